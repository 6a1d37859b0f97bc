"""Tables in, documents out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_request_order(urls: DataFrame) -> DataFrame:
    """One row per URL of each batch with its place (S1). urls: batch_id, urls (array)."""
    return urls.select("batch_id", F.posexplode("urls").alias("pos", "url"))


def error_documents(rows: DataFrame) -> DataFrame:
    """Failures as documents of the same shape, never dropped (S17). rows: url, text, kind (null: good)."""
    text = F.when(F.col("kind").isNull(), F.col("text")).otherwise(F.concat(F.lit("error: "), "kind"))
    return rows.select("url", text.alias("page_content"), F.map_from_arrays(F.array(F.lit("source"), F.lit("kind")), F.array(F.col("url"), F.coalesce("kind", F.lit("ok")))).alias("metadata"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables in between, which the driver and all executors see."""
    checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/w-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() work: the cluster's folder from spark.checkpoint.dir, a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="heddle-"))
