"""Where intermediate tables go, and how many parts a table is worked in."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block of text, what one task holds at a time, takes this part of a core's share of an executor's memory (its arrays take some 15 times as much).
BLOCK_PART = 128


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a temporary one only where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not told and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="heddle-"))
    return jsc.getCheckpointDir().get()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session or the folder is gone
        return


#: Folders of the tables that the run under way has stored; a thread beside it has its own run or none.
_RUN: ContextVar[list[str] | None] = ContextVar("heddle_run", default=None)


@contextmanager
def run() -> Iterator[list[str]]:
    """Notes the tables that are stored within it (in this thread), for drop_run(). Runs may lie within one another."""
    token = _RUN.set([])
    try:
        yield _RUN.get()
    finally:
        _RUN.reset(token)


def drop_run(tables: list[str], keep: DataFrame) -> None:
    """Deletes a run's tables but for one; whatever reads the others is done with."""
    own = getattr(keep, "_heddle_path", None)
    for path in tables:
        if path != own:
            _delete(keep.sparkSession, path)
    tables[:] = [own] if own else []


def _note(path: str) -> None:
    if _RUN.get() is not None:
        _RUN.get().append(path)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.

    The folder stays for what reads it later: an operator's result is lazy and reads its tables when it is used. Who has used
    it deletes them with run() and drop_run(), or with the shared folder itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _note(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._heddle_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes the files of a stored table; nothing may read it afterwards."""
    path = getattr(df, "_heddle_path", None)
    if path:
        _delete(df.sparkSession, path)


def stored_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As stored(), bucketed by `key`: grouping or joining the rows by it needs no further shuffle of them.

    Spark buckets only tables of its catalog, so a table of an unused name is made in the current database, whose files lie in the
    shared folder, and unregistered at once, also if writing fails. The session needs leave to create tables there.
    """
    spark = df.sparkSession
    name = f"heddle_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _note(path)
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).format("parquet").saveAsTable(name)
        out = spark.table(name)
    finally:
        # the table's name is only needed to find it once; its files stay
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    out._heddle_path = path
    return out


def memory_of_core(spark: SparkSession) -> int:
    """Bytes of an executor's heap for each of its cores."""
    conf = spark.sparkContext.getConf()
    local = re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", ""))
    told = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", told).groups()
    memory = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    master = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*\]", conf.get("spark.master", ""))
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", master[1] if master else "1"))
    return memory // max(cores, 1)


def default_block(spark: SparkSession) -> int:
    """Bytes of a block by the executors' memory and cores: 4 to 256 MB."""
    return max(4 << 20, min(256 << 20, memory_of_core(spark) // BLOCK_PART))


def bounded(df: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """The same rows in a session of their own whose Arrow batches hold at most a block's bytes; the caller's session stays as it is."""
    spark = df.sparkSession
    most = block_bytes or default_block(spark)
    session = spark._jsparkSession.cloneSession()
    now = int(re.match(r"\d+", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))[0])
    session.conf().set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(most, now)))
    frame = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().analyzed())
    return DataFrame(frame, SparkSession(spark.sparkContext, session))
