"""Files of lines as data sources: metrics in the text form that scrapers read (S18), and benchmark rows of several kinds.

Writers commit all or nothing. Each task writes a file of its own name and reports it; the driver then puts the list of a
write's files in place by one rename. Readers read what the list names, so files of failed or repeated tasks are never seen, and a reader sees
a write whole or not at all. Folders may lie in any file system that Arrow opens: local ones, HDFS, object stores.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Name of the list of files.
LIST = "_files.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str) -> list[str]:
    system, root = _open(path)
    if system.get_file_info(f"{root}/{LIST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{LIST}") as f:
        return json.loads(f.readall())


@dataclass
class Written(WriterCommitMessage):
    """A task's file; None if it had no rows."""

    name: str | None


@dataclass
class File(InputPartition):
    name: str


class LineWriter(DataSourceWriter):
    """Writes rows as the lines that `lines` of the source makes of them."""

    def __init__(self, path: str, source: LineSource, overwrite: bool) -> None:
        self.path, self.source, self.overwrite = path, source, overwrite

    def write(self, rows: Iterator[Any]) -> Written:
        name, out = f"part-{uuid.uuid4().hex}.txt", None
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        try:
            for row in rows:
                if out is None:
                    out = system.open_output_stream(f"{root}/{name}")
                out.write("".join(line + "\n" for line in self.source.lines(row.asDict())).encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        before = [] if self.overwrite else _listed(self.path)
        new = sorted(m.name for m in messages if m and m.name)
        held = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(held) as f:
            f.write(json.dumps(before + new).encode())
        system.move(held, f"{root}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/{m.name}")


class LineReader(DataSourceReader):
    """A partition for each file of the list."""

    def __init__(self, path: str, source: LineSource) -> None:
        self.path, self.source = path, source

    def partitions(self) -> list[File]:
        return [File(n) for n in _listed(self.path)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        system, root = _open(self.path)
        kept: dict[str, Any] = {}
        with system.open_input_stream(f"{root}/{partition.name}") as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                for line in whole:
                    yield from self.source.rows(line.decode("utf-8", "replace"), kept)
            yield from self.source.rows(rest.decode("utf-8", "replace"), kept)


class LineSource(DataSource):
    """Option path: the folder. Subclasses say how a row becomes lines and lines become rows."""

    def writer(self, schema: Any, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self, overwrite)

    def reader(self, schema: Any) -> LineReader:
        return LineReader(self.options["path"], self)

    def lines(self, row: dict) -> list[str]:
        raise NotImplementedError

    def rows(self, line: str, kept: dict) -> Iterator[tuple]:
        """Rows of a line; `kept` is what the file's lines before it left behind."""
        raise NotImplementedError


_SAMPLE = re.compile(r"([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})? (\S+)(?: (-?\d+))?")
_LABEL = re.compile(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"(?:,|$)')
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n"}


class Exposition(LineSource):
    """Metrics as text: `name{label="value"} number` behind a line with the metric's type.

    Rows: name, type (null: untyped), labels (map), value (double). A file's type lines hold for the samples behind them; comments, and
    lines that are no samples, give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "exposition"

    def schema(self) -> str:
        return "name string, type string, labels map<string,string>, value double"

    def lines(self, row: dict) -> list[str]:
        said = {k: "".join(_ESCAPES.get(c, c) for c in v or "") for k, v in sorted((row["labels"] or {}).items())}
        labels = "{" + ",".join(f'{k}="{v}"' for k, v in said.items()) + "}" if said else ""
        number = float(row["value"])
        text = {float("inf"): "+Inf", float("-inf"): "-Inf"}.get(number, "NaN" if number != number else repr(int(number)) if number.is_integer() and abs(number) < 2**53 else repr(number))
        return [f"# TYPE {row['name']} {row['type']}"] * bool(row["type"]) + [f"{row['name']}{labels} {text}"]

    def rows(self, line: str, kept: dict) -> Iterator[tuple]:
        told = re.fullmatch(r"# TYPE (\S+) (\S+)\s*", line)
        if told:
            kept[told[1]] = told[2]
            return
        m = _SAMPLE.fullmatch(line.strip()) if not line.startswith("#") else None
        if m:
            plain = lambda v: re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], v)
            try:
                value = float(m[3])
            except ValueError:
                return
            yield m[1], kept.get(m[1]), {k: plain(v) for k, v in _LABEL.findall(m[2] or "")}, value


class BenchmarkLines(LineSource):
    """JSON lines of a benchmark in one file: items asked for (url, phrases), results (with a grade) and summaries (with n).

    Rows: kind (item, result, summary; other for objects that are none), then the fields of all kinds, null where a kind hasn't got them.
    Unknown fields are left out; lines that are no JSON objects give no rows, and a field of another type is null.
    """

    fields = (("url", str), ("phrases", list), ("candidate", str), ("pass", str), ("grade", str), ("seconds", float), ("chars", int), ("coverage", float), ("n", int), ("n_ok", int))

    @classmethod
    def name(cls) -> str:
        return "benchmark_lines"

    def schema(self) -> str:
        kinds = {str: "string", list: "array<string>", float: "double", int: "bigint"}
        return "kind string, " + ", ".join(f"{f} {kinds[t]}" for f, t in self.fields)

    def lines(self, row: dict) -> list[str]:
        return [json.dumps({f: row[f] for f, _ in self.fields if row.get(f) is not None}, ensure_ascii=False)]

    def rows(self, line: str, kept: dict) -> Iterator[tuple]:
        try:
            x = json.loads(line)
        except ValueError:
            return
        if not isinstance(x, dict):
            return

        def read(f: str, kind: type) -> Any:
            v = x.get(f)
            if kind is float and isinstance(v, int) and not isinstance(v, bool):
                return float(v)
            if kind is list:
                return [str(i) for i in v] if isinstance(v, list) else None
            return v if isinstance(v, kind) and not isinstance(v, bool) else None

        kind = "result" if "grade" in x else "summary" if "n" in x else "item" if "url" in x else "other"
        yield kind, *(read(f, t) for f, t in self.fields)


def full(rows: DataFrame) -> DataFrame:
    """Rows with all columns of benchmark_lines, null where they have none."""
    kinds = {str: "string", list: "array<string>", float: "double", int: "bigint"}
    there = [F.col(f).cast(kinds[t]) if f in rows.columns else F.lit(None).cast(kinds[t]).alias(f) for f, t in BenchmarkLines.fields]
    return rows.select(F.lit(None).cast("string").alias("kind"), *there)


def register(spark: SparkSession) -> None:
    """Makes the formats `exposition` and `benchmark_lines` known to a session."""
    for source in (Exposition, BenchmarkLines):
        spark.dataSource.register(source)
