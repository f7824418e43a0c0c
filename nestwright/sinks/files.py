"""Writing documents and reports: part files with save modes, single files, dead letters."""

from __future__ import annotations

import gzip
import html
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nestwright.errors import SinkError
from nestwright.functions.scalars import formula_guard
from nestwright.shared import shared_folder

MODES = {"error": "errorifexists", "overwrite": "overwrite", "append": "append"}


@dataclass
class SinkResult:
    records: int
    bytes: int
    path: str
    files: int = 0
    errors: list[str] = field(default_factory=list)


@runtime_checkable
class Sink(Protocol):
    """What ``Pipeline.to_sink`` takes: something that writes a DataFrame of one column of JSON texts."""

    def write(self, json_docs: DataFrame) -> SinkResult: ...


@runtime_checkable
class ChunkSink(Protocol):
    """The other thing it takes: something that is handed lists of documents on the driver, one after another."""

    chunk_size: int

    def open(self) -> None: ...
    def write_chunk(self, docs: list[dict]) -> None: ...
    def close(self) -> SinkResult: ...


class Folder:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str, options: dict[str, str] | None = None):
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in (options or {}).items():
            conf.set(k, v)
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at)) if self.fs.exists(self.at) else []

    def clear(self) -> None:
        self.fs.delete(self.at, True)


_PART = re.compile(r"part-(\d{5,})\.ndjson")


@dataclass
class NDJSONSink:
    """Newline-delimited part files named ``part-00000.ndjson``, ``part-00001.ndjson``, ... and ``_SUCCESS``.

    Tasks write in parallel below a folder of their own, whose files then get their names: a rename each, by the driver.
    ``error`` refuses a folder with such part files, ``overwrite`` empties the folder, ``append`` counts on.
    """

    path: str
    chunk_size: int = 10_000
    mode: str = "error"
    workers: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES or self.chunk_size < 1:
            raise SinkError("mode is error, overwrite or append; chunk_size is positive")

    def write(self, json_docs: DataFrame) -> SinkResult:
        folder = Folder(json_docs.sparkSession, self.path, self.options)
        there = [int(m[1]) for n in folder.names() if (m := _PART.fullmatch(n))]
        if self.mode == "error" and there:
            raise SinkError(f"{self.path} already has {len(there)} part files")
        if self.mode == "overwrite":
            folder.clear()
            there = []
        staging = f"_writing-{uuid.uuid4().hex}"
        done = write_parts(json_docs, f"{self.path.rstrip('/')}/{staging}", "error", self.chunk_size, self.workers)
        inner = Folder(json_docs.sparkSession, f"{self.path.rstrip('/')}/{staging}")
        next_one = max(there, default=-1) + 1
        parts = [n for n in inner.names() if n.startswith("part-") and inner.fs.getFileStatus(inner.path(n)).getLen()]
        for i, name in enumerate(parts):
            if not folder.fs.rename(inner.path(name), folder.path(f"part-{next_one + i:05d}.ndjson")):
                raise SinkError(f"cannot name {name} in {self.path}")
        inner.clear()
        folder.fs.create(folder.path("_SUCCESS"), True).close()
        return SinkResult(done.records, done.bytes, self.path, len(parts))


class ADLSink(NDJSONSink):
    """The same below ``abfss://`` (or any Hadoop address); ``options`` are Hadoop settings such as account keys."""


def write_chunks(json_docs: DataFrame, sink: ChunkSink) -> SinkResult:
    """Documents in lists of ``sink.chunk_size`` through the driver, for sinks that are no file system."""
    sink.open()
    held: list[dict] = []
    for row in json_docs.toLocalIterator(prefetchPartitions=True):
        held.append(json.loads(row[0]))
        if len(held) == sink.chunk_size:
            sink.write_chunk(held)
            held = []
    if held:
        sink.write_chunk(held)
    return sink.close()


def write_parts(json_docs: DataFrame, path: str, mode: str = "error", chunk_size: int = 10_000, workers: int | None = None, compression: str | None = None) -> SinkResult:
    """One column of JSON texts as newline-delimited part files of at most ``chunk_size`` records, with ``_SUCCESS``.

    Any file system that Spark knows works; tasks write in parallel, ``workers`` sets their number.
    """
    if mode not in MODES or chunk_size < 1:
        raise SinkError("mode is error, overwrite or append; chunk_size is positive")
    seen = Observation()
    c = json_docs.columns[0]
    rows = json_docs.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(c) + 1), F.lit(0)).alias("b"))
    writer = (rows.repartition(workers) if workers else rows).write.mode(MODES[mode]).option("maxRecordsPerFile", chunk_size)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
    return SinkResult(seen.get["n"], seen.get["b"], path)


def texts(json_docs: DataFrame) -> Iterator[str]:
    """The texts of one column on the driver, in the order of the partitions; some lines are held, not a partition.

    Tasks write packed files into the shared folder, which are fetched one after another. Without such a folder
    partitions are fetched whole.
    """
    spark = json_docs.sparkSession
    try:
        path = shared_folder(spark, "texts")
    except ValueError:
        for row in json_docs.toLocalIterator():
            yield row[0]
        return
    try:
        json_docs.write.option("maxRecordsPerFile", 100_000).option("compression", "gzip").text(path)
        folder = Folder(spark, path)
        parts = sorted((int(m[1]), int(m[2]), n) for n in folder.names() if (m := re.fullmatch(r"part-(\d+)-.*-c(\d+)\.txt\.gz", n)))
        with tempfile.TemporaryDirectory(prefix="nestwright-") as own:
            for *_, name in parts:
                folder.fs.copyToLocalFile(False, folder.path(name), folder.jvm.org.apache.hadoop.fs.Path(f"file://{own}/part.gz"), True)
                with gzip.open(f"{own}/part.gz", "rt", encoding="utf-8", newline="\n") as f:
                    for line in f:
                        yield line.removesuffix("\n")
    finally:
        Folder(spark, path).clear()


def write_single(json_docs: DataFrame, path: str, form: str = "ndjson", pretty: bool = False) -> SinkResult:
    """One local file, ``ndjson`` or a JSON ``array``, streamed through the driver."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n, part = 0, target.with_name(target.name + ".part")
    with open(part, "w", encoding="utf-8") as f:
        if form == "array":
            f.write("[")
        for text in texts(json_docs) if isinstance(json_docs, DataFrame) else json_docs.texts():
            text = json.dumps(json.loads(text), indent=2, ensure_ascii=False) if pretty else text
            if form == "array":
                f.write((",\n" if n else "\n") + ("\n".join("  " + x for x in text.split("\n")) if pretty else text))
            else:
                f.write(text + "\n")
            n += 1
        if form == "array":
            f.write("\n]\n" if n else "]\n")
    os.replace(part, target)
    return SinkResult(n, target.stat().st_size, path)


def write_dead_letters(rejected: DataFrame, path: str, error_col: str = "_error", mode: str = "append") -> int:
    """Rejected rows as ``{"_error": ..., "_record": {...}}`` lines; nothing is written when there are none."""
    record = F.struct(*(F.col(f"`{c}`") for c in rejected.columns if c != error_col))
    lines = rejected.select(F.to_json(F.struct(F.col(error_col).alias("_error"), record.alias("_record"))).alias("value"))
    if lines.isEmpty():
        return 0
    return write_parts(lines, path, mode).records


def report_csv(issues: DataFrame, path: str) -> None:
    """Issues as CSV, with cells that a spreadsheet would take for formulas quoted."""
    issues.select(*(formula_guard(F.col(c).cast("string")).alias(c) for c in issues.columns)).write.mode("overwrite").option("header", True).csv(path)


def report_parquet(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").parquet(path)


def _entries(issues: DataFrame) -> Iterator[dict]:
    return (r.asDict() for r in issues.toLocalIterator(prefetchPartitions=True))


def report_json(summary: dict, issues: DataFrame, path: str) -> None:
    """Run facts, counters and every issue as one JSON file, streamed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(summary, indent=2, default=str).rstrip("}").rstrip() + ("," if summary else "") + '\n  "issues": [')
        for i, row in enumerate(_entries(issues)):
            f.write((",\n    " if i else "\n    ") + json.dumps(row, default=str))
        f.write("\n  ]\n}\n")


def report_html(summary: dict, issues: DataFrame, path: str) -> None:
    """A self-contained page of every issue, streamed; everything is escaped, lists included."""
    cell = lambda x: f"<td>{html.escape(', '.join(map(str, x)) if isinstance(x, (list, tuple)) else '' if x is None else str(x))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in issues.columns)
    facts = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in summary.items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>Validation</title><style>td,th{{border:1px solid #999;padding:2px 6px}}</style><h1>Validation</h1><ul>{facts}</ul><table><tr>{head}</tr>\n")
        for row in _entries(issues):
            f.write("<tr>" + "".join(map(cell, row.values())) + "</tr>\n")
        f.write("</table>\n")
