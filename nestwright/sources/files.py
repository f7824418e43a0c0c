"""File, table and in-memory sources as DataFrames. Missing values are nulls; columns of text formats are text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import SourceError

#: Cells that count as missing in delimited text.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", missing: tuple[str, ...] = (), multiline: bool = True) -> DataFrame:
    """Header row, text columns, short rows filled with nulls. Without quoted line breaks ``multiline=False`` splits files."""
    df = spark.read.options(header=True, sep=delimiter, encoding=encoding, multiLine=multiline, escape='"', mode="PERMISSIVE", enforceSchema=False).csv(path)
    gone = [*MISSING, *missing]
    return df.select(*(F.when(~F.col(f"`{c}`").isin(gone), F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Column pruning and filters reach the files; ``count()`` reads footers alone."""
    df = spark.read.parquet(path)
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = True) -> DataFrame:
    """One JSON object per line, values as text; byte-order marks and blank lines are skipped.

    A line that is no JSON object stops the read, or with ``strict=False`` gives a row of nulls.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    if schema is None:
        reader = spark.read.options(primitivesAsString=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        texts = getattr(lines._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = T._parse_datatype_json_string(reader._jreader.json(texts).schema().json())  # inferred inside the JVM
        schema = T.StructType([f for f in schema.fields if f.name != "_bad"])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    good = F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json("value").isNotNull()
    row = F.when(good, parsed)
    if strict:
        row = F.when(good, parsed).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 200))))
    return lines.select(row.alias("r")).select("r.*")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """One sheet as text columns. Excel files are read on the driver, with pandas and openpyxl."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet, header=header, dtype=str)
    except ImportError as e:
        raise SourceError("reading Excel files needs openpyxl") from e
    return read_rows(spark, frame.astype(object).where(frame.notna(), None).to_dict("records"), list(map(str, frame.columns)))


def read_rows(spark: SparkSession, rows: dict | Iterable[dict], columns: list[str] | None = None) -> DataFrame:
    """Dicts as a DataFrame over the union of their keys. Columns of one type keep it, mixed and empty ones become text."""
    rows = [rows] if isinstance(rows, dict) else list(rows)
    names = columns or list(dict.fromkeys(k for r in rows for k in r))

    def kind(name: str) -> T.DataType:
        seen = {type(r[name]) for r in rows if r.get(name) is not None}
        if seen == {bool}:
            return T.BooleanType()
        if seen == {int} and all(abs(r[name]) < 1 << 63 for r in rows if r.get(name) is not None):
            return T.LongType()
        if seen and seen <= {int, float}:
            return T.DoubleType()
        if seen == {list} and all(isinstance(x, str) for r in rows for x in r.get(name) or []):
            return T.ArrayType(T.StringType())
        return T.StringType()

    kinds = {n: kind(n) for n in names}

    def cell(name: str, v):
        if v is None or isinstance(kinds[name], T.ArrayType):
            return v
        if isinstance(kinds[name], T.StringType):
            if v != v or v in ([], {}, ()):  # NaN and empty collections are missing values
                return None
            return json.dumps(v) if isinstance(v, (dict, list)) else str(v)
        return float(v) if isinstance(kinds[name], T.DoubleType) else v

    return spark.createDataFrame([tuple(cell(n, r.get(n)) for n in names) for r in rows], T.StructType([T.StructField(n, kinds[n]) for n in names]))


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options) -> DataFrame:
    """A query or table of a database. With a partition column and bounds the scan is parallel; filters are pushed down."""
    if (query is None) == (table is None):
        raise SourceError("either a query or a table")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
        return reader.option("dbtable", table or f"({query}) q").load()
    return (reader.option("query", query) if query else reader.option("dbtable", table)).load()


def source_for(spark: SparkSession, path: str, **options) -> DataFrame:
    """A reader by file extension."""
    kind = PurePath(path.rstrip("/")).suffix.lower()
    readers = {".csv": read_csv, ".ndjson": read_ndjson, ".jsonl": read_ndjson, ".parquet": read_parquet, ".xlsx": read_excel, ".xls": read_excel}
    if kind not in readers:
        raise SourceError(f"no reader for {kind or 'files without an extension'}; known: {', '.join(sorted(readers))}")
    return readers[kind](spark, path, **options)


def batches(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Rows on the driver in lists of ``size``, the last one shorter; one partition is held at a time."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


@dataclass(frozen=True)
class Source:
    """A source as an object: what reads it, and its rows as a frame, in batches, or counted.

    Any object with ``frame(spark)`` can stand in for one, so sources are pluggable.
    """

    read: Callable[[SparkSession], DataFrame]

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.read(spark)

    def rows(self, spark: SparkSession) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.frame(spark).toLocalIterator())

    def batches(self, spark: SparkSession, size: int = 1000) -> Iterator[list[Row]]:
        return batches(self.frame(spark), size)

    def count(self, spark: SparkSession) -> int:
        return self.frame(spark).count()


def source(reader: Callable[..., DataFrame], *args, **options) -> Source:
    """A ``Source`` of one of the ``read_...`` functions and its arguments."""
    return Source(lambda spark: reader(spark, *args, **options))
