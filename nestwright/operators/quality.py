"""Row checks compiled from a specification: an array of issues per row, and what to do with it.

A rule is a column that is null or an array of one issue; nested properties are checked too, satellite fields are not part of the
primary row. One projection finds all issues, one aggregation counts them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import QualityError
from nestwright.functions import scalars as S
from nestwright.plans.compiler import _column
from nestwright.plans.spec import MappingSpec, PropertySpec

ISSUE = "struct<property_path:string,severity:string,message:string,expected:string,actual:string>"


def _issue(cond: Column, path: str, severity: str, message: Column | str, expected: str = "", actual: Column | None = None) -> Column:
    """An array of one issue, or null."""
    text = F.lit(message) if isinstance(message, str) else message
    actual = F.lit("") if actual is None else F.coalesce(actual, F.lit(""))
    return F.when(cond, F.array(F.struct(F.lit(path).alias("property_path"), F.lit(severity).alias("severity"), text.alias("message"), F.lit(expected).alias("expected"), actual.alias("actual"))))


def date_issue(text: Column, path: str) -> list[Column]:
    """The whole value as a strict date: three numeric parts, zero-padded, in the calendar."""
    parts = text.rlike("^[0-9]+-[0-9]+-[0-9]+$")
    padded = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    real = F.try_to_date(F.when(padded, text), "yyyy-MM-dd").isNotNull()
    return [
        _issue(~parts, path, "warning", "not a date of three numeric parts", "YYYY-MM-DD", text),
        _issue(parts & ~padded, path, "warning", "date is not zero-padded", "YYYY-MM-DD", text),
        _issue(padded & ~real, path, "warning", "not a calendar date", "YYYY-MM-DD", text),
    ]


@dataclass
class Rules:
    """Compiled rules of a mapping over a source schema."""

    issues: Column
    record_id: Column

    def check(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``record_id``, ``issues`` and ``conforms`` of each row."""
        rows = df.select(*(_column(c) for c in keep), self.record_id.alias("record_id"), self.issues.alias("issues"))
        return rows.withColumn("conforms", ~F.exists("issues", lambda i: i["severity"] == "error"))


def compile_rules(spec: MappingSpec, schema: T.StructType, allowed: dict[str, list[str]] | None = None) -> Rules:
    """Rules: id and required fields are there (errors); empty segments, dates, timestamps, integers, allowed values (warnings)."""
    kinds = {f.name: f.dataType for f in schema.fields}
    allowed = allowed or {}
    columns = ", ".join(sorted(kinds))
    rules: list[Column] = []
    lists: list[Column] = []

    def source(name: str) -> tuple[Column, T.DataType]:
        return (_column(name), kinds[name]) if name in kinds else (F.lit(None).cast("string"), T.StringType())

    def walk(p: PropertySpec, prefix: str) -> None:
        if p.source_table:
            return
        for f in p.fields:
            path = f"{prefix}{p.name}.{f.target}"
            c, kind = source(f.source)
            missing = S.is_missing(c, kind, collections=False)
            if not f.optional:
                rules.append(_issue(missing, path, "error", f"required field '{f.source}' is missing; columns: {columns}", "a value"))
            if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                continue
            text = F.when(~missing, c.cast("string"))
            parts = F.split(text, "\\Q" + p.split_on + "\\E") if p.cardinality == "multiple" else None
            if parts is not None:
                blank = F.filter(F.transform(parts, lambda x, i: F.when(S.strip(x) == "", i)), lambda i: i.isNotNull())
                rules.append(_issue(F.size(blank) > 0, path, "warning", F.concat(F.lit("empty segments at "), F.array_join(blank.cast("array<string>"), ", ")), "", text))
            if f.datatype == "xsd:date":
                rules.extend(date_issue(text, path))
            elif f.datatype == "xsd:dateTime":
                rules.append(_issue(~text.contains("T") & ~text.contains(" "), path, "warning", "not a date and time", "YYYY-MM-DDThh:mm:ss", text))
            elif f.datatype in ("xsd:integer", "xsd:int"):
                number = S.strip(text).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
                rules.append(_issue(~number, path, "warning", "not a number", f.datatype, text))
            if values := allowed.get(path, allowed.get(f"{p.name}.{f.target}")):
                pieces = parts if parts is not None else F.array(text)
                if f.multi_value_split:
                    pieces = F.flatten(F.transform(pieces, lambda x: F.split(x, "\\Q" + f.multi_value_split + "\\E")))
                odd = F.filter(F.transform(pieces, S.strip), lambda x: (x != "") & ~F.array_contains(F.lit(list(values)), x))
                expected = ", ".join(values)
                lists.append(F.transform(F.when(text.isNotNull(), odd), lambda x: F.struct(F.lit(path).alias("property_path"), F.lit("warning").alias("severity"), F.lit("value is not allowed").alias("message"), F.lit(expected).alias("expected"), x.alias("actual"))))
        for q in p.properties:
            walk(q, f"{prefix}{p.name}.")

    ident, kind = source(spec.id_source)
    rules.append(_issue(S.is_missing(ident, kind, collections=False), "@id", "error", f"ID source field '{spec.id_source}' is missing", "a value"))
    for p in spec.properties:
        walk(p, "")
    none = F.expr(f"cast(array() as array<{ISSUE}>)")
    # arrays of one or none, joined: a filter over an array of all rules would take them out of generated code
    found = F.concat(*(F.coalesce(x, none) for x in [*rules, *lists]))
    record = F.coalesce(ident.cast("string"), F.lit("None")) if spec.id_source in kinds else F.lit("unknown")
    return Rules(found, record)


def issue_table(checked: DataFrame) -> DataFrame:
    """One row per issue: record_id, property_path, severity, message, expected, actual.

    A plain explode would have Spark filter on the size of ``issues`` first, and so evaluate all rules twice.
    """
    return checked.select("record_id", F.explode_outer("issues").alias("i")).where("i is not null").select("record_id", "i.*")


def summary(checked: DataFrame) -> DataFrame:
    """One row: total_records, error_count, warning_count, failed_records, conforms."""
    count = lambda s: F.coalesce(F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s))), F.lit(0))
    return checked.agg(F.count(F.lit(1)).alias("total_records"), count("error").alias("error_count"), count("warning").alias("warning_count"), F.count_if(~F.col("conforms")).alias("failed_records")).withColumn("conforms", F.col("error_count") == 0)


class CheckResult(NamedTuple):
    """The one-row table of counters and the table of issues."""

    table: DataFrame
    issues: DataFrame

    def facts(self) -> dict:
        return self.table.head().asDict()

    def summary(self) -> str:
        f = self.facts()
        return f"{'conforms' if f['conforms'] else 'does not conform'}: {f['total_records']} records, {f['error_count']} errors, {f['warning_count']} warnings"

    def to_dict(self, most: int = 1000) -> dict:
        """Counters and the first ``most`` issues; ``issues`` is the whole table."""
        return {**self.facts(), "issues": [r.asDict() for r in self.issues.limit(most).collect()]}

    def to_dataframe(self) -> DataFrame:
        """Issues beside the counters of the run."""
        f = self.facts()
        return self.issues.select("*", *(F.lit(f[c]).alias(c) for c in ("conforms", "total_records", "error_count", "warning_count")))


def first_strict(checked: DataFrame) -> None:
    """Raises on the first issue of any severity; stops at the first row that has one."""
    row = checked.where(F.size("issues") > 0).select("record_id", F.get("issues", F.lit(0)).alias("i")).head()
    if row:
        raise QualityError(f"record {row.record_id}: {row.i.property_path}: {row.i.message}")


def sample(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """A simple random sample of max(1, int(n * rate)) rows without replacement, the same for one seed.

    Rows draw numbers of 24 bits; two counts by half of the bits (at most 4096 rows each) tell the largest number that is
    still taken, so nothing is sorted. Only among the rows of that one number a limit decides.
    """
    drawn = df.withColumn("_draw", F.floor(F.rand(seed) * (1 << 24)).cast("int"))
    counts = lambda rows, by: sorted((r[0], r[1]) for r in rows.groupBy(by.alias("d")).count().collect())
    high = counts(drawn, F.shiftright("_draw", 12))
    left = max(1, int(sum(n for _, n in high) * rate))

    def cut(table: list[tuple[int, int]], left: int) -> tuple[int, int]:
        for d, n in table:
            if n >= left:
                return d, left
            left -= n
        return (table[-1][0], table[-1][1]) if table else (0, 0)

    first, left = cut(high, left)
    last, left = cut(counts(drawn.where(F.shiftright("_draw", 12) == first), F.col("_draw")), left)
    return drawn.where(F.col("_draw") < last).unionByName(drawn.where(F.col("_draw") == last).limit(left)).drop("_draw")


def duplicate_ids(documents: DataFrame, id_col: str = "id") -> DataFrame:
    """``id`` and ``n`` of identifiers that occur more than once."""
    return documents.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
