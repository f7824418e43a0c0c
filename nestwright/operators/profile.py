"""Column profiles: null and distinct shares, inferred type, delimiter, date form, small value sets.

Columns are looked at one below the other: one aggregation by column and value, pre-aggregated before its shuffle, then
one by column over distinct values and their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.functions.scalars import is_blank, strip
from nestwright.plans.compiler import _column

#: Forms of dates with their names, and texts that stand for truth values.
DATE_FORMS = {
    r"^\d{4}-\d{2}-\d{2}$": "YYYY-MM-DD",
    r"^\d{2}/\d{2}/\d{4}$": "MM/DD/YYYY",
    r"^\d{2}-\d{2}-\d{4}$": "MM-DD-YYYY",
}
DATES = "|".join(DATE_FORMS)
TRUTHS = ("true", "false", "yes", "no", "0", "1")
_INT, _FLOAT = r"^[+-]?[0-9]+$", r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
_MOST_VALUES = 20


def date_form(c: Column) -> Column:
    """The name of the form that a text has as a date; null for other texts."""
    out = F.lit(None).cast("string")
    for form, name in DATE_FORMS.items():
        out = F.coalesce(out, F.when(c.rlike(form), name))
    return out


def _kind(v: Column, n: Column) -> Column:
    """The type that ``n`` occurrences of each value ``v`` make together; null values count nothing."""
    total = F.sum(F.when(v.isNotNull(), n))
    held = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    low = F.lower(v)
    special = held(low.rlike("^[+-]?(inf|infinity|nan)$"))
    return (
        F.when(total.isNull(), "string")
        .when(held(v.rlike(DATES)) >= 0.8 * total, "date")
        .when(held(v.rlike(_INT)) == total, "integer")
        .when((held(low.rlike(_FLOAT)) == total) & (special < total), "float")
        .when(held(low.isin(*TRUTHS)) == total, "boolean")
        .otherwise("string")
    )


def profile(df: DataFrame, columns: list[str] | None = None, sample_size: int | None = 100) -> DataFrame:
    """One row per column: column, total, null_rate, unique_rate, distinct_count, inferred_type, delimiter,
    date_pattern (form of the first value) and values (sorted, at most 20, else empty).

    ``sample_size`` rows are looked at, all when it is None.
    """
    names = columns or df.columns
    rows = df.select(*(_column(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)))
    rows = rows.limit(sample_size) if sample_size else rows
    text = [F.when(~is_blank(F.col(f"c{i}")), strip(F.col(f"c{i}"))) for i in range(len(names))]
    cells = rows.select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.array(*text)).alias("i", "v"))
    counted = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    v, n = F.col("v"), F.col("n")
    full = F.sum(F.when(v.isNotNull(), n))
    share = lambda mark: F.sum(F.when(F.contains(v, F.lit(mark)), n)) / full > 0.1
    facts = counted.groupBy("i").agg(
        F.sum("n").alias("total"),
        (1 - F.coalesce(full, F.lit(0)) / F.sum("n")).alias("null_rate"),
        F.coalesce(F.count("v") / full, F.lit(0.0)).alias("unique_rate"),
        F.count("v").alias("distinct_count"),
        _kind(v, n).alias("inferred_type"),
        F.when(share("|"), "|").when(share(","), ",").alias("delimiter"),
        date_form(F.min_by(v, F.when(v.isNotNull(), F.col("at")))).alias("date_pattern"),
    )
    small = facts.where(f"distinct_count <= {_MOST_VALUES}").select("i")
    sets = counted.where("v is not null").join(small, "i", "left_semi").groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("values"))
    named = F.element_at(F.lit(list(names)), F.col("i") + 1).alias("column")
    empty = F.array().cast("array<string>")
    none = df.sparkSession.createDataFrame([(i,) for i in range(len(names))], "i int")  # an empty table has columns, too
    out = none.join(facts, "i", "left").join(sets, "i", "left").orderBy("i")
    zero = lambda c, x: F.coalesce(c, F.lit(x)).alias(c)
    return out.select(named, zero("total", 0), zero("null_rate", 0.0), zero("unique_rate", 0.0), zero("distinct_count", 0), zero("inferred_type", "string"), "delimiter", "date_pattern", F.coalesce("values", empty).alias("values"))
