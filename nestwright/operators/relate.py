"""Nesting join: a primary row with the rows of each satellite as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.errors import ConfigError
from nestwright.functions.scalars import is_blank
from nestwright.plans.compiler import RELATED, _column


def nest_join(primary: DataFrame, key: str, satellites: dict[str, DataFrame], satellite_key: str | dict[str, str] | None = None, order_by: dict[str, list[str]] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """``primary`` with ``__related__``: for each satellite an array of its matching rows, empty without a match.

    Keys are compared as text. Satellite rows with a null or blank key match nothing, and null primary keys match
    nothing. Rows in an array follow ``order_by`` columns, else the satellite's scan order. Each satellite is
    grouped before the join, so the join is one row to one row on the key. ``columns`` names what a satellite's rows keep
    (all without an entry; ``MappingSpec.satellite_columns`` tells what a mapping reads), so the others are never read.
    All rows of one key become one array: a key may have as many as one row of Spark can hold (2 GB).
    """
    if not (key or "").strip() or not satellites:
        raise ConfigError("a join key and at least one satellite are needed")
    out = primary.withColumn("_key", F.coalesce(_column(key).cast("string"), F.lit("")))
    parts = []
    for i, (name, sat) in enumerate(satellites.items()):
        own = (satellite_key.get(name, key) if isinstance(satellite_key, dict) else satellite_key) or key
        order = [_column(c) for c in (order_by or {}).get(name, [])] or [F.monotonically_increasing_id()]
        kept = (columns or {}).get(name)
        row = F.struct(*(_column(c) for c in sat.columns if kept is None or c in kept))
        text = _column(own).cast("string")
        grouped = sat.where(~is_blank(text)).select(text.alias(f"_k{i}"), F.struct(F.struct(*(o.alias(f"o{j}") for j, o in enumerate(order))).alias("o"), row.alias("r")).alias("e")).groupBy(f"_k{i}").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["r"]).alias(f"_rows{i}"))
        out = out.join(grouped, F.col("_key") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        parts.append(F.coalesce(f"_rows{i}", F.array().cast(grouped.schema[f"_rows{i}"].dataType)).alias(name))
    return out.withColumn(RELATED, F.struct(*parts)).drop("_key", *(f"_rows{i}" for i in range(len(parts))))
