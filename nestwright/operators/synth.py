"""Synthetic source rows for a mapping: seeded, distributed, the same for the same seed and row count.

A field draws from its pool of allowed values, else from a generator for its datatype and name. Fields of one
``multiple`` property get the same number of segments.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.plans.spec import FieldSpec, MappingSpec

#: Pools by what a field's name holds.
NAMES = {
    "firstname": ["Ana", "Ben", "Chen", "Dara", "Eli", "Fatima", "Grace", "Hugo", "Iris", "Jonas"],
    "middlename": ["A", "B", "J", "K", "Lee", "M", "R", "S"],
    "lastname": ["Adams", "Brown", "Chavez", "Diaz", "Evans", "Fischer", "Garcia", "Hill", "Ito", "Jones"],
    "surname": ["Adams", "Brown", "Chavez", "Diaz", "Evans", "Fischer", "Garcia", "Hill", "Ito", "Jones"],
    "suffix": ["II", "III", "Jr", "Sr"],
    "city": ["Alma", "Berne", "Clare", "Dexter", "Elgin"],
    "state": ["CA", "MI", "NY", "OH", "TX"],
    "sex": ["Female", "Male"],
    "race": ["Asian", "Black", "White"],
}


def _draw(seed: int, salt: str, at: Column) -> Column:
    """A number in [0, 1) that depends on seed, field and row alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), at), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(pool: list[str], draw: Column) -> Column:
    return F.element_at(F.lit(pool), (F.floor(draw * len(pool)) + 1).cast("int"))


def value(f: FieldSpec, pool: list[str] | None, draw: Column) -> Column:
    """One value of a field."""
    kind = (f.datatype or "xsd:string").removeprefix("xsd:")
    low = f.target.lower()
    if pool:
        return _pick(pool, draw)
    if kind == "date" or "date" in low and kind == "string":
        return F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.floor(draw * 25_000).cast("int")), "yyyy-MM-dd")
    if kind == "dateTime":
        return F.concat(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.floor(draw * 9_000).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00"))
    if kind in ("decimal", "float", "double"):
        return (draw * 180 - 90).cast("decimal(10,4)").cast("string")
    if kind in ("integer", "int", "long", "short", "nonNegativeInteger", "positiveInteger"):
        return (F.floor(draw * 1000) + 1).cast("string")
    if kind == "boolean":
        return F.when(draw < 0.5, "true").otherwise("false")
    if kind == "anyURI":
        return F.concat(F.lit("http://example.org/"), F.floor(draw * 1_000_000).cast("string"))
    if kind == "gYear":
        return (F.floor(draw * 80) + 1945).cast("string")
    if kind == "time":
        return F.concat(F.lpad(F.floor(draw * 24).cast("string"), 2, "0"), F.lit(":00:00"))
    for part, names in NAMES.items():
        if part in low:
            return _pick(names, draw)
    if kind == "token" or "identifier" in low or low.endswith("id"):
        return (F.floor(draw * 900_000_000) + 100_000_000).cast("string")
    return F.concat(F.lit(f"{f.target}_"), (F.floor(draw * 100) + 1).cast("string"))


def generate(spark: SparkSession, spec: MappingSpec, rows: int, seed: int = 0, pools: dict[str, list[str]] | None = None, most: int = 3, skip: float = 0.15) -> DataFrame:
    """``rows`` rows of text columns for the top-level fields. ``pools``: values by source column.

    Multiple properties get 1 to ``most`` - 1 segments and sub-values, optional fields are null with probability ``skip``.
    """
    pools, out, at = pools or {}, {}, F.col("id")
    for p in spec.properties:
        count = (F.floor(_draw(seed, p.name, at) * max(1, most - 1)) + 1).cast("int")
        for f in p.fields:
            one = lambda i, f=f: value(f, pools.get(f.source), _draw(seed, f.source, F.xxhash64(at, i)))
            if f.multi_value_split:
                n = lambda i, f=f: (F.floor(_draw(seed, f.source + "#", F.xxhash64(at, i)) * 3) + 1).cast("int")
                piece = lambda i, f=f, one=one, n=n: F.array_join(F.array_distinct(F.transform(F.sequence(F.lit(1), n(i)), lambda j: one(i * 100 + j))), f.multi_value_split)
            else:
                piece = one
            whole = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: piece(i)), p.split_on) if p.cardinality == "multiple" else piece(F.lit(1))
            out[f.source] = F.when(_draw(seed, f.source + "?", at) >= skip, whole) if f.optional else whole
    if spec.id_source not in out:
        out[spec.id_source] = (F.lit(100_000_000) + at).cast("string")
    return spark.range(rows).select(*(c.alias(n) for n, c in out.items()))


class PoolCache:
    """Value pools as JSON files, so that costly generators run once."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _file(self, name: str) -> Path:
        tail = name.replace("#", "/").rstrip("/").rsplit("/", 1)[-1]
        return self.folder / ("".join(c if c.isalnum() else "_" for c in tail) + ".json")

    def get(self, name: str, make=None, count: int = 50, tries: int = 3) -> list[str] | None:
        """The kept pool, else what ``make(name, count)`` gives once at least half the values are there."""
        if self._file(name).exists():
            return json.loads(self._file(name).read_text(encoding="utf-8"))
        for _ in range(tries if make else 0):
            pool = list(dict.fromkeys(v.strip() for v in make(name, count) if isinstance(v, str) and v.strip()))
            if len(pool) >= count / 2:
                self.folder.mkdir(parents=True, exist_ok=True)
                part = self._file(name).with_suffix(".part")
                part.write_text(json.dumps(pool), encoding="utf-8")
                os.replace(part, self._file(name))
                return pool
        return None
