"""Suggesting a mapping: column profiles against the properties of a shape.

Three passes, each over what the earlier ones left: value sets against concept values, names and types by points, and
an optional callable for the rest. Columns and targets are metadata, so this runs on the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.operators.profile import profile
from nestwright.operators.shapes import Shapes, local_name

#: Abbreviations in column names and what they stand for, and datatypes that a value type fits.
SHORT = {
    "nm": ["name"],
    "fname": ["firstname"],
    "lname": ["lastname", "lastorsurname"],
    "mname": ["middlename"],
    "dob": ["birthdate", "dateofbirth"],
    "bdate": ["birthdate"],
    "birthdt": ["birthdate"],
    "ssn": ["personidentifier"],
    "gender": ["sex", "hassex"],
    "race": ["raceand", "hasraceand"],
    "eth": ["ethnicity", "raceand"],
    "id": ["identifier", "personidentifier"],
}
FITS = {
    "string": {"string", "token", "normalizedString"},
    "date": {"date", "dateTime"},
    "integer": {"integer", "int", "long", "nonNegativeInteger", "positiveInteger", "token", "string"},
    "float": {"float", "double", "decimal"},
    "boolean": {"boolean"},
}
CONCEPT_SHARE, LEAST_SCORE = 0.7, 0.4


@dataclass
class Target:
    name: str
    shape: str
    property: str
    datatype: str | None = None
    values: tuple[str, ...] = ()
    required: bool = False
    shape_type: str = ""
    multiple: bool = False


@dataclass
class Match:
    column: str
    target: Target
    confidence: float
    strategy: str
    reasons: list[str] = field(default_factory=list)
    transform: str | None = None


def plain(name: str) -> str:
    return re.sub(r"[\s_\-./]+", "", name).lower()


def targets(shapes: Shapes, names: dict[str, str] | None = None) -> list[Target]:
    """Leaf properties of a shape's tree, status and collection nodes left out."""
    names, out, seen = names or {}, [], set()

    def walk(shape, prop: str, multiple: bool) -> None:
        if shape.iri in seen:
            return
        seen.add(shape.iri)
        for p in shape.properties:
            name = names.get(p.path, p.name or local_name(p.path))
            if local_name(p.path) in ("hasRecordStatus", "hasDataCollection") or name in ("hasRecordStatus", "hasDataCollection"):
                continue
            if p.node in shapes.shapes:
                walk(shapes.shapes[p.node], name, p.max_count != 1)
            else:
                kind = names.get(shape.target_class or "", local_name(shape.target_class or shape.iri))
                out.append(Target(name, shape.local, prop, p.datatype, tuple(map(local_name, p.allowed)), bool(p.min_count), kind, multiple))

    walk(shapes.root(), "", False)
    return out


def suggested_transform(kind: str, delimiter: str | None, t: Target) -> str | None:
    xsd = local_name(t.datatype) if t.datatype else ""
    if kind == "date" and xsd in ("date", "dateTime"):
        return "date_format"
    if kind == "integer" and xsd in ("token", "string"):
        return "int_clean"
    low = t.name.lower()
    if "sex" in low:
        return "sex_prefix"
    if "race" in low or "ethnicity" in low:
        return "race_prefix"
    return "first_pipe_split" if delimiter == "|" else None


def by_values(column: dict, t: Target) -> Match | None:
    """Share of the column's values that are concept values: as they are, after a prefix, or as their beginnings."""
    mine, known = [v.strip().lower() for v in column["values"] or []], [v.lower() for v in t.values]
    if not mine or not known:
        return None
    tests = (
        ("concept_direct", 1.0, lambda v: v in known),
        ("concept_prefixed", 1.0, lambda v: "_" in v and v.rsplit("_", 1)[1] in known),
        ("concept_abbreviation", 0.9, lambda v: bool(v) and any(k.startswith(v) for k in known)),
    )
    for name, weight, test in tests:
        share = sum(map(test, mine)) / len(mine)
        if share >= CONCEPT_SHARE:
            change = {True: "sex_prefix"}.get("sex" in t.name.lower()) or ("race_prefix" if re.search("race|ethnicity", t.name.lower()) else None)
            return Match(column["column"], t, share * weight, name, [f"{share:.0%} of values"], change)
    return None


def by_name(column: dict, t: Target) -> Match:
    """Points: same name .50, part of it .30, a common word .20 or an abbreviation .25; fitting type .20; dates .15."""
    mine, its, score, why = plain(column["column"]), plain(t.name), 0.0, []
    words = [w for w in re.split(r"[^a-z0-9]+", column["column"].lower()) if len(w) >= 3]
    if mine == its:
        score, why = 0.5, ["same name"]
    elif len(mine) >= 3 and len(its) >= 3 and (mine in its or its in mine):
        score, why = 0.3, ["part of the name"]
    elif len(mine) >= 3 and len(its) >= 3 and any(w in its for w in words):
        score, why = 0.2, ["common word"]
    elif any(a in mine and any(x in its for x in full) for a, full in SHORT.items()):
        score, why = 0.25, ["abbreviation"]
    xsd = local_name(t.datatype) if t.datatype else ""
    if xsd in FITS.get(column["inferred_type"], ()):
        score, why = score + 0.2, [*why, "type fits"]
    if column["inferred_type"] == "date" and xsd in ("date", "dateTime") and column.get("date_pattern"):
        score, why = score + 0.15, [*why, "date form"]
    return Match(column["column"], t, min(score, 1.0), "heuristic", why, suggested_transform(column["inferred_type"], column["delimiter"], t))


def match(columns: list[dict], wanted: list[Target], least: float = LEAST_SCORE, ask: Callable[[list[dict], list[Target]], list[Match]] | None = None) -> list[Match]:
    """Best match of each column, each target once. ``ask`` proposes matches for what is left; unknown names are dropped."""
    out: list[Match] = []
    for scored in (by_values, by_name):
        for c in columns:
            if any(m.column == c["column"] for m in out):
                continue
            best = None
            for t in wanted:
                if any(m.target is t for m in out):
                    continue
                m = scored(c, t)
                if m and m.confidence >= (least if scored is by_name else 0) and (best is None or m.confidence > best.confidence):
                    best = m
            if best:
                out.append(best)
    if ask:
        rest = [c for c in columns if all(m.column != c["column"] for m in out)]
        free = [t for t in wanted if all(m.target is not t for m in out)]
        for m in ask(rest, free) if rest and free else []:
            if m.column in {c["column"] for c in rest} and any(m.target is t for t in free) and all(x.target is not m.target for x in out):
                m.confidence = 0.0 if math.isnan(m.confidence) else min(1.0, max(0.0, m.confidence))
                out.append(m)
    return out


def assemble(matches: list[Match], columns: list[str], context_url: str = "", base_uri: str = "", type_name: str = "") -> dict:
    """A mapping configuration of matches. The id comes from the surest identifier match, else from the first column."""
    props: dict = {}
    for m in matches:
        t = m.target
        p = props.setdefault(t.property or "has" + t.shape.removesuffix("Shape"), {"type": t.shape_type or t.shape.removesuffix("Shape"), "cardinality": "multiple" if t.multiple else "single", "fields": {}})
        f = {"source": m.column, "target": t.name, "optional": not t.required}
        if m.transform:
            f["transform"] = m.transform
        if t.datatype and local_name(t.datatype) != "string":
            f["datatype"] = "xsd:" + local_name(t.datatype)
        p["fields"][t.name] = f
    ids = sorted((m for m in matches if "identifier" in m.target.name.lower()), key=lambda m: -m.confidence)
    return {"context_url": context_url, "base_uri": base_uri or "ex:record/", "id_source": ids[0].column if ids else columns[0], "id_transform": "first_pipe_split", "type": type_name, "properties": props}


def annotated_yaml(config: dict, matches: list[Match], columns: list[str]) -> str:
    """The configuration with a line per column on how sure its match is."""
    import yaml

    mark = lambda m: "+" if m.confidence >= 0.9 else "?" if m.confidence >= 0.7 else "!"
    found = {m.column: m for m in matches}
    notes = [f"# {mark(found[c])} {c} -> {found[c].target.name} ({found[c].confidence:.0%}, {found[c].strategy})" if c in found else f"# x {c}: no match" for c in columns]
    return "\n".join(notes) + "\n" + yaml.safe_dump(config, sort_keys=False, allow_unicode=True)


def detect(columns: list[str], candidates: dict[str, list[Target]]) -> list[tuple[str, float]]:
    """Shapes by the share of their targets that a column is named like, best first."""
    mine = {plain(c) for c in columns}
    score = lambda ts: len(mine & {plain(t.name) for t in ts}) / len({plain(t.name) for t in ts}) if ts else 0.0
    return sorted(((n, score(ts)) for n, ts in candidates.items()), key=lambda x: -x[1])


def suggest(df: DataFrame, shapes: Shapes, names: dict[str, str] | None = None, context_url: str = "", base_uri: str = "", least: float = LEAST_SCORE, ask: Callable | None = None) -> tuple[dict, list[Match]]:
    """(configuration, matches) for a source and a shape."""
    columns = [r.asDict() for r in profile(df).collect()]
    found = match(columns, targets(shapes, names), least, ask)
    root = shapes.root()
    kind = (names or {}).get(root.target_class or "", local_name(root.target_class or root.iri))
    return assemble(found, df.columns, context_url, base_uri, kind), found


def preview(df: DataFrame, config: dict, count: int = 5) -> list[dict]:
    """Documents that a suggested configuration makes of the first ``count`` rows; empty where it cannot be used."""
    from nestwright.errors import NestwrightError
    from nestwright.pipeline import Pipeline
    from nestwright.plans.spec import parse

    try:
        return [json.loads(r[0]) for r in Pipeline(df.limit(count), parse(config)).json().collect()]
    except (NestwrightError, KeyError, TypeError, ValueError):
        return []


def _json_in(reply: str, opening: str) -> object:
    """The first JSON value in a model's reply that begins with ``opening``; fences and text around it are skipped."""
    decoder = json.JSONDecoder()
    for m in re.finditer(re.escape(opening), reply):
        try:
            return decoder.raw_decode(reply, m.start())[0]
        except ValueError:
            continue
    return None


def values_in(reply: str) -> list[str] | None:
    """Non-blank values out of a model's reply: ``{"values": [...]}`` or a bare list; None without either."""
    for found in (_json_in(reply, "{"), _json_in(reply, "[")):
        values = found.get("values") if isinstance(found, dict) else found
        if isinstance(values, list):
            return [str(v) for v in values if v is not None and str(v).strip()]
    return None


def mappings_in(reply: str) -> list[dict]:
    """The entries of ``{"mappings": [...]}`` in a model's reply; empty without it."""
    found = _json_in(reply, "{")
    entries = found.get("mappings") if isinstance(found, dict) else None
    return [m for m in entries if isinstance(m, dict)] if isinstance(entries, list) else []


def asking(complete: Callable[[str], str], transforms: tuple[str, ...] = ()) -> Callable[[list[dict], list[Target]], list[Match]]:
    """A matcher for what rules leave over: ``complete`` answers a prompt. Unknown columns, properties and transforms go."""

    def ask(columns: list[dict], wanted: list[Target]) -> list[Match]:
        named = {f"{t.property}.{t.name}" if t.property else t.name: t for t in wanted}
        facts = [{"column": c["column"], "type": c["inferred_type"], "values": list(c["values"] or [])[:5]} for c in columns]
        prompt = "Match columns to properties. Answer with JSON {\"mappings\": [{\"column\", \"property\", \"confidence\", \"transform\"}]}.\nColumns: " + json.dumps(facts) + "\nProperties: " + json.dumps([{"property": n, "datatype": t.datatype, "values": list(t.values)[:10]} for n, t in named.items()]) + "\nTransforms: " + json.dumps(list(transforms))
        known = {c["column"] for c in columns}
        out = []
        for m in mappings_in(complete(prompt)):
            t = named.get(str(m.get("property")))
            if t is None or m.get("column") not in known:
                continue
            try:
                sure = float(m.get("confidence", 0))
            except (TypeError, ValueError):
                sure = 0.0
            change = m.get("transform")
            out.append(Match(m["column"], t, sure, "asked", ["a model's reply"], change if change in transforms else None))
        return out

    return ask


def overlap(values: Column, known: list[str]) -> Column:
    """How a column's distinct ``values`` lie in a concept set, for large tables: the shares that ``by_values`` compares.

    ``values``: array of texts; a struct of the shares found direct, after the last ``_`` and as beginnings (weight 0.9).
    """
    low = F.lit([k.lower() for k in known])
    mine = F.transform(values, lambda v: F.lower(F.trim(v)))
    share = lambda test: F.size(F.filter(mine, test)) / F.size(mine)
    return F.struct(
        share(lambda v: F.array_contains(low, v)).alias("direct"),
        share(lambda v: v.contains("_") & F.array_contains(low, F.substring_index(v, "_", -1))).alias("prefixed"),
        (share(lambda v: (v != "") & F.exists(low, lambda k: k.startswith(v))) * 0.9).alias("abbreviation"),
    )


def best_matches(scores: DataFrame) -> DataFrame:
    """The first best target of each column from (column, target, position, score): highest score, then position."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("score"), "position"))
    return scores.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
