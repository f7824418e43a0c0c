"""A specification and a source schema become columns: the document, its first error, warnings.

Nothing here runs per row in Python. Every property is an array of instances; a delimited column is split once and
zipped by position, satellite rows arrive as arrays of structs. Errors are values: each field contributes a message or
null, and a row's error is the first one in configuration order. Whether that stops the run or goes to dead letters is
decided by the caller, on the same plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.errors import ConfigError
from nestwright.functions import scalars as S
from nestwright.plans.spec import FieldSpec, MappingSpec, PropertySpec

RELATED = "__related__"


def _first(*columns: Column | None) -> Column:
    given = [c for c in columns if c is not None]
    return F.coalesce(*given) if given else F.lit(None).cast("string")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Instances:
    """Array of instance structs, its element's field kinds, and the error and warning columns."""

    items: Column
    error: Column | None
    warning: Column | None
    names: list[tuple[str, str, object]] = field(default_factory=list)  # target, kind (text, list, node), detail


class Compiler:
    def __init__(self, spec: MappingSpec, schema: T.StructType, transforms: dict | None = None, normalise: bool = True):
        self.spec, self.schema, self.normalise = spec, schema, normalise
        self.kinds = {f.name: f.dataType for f in schema.fields}
        self.staged: list[tuple[str, Column]] = []
        self.transforms = dict(S.TRANSFORMS)
        for name, t in (transforms or {}).items():
            self.transforms[name] = t if isinstance(t, S.Transform) else S.python_transform(t)

    def source(self, name: str) -> tuple[Column, T.DataType]:
        """A source column; a name that the source lacks is null in every row."""
        return (_column(name), self.kinds[name]) if name in self.kinds else (F.lit(None).cast("string"), T.StringType())

    def stage(self, c: Column) -> Column:
        """A value that several outputs use: a column of its own, so that it is computed once a row."""
        self.staged.append((f"_nw{len(self.staged)}", c))
        return F.col(self.staged[-1][0])

    def transform(self, name: str) -> S.Transform:
        if name not in self.transforms:
            raise ConfigError(f"unknown transform {name!r}; known: {', '.join(sorted(self.transforms))}")
        return self.transforms[name]

    def _transformed(self, text: Column, f: FieldSpec, prop: str, keep: Callable[[Column], Column] = lambda c: c) -> tuple[Column, Column | None]:
        if not f.transform:
            return text, None
        t = self.transform(f.transform)
        value = keep(t.apply(text))
        where = f"field '{f.source}' in property '{prop}'"
        error = None
        if t.fails is not None:
            why = t.fails(text, value)
            error = F.when(why.isNotNull(), F.concat(F.lit(f"Transform '{f.transform}' failed on {where}: "), why))
        if not f.optional:
            none = F.when(text.isNotNull() & value.isNull(), F.lit(f"Transform '{f.transform}' made nothing of the required {where}"))
            error = _first(error, none)
        return value, error

    # ---- instances --------------------------------------------------------------------------------------------
    def instances(self, p: PropertySpec) -> Instances:
        if p.source_table:
            return self._satellite(p)
        return self._multiple(p) if p.cardinality == "multiple" else self._single(p)

    def _nested(self, p: PropertySpec) -> list[tuple[PropertySpec, Instances]]:
        return [(q, self.instances(q)) for q in p.properties]

    @staticmethod
    def _node(parts: list[tuple[str, Column]]) -> Column:
        return F.struct(*(c.alias(n) for n, c in parts))

    @staticmethod
    def _some(parts: list[tuple[str, Column]]) -> Column:
        out = F.lit(False)
        for _, c in parts:
            out = out | c.isNotNull()
        return out

    def _merged(self, parts: list[tuple[str, Column, str, object]]) -> list[tuple[str, Column, str, object]]:
        """Later fields with the same target win where they have a value."""
        out: dict[str, tuple] = {}
        for name, c, kind, detail in parts:
            out[name] = (name, F.coalesce(c, out[name][1]) if name in out and out[name][2] == kind else c, kind, detail)
        return list(out.values())

    def _single(self, p: PropertySpec) -> Instances:
        parts, errors = [], []
        for f in p.fields:
            c, kind = self.source(f.source)
            missing = S.is_missing(c, kind)
            if not f.optional:
                errors.append(F.when(missing, F.lit(f"Required field '{f.source}' is missing or empty for property '{p.name}'")))
            scalar = S.scalar_error(c, kind, f.source, p.name)
            if scalar is not None:
                errors.append(F.when(~missing, scalar))
            nested_kind = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
            text = F.lit(None).cast("string") if nested_kind else F.when(~missing, S.strip_control(c.cast("string")))
            value, error = self._transformed(text, f, p.name, self.stage)
            errors.append(error)
            parts.append((f.target, value, "text", f))
        warnings = []
        for q, inner in self._nested(p):
            parts.append((q.name, F.when(F.size(inner.items) > 0, inner.items), "node", (q, inner)))
            errors.append(inner.error)
            warnings.append(inner.warning)
        parts = self._merged(parts)
        pairs = [(n, c) for n, c, _, _ in parts]
        # null when no field has a value: what stands for "no instance"
        node = F.array(self._node(pairs))
        items = self.stage(F.when(self._some(pairs), node).otherwise(F.slice(node, 1, 0)))
        return Instances(items, _first(*errors), _first(*warnings), [(n, k, d) for n, _, k, d in parts])

    def _multiple(self, p: PropertySpec) -> Instances:
        delimiter = "\\Q" + p.split_on + "\\E"
        splits: dict[str, tuple[Column, Column]] = {}
        scalars = []
        for f in p.fields:
            c, kind = self.source(f.source)
            missing = S.is_missing(c, kind)
            scalar = S.scalar_error(c, kind, f.source, p.name)
            if scalar is not None:
                scalars.append(F.when(~missing, scalar))
            nested_kind = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
            splits[f.source] = (missing, F.lit(None).cast("array<string>") if nested_kind else F.when(~missing, F.split(c.cast("string"), delimiter)))
        nested = self._nested(p)
        order = list(splits)
        bound = F.struct(*(splits[n][1].alias(f"s{k}") for k, n in enumerate(order)))
        lead = f"s{order.index(p.fields[0].source)}"
        first = splits[p.fields[0].source][1]

        def build(s: Column, i: Column) -> tuple[list, list]:
            parts, errors = [], []
            for f in p.fields:
                segment = S.strip(F.get(s.getField(f"s{order.index(f.source)}"), i))
                text = F.when(segment != "", S.strip_control(segment))
                if f.multi_value_split:
                    inner = F.filter(F.transform(F.split(text, "\\Q" + f.multi_value_split + "\\E"), S.strip), lambda x: x != "")
                    value = F.filter(F.transform(inner, lambda x: self._transformed(x, f, p.name)[0]), lambda x: x.isNotNull())
                    if f.transform and self._transformed(F.lit(""), f, p.name)[1] is not None:
                        errors.append(F.get(F.filter(F.transform(inner, lambda x: self._transformed(x, f, p.name)[1]), lambda x: x.isNotNull()), F.lit(0)))
                    parts.append((f.target, F.when(F.size(value) > 0, value), "list", f))
                else:
                    value, error = self._transformed(text, f, p.name)
                    parts.append((f.target, value, "text", f))
                    errors.append(error)
            for q, inner in nested:
                parts.append((q.name, F.when(F.size(inner.items) > 0, inner.items), "node", (q, inner)))
            return self._merged(parts), errors

        probe = build(bound, F.lit(0))
        layout = [(n, k, d) for n, _, k, d in probe[0]]

        def live(s: Column) -> Column:
            """Positions of the first column's segments that are not blank."""
            segments = s.getField(lead)
            numbered = F.transform(segments, lambda x, i: F.when(~S.is_blank(x), i))
            return F.coalesce(F.filter(numbered, lambda i: i.isNotNull()), F.array().cast("array<int>"))

        def node(s: Column, i: Column) -> Column:
            pairs = [(n, c) for n, c, _, _ in build(s, i)[0]]
            return F.when(self._some(pairs), self._node(pairs))

        # the splits are made once per row and bound to a name: inside a lambda they would be made for every segment
        items = self.stage(S.let(bound, lambda s: F.filter(F.transform(live(s), lambda i: node(s, i)), lambda x: x.isNotNull())))
        failing = any(e is not None for e in probe[1])
        error = S.let(bound, lambda s: F.get(F.filter(F.transform(live(s), lambda i: _first(*build(s, i)[1])), lambda x: x.isNotNull()), F.lit(0))) if failing else None
        counts = [F.when(~splits[f.source][0] & ~splits[p.fields[0].source][0] & (F.size(splits[f.source][1]) < F.size(first)), F.lit(f"'{f.source}' has fewer segments than '{p.fields[0].source}' in property '{p.name}'")) for f in p.fields[1:]]
        errors = [*scalars, error, *(F.when(F.size(items) > 0, inner.error) for _, inner in nested if inner.error is not None)]
        return Instances(items, _first(*errors), _first(*counts), layout)

    def _satellite(self, p: PropertySpec) -> Instances:
        related = self.kinds.get(RELATED)
        kinds = {}
        rows = F.array().cast("array<struct<_none:string>>")
        if isinstance(related, T.StructType) and p.source_table in related.fieldNames():
            rows = F.coalesce(F.col(RELATED).getField(p.source_table), F.array().cast(related[p.source_table].dataType))
            kinds = {f.name: f.dataType for f in related[p.source_table].dataType.elementType.fields}

        def build(r: Column) -> tuple[list, list]:
            parts, skips = [], []
            for f in p.fields:
                c, kind = (r.getField(f.source), kinds[f.source]) if f.source in kinds else (F.lit(None).cast("string"), T.StringType())
                missing = S.is_missing(c, kind)
                if not f.optional:
                    skips.append(missing)
                text = F.when(~missing, S.strip_control(c.cast("string"))) if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.lit(None).cast("string")
                value, _ = self._transformed(text, f, p.name)
                if not f.optional and f.transform:
                    skips.append(~missing & value.isNull())
                if f.multi_value_split:
                    inner = F.filter(F.transform(F.split(value, "\\Q" + f.multi_value_split + "\\E"), S.strip), lambda x: x != "")
                    parts.append((f.target, F.when(F.size(inner) > 0, inner), "list", f))
                else:
                    parts.append((f.target, value, "text", f))
            return self._merged(parts), skips

        def node(r: Column) -> Column:
            parts, skips = build(r)
            pairs = [(n, c) for n, c, _, _ in parts]
            skip = F.lit(False)
            for s in skips:
                skip = skip | s
            return F.when(~skip & self._some(pairs), self._node(pairs))

        items = self.stage(F.filter(F.transform(rows, node), lambda x: x.isNotNull()))
        layout = [(f.target, "list" if f.multi_value_split else "text", f) for f in p.fields]
        layout = list({n: (n, k, d) for n, k, d in layout}.values())
        lost = F.size(rows) - F.size(items)
        warning = F.when(lost > 0, F.concat(lost.cast("string"), F.lit(f" row(s) of '{p.source_table}' without required values skipped in property '{p.name}'")))
        return Instances(items, None, warning, layout)

    # ---- documents --------------------------------------------------------------------------------------------
    @staticmethod
    def _typed(value: Column, datatype: str) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(datatype).alias("@type"), value.alias("@value")))

    @staticmethod
    def _bound(build: Callable, p: PropertySpec, names: list) -> Callable[[Column], Column]:
        return lambda x: build(p, names, x)

    def _typing(self, datatype: str) -> Callable[[Column], Column]:
        return lambda x: self._typed(x, datatype)

    @staticmethod
    def _quoting(datatype: str) -> Callable[[Column], Column]:
        return lambda x: F.concat(F.lit('{"@type":' + json.dumps(datatype) + ',"@value":'), S.json_quote(x), F.lit("}"))

    @staticmethod
    def _bare(datatype: str | None) -> bool:
        return not datatype or datatype in ("xsd:string", "named_individual")

    def _constants(self, p: PropertySpec) -> list[tuple[str, dict]]:
        out = []
        if p.record_status and self.spec.record_status:
            out.append(("hasRecordStatus", record_status_node(self.spec.record_status)))
        if p.data_collection and self.spec.data_collection:
            out.append(("hasDataCollection", data_collection_node(self.spec.data_collection)))
        return out

    def wide(self, p: PropertySpec, inst: Instances) -> Column:
        """Instances as an array of final nodes (or of texts, for concepts)."""
        return F.transform(inst.items, lambda e: self._wide_node(p, inst.names, e))

    def _wide_node(self, p: PropertySpec, names, e: Column) -> Column:
        if p.is_concept:
            return _first(*(self._as_text(e, n, k) for n, k, _ in names if k != "node"))
        if p.is_reference:
            return F.struct(_first(*(self._as_text(e, n, k) for n, k, _ in self._reference_order(names))).alias("@id"))
        parts = []
        for n, k, d in names:
            c = e.getField(n)
            if k == "node":
                q, inner = d
                parts.append((n, F.transform(c, self._bound(self._wide_node, q, inner.names))))
            elif self._bare(d.datatype):
                parts.append((n, c))
            elif k == "list":
                parts.append((n, F.transform(c, self._typing(d.datatype))))
            else:
                parts.append((n, self._typed(c, d.datatype)))
        if p.wrapper_field and p.inner_type:
            inner = self._node([("@type", F.lit(p.inner_type)), *parts])
            return F.struct(F.lit(p.type).alias("@type"), inner.alias(p.wrapper_field))
        parts += [(n, _literal_struct(v)) for n, v in self._constants(p)]
        return self._node([("@type", F.lit(p.type)), *parts])

    @staticmethod
    def _as_text(e: Column, name: str, kind: str) -> Column:
        c = e.getField(name)
        return F.array_join(c, ",") if kind == "list" else c

    @staticmethod
    def _reference_order(names):
        plain = [x for x in names if x[1] != "node"]
        return [x for x in plain if x[0] == "@id"] + [x for x in plain if x[0] != "@id"]

    def text(self, p: PropertySpec, inst: Instances) -> Column:
        """JSON of the property's value: nothing for no node, the node alone for one, a list for more."""
        return collapse(F.filter(F.transform(inst.items, lambda e: self._text_node(p, inst.names, e)), lambda x: x.isNotNull()))

    def _text_node(self, p: PropertySpec, names, e: Column) -> Column:
        if p.is_concept:
            return S.json_quote(_first(*(self._as_text(e, n, k) for n, k, _ in names if k != "node")))
        if p.is_reference:
            ref = _first(*(self._as_text(e, n, k) for n, k, _ in self._reference_order(names)))
            return F.concat(F.lit('{"@id":'), S.json_quote(ref), F.lit("}"))
        pairs = []
        for n, k, d in names:
            c, key = e.getField(n), F.lit(json.dumps(n, ensure_ascii=False) + ":")
            if k == "node":
                q, inner = d
                nodes = F.filter(F.transform(c, self._bound(self._text_node, q, inner.names)), lambda x: x.isNotNull())
                value = collapse(nodes)
            else:
                quote = S.json_quote if self._bare(d.datatype) else self._quoting(d.datatype)
                if k == "text":
                    value = quote(c)
                elif not d.datatype:
                    value = collapse(F.transform(c, quote))
                else:  # a typed list stays a list
                    value = F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(F.transform(c, quote), ","), F.lit("]")))
            pairs.append(F.concat(key, value))
        if p.wrapper_field and p.inner_type:
            inner = F.concat_ws(",", *pairs)
            return F.when(inner != "", F.concat(F.lit('{"@type":' + json.dumps(p.type) + "," + json.dumps(p.wrapper_field) + ':{"@type":' + json.dumps(p.inner_type) + ","), inner, F.lit("}}")))
        tail = [F.lit(json.dumps(n) + ":" + json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for n, v in self._constants(p)]
        return F.concat(F.lit("{"), F.concat_ws(",", F.lit('"@type":' + json.dumps(p.type)), *pairs, *tail), F.lit("}"))

    # ---- whole rows ---------------------------------------------------------------------------------------------
    def identifier(self) -> tuple[Column, Column]:
        """(@id, error)."""
        spec = self.spec
        c, kind = self.source(spec.id_source)
        errors = [F.when(S.is_missing(c, kind), F.lit(f"ID source field '{spec.id_source}' is missing or empty"))]
        errors.append(S.scalar_error(c, kind, spec.id_source, "@id"))
        if isinstance(kind, T.NumericType):
            errors.append(F.when(c == 0, F.lit(f"ID source field '{spec.id_source}' is zero, which is no identifier")))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.lit(None).cast("string"), _first(*errors)
        value = S.strip_control(c.cast("string"))
        if spec.id_transform:
            t = self.transform(spec.id_transform)
            if t.fails is not None:
                errors.append(t.fails(value, t.apply(value)))
            value = t.apply(value)
        if spec.id_is_uri:
            out = S.strip(value)
            out = F.when(out != "", out)
        else:
            base = [F.lit(x) if i % 2 == 0 else S.iri_component(self.source(x)[0].cast("string"), self.normalise) for i, x in enumerate(re.split(r"\{([^{}]+)\}", spec.base_uri)) if x]
            out = F.concat(*base) if spec.base_uri.endswith("}") else F.concat(*base, S.iri_component(value, self.normalise))
        out = self.stage(out)
        errors.append(F.when(out.isNull(), F.lit("the document has no identifier")))
        return out, _first(*errors)

    def compile(self) -> Compiled:
        spec = self.spec
        ident, error = self.identifier()
        props = [(p, self.instances(p)) for p in spec.properties]
        errors = [error, *(i.error for _, i in props)]
        kind = F.array(*map(F.lit, spec.type)) if isinstance(spec.type, list) else F.lit(spec.type)
        context = F.lit(spec.context_url if isinstance(spec.context_url, str) else json.dumps(spec.context_url))
        doc = F.struct(context.alias("@context"), ident.alias("@id"), kind.alias("@type"), *(self.wide(p, i).alias(p.name) for p, i in props))
        pairs = [F.concat(F.lit(json.dumps(p.name, ensure_ascii=False) + ":"), self.text(p, i)) for p, i in props]
        head = [F.lit('"@context":' + json.dumps(spec.context_url, ensure_ascii=False)), F.concat(F.lit('"@id":'), S.json_quote(ident)), F.lit('"@type":' + json.dumps(spec.type, ensure_ascii=False))]
        text = F.concat(F.lit("{"), F.concat_ws(",", *head, *pairs), F.lit("}"))
        warnings = [i.warning for _, i in props if i.warning is not None]
        warning = F.filter(F.array(*warnings), lambda x: x.isNotNull()) if warnings else F.array().cast("array<string>")
        return Compiled(spec, ident, doc, text, _first(*errors), warning, self.staged)


@dataclass
class Compiled:
    """Columns of a compiled mapping."""

    spec: MappingSpec
    id: Column
    document: Column
    json: Column
    error: Column
    warnings: Column
    staged: list[tuple[str, Column]]

    def prepare(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that the outputs are made of; select outputs from it."""
        for name, c in self.staged:
            df = df.withColumn(name, c)
        return df

    def select(self, df: DataFrame, *outputs: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """Chosen outputs (id, document, json, error, warnings) beside source columns; Spark reads only what they use."""
        return self.prepare(df).select(*(_column(c) for c in keep), *(getattr(self, o).alias(o) for o in outputs))


def collapse(items: Column) -> Column:
    """JSON texts: none is null, one stands alone, more make a list."""
    n = F.size(items)
    return F.when(n == 1, F.get(items, F.lit(0))).when(n > 1, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def record_status_node(defaults: dict) -> dict:
    node = {"@type": defaults.get("type", "RecordStatus")}
    for key, value in defaults.items():
        if key == "type":
            continue
        if isinstance(value, dict) and "value_id" in value:
            node[key] = {"@id": value["value_id"]}
        elif isinstance(value, dict) and "value" in value:
            plain = value.get("datatype") in (None, "xsd:string", "named_individual")
            node[key] = value["value"] if plain else {"@type": value["datatype"], "@value": value["value"]}
        else:
            node[key] = value
    return node


def data_collection_node(defaults: dict) -> dict:
    node = {"@id": defaults["value_id"]} if "value_id" in defaults else {}
    return {**node, "@type": defaults.get("type", "DataCollection")}


def _literal_struct(node: dict) -> Column:
    return F.struct(*((_literal_struct(v) if isinstance(v, dict) else F.lit(v)).alias(k) for k, v in node.items()))


def compile_mapping(spec: MappingSpec, schema: T.StructType, transforms: dict[str, S.Transform | Callable] | None = None, normalise: bool = True) -> Compiled:
    """Columns for ``spec`` over a source of ``schema``. ``normalise``: Unicode NFC on identifiers."""
    return Compiler(spec, schema, transforms, normalise).compile()
