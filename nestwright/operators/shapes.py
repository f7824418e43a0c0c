"""SHACL shapes: reading the Turtle they are written in, introspection, mapping templates, checks of documents.

The reader covers the Turtle that shapes use: prefixes, ``a``, ``;``, ``,``, lists, blank nodes, literals. Constraints
(closed, minCount, maxCount, datatype, in, node, class, nodeKind) are checked on documents as arrays of nodes.
"""

from __future__ import annotations

import json
import re
import shutil
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestwright.errors import ShapeError
from nestwright.plans.spec import MappingSpec, PropertySpec, parse

SH, RDF, XSD = "http://www.w3.org/ns/shacl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(r'''\s+|\#[^\n]*|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*")(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?|(?P<iri><[^>\s]*>)|(?P<mark>[;,.\[\]()](?!\d)|\^\^)|(?P<at>@prefix|@base)|(?P<name>[\w.%-]*:[\w.%/-]*(?<!\.)|[\w+-]+(?:\.\d+)?)''', re.S)


def read_turtle(text: str) -> list[tuple]:
    """(subject, predicate, object) triples. Lists are tuples, blank nodes ``_:bN``, literals plain texts."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ShapeError(f"cannot read Turtle at: {text[at : at + 40]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    prefixes: dict[str, str] = {}
    triples: list[tuple] = []
    blanks = iter(range(10**9))
    pos = 0

    def take(mark: str | None = None):
        nonlocal pos
        if pos >= len(tokens):
            raise ShapeError("Turtle ends too early")
        kind, value = tokens[pos]
        if mark and value != mark:
            raise ShapeError(f"expected {mark!r}, found {value!r}")
        pos += 1
        return kind, value

    def term():
        kind, value = take()
        if kind == "iri":
            return value[1:-1]
        if kind == "text":
            body = value[3:-3] if value.startswith('"""') else value[1:-1]
            return re.sub(r'\\(["\\ntr])', lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
        if value == "[":
            node = f"_:b{next(blanks)}"
            if tokens[pos][1] != "]":
                predicates(node, "]")
            take("]")
            return node
        if value == "(":
            items = []
            while tokens[pos][1] != ")":
                items.append(term())
            take(")")
            return tuple(items)
        if kind == "name":
            if value == "a":
                return RDF + "type"
            if ":" in value:
                prefix, _, rest = value.partition(":")
                if prefix not in prefixes:
                    raise ShapeError(f"unknown prefix {prefix!r}")
                return prefixes[prefix] + rest
            return value
        raise ShapeError(f"unexpected {value!r}")

    def predicates(subject, end: str) -> None:
        while True:
            verb = term()
            while True:
                triples.append((subject, verb, term()))
                if tokens[pos][1] != ",":
                    break
                take(",")
            if tokens[pos][1] != ";":
                return
            while tokens[pos][1] == ";":
                take(";")
            if tokens[pos][1] in (end, "."):
                return

    while pos < len(tokens):
        if tokens[pos][0] == "at":
            take()
            prefix = take()[1][:-1]
            prefixes[prefix] = take()[1][1:-1]
            take(".")
            continue
        subject = term()
        if tokens[pos][1] != ".":
            predicates(subject, ".")
        take(".")
    return triples


def local_name(iri: str) -> str:
    return iri.rsplit("#", 1)[-1] if "#" in iri else iri.rstrip("/").rsplit("/", 1)[-1]


@dataclass
class PropertyShape:
    path: str
    name: str = ""
    datatype: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    allowed: tuple[str, ...] = ()
    node: str | None = None
    node_class: str | None = None
    node_kind: str | None = None


@dataclass
class NodeShape:
    iri: str
    target_class: str | None = None
    closed: bool = False
    ignored: tuple[str, ...] = ()
    properties: list[PropertyShape] = field(default_factory=list)

    @property
    def local(self) -> str:
        return local_name(self.iri)


class Shapes:
    """Node shapes of a Turtle text."""

    def __init__(self, text: str):
        facts: dict[str, dict[str, list]] = {}
        for s, p, o in read_turtle(text):
            facts.setdefault(s, {}).setdefault(p, []).append(o)
        one = lambda f, name: (f.get(SH + name) or [None])[0]
        number = lambda v: None if v is None else int(v)
        self.shapes: dict[str, NodeShape] = {}
        for iri, f in facts.items():
            if SH + "NodeShape" not in f.get(RDF + "type", []):
                continue
            shape = NodeShape(iri, one(f, "targetClass"), one(f, "closed") == "true", tuple(one(f, "ignoredProperties") or ()))
            for ref in f.get(SH + "property", []):
                g = facts.get(ref, {})
                if path := one(g, "path"):
                    shape.properties.append(PropertyShape(path, one(g, "name") or "", one(g, "datatype"), number(one(g, "minCount")), number(one(g, "maxCount")), tuple(one(g, "in") or ()), one(g, "node"), one(g, "class"), one(g, "nodeKind")))
            shape.properties.sort(key=lambda p: p.path)
            self.shapes[iri] = shape
        if not self.shapes:
            raise ShapeError("the text has no node shape")
        by_class = {s.target_class: s.iri for s in self.shapes.values() if s.target_class}
        for shape in self.shapes.values():  # children by node, by class, or by name
            for p in shape.properties:
                p.node = p.node if p.node in self.shapes else by_class.get(p.node_class)

    def get(self, name: str) -> NodeShape:
        for s in self.shapes.values():
            if name in (s.iri, s.local):
                return s
        raise ShapeError(f"no shape {name!r}")

    def root(self) -> NodeShape:
        """The shape that no other refers to with the most children, then the most properties."""
        used = {p.node for s in self.shapes.values() for p in s.properties if p.node and p.node != s.iri}
        free = [s for s in self.shapes.values() if s.iri not in used] or list(self.shapes.values())
        return max(free, key=lambda s: (sum(bool(p.node) for p in s.properties), len(s.properties)))

    def tree(self, shape: NodeShape | None = None, above: tuple[str, ...] = ()) -> dict:
        shape = shape or self.root()
        children = {local_name(p.path): self.tree(self.shapes[p.node], (*above, shape.iri)) for p in shape.properties if p.node and p.node not in (*above, shape.iri)}
        return {"shape": shape.local, "target_class": shape.target_class, "closed": shape.closed, "properties": [vars(p) for p in shape.properties], "children": children}

    def allowed_values(self, names: dict[str, str] | None = None, local: bool = True) -> dict[str, list[str]]:
        """Allowed values by ``property.field`` of the root's children, as local names or whole IRIs."""
        names = names or {}
        out = {}
        for p in self.root().properties:
            for q in self.shapes[p.node].properties if p.node else []:
                if q.allowed:
                    out[f"{names.get(p.path, local_name(p.path))}.{names.get(q.path, local_name(q.path))}"] = [local_name(v) if local else v for v in q.allowed]
        return out

    def template(self, context_url: str = "", base_uri: str = "", names: dict[str, str] | None = None) -> dict:
        """A mapping configuration with every target filled in and sources to do."""
        names, root = names or {}, self.root()
        call = lambda p: names.get(p.path, p.name or local_name(p.path))

        def entry(p: PropertyShape) -> dict:
            child = self.shapes[p.node]
            out: dict = {"type": names.get(child.target_class or "", local_name(child.target_class or child.iri)), "cardinality": "single" if p.max_count == 1 else "multiple"}
            if p.max_count != 1:
                out["split_on"] = "|"
            linked = {local_name(q.path) for q in child.properties}
            out.update({k: True for k, name in (("include_record_status", "hasRecordStatus"), ("include_data_collection", "hasDataCollection")) if name in linked})
            out["fields"] = {}
            for q in child.properties:
                if local_name(q.path) in ("hasRecordStatus", "hasDataCollection"):
                    continue
                if q.node and q.node != p.node:
                    out.setdefault("properties", {})[call(q)] = entry(q)
                    continue
                f: dict = {"source": f"TODO_{call(q)}", "target": call(q)}
                if q.datatype and q.datatype != XSD + "string":
                    f["datatype"] = "xsd:" + local_name(q.datatype)
                if not q.min_count:
                    f["optional"] = True
                out["fields"][call(q)] = f
            return out

        out = {"shape": root.local, "context_url": context_url, "base_uri": base_uri, "id_source": "TODO_ID_COLUMN", "id_transform": "first_pipe_split", "type": names.get(root.target_class or "", local_name(root.target_class or root.iri)), "properties": {call(p): entry(p) for p in root.properties if p.node}}
        if any(s.local == "RecordStatusShape" for s in self.shapes.values()):
            out["record_status_defaults"] = {"type": "RecordStatus", "RecordStartDateTime": {"value": "1900-01-01T00:00:00", "datatype": "xsd:dateTime"}, "RecordEndDateTime": {"value": "9999-12-31T00:00:00", "datatype": "xsd:dateTime"}}
            out["data_collection_defaults"] = {"type": "DataCollection", "value_id": "http://example.org/dataCollection/TODO"}
        return out

    def reconcile(self, spec: MappingSpec, names: dict[str, str] | None = None) -> list[dict]:
        """Differences between a mapping and the shapes: severity, property, message."""
        names, root, out = names or {}, self.root(), []
        call = lambda p: names.get(p.path, p.name or local_name(p.path))
        tell = lambda severity, prop, message: out.append({"severity": severity, "property": prop, "message": message})
        mapped = {p.name: p for p in spec.properties}
        shaped = {call(p): p for p in root.properties}
        for name, p in shaped.items():
            if name not in mapped:
                if local_name(p.path) not in ("hasRecordStatus", "hasDataCollection"):
                    tell("error" if p.min_count else "warning", name, "not mapped")
                continue
            child = self.shapes.get(p.node or "")
            if child is None:
                continue
            want = names.get(child.target_class or "", local_name(child.target_class or child.iri))
            if mapped[name].type not in (want, "named_individual", "id_ref", "iri_ref"):
                tell("error", name, f"type is {mapped[name].type!r}, the shape says {want!r}")
            fields = {f.target: f for f in mapped[name].fields}
            for q in child.properties:
                f = fields.get(call(q))
                if f is None:
                    if q.min_count and not q.node:
                        tell("error", f"{name}.{call(q)}", "required field is not mapped")
                elif q.datatype and f.datatype and local_name(q.datatype) != f.datatype.removeprefix("xsd:"):
                    tell("warning", f"{name}.{f.target}", f"datatype is {f.datatype}, the shape says xsd:{local_name(q.datatype)}")
        for name in mapped.keys() - shaped.keys():
            tell("warning", name, "the shape has no such property")
        return out


#: Lexical forms of the datatypes that documents carry.
LEXICAL = {
    "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "integer": r"^[+-]?[0-9]+$",
    "int": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "boolean": r"^(true|false|0|1)$",
}
_VIOLATIONS = "cast(array() as array<struct<property_path:string,severity:string,message:string,expected:string,actual:string>>)"
_STATUS = ("hasRecordStatus", "hasDataCollection")


class _Judge:
    """Constraints of node shapes as columns over the nodes of a document, followed down to any depth."""

    def __init__(self, shapes: Shapes, names: dict[str, str], unknown_class: str):
        self.shapes, self.names, self.unknown_class = shapes, names, unknown_class

    def call(self, p: PropertyShape) -> str:
        return self.names.get(p.path, p.name or local_name(p.path))

    def class_name(self, iri: str) -> str:
        return self.names.get(iri, local_name(iri))

    @staticmethod
    def issue(cond: Column | bool, path: str, message: str, expected: str, actual: Column | None = None, severity: str = "error") -> Column:
        actual = F.lit("") if actual is None else F.coalesce(actual, F.lit(""))
        found = F.struct(F.lit(path).alias("property_path"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(expected).alias("expected"), actual.alias("actual"))
        return F.when(F.lit(cond) if isinstance(cond, bool) else cond, found)

    def counts(self, q: PropertyShape, n: Column, path: str) -> list[Column]:
        out = [self.issue(n < q.min_count, path, "too few values", f"at least {q.min_count}", n.cast("string"))] if q.min_count else []
        return out + ([self.issue(n > q.max_count, path, "too many values", f"at most {q.max_count}", n.cast("string"))] if q.max_count is not None else [])

    def kind(self, q: PropertyShape, is_a: str, there: Column, path: str) -> list[Column]:
        """``is_a``: IRI, BlankNode or Literal; node kinds name one or two of them."""
        want = local_name(q.node_kind) if q.node_kind else ""
        return [self.issue(there, path, "node kind differs", want, F.lit(is_a))] if want and is_a not in want.split("Or") else []

    def type_of(self, q: PropertyShape, kind: str, there: Column, path: str) -> list[Column]:
        child = self.shapes.shapes.get(q.node or "")
        want = q.node_class or (child.target_class if child else None)
        return [self.issue(there, path, "class differs", self.class_name(want), F.lit(kind))] if want and kind != self.class_name(want) else []

    @staticmethod
    def found(flat: list[Column], lists: list[Column]) -> Column:
        none = F.expr(_VIOLATIONS)
        here = F.filter(F.array(*flat), lambda x: x.isNotNull()) if flat else none
        return F.concat(here, *(F.coalesce(x, none) for x in lists))

    def literal(self, q: PropertyShape, f, c: Column, path: str) -> tuple[list[Column], list[Column]]:
        """Issues of one field: counts, datatype and its lexical form, allowed values, node kind."""
        bare = f.datatype in (None, "xsd:string", "named_individual")
        many = bool(f.multi_value_split)
        values = c if many else F.when(c.isNotNull(), F.array(c))
        n = F.when(c.isNull(), 0).otherwise(F.size(values))
        text = (lambda v: v) if bare else (lambda v: v["@value"])
        flat = self.counts(q, n, path) + self.kind(q, "IRI" if f.datatype == "named_individual" else "Literal", n > 0, path)
        lists = []
        if q.datatype:
            want, have = "xsd:" + local_name(q.datatype), f.datatype or "xsd:string"
            if have != want:
                flat.append(self.issue(n > 0, path, "datatype differs", want, F.lit(have)))
            elif form := LEXICAL.get(local_name(q.datatype)):
                lists.append(F.transform(F.filter(values, lambda v: ~text(v).rlike(form)), lambda v: self.row(path, "not a literal of its datatype", want, text(v))))
        if q.allowed:
            ok, expected = F.lit([local_name(v) for v in q.allowed]), ", ".join(map(local_name, q.allowed))
            lists.append(F.transform(F.filter(values, lambda v: ~F.array_contains(ok, text(v))), lambda v: self.row(path, "value is not allowed", expected, text(v))))
        return flat, lists

    @staticmethod
    def row(path: str, message: str, expected: str, actual: Column) -> Column:
        return F.struct(F.lit(path).alias("property_path"), F.lit("error").alias("severity"), F.lit(message).alias("message"), F.lit(expected).alias("expected"), actual.alias("actual"))

    def nodes(self, q: PropertyShape, prop: PropertySpec, nodes: Column, path: str) -> tuple[list[Column], list[Column]]:
        """Issues of a property whose values are nodes, references or concepts."""
        n = F.when(nodes.isNull(), 0).otherwise(F.size(nodes))
        flat, lists = self.counts(q, n, path), []
        if prop.is_concept or prop.is_reference:
            text = (lambda v: v) if prop.is_concept else (lambda v: v["@id"])
            flat += self.kind(q, "IRI", n > 0, path)
            if q.allowed:
                ok, expected = F.lit([*map(local_name, q.allowed), *q.allowed]), ", ".join(map(local_name, q.allowed))
                lists.append(F.transform(F.filter(nodes, lambda v: ~F.array_contains(ok, text(v))), lambda v: self.row(path, "value is not allowed", expected, text(v))))
            if q.node_class and prop.is_reference and self.unknown_class:
                flat.append(self.issue(n > 0, path, "the class of a reference is not known", self.class_name(q.node_class), severity=self.unknown_class))
            return flat, lists
        flat += self.kind(q, "BlankNode", n > 0, path) + self.type_of(q, prop.type, n > 0, path)
        if q.datatype:
            flat.append(self.issue(n > 0, path, "datatype differs", "xsd:" + local_name(q.datatype), F.lit("a node")))
        if child := self.shapes.shapes.get(q.node or ""):
            lists.append(F.flatten(F.transform(nodes, lambda e: self.element(child, prop, e, path))))
        return flat, lists

    def element(self, shape: NodeShape, prop: PropertySpec, e: Column, path: str) -> Column:
        if prop.wrapper_field and prop.inner_type:
            outer = self.node(shape, e, path + ".", {}, {}, {prop.wrapper_field})
            for q in shape.properties:
                if self.call(q) == prop.wrapper_field:
                    inner, at = e.getField(prop.wrapper_field), f"{path}.{prop.wrapper_field}"
                    here = self.found(self.type_of(q, prop.inner_type, inner.isNotNull(), at), [])
                    child = self.shapes.shapes.get(q.node or "")
                    deep = [self.fields(child, prop, inner, at)] if child else []
                    return F.concat(outer, here, *deep)
            return outer
        return self.fields(shape, prop, e, path)

    def fields(self, shape: NodeShape, prop: PropertySpec, e: Column, path: str) -> Column:
        held = {name for name, has in zip(_STATUS, (prop.record_status, prop.data_collection), strict=True) if has}
        return self.node(shape, e, path + ".", {f.target: f for f in prop.fields}, {p.name: p for p in prop.properties}, held)

    def node(self, shape: NodeShape, e: Column, path: str, fields: dict, nested: dict, held: set) -> Column:
        flat, lists = [], []
        for q in shape.properties:
            name = self.call(q)
            if name in nested:
                more = self.nodes(q, nested[name], e.getField(name), path + name)
            elif name in fields:
                more = self.literal(q, fields[name], e.getField(name), path + name)
            elif name not in held and q.min_count and local_name(q.path) not in _STATUS:
                more = [self.issue(True, path + name, "too few values", f"at least {q.min_count}", F.lit("0"))], []
            else:
                continue
            flat += more[0]
            lists += more[1]
        if shape.closed:
            known = {self.call(q) for q in shape.properties} | {self.names.get(i, local_name(i)) for i in shape.ignored}
            for name in sorted({*fields, *nested, *held} - known):
                c = e.getField(name)
                there = F.size(c) > 0 if name in nested else c.isNotNull()
                flat.append(self.issue(there, path + name, "the shape is closed", "no such property"))
        return self.found(flat, lists)


def compile_constraints(shapes: Shapes, spec: MappingSpec, document: Column, names: dict[str, str] | None = None, unknown_class: str = "warning") -> Column:
    """Array of violations (property_path, severity, message, expected, actual) of a compiled document column.

    Counts, datatypes and their lexical forms, allowed values, classes, node kinds and closed shapes are checked, from
    the root shape down through child nodes, nested properties and the inner nodes of wrappers. The class of a node that
    is a reference alone cannot be known from a document: it is told with the severity ``unknown_class``, or not at all
    when that is empty.
    """
    return _Judge(shapes, names or {}, unknown_class).node(shapes.root(), document, "", {}, {p.name: p for p in spec.properties}, set())


@dataclass(frozen=True)
class ShapeFolder:
    name: str
    path: Path
    mapping: dict
    shacl: Path | None
    context: dict
    sample: Path | None
    example: Path | None

    def spec(self) -> MappingSpec:
        return parse(self.mapping)

    def shapes(self) -> Shapes:
        if self.shacl is None:
            raise ShapeError(f"shape {self.name!r} has no SHACL file")
        return Shapes(self.shacl.read_text(encoding="utf-8"))


class Registry:
    """Shape folders by name: a mapping, and optionally SHACL, a context, a sample and an example."""

    def __init__(self, *folders: str | Path):
        self.folders = [Path(f) for f in folders]
        self.loaded: dict[str, ShapeFolder] = {}

    def add(self, folder: str | Path) -> None:
        self.folders.insert(0, Path(folder))

    def available(self) -> list[str]:
        return sorted({d.name for f in self.folders if f.is_dir() for d in f.iterdir() if d.is_dir() and d.name != "base" and any(d.glob("*mapping*.yaml"))})

    def load(self, name: str) -> ShapeFolder:
        import yaml

        for f in self.folders:
            d = f / name
            if d.is_dir() and (maps := sorted(d.glob("*mapping*.yaml"))):
                first = lambda pattern, d=d: next(iter(sorted(d.glob(pattern))), None)
                context = first("*context*.json")
                self.loaded[name] = ShapeFolder(name, d, yaml.safe_load(maps[0].read_text(encoding="utf-8")), first("*SHACL*.ttl"), json.loads(context.read_text(encoding="utf-8")) if context else {}, first("*.csv"), first("*example*.json"))
                return self.loaded[name]
        raise ShapeError(f"no shape {name!r}; available: {', '.join(self.available()) or 'none'}")

    def get(self, name: str) -> ShapeFolder:
        return self.loaded.get(name) or self.load(name)

    def fetch(self, name: str, mapping_url: str, shacl_url: str | None = None, context_url: str | None = None, cache: str | Path = "shapes", force: bool = False) -> ShapeFolder:
        """Download a shape's files once into ``cache`` and load it."""
        d = Path(cache) / name
        d.mkdir(parents=True, exist_ok=True)
        for url, file in ((mapping_url, f"{name}_mapping.yaml"), (shacl_url, f"{name}_SHACL.ttl"), (context_url, f"{name}_context.json")):
            if url and (force or not (d / file).exists()):
                try:
                    with urllib.request.urlopen(url, timeout=30) as answer, open(d / file, "wb") as out:
                        shutil.copyfileobj(answer, out)
                except OSError as e:
                    raise ShapeError(f"cannot fetch {url}") from e
        self.add(cache)
        return self.load(name)


def context_names(context: dict) -> dict[str, str]:
    """IRI to name of a JSON-LD context; one prefix is expanded."""
    terms = context.get("@context", context)
    terms = {k: v for part in (terms if isinstance(terms, list) else [terms]) if isinstance(part, dict) for k, v in part.items()}
    out = {}
    for name, v in terms.items():
        iri = v.get("@id") if isinstance(v, dict) else v
        if isinstance(iri, str) and not name.startswith("@"):
            prefix, colon, rest = iri.partition(":")
            base = terms.get(prefix)
            out[base + rest if colon and isinstance(base, str) and not rest.startswith("//") else iri] = name
    return out
