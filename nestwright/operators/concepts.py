"""Concept values of an ontology: what a property may hold, by allowed individuals or by the class of its range.

Ontologies are Turtle texts, or RDF/XML as far as descriptions with literal and resource properties go. They are
metadata, so this runs on the driver; value sets reach data as literals or pools.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from nestwright.errors import ShapeError
from nestwright.operators.shapes import RDF, XSD, PropertyShape, Shapes, local_name, read_turtle
from nestwright.plans.spec import MappingSpec

SKOS, RDFS, OWL = "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
RANGES = ("http://schema.org/rangeIncludes", "https://schema.org/rangeIncludes", RDFS + "range")
DESCRIPTIONS = ("http://purl.org/dc/elements/1.1/description", "http://purl.org/dc/terms/description", RDFS + "comment", SKOS + "definition")


def read_rdf_xml(text: str) -> list[tuple]:
    """(subject, predicate, object) triples of an RDF/XML text without nested descriptions."""
    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise ShapeError(f"no RDF/XML: {e}") from e
    name = lambda tag: tag[1:].replace("}", "") if tag.startswith("{") else tag
    out = []
    for node in top:
        subject = node.get(f"{{{RDF}}}about") or node.get(f"{{{RDF}}}ID") or ""
        if name(node.tag) != RDF + "Description":
            out.append((subject, RDF + "type", name(node.tag)))
        for child in node:
            out.append((subject, name(child.tag), child.get(f"{{{RDF}}}resource") or (child.text or "").strip()))
    return out


class Concepts:
    """Facts of ontologies by subject."""

    def __init__(self, triples: list[tuple]):
        self.facts: dict[str, dict[str, list]] = {}
        self.members: dict[str, list[str]] = {}
        for s, p, o in triples:
            self.facts.setdefault(s, {}).setdefault(p, []).append(o)
        for s, f in self.facts.items():
            if OWL + "NamedIndividual" in f.get(RDF + "type", []):
                for c in f[RDF + "type"]:
                    self.members.setdefault(c, []).append(s)
        self.schemes: dict[str, list[str]] = {}
        for s in self.members.get(OWL + "NamedIndividual", []):
            for c in self.facts[s].get(SKOS + "inScheme", []):
                self.schemes.setdefault(c, []).append(s)

    @classmethod
    def load(cls, *paths: str | Path) -> Concepts:
        triples = []
        for p in map(Path, paths):
            try:
                text = p.read_text(encoding="utf-8")
            except OSError as e:
                raise ShapeError(f"no ontology at {p}") from e
            triples += read_turtle(text) if p.suffix == ".ttl" else read_rdf_xml(text)
        return cls(triples)

    def _one(self, iri: str, *predicates: str) -> str | None:
        found = self.facts.get(iri, {})
        return next((str(v).strip() for p in predicates for v in found.get(p, []) if str(v).strip()), None)

    def notation(self, iri: str) -> str | None:
        """What data write for an individual: its notation, else its label."""
        return self._one(iri, SKOS + "notation", RDFS + "label")

    def notations(self, iris: tuple[str, ...] | list[str]) -> list[str]:
        return [n for i in iris if (n := self.notation(i))]

    def of_class(self, iri: str) -> list[str]:
        """Values of a class's individuals, by type, else by scheme."""
        return sorted(set(self.notations(self.members.get(iri, []))) or set(self.notations(self.schemes.get(iri, []))))

    def range_of(self, iri: str) -> str | None:
        """The class in a property's range; datatypes are none."""
        found = self.facts.get(iri, {})
        return next((c for p in RANGES for c in found.get(p, []) if not str(c).startswith(XSD)), None)

    def values(self, p: PropertyShape) -> list[str]:
        """Values that a property may hold: its allowed individuals, else the individuals of its class or range."""
        if p.allowed:
            return self.notations(p.allowed)
        kind = p.node_class or self.range_of(p.path)
        return self.of_class(kind) if kind else []

    def role(self, p: PropertyShape) -> str:
        """``concept`` (a set of values), ``structural`` (a node of its own) or ``literal``."""
        if p.allowed or (not p.node and self.values(p)):
            return "concept"
        return "structural" if p.node or p.node_class else "literal"

    def metadata(self, iri: str) -> dict:
        """Label, description, greatest length and text format of a property, as far as they are told."""
        named = {local_name(k): v[0] for k, v in self.facts.get(iri, {}).items()}
        length = str(named.get("maxLength", ""))
        return {"iri": iri, "label": self._one(iri, RDFS + "label") or "", "description": self._one(iri, *DESCRIPTIONS) or "", "max_length": int(length) if length.isdigit() else None, "text_format": named.get("textFormat")}


def pools(spec: MappingSpec, shapes: Shapes, concepts: Concepts, names: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Value pools by source column, for the synthetic rows of a mapping whose fields are concepts of the shapes."""
    names, out = names or {}, {}
    call = lambda p: names.get(p.path, p.name or local_name(p.path))
    fields = {(p.name, f.target): f.source for p in spec.properties for f in p.fields}
    for p in shapes.root().properties:
        for q in shapes.shapes[p.node].properties if p.node else [p]:
            source = fields.get((call(p), call(q)))
            if source and (values := concepts.values(q)):
                out[source] = values
    return out
