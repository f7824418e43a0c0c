"""Mapping specifications: reading, checking, overriding and composing."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from nestwright.errors import ConfigError


@dataclass(frozen=True)
class FieldSpec:
    target: str
    source: str
    optional: bool = False
    transform: str | None = None
    datatype: str | None = None
    multi_value_split: str | None = None


@dataclass(frozen=True)
class PropertySpec:
    name: str
    type: str = ""
    cardinality: str = "single"
    split_on: str = "|"
    source_table: str | None = None
    wrapper_field: str | None = None
    inner_type: str | None = None
    record_status: bool = False
    data_collection: bool = False
    fields: tuple[FieldSpec, ...] = ()
    properties: tuple[PropertySpec, ...] = ()

    @property
    def is_reference(self) -> bool:
        return self.type in ("id_ref", "iri_ref")

    @property
    def is_concept(self) -> bool:
        return self.type == "named_individual"


@dataclass(frozen=True)
class MappingSpec:
    id_source: str
    type: str | list[str] = ""
    base_uri: str = ""
    context_url: Any = ""
    id_transform: str | None = None
    id_is_uri: bool = False
    properties: tuple[PropertySpec, ...] = ()
    record_status: dict | None = None
    data_collection: dict | None = None
    raw: dict = field(default_factory=dict, compare=False, repr=False)

    def config(self) -> dict:
        """The configuration that the specification was made of; a copy, which may be changed."""
        return copy.deepcopy(self.raw)

    def satellite_columns(self) -> dict[str, list[str]]:
        """Columns that the mapping reads from each satellite."""
        out: dict[str, set[str]] = {}

        def walk(props, table):
            for p in props:
                own = p.source_table or table
                if own:
                    out.setdefault(own, set()).update(f.source for f in p.fields)
                walk(p.properties, own)

        walk(self.properties, None)
        return {t: sorted(c) for t, c in out.items()}

    def sources(self) -> set[str]:
        """Columns that the mapping reads from the primary row."""
        out = {self.id_source, *re.findall(r"\{([^{}]+)\}", self.base_uri)}

        def walk(props):
            for p in props:
                if not p.source_table:
                    out.update(f.source for f in p.fields)
                walk(p.properties)

        walk(self.properties)
        return out


def check_base_uri(uri: str) -> None:
    """Raises where a base would make unsafe or broken identifiers."""
    low = uri.lower()
    if not uri.strip():
        raise ConfigError("base_uri is empty")
    if re.search(r"[\s\x00]", uri) or re.match(r"(javascript|data|vbscript|file|ftp):", low) or "<script" in low:
        raise ConfigError(f"base_uri {uri!r} is not allowed")
    if re.search(r"%2e%2e|\.\.[/\\]|%2f\.\.|\.\.%2f", low):
        raise ConfigError(f"base_uri {uri!r} climbs paths")
    if uri[-1] not in "/#":
        raise ConfigError(f"base_uri {uri!r} must end with / or #")


def _fields(given: Any, where: str) -> tuple[FieldSpec, ...]:
    rows = given.items() if isinstance(given, dict) else [(f.get("target") or f.get("name") or f.get("source"), f) for f in given or []]
    out = []
    for key, f in rows:
        if not isinstance(f, dict) or not f.get("source"):
            raise ConfigError(f"field {key!r} of {where} has no source")
        out.append(FieldSpec(str(f.get("target") or key), f["source"], bool(f.get("optional", False)), f.get("transform"), f.get("datatype"), f.get("multi_value_split")))
    return tuple(out)


def _property(name: str, p: dict, where: str) -> PropertySpec:
    if not isinstance(p, dict):
        raise ConfigError(f"property {where} is not a mapping")
    if p.get("cardinality", "single") not in ("single", "multiple"):
        raise ConfigError(f"cardinality of {where} is single or multiple")
    fields = _fields(p.get("fields", {}), where)
    if not fields and p.get("source"):  # short form: one field of the property's own name
        fields = (FieldSpec(name, p["source"], bool(p.get("optional", True)), p.get("transform"), p.get("datatype"), p.get("multi_value_split")),)
    if p.get("cardinality") == "multiple" and not fields:
        raise ConfigError(f"{where} is multiple but has no fields")
    nested = tuple(_property(n, q, f"{where}.{n}") for n, q in (p.get("properties") or {}).items())
    return PropertySpec(name, p.get("type", ""), p.get("cardinality", "single"), p.get("split_on", "|"), p.get("source_table"), p.get("wrapper_field"), p.get("inner_type"), bool(p.get("include_record_status")), bool(p.get("include_data_collection")), fields, nested)


def parse(config: dict) -> MappingSpec:
    """Checked specification of a configuration."""
    if not isinstance(config, dict) or not config.get("id_source"):
        raise ConfigError("a mapping needs id_source")
    base, uri = config.get("base_uri") or "", bool(config.get("id_is_uri"))
    if not uri:
        plain = re.sub(r"\{[^{}]+\}", "x", base)
        check_base_uri(plain + "/" if base.endswith("}") else plain)  # a template that ends in a column is the whole identifier
    props = tuple(_property(n, p, n) for n, p in (config.get("properties") or {}).items())
    return MappingSpec(config["id_source"], config.get("type", ""), base, config.get("context_url", ""), config.get("id_transform"), uri, props, config.get("record_status_defaults"), config.get("data_collection_defaults"), copy.deepcopy(config))


def load(path: str | Path) -> MappingSpec:
    """Specification from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


def with_overrides(spec: MappingSpec, sources: dict | None = None, transforms: dict | None = None, id_source: str | None = None, id_transform: str | None = None) -> MappingSpec:
    """Other sources or transforms for top-level fields, by property and then by target or key; unknown names do nothing."""
    config = copy.deepcopy(spec.raw)
    for key, table in (("source", sources), ("transform", transforms)):
        for prop, changes in (table or {}).items():
            given = config.get("properties", {}).get(prop, {}).get("fields", {})
            for name, f in given.items() if isinstance(given, dict) else [(f.get("target"), f) for f in given]:
                new = changes.get(f.get("target", name), changes.get(name))
                if new is not None:
                    f[key] = new
    if id_source:
        config["id_source"] = id_source
    if id_transform:
        config["id_transform"] = id_transform
    return parse(config)


def compose(base: dict, overlay: dict) -> dict:
    """``base`` with ``overlay`` on top: fields merge by key, defaults by key, everything else is replaced."""
    out = copy.deepcopy(base)
    for key, value in copy.deepcopy(overlay).items():
        if key == "properties":
            for name, prop in value.items():
                mine = out.setdefault("properties", {}).setdefault(name, {})
                for k, v in prop.items():
                    if k == "fields" and isinstance(v, dict) and isinstance(mine.get("fields"), dict):
                        for f, d in v.items():
                            mine["fields"][f] = {**mine["fields"].get(f, {}), **d}
                    else:
                        mine[k] = v
        elif key in ("record_status_defaults", "data_collection_defaults") and isinstance(out.get(key), dict):
            out[key] = {**out[key], **value}
        else:
            out[key] = value
    return out
