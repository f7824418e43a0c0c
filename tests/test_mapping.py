import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nestwright.errors import ConfigError, MappingError
from nestwright.operators.relate import nest_join
from nestwright.pipeline import Pipeline
from nestwright.plans.compiler import compile_mapping
from nestwright.plans.spec import compose, parse, with_overrides
from nestwright.sources.files import read_rows

PERSON = {
    "context_url": "https://example.org/c.json", "base_uri": "ex:person/", "id_source": "Ids", "id_transform": "first_pipe_split", "type": "Person",
    "properties": {
        "race": {"type": "Race", "cardinality": "multiple", "include_record_status": True, "include_data_collection": True, "fields": {"code": {"source": "Race", "transform": "race_prefix", "multi_value_split": ",", "optional": True}}},
        "ident": {"type": "Ident", "cardinality": "multiple", "fields": {"value": {"source": "Ids", "datatype": "xsd:token", "transform": "int_clean"}, "system": {"source": "Systems", "optional": True}}},
        "birth": {"type": "Birth", "fields": {"day": {"source": "Birth", "datatype": "xsd:date", "transform": "date_format"}}},
        "name": {"type": "Name", "fields": {"first": {"source": "First"}, "middle": {"source": "Middle", "optional": True}}},
    },
    "record_status_defaults": {"type": "RecordStatus", "start": {"value": "1900-01-01T00:00:00", "datatype": "xsd:dateTime"}, "by": {"value_id": "ex:org/1"}},
    "data_collection_defaults": {"type": "DataCollection", "value_id": "ex:dc/1"},
}
ROW = {"First": "EDITH", "Middle": "M", "Birth": "1965-5-15", "Race": "White,Black|Asian", "Ids": "989897099.0|40420", "Systems": "SSN|Ed"}


def docs(spark, rows, config=PERSON, **kw):
    return [json.loads(r[0]) for r in Pipeline(read_rows(spark, rows), parse(config), **kw).json().collect()]


def test_whole_document(spark):
    status = {"@type": "RecordStatus", "start": {"@type": "xsd:dateTime", "@value": "1900-01-01T00:00:00"}, "by": {"@id": "ex:org/1"}}
    tail = {"hasRecordStatus": status, "hasDataCollection": {"@id": "ex:dc/1", "@type": "DataCollection"}}
    assert docs(spark, [ROW]) == [
        {
            "@context": "https://example.org/c.json", "@id": "ex:person/989897099", "@type": "Person",
            "race": [{"@type": "Race", "code": ["RaceAndEthnicity_White", "RaceAndEthnicity_Black"], **tail}, {"@type": "Race", "code": "RaceAndEthnicity_Asian", **tail}],
            "ident": [{"@type": "Ident", "value": {"@type": "xsd:token", "@value": "989897099"}, "system": "SSN"}, {"@type": "Ident", "value": {"@type": "xsd:token", "@value": "40420"}, "system": "Ed"}],
            "birth": {"@type": "Birth", "day": {"@type": "xsd:date", "@value": "1965-05-15"}},
            "name": {"@type": "Name", "first": "EDITH", "middle": "M"},
        }
    ]


def test_ragged_and_blank_segments(spark):
    d = docs(spark, [{**ROW, "Ids": "1||3", "Systems": "a|b"}])[0]
    assert d["ident"] == [{"@type": "Ident", "value": {"@type": "xsd:token", "@value": "1"}, "system": "a"}, {"@type": "Ident", "value": {"@type": "xsd:token", "@value": "3"}}]
    d = docs(spark, [{**ROW, "Race": None}])[0]
    assert "race" not in d


def test_errors_in_order_and_dead_letters(spark, tmp_path):
    rows = [ROW, {**ROW, "Birth": "1965-13-01", "First": None}, {**ROW, "First": " "}, {**ROW, "Ids": None}]
    p = Pipeline(read_rows(spark, rows), parse(PERSON))
    errors = [r._error for r in p.rejected().collect()]
    assert "date_format" in errors[0] and "First" in errors[1] and "ID source" in errors[2]
    with pytest.raises(MappingError):
        p.to_ndjson(str(tmp_path / "a.ndjson"))
    p = Pipeline(read_rows(spark, rows), parse(PERSON), dead_letters=str(tmp_path / "dead"))
    r = p.to_parts(str(tmp_path / "out"))
    assert (r.records_in, r.records_out, r.records_failed) == (4, 1, 3)
    lines = spark.read.json(str(tmp_path / "dead"))
    assert lines.count() == 3 and {"_error", "_record"} == set(lines.columns)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        p.to_parts(str(tmp_path / "out"))
    assert p.to_parts(str(tmp_path / "out"), "overwrite").records_out == 1


def test_scalars_that_are_none(spark):
    one = {"base_uri": "ex:a/", "id_source": "id", "properties": {"p": {"type": "P", "fields": {"x": {"source": "x", "optional": True}}}}}
    for value, sure in ((True, "boolean"), (["a"], "nested"), (float("inf"), "infinite")):
        p = Pipeline(read_rows(spark, [{"id": "1", "x": value}]), parse(one))
        assert sure in p.rejected().head()._error
    assert "p" not in docs(spark, [{"id": "1", "x": float("nan")}, {"id": "2", "x": []}], one)[0]
    for bad in (0, 0.0, " ", None):
        assert Pipeline(read_rows(spark, [{"id": bad, "x": "1"}]), parse(one)).rejected().count() == 1


def test_references_concepts_wrappers_nested(spark):
    config = {
        "base_uri": "ex:a/", "id_source": "id", "type": ["A"],
        "properties": {
            "ref": {"type": "iri_ref", "cardinality": "multiple", "fields": {"@id": {"source": "refs"}}},
            "use": {"type": "named_individual", "fields": {"u": {"source": "use"}}},
            "loc": {"type": "Loc", "wrapper_field": "addr", "inner_type": "Addr", "fields": {"city": {"source": "city", "optional": True}}},
            "rel": {"type": "Rel", "fields": {"t": {"source": "use"}}, "properties": {"to": {"type": "id_ref", "fields": {"@id": {"source": "refs"}}}}},
        },
    }
    d = docs(spark, [{"id": "1", "refs": "x:1|x:2", "use": "U", "city": "C"}, {"id": "2", "refs": "x:1", "use": "U", "city": None}], config)
    assert d[0] == {"@context": "", "@id": "ex:a/1", "@type": ["A"], "ref": [{"@id": "x:1"}, {"@id": "x:2"}], "use": "U", "loc": {"@type": "Loc", "addr": {"@type": "Addr", "city": "C"}}, "rel": {"@type": "Rel", "t": "U", "to": {"@id": "x:1|x:2"}}}
    assert d[1]["ref"] == {"@id": "x:1"} and "loc" not in d[1]


def test_satellites(spark):
    people = read_rows(spark, [{"sid": "1", "n": "a"}, {"sid": "2", "n": "b"}, {"sid": "3", "n": "c"}, {"sid": None, "n": "d"}])
    ids = read_rows(spark, [{"sid": "1", "k": "x", "o": 1}, {"sid": "2", "k": "y", "o": 2}, {"sid": "2", "k": "z", "o": 1}, {"sid": None, "k": "w", "o": 1}, {"sid": "2", "k": None, "o": 3}])
    rows = nest_join(people, "sid", {"ids": ids}, order_by={"ids": ["o"]})
    config = {"base_uri": "ex:a/", "id_source": "n", "properties": {"i": {"type": "I", "source_table": "ids", "fields": {"k": {"source": "k"}}}}}
    got = {json.loads(r[0])["@id"]: json.loads(r[0]).get("i") for r in Pipeline(rows, parse(config)).json().collect()}
    assert got == {"ex:a/a": {"@type": "I", "k": "x"}, "ex:a/b": [{"@type": "I", "k": "z"}, {"@type": "I", "k": "y"}], "ex:a/c": None, "ex:a/d": None}
    with pytest.raises(ConfigError):
        nest_join(people, " ", {"ids": ids})


def test_overrides_and_compose(spark):
    spec = with_overrides(parse(PERSON), {"name": {"first": "Nick"}, "nothing": {"x": "y"}}, id_source="Other")
    assert spec.id_source == "Other" and spec.properties[3].fields[0].source == "Nick"
    both = compose(PERSON, {"type": "P2", "properties": {"name": {"fields": {"first": {"transform": "sex_prefix"}, "last": {"source": "Last"}}}}})
    assert both["properties"]["name"]["fields"]["first"] == {"source": "First", "transform": "sex_prefix"} and both["type"] == "P2"
    assert "last" not in PERSON["properties"]["name"]["fields"]


@pytest.mark.parametrize("uri", ["", " ", "ex:a", "file:///x/", "ftp://x/", "javascript:x/", "ex:a b/", "ex:%2e%2e/"])
def test_base_uri(uri):
    with pytest.raises(ConfigError):
        parse({"id_source": "x", "base_uri": uri})


def test_custom_transform_and_unknown(spark):
    config = {"base_uri": "ex:a/", "id_source": "id", "properties": {"p": {"type": "P", "fields": {"x": {"source": "x", "transform": "t"}}}}}
    with pytest.raises(ConfigError):
        Pipeline(read_rows(spark, [{"id": "1", "x": "a"}]), parse(config))
    p = Pipeline(read_rows(spark, [{"id": "1", "x": "a"}, {"id": "2", "x": "bad"}]), parse(config), {"t": lambda v: {"x": 1} if v == "bad" else v.upper()})
    assert json.loads(p.json().head()[0])["p"] == {"@type": "P", "x": "A"} and "dict" in p.rejected().head()._error


text = st.text(st.characters(codec="utf-8", exclude_characters="|,"), max_size=8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(text, text, st.lists(text, min_size=1, max_size=3)), min_size=1, max_size=8))
def test_json_parses_and_agrees_with_the_struct(spark, rows):
    df = read_rows(spark, [{"id": f"k{i}", "a": a, "b": b, "m": "|".join(m)} for i, (a, b, m) in enumerate(rows)], ["id", "a", "b", "m"])
    config = {"base_uri": "ex:a/", "id_source": "id", "properties": {"s": {"type": "S", "fields": {"a": {"source": "a", "optional": True}, "b": {"source": "b", "datatype": "xsd:token", "optional": True}}}, "m": {"type": "M", "cardinality": "multiple", "fields": {"x": {"source": "m"}}}}}
    for r in compile_mapping(parse(config), df.schema).select(df, "json", "document").collect():
        d = json.loads(r.json)
        s = d.get("s", {})
        wide = r.document.s[0] if r.document.s else None
        assert s.get("a") == (wide.a if wide else None)
        assert (s.get("b") or {}).get("@value") == (wide.b["@value"] if wide and wide.b else None)
        m = d.get("m", [])
        assert [x["x"] for x in (m if isinstance(m, list) else [m])] == [x.x for x in r.document.m]


def test_partitioning_does_not_matter(spark):
    rows = [{**ROW, "Ids": str(i + 1)} for i in range(20)]
    a = docs(spark, rows)
    df = read_rows(spark, rows).repartition(7)
    b = [json.loads(r[0]) for r in Pipeline(df, parse(PERSON)).json().collect()]
    key = lambda d: d["@id"]
    assert sorted(a, key=key) == sorted(b, key=key)
