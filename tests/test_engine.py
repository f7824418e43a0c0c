import http.server
import json
import subprocess
import tempfile
import threading
import urllib.parse
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from nestwright import catalog_io
from nestwright.cli import main
from nestwright.errors import QualityError, ShapeError, SourceError
from nestwright.logs import scrub
from nestwright.operators import matcher, quality, synth
from nestwright.operators.profile import profile
from nestwright.operators.shapes import Registry, Shapes, compile_constraints, read_turtle
from nestwright.pipeline import Pipeline
from nestwright.plans.spec import parse
from nestwright.sinks import docstore, files, serial
from nestwright.sources import services
from nestwright.sources.files import batches, read_csv, read_jdbc, read_ndjson, read_rows, source_for
from nestwright.sources.rest import flatten, next_link, read_rest
from nestwright.streaming import stream_to_parts

SPEC = {"base_uri": "ex:a/", "id_source": "id", "type": "A", "properties": {"n": {"type": "N", "fields": {"day": {"source": "day", "datatype": "xsd:date", "optional": True}, "name": {"source": "name"}}}}}
TTL = """
@prefix ex: <http://e.org/t#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:AShape a sh:NodeShape ; sh:closed true ; sh:property ex:nP ; sh:targetClass ex:A .
ex:NShape a sh:NodeShape ; sh:closed true ; sh:property ex:nameP, ex:dayP ; sh:targetClass ex:N .
ex:nP a sh:PropertyShape ; sh:path ex:n ; sh:node ex:NShape ; sh:minCount 1 ; sh:maxCount 1 .
ex:nameP a sh:PropertyShape ; sh:path ex:name ; sh:datatype xsd:string ; sh:minCount 1 ; sh:in ( "ann" "bob" ) . # names
ex:dayP a sh:PropertyShape ; sh:path ex:day ; sh:datatype xsd:date ; sh:maxCount 1 .
"""


def test_quality_rules(spark):
    df = read_rows(spark, [{"id": "1", "day": "2024-01-02", "name": "ann"}, {"id": None, "day": "2024-1-2", "name": "eve"}, {"id": "3", "day": "2024-02-30", "name": None}])
    checked = quality.compile_rules(parse(SPEC), df.schema, {"n.name": ["ann", "bob"]}).check(df)
    assert quality.summary(checked).head().asDict() == {"total_records": 3, "error_count": 2, "warning_count": 3, "failed_records": 2, "conforms": False}
    assert {(r.record_id, r.property_path) for r in quality.issue_table(checked).collect()} == {("None", "@id"), ("None", "n.day"), ("None", "n.name"), ("3", "n.day"), ("3", "n.name")}
    with pytest.raises(QualityError):
        quality.first_strict(checked)
    assert quality.sample(spark.range(100), 0.1, 3).count() == 10 and quality.sample(spark.range(3), 0.1).count() == 1


def test_reports(spark, tmp_path):
    issues = spark.createDataFrame([("=x", ["<a>"])], "message string, expected array<string>")
    files.report_html({"n": 1}, issues, str(tmp_path / "r.html"))
    assert "&lt;a&gt;" in (tmp_path / "r.html").read_text()
    files.report_csv(issues.select("message"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).head()[0] == "'=x"
    files.report_json({"n": 1}, issues, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["n"] == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B,C\n1,"x\ny",\nNA,z\n')
    rows = read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny", None), (None, "z", None)]
    (tmp_path / "b.ndjson").write_text('﻿{"a": 1, "b": "x"}\n\n{"a": null}\n', encoding="utf-8")
    assert [r.a for r in source_for(spark, str(tmp_path / "b.ndjson")).collect()] == ["1", None]
    (tmp_path / "c.ndjson").write_text('{"a": 1}\nnonsense\n')
    with pytest.raises(Exception, match="no JSON object"):
        read_ndjson(spark, str(tmp_path / "c.ndjson")).collect()
    assert read_ndjson(spark, str(tmp_path / "c.ndjson"), strict=False).count() == 2
    with pytest.raises(SourceError):
        source_for(spark, "x.zip")
    assert [len(b) for b in batches(spark.range(5), 2)] == [2, 2, 1]


class _Pages(http.server.BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        rows, head, code = [{"k": i, "v": {"x": i}} for i in range(5)], {}, 200
        body = rows
        if url.path == "/offset":
            body = {"data": {"rows": rows[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]}}
        elif url.path == "/cursor":
            at = int(q.get("cursor", 0))
            body = {"data": {"rows": rows[at : at + 2]}, "next_cursor": at + 2 if at + 2 < 5 else None}
        elif url.path == "/link":
            at = int(q.get("p", 0))
            body, head = rows[at : at + 2], {"Link": f'</link?p={at + 2}>; rel="next"'} if at + 2 < 5 else {}
        elif url.path == "/bad":
            code = 500
        self.send_response(code)
        for k, v in head.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


def test_rest_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    keys = lambda df: sorted(r.k for r in df.collect())
    want = list("01234")
    assert keys(read_rest(spark, base + "/none")) == want
    assert keys(read_rest(spark, base + "/offset", results_key="data.rows", pagination="offset", page_size=2)) == want
    parallel = read_rest(spark, base + "/offset", ["k"], results_key="data.rows", pagination="offset", page_size=2, total=5)
    assert keys(parallel) == want and parallel.rdd.getNumPartitions() == 3
    assert keys(read_rest(spark, base + "/cursor", results_key="data.rows", pagination="cursor")) == want
    assert keys(read_rest(spark, base + "/link", pagination="link")) == want
    with pytest.raises(SourceError):
        read_rest(spark, base + "/bad")
    server.shutdown()
    assert next_link('<a>; rel="prev", <b?x=1>; rel="next"') == "b?x=1" and next_link(None) is None


def test_services_check_their_arguments(spark):
    for call in (lambda: services.read_powerschool(spark, "", "t"), lambda: services.read_canvas(spark, "b", "k", "sections"), lambda: services.read_oneroster(spark, "b", "users"), lambda: services.read_bigquery(spark), lambda: services.sheet_id("short")):
        with pytest.raises(Exception, match="must not|needs|either|give"):
            call()
    assert services.sheet_id("https://docs.google.com/spreadsheets/d/abc_1-2/edit") == "abc_1-2"


def test_flatten(spark):
    df = spark.sql("select 1 as id, named_struct('b', 2) as a, array(named_struct('x', 3), named_struct('x', 4)) as items")
    assert flatten(df, {"items": 2}).head().asDict() == {"id": 1, "a_b": 2, "item_0_x": 3, "item_1_x": 4, "items_count": 2}
    with pytest.raises(SourceError):
        flatten(spark.sql("select named_struct('b', 2) as a, 1 as a_b"))


def test_shapes(spark, tmp_path):
    s = Shapes(TTL)
    assert s.root().local == "AShape" and s.allowed_values() == {"n.name": ["ann", "bob"]}
    assert parse({**s.template(base_uri="ex:a/"), "id_source": "id"}).properties[0].fields
    assert s.reconcile(parse(SPEC)) == []
    assert {d["property"] for d in s.reconcile(parse({**SPEC, "properties": {"o": {"type": "O", "fields": {"x": {"source": "x"}}}}}))} == {"n", "o"}
    df = read_rows(spark, [{"id": "1", "day": None, "name": "ann"}, {"id": "2", "day": None, "name": "zoe"}])
    docs = Pipeline(df, parse(SPEC)).documents()
    bad = docs.select("id", compile_constraints(s, parse(SPEC), F.col("document")).alias("v")).where(F.size("v") > 0).collect()
    assert [r.id for r in bad] == ["ex:a/2"] and bad[0].v[0].message == "value is not allowed"
    assert read_turtle("@prefix a: <x#> . a:s a:p [ a:q 1 ] .")[0][1] == "x#q"
    with pytest.raises(ShapeError):
        Shapes("@prefix a: <x#> . a:s a:p a:o .")
    d = tmp_path / "thing"
    d.mkdir()
    (d / "thing_mapping.yaml").write_text(json.dumps(SPEC))
    (d / "thing_SHACL.ttl").write_text(TTL)
    r = Registry(tmp_path)
    assert r.available() == ["thing"] and r.get("thing").spec().type == "A"
    with pytest.raises(ShapeError):
        r.get("none")


def test_profile_and_matching(spark):
    df = read_rows(spark, [{"Name": n, "Day": f"2024-01-0{i + 1}", "Zip": str(i)} for i, n in enumerate(["ann", "bob", "ann"])])
    p = {r.column: r for r in profile(df).collect()}
    assert p["Day"].inferred_type == "date" and p["Zip"].inferred_type == "integer" and p["Name"]["values"] == ["ann", "bob"]
    config, found = matcher.suggest(df, Shapes(TTL), base_uri="ex:a/")
    assert {m.column: m.target.name for m in found} == {"Name": "name", "Day": "day"} and parse(config)
    assert "# x Zip" in matcher.annotated_yaml(config, found, df.columns)


def test_synthetic_rows_are_seeded(spark):
    a, b = (synth.generate(spark, parse(SPEC), 20, 5).orderBy("id").collect() for _ in range(2))
    assert a == b and Pipeline(synth.generate(spark, parse(SPEC), 20), parse(SPEC)).rejected().count() == 0


def test_synthetic_segments_go_together(spark):
    spec = parse({"base_uri": "ex:a/", "id_source": "k", "properties": {"m": {"type": "M", "cardinality": "multiple", "fields": {"a": {"source": "a"}, "b": {"source": "b", "multi_value_split": ","}}}}})
    rows = synth.generate(spark, spec, 50, pools={"b": ["x", "y"]}).collect()
    assert all(r.a.count("|") == r.b.count("|") for r in rows) and {v for r in rows for s in r.b.split("|") for v in s.split(",")} == {"x", "y"}


def test_document_store(spark):
    rows = read_rows(spark, [{"@id": "ex:a/1", "@type": "A", "json": "{}"}, {"@id": "", "@type": "A", "json": "{}"}])
    ready = docstore.prepare(rows)
    assert [(r.id, r.partitionKey) for r in ready.collect()] == [("ex:a|1", "A"), (None, "A")]
    total = docstore.upsert_summary(docstore.upsert(ready, lambda: lambda body: 2.5)).head()
    assert (total.succeeded, total.failed, total.charge) == (1, 1, 2.5)


def test_stream_equals_batch(spark, tmp_path):
    df = read_rows(spark, [{"id": str(i), "day": None, "name": "n" if i % 3 else None} for i in range(1, 10)])
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    p = Pipeline(source, parse(SPEC), dead_letters=str(tmp_path / "dead"))
    stream_to_parts(p, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == sorted(r.value for r in Pipeline(df, parse(SPEC)).json().collect())
    assert spark.read.json(str(tmp_path / "dead")).count() == 3


def test_single_files(spark, tmp_path):
    p = Pipeline(read_rows(spark, [{"id": "1", "day": None, "name": "a"}, {"id": "2", "day": None, "name": "b"}]), parse(SPEC))
    p.to_json(str(tmp_path / "x" / "a.json"))
    assert [d["@id"] for d in json.loads((tmp_path / "x" / "a.json").read_text())] == ["ex:a/1", "ex:a/2"] == [d["@id"] for d in p.stream()]
    p.to_ndjson(str(tmp_path / "a.ndjson"))
    assert len((tmp_path / "a.ndjson").read_text().splitlines()) == 2
    keyed = Pipeline(p.source, parse(SPEC), store_keys=True).json().head()[0]
    assert json.loads(keyed)["id"] == "ex:a|1"


def test_items_of_an_array_one_by_one(tmp_path):
    path = tmp_path / "a.json"
    value = [1.5, -20, 1e300, [], {}, {"a": ["],", None, {"é": "\n\\"}]}, "x" * 300, True]
    for indent in (None, 2):
        path.write_text(json.dumps(value, indent=indent, ensure_ascii=False), encoding="utf-8")
        assert all(list(serial.read_items(path, size)) == value for size in (1, 2, 3, 50, 100_000))
    for bad in ("", "{}", "[ ", "[1", "[1, ", "[1,]", "[1 2]", "[1] 2", "[NaN]", "[1.]"):
        path.write_text(bad)
        with pytest.raises(SourceError):
            list(serial.read_items(path, 2))
    with pytest.raises(SourceError):
        next(serial.read_items(tmp_path / "none.json"))


def test_single_files_are_counted_without_holding_them(spark, small, monkeypatch):
    """The driver reads back neither file as a whole."""
    held = []
    monkeypatch.setattr(serial, "read_json", lambda path: held.append(path))
    monkeypatch.setattr(Path, "read_text", lambda self, *a, **b: held.append(self))
    made = catalog_io.single_files(spark, small)
    assert {r.form: r.records for r in made.collect()} == dict.fromkeys(("json", "ndjson"), spark.read.parquet(f"{small}/orders.parquet").where("o_orderkey <> 0").count())
    assert not held
    assert catalog_io._distinct(["a", "b\n", "a", "", "é"], Path(tempfile.mkdtemp()) / "x", 2) == 4


def test_a_single_file_holds_no_partition(spark, tmp_path, monkeypatch):
    """Partitions of any size: their texts come in files, in order, whatever separators of lines they hold."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **b: pytest.fail("a partition is fetched whole"))
    want = [json.dumps({"n": i, "x": "\u2028é\r\x85"}, ensure_ascii=False) for i in range(700)]
    docs = spark.createDataFrame([(x,) for x in want], "value string").coalesce(3)
    assert files.write_single(docs, str(tmp_path / "a.ndjson")).records == 700
    assert (tmp_path / "a.ndjson").read_bytes().decode().removesuffix("\n").split("\n") == want
    files.write_single(docs.limit(0), str(tmp_path / "a.json"), "array")
    assert json.loads((tmp_path / "a.json").read_text()) == []


def test_database_that_other_processes_open(spark, small):
    """An executor is another process than the driver: a database in memory, or one that the driver holds, is not there."""
    url = catalog_io._database(spark, spark.read.parquet(f"{small}/nation.parquet"), "nation")
    jars = Path(pyspark.__file__).parent / "jars"
    ij = ["java", "-cp", f"{jars}/*", "org.apache.derby.tools.ij"]
    for _ in range(2):
        assert read_jdbc(spark, url, table="nation", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 25
        out = subprocess.run(ij, input=f"connect '{url}'; select count(*) from nation;", capture_output=True, text=True, timeout=60, cwd=tempfile.mkdtemp()).stdout
        assert "25" in out and "ERROR" not in out


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "thing"
    d.mkdir()
    (d / "thing_mapping.yaml").write_text(json.dumps(SPEC))
    (d / "thing_SHACL.ttl").write_text(TTL)
    (tmp_path / "in.csv").write_text("id,day,name\n1,2024-01-02,ann\n2,,\n")
    base = ["--shapes-dir", str(tmp_path), "-s", "thing", "-i", str(tmp_path / "in.csv")]
    assert main(["validate", *base]) == 1
    assert main(["convert", *base, "-o", str(tmp_path / "o.ndjson"), "--dead-letters", str(tmp_path / "dl")]) == 0
    assert main(["list-shapes", "--shapes-dir", str(tmp_path)]) == 0 and "thing" in capsys.readouterr().out
    assert main(["introspect", "--shacl", str(d / "thing_SHACL.ttl"), "--format", "json"]) == 0
    assert main(["generate-mapping", "--shacl", str(d / "thing_SHACL.ttl"), "-o", str(tmp_path / "m.yaml")]) == 0
    assert main(["map-wizard", "--shapes-dir", str(tmp_path), "-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "w.yaml")]) == 0
    assert main(["convert", *base[:3], "nothing", *base[4:], "-o", "x"]) == 2


def test_validation_in_two_phases(spark, tmp_path):
    rows = [{"id": str(i), "day": None, "name": "ann"} for i in range(40)]
    bad = read_rows(spark, [*rows, {"id": "x", "day": None, "name": None}])
    for seed in range(3):  # row checks are never sampled
        table, issues = Pipeline(bad, parse(SPEC)).validate("sample", 0.05, seed)
        assert table.head().asDict() == {"total_records": 41, "error_count": 1, "warning_count": 0, "failed_records": 1, "conforms": False}
        assert [r.record_id for r in issues.collect()] == ["x"]
    shapes = Shapes(TTL)
    zoe = Pipeline(read_rows(spark, [{**r, "name": "zoe"} for r in rows]), parse(SPEC))
    assert zoe.validate()[0].head().conforms
    table, issues = zoe.validate(shacl=shapes)
    assert (table.head().total_records, table.head().error_count, table.head().conforms, issues.count()) == (40, 40, False, 40)
    assert zoe.validate("sample", 0.1, shacl=shapes)[0].head().error_count == 4
    with pytest.raises(QualityError):
        zoe.validate("strict", shacl=shapes)
    assert Pipeline(read_rows(spark, rows), parse(SPEC)).validate(shacl=shapes)[0].head().conforms
    d = tmp_path / "thing"
    d.mkdir()
    (d / "thing_mapping.yaml").write_text(json.dumps(SPEC))
    (d / "thing_SHACL.ttl").write_text(TTL.replace("sh:path ex:day ; sh:datatype xsd:date", "sh:path ex:day ; sh:minCount 1 ; sh:datatype xsd:date"))
    (tmp_path / "in.csv").write_text("id,day,name\n1,2024-01-02,ann\n2,,bob\n")
    base = ["validate", "--shapes-dir", str(tmp_path), "-s", "thing", "-i", str(tmp_path / "in.csv")]
    assert main(base) == 0 and main([*base, "--shacl"]) == 1


def test_logs_hide_personal_data():
    assert scrub({"ssn": "1", "note": ["a@b.org", {"FirstName": "x"}]}) == {"ssn": "***REDACTED***", "note": ["***REDACTED***", {"FirstName": "***REDACTED***"}]}


def test_catalogue(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
