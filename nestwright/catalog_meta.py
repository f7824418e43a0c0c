"""Registered queries of profiles, matching, synthetic rows, shape folders, logs and the command line."""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from nestwright import errors
from nestwright.catalog import CUSTOMER, query, t
from nestwright.catalog_checks import SHAPED, TTL
from nestwright.logs import scrub
from nestwright.operators import concepts, matcher, synth
from nestwright.operators import profile as P
from nestwright.operators.shapes import Registry, Shapes, context_names
from nestwright.plans.spec import parse
from nestwright.shared import shared_folder


# ---- profiles -------------------------------------------------------------------------------------------------------
@query("""SELECT 'seg' AS "column", count(*) AS total, avg(CAST(c_custkey % 4 = 0 AS INTEGER)) AS null_rate, count(DISTINCT CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END) / CAST(count(*) FILTER (c_custkey % 4 <> 0) AS DOUBLE) AS unique_rate FROM customer
UNION ALL SELECT 'c_custkey', count(*), 0.0, 1.0 FROM customer""")
def profile_rates(spark, d):
    """A-06, R-07: shares of missing and of distinct values."""
    df = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("seg"), "c_custkey")
    return P.profile(df, sample_size=None).select("column", "total", "null_rate", "unique_rate")


@query("""SELECT * FROM (VALUES ('yes_no', 'boolean', NULL, NULL), ('zero_one', 'integer', NULL, NULL), ('y_n', 'string', NULL, NULL), ('dates', 'date', NULL, 'YYYY-MM-DD'), ('us_dates', 'date', NULL, 'MM/DD/YYYY'), ('dashed', 'date', NULL, 'MM-DD-YYYY'), ('specials', 'string', NULL, NULL), ('floats', 'float', NULL, NULL), ('lists', 'string', '|', NULL), ('none', 'string', NULL, NULL)) AS v("column", inferred_type, delimiter, date_pattern)""")
def profile_types(spark, d):
    """F-23 to F-25, A-07, A-08: types, delimiters and date forms of whole columns."""
    k = F.col("c_custkey")
    either = lambda a, b: F.when(k % 2 == 0, a).otherwise(b)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int"))
    made = {
        "yes_no": either("Yes", "no"),
        "zero_one": either("0", "1"),
        "y_n": either("y", "n"),
        "dates": F.when(k % 10 == 7, "soon").otherwise(F.date_format(day, "yyyy-MM-dd")),
        "us_dates": F.date_format(day, "MM/dd/yyyy"),
        "dashed": F.date_format(day, "MM-dd-yyyy"),
        "specials": either("nan", "-inf"),
        "floats": either("1e3", "nan"),
        "lists": F.when(k % 5 == 0, "a|b").otherwise("a"),
        "none": F.lit(None).cast("string"),
    }
    return P.profile(t(spark, d, "customer").select(*(c.alias(n) for n, c in made.items())), sample_size=None).select("column", "inferred_type", "delimiter", "date_pattern")


@query("SELECT CAST(least(100, count(*)) AS BIGINT) AS total FROM orders")
def profile_sample(spark, d):
    """O-02: the first rows alone are looked at."""
    return P.profile(t(spark, d, "orders"), ["o_orderkey"]).select("total")


# ---- matching -------------------------------------------------------------------------------------------------------
@query("SELECT count(DISTINCT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') THEN c_mktsegment END) / CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS direct, count(DISTINCT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') THEN c_mktsegment END) / CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS prefixed, 0.9 * count(DISTINCT CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE') THEN c_mktsegment END) / count(DISTINCT c_mktsegment) AS abbreviation FROM customer")
def value_overlap(spark, d):
    """A-09, A-13: shares of distinct values in a concept set: as they are, after a prefix, as beginnings."""
    known = ["Building", "Machinery", "Household", "Furniture"]
    rows = t(spark, d, "customer").agg(F.collect_set("c_mktsegment").alias("plain"), F.collect_set(F.concat(F.lit("Seg_"), "c_mktsegment")).alias("coded"), F.collect_set(F.substring("c_mktsegment", 1, 3)).alias("short"))
    share = lambda c, form: matcher.overlap(F.col(c), known)[form].alias(form)
    return rows.select(share("plain", "direct"), share("coded", "prefixed"), share("short", "abbreviation"))


@query("SELECT strategy, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('concept_direct', 1.0), ('concept_prefixed', 1.0), ('concept_abbreviation', 0.9), ('none', 0.0)) AS v(strategy, confidence)")
def value_match(spark, d):
    """R-09: what the share of known values makes of a column."""
    seg = [r[0] for r in t(spark, d, "customer").select("c_mktsegment").distinct().collect()]
    target = matcher.Target("Segment", "S", "p", values=tuple(seg))
    out = []
    for values in (seg, [f"x_{s}" for s in seg], [s[:4] for s in seg], ["other"]):
        m = matcher.by_values({"column": "c", "values": values}, target)
        out.append((m.strategy, float(m.confidence)) if m else ("none", 0.0))
    return spark.createDataFrame(out, ["strategy", "confidence"])


@query("SELECT name, target, CAST(score AS DOUBLE) AS score FROM (VALUES ('first_name', 'FirstName', 0.7), ('nm', 'FullName', 0.45), ('dob', 'Birthdate', 0.6), ('ssn', 'PersonIdentifier', 0.25)) AS v(name, target, score)")
def name_scores(spark, d):
    """R-10: points for names, abbreviations, types and date forms."""
    xsd = "http://www.w3.org/2001/XMLSchema#"
    cases = (("first_name", "FirstName", "string", xsd + "string", None), ("nm", "FullName", "string", xsd + "string", None), ("dob", "Birthdate", "date", xsd + "date", "YYYY-MM-DD"), ("ssn", "PersonIdentifier", "integer", xsd + "date", None))
    out = []
    for column, target, kind, datatype, form in cases:
        m = matcher.by_name({"column": column, "inferred_type": kind, "values": [], "delimiter": None, "date_pattern": form}, matcher.Target(target, "S", "p", datatype))
        out.append((column, target, round(m.confidence, 2)))
    return spark.createDataFrame(out, ["name", "target", "score"])


@query("""SELECT s AS "column", 'n' || min(n) AS target FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT n_nationkey AS n FROM nation) WHERE (n + length(s)) % 7 = 6 GROUP BY 1""")
def best_match_topk(spark, d):
    """O-04: the first best target of each column."""
    pairs = t(spark, d, "customer").select(F.col("c_mktsegment").alias("column")).distinct().join(t(spark, d, "nation").select(F.col("n_nationkey").alias("position")), F.lit(True))
    scores = pairs.select("column", F.concat(F.lit("n"), "position").alias("target"), "position", ((F.col("position") + F.length("column")) % 7).alias("score"))
    return matcher.best_matches(scores).select("column", "target")


@query("SELECT shape, place, CAST(score AS DOUBLE) AS score FROM (VALUES ('line', 1, 1.0), ('when', 2, 0.0)) AS v(shape, place, score)")
def shape_detection(spark, d):
    """A-10, O-03: shapes by the share of their targets that columns are named like."""
    candidates = {"when": [matcher.Target("day", "W", "p")], "line": [matcher.Target("l_orderkey", "L", "p"), matcher.Target("lQuantity", "L", "p")]}
    ranked = matcher.detect(t(spark, d, "lineitem").columns, candidates)
    return spark.createDataFrame([(n, i, float(s)) for i, (n, s) in enumerate(ranked, 1)], "shape string, place int, score double")


@query("SELECT * FROM (VALUES ('flag', 'l_returnflag', 'concept_direct'), ('number', 'number', 'heuristic'), ('size', 'how_big', 'asked')) AS v(target, source, strategy)")
def suggested_mapping(spark, d):
    """J-06, R-08, R-11 to R-14, F-28: three passes over columns and properties, the last one a model's reply."""
    reply = "Here you are:\n```json\n" + json.dumps({"mappings": [{"column": "how_big", "property": "hasPart.size", "confidence": 2, "transform": "int_clean"}, {"column": "made up", "property": "x"}]}) + "\n```"
    df = t(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_returnflag", F.col("l_linenumber").alias("number"), F.lit("9").alias("how_big"))
    ttl = TTL.replace("sh:property t:lineP, t:whenP, t:statusP, t:custP, t:placeP", "sh:property t:lineP")
    config, found = matcher.suggest(df, Shapes(ttl), base_uri="ex:o/", ask=matcher.asking(lambda prompt: reply, ("int_clean",)))
    assert config["id_source"] and matcher.annotated_yaml(config, found, df.columns).count("# ") >= 3
    return spark.createDataFrame([(m.target.name, m.column, m.strategy) for m in found], ["target", "source", "strategy"])


@query("SELECT 5 AS documents, 0 AS unusable")
def mapping_preview(spark, d):
    """R-14: the first documents of a suggestion; none where it cannot be used."""
    df = t(spark, d, "customer")
    return spark.createDataFrame([(len(matcher.preview(df, CUSTOMER, 5)), len(matcher.preview(df, {"properties": {}}, 5)))], "documents int, unusable int")


@query("SELECT * FROM (VALUES ('fenced', 'a,b'), ('bare', '1,c'), ('talk', 'x'), ('broken', 'none')) AS v(reply, found)")
def reply_values(spark, d):
    """F-28: values out of what a model says."""
    replies = {"fenced": '```json\n{"values": ["a", " ", null, "b"]}\n```', "bare": '[1, "c"]', "talk": 'Sure! {"values": ["x"]} Anything else?', "broken": '{"values": ["x"'}
    return spark.createDataFrame([(k, "none" if (v := matcher.values_in(r)) is None else ",".join(v)) for k, r in replies.items()], ["reply", "found"])


# ---- concepts and synthetic rows ------------------------------------------------------------------------------------
ONTOLOGY = """
@prefix t: <http://e.org/t#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix schema: <http://schema.org/> .
t:F a owl:NamedIndividual , t:Status ; skos:notation "Finished" .
t:O a owl:NamedIndividual , t:Status ; rdfs:label "Open" .
t:P a owl:NamedIndividual ; skos:inScheme t:Other ; skos:notation "Pending" .
t:flag schema:rangeIncludes t:Other ; rdfs:label "Flag" ; rdfs:comment "A mark." ; t:maxLength "3" ; t:textFormat "Alphanumeric" .
"""


@query("SELECT * FROM (VALUES ('allowed', 'Finished,Open'), ('class', 'Finished,Open'), ('scheme', 'Pending'), ('label', 'Flag'), ('length', '3'), ('format', 'Alphanumeric'), ('roles', 'concept,structural')) AS v(fact, found)")
def concept_values(spark, d):
    """R-08, R-15, R-19: values of allowed individuals, of a class, of a property's range; a property's facts."""
    c, shapes = concepts.Concepts(concepts.read_turtle(ONTOLOGY)), Shapes(TTL)
    by = {p.path.rsplit("#", 1)[1]: p for s in shapes.shapes.values() for p in s.properties}
    facts = c.metadata("http://e.org/t#flag")
    found = {"allowed": c.values(by["hasStatus"]), "class": c.of_class("http://e.org/t#Status"), "scheme": c.of_class(c.range_of("http://e.org/t#flag")), "label": [facts["label"]], "length": [str(facts["max_length"])], "format": [facts["text_format"]], "roles": [c.role(by["hasStatus"]), c.role(by["hasLine"])]}
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], ["fact", "found"])


SYNTH = {
    "base_uri": "ex:p/", "id_source": "id",
    "properties": {
        "n": {"type": "N", "cardinality": "multiple", "fields": {"first": {"source": "first", "target": "firstName"}, "code": {"source": "code"}, "many": {"source": "many", "multi_value_split": ","}}},
        "b": {"type": "B", "fields": {"day": {"source": "day", "datatype": "xsd:date"}, "n": {"source": "n", "datatype": "xsd:integer"}, "maybe": {"source": "maybe", "optional": True}}},
    },
}


@query("SELECT 20000 AS n, 20000 AS ids, 20000 AS even, 20000 AS days, 20000 AS whole, 20000 AS pooled, true AS some_missing, true AS same")
def synth_rows(spark, d):
    """R-16 to R-18, K-24: seeded rows that keep a mapping's rules: as many segments in all fields, types, pools."""
    rows = synth.generate(spark, parse(SYNTH), 20_000, seed=5, pools={"code": ["A", "B"]})
    again = synth.generate(spark, parse(SYNTH), 20_000, seed=5, pools={"code": ["A", "B"]})
    size = lambda c: F.size(F.split(c, r"\|"))
    count = lambda cond: F.count_if(cond).cast("int")
    return rows.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("id").cast("int").alias("ids"), count((size("first") == size("code")) & (size("first") <= 2)).alias("even"), count(F.try_to_date("day", "yyyy-MM-dd").isNotNull()).alias("days"), count(F.col("n").rlike("^[0-9]+$")).alias("whole"), count(F.forall(F.split("code", r"\|"), lambda x: x.isin("A", "B"))).alias("pooled"), F.avg(F.col("maybe").isNull().cast("int")).between(0.1, 0.2).alias("some_missing")).withColumn("same", F.lit(rows.exceptAll(again).isEmpty()))


@query("SELECT 1000 AS n, 1000 AS known")
def synth_concepts(spark, d):
    """R-18: pools come from the concepts that a shape allows."""
    ttl = TTL.replace('sh:in ( "A" "N" )', "sh:class t:Status")
    spec = parse({"base_uri": "ex:o/", "id_source": "id", "properties": {"hasLine": {"type": "Line", "fields": {"flag": {"source": "flag"}}}}})
    pools = concepts.pools(spec, Shapes(ttl), concepts.Concepts(concepts.read_turtle(ONTOLOGY)))
    rows = synth.generate(spark, spec, 1000, pools=pools)
    return rows.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("flag").isin("Finished", "Open")).cast("int").alias("known"))


@query("SELECT * FROM (VALUES ('Name_of_x', 2, 'a,b')) AS v(file, asked, pool)")
def pool_cache(spark, d):
    """F-30, R-19: a value pool is asked for until it is large enough, then kept in a file."""
    folder, asked = Path(tempfile.mkdtemp(prefix="nestwright-")), []

    def make(name: str, count: int) -> list:
        asked.append(name)
        return ["a", " a "] if len(asked) == 1 else ["a", "b", ""]

    cache = synth.PoolCache(folder)
    name = "http://e.org/t#Name of-x"
    first = cache.get(name, make, count=4)
    assert cache.get(name, make, count=4) == first
    return spark.createDataFrame([(next(folder.iterdir()).stem, len(asked), ",".join(first))], "file string, asked int, pool string")


# ---- shape folders, logs, errors, command line ----------------------------------------------------------------------
def _folder() -> Path:
    top = Path(tempfile.mkdtemp(prefix="nestwright-"))
    for name, spec in (("customer", CUSTOMER), ("order", {**SHAPED, "properties": {k: v for k, v in SHAPED["properties"].items() if k == "hasStatus"}})):
        (top / name).mkdir()
        (top / name / f"{name}_mapping.yaml").write_text(json.dumps(spec))
    (top / "order" / "order_SHACL.ttl").write_text(TTL)
    (top / "order" / "order_context.json").write_text(json.dumps({"@context": {"Order": "http://e.org/t#Order"}}))
    return top


@query("SELECT * FROM (VALUES ('available', 'customer,order'), ('fetched', 'far'), ('type', 'Order'), ('unknown', 'refused'), ('name', 'Order')) AS v(fact, found)")
def shape_registry(spark, d):
    """R-01, R-02, U-03: folders of shapes, and one fetched by address."""
    top = _folder()
    r = Registry(top)
    found = {"available": ",".join(r.available()), "type": r.get("order").spec().type, "name": context_names(r.get("order").context)["http://e.org/t#Order"]}
    found["fetched"] = r.fetch("far", (top / "customer" / "customer_mapping.yaml").as_uri(), cache=top / "cache").name
    try:
        r.get("none")
    except errors.ShapeError:
        found["unknown"] = "refused"
    return spark.createDataFrame(list(found.items()), ["fact", "found"])


@query("SELECT * FROM (VALUES ('***REDACTED***', 'mail ***REDACTED***', 'ok')) AS v(ssn, text, plain)")
def log_scrubbing(spark, d):
    """R-20: personal data never reach a log."""
    got = scrub({"ssn": "1", "text": "mail a@b.org", "plain": "ok"})
    return spark.createDataFrame([(got["ssn"], got["text"], got["plain"])], ["ssn", "text", "plain"])


@query("SELECT * FROM (VALUES (8, true)) AS v(kinds, one_base)")
def error_kinds(spark, d):
    """R-21."""
    kinds = [e for e in vars(errors).values() if isinstance(e, type) and issubclass(e, Exception) and e is not errors.NestwrightError]
    return spark.createDataFrame([(len(kinds), all(issubclass(e, errors.NestwrightError) for e in kinds))], "kinds int, one_base boolean")


def _command(*args: str) -> tuple[int, str]:
    from nestwright.cli import main

    with contextlib.redirect_stdout(io.StringIO()) as out, contextlib.redirect_stderr(io.StringIO()):
        code = main(list(args))
    return code, out.getvalue()


@query("SELECT 'convert' AS command, 0 AS code, count(*) || ' documents' AS says FROM customer UNION ALL SELECT 'validate', 0, 'true ' || count(*) FROM customer UNION ALL SELECT 'bad', 1, 'false ' || count(*) FROM customer")
def command_line_data(spark, d):
    """C-01, C-02: convert, and validate with and without success."""
    top, path = str(_folder()), shared_folder(spark, "cli") + ".parquet"
    spec = Path(top) / "bad.yaml"
    spec.write_text(json.dumps({**CUSTOMER, "id_source": "lacking"}))
    t(spark, d, "customer").write.parquet(path)
    out = []
    code, said = _command("convert", "-s", "customer", "--shapes-dir", top, "-i", path, "-o", f"{top}/out.ndjson")
    out.append(("convert", code, said.split(",")[0]))
    for name, shape in (("validate", "customer"), ("bad", str(spec))):
        code, said = _command("validate", "-s", shape, "--shapes-dir", top, "-i", path, "--report-path", f"{top}/report.json")
        facts = json.loads(said)
        out.append((name, code, f"{str(facts['conforms']).lower()} {facts['total_records']}"))
    return spark.createDataFrame(out, "command string, code int, says string")


@query("SELECT * FROM (VALUES ('shapes', 0, 'customer order'), ('introspect', 0, 'OrderShape'), ('template', 0, 'hasLine'), ('constraints', 1, 'false'), ('benchmark', 0, 'map and build'), ('wizard', 0, 'hasStatus')) AS v(command, code, says)")
def command_line_shapes(spark, d):
    """C-02 to C-07: shapes, templates, SHACL checks, benchmark and wizard."""
    top = _folder()
    ttl, path = str(top / "order" / "order_SHACL.ttl"), shared_folder(spark, "cli") + ".parquet"
    t(spark, d, "orders").where("o_orderkey <> 0").write.parquet(path)
    runs = {
        "shapes": ("list-shapes", "--shapes-dir", str(top)),
        "introspect": ("introspect", "--shacl", ttl),
        "template": ("generate-mapping", "--shacl", ttl, "-o", str(top / "t.yaml")),
        "constraints": ("validate", "-s", "order", "--shapes-dir", str(top), "-i", path, "--shacl"),
        "benchmark": ("benchmark", "-s", "customer", "--shapes-dir", str(top), "-n", "100"),
        "wizard": ("map-wizard", "-i", path, "-s", "order", "--shapes-dir", str(top), "-o", str(top / "w.yaml")),
    }
    out = []
    for name, args in runs.items():
        code, said = _command(*args)
        if name == "shapes":
            said = " ".join(said.split())
        elif name == "introspect":
            said = "OrderShape" if "OrderShape" in said and "hasLine" in said else said
        elif name == "template":
            said = "hasLine" if "hasLine" in (top / "t.yaml").read_text() else "nothing"
        elif name == "constraints":
            said = str(json.loads(said)["conforms"]).lower()
        elif name == "benchmark":
            said = said.split(":")[0]
        elif name == "wizard":
            said = "hasStatus" if "o_orderstatus" in (top / "w.yaml").read_text() else "nothing"
        out.append((name, code, said))
    return spark.createDataFrame(out, "command string, code int, says string")
