"""Registered queries of scalar functions, mapping rules, row checks, shapes and constraints."""

from __future__ import annotations


from pyspark.sql import functions as F

from nestwright.catalog import CHECKED, CUSTOMER, ORDER, doc, query, t
from nestwright.errors import NestwrightError, QualityError
from nestwright.functions import scalars as S
from nestwright.operators import quality as Q
from nestwright.operators.relate import nest_join
from nestwright.operators.shapes import Shapes, context_names
from nestwright.pipeline import Pipeline
from nestwright.plans.compiler import RELATED, compile_mapping
from nestwright.plans.spec import check_base_uri, parse


# ---- scalar functions -----------------------------------------------------------------------------------------------
@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'Field ''x'' in property ''p'' is infinite' ELSE 'none' END AS error, count(*) AS n FROM orders WHERE o_orderkey <> 0 GROUP BY 1")
def scalar_only(spark, d):
    """F-03: infinite numbers are refused, row by row."""
    df = t(spark, d, "orders").where("o_orderkey <> 0").withColumn("x", F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice")))
    c = compile_mapping(parse({"base_uri": "ex:o/", "id_source": "o_orderkey", "properties": {"p": {"type": "P", "fields": {"x": {"source": "x"}}}}}), df.schema)
    return c.select(df, "error").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('array', 'nested value'), ('boolean', 'boolean')) AS v(kind, says)")
def scalar_kinds(spark, d):
    """F-03: nested values and booleans are refused by their type."""
    out = []
    for kind, c in (("array", F.array(F.lit(1))), ("boolean", F.lit(True))):
        df = t(spark, d, "region").select("r_name", c.alias("x"))
        mapped = compile_mapping(parse({"base_uri": "ex:o/", "id_source": "r_name", "properties": {"p": {"type": "P", "fields": {"x": {"source": "x"}}}}}), df.schema)
        error = mapped.select(df, "error").head()[0]
        out.append((kind, next(x for x in ("nested value", "boolean") if x in error)))
    return spark.createDataFrame(out, ["kind", "says"])


def _odd(v: str):
    n = int(v)
    return None if n % 4 == 0 else str(n) if n % 4 == 1 else [n] if n % 4 == 2 else 1 // 0


@query("SELECT CASE n_nationkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'value' WHEN 2 THEN 'returned list' ELSE 'raised ZeroDivisionError' END AS outcome, count(*) AS n FROM nation GROUP BY 1")
def transform_outcomes(spark, d):
    """F-11 to F-13: what a callable returns is checked, and what it raises becomes the row's error."""
    df = t(spark, d, "nation")
    spec = {"base_uri": "ex:n/", "id_source": "n_name", "properties": {"x": {"type": "X", "fields": {"x": {"source": "n_nationkey", "transform": "odd", "optional": True}}}}}
    c = compile_mapping(parse(spec), df.schema, {"odd": _odd})
    rows = c.prepare(df).select(c.error.alias("e"), F.get(c.document.getField("x"), F.lit(0)).getField("x").alias("x"))
    outcome = F.when(F.col("e").isNotNull(), F.regexp_extract("e", "(returned list|raised ZeroDivisionError)", 1)).when(F.col("x").isNotNull(), "value").otherwise("missing")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '%2E%2E%2F' || replace(p_name, ' ', '%20') ELSE 'a.b%2Fc' END AS part FROM part")
def iri_traversal(spark, d):
    """F-14, F-15: values that climb paths lose their dots, others keep them."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("../"), "p_name")).otherwise("a.b/c")
    return t(spark, d, "part").select("p_partkey", S.iri_component(raw).alias("part"))


_URIS = ("ex:a/", "http://e.org/t#", "", "ex:a", "javascript:x/", "data:x/", "file:///x/", "ftp://x/", "http://e.org/ x/", "http://e.org/%2e%2e/x/")


@query("SELECT * FROM (VALUES ('ex:a/', true), ('http://e.org/t#', true), ('', false), ('ex:a', false), ('javascript:x/', false), ('data:x/', false), ('file:///x/', false), ('ftp://x/', false), ('http://e.org/ x/', false), ('http://e.org/%2e%2e/x/', false)) AS v(uri, safe)")
def base_uris(spark, d):
    """F-16."""

    def safe(uri: str) -> bool:
        try:
            check_base_uri(uri)
            return True
        except NestwrightError:
            return False

    return spark.createDataFrame([(u, safe(u)) for u in _URIS], ["uri", "safe"])


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN 'list' ELSE 'text' END AS plain, 'list' AS typed FROM part")
def list_unwrap(spark, d):
    """F-18, F-19: an untyped list of one stands alone, a typed one stays a list."""
    df = t(spark, d, "part")
    fields = {"a": {"source": "p_name", "multi_value_split": " "}, "b": {"source": "p_size", "multi_value_split": " ", "datatype": "xsd:integer"}}
    c = compile_mapping(parse({"base_uri": "ex:p/", "id_source": "p_partkey", "properties": {"w": {"type": "W", "cardinality": "multiple", "fields": fields}}}), df.schema)
    form = lambda path: F.when(F.get_json_object("json", path).startswith("["), "list").otherwise("text")
    return c.select(df, "json", keep=("p_partkey",)).select("p_partkey", form("$.w.a").alias("plain"), form("$.w.b").alias("typed"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name, replace(replace(lower(regexp_extract(url, '[^/]*$')), '_', ''), '-', '') AS plain FROM (SELECT page_id, regexp_replace(url, '[?#./]+.*$', '') AS u, split_part(split_part(split_part(url, '?', 1), '#', 1), '.html', 1) AS url FROM pages)")
def names_of_addresses(spark, d):
    """F-20, F-22."""
    url = F.split_part(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit(".html"), F.lit(1))
    return t(spark, d, "pages").select("page_id", S.local_name(url).alias("name"), S.normal_name(S.local_name(url)).alias("plain"))


@query("SELECT * FROM (VALUES ('http://e.org/t#name', 'fullName'), ('http://e.org/t#age', 'age'), ('urn:x:y', 'z')) AS v(iri, name)")
def names_of_context(spark, d):
    """F-21: prefixes expand, objects give their identifier."""
    names = context_names({"@context": {"t": "http://e.org/t#", "fullName": "t:name", "age": {"@id": "http://e.org/t#age"}, "z": {"@id": "urn:x:y"}}})
    return spark.createDataFrame([(k, v) for k, v in names.items() if v != "t"], ["iri", "name"])


@query(r"""SELECT conv_id, turn, '***REDACTED***' AS ssn, regexp_replace(regexp_replace(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '***REDACTED***', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '***REDACTED***', 'g') AS said FROM conversations""")
def mask_nested(spark, d):
    """F-26: fields by name and texts by pattern, at any depth."""
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.array(F.struct(F.lit("1").alias("ssn"), F.col("text").alias("said"))).alias("x"))
    masked = S.mask_column("x", F.col("x"), rows.schema["x"].dataType)
    return rows.select("conv_id", "turn", masked[0]["ssn"].alias("ssn"), masked[0]["said"].alias("said"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (o_totalprice - 100000) / 200000)) END AS sure FROM orders")
def clamp(spark, d):
    """F-29."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("o_totalprice") - 100000) / 200000)
    return t(spark, d, "orders").select("o_orderkey", S.clamp01(raw).alias("sure"))


@query("SELECT o_orderkey, CAST(try_cast('2023-' || (o_orderkey % 15) || '-' || (o_orderkey % 33) AS DATE) AS VARCHAR) AS day FROM orders")
def date_iso_calendar(spark, d):
    """F-10: months and days that the calendar lacks have no date; others are padded."""
    made = F.concat_ws("-", F.lit("2023"), (F.col("o_orderkey") % 15).cast("string"), (F.col("o_orderkey") % 33).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", S.date_iso(made).alias("day"))


# ---- mapping and documents ------------------------------------------------------------------------------------------
@query("SELECT c_custkey, c_name AS name, 'Sex_' || c_mktsegment AS code, 'Inner' AS kind, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS deep FROM customer")
def nested_properties(spark, d):
    """M-08: properties inside a node, absent where they have no value."""
    df = t(spark, d, "customer").withColumn("even", F.when(F.col("c_custkey") % 2 == 0, "x"))
    inner = {"type": "Inner", "fields": {"code": {"source": "c_mktsegment", "transform": "sex_prefix"}}, "properties": {"deep": {"type": "Deep", "fields": {"e": {"source": "even", "optional": True}}}}}
    spec = {"base_uri": "ex:c/", "id_source": "c_name", "properties": {"outer": {"type": "Outer", "fields": {"name": {"source": "c_name"}}, "properties": {"inner": inner}}}}
    c = compile_mapping(parse(spec), df.schema)
    rows = c.select(df, "document", keep=("c_custkey",)).select("c_custkey", F.get("document.outer", F.lit(0)).alias("o")).select("c_custkey", "o.name", F.get("o.inner", F.lit(0)).alias("i"))
    return rows.select("c_custkey", "name", "i.code", F.col("i.`@type`").alias("kind"), F.coalesce(F.greatest(F.size("i.deep"), F.lit(0)), F.lit(0)).alias("deep"))


@query("SELECT * FROM (VALUES (true, true)) AS v(same, apart)")
def configuration_copies(spark, d):
    """M-11, B-11: a configuration that is read is a copy, and specifications do not change."""
    spec = parse(ORDER)
    mine = spec.config()
    mine["properties"]["hasDate"]["fields"]["day"]["source"] = "other"
    return spark.createDataFrame([(parse(ORDER) == spec, spec.config() != mine and spec.config() == ORDER)], ["same", "apart"])


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 3 = 0) AS without FROM customer")
def nest_join_null_keys(spark, d):
    """J-02, J-05: null and blank keys match nothing, and no primary row is lost."""
    primary = t(spark, d, "customer").withColumn("k", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).otherwise(F.when(F.col("c_custkey") % 2 == 0, " ")))
    tags = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).otherwise(" ").alias("k"), F.lit(1).alias("x"))
    rows = nest_join(primary, "k", {"tags": tags})
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size(f"{RELATED}.tags") == 0).alias("without"))


@query("SELECT * FROM (VALUES ('blank', true), ('none', true)) AS v(key, refused)")
def nest_join_key_checks(spark, d):
    """J-03."""
    out = []
    for name, args in (("blank", (" ", {"a": t(spark, d, "orders")})), ("none", ("c_custkey", {}))):
        try:
            nest_join(t(spark, d, "customer"), *args)
            out.append((name, False))
        except NestwrightError:
            out.append((name, True))
    return spark.createDataFrame(out, ["key", "refused"])


@query("SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(sum(o_totalprice), 0.0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def nest_join_pruned(spark, d):
    """J-01, S-27: satellites keep the columns that a mapping reads."""
    spec = parse({"base_uri": "ex:c/", "id_source": "c_custkey", "properties": {"o": {"type": "O", "source_table": "orders", "fields": {"total": {"source": "o_totalprice"}}}}})
    rows = nest_join(t(spark, d, "customer"), "c_custkey", {"orders": t(spark, d, "orders")}, "o_custkey", columns=spec.satellite_columns())
    assert rows.schema[RELATED].dataType["orders"].dataType.elementType.names == ["o_totalprice"]
    o = F.col(f"{RELATED}.orders")
    return rows.select("c_custkey", F.size(o).alias("n"), F.aggregate(F.array_sort(F.transform(o, lambda r: r["o_totalprice"])), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT 'ex:customer/Customer%23' || substr(c_name, 10) AS id, 'DataCollection' AS kind, 'ex:dc/1' AS iri FROM customer")
def data_collection(spark, d):
    """B-01, B-02, B-08: constant collection nodes in documents."""
    spec = {**CUSTOMER, "data_collection_defaults": {"type": "DataCollection", "value_id": "ex:dc/1"}, "properties": {"hasName": {**CUSTOMER["properties"]["hasName"], "include_data_collection": True}}}
    return doc(spec, t(spark, d, "customer"), kind="document.hasName[0].hasDataCollection.`@type`", iri="document.hasName[0].hasDataCollection.`@id`")


# ---- row checks -----------------------------------------------------------------------------------------------------
def _issues(spark, d, spec: dict, df, allowed=None):
    return Q.issue_table(Q.compile_rules(parse(spec), df.schema, allowed).check(df))


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'None' ELSE CAST(o_orderkey AS VARCHAR) END AS record_id, '@id' AS property_path, 'error' AS severity FROM orders WHERE o_orderkey % 5 = 0")
def validate_id(spark, d):
    """V-02, V-03: a missing identifier."""
    df = t(spark, d, "orders").withColumn("key", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")))
    return _issues(spark, d, {"base_uri": "ex:o/", "id_source": "key"}, df).select("record_id", "property_path", "severity")


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'empty segments at 1' || CASE WHEN p_partkey % 4 = 0 THEN ', 2' ELSE '' END AS message FROM part WHERE p_partkey % 2 = 0")
def validate_segments(spark, d):
    """V-05: blank segments by their places."""
    codes = F.concat(F.lit("a|"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("b"), F.when(F.col("p_partkey") % 4 == 0, "|").otherwise(""))
    df = t(spark, d, "part").select("p_partkey", codes.alias("codes"))
    spec = {"base_uri": "ex:p/", "id_source": "p_partkey", "properties": {"c": {"type": "C", "cardinality": "multiple", "fields": {"x": {"source": "codes"}}}}}
    return _issues(spark, d, spec, df).where("severity = 'warning'").select("record_id", "message")


@query("SELECT CASE o_orderkey % 4 WHEN 1 THEN 'not a date of three numeric parts' WHEN 2 THEN 'date is not zero-padded' ELSE 'not a calendar date' END AS message, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def validate_date(spark, d):
    """V-06: the three ways of not being a date."""
    df = t(spark, d, "orders").withColumn("day", F.element_at(F.lit(["2024-01-02", "2024-01", "2024-1-2", "2024-02-30"]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    spec = {"base_uri": "ex:o/", "id_source": "o_custkey", "properties": {"p": {"type": "P", "fields": {"day": {"source": "day", "datatype": "xsd:date"}}}}}
    return _issues(spark, d, spec, df).where("property_path = 'p.day'").groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'p.at' AS property_path, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'p.size', count(*) FILTER (o_orderkey % 5 = 0) FROM orders")
def validate_time_and_number(spark, d):
    """V-07, V-08."""
    df = t(spark, d, "orders").withColumn("at", F.when(F.col("o_orderkey") % 3 == 0, "2024-01-02").otherwise("2024-01-02T03:04:05")).withColumn("size", F.when(F.col("o_orderkey") % 5 == 0, "12d").otherwise("1.5e3"))
    spec = {"base_uri": "ex:o/", "id_source": "o_custkey", "properties": {"p": {"type": "P", "fields": {"at": {"source": "at", "datatype": "xsd:dateTime"}, "size": {"source": "size", "datatype": "xsd:integer"}}}}}
    return _issues(spark, d, spec, df).where("severity = 'warning'").groupBy("property_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, x AS actual FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part) WHERE x NOT IN ('small', 'red', 'ring')")
def validate_allowed(spark, d):
    """V-01, V-09: each part that is no allowed value."""
    spec = {"base_uri": "ex:p/", "id_source": "p_partkey", "properties": {"w": {"type": "W", "cardinality": "multiple", "split_on": " ", "fields": {"x": {"source": "p_name"}}}}}
    return _issues(spark, d, spec, t(spark, d, "part"), {"w.x": ["small", "red", "ring"]}).where("message = 'value is not allowed'").select("record_id", "actual")


@query("SELECT 'o.i.code' AS property_path, count(*) AS n FROM part WHERE p_partkey % 3 = 0")
def validate_nested(spark, d):
    """V-16: nested properties are checked, too."""
    df = t(spark, d, "part").withColumn("code", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")))
    spec = {"base_uri": "ex:p/", "id_source": "p_partkey", "properties": {"o": {"type": "O", "fields": {"n": {"source": "p_name"}}, "properties": {"i": {"type": "I", "fields": {"code": {"source": "code"}}}}}}}
    return _issues(spark, d, spec, df).where("property_path <> '@id'").groupBy("property_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('p.day', true)) AS v(path, stopped)")
def validate_strict(spark, d):
    """V-11: the first issue of any severity stops, warnings included."""
    df = t(spark, d, "orders").withColumn("day", F.lit("2024-1-2"))
    spec = {"base_uri": "ex:o/", "id_source": "o_custkey", "properties": {"p": {"type": "P", "fields": {"day": {"source": "day", "datatype": "xsd:date"}}}}}
    try:
        Pipeline(df.where("o_custkey > 0"), parse(spec)).validate("strict")
        return spark.createDataFrame([("", False)], ["path", "stopped"])
    except QualityError as e:
        return spark.createDataFrame([(str(e).split(": ")[1], True)], ["path", "stopped"])


@query("SELECT CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS n, true AS same, true AS rows_of_the_table FROM orders")
def sample_size(spark, d):
    """V-13, O-07: an exact number of rows, the same for a seed."""
    rows = t(spark, d, "orders").select("o_orderkey")
    one, two = Q.sample(rows, 0.1, 3), Q.sample(rows, 0.1, 3)
    return one.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(one.exceptAll(two).isEmpty()).alias("same"), F.lit(one.exceptAll(rows).isEmpty()).alias("rows_of_the_table"))


@query("SELECT count(*) FILTER (o_orderkey <> 0 AND month(o_orderdate) >= 10) AS records_out, count(*) FILTER (o_orderkey = 0 OR month(o_orderdate) < 10) AS records_failed FROM orders")
def validate_inline(spark, d):
    """V-21: rows that fail their checks go to the dead letters."""
    df = t(spark, d, "orders").withColumn("day", F.when(F.month("o_orderdate") >= 10, F.date_format("o_orderdate", "yyyy-MM-dd")))
    spec = {"base_uri": "ex:o/", "id_source": "o_orderkey", "properties": {"p": {"type": "P", "fields": {"day": {"source": "day"}}}}}
    return Pipeline(df, parse(spec), validate_mode="report").metrics().select("records_out", "records_failed")


@query("SELECT * FROM (VALUES ('does not conform', true, 4)) AS v(says, listed, counters)")
def check_results(spark, d):
    """V-10, V-12, V-14, V-20: the forms of a result."""
    df = t(spark, d, "orders").withColumn("day", F.lit(None).cast("string")).withColumn("price", F.lit("1"))
    got = Pipeline(df, parse(CHECKED)).validate()
    return spark.createDataFrame([(got.summary().split(":")[0], len(got.to_dict(5)["issues"]) == 5, len(set(got.to_dataframe().columns) & {"conforms", "total_records", "error_count", "warning_count"}))], "says string, listed boolean, counters int")


# ---- shapes ---------------------------------------------------------------------------------------------------------
TTL = """
@prefix t: <http://e.org/t#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
t:OrderShape a sh:NodeShape ; sh:targetClass t:Order ; sh:closed true ; sh:property t:lineP, t:whenP, t:statusP, t:custP, t:placeP .
t:LineShape a sh:NodeShape ; sh:targetClass t:Line ; sh:closed true ; sh:property t:nP, t:flagP, t:partP .
t:PartShape a sh:NodeShape ; sh:targetClass t:Part ; sh:property t:sizeP, t:noteP .
t:WhenShape a sh:NodeShape ; sh:targetClass t:When ; sh:property t:dayP .
t:PlaceShape a sh:NodeShape ; sh:targetClass t:Place ; sh:property t:addressP .
t:AddressShape a sh:NodeShape ; sh:targetClass t:Address ; sh:property t:cityP .
t:lineP sh:path t:hasLine ; sh:node t:LineShape ; sh:minCount 1 ; sh:maxCount 3 .
t:whenP sh:path t:hasWhen ; sh:node t:WhenShape ; sh:class t:When ; sh:nodeKind sh:BlankNode .
t:statusP sh:path t:hasStatus ; sh:in ( t:F t:O ) ; sh:nodeKind sh:IRI .
t:custP sh:path t:hasCustomer ; sh:class t:Customer ; sh:nodeKind sh:IRI .
t:placeP sh:path t:hasPlace ; sh:node t:PlaceShape .
t:nP sh:path t:number ; sh:datatype xsd:integer ; sh:minCount 1 .
t:flagP sh:path t:flag ; sh:in ( "A" "N" ) ; sh:datatype xsd:string .
t:partP sh:path t:hasPart ; sh:node t:PartShape .
t:sizeP sh:path t:size ; sh:datatype xsd:integer ; sh:maxCount 1 .
t:noteP sh:path t:note ; sh:minCount 1 .
t:dayP sh:path t:day ; sh:datatype xsd:date ; sh:minCount 1 .
t:addressP sh:path t:hasAddress ; sh:node t:AddressShape ; sh:class t:Address .
t:cityP sh:path t:city ; sh:minCount 1 ; sh:nodeKind sh:IRI .
"""
SHAPED = {
    "base_uri": "ex:o/", "id_source": "o_orderkey", "type": "Order",
    "properties": {
        "hasLine": {"type": "Line", "source_table": "lines", "fields": {"number": {"source": "l_linenumber", "datatype": "xsd:integer"}, "flag": {"source": "l_returnflag"}, "extra": {"source": "extra", "optional": True}},
                    "properties": {}},
        "hasWhen": {"type": "When", "fields": {"day": {"source": "day", "datatype": "xsd:date", "optional": True}}},
        "hasStatus": {"type": "named_individual", "fields": {"s": {"source": "o_orderstatus"}}},
        "hasCustomer": {"type": "iri_ref", "fields": {"@id": {"source": "cust"}}},
        "hasPlace": {"type": "Place", "wrapper_field": "hasAddress", "inner_type": "Address", "fields": {"city": {"source": "city"}}},
    },
}


def _shaped(spark, d):
    df = t(spark, d, "orders").where("o_orderkey <> 0").withColumn("day", F.when(F.col("o_orderkey") % 4 == 0, "2024-1-2").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    df = df.withColumn("cust", F.concat(F.lit("ex:c/"), "o_custkey")).withColumn("city", F.lit("Alma"))
    lines = t(spark, d, "lineitem").withColumn("extra", F.when(F.col("l_linenumber") == 2, "x"))
    spec = parse(SHAPED)
    rows = nest_join(df, "o_orderkey", {"lines": lines}, "l_orderkey", {"lines": ["l_linenumber", "l_partkey"]}, spec.satellite_columns())
    return Pipeline(rows, spec, shapes=Shapes(TTL))


def _violations(spark, d, like: str):
    return _shaped(spark, d).validate(shacl=True).issues.where(F.col("message").like(like))


@query("SELECT CASE WHEN n < 1 THEN 'too few values' ELSE 'too many values' END AS message, 'hasLine' AS property_path, count(*) AS n FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey <> 0 GROUP BY 1) WHERE n < 1 OR n > 3 GROUP BY 1")
def shacl_counts(spark, d):
    """V-17, V-19: sh:minCount and sh:maxCount of nodes."""
    return _violations(spark, d, "too%").where("property_path = 'hasLine'").groupBy("message", "property_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hasLine.flag' AS property_path, l_returnflag AS actual, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey <> 0 AND l_returnflag NOT IN ('A', 'N') GROUP BY 2 UNION ALL SELECT 'hasStatus', o_orderstatus, count(*) FROM orders WHERE o_orderkey <> 0 AND o_orderstatus NOT IN ('F', 'O') GROUP BY 2")
def shacl_allowed(spark, d):
    """V-17, V-22: sh:in of fields and of concepts."""
    return _violations(spark, d, "value is not allowed").groupBy("property_path", "actual").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hasLine.extra' AS property_path, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey <> 0 AND l_linenumber = 2")
def shacl_closed(spark, d):
    """V-17, V-22: sh:closed."""
    return _violations(spark, d, "the shape is closed").groupBy("property_path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hasWhen.day' AS property_path, 'not a literal of its datatype' AS message, count(*) AS n FROM orders WHERE o_orderkey <> 0 AND o_orderkey % 4 = 0")
def shacl_datatype(spark, d):
    """V-17, V-22: sh:datatype, by its name and by the literal's form."""
    return _violations(spark, d, "%datatype%").groupBy("property_path", "message").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hasPlace.hasAddress.city' AS property_path, 'error' AS severity, 'node kind differs' AS message, count(*) AS n FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 'hasCustomer', 'warning', 'the class of a reference is not known', count(*) FROM orders WHERE o_orderkey <> 0")
def shacl_kinds_and_classes(spark, d):
    """V-17, V-22: sh:nodeKind inside a wrapper, and sh:class of references, which documents do not tell."""
    found = _shaped(spark, d).validate(shacl=True).issues.where("message = 'node kind differs' or message like 'the class%'")
    return found.groupBy("property_path", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'hasOuter.hasPart.note' AS property_path, 'too few values' AS message, count(*) AS n FROM part UNION ALL SELECT 'hasOuter.hasPart', 'class differs', count(*) FROM part UNION ALL SELECT 'hasOuter.hasPart.size', 'datatype differs', count(*) FROM part")
def shacl_deep(spark, d):
    """V-17: two levels down: a required field that no mapping fills, another class, another datatype."""
    shapes = Shapes("""
@prefix t: <http://e.org/t#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
t:TopShape a sh:NodeShape ; sh:targetClass t:Top ; sh:property t:outerP .
t:OuterShape a sh:NodeShape ; sh:targetClass t:Outer ; sh:property t:partP .
t:PartShape a sh:NodeShape ; sh:targetClass t:Part ; sh:property t:sizeP, t:noteP .
t:outerP sh:path t:hasOuter ; sh:node t:OuterShape .
t:partP sh:path t:hasPart ; sh:node t:PartShape ; sh:class t:Part .
t:sizeP sh:path t:size ; sh:datatype xsd:integer .
t:noteP sh:path t:note ; sh:minCount 1 .
""")
    inner = {"type": "Piece", "fields": {"size": {"source": "p_size", "datatype": "xsd:decimal"}}}
    spec = {"base_uri": "ex:p/", "id_source": "p_name", "type": "Top", "properties": {"hasOuter": {"type": "Outer", "fields": {}, "properties": {"hasPart": inner}}}}
    found = Pipeline(t(spark, d, "part"), parse(spec), shapes=shapes).validate(shacl=True).issues
    return found.groupBy("property_path", "message").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (o_orderkey <> 0) AS total_records, false AS conforms FROM orders")
def shacl_summary(spark, d):
    """V-18, V-19: source rows are counted once, in both phases."""
    return _shaped(spark, d).validate(shacl=True).table.select("total_records", "conforms")


@query("SELECT * FROM (VALUES ('Order', 'hasStatus', 'F,O'), ('Line', 'flag', 'A,N')) AS v(shape, property, allowed)")
def shape_facts(spark, d):
    """V-15, R-03, R-04, O-05, O-06: shapes as they were read."""
    shapes, out = Shapes(TTL), []
    assert shapes.root().local == "OrderShape" and [p.path for p in shapes.root().properties] == sorted(p.path for p in shapes.root().properties)
    assert shapes.allowed_values() == {"hasLine.flag": ["A", "N"]}
    for s in shapes.shapes.values():
        out += [(s.local.removesuffix("Shape"), p.path.rsplit("#", 1)[1], ",".join(v.rsplit("#", 1)[-1] for v in p.allowed)) for p in s.properties if p.allowed]
    return spark.createDataFrame(out, ["shape", "property", "allowed"])


@query("SELECT * FROM (VALUES ('error', 'hasLine.number'), ('error', 'hasWhen'), ('warning', 'hasCustomer'), ('warning', 'hasStatus'), ('warning', 'odd')) AS v(severity, property)")
def mapping_against_shape(spark, d):
    """J-07, R-06: what a mapping and a shape do not share."""
    spec = parse({"id_source": "x", "base_uri": "ex:x/", "properties": {"hasLine": {"type": "Line", "fields": {"flag": {"source": "f"}}}, "hasWhen": {"type": "Then", "fields": {"day": {"source": "x", "datatype": "xsd:date"}}}, "odd": {"type": "Odd", "fields": {"x": {"source": "x"}}}, "hasPlace": {"type": "Place", "fields": {}}}})
    return spark.createDataFrame(sorted({(x["severity"], x["property"]) for x in Shapes(TTL).reconcile(spec)}), ["severity", "property"])


@query("SELECT * FROM (VALUES ('hasLine', 'multiple', '|', 'flag,number'), ('hasPlace', 'multiple', '|', ''), ('hasWhen', 'multiple', '|', 'day')) AS v(property, cardinality, split_on, fields)")
def shape_template(spark, d):
    """R-05: a mapping to fill in."""
    props = Shapes(TTL).template(base_uri="ex:o/")["properties"]
    return spark.createDataFrame([(n, p["cardinality"], p.get("split_on", ""), ",".join(sorted(p["fields"]))) for n, p in props.items()], ["property", "cardinality", "split_on", "fields"])


