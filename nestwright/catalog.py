"""Registered queries over the driver's tables, and the same results as DuckDB SQL.

Each query exercises named operators of the engine on whole tables; values are flat scalars so that results compare
across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwright.functions import scalars as S
from nestwright.operators import profile as P
from nestwright.operators import quality as Q
from nestwright.operators.relate import nest_join
from nestwright.pipeline import Pipeline
from nestwright.plans.compiler import RELATED, compile_mapping
from nestwright.plans.spec import compose, parse, with_overrides
from nestwright.sinks import docstore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc(spec: dict, df: DataFrame, *fields: str, **columns) -> DataFrame:
    """Flat columns out of the documents of a mapping."""
    good = Pipeline(df, parse(spec)).documents()
    return good.select(F.col("id"), *(F.expr(v).alias(k) for k, v in columns.items()))


CUSTOMER = {
    "base_uri": "ex:customer/", "id_source": "c_name", "type": "Customer",
    "properties": {
        "hasName": {"type": "Name", "include_record_status": True, "fields": {"name": {"source": "c_name"}, "segment": {"source": "c_mktsegment", "transform": "sex_prefix"}, "nick": {"source": "c_nickname", "optional": True}}},
        "hasBalance": {"type": "Balance", "fields": {"amount": {"source": "c_acctbal", "datatype": "xsd:decimal"}}},
    },
    "record_status_defaults": {"type": "RecordStatus", "start": {"value": "1900-01-01T00:00:00", "datatype": "xsd:dateTime"}, "by": {"value_id": "ex:org/1"}},
}
ORDER = {
    "base_uri": "ex:order/", "id_source": "o_orderkey", "type": "Order",
    "properties": {"hasDate": {"type": "Day", "fields": {"day": {"source": "o_orderdate", "transform": "date_format", "datatype": "xsd:date"}}}, "hasPriority": {"type": "Priority", "fields": {"priority": {"source": "o_orderpriority"}}}},
}


@query("""WITH o AS (
  SELECT o_custkey, count(*) AS n, string_agg('{"@type":"Order","key":"' || o_orderkey || '","total":{"@type":"xsd:decimal","@value":"' || o_totalprice || '"},"priority":"' || o_orderpriority || '"}', ',' ORDER BY o_orderkey) AS orders
  FROM orders GROUP BY 1
)
SELECT 'ex:customer/Customer%23' || substr(c_name, 10) AS id,
  '{"@context":"","@id":"ex:customer/Customer%23' || substr(c_name, 10) || '","@type":"Customer","hasName":{"@type":"Name","name":"' || c_name || '","segment":"Sex_' || c_mktsegment
  || '","hasRecordStatus":{"@type":"RecordStatus","start":{"@type":"xsd:dateTime","@value":"1900-01-01T00:00:00"},"by":{"@id":"ex:org/1"}}},"hasBalance":{"@type":"Balance","amount":{"@type":"xsd:decimal","@value":"' || c_acctbal || '"}}'
  || CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN ',"hasOrder":' || orders ELSE ',"hasOrder":[' || orders || ']' END || '}' AS json
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def flagship_customer_documents(spark, d):
    """Customers with their orders as nested JSON documents: B-01, B-02, B-09, J-01, M-01, M-03 to M-07."""
    spec = {**CUSTOMER, "properties": {**CUSTOMER["properties"], "hasOrder": {"type": "Order", "source_table": "orders", "fields": {"key": {"source": "o_orderkey"}, "total": {"source": "o_totalprice", "datatype": "xsd:decimal"}, "priority": {"source": "o_orderpriority"}}}}}
    rows = nest_join(t(spark, d, "customer"), "c_custkey", {"orders": t(spark, d, "orders")}, "o_custkey", {"orders": ["o_orderkey"]}, parse(spec).satellite_columns())
    return compile_mapping(parse(spec), rows.schema).select(rows, "id", "json")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_parquet_project(spark, d):
    return t(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT 'orders' AS tbl, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'documents', count(*) FROM documents")
def scan_count(spark, d):
    out = None
    for name in ("orders", "lineitem", "customer", "documents"):
        one = t(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'ex:order/' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, 'xsd:date' AS kind, o_orderpriority AS priority FROM orders WHERE o_orderkey <> 0")
def doc_id_prefix(spark, d):
    """M-02, M-04, F-10, F-17, F-18: identifier, single node, typed literal."""
    return doc(ORDER, t(spark, d, "orders"), day="document.hasDate[0].day.`@value`", kind="document.hasDate[0].day.`@type`", priority="document.hasPriority[0].priority")


@query("SELECT 'ex:part/' || replace(p_brand, '#', '%23') || '%20' || p_partkey AS id FROM part")
def doc_id_iri_encode(spark, d):
    """F-14: percent-encoding of identifiers."""
    df = t(spark, d, "part").withColumn("key", F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string")))
    return doc({"base_uri": "ex:part/", "id_source": "key", "type": "Part"}, df)


@query("SELECT count(*) AS records_in, count(*) FILTER (o_orderkey <> 0) AS records_out, count(*) FILTER (o_orderkey = 0) AS records_failed FROM orders")
def doc_id_falsy_rejected(spark, d):
    """M-02, M-12, A-03: a numeric zero is no identifier."""
    return Pipeline(t(spark, d, "orders"), parse(ORDER)).metrics()


@query("SELECT trim(url) AS id FROM pages")
def id_is_uri(spark, d):
    return doc({"id_source": "url", "id_is_uri": True, "type": "Page"}, t(spark, d, "pages"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity FROM lineitem")
def int_clean_double(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.int_clean(F.col("l_quantity").cast("string")).alias("quantity"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_iso_from_ts(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.date_iso(F.col("o_orderdate").cast("string")).alias("day"))


@query("SELECT c_custkey, 'Sex_' || c_mktsegment AS segment FROM customer")
def prefix_code(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.prefixed("Sex_")(F.col("c_mktsegment")).alias("segment"))


@query("SELECT o_orderkey, 'RaceAndEthnicity_' || replace(o_orderpriority, ' ', '') AS priority FROM orders")
def prefix_code_nospace(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.prefixed("RaceAndEthnicity_", True)(F.col("o_orderpriority")).alias("priority"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first FROM part")
def first_segment(spark, d):
    return t(spark, d, "part").select("p_partkey", S.first_segment(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("first"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]|[\x{80}-\x{9F}]', '', 'g')) AS n FROM documents")
def strip_control(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(S.strip_control(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '***REDACTED***', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '***REDACTED***', 'g')) AS digest FROM documents""")
def mask_pii(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(S.mask_text(F.col("text")), 256).alias("digest"))


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM part")
def csv_formula_guard(spark, d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", S.formula_guard(cell).alias("cell"))


@query("SELECT 'ex:customer/Customer%23' || substr(c_name, 10) AS id, c_name AS name, 'Sex_' || c_mktsegment AS segment, 'Name' AS kind, 'xsd:decimal' AS amount_kind FROM customer")
def single_node(spark, d):
    """M-04, B-05: fields of typed sub-nodes; the optional column is missing and left out."""
    return doc(CUSTOMER, t(spark, d, "customer"), name="document.hasName[0].name", segment="document.hasName[0].segment", kind="document.hasName[0].`@type`", amount_kind="document.hasBalance[0].amount.`@type`")


@query("SELECT 'ex:doc/' || d.doc_id AS id, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id <> 0")
def optional_omitted(spark, d):
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return doc({"base_uri": "ex:doc/", "id_source": "doc_id", "properties": {"label": {"type": "L", "fields": {"quality": {"source": "quality", "optional": True}}}}}, rows, quality="get(document.label, 0).quality")


@query("SELECT count(*) AS records_in, count(l.quality) FILTER (d.doc_id <> 0) AS records_out, count(*) - count(l.quality) FILTER (d.doc_id <> 0) AS records_failed FROM documents d LEFT JOIN labels l USING (doc_id)")
def required_reject(spark, d):
    """M-12: rows without a required value fail."""
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return Pipeline(rows, parse({"base_uri": "ex:doc/", "id_source": "doc_id", "properties": {"label": {"type": "L", "fields": {"quality": {"source": "quality"}}}}})).metrics()


@query("SELECT 'ID source field ''doc_id'' is zero, which is no identifier' AS error, count(*) FILTER (d.doc_id = 0) AS n FROM documents d UNION ALL SELECT 'Required field ''quality'' is missing or empty for property ''label''', count(*) FILTER (l.quality IS NULL AND d.doc_id <> 0) FROM documents d LEFT JOIN labels l USING (doc_id)")
def dead_letter_count(spark, d):
    """K-11: rejected rows by their first error."""
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    p = Pipeline(rows, parse({"base_uri": "ex:doc/", "id_source": "doc_id", "properties": {"label": {"type": "L", "fields": {"quality": {"source": "quality"}}}}}))
    return p.rejected().groupBy(F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


ZIP = {"base_uri": "ex:part/", "id_source": "p_brand", "properties": {"word": {"type": "W", "cardinality": "multiple", "split_on": " ", "fields": {"a": {"source": "p_name"}, "b": {"source": "p_type", "optional": True}}}}}


@query("SELECT p_partkey, i - 1 AS pos, string_split(p_name, ' ')[i] AS a, string_split(p_type, ' ')[i] AS b FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS u(i)")
def zip_explode(spark, d):
    """M-05: positional zip of two delimited columns of uneven lengths; missing segments are null."""
    df = t(spark, d, "part")
    c = compile_mapping(parse(ZIP), df.schema)
    rows = c.select(df, "document", keep=("p_partkey",))
    return rows.select("p_partkey", F.posexplode("document.word").alias("pos", "w")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "w.a", "w.b")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS n, NULLIF(c_mktsegment, '') AS last FROM customer")
def zip_explode_ragged(spark, d):
    """M-05: blank segments of the first column make no instance."""
    df = t(spark, d, "customer").withColumn("codes", F.concat(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise("x"), F.lit("|"), "c_mktsegment"))
    c = compile_mapping(parse({"base_uri": "ex:c/", "id_source": "c_name", "properties": {"p": {"type": "P", "cardinality": "multiple", "fields": {"a": {"source": "codes"}}}}}), df.schema)
    rows = c.select(df, "document", keep=("c_custkey",))
    return rows.select("c_custkey", F.size("document.p").alias("n"), F.element_at("document.p", -1)["a"].alias("last"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS INTEGER) AS n FROM documents WHERE doc_id <> 0")
def blank_segment_skip(spark, d):
    """M-05: lines of a text as instances."""
    df = t(spark, d, "documents").where("doc_id <> 0").select("doc_id", "text")
    c = compile_mapping(parse({"base_uri": "ex:d/", "id_source": "doc_id", "properties": {"line": {"type": "L", "cardinality": "multiple", "split_on": "\n", "fields": {"x": {"source": "text"}}}}}), df.schema)
    return c.select(df, "document", keep=("doc_id",)).select("doc_id", F.size("document.line").alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: 'Sex_' || x), '|') AS codes FROM part")
def sub_array_split(spark, d):
    """M-06: sub-values inside a segment, each transformed."""
    df = t(spark, d, "part")
    c = compile_mapping(parse({"base_uri": "ex:p/", "id_source": "p_brand", "properties": {"w": {"type": "W", "cardinality": "multiple", "fields": {"codes": {"source": "p_name", "transform": "sex_prefix", "multi_value_split": " "}}}}}), df.schema)
    return c.select(df, "document", keep=("p_partkey",)).select("p_partkey", F.array_join(F.get("document.w", F.lit(0))["codes"], "|").alias("codes"))


@query("SELECT 'ex:n/' || n_name AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def concept_flatten(spark, d):
    """B-03: a concept is a bare text."""
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return doc({"base_uri": "ex:n/", "id_source": "n_name", "properties": {"region": {"type": "named_individual", "fields": {"r": {"source": "r_name"}}}}}, rows, region="document.region[0]")


@query("SELECT l_orderkey, l_linenumber, 'ex:order/' || l_orderkey AS ref FROM lineitem")
def iri_ref(spark, d):
    """B-04: a reference node holds an identifier alone."""
    df = t(spark, d, "lineitem").withColumn("ref", F.concat(F.lit("ex:order/"), "l_orderkey")).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    c = compile_mapping(parse({"base_uri": "ex:l/", "id_source": "key", "properties": {"order": {"type": "iri_ref", "fields": {"@id": {"source": "ref"}}}}}), df.schema)
    return c.select(df, "document", keep=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", F.get("document.order", F.lit(0))["@id"].alias("ref"))


@query("SELECT 'ex:s/Supplier%23' || substr(s_name, 10) AS id, 'Location' AS outer_type, 'Address' AS inner_type, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def wrapper_node(spark, d):
    """B-06: two-level nodes."""
    spec = {"base_uri": "ex:s/", "id_source": "s_name", "properties": {"hasLocation": {"type": "Location", "wrapper_field": "hasAddress", "inner_type": "Address", "fields": {"nation": {"source": "s_nationkey"}}}}}
    return doc(spec, t(spark, d, "supplier"), outer_type="document.hasLocation[0].`@type`", inner_type="document.hasLocation[0].hasAddress.`@type`", nation="document.hasLocation[0].hasAddress.nation")


@query("SELECT '1900-01-01T00:00:00' AS start_value, 'ex:org/1' AS by_id, 'RecordStatus' AS kind, count(*) AS n FROM customer")
def constant_injection(spark, d):
    """B-07: constant status nodes."""
    rows = doc(CUSTOMER, t(spark, d, "customer"), start_value="document.hasName[0].hasRecordStatus.start.`@value`", by_id="document.hasName[0].hasRecordStatus.by.`@id`", kind="document.hasName[0].hasRecordStatus.`@type`")
    return rows.groupBy("start_value", "by_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _nested(spark, d):
    return nest_join(t(spark, d, "customer"), "c_custkey", {"orders": t(spark, d, "orders")}, "o_custkey", {"orders": ["o_orderkey"]}, {"orders": ["o_orderkey"]})


@query("SELECT CASE WHEN n = 0 THEN 'absent' WHEN n = 1 THEN 'object' ELSE 'list' END AS form, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def arity_collapse(spark, d):
    """B-09: none, one, many in the JSON text."""
    rows = _nested(spark, d)
    spec = {"base_uri": "ex:c/", "id_source": "c_name", "properties": {"o": {"type": "O", "source_table": "orders", "fields": {"k": {"source": "o_orderkey"}}}}}
    text = compile_mapping(parse(spec), rows.schema).select(rows, "json")
    v = F.get_json_object("json", "$.o")
    return text.select(F.when(v.isNull(), "absent").when(v.startswith("["), "list").otherwise("object").alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT p_partkey, 'Thing,Part' AS types FROM part")
def multi_type(spark, d):
    """B-10: a list of types stays a list."""
    df = t(spark, d, "part")
    c = compile_mapping(parse({"base_uri": "ex:p/", "id_source": "p_brand", "type": ["Thing", "Part"]}), df.schema)
    return c.select(df, "document", keep=("p_partkey",)).select("p_partkey", F.array_join("document.@type", ",").alias("types"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def nest_join_orders(spark, d):
    """J-01, A-01."""
    o = F.col(f"{RELATED}.orders")
    return _nested(spark, d).select("c_custkey", F.size(o).alias("n"), F.array_join(F.transform(o, lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


@query("SELECT o_orderkey, (SELECT CAST(count(*) AS INTEGER) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT CAST(count(*) AS INTEGER) FROM customer WHERE c_custkey = o_custkey) AS customers FROM orders")
def nest_join_two_satellites(spark, d):
    rows = nest_join(t(spark, d, "orders").withColumn("c_key", F.col("o_custkey")), "o_orderkey", {"lines": t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")}, "l_orderkey", {"lines": ["l_linenumber"]})
    rows = rows.select("o_orderkey", "c_key", F.size(f"{RELATED}.lines").alias("lines"))
    both = nest_join(rows, "c_key", {"customers": t(spark, d, "customer").select("c_custkey")}, "c_custkey")
    return both.select("o_orderkey", "lines", F.size(f"{RELATED}.customers").alias("customers"))


@query("SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def nest_join_no_match(spark, d):
    return _nested(spark, d).where(F.size(f"{RELATED}.orders") == 0).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, CAST(count(*) FILTER (l.toxic = 1) AS INTEGER) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id")
def satellite_required_skip(spark, d):
    """M-07: satellite rows without a required value make no instance."""
    labels = t(spark, d, "labels").withColumn("flag", F.when(F.col("toxic") == 1, "toxic"))
    rows = nest_join(t(spark, d, "documents").select("doc_id"), "doc_id", {"labels": labels})
    c = compile_mapping(parse({"base_uri": "ex:d/", "id_source": "doc_id", "properties": {"l": {"type": "L", "source_table": "labels", "fields": {"flag": {"source": "flag"}}}}}), rows.schema)
    return c.select(rows, "document", keep=("doc_id",)).select("doc_id", F.size("document.l").alias("n"))


@query("SELECT 'ex:order/' || o_orderkey AS id, o_orderstatus AS priority FROM orders WHERE o_orderkey <> 0")
def override_source(spark, d):
    """M-09."""
    df = t(spark, d, "orders")
    good = Pipeline(df, with_overrides(parse(ORDER), {"hasPriority": {"priority": "o_orderstatus"}})).documents()
    return good.select("id", F.expr("document.hasPriority[0].priority").alias("priority"))


@query("SELECT 'ex:o2/' || o_orderkey AS id, 'Sex_' || o_orderpriority AS priority FROM orders WHERE o_orderkey <> 0")
def compose_overlay(spark, d):
    """M-10."""
    spec = compose(ORDER, {"base_uri": "ex:o2/", "properties": {"hasPriority": {"fields": {"priority": {"transform": "sex_prefix"}}}}})
    return doc(spec, t(spark, d, "orders"), priority="document.hasPriority[0].priority")


CHECKED = {"base_uri": "ex:o/", "id_source": "o_orderkey", "properties": {"p": {"type": "P", "fields": {"priority": {"source": "o_orderpriority"}, "day": {"source": "day", "datatype": "xsd:date"}, "price": {"source": "price", "datatype": "xsd:integer"}}}}}


def _checked(spark, d):
    df = t(spark, d, "orders").withColumn("day", F.concat_ws("-", F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "M"), F.date_format("o_orderdate", "dd"))).withColumn("price", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")))
    df = df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, " ").otherwise(F.col("o_orderpriority")))
    return Q.compile_rules(parse(CHECKED), df.schema, {"p.priority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}).check(df)


@query("""SELECT 'p.priority' AS property_path, 'error' AS severity, count(*) FILTER (o_orderkey % 11 = 0) AS n FROM orders
UNION ALL SELECT 'p.day', 'warning', count(*) FILTER (month(o_orderdate) < 10) FROM orders
UNION ALL SELECT 'p.price', 'warning', count(*) FILTER (o_orderkey % 7 = 0) FROM orders
UNION ALL SELECT 'p.priority', 'warning', count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM orders""")
def validate_rules(spark, d):
    """V-04, V-06, V-08, V-09: issues by path and severity."""
    return Q.issue_table(_checked(spark, d)).groupBy("property_path", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS total_records, count(*) FILTER (o_orderkey % 11 = 0) AS error_count,
count(*) FILTER (month(o_orderdate) < 10) + count(*) FILTER (o_orderkey % 7 = 0) + count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS warning_count,
count(*) FILTER (o_orderkey % 11 = 0) AS failed_records, count(*) FILTER (o_orderkey % 11 = 0) = 0 AS conforms FROM orders""")
def validate_summary(spark, d):
    """A-05, V-20."""
    return Q.summary(_checked(spark, d))


@query("SELECT CAST(user_id AS VARCHAR) AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    """A-02."""
    return Q.duplicate_ids(t(spark, d, "events").select(F.col("user_id").cast("string").alias("id")))


@query("SELECT count(*) AS records_in, count(*) FILTER (event_id <> 0) AS records_out, count(*) FILTER (event_id = 0) AS records_failed FROM events")
def run_metrics(spark, d):
    """A-03."""
    return Pipeline(t(spark, d, "events"), parse({"base_uri": "ex:e/", "id_source": "event_id", "properties": {"k": {"type": "K", "fields": {"type": {"source": "event_type"}}}}})).metrics()


@query("""SELECT 'c_mktsegment' AS "column", 'string' AS inferred_type, count(DISTINCT c_mktsegment) AS distinct_count, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS vals FROM customer
UNION ALL SELECT 'c_nationkey', 'integer', count(DISTINCT c_nationkey), CASE WHEN count(DISTINCT c_nationkey) <= 20 THEN array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))), '|') ELSE '' END FROM customer
UNION ALL SELECT 'c_acctbal', 'float', count(DISTINCT c_acctbal), '' FROM customer""")
def profile_columns(spark, d):
    """A-06 to A-08, F-23, F-24."""
    out = P.profile(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey", "c_acctbal"], sample_size=None)
    return out.select("column", "inferred_type", "distinct_count", F.array_join("values", "|").alias("vals"))


@query("SELECT CASE WHEN avg(CAST(contains(text, '|') AS INTEGER)) > 0.1 THEN '|' WHEN avg(CAST(contains(text, ',') AS INTEGER)) > 0.1 THEN ',' END AS delimiter FROM documents")
def delimiter_detect(spark, d):
    """F-24."""
    return P.profile(t(spark, d, "documents"), ["text"], sample_size=None).select("delimiter")


@query("SELECT page_id, replace(url, '/', '|') AS id, 'Page' AS pk FROM pages")
def docstore_prepare(spark, d):
    """K-15, K-16."""
    rows = t(spark, d, "pages").select("page_id", F.col("url").alias("@id"), F.lit("Page").alias("@type"))
    return docstore.prepare(rows).select("page_id", "id", F.col("partitionKey").alias("pk"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def flatten_nested(spark, d):
    """S-24: nested records as flat columns."""
    from nestwright.sources.rest import flatten

    rows = t(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(rows)


@query("SELECT n_nationkey, 'nation_' || lower(substr(n_name, 8)) AS x FROM nation")
def custom_transform(spark, d):
    """F-11, U-01: a Python callable as a transform, in Arrow batches."""
    df = t(spark, d, "nation")
    spec = {"base_uri": "ex:n/", "id_source": "n_name", "properties": {"x": {"type": "X", "fields": {"x": {"source": "n_name", "transform": "low"}}}}}
    c = compile_mapping(parse(spec), df.schema, {"low": str.lower})
    return c.select(df, "document", keep=("n_nationkey",)).select("n_nationkey", F.get("document.x", F.lit(0))["x"].alias("x"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id <> 0 GROUP BY event_type")
def stream_available_now(spark, d):
    """T-01: the same mapping on a file stream, run to its end."""
    from nestwright.shared import shared_folder

    path = shared_folder(spark, "stream")
    source = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    p = Pipeline(source, parse({"base_uri": "ex:e/", "id_source": "event_id", "properties": {"k": {"type": "K", "fields": {"type": {"source": "event_type"}}}}}))
    kinds = p.documents().select(F.get("document.k", F.lit(0))["type"].alias("event_type"))
    kinds.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _complete() -> None:
    """The queries of the other modules register themselves when they are imported."""
    from nestwright import catalog_checks, catalog_io, catalog_meta  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _complete()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _complete()
    return dict(ORACLES)
