"""Registered queries of sources and sinks: each writes or serves rows of the tables, reads them back and returns them.

Files go to the folder that executors share. Services are played by a small HTTP server of the driver.
"""

from __future__ import annotations

import http.server
import json
import shutil
import tempfile
import threading
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterable
from contextlib import ExitStack
from functools import cache
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from nestwright.catalog import CUSTOMER, ORDER, query, t
from nestwright.errors import MappingError, SinkError, SourceError
from nestwright.pipeline import Pipeline
from nestwright.plans.spec import parse
from nestwright.shared import shared_folder
from nestwright.sinks import docstore, files, serial
from nestwright.sources import files as sources
from nestwright.sources import services
from nestwright.sources.rest import flatten, read_rest


def _local(name: str) -> Path:
    """A folder of the driver alone, for single files."""
    return Path(tempfile.mkdtemp(prefix="nestwright-")) / name


def _facts(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


# ---- files ----------------------------------------------------------------------------------------------------------
@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || ',\"' || chr(10) || 'x' END AS segment, c_name AS name FROM customer")
def csv_round_trip(spark, d):
    """S-02, S-28, S-29: quoted separators, quotes and line breaks; missing cells."""
    path = shared_folder(spark, "csv") + ".csv"
    segment = F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.concat("c_mktsegment", F.lit(',"\nx')))
    t(spark, d, "customer").select("c_custkey", segment.alias("segment"), F.col("c_name").alias("name")).write.options(header=True, escape='"').csv(path)
    return sources.source_for(spark, path)


@query("SELECT count(*) AS n FROM customer")
def csv_count(spark, d):
    """S-04: records, whatever line breaks they hold."""
    path = shared_folder(spark, "csv")
    t(spark, d, "customer").select(F.concat("c_name", F.lit("\n\n")).alias("name")).write.options(header=True, escape='"').csv(path)
    return _facts(spark, n=sources.source(sources.read_csv, path).count(spark))


@query("SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS batches, count(*) - 7 * (CAST(ceil(count(*) / 7.0) AS BIGINT) - 1) AS last FROM nation")
def batches_keep_the_last(spark, d):
    """S-01, S-03, S-06: batches of rows, the last one shorter."""
    sizes = [len(b) for b in sources.source(sources.read_parquet, f"{d}/nation.parquet").batches(spark, 7)]
    return _facts(spark, batches=len(sizes), last=sizes[-1])


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id FROM events")
def ndjson_round_trip(spark, d):
    """S-08: a byte-order mark, blank lines, nulls; values as text."""
    path = shared_folder(spark, "events") + ".ndjson"
    row = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")))
    mark = F.when(F.col("event_id") == 0, "﻿").otherwise("")
    t(spark, d, "events").select(F.concat(mark, row, F.when(F.col("event_id") % 2 == 0, "\n  ").otherwise(""))).write.text(path)
    return sources.source_for(spark, path).select("event_id", "event_type", "user_id")


@query("SELECT count(*) AS n FROM events")
def ndjson_count(spark, d):
    """S-09: lines that are not blank."""
    path = shared_folder(spark, "events")
    t(spark, d, "events").select(F.concat(F.to_json(F.struct("event_id")), F.lit("\n"))).write.text(path)
    return _facts(spark, n=sources.count_lines(spark, path))


@query("SELECT * FROM (VALUES ('1', 'x', NULL, true), ('2', NULL, '[1, 2]', NULL), ('n', NULL, NULL, NULL)) AS v(a, b, c, e)")
def dict_rows(spark, d):
    """S-11: the union of keys; mixed columns are text."""
    return sources.read_rows(spark, [{"a": 1, "b": "x", "e": True}, {"a": 2, "c": [1, 2]}, {"a": "n", "b": float("nan")}])


_COLUMNS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}


def _database(spark, rows, name: str) -> str:
    """The address of a Derby database with one small table, which the processes of driver and executors can all open.

    One in memory is the driver's alone, and one in a folder belongs to the process that opened it first. So the driver
    fills one, closes it and puts it into an archive in the shared folder: Derby opens that read-only, as often as asked.
    """
    made, target = _local("db"), urllib.parse.urlparse(shared_folder(spark, "db") + "/db.jar")
    if target.scheme not in ("", "file"):
        raise SourceError("Derby opens archives of mounted folders only: spark.checkpoint.dir must be one here")
    names = ", ".join(f'"{c}" {_COLUMNS.get(kind, "VARCHAR(32672)")}' for c, kind in rows.dtypes)
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    open_ = manager.getConnection(f"jdbc:derby:{made};create=true")
    try:
        open_.createStatement().execute(f"CREATE TABLE {name} ({names})")
        put = open_.prepareStatement(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows.columns))})")
        for row in rows.toLocalIterator():
            for i, value in enumerate(row, 1):
                put.setObject(i, value)
            put.executeUpdate()
    finally:
        open_.close()
    try:
        manager.getConnection(f"jdbc:derby:{made};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # a database that was closed says so by this error
            raise
    Path(target.path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(target.path, "w") as archive:
        for file in sorted(made.rglob("*")):
            if file.is_file() and file.suffix != ".lck":
                archive.write(file, Path("db", file.relative_to(made)))
    shutil.rmtree(made.parent)
    return f"jdbc:derby:jar:({target.path})db"


@query("SELECT r_regionkey AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 0 GROUP BY 1")
def jdbc_query(spark, d):
    """S-17: a query that a database runs (Derby, which Spark brings along)."""
    url, driver = _database(spark, t(spark, d, "nation"), "nation"), "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    whole = sources.read_jdbc(spark, url, table="nation", partition_column="n_regionkey", bounds=(0, 5), partitions=2, driver=driver)
    assert whole.rdd.getNumPartitions() == 2
    counted = sources.read_jdbc(spark, url, 'SELECT "n_regionkey" AS "region", COUNT(*) AS "n" FROM nation WHERE "n_regionkey" > 0 GROUP BY "n_regionkey"', driver=driver)
    return counted.join(whole.select(F.col("n_regionkey").alias("region")).distinct(), "region").select("region", F.col("n").cast("long").alias("n"))


# ---- services -------------------------------------------------------------------------------------------------------
class _Service(http.server.BaseHTTPRequestHandler):
    """Pages of the rows that the server holds, in each style of paging."""

    def log_message(self, *a):
        pass

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        rows, head = self.server.rows, {}
        if "filter" in q:
            key, value = q["filter"].replace("'", "").split("=")
            rows = [r for r in rows if str(r.get(key)) == value]
        size = int(q.get("limit", q.get("pagesize", q.get("per_page", 4))))
        at = int(q.get("offset", q.get("page", q.get("cursor", q.get("from", 0)))))
        page = rows[at : at + size]
        if url.path == "/all":
            body = rows
        elif url.path.startswith("/v4/spreadsheets/"):
            body = {"values": [["key", "name"], *([r["key"], r["name"]] for r in rows)]}
        elif "/api/v1/" in url.path:
            body = page
            if at + size < len(rows):
                head = {"Link": f'<{url.path}?per_page={size}&from={at + size}>; rel="next"'}
        elif url.path == "/cursor":
            body = {"data": {"rows": page}, "next_cursor": at + size if at + size < len(rows) else None}
        elif url.path.startswith("/ws/"):
            body = {"schools": {"school": page}}
        elif url.path.startswith("/school/"):
            body = {"value": page}
        else:
            body = {url.path.rsplit("/", 1)[-1]: page}
        if url.path != "/all" and self.headers.get("Authorization") is None and "key" not in q and url.path != "/cursor":
            self.send_response(401)
            self.end_headers()
            return
        self.send_response(200)
        for k, v in head.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@cache
def _serve(d: str, rows: str) -> str:
    server = http.server.ThreadingHTTPServer(("0.0.0.0", 0), _Service)
    server.rows = json.loads(rows)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return str(server.server_port)


def _address(spark, d) -> str:
    """A service with the nations; those of odd keys have a ``late`` key that the first page lacks."""
    rows = [{"key": r.n_nationkey, "name": r.n_name, "place": {"region": r.n_regionkey}} | ({"late": f"n{r.n_nationkey}"} if r.n_nationkey > 9 else {}) for r in t(spark, d, "nation").orderBy("n_nationkey").collect()]
    return f"http://{spark.conf.get('spark.driver.host', '127.0.0.1')}:{_serve(d, json.dumps(rows))}"


_NATIONS = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, '{\"region\": ' || n_regionkey || '}' AS place, CASE WHEN n_nationkey > 9 THEN 'n' || n_nationkey END AS late FROM nation"
_AUTH = {"Authorization": "Bearer x"}


@query(_NATIONS)
def rest_one_page(spark, d):
    """S-12, S-13."""
    return read_rest(spark, _address(spark, d) + "/all")


@query(_NATIONS)
def rest_offset_pages(spark, d):
    """S-12, S-14: keys that later pages bring are columns, too."""
    return read_rest(spark, _address(spark, d) + "/nations", results_key="nations", pagination="offset", page_size=4, headers=_AUTH)


@query(_NATIONS)
def rest_cursor_pages(spark, d):
    """S-15."""
    return read_rest(spark, _address(spark, d) + "/cursor", results_key="data.rows", pagination="cursor", page_size=4)


@query(_NATIONS)
def rest_link_pages(spark, d):
    """S-16, S-22: a service that links its next page."""
    return services.read_canvas(spark, _address(spark, d), "x", "users", per_page=4)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation WHERE n_name = 'NATION_7'")
def rest_filter_pushed(spark, d):
    """S-23: the service evaluates the filter."""
    return services.read_oneroster(spark, _address(spark, d), "orgs", "x", filter_expr="name='NATION_7'", page_size=4).select("key", "name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def rest_district_service(spark, d):
    """S-25."""
    return services.read_powerschool(spark, _address(spark, d), "x", "schools", page_size=4).select("key", "name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def rest_school_service(spark, d):
    """S-26."""
    return services.read_blackbaud(spark, "x", "y", "students", base_url=_address(spark, d), page_size=4).select("key", "name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def sheet_rows(spark, d):
    """S-21: a worksheet, by a bearer credential."""
    return services.read_google_sheet(spark, "a" * 44, credentials="x", service=_address(spark, d))


@query("SELECT * FROM (VALUES ('SELECT 1 WHERE a = ''it''''s'' AND b = 3 AND c = '':b'' AND e IS NOT TRUE', 'BOOL,INT64,FLOAT64,STRING')) AS v(bound, kinds)")
def warehouse_parameters(spark, d):
    """S-18, S-19: named parameters as literals, and their types."""
    text = services.bound("SELECT 1 WHERE a = :a AND b = @b AND c = ':b' AND e IS NOT :e", {"a": "it's", "b": 3, "e": True})
    kinds = [p["type"] for p in services.query_parameters({"a": True, "b": 1, "c": 0.5, "e": "x"})]
    return _facts(spark, bound=text, kinds=",".join(kinds))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def warehouse_session_query(spark, d):
    """S-20: a query of the session's own catalogue."""
    t(spark, d, "nation").createOrReplaceTempView("nestwright_nation")
    return services.read_databricks(spark, "SELECT n_regionkey AS region, count(*) AS n FROM nestwright_nation GROUP BY 1")


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_0_k, CAST(event_id + 1 AS BIGINT) AS item_1_k, CAST(2 AS INTEGER) AS items_count FROM events")
def flatten_list(spark, d):
    """S-24: a list of records as numbered columns and their count."""
    items = F.array(F.from_json("props", "k bigint"), F.struct((F.col("event_id") + 1).alias("k")))
    return flatten(t(spark, d, "events").select(F.col("event_id").alias("id"), items.alias("items")), {"items": 2})


# ---- sinks ----------------------------------------------------------------------------------------------------------
def _orders(spark, d, **options) -> Pipeline:
    return Pipeline(t(spark, d, "orders").where("o_orderkey <> 0"), parse(ORDER), **options)


@query("SELECT 'ex:order/' || o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey <> 0")
def write_read_ndjson(spark, d):
    """K-03, K-05, K-06, U-04: part files of a sink, read back as a source."""
    path = shared_folder(spark, "parts")
    _orders(spark, d).to_sink(files.NDJSONSink(path, chunk_size=500))
    rows = sources.read_ndjson(spark, f"{path}/part-*.ndjson")
    return rows.select(F.col("`@id`").alias("id"), F.col("hasPriority.priority").alias("priority"))


@query("SELECT 'first' AS run, count(*) AS records, 'part-00000.ndjson' AS first_file, true AS success, true AS numbered FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 'append', 2 * count(*), 'part-00000.ndjson', true, true FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 'refused', 2 * count(*), 'part-00000.ndjson', true, true FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 'overwrite', count(*), 'part-00000.ndjson', true, true FROM orders WHERE o_orderkey <> 0")
def sink_modes(spark, d):
    """K-04, K-06 to K-10: names, modes and the mark of success; K-07 is the same sink on another address."""
    path, out = shared_folder(spark, "parts"), []
    folder = files.Folder(spark, path)
    for run, mode in (("first", "error"), ("append", "append"), ("refused", "error"), ("overwrite", "overwrite")):
        try:
            _orders(spark, d).to_sink(files.ADLSink(path, chunk_size=400, mode=mode, workers=3))
            assert run != "refused"
        except SinkError:
            assert run == "refused"
        names = [n for n in folder.names() if n.endswith(".ndjson")]
        out.append((run, spark.read.text(f"{path}/part-*.ndjson").count(), names[0], "_SUCCESS" in folder.names(), names == [f"part-{i:05d}.ndjson" for i in range(len(names))]))
    return spark.createDataFrame(out, ["run", "records", "first_file", "success", "numbered"])


def _distinct(texts: Iterable[str], folder: Path, files: int = 128) -> int:
    """Number of different texts: dealt to files by hash, of which one at a time is held."""
    folder.mkdir()
    with ExitStack() as stack:
        parts = [stack.enter_context(open(folder / str(i), "w", encoding="utf-8")) for i in range(files)]
        for x in texts:
            parts[zlib.crc32(x.encode()) % files].write(json.dumps(x) + "\n")
    n = 0
    for i in range(files):
        with open(folder / str(i), encoding="utf-8") as lines:
            n += len(set(lines))
    return n


@query("SELECT 'json' AS form, count(*) AS records FROM orders WHERE o_orderkey <> 0 UNION ALL SELECT 'ndjson', count(*) FROM orders WHERE o_orderkey <> 0")
def single_files(spark, d):
    """K-01, K-02: one array, one line each."""
    p, path = _orders(spark, d), _local("out")
    p.to_json(f"{path}.json")
    p.to_ndjson(f"{path}.ndjson")
    with open(f"{path}.ndjson", encoding="utf-8") as lines:
        ids = _distinct((serial.loads(x)["@id"] for x in lines), path.with_name("ids"))
    found = [("json", sum(1 for _ in serial.read_items(f"{path}.json"))), ("ndjson", ids)]
    shutil.rmtree(path.parent)
    return spark.createDataFrame(found, ["form", "records"])


@query("SELECT 'Required field ''quality'' is missing or empty for property ''label''' AS error, count(*) FILTER (l.quality IS NULL AND d.doc_id <> 0) AS n FROM documents d LEFT JOIN labels l USING (doc_id) HAVING n > 0 UNION ALL SELECT 'ID source field ''doc_id'' is zero, which is no identifier', 1")
def dead_letter_files(spark, d):
    """K-11, A-03, A-04: rejected rows in files of their own, counted in the same pass as the good ones."""
    rows = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    spec = parse({"base_uri": "ex:doc/", "id_source": "doc_id", "properties": {"label": {"type": "L", "fields": {"quality": {"source": "quality"}}}}})
    path = shared_folder(spark, "dead")
    done = Pipeline(rows, spec, dead_letters=f"{path}/dead").to_parts(f"{path}/good")
    letters = sources.read_ndjson(spark, f"{path}/dead")
    assert letters.count() == done.records_failed and done.records_in == rows.count()
    return letters.groupBy(F.col("_error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('parts', true), ('single', true)) AS v(writer, stopped)")
def failed_row_stops(spark, d):
    """F-13, M-12: without dead letters the first failed row stops a run, and nothing is left behind."""
    path, out = shared_folder(spark, "stop"), []
    p = Pipeline(t(spark, d, "orders"), parse(ORDER))
    for name, run in (("parts", lambda: p.to_parts(path)), ("single", lambda: p.to_ndjson(str(_local("x.ndjson"))))):
        try:
            run()
            out.append((name, False))
        except MappingError as e:
            out.append((name, "is zero" in str(e)))
    return spark.createDataFrame(out, ["writer", "stopped"])


def _client():
    def store(body: dict) -> float:
        if body["id"].endswith("7"):
            raise ValueError("refused")
        return 1.5

    return store


@query("SELECT count(*) AS total, count(*) FILTER (o_orderkey % 10 <> 7) AS succeeded, count(*) FILTER (o_orderkey % 10 = 7) AS failed, CAST(1.5 * count(*) FILTER (o_orderkey % 10 <> 7) AS DOUBLE) AS charge FROM orders WHERE o_orderkey <> 0")
def store_upserts(spark, d):
    """K-12, K-13, A-11: one result row a document; errors are rows."""
    return docstore.upsert_summary(_orders(spark, d).to_store(_client))


class _Store:
    """Stands in for a store's client: notes what it is asked to make."""

    def __init__(self, made):
        self.made = made

    def create_database_if_not_exists(self, id):
        self.made.append(id)
        return self

    def create_container_if_not_exists(self, id, partition_key, indexing_policy):
        self.made.append((id, partition_key, len(indexing_policy["includedPaths"]), indexing_policy["excludedPaths"][0]["path"]))
        return self


@query("SELECT * FROM (VALUES ('db', 'docs', '/partitionKey', 3, '/*')) AS v(database, container, partition_key, indexed, left_out)")
def container_creation(spark, d):
    """K-14."""
    made: list = []
    docstore.open_container(_Store(made), "db", "docs")
    return spark.createDataFrame([(made[0], *made[1])], "database string, container string, partition_key string, indexed int, left_out string")


@query("SELECT replace('ex:order/' || o_orderkey, '/', '|') AS id, 'ex:order/' || o_orderkey AS iri FROM orders WHERE o_orderkey <> 0")
def store_keys_in_text(spark, d):
    """K-17: the store's key in every output."""
    rows = _orders(spark, d, store_keys=True).json()
    return rows.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$['@id']").alias("iri"))


@query("SELECT * FROM (VALUES (23, true, true)) AS v(bytes, same, strict)")
def json_files(spark, d):
    """K-18, K-19."""
    path, value = _local("x.json"), {"a": "ä", "b": [1, None]}
    n = serial.write_json(value, path, pretty=False)
    try:
        serial.dumps({"a": float("nan")})
        strict = False
    except SinkError:
        strict = True
    try:
        serial.loads('{"a": NaN}')
        strict = False
    except SourceError:
        pass
    return spark.createDataFrame([(n, serial.read_json(path) == value, strict)], "bytes int, same boolean, strict boolean")


@query("SELECT f AS form, count(*) AS n FROM orders, (VALUES ('csv'), ('html'), ('json'), ('parquet')) AS v(f) WHERE o_orderkey % 7 = 0 GROUP BY 1")
def reports(spark, d):
    """K-20 to K-23: every issue in each form."""
    bad = t(spark, d, "orders").where("o_orderkey % 7 = 0")
    issues = bad.select(F.col("o_orderkey").cast("string").alias("record_id"), F.lit("=<p>").alias("message"))
    path, one = shared_folder(spark, "report"), _local("report")
    files.report_csv(issues, f"{path}/csv")
    files.report_parquet(issues, f"{path}/parquet")
    files.report_json({"n": 1}, issues, f"{one}.json")
    files.report_html({"n": 1}, issues, f"{one}.html")
    page = Path(f"{one}.html").read_text(encoding="utf-8")
    found = [("csv", spark.read.option("header", True).csv(f"{path}/csv").where("message = \"'=<p>\"").count()), ("parquet", spark.read.parquet(f"{path}/parquet").count()), ("json", len(serial.read_json(f"{one}.json")["issues"])), ("html", page.count("<td>=&lt;p&gt;</td>"))]
    return spark.createDataFrame(found, ["form", "n"])


class _Chunks:
    chunk_size = 100

    def __init__(self):
        self.sizes: list[int] = []

    def open(self) -> None:
        self.sizes = []

    def write_chunk(self, docs: list[dict]) -> None:
        self.sizes.append(len(docs))

    def close(self) -> files.SinkResult:
        return files.SinkResult(sum(self.sizes), 0, "", len(self.sizes))


@query("SELECT count(*) AS records, CAST(ceil(count(*) / 100.0) AS BIGINT) AS chunks, count(*) AS told FROM customer")
def chunk_sink(spark, d):
    """K-05, U-04, U-05, T-03: a sink of chunks, and a callback that counts the documents."""
    sink, told = _Chunks(), []
    p = Pipeline(t(spark, d, "customer"), parse(CUSTOMER), progress=lambda n, total: told.append(n))
    done = p.to_sink(sink)
    return _facts(spark, records=done.records_out, chunks=len(sink.sizes), told=told[-1])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id <> 0 GROUP BY event_type UNION ALL SELECT 'dead', 1")
def stream_dead_letters(spark, d):
    """T-02, T-04, T-05: a file stream in chunks, with failed rows beside it."""
    from nestwright.streaming import stream_to_parts

    path = shared_folder(spark, "stream")
    source = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    spec = parse({"base_uri": "ex:e/", "id_source": "event_id", "properties": {"k": {"type": "K", "fields": {"type": {"source": "event_type"}}}}})
    stream_to_parts(Pipeline(source, spec, dead_letters=f"{path}/dead"), f"{path}/out", f"{path}/state").awaitTermination()
    good = spark.read.text(f"{path}/out").select(F.get_json_object("value", "$.k.type").alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(spark.read.text(f"{path}/dead").agg(F.lit("dead").alias("event_type"), F.count(F.lit(1)).alias("n")))


@query("SELECT 'ex:customer/Customer%23' || substr(c_name, 10) AS id FROM customer WHERE c_custkey < 50")
def stream_one_by_one(spark, d):
    """T-01, O-01: documents on the driver, one after another, in the order of the source."""
    rows = t(spark, d, "customer").where("c_custkey < 50")
    ids = [x["@id"] for x in Pipeline(rows, parse(CUSTOMER)).stream()]
    assert ids == sorted(ids)
    return spark.createDataFrame([(i,) for i in ids], "id string")

