"""REST sources: paginated JSON over HTTP as a Spark data source, presets for services, and record flattening.

Offset pages of a known total are read in parallel, one partition each; cursor and link pages follow one another and
take one partition. A filter on a column that the service can filter by is passed to it.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nestwright.errors import ConfigError, SourceError


def _dig(body, path: str | None):
    for key in (path or "").split(".") if path else []:
        if not isinstance(body, dict) or key not in body:
            raise SourceError(f"the response has no {path!r}")
        body = body[key]
    return body


def next_link(header: str | None) -> str | None:
    """Target of ``rel="next"`` in a Link header."""
    for part in re.split(r",\s*(?=<)", header or ""):
        m = re.match(r"\s*<([^>]*)>\s*(.*)", part)
        if m and re.search(r'rel\s*=\s*"?(?:[^"]*\s)?next(?:\s[^"]*)?"?', m[2]):
            return m[1]
    return None


class RestReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.o = {k.lower(): v for k, v in options.items()}
        if "url" not in self.o:
            raise ConfigError("a REST source needs url")
        self.schema = schema
        self.size = int(self.o.get("page_size", 100))
        self.style = self.o.get("pagination", "none")
        if self.style not in ("none", "offset", "cursor", "link"):
            raise ConfigError("pagination is none, offset, cursor or link")

    def get(self, url: str, params: dict) -> tuple[list, dict, str | None]:
        if params:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params)
        headers = {"Accept": "application/json", **json.loads(self.o.get("headers", "{}"))}
        body = self.o.get("body")
        request = urllib.request.Request(url, body.encode() if body else None, headers, method=self.o.get("method", "POST" if body else "GET"))
        try:
            with urllib.request.urlopen(request, timeout=float(self.o.get("timeout", 30))) as answer:
                data, link = json.loads(answer.read()), answer.headers.get("Link")
        except urllib.error.HTTPError as e:
            raise SourceError(f"{url}: HTTP {e.code}") from e
        except (urllib.error.URLError, ValueError) as e:
            raise SourceError(f"{url}: {e}") from e
        rows = _dig(data, self.o.get("results_key"))
        if not isinstance(rows, list):
            raise SourceError(f"{url}: the result is no list")
        return rows, data, link

    def partitions(self) -> list[InputPartition]:
        total = self.o.get("total")
        if self.style == "offset" and total is not None:
            return [InputPartition(a) for a in range(0, int(total), self.size)] or [InputPartition(0)]
        return [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = self.schema.fieldNames()
        whole = isinstance(self.schema[0].dataType, T.MapType) if names else False
        for rows in self.pages(partition.value):
            for row in rows:
                yield ({k: self.cell(v) for k, v in row.items()},) if whole else tuple(self.cell(row.get(n)) for n in names)

    @staticmethod
    def cell(v):
        return v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v)

    def pages(self, offset: int | None) -> Iterator[list]:
        params = json.loads(self.o.get("params", "{}"))
        url = self.o["url"]
        at, limit = self.o.get("offset_param", "offset"), self.o.get("limit_param", "limit")
        if self.style == "none":
            yield self.get(url, params)[0]
        elif offset is not None:
            yield self.get(url, {**params, at: offset, limit: self.size})[0]
        elif self.style == "offset":
            now = 0
            while True:
                rows = self.get(url, {**params, at: now, limit: self.size})[0]
                yield rows
                if len(rows) < self.size:
                    return
                now += self.size
        elif self.style == "cursor":
            cursor = None
            while True:
                rows, data, _ = self.get(url, {**params, limit: self.size, **({self.o.get("cursor_param", "cursor"): cursor} if cursor else {})})
                if not rows:
                    return
                yield rows
                try:
                    cursor = _dig(data, self.o.get("cursor_response_key", "next_cursor"))
                except SourceError:
                    return
                if not cursor:
                    return
        else:
            while url:
                rows, _, link = self.get(url, params)
                yield rows
                target = next_link(link)
                url, params = (urllib.parse.urljoin(url, target) if target else None), {}


class RestSource(DataSource):
    """``spark.read.format("nestwright_rest").schema(...).option("url", ...)``; every column is text.

    A schema of one ``map<string,string>`` column takes whatever keys the records have.
    """

    @classmethod
    def name(cls) -> str:
        return "nestwright_rest"

    def reader(self, schema: T.StructType) -> RestReader:
        return RestReader(dict(self.options), schema)


def read_rest(spark: SparkSession, url: str, columns: list[str] | None = None, **options) -> DataFrame:
    """JSON records of a service as text columns.

    Without ``columns`` the keys of all records on all pages are columns, in the order they are first met. The records
    are then kept (in memory, beyond that on disk) so that the service is asked once.
    """
    options = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in {"url": url, **options}.items() if v is not None}
    spark.dataSource.register(RestSource)
    reader = spark.read.format("nestwright_rest").options(**options)
    if columns is not None:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).load()
    records = reader.schema("fields map<string,string>").load().persist()
    keys = records.select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.map_keys("fields")).alias("pos", "key"))
    try:
        found = [r.key for r in keys.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).orderBy("first").collect()]
    except PythonException as e:
        raise SourceError(f"{url} cannot be read: {(re.findall(r'SourceError: (.*)', str(e)) or ['see above'])[0]}") from e
    return records.select(*(F.try_element_at("fields", F.lit(k)).alias(k) for k in found))


def flatten(df: DataFrame, items: dict[str, int] | None = None) -> DataFrame:
    """Structs as ``a_b`` columns, arrays of structs as ``singular_i_b`` and ``a_count``; other arrays stay.

    ``items``: how many elements of an array become columns (1 without an entry). Clashing names are an error.
    """
    out: list[tuple[str, Column]] = []

    def walk(name: str, c: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}_{f.name}", c.getField(f.name), f.dataType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            one = name[:-1] if name.endswith("s") else name
            for i in range((items or {}).get(name, 1)):
                walk(f"{one}_{i}", F.get(c, F.lit(i)), kind.elementType)
            out.append((f"{name}_count", F.size(c)))
        else:
            out.append((name, c))

    for f in df.schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    names = [n for n, _ in out]
    if clash := {n for n in names if names.count(n) > 1}:
        raise SourceError(f"flattened names clash: {sorted(clash)}")
    return df.select(*(c.alias(n) for n, c in out))
