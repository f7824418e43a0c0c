"""Readers for hosted services: warehouses through their Spark connectors, school systems through the REST source."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from nestwright.errors import ConfigError, SourceError
from nestwright.sources.rest import read_rest

#: Resources of the services and where they are.
POWERSCHOOL = {
    "students": ("/ws/v1/district/student", "students.student"),
    "staff": ("/ws/v1/district/staff", "staff.staff"),
    "schools": ("/ws/v1/district/school", "schools.school"),
    "sections": ("/ws/v1/district/section", "sections.section"),
    "enrollments": ("/ws/v1/district/enrollment", "enrollments.enrollment"),
}
BLACKBAUD = {
    "users": "/school/v1/users",
    "students": "/school/v1/students",
    "sections": "/school/v1/sections",
    "enrollments": "/school/v1/enrollment",
    "schools": "/school/v1/schools",
    "courses": "/school/v1/academics/courses",
}
ONEROSTER = frozenset({
    "users",
    "students",
    "teachers",
    "orgs",
    "enrollments",
    "courses",
    "classes",
    "academicSessions",
    "demographics",
    "lineItems",
    "results",
    "gradingPeriods",
    "terms",
    "categories",
})
CANVAS_ACCOUNT = frozenset({"users", "courses", "sis_imports"})
CANVAS_COURSE = frozenset({"enrollments", "students", "assignments", "sections"})


def _one_of(value: str, known) -> None:
    if value not in known:
        raise ConfigError(f"unknown resource {value!r}; known: {', '.join(sorted(known))}")


def _need(**values) -> None:
    if empty := [k for k, v in values.items() if not v]:
        raise ConfigError(f"{', '.join(empty)} must not be empty")


def read_powerschool(spark: SparkSession, base_url: str, access_token: str, resource: str = "students", page_size: int = 100, **options) -> DataFrame:
    _need(base_url=base_url, access_token=access_token)
    _one_of(resource, POWERSCHOOL)
    path, key = POWERSCHOOL[resource]
    return read_rest(spark, base_url.rstrip("/") + path, headers={"Authorization": f"Bearer {access_token}"}, results_key=key, pagination="offset", offset_param="page", limit_param="pagesize", page_size=page_size, **options)


def read_blackbaud(spark: SparkSession, access_token: str, subscription_key: str, resource: str = "students", base_url: str = "https://api.sky.blackbaud.com", page_size: int = 100, **options) -> DataFrame:
    _need(access_token=access_token, subscription_key=subscription_key)
    _one_of(resource, BLACKBAUD)
    headers = {"Authorization": f"Bearer {access_token}", "Bb-Api-Subscription-Key": subscription_key}
    return read_rest(spark, base_url.rstrip("/") + BLACKBAUD[resource], headers=headers, results_key="value", pagination="offset", page_size=page_size, **options)


def client_token(token_url: str, client_id: str, client_secret: str, scope: str | None = None) -> str:
    """OAuth client-credentials token."""
    body = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": client_id, "client_secret": client_secret, **({"scope": scope} if scope else {})}).encode()
    try:
        with urllib.request.urlopen(token_url, body, timeout=30) as answer:
            return json.loads(answer.read())["access_token"]
    except (OSError, KeyError, ValueError) as e:
        raise SourceError(f"no token from {token_url}") from e


def read_oneroster(spark: SparkSession, base_url: str, resource: str, bearer_token: str | None = None, client: tuple[str, str, str] | None = None, filter_expr: str | None = None, page_size: int = 100, **options) -> DataFrame:
    """``client`` is (token url, id, secret). ``filter_expr`` is evaluated by the service."""
    _need(base_url=base_url)
    _one_of(resource, ONEROSTER)
    if (bearer_token is None) == (client is None):
        raise ConfigError("either a bearer token or client credentials")
    token = bearer_token or client_token(*client)
    return read_rest(spark, f"{base_url.rstrip('/')}/{resource}", headers={"Authorization": f"Bearer {token}"}, results_key=resource, pagination="offset", page_size=page_size, params={"filter": filter_expr} if filter_expr else {}, **options)


def read_canvas(spark: SparkSession, base_url: str, api_key: str, resource: str, account_id: str = "self", course_id: int | None = None, include: list[str] | None = None, per_page: int = 100, **options) -> DataFrame:
    _need(base_url=base_url, api_key=api_key)
    _one_of(resource, CANVAS_ACCOUNT | CANVAS_COURSE)
    if resource in CANVAS_COURSE and course_id is None:
        raise ConfigError(f"{resource} needs a course_id")
    if not 1 <= per_page <= 100:
        raise ConfigError("per_page is 1 to 100")
    where = f"courses/{course_id}" if resource in CANVAS_COURSE else f"accounts/{account_id}"
    query = urllib.parse.urlencode([("per_page", per_page), *(("include[]", x) for x in include or [])])
    return read_rest(spark, f"{base_url.rstrip('/')}/api/v1/{where}/{resource}?{query}", headers={"Authorization": f"Bearer {api_key}"}, pagination="link", **options)


def sheet_id(spreadsheet: str) -> str:
    """Identifier out of a sheet's address, or the identifier itself (44 characters)."""
    if m := re.search(r"/spreadsheets/d/([A-Za-z0-9_-]+)", spreadsheet):
        return m[1]
    if re.fullmatch(r"[A-Za-z0-9_-]{44}", spreadsheet):
        return spreadsheet
    raise ConfigError("give a sheet's address or its 44-character id")


def _sheet_token(credentials=None, service_account_file: str | None = None) -> str:
    """An access token out of credentials (an object with ``token``, or the token), or of a service account's key file."""
    if credentials is not None:
        return credentials if isinstance(credentials, str) else credentials.token
    try:
        from google.auth.transport.requests import Request
        from google.oauth2.service_account import Credentials
    except ImportError as e:
        raise SourceError("service accounts need google-auth") from e
    made = Credentials.from_service_account_file(service_account_file, scopes=["https://www.googleapis.com/auth/spreadsheets.readonly"])
    made.refresh(Request())
    return made.token


def read_google_sheet(spark: SparkSession, spreadsheet: str, api_key: str | None = None, worksheet: str = "Sheet1", header_row: int = 1, value_render_option: str = "FORMATTED_VALUE", credentials=None, service_account_file: str | None = None, service: str = "https://sheets.googleapis.com") -> DataFrame:
    """One worksheet as text columns, by exactly one of API key, credentials and service account file."""
    from nestwright.sources.files import read_rows

    if sum(x is not None and x != "" for x in (api_key, credentials, service_account_file)) != 1:
        raise ConfigError("exactly one of api_key, credentials and service_account_file")
    url = f"{service}/v4/spreadsheets/{sheet_id(spreadsheet)}/values/{urllib.parse.quote(worksheet)}?" + urllib.parse.urlencode({**({"key": api_key} if api_key else {}), "valueRenderOption": value_render_option})
    headers = {} if api_key else {"Authorization": f"Bearer {_sheet_token(credentials, service_account_file)}"}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as answer:
            values = json.loads(answer.read()).get("values", [])
    except (OSError, ValueError) as e:
        raise SourceError(f"worksheet {worksheet!r} cannot be read") from e
    names = [str(x) for x in values[header_row - 1]] if len(values) >= header_row else []
    return read_rows(spark, [dict(zip(names, map(str, r), strict=False)) for r in values[header_row:]], names)


def _load(reader, what: str) -> DataFrame:
    try:
        return reader.load()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e):
            raise SourceError(f"the Spark connector for {what} is not on the class path") from e
        raise


def bound(query: str, params: dict | None) -> str:
    """``query`` with its named parameters (``:name`` or ``@name``) as SQL literals; text is quoted, names must be known."""
    if not params:
        return query

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "''") + "'"

    def put(m: re.Match) -> str:
        if m[1] is None:  # a quoted text of the query
            return m[0]
        if m[1] not in params:
            raise ConfigError(f"no value for parameter {m[1]!r}")
        return literal(params[m[1]])

    return re.sub(r"'(?:[^']|'')*'|::\w+|[:@]([A-Za-z_]\w*)", put, query)


def query_parameters(params: dict | None) -> list[dict]:
    """Named parameters with the types that a warehouse wants: BOOL, INT64, FLOAT64, STRING."""
    kinds = ((bool, "BOOL"), (int, "INT64"), (float, "FLOAT64"))
    return [{"name": k, "type": next((t for kind, t in kinds if isinstance(v, kind)), "STRING"), "value": v} for k, v in (params or {}).items()]


def read_snowflake(spark: SparkSession, query: str, account: str, user: str, password: str, database: str | None = None, schema: str | None = None, warehouse: str | None = None, role: str | None = None, params: dict | None = None) -> DataFrame:
    _need(query=query, account=account, user=user)
    given = {"sfURL": f"{account}.snowflakecomputing.com", "sfUser": user, "sfPassword": password, "sfDatabase": database, "sfSchema": schema, "sfWarehouse": warehouse, "sfRole": role}
    return _load(spark.read.format("net.snowflake.spark.snowflake").options(**{k: v for k, v in given.items() if v}).option("query", bound(query, params)), "Snowflake")


def read_bigquery(spark: SparkSession, query: str | None = None, table: str | None = None, project: str | None = None, max_results: int | None = None, params: dict | None = None, **options) -> DataFrame:
    """``params`` are named ``@name`` in the query. A table's ``count()`` is its number of rows."""
    if (query is None) == (table is None):
        raise ConfigError("either a query or a table")
    reader = spark.read.format("bigquery").options(**options)
    if project:
        reader = reader.option("parentProject", project)
    if query:
        for p in query_parameters(params):
            reader = reader.option(f"NamedParameters.{p['name']}", f"{p['type']}:{p['value']}")
    df = _load(reader.option("query", query) if query else reader.option("table", table), "BigQuery")
    return df.limit(max_results) if max_results else df


def read_databricks(spark: SparkSession, query: str, server_hostname: str | None = None, http_path: str | None = None, access_token: str | None = None) -> DataFrame:
    """The query in this session, or over JDBC where a server is given."""
    from nestwright.sources.files import read_jdbc

    if server_hostname is None:
        return spark.sql(query)
    _need(http_path=http_path, access_token=access_token)
    return read_jdbc(spark, f"jdbc:databricks://{server_hostname}:443;httpPath={http_path};AuthMech=3;UID=token;PWD={access_token}", query)
