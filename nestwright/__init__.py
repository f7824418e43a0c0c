"""Nestwright: declarative record-to-document mapping compiled to Spark plans."""

from nestwright.errors import ConfigError, DocumentError, MappingError, MatchError, NestwrightError, QualityError, ShapeError, SinkError, SourceError
from nestwright.functions.scalars import TRANSFORMS, Transform, document_key, iri_component, strip_control
from nestwright.logs import get_logger
from nestwright.operators.concepts import Concepts
from nestwright.operators.matcher import Match, Target, asking, detect, match, preview, suggest
from nestwright.operators.profile import profile
from nestwright.operators.quality import CheckResult, Rules, compile_rules, duplicate_ids, issue_table, summary
from nestwright.operators.relate import nest_join
from nestwright.operators.shapes import NodeShape, PropertyShape, Registry, ShapeFolder, Shapes, compile_constraints, context_names
from nestwright.operators.synth import PoolCache, generate
from nestwright.pipeline import Pipeline, RunResult
from nestwright.plans.compiler import Compiled, compile_mapping
from nestwright.plans.spec import FieldSpec, MappingSpec, PropertySpec, check_base_uri, compose, load, parse, with_overrides
from nestwright.sinks.docstore import open_container, prepare, upsert, upsert_summary
from nestwright.sinks.files import ADLSink, ChunkSink, NDJSONSink, Sink, SinkResult, report_csv, report_html, report_json, report_parquet
from nestwright.sinks.serial import dumps, loads, read_json, write_json
from nestwright.sources.files import Source, read_csv, read_excel, read_jdbc, read_ndjson, read_parquet, read_rows, source, source_for
from nestwright.sources.rest import flatten, read_rest
from nestwright.sources.services import read_bigquery, read_blackbaud, read_canvas, read_databricks, read_google_sheet, read_oneroster, read_powerschool, read_snowflake

__version__ = "0.2.0"
__all__ = [n for n in dir() if not n.startswith("_") and n not in ("errors", "functions", "logs", "operators", "pipeline", "plans", "sinks", "sources")]
