"""Façade: a source, a mapping, and what to do with rows that fail."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nestwright.errors import ConfigError, MappingError, SinkError
from nestwright.operators import quality
from nestwright.operators.shapes import Shapes, compile_constraints
from nestwright.plans.compiler import RELATED, Compiled, _column, compile_mapping
from nestwright.plans.spec import MappingSpec, with_overrides
from nestwright.sinks import docstore, files


@dataclass
class RunResult:
    records_in: int
    records_out: int
    records_failed: int
    bytes_written: int
    elapsed: float
    path: str | None = None
    dead_letters: str | None = None

    @property
    def records_per_second(self) -> float:
        return self.records_out / self.elapsed if self.elapsed else 0.0


@dataclass
class _Counted:
    """A DataFrame whose rows are counted as the driver takes them."""

    docs: DataFrame
    tell: Callable[[int, int | None], None]

    def toLocalIterator(self, prefetchPartitions: bool = False) -> Iterator:
        for n, row in enumerate(self.docs.toLocalIterator(prefetchPartitions=prefetchPartitions), 1):
            self.tell(n, None)
            yield row

    def texts(self) -> Iterator[str]:
        for n, text in enumerate(files.texts(self.docs), 1):
            self.tell(n, None)
            yield text


@dataclass
class Pipeline:
    """``source`` (batch or streaming) mapped by ``spec``.

    Without ``dead_letters`` the first row that fails stops a run; with it failing rows are written there. ``validate``
    drops rows whose checks find an error the same way ("report"), or stops at any issue ("strict"). ``progress`` is
    called with (done, total): documents on the driver (total None), or tasks where executors write.
    """

    source: DataFrame
    spec: MappingSpec
    transforms: dict[str, Callable] = field(default_factory=dict)
    source_overrides: dict | None = None
    transform_overrides: dict | None = None
    id_source: str | None = None
    id_transform: str | None = None
    dead_letters: str | None = None
    validate_mode: str | None = None
    allowed: dict[str, list[str]] | None = None
    store_keys: bool = False
    shapes: Shapes | None = None
    progress: Callable[[int, int | None], None] | None = None

    def __post_init__(self):
        if self.source_overrides or self.transform_overrides or self.id_source or self.id_transform:
            self.spec = with_overrides(self.spec, self.source_overrides, self.transform_overrides, self.id_source, self.id_transform)
        self.compiled: Compiled = compile_mapping(self.spec, self.source.schema, self.transforms)

    # ---- frames -------------------------------------------------------------------------------------------------
    def _marked(self) -> DataFrame:
        error = self.compiled.error
        if self.validate_mode:
            rules = quality.compile_rules(self.spec, self.source.schema, self.allowed)
            bad = F.exists(rules.issues, lambda i: i["severity"] == "error") if self.validate_mode != "strict" else F.size(rules.issues) > 0
            error = F.coalesce(F.when(bad, F.lit("pre-build validation failed")), error)
        return self.compiled.prepare(self.source).withColumn("_error", error)

    def _select(self, **outputs) -> DataFrame:
        return self._marked().where("_error is null").select(*(c.alias(n) for n, c in outputs.items()))

    def documents(self) -> DataFrame:
        """Good rows as ``id`` and nested ``document``."""
        return self._select(id=self.compiled.id, document=self.compiled.document)

    def _text(self):
        text = self.compiled.json
        if self.store_keys:
            head = F.concat(F.lit('{"id":'), F.to_json(F.array(F.translate(self.compiled.id, "/", "|"))))
            text = F.concat(F.regexp_replace(head, r"\[(.*)\]$", "$1"), F.lit(","), F.substr(text, F.lit(2)))
        return text

    def json(self) -> DataFrame:
        """Good rows as ``value``: JSON texts, keys in configuration order."""
        return self._select(value=self._text())

    def rejected(self) -> DataFrame:
        """Rows that fail, with ``_error``."""
        return self._marked().where("_error is not null").select(*(_column(c) for c in self.source.columns if c != RELATED), "_error")

    def warnings(self) -> DataFrame:
        return self.compiled.select(self.source, "id", "warnings").where(F.size("warnings") > 0)

    def validate(self, mode: str = "report", sample_rate: float = 0.1, seed: int = 0, shacl: Shapes | bool | None = None, names: dict[str, str] | None = None) -> quality.CheckResult:
        """(summary, issues). Row checks see every row in every mode; ``strict`` raises at the first issue.

        With ``shacl`` (True: the pipeline's ``shapes``), and when no row check found an error, the documents built are checked against its constraints
        in a second phase; ``sample`` checks a random share of them there. ``names`` are a context's, by IRI. The summary
        counts source rows once, and the issues of both phases.
        """
        if shacl is True and self.shapes is None:
            raise ConfigError("the pipeline has no shapes to check documents against")
        shacl = self.shapes if shacl is True else shacl or None
        checked = quality.compile_rules(self.spec, self.source.schema, self.allowed).check(self.source)
        if mode == "strict":
            quality.first_strict(checked)
        table, issues = quality.summary(checked), quality.issue_table(checked)
        if shacl is None or not table.head().conforms:
            return quality.CheckResult(table, issues)
        rows = quality.sample(self.source, sample_rate, seed) if mode == "sample" else self.source
        # a row without a document is an issue of its own
        none = F.expr(f"cast(array() as array<{quality.ISSUE}>)")
        unbuilt = F.struct(F.lit("@id").alias("property_path"), F.lit("error").alias("severity"), F.col("_error").alias("message"), F.lit("a document").alias("expected"), F.lit("").alias("actual"))
        built = self.compiled.prepare(rows).select(self.compiled.id.alias("record_id"), self.compiled.error.alias("_error"), self.compiled.document.alias("_document"))
        found = F.when(F.col("_error").isNotNull(), F.array(unbuilt)).otherwise(F.coalesce(compile_constraints(shacl, self.spec, F.col("_document"), names), none))
        judged = built.select(F.coalesce("record_id", F.lit("None")).alias("record_id"), found.alias("issues")).withColumn("conforms", ~F.exists("issues", lambda i: i["severity"] == "error"))
        if mode == "strict":
            quality.first_strict(judged)
        second = quality.summary(judged).select(*(F.col(c).alias(f"_{c}") for c in ("error_count", "warning_count", "failed_records")))
        both = table.crossJoin(second).select("total_records", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("error_count", "warning_count", "failed_records")))
        return quality.CheckResult(both.withColumn("conforms", F.col("error_count") == 0), issues.unionByName(quality.issue_table(judged)))

    # ---- actions ------------------------------------------------------------------------------------------------
    def _settle(self) -> int:
        """Rows that failed; they are written, or the first stops the run."""
        if self.dead_letters is None:
            row = self.rejected().select("_error").head()
            if row:
                raise MappingError(row[0])
            return 0
        return files.write_dead_letters(self.rejected(), self.dead_letters)

    def _run(self, write: Callable[[DataFrame], files.SinkResult]) -> RunResult:
        """For writers that stream through the driver: failed rows are settled first."""
        began = time.time()
        failed = self._settle()
        done = write(self._counted(self.json()))
        return RunResult(done.records + failed, done.records, failed, done.bytes, time.time() - began, done.path, self.dead_letters if failed else None)

    def _run_once(self, write: Callable[[DataFrame], files.SinkResult]) -> RunResult:
        """For writers of the executors: one pass over the source, and one more only where rows failed.

        Without dead letters a failed row fails its task, and Spark commits nothing.
        """
        began, seen = time.time(), Observation()
        marked = self._marked()
        if self.dead_letters is None:
            text = F.when(F.col("_error").isNotNull(), F.raise_error(F.concat(F.lit("row error: "), F.col("_error"))).cast("string")).otherwise(self._text())
            try:
                done, failed = write(marked.select(text.alias("value"))), 0
            except SinkError:
                raise
            except Exception as e:
                if m := re.search(r"row error: ([^\n]*)", str(e)):
                    raise MappingError(m[1]) from e
                raise
        else:
            counted = marked.observe(seen, F.count_if(F.col("_error").isNotNull()).alias("failed"))
            done = write(counted.where("_error is null").select(self._text().alias("value")))
            failed = files.write_dead_letters(self.rejected(), self.dead_letters) if seen.get["failed"] else 0
        return RunResult(done.records + failed, done.records, failed, done.bytes, time.time() - began, done.path, self.dead_letters if failed else None)

    def _counted(self, docs: DataFrame) -> DataFrame | _Counted:
        return docs if self.progress is None else _Counted(docs, self.progress)

    def _watched(self, write: Callable[[], files.SinkResult]) -> files.SinkResult:
        """Runs ``write`` and tells ``progress`` of the tasks of the stages under way."""
        if self.progress is None:
            return write()
        tracker, over = self.source.sparkSession.sparkContext.statusTracker(), threading.Event()

        def tell() -> None:
            while not over.wait(0.2):
                stages = [x for i in tracker.getActiveStageIds() if (x := tracker.getStageInfo(i))]
                if stages:
                    self.progress(sum(x.numCompletedTasks for x in stages), sum(x.numTasks for x in stages))

        thread = threading.Thread(target=tell, daemon=True)
        thread.start()
        try:
            done = write()
        finally:
            over.set()
            thread.join()
        self.progress(done.records, done.records)
        return done

    def to_parts(self, path: str, mode: str = "error", chunk_size: int = 10_000, workers: int | None = None) -> RunResult:
        return self._run_once(lambda docs: self._watched(lambda: files.write_parts(docs, path, mode, chunk_size, workers)))

    def to_sink(self, sink: files.Sink | files.ChunkSink) -> RunResult:
        """Into any sink: one that writes a DataFrame from the executors, or one that takes chunks on the driver."""
        if isinstance(sink, files.Sink):
            return self._run_once(lambda docs: self._watched(lambda: sink.write(docs)))
        return self._run(lambda docs: files.write_chunks(docs, sink))

    def to_ndjson(self, path: str) -> RunResult:
        return self._run(lambda docs: files.write_single(docs, path))

    def to_json(self, path: str, pretty: bool = True) -> RunResult:
        return self._run(lambda docs: files.write_single(docs, path, "array", pretty))

    def to_store(self, client: Callable, partition_value: str | None = None, concurrency: int = 25) -> DataFrame:
        """One result row per upserted document."""
        rows = self._select(id=self.compiled.id, json=self.compiled.json)
        kind = self.spec.type if isinstance(self.spec.type, str) else (self.spec.type or [None])[0]
        named = rows.withColumnRenamed("id", "@id").withColumn("@type", F.lit(kind).cast("string"))
        return docstore.upsert(docstore.prepare(named, partition_value=partition_value), client, concurrency)

    def stream(self) -> Iterator[dict]:
        """Documents one by one on the driver, in partition order."""
        import json

        self._settle()
        for row in self._counted(self.json()).toLocalIterator():
            yield json.loads(row[0])

    def metrics(self) -> DataFrame:
        """One row: records_in, records_out, records_failed, in one pass without writing."""
        return self._marked().agg(F.count(F.lit(1)).alias("records_in"), F.count_if(F.col("_error").isNull()).alias("records_out"), F.count_if(F.col("_error").isNotNull()).alias("records_failed"))

    def observed(self, name: str = "nestwright") -> tuple[DataFrame, Observation]:
        """JSON texts with counters that fill as they are written."""
        seen = Observation(name)
        return self.json().observe(seen, F.count(F.lit(1)).alias("records_out"), F.sum(F.octet_length("value")).alias("bytes")), seen
