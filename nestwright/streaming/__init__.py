"""The same compiled mapping on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nestwright.pipeline import Pipeline


def stream_to_parts(pipeline: Pipeline, path: str, checkpoint: str, trigger: dict | None = None, max_records_per_file: int = 10_000) -> StreamingQuery:
    """Runs a pipeline whose source is a stream: documents to part files, failing rows to dead letters, exactly once per batch.

    Each micro-batch writes below its own number and overwrites it when it is run again.
    """
    from nestwright.sinks.files import write_dead_letters

    def write(batch: DataFrame, number: int) -> None:
        own = Pipeline(batch, pipeline.spec, pipeline.transforms, dead_letters=pipeline.dead_letters, validate_mode=pipeline.validate_mode, allowed=pipeline.allowed)
        own.json().write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).text(f"{path}/batch={number}")
        if pipeline.dead_letters:
            write_dead_letters(own.rejected(), f"{pipeline.dead_letters}/batch={number}", mode="overwrite")

    return pipeline.source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
