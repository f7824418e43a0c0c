"""Shared-folder tables that cut lineage between the phases of multi-pass operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_made: list[Workspace] = []


class Workspace:
    """A folder of intermediate Parquet tables below ``spark.checkpoint.dir``.

    The folder is the one the cluster shares, so a table survives lost executors. Only where the setting is
    missing (single-machine tests) a local temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="nestwright-")
        self.spark = spark
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written; it is deleted when the session's process ends."""
        df.write.parquet(f"{self.path}/{name}")
        where = self._where()
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _where(self, name: str | None = None):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads, or the whole folder."""
        for name in names or (None,):
            where = self._where(name)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    @staticmethod
    def drop_since(mark: int) -> int:
        """Delete the folders made after ``mark`` (a number that this returned): their readers' results were written."""
        for w in _made[mark:]:
            w.drop()
        del _made[mark:]
        return len(_made)

    @staticmethod
    def mark() -> int:
        return len(_made)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)


_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, release: Callable[[], None]) -> None:
    """Say that this worker keeps something for ``owner``'s later tasks; ``release`` gives it up when another's begin."""
    _held[owner] = release


def begin(owner: str) -> None:
    """A task of ``owner`` begins in this worker: what it keeps for others goes."""
    if others := [name for name in _held if name != owner]:
        for name in others:
            _held.pop(name)()
        give_back()


def give_back() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def lean(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, giving its memory back when it ends: workers are used again by other stages."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        from nestwright.llm import text, work  # a worker's own modules, not what the driver's copies held

        work.begin(owner)
        try:
            yield from run(batches)
        finally:
            text._powers.clear()
            work.give_back()

    return wrapped


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as a column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
