"""Documents for a document store: keys, partition keys, and upserts from the executors through an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.functions.scalars import document_key

#: Indexing of a container made for such documents, only what they are found by.
INDEXING = {
    "indexingMode": "consistent",
    "automatic": True,
    "includedPaths": [{"path": "/id/?"}, {"path": "/partitionKey/?"}, {"path": '/"@type"/?'}],
    "excludedPaths": [{"path": "/*"}],
}


def open_container(client, database: str, container: str, create_if_missing: bool = True, partition_key: str = "/partitionKey"):
    """The container, made first with its database and ``INDEXING`` where missing. ``client`` is a store's own client.

    It has ``create_database_if_not_exists(id=)`` and ``get_database_client(name)``; a database has
    ``create_container_if_not_exists(id=, partition_key=, indexing_policy=)`` and ``get_container_client(name)``.
    """
    if not create_if_missing:
        return client.get_database_client(database).get_container_client(container)
    place = client.create_database_if_not_exists(id=database)
    return place.create_container_if_not_exists(id=container, partition_key=partition_key, indexing_policy=INDEXING)


def prepare(documents: DataFrame, id_col: str = "@id", type_col: str = "@type", partition_value: str | None = None) -> DataFrame:
    """``id`` (with ``/`` as ``|``) and ``partitionKey``: the given value, else the first type, else the id. Empty ids are null."""
    key = document_key(F.col(f"`{id_col}`"))
    key = F.when(key != "", key)
    kind = F.lit(None).cast("string")
    if type_col in documents.columns:
        t = F.col(f"`{type_col}`")
        kind = F.get(t, F.lit(0)) if documents.schema[type_col].dataType.typeName() == "array" else F.when(t != "", t)
    return documents.withColumns({"id": key, "partitionKey": F.coalesce(F.lit(partition_value).cast("string"), kind, key)})


def upsert(documents: DataFrame, client: Callable[[], Callable[[dict], float]], concurrency: int = 25) -> DataFrame:
    """Upserts each row of ``id``, ``partitionKey``, ``json``: one result row each (document_id, status, charge, error).

    ``client()`` runs once a task and returns a function that stores one document and tells its cost. Errors are rows,
    not failures; at most ``concurrency`` documents a task are under way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        store = client()

        def one(row) -> tuple:
            try:
                body = {**json.loads(row.json), "id": row.id, "partitionKey": row.partitionKey}
                if not row.id:
                    raise ValueError("the document has no id")
                return row.id, "ok", float(store(body) or 0.0), None
            except Exception as e:
                return row.id, "failed", 0.0, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.itertuples(index=False))), columns=["document_id", "status", "charge", "error"])

    return documents.select("id", "partitionKey", "json").mapInPandas(run, "document_id string, status string, charge double, error string")


def upsert_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.sum("charge"), F.lit(0.0)).alias("charge"))
