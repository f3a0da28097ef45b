"""The vector store and the property graph as Parquet tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.operators.ranking import top_per_key
from tesselon.session import store_parts, store_table
from tesselon.sources import files

#: Query vectors that one block of a search holds, and the most queries that are sent to all tasks at once.
QUERY_BLOCK = 2_000
#: Cosines that a task computes at once.
CELLS = 4_000_000


class VectorStore:
    """Collections of rows (id, parent_asin, ..., vector) under a folder; inserting appends, it doesn't replace."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def has(self, name: str) -> bool:
        return files.exists(self.spark, files.joined(self.root, name))

    def drop(self, name: str) -> None:
        files.remove(self.spark, files.joined(self.root, name))

    def insert(self, name: str, rows: DataFrame, reset: bool = False) -> None:
        rows.write.mode("overwrite" if reset else "append").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def search(self, name: str, queries: DataFrame, k: int = 10) -> DataFrame:
        return search_vectors(self.read(name), queries, k)


def search_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, id, sim)``: the ``k`` vectors with the greatest cosine to each query, ties by id; exact.

    ``queries`` is a stated set. Blocks of ``block`` queries are broadcast one after the other, so the driver never holds
    more than one; every vector is compared with every query there, ``CELLS`` cosines at a time, of which only about ``k`` a query leave the task. Null
    and all-zero vectors, and those of another length than the query, match nothing. Both tables have ``id`` and ``vector``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    double = F.transform("vector", lambda x: x.cast("double"))
    rows, asked = vectors.where(usable).select("id", double.alias("vector")), queries.where(usable).select("id", double.alias("vector"))
    kind, asks = vectors.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    context = vectors.sparkSession.sparkContext

    def blocks() -> Iterator[list[tuple[list, np.ndarray]]]:
        held: list = []
        for row in asked.toLocalIterator():
            held.append(row)
            if len(held) == block:
                yield _by_length(held)
                held = []
        if held:
            yield _by_length(held)

    def compared(sent: Broadcast) -> DataFrame:
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets = batch.column(1).offsets.to_numpy()
                for ids, matrix in sent.value:
                    fits = np.flatnonzero(np.diff(offsets) == matrix.shape[1])
                    if not len(fits):
                        continue
                    step = max(k, CELLS // len(ids))
                    for own in (fits[i : i + step] for i in range(0, len(fits), step)):
                        x = batch.column(1).values.to_numpy()[offsets[own][:, None] + np.arange(matrix.shape[1])]
                        x = x / np.linalg.norm(x, axis=1, keepdims=True)
                        sims = matrix @ x.T
                        keep = min(k, len(own))
                        # all that tie with the last kept one stay, so that ties are decided by id later
                        least = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1 : keep]
                        q, r = np.nonzero(sims >= least)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), batch.column(0).take(pa.array(own[r], pa.int64())), pa.array(sims[q, r], pa.float64())], ["query_id", "id", "sim"])

        found = rows.mapInArrow(best, f"query_id {asks}, id {kind}, sim double")
        return top_per_key(found, ["query_id"], [F.desc("sim"), F.col("id")], k).select("query_id", "rank", "id", "sim")

    every = blocks()
    first, second = next(every, None), next(every, None)
    if first is None:
        return rows.limit(0).select(F.lit(None).cast(asks).alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("sim"))
    if second is None:
        return compared(context.broadcast(first))

    def parts() -> Iterator[DataFrame]:
        for queries in itertools.chain((first, second), every):
            sent = context.broadcast(queries)
            yield compared(sent)
            sent.destroy()  # its part is written

    return store_parts(parts())


def _by_length(held: list) -> list[tuple[list, np.ndarray]]:
    """(ids, unit vectors as rows) for each length."""
    out = []
    for size in sorted({len(r["vector"]) for r in held}):
        own = [r for r in held if len(r["vector"]) == size]
        matrix = np.array([r["vector"] for r in own])
        out.append(([r["id"] for r in own], matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))
    return out


class GraphStore:
    """Vertex and edge tables under a folder, merged by key: of rows with one key the newest are kept."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.store = VectorStore(spark, root)

    def reset(self, name: str) -> None:
        self.store.drop(name)

    def merge(self, name: str, rows: DataFrame, *key: str) -> None:
        """Rows replace those of the same key; others stay. A new version is written and then put in place."""
        fresh = rows.dropDuplicates(list(key))
        if self.store.has(name):
            fresh = store_table(fresh.unionByName(self.read(name).join(fresh, list(key), "left_anti"), allowMissingColumns=True))
        fresh.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def load_vector_artifacts(spark: SparkSession, primary: str, fallback: str | None = None, dim: int | None = None) -> DataFrame:
    """``(parent_asin, vector)`` from the first folder that exists; no folder, no rows, mixed lengths or another ``dim`` raise."""
    for path in filter(None, (primary, fallback)):
        if files.exists(spark, path):
            out = spark.read.parquet(path).select("parent_asin", F.transform("vector", lambda x: x.cast("float")).alias("vector"))
            least, most, n = out.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count(F.lit(1))).first()
            if not n or least != most or (dim is not None and most != dim):
                raise ValueError(f"vectors of length {least} to {most}, {n} rows")
            return out
    raise FileNotFoundError(primary)


def embedding_preview(vectors: DataFrame, rows: int = 10, dims: int = 20) -> DataFrame:
    """The first rows in the order of ids, with the first numbers as columns dim_0, dim_1, ... (null beyond a vector's length)."""
    first = vectors.orderBy("parent_asin").limit(rows)
    return first.select("parent_asin", *[F.get("vector", F.lit(i)).alias(f"dim_{i}") for i in range(dims)]).orderBy("parent_asin")


def write_embedding_preview(vectors: DataFrame, path: str, rows: int = 10, dims: int = 20) -> None:
    """``embedding_preview`` as one CSV file."""
    files.write_text(vectors.sparkSession, path, embedding_preview(vectors, rows, dims).toPandas().to_csv(index=False))
