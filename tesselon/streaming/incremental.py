"""Counts and means that keep up with arriving interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tesselon.operators.key_profile import value_frequencies
from tesselon.sources.stores import VectorStore


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, end, key, n, total)`` of the rating per window; rows later than ``late`` are left out, as is a null time."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def item_means_sink(store: VectorStore, name: str, key: str = "parent_asin"):
    """A ``foreachBatch`` function that appends each batch's value frequencies under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        compressed = value_frequencies(batch, F.col(key), F.col("rating")).withColumnsRenamed({"_key": key, "_value": "rating", "_n": "n"})
        compressed.write.mode("overwrite").parquet(f"{store.root}/{name}/batch={number}")

    return write


def item_means(store: VectorStore, name: str, key: str = "parent_asin") -> DataFrame:
    """``(key, n, mean)`` over all batches so far."""
    return store.read(name).groupBy(key).agg(F.sum("n").alias("n"), (F.sum(F.col("rating") * F.col("n")) / F.sum(F.when(F.col("rating").isNotNull(), F.col("n")))).alias("mean"))
