"""Summaries of interaction and item tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def sparsity(n: Column, users: Column, items: Column) -> Column:
    """1 - n / (users * items); null where there are no users or items."""
    return 1 - n / F.nullif(users * items, F.lit(0))


def rating_histogram(df: DataFrame) -> DataFrame:
    """``(rating, n)`` with ratings rounded half to even to one decimal."""
    return df.groupBy(F.bround("rating", 1).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


def degrees(df: DataFrame, key: str) -> DataFrame:
    """``(key, degree)``: rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("degree"))


def min_degree(df: DataFrame, key: str) -> DataFrame:
    """One row: the least number of rows of a key, 0 for an empty table."""
    return degrees(df, key).agg(F.coalesce(F.min("degree"), F.lit(0)).alias("min_degree"))


def table_facts(df: DataFrame, prefix: str, relevant_from: float = 4.0) -> DataFrame:
    """One row with rows, exact distinct users and items, sparsity, share of relevant ratings and least degrees."""
    users, items = degrees(df, "user_id"), degrees(df, "parent_asin")
    u = users.agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.min("degree"), F.lit(0)).alias("least_u"), F.coalesce(F.sum("degree"), F.lit(0)).alias("n"))
    i = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.min("degree"), F.lit(0)).alias("least_i"))
    r = df.agg(F.avg((F.col("rating") >= relevant_from).cast("double")).alias("relevant"))
    one = u.join(i, F.lit(True)).join(r, F.lit(True))  # three single rows
    return one.select(
        F.col("n").alias(f"{prefix}_rows"), F.col("users").alias(f"{prefix}_users"), F.col("items").alias(f"{prefix}_items"), sparsity(F.col("n"), F.col("users"), F.col("items")).alias(f"{prefix}_sparsity"),
        F.col("relevant").alias(f"{prefix}_pct_relevant"), F.col("least_u").alias(f"{prefix}_min_user_degree"), F.col("least_i").alias(f"{prefix}_min_item_degree"),
    )


def missingness(metadata: DataFrame) -> DataFrame:
    """One row: the share of items whose price, average rating and rating number are missing."""
    return metadata.agg(*[F.avg(F.col(f"{c}_missing").cast("double")).alias(f"{c}_missing_rate") for c in ("price", "average_rating", "rating_number")])


def only_in(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys of ``first`` don't occur in ``second``."""
    return first.select(key).subtract(second.select(key)).agg(F.count(F.lit(1)).alias("n"))


def summarize_values(df: DataFrame, value: str, whole: bool) -> DataFrame:
    """count, min, max, mean, median, std (population) of a column; of whole numbers the median is cut off; zeros if empty."""
    v = F.col(value)
    median = F.percentile(v, F.lit(0.5))
    median = median.cast("bigint") if whole else median
    return df.agg(F.count(v).alias("count"), *[F.coalesce(x, F.lit(0)).alias(n) for n, x in (("min", F.min(v)), ("max", F.max(v)), ("mean", F.avg(v)), ("median", median), ("std", F.stddev_pop(v)))])


def funnel(facts: DataFrame, columns: list[str]) -> DataFrame:
    """``(stage, n)``: the named counts of a one-row table as rows, in order; columns it lacks are left out."""
    present = [c for c in columns if c in facts.columns]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("stage"), F.col(c).cast("bigint").alias("n")) for i, c in enumerate(present)])).alias("s")).select("s.pos", "s.stage", "s.n")


def histogram_text(df: DataFrame, name: str) -> DataFrame:
    """One row: the rating histogram as text such as '4.0:12,5.0:3'."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("rating", "n"))), lambda c: F.concat_ws(":", c["rating"].cast("string"), c["n"].cast("string")))
    return rating_histogram(df).agg(F.array_join(cells, ",").alias(name))


def summarize(raw: DataFrame, valid: DataFrame, dedup: DataFrame, core: DataFrame, train: DataFrame, test: DataFrame, relevant_from: float = 4.0) -> DataFrame:
    """One row of the 17 facts of a preparation, from landed rows to the split; the shares of an empty table are null."""
    rows = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    before, after = table_facts(dedup, "dedup", relevant_from), table_facts(core, "kcore", relevant_from)
    one = reduce(lambda a, b: a.join(b, F.lit(True)), [rows(raw, "raw_rows"), rows(valid, "valid_rows"), before, after, rows(train, "train_rows"), rows(test, "test_rows"), histogram_text(dedup, "dedup_ratings"), histogram_text(core, "kcore_ratings")])  # single rows
    return one.drop("dedup_pct_relevant", "dedup_min_user_degree", "dedup_min_item_degree")
