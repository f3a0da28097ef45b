"""Features of users and items, from training rows and item tables only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions import text as T
from tesselon.functions.vectors import hash_embedding, l2_normalize, let
from tesselon.operators.prep import keep_one
from tesselon.session import store_table
from tesselon.sources import files

NUMERIC = ("price", "average_rating", "rating_number")
SENTIMENT = ("item_train_sentiment_mean", "item_rating_minus_sentiment_gap")
KEYS = ("user_id", "parent_asin", "timestamp")


def score_reviews(reviews: DataFrame, train: DataFrame, scorer: Callable[[Column], Column] = T.lexicon_sentiment, max_chars: int = 1000, max_rows: int | None = None) -> DataFrame:
    """Sentiment of those raw reviews whose (user, item, timestamp) is a training row; each duplicate is scored.

    ``scorer`` maps a text column to the struct of ``lexicon_sentiment``; a model plugs in as a vectorised UDF. Rows
    without a timestamp match nothing. Only the first ``max_chars`` characters count, which is part of the feature's
    definition; ``max_rows`` caps development runs.
    """
    if max_rows is not None and max_rows <= 0:
        raise ValueError("max_rows must be positive")
    kept = reviews.join(train.select(*KEYS).distinct(), list(KEYS), "left_semi")
    if max_rows is not None:
        kept = kept.orderBy(*KEYS).limit(max_rows)
    return kept.select(*KEYS, scorer(F.substring(F.coalesce("text", F.lit("")), 1, max_chars)).alias("_s")).select(*KEYS, "_s.*")


def with_sentiment(train: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Every training row with its sentiment score, or null; of repeated scores for a key one is kept (the greatest)."""
    one = sentiment.groupBy(*KEYS).agg(F.max("sentiment_score").alias("sentiment_score"))
    return train.join(one, list(KEYS), "left")


def user_aggregates(train: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per user: mean and population deviation of ratings and sentiment (0 where there is none), their gap and its negative."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = with_sentiment(train, sentiment).groupBy("user_id").agg(
        F.avg("rating").alias("user_mean_rating"), zero(F.stddev_pop("rating")).alias("user_rating_std"),
        zero(F.avg("sentiment_score")).alias("user_review_sentiment_mean"), zero(F.stddev_pop("sentiment_score")).alias("user_review_sentiment_std"),
    )
    gap = F.col("user_mean_rating") - F.col("user_review_sentiment_mean")
    return out.withColumns({"user_rating_minus_sentiment_gap": gap, "user_strictness_score": -gap})


def item_aggregates(train: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per item: mean rating, mean and number of sentiment scores (0 where there are none) and the gap."""
    out = with_sentiment(train, sentiment).groupBy("parent_asin").agg(
        F.avg("rating").alias("item_mean_rating"), F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("item_train_sentiment_mean"), F.count("sentiment_score").alias("item_train_sentiment_count"),
    )
    return out.withColumn("item_rating_minus_sentiment_gap", F.col("item_mean_rating") - F.col("item_train_sentiment_mean"))


def generosity(aggregates: DataFrame, global_mean: float | None = None) -> DataFrame:
    """``(user_id, offset)``: how far a user's gap (or mean rating) lies from the mean over users, between -1 and 1."""
    if "user_rating_minus_sentiment_gap" in aggregates.columns:
        value, centre = F.col("user_rating_minus_sentiment_gap"), aggregates.agg(F.avg("user_rating_minus_sentiment_gap").alias("_m"))
    else:
        value, centre = F.col("user_mean_rating"), aggregates.agg(F.max(F.lit(global_mean)).alias("_m"))
    return aggregates.join(centre, F.lit(True)).select("user_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value - F.col("_m"))).alias("offset"))


def rating_facts(train: DataFrame, key: str, positive_from: float = 4.0) -> DataFrame:
    return train.groupBy(key).agg(F.avg("rating").alias("mean_rating"), F.count("rating").cast("double").alias("rating_count"), F.avg((F.col("rating") >= positive_from).cast("double")).alias("positive_ratio"))


def user_node_features(train: DataFrame, users: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """Of the users listed: mean rating, rows, share of ratings from 4, and the generosity offset if given; zeros for cold users."""
    out = users.join(rating_facts(train, "user_id"), "user_id", "left")
    columns = ["mean_rating", "rating_count", "positive_ratio"]
    if offsets is not None:
        out = out.join(offsets.withColumnRenamed("offset", "generosity_offset"), "user_id", "left")
        # a cold user is zero in every column
        out = out.withColumn("generosity_offset", F.when(F.col("mean_rating").isNotNull(), F.col("generosity_offset")))
        columns.append("generosity_offset")
    return out.select("user_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def structure_features(train: DataFrame, items: DataFrame) -> DataFrame:
    """Of the items listed: log(1 + rows), mean rating, share of ratings from 4; zeros for cold items."""
    facts = rating_facts(train, "parent_asin").select("parent_asin", F.log1p("rating_count").alias("log_degree"), "mean_rating", "positive_ratio")
    return items.join(facts, "parent_asin", "left").select("parent_asin", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("log_degree", "mean_rating", "positive_ratio")])


def category_vocab(items: DataFrame, labels: Column, max_vocab: int = 256, min_doc_freq: int = 5) -> DataFrame:
    """``(category, df, col)``: labels in at least ``min_doc_freq`` items, most frequent first, then by name; ``col`` from 0."""
    counts = items.select(F.explode(labels).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_doc_freq)
    top = counts.orderBy(F.desc("df"), "category").limit(max_vocab)
    every = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("o"), "category"))), lambda s: s)
    return top.agg(every.alias("v")).select(F.posexplode("v").alias("col", "s")).select(F.col("s.category").alias("category"), (-F.col("s.o")).alias("df"), "col")


def vocab_list(vocab: DataFrame) -> list[str]:
    """The vocabulary on the driver; ``category_vocab`` bounds it by ``max_vocab``."""
    return [r["category"] for r in vocab.orderBy("col").collect()]


def write_category_artifacts(folder: str, items: DataFrame, labels: Column, dataset: str, max_vocab: int = 256, min_doc_freq: int = 5) -> None:
    """Vocabulary, flags of all items and a description under a folder: category_vocab.json, item_features.parquet, item_features_meta.json."""
    spark = items.sparkSession
    vocab = vocab_list(category_vocab(items, labels, max_vocab, min_doc_freq))
    files.write_json(spark, files.joined(folder, "category_vocab.json"), vocab)
    items.select("parent_asin", multi_hot(labels, vocab).alias("features")).write.mode("overwrite").parquet(files.joined(folder, "item_features.parquet"))
    files.write_json(spark, files.joined(folder, "item_features_meta.json"), {"dataset": dataset, "vocab_size": len(vocab), "row_count": items.count(), "version": 1})


def multi_hot(labels: Column, vocab: Sequence[str]) -> Column:
    known = F.array(*[F.lit(c) for c in vocab]) if vocab else F.array().cast("array<string>")
    return let(labels, lambda own: F.transform(known, lambda c: F.array_contains(own, c).cast("double")))


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as (x - mean) / population deviation; a constant column becomes 0."""
    stats = df.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats), F.lit(True))  # one row
    return out.withColumns({c: (F.col(c).cast("double") - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


def embed_text(df: DataFrame) -> Column:
    """Title and description where the table has one of them, else text."""
    if "title" in df.columns or "description" in df.columns:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("title", "description")]
        return F.trim(F.concat_ws(" ", *parts))
    return F.coalesce("text", F.lit(""))


#: Which groups of columns a feature set keeps: text, categories, numbers, item sentiment, the user's generosity offset.
FEATURE_SETS = {
    "full": (True, True, True, True, True),
    "no_text": (False, True, True, True, True),
    "no_sentiment": (True, True, True, False, False),
    "metadata_only": (False, True, True, False, False),
    "structure_only": (False, False, False, False, False),
}


def item_node_features(items: DataFrame, order: Sequence[Column], *, labels: Column | None = None, aggregates: DataFrame | None = None, generic_roots: Sequence[str] = (), max_vocab: int = 256, min_doc_freq: int = 5, dim: int = 32, embedder: Callable[[Column], Column] | None = None, use_text: bool = True, use_categories: bool = True, use_numeric: bool = True, use_item_sentiment: bool = True) -> DataFrame:
    """``(parent_asin, features)``: text embedding, category flags, standardised numbers and item sentiment, of length 1.

    A group that is switched off is left out, not zeroed. Of repeated items the last in ``order`` is kept. Without
    ``aggregates`` there is no sentiment group; items that lack in it have zeros there before standardising.
    """
    rows = store_table(keep_one(items, "parent_asin", list(order)))  # read for the vocabulary, the numbers' means and the features
    parts: list[Column] = []
    if use_text:
        parts.append((embedder or (lambda c: hash_embedding(c, dim)))(embed_text(rows)))
    if use_categories:
        label = labels if labels is not None else T.filter_categories(F.col("categories"), generic_roots)
        rows = rows.withColumn("_labels", label)
        parts.append(multi_hot(F.col("_labels"), vocab_list(category_vocab(rows, F.col("_labels"), max_vocab, min_doc_freq))))
    if use_numeric:
        rows = standardized(rows, NUMERIC)
        parts.append(F.array(*[F.col(c) for c in NUMERIC]))
    if use_item_sentiment and aggregates is not None:
        aggregates = store_table(aggregates.select("parent_asin", *SENTIMENT))
        rows = rows.join(aggregates, "parent_asin", "left").fillna(0.0, subset=list(SENTIMENT))
        rows = standardized(rows, SENTIMENT)
        parts.append(F.array(*[F.col(c) for c in SENTIMENT]))
    return rows.select("parent_asin", l2_normalize(F.concat(*parts) if parts else F.array().cast("array<double>")).alias("features"))


def content_hash(df: DataFrame, name: str, *order: str) -> DataFrame:
    """One row: the sha256 over a model name, ids and texts, made of row hashes so no task gathers the texts."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    low = df.select(F.substring(row, 1, 2).alias("_p"), row.alias("_h")).groupBy("_p").agg(F.sum(F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring("_h", 16, 15), 16, 10).cast("decimal(38,0)")).alias("b"))
    return low.agg(F.sha2(F.concat_ws("|", F.lit(name), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_p", "a", "b"))), ",")), 256).alias("content_hash"))
