"""From landed records to clean interactions, items and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.functions import text as T
from tesselon.operators.ranking import add_position, sample_exactly, stable_order
from tesselon.session import drop_table, store_table

#: Milliseconds in a slot of positions: ranking within a user orders a month at a time.
SLOT_MS = 30 * 86_400_000


def load_interactions(records: DataFrame) -> DataFrame:
    """The four interaction columns of the records that have a user, an item and a rating; missing columns are null."""
    kinds = {"user_id": "string", "parent_asin": "string", "rating": "double", "timestamp": "bigint"}
    chosen = [(F.col(c) if c in records.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return records.select(*chosen).dropna(subset=["user_id", "parent_asin", "rating"])


def raw_and_kept(records: DataFrame) -> DataFrame:
    """One row: how many records there are and how many of them ``load_interactions`` keeps, in one pass."""
    whole = F.lit(True)
    for c in ("user_id", "parent_asin", "rating"):
        whole = whole & (F.col(c).isNotNull() if c in records.columns else F.lit(False))
    return records.agg(F.count(F.lit(1)).alias("raw"), F.count_if(whole).alias("kept"))


def deduplicate(df: DataFrame, policy: str = "latest", tie: tuple[str, ...] = ("rating",)) -> DataFrame:
    """One row per (user_id, parent_asin): the latest or the first; rows without a timestamp are before all others.

    Ties on the timestamp are decided by the ``tie`` columns, the greatest for 'latest' and the least for 'first'. As the
    choice is a maximum (minimum), partial results are combined before the shuffle and no pair is gathered in a task.
    """
    if policy not in ("latest", "first"):
        raise ValueError(f"unknown dedup policy: {policy!r}")
    keys = ("user_id", "parent_asin")
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col("timestamp").isNotNull().alias("_k0"), F.coalesce("timestamp", F.lit(0)).alias("_k1"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)])
    pick = F.max_by if policy == "latest" else F.min_by
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
    return chosen.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def k_core(df: DataFrame, k: int, max_rounds: int = 200) -> DataFrame:
    """The interactions that remain when users and items with fewer than ``k`` of them are removed again and again.

    Each round counts both sides at once on the same rows and drops by anti joins with the keys that are too rare, so
    the rows of frequent keys meet no partner; rounds end when nothing is dropped. Each round's rows are a table in the
    shared folder. Rows are expected to be distinct pairs. ``k`` below 2 changes nothing.
    """
    current, n = df, -1
    for _ in range(max_rounds):
        rare = {c: current.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k).select(c) for c in ("user_id", "parent_asin")}
        nxt = current
        for c, keys in rare.items():
            nxt = nxt.join(keys, c, "left_anti")
        nxt = store_table(nxt.select(*df.columns))
        if current is not df:
            drop_table(current)
        kept = nxt.count()
        if kept == n or kept == 0:
            return nxt
        current, n = nxt, kept
    raise RuntimeError("k-core did not settle")


def _position(df: DataFrame, order: list[Column], slot: Column) -> DataFrame:
    return add_position(df, "user_id", order, slot)


def split_per_user(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` 'train' or 'test': of each user the latest ``test_size`` of the rows are the test.

    Users with one row are all train, others have at least one row in both parts; the number is rounded half to even. A
    user with any missing timestamp gets a pseudo-random order instead. Ties are ordered by item.
    """
    gaps = df.groupBy("user_id").agg(F.count_if(F.col("timestamp").isNull()).alias("_g")).where("_g > 0").select(F.col("user_id").alias("_gu"))
    rows = df.join(gaps, F.col("user_id") == F.col("_gu"), "left").withColumn("_h", F.when(F.col("_gu").isNotNull(), stable_order(seed, F.col("user_id"), F.col("parent_asin"))))
    time = F.when(F.col("_gu").isNull(), F.col("timestamp"))
    slot = F.coalesce(F.floor(time / SLOT_MS), F.conv(F.substring("_h", 1, 2), 16, 10).cast("bigint"))
    placed = _position(rows, [time, F.col("_h"), F.col("parent_asin")], slot)
    n_test = F.least(F.greatest(F.lit(1), F.bround(F.col("_cnt") * F.lit(float(test_size)))), F.col("_cnt") - 1)
    return placed.withColumn("part", F.when(F.col("_pos") > F.col("_cnt") - n_test, "test").otherwise("train")).select(*df.columns, "part")


def split_leave_last_out(df: DataFrame) -> DataFrame:
    """``df`` with ``part``: a user's last row is 'test', the one before it 'validation', the rest 'train'.

    With two rows there is no validation, with one only train. Rows without a timestamp come last. Ties are ordered by item.
    """
    late = F.col("timestamp").isNull()
    placed = _position(df, [late, F.col("timestamp"), F.col("parent_asin")], F.when(late, F.lit(2**62)).otherwise(F.floor(F.col("timestamp") / SLOT_MS)))
    back = F.col("_cnt") - F.col("_pos")
    part = F.when((back == 0) & (F.col("_cnt") >= 2), "test").when((back == 1) & (F.col("_cnt") >= 3), "validation").otherwise("train")
    return placed.withColumn("part", part).select(*df.columns, "part")


def split_validation(train: DataFrame, fraction: float) -> DataFrame:
    """``train`` with ``part`` 'train' or 'validation': the last ``fraction`` (rounded down, at least one of two rows) of each user."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    late = F.col("timestamp").isNull()
    placed = _position(train, [late, F.col("timestamp"), F.col("parent_asin")], F.when(late, F.lit(2**62)).otherwise(F.floor(F.col("timestamp") / SLOT_MS)))
    n = F.floor(F.col("_cnt") * F.lit(float(fraction)))
    n = F.when((n == 0) & (F.col("_cnt") >= 2), F.lit(1)).otherwise(n)
    n = F.when(n >= F.col("_cnt"), F.lit(0)).otherwise(n)
    return placed.withColumn("part", F.when(F.col("_pos") > F.col("_cnt") - n, "validation").otherwise("train")).select(*train.columns, "part")


def cap_users(df: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """The rows of exactly ``n`` users, pseudo-randomly chosen (all, if there are no more)."""
    if n is None:
        return df
    chosen = sample_exactly(df.select("user_id").distinct(), n, seed, F.col("user_id"))
    return df.join(chosen, "user_id", "left_semi")


def cap_rows(df: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    return sample_exactly(df, n, seed, F.col("user_id"), F.col("parent_asin"))


def keep_one(df: DataFrame, key: str, order: list[Column], last: bool = True) -> DataFrame:
    """One row per key: that with the greatest (least) ``order``; rows with a null key are left out."""
    rest = [c for c in df.columns if c != key]
    by = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    chosen = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.max_by if last else F.min_by)(F.struct(*rest), by).alias("_r"))
    return chosen.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def prepare_metadata(records: DataFrame) -> DataFrame:
    """The closed item table from landed item records; columns are strings, arrays of strings or numbers, and may be missing.

    Null keys are left out. ``text`` is title, description and categories with tags, entities and white space cleaned.
    Missing prices, ratings and counts are 0 with a flag.
    """

    def text_of(name: str) -> Column:
        if name not in records.columns:
            return F.lit("")
        return T.join_text(F.col(name)) if records.schema[name].dataType.typeName() == "array" else F.coalesce(F.col(name).cast("string"), F.lit(""))

    def number_of(name: str, kind: str) -> tuple[Column, Column]:
        value = F.col(name).cast(kind) if name in records.columns else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(0).cast(kind)), value.isNull()

    title, description, categories = (text_of(c) for c in ("title", "description", "categories"))
    price, price_missing = T.parse_price(text_of("price"))
    rating, rating_missing = number_of("average_rating", "double")
    count, count_missing = number_of("rating_number", "bigint")
    return records.where(F.col("parent_asin").isNotNull()).select(
        F.col("parent_asin").cast("string").alias("parent_asin"), title.alias("title"), description.alias("description"),
        T.clean_text(F.concat_ws(" ", title, description, categories)).alias("text"), categories.alias("categories"), text_of("store").alias("store"),
        price.alias("price"), price_missing.alias("price_missing"), rating.alias("average_rating"), rating_missing.alias("average_rating_missing"), count.alias("rating_number"), count_missing.alias("rating_number_missing"),
    )


def prepare_variant_metadata(records: DataFrame, column: str = "v") -> DataFrame:
    """``prepare_metadata`` for records read as one variant column, whose fields may be scalars in some rows and lists in others."""
    v = F.col(column)
    names = ("title", "description", "categories", "store", "price")
    flat = records.select(F.try_variant_get(v, "$.parent_asin", "string").alias("parent_asin"), *[T.variant_text(v, f"$.{c}").alias(c) for c in names], F.try_variant_get(v, "$.average_rating", "double").alias("average_rating"), F.try_variant_get(v, "$.rating_number", "bigint").alias("rating_number"))
    return prepare_metadata(flat)


def restrict(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of ``df`` whose key columns occur in ``keys`` (nulls match nothing)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")
