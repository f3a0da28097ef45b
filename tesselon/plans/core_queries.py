"""The queries of problems 1 and 5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions.keys import WHITE_SPACE, clean_key, epoch_millis, not_blank, utc_month
from tesselon.operators.event_features import entity_features
from tesselon.operators.key_profile import hot_keys, key_history, key_profile

#: A key with this share of all rows is reported as hot.
HOT = 0.01


def _train(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/train.parquet")


def valid_train(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows: keys in normal form and neither null nor blank, a rating."""
    # keys are made after the filter, which would otherwise make them too
    rows = _train(spark, d).where(F.col("rating").isNotNull() & not_blank("user_id") & not_blank("parent_asin"))
    return rows.select(clean_key("user_id").alias("user_id"), clean_key("parent_asin").alias("parent_asin"), "rating", "timestamp")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = {c: clean_key(c) for c in ("parent_asin", "user_id")}
    return hot_keys(_train(spark, d), keys, F.col("rating"), HOT).select("field", "hot_key")


def _profile(spark: SparkSession, d: str, key: str) -> DataFrame:
    rows = valid_train(spark, d)
    out = key_profile(rows, F.col(key), F.col("rating"), key_name=key, percentiles=(0.25, 0.5, 0.75))
    return out.select(key, "n_rows", "n_distinct", F.round("mean", 6).alias("mean_rating"), F.col("mode").alias("mode_rating"), "mode_count", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def p1_item_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "parent_asin")


def p1_user_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d, "user_id")


def p1_item_users(spark: SparkSession, d: str) -> DataFrame:
    """Per item: rows, exact number of different users, and the user with most rows."""
    out = key_profile(valid_train(spark, d), F.col("parent_asin"), F.col("user_id"), key_name="parent_asin")
    return out.select("parent_asin", "n_rows", F.col("n_distinct").alias("n_users"), F.col("mode").alias("top_user"), F.col("mode_count").alias("top_user_rows"))


def p1_user_times(spark: SparkSession, d: str) -> DataFrame:
    """Per user: median and 90th percentile of the event times, of which a busy user has very many."""
    rows = valid_train(spark, d).select("user_id", epoch_millis("timestamp").alias("t"))
    out = key_profile(rows, F.col("user_id"), F.col("t"), key_name="user_id", percentiles=(0.5, 0.9))
    return out.select("user_id", "n_rows", "n_valued", F.col("percentiles")[0].alias("median_ms"), F.col("percentiles")[1].alias("p90_ms"))


def p1_user_history(spark: SparkSession, d: str) -> DataFrame:
    """Every event of every user with its place in the user's history, chunk by chunk."""
    rows = valid_train(spark, d).select("user_id", "parent_asin", "rating", epoch_millis("timestamp").alias("t"))
    out = key_history(rows, F.col("user_id"), F.col("t"), 5_000, key_name="user_id", payload=("parent_asin", "rating"))
    # events without a time come first in no certain order, so their places are left out here
    seq = F.when(F.col("e.time").isNotNull(), F.col("e.seq"))
    return out.select("user_id", "chunk", F.explode("events").alias("e")).select("user_id", F.when(seq.isNotNull(), F.col("chunk")).alias("chunk"), seq.alias("seq"), F.col("e.time").alias("time_ms"), F.col("e.parent_asin").alias("parent_asin"), F.col("e.rating").alias("rating"))


def user_cells(spark: SparkSession, d: str) -> DataFrame:
    millis = epoch_millis("timestamp")
    half = (2 * F.col("rating")).cast("bigint")
    return entity_features(valid_train(spark, d).where("timestamp is not null"), F.col("user_id"), half, utc_month(millis), half, millis, distinct_by=("parent_asin", "rating", "timestamp"), entity_name="user_id")


def p5_user_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per user; summary columns beside a fixed-order text form of all cells, which SQL can repeat."""
    cell = lambda c: F.concat_ws(":", c["type_a"], c["type_b"], c["n"], c["total"], c["latest"])
    total = lambda f: F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c[f])
    return user_cells(spark, d).select("user_id", F.size("cells").cast("bigint").alias("n_types"), total("n").alias("n_events"), (total("total") / 2).alias("rating_total"), F.array_max(F.transform("cells", lambda c: c["latest"])).alias("last_ms"), F.md5(F.array_join(F.transform("cells", cell), ",")).alias("cells_md5"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = user_cells(spark, d).select("user_id", F.explode(F.filter("cells", lambda c: c["n"] >= 3)).alias("c"))
    return cells.select("user_id", F.col("c.type_a").alias("half_stars"), F.col("c.type_b").alias("yyyymm"))


QUERIES = {f.__name__: f for f in (p1_found, p1_item_profile, p1_user_profile, p1_item_users, p1_user_times, p1_user_history, p5_found, p5_user_features)}


def _sql_string(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


_KEY = "upper(trim({c}, " + _sql_string(WHITE_SPACE) + "))"
_USER, _ITEM = _KEY.format(c="user_id"), _KEY.format(c="parent_asin")
VALID_SQL = f"(select * from (select {_USER} as user_id, {_ITEM} as parent_asin, rating, timestamp from train) where user_id <> '' and parent_asin <> '' and rating is not null)"
_MS = "case when timestamp < 100000000000 then timestamp * 1000 else timestamp end"


def _profile_sql(key: str) -> str:
    return f"""
    with v as {VALID_SQL}, f as (select {key}, rating, count(*) as n from v group by all),
    m as (select {key}, rating as mode_rating, n as mode_count from f qualify row_number() over (partition by {key} order by n desc, rating) = 1)
    select v.{key}, count(*) as n_rows, count(distinct rating) as n_distinct, round(avg(rating), 6) as mean_rating, any_value(mode_rating) as mode_rating, any_value(mode_count) as mode_count,
    quantile_disc(rating, 0.25) as q1, quantile_disc(rating, 0.5) as median, quantile_disc(rating, 0.75) as q3 from v join m using ({key}) group by v.{key}"""


_CELLS_SQL = f"""
    with e as (select distinct user_id, parent_asin, rating, timestamp from {VALID_SQL} where timestamp is not null),
    c as (select user_id, cast(2 * rating as bigint) as half_stars, {_MS} as ms from e),
    g as (select user_id, half_stars, cast(strftime(make_timestamp(ms * 1000), '%Y%m') as bigint) as yyyymm, ms from c),
    cells as (select user_id, half_stars, yyyymm, count(*) as n, cast(sum(half_stars) as bigint) as total, max(ms) as latest from g group by all)"""

SQL = {
    "p1_found": f"""
    with t as (select count(*) as n from train), k as (select 'parent_asin' as field, {_ITEM} as hot_key from train union all select 'user_id', {_USER} from train)
    select field, hot_key from k where hot_key <> '' group by field, hot_key having count(*) >= 0.01 * (select n from t)""",
    "p1_item_profile": _profile_sql("parent_asin"),
    "p1_user_profile": _profile_sql("user_id"),
    "p1_item_users": f"""
    with f as (select parent_asin, user_id, count(*) as n from {VALID_SQL} group by all)
    select parent_asin, cast(sum(n) as bigint) as n_rows, count(*) as n_users, arg_min(user_id, struct_pack(a := -n, b := user_id)) as top_user, max(n) as top_user_rows from f group by parent_asin""",
    "p1_user_times": f"""
    with v as (select user_id, {_MS} as t from {VALID_SQL})
    select user_id, count(*) as n_rows, count(t) as n_valued, quantile_disc(t, 0.5) as median_ms, quantile_disc(t, 0.9) as p90_ms from v group by user_id""",
    "p1_user_history": f"""
    with v as (select user_id, parent_asin, rating, {_MS} as time_ms from {VALID_SQL}),
    s as (select *, case when time_ms is not null then row_number() over (partition by user_id order by time_ms nulls first, parent_asin, rating) end as seq from v)
    select user_id, cast((seq - 1) // 5000 as bigint) as chunk, seq, time_ms, parent_asin, rating from s""",
    "p5_found": _CELLS_SQL + "select user_id, half_stars, yyyymm from cells where n >= 3",
    "p5_user_features": _CELLS_SQL + """
    select user_id, count(*) as n_types, cast(sum(n) as bigint) as n_events, sum(total) / 2 as rating_total, max(latest) as last_ms,
    md5(string_agg(half_stars || ':' || yyyymm || ':' || n || ':' || total || ':' || latest, ',' order by half_stars, yyyymm)) as cells_md5 from cells group by user_id""",
}
