"""The tables as the engine's domain sees them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions.keys import clean_key, epoch_millis
from tesselon.operators.prep import deduplicate, keep_one, split_per_user
from tesselon.session import store_table
from tesselon.plans.core_queries import _ITEM, _MS, VALID_SQL, valid_train

#: Roots of this catalogue that say nothing about an item.
ROOTS = ("Harbour Goods", "Home & Yard")
CORE = 5
SEED = 42
#: A lexicon of words that occur in the invented texts (the default one has English opinions).
POSITIVE, NEGATIVE = ("and", "on", "the"), ("a", "is", "of", "to")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows with times in milliseconds."""
    return valid_train(spark, d).withColumn("timestamp", epoch_millis("timestamp"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """One row per user and item, the latest."""
    return deduplicate(ratings(spark, d))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the 80/20 split, which is computed once and kept as a table."""
    split = store_table(split_per_user(interactions(spark, d), 0.2, SEED))
    return split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")


def items(spark: SparkSession, d: str) -> DataFrame:
    """One row per item of the catalogue."""
    landed = spark.read.parquet(f"{d}/metadata.parquet").withColumn("parent_asin", clean_key("parent_asin"))
    return keep_one(landed, "parent_asin", item_order())


def item_order() -> list:
    return [F.col("price"), F.col("title"), F.coalesce(F.array_join("categories", "|"), F.lit(""))]


V = f"v as materialized (select user_id, parent_asin, rating, {_MS} as timestamp from {VALID_SQL})"
D = V + ", d as materialized (select * from v qualify row_number() over (partition by user_id, parent_asin order by (timestamp is not null) desc, timestamp desc, rating desc) = 1)"


def split_sql(source: str, out: str) -> str:
    return f"""{out} as materialized (select user_id, parent_asin, rating, timestamp, case when pos > n - least(greatest(1, round_even(n * cast(0.2 as double), 0)), n - 1) then 'test' else 'train' end as part from (
        select *, row_number() over (partition by user_id order by case when gap then md5('{SEED}|' || user_id || '|' || parent_asin) end, case when not gap then timestamp end, parent_asin) as pos, count(*) over (partition by user_id) as n
        from (select *, bool_or(timestamp is null) over (partition by user_id) as gap from {source})))"""


P = D + ", " + split_sql("d", "s") + ", tr as materialized (select user_id, parent_asin, rating, timestamp from s where part = 'train'), te as materialized (select user_id, parent_asin, rating, timestamp from s where part = 'test')"
M = f"m as materialized (select * replace ({_ITEM} as parent_asin) from metadata where parent_asin is not null qualify row_number() over (partition by {_ITEM} order by price desc, title desc, coalesce(array_to_string(categories, '|'), '') desc) = 1)"


def core_sql(k: int = CORE, rounds: int = 14) -> str:
    """The fixpoint unrolled; the last rounds change nothing."""
    steps, last = [], "d"
    for r in range(rounds):
        steps.append(f"c{r} as materialized (select * from {last} where user_id in (select user_id from {last} group by user_id having count(*) >= {k}) and parent_asin in (select parent_asin from {last} group by parent_asin having count(*) >= {k}))")
        last = f"c{r}"
    return ", ".join(steps) + f", core as (select * from {last})"
