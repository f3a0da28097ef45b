"""Items that appear together in a basket, and how much more often than chance (problem 4): large-basket blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.operators.pairs import CHUNK, basket_pairs, item_pair
from tesselon.session import store_table


def cooccurrence(df: DataFrame, basket: Column, item: Column, *, min_count: int = 1, min_lift: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """One row per pair of items found in one basket: ``(item_a, item_b, weight_count, n_a, n_b, weight_jaccard, lift)``.

    ``item_a < item_b``. ``weight_count`` is the number of baskets with both, ``n_a`` and ``n_b`` the baskets of each,
    ``weight_jaccard`` the share of both in either, ``lift`` the count over that expected by chance, n_a * n_b / baskets.
    Repeated rows count once; rows with a null basket or item are left out; an empty table gives no rows.

    ``min_count`` and ``min_lift`` keep the pairs that reach them, and exactly these: as a pair's count is at most the
    lesser of n_a and n_b, items in fewer than ``min_count`` baskets, or in more than baskets / ``min_lift``, can't be in
    any such pair and are set aside before pairs are made.

    A basket above ``chunk`` items is cut into item chunks by hash, and each pair of its chunks is a row of its own that
    any task can multiply out; no task holds a whole large basket (``basket_pairs``). Pairs are combined by partial counts
    before the shuffle. With neither least every pair ever seen together comes out, up to the sum of the squares of all
    baskets: at scale give a ``min_count``.
    """
    rows = store_table(df.select(basket.alias("basket"), item.alias("item")).where("basket is not null and item is not null").distinct())
    n_baskets = rows.agg(F.count_distinct("basket")).first()[0]
    items = store_table(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    useful = rows
    if min_lift > 0 or min_count > 1:
        most = F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n_baskets))
        useful = store_table(rows.join(items.where((F.col("n") >= min_count) & most).select("item"), "item", "left_semi"))
    counts = basket_pairs(useful, item_pair, chunk).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight_count")).where(F.col("weight_count") >= min_count)
    counts = counts.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    product = F.col("n_a").cast("double") * F.col("n_b")
    out = counts.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "weight_count", "n_a", "n_b",
        (F.col("weight_count") / (F.col("n_a") + F.col("n_b") - F.col("weight_count"))).alias("weight_jaccard"),
        (F.col("weight_count") * F.lit(float(n_baskets)) / product).alias("lift"),
    )
    return out.where(F.col("weight_count") * F.lit(float(n_baskets)) >= F.lit(float(min_lift)) * product) if min_lift > 0 else out
