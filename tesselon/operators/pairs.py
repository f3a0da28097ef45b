"""Pairs of elements found in one basket, without a task that holds a large basket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.session import store_table

#: Baskets up to this size are multiplied out in one row; larger ones are cut into chunks of about this many elements.
CHUNK = 256
#: The sizes of large baskets are sent to all tasks only if these are no more than this.
SMALL_SIDE = 10_000


def basket_pairs(rows: DataFrame, pair: Callable[[Column, Column], Column], chunk: int = CHUNK) -> DataFrame:
    """One column ``p``: what ``pair(a, b)`` makes of every two elements of one basket, ``a`` before ``b``.

    ``rows`` has the columns ``basket`` and ``item``, and any others to carry; an element is a struct of ``item`` and
    these. Elements are ordered by ``item``, and rows of one basket and item are to be distinct. ``rows`` is read twice.

    Every basket is cut into k chunks by a hash of the item, k being 1 up to ``chunk`` items. A pair of chunks is a row
    of its own, which any task can multiply out, so a basket of any size is spread. Only large baskets' k are joined to
    the rows: broadcast if they are few, else by basket and a hash of the item, so no task meets a whole basket there.
    """
    carried = [c for c in rows.columns if c != "basket"]
    sizes = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("_s")).where(F.col("_s") > chunk)
    large = store_table(sizes.select("basket", F.ceil(F.col("_s") / F.lit(chunk)).cast("bigint").alias("_k")))
    n_large = large.count()
    if n_large <= SMALL_SIDE:
        cut = rows.join(F.broadcast(large), "basket", "left") if n_large else rows.withColumn("_k", F.lit(1).cast("bigint"))
    else:
        dealt = large.select("basket", "_k", F.explode(F.sequence(F.lit(0), F.lit(chunk - 1))).alias("_salt"))
        cut = rows.withColumn("_salt", F.pmod(F.xxhash64("item", F.lit(1)), F.lit(chunk))).join(dealt, ["basket", "_salt"], "left")
    k = F.coalesce("_k", F.lit(1))
    cut = cut.select("basket", F.struct(*carried).alias("e"), F.pmod(F.xxhash64("item"), k).alias("_c"), F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("_o"))
    gathered = lambda mine: F.array_sort(F.collect_list(F.when(mine, F.col("e"))))
    x, y, own = F.least("_c", "_o").alias("_x"), F.greatest("_c", "_o").alias("_y"), F.col("_c") <= F.col("_o")
    blocks = cut.groupBy("basket", x, y).agg(gathered(own).alias("_l"), gathered(~own).alias("_r"))
    within = F.flatten(F.transform("_l", lambda a, i: F.transform(F.slice("_l", i + 2, F.size("_l")), lambda b: pair(a, b))))
    ordered = lambda a, b: F.when(a["item"] < b["item"], pair(a, b)).otherwise(pair(b, a))
    across = F.flatten(F.transform("_l", lambda a: F.transform("_r", lambda b: ordered(a, b))))
    return blocks.where((F.col("_x") < F.col("_y")) | (F.size("_l") > 1)).select(F.explode(F.when(F.col("_x") == F.col("_y"), within).otherwise(across)).alias("p"))


def item_pair(a: Column, b: Column) -> Column:
    return F.struct(a["item"].alias("a"), b["item"].alias("b"))
