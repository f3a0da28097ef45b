"""Rating errors, sampled-candidate ranking metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tesselon.operators.ranking import number_keys, top_per_key
from tesselon.session import store_table

BUNDLE = ("precision_at_k", "recall_at_k", "f1_at_k", "hit_rate_at_k", "ndcg_at_k", "oracle_precision_at_k", "oracle_recall_at_k", "oracle_f1_at_k", "oracle_hit_rate_at_k", "oracle_ndcg_at_k")


def rating_errors(df: DataFrame, actual: str = "rating", estimate: str = "est") -> DataFrame:
    """One row: ``rmse`` and ``mae``; null for an empty table."""
    gap = F.col(actual) - F.col(estimate)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def relevant_items(test: DataFrame, threshold: float = 4.0) -> DataFrame:
    """``(user_id, parent_asin)``: the distinct test items a user rated at ``threshold`` or more."""
    return test.where(F.col("rating") >= threshold).select("user_id", "parent_asin").distinct()


def _probe(seed: int, user: Column, j: Column, n_items: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), user, j.cast("string"))), 25, 8), 16, 10).cast("bigint"), F.lit(n_items))


def sample_negatives(users: DataFrame, catalog: DataFrame, exclude: DataFrame, n: int, seed: int = 42, probes: int | None = None) -> DataFrame:
    """``(user_id, parent_asin)``: ``n`` different catalog items per user, none of the user's ``exclude`` pairs.

    Numbered items are probed at pseudo-random places (md5 of seed, user and number of the probe), and the first ``n``
    that aren't excluded are taken; users whose probes don't give enough get the rest by scanning the catalog in order,
    and fewer than ``n`` only if the catalog has no more.

    First somewhat more than ``n`` probes are drawn, and all ``probes`` (3 ``n`` by default) only for users who fall
    short of ``n`` then. The scan takes ranges of places, each larger than the one before, for those users who still lack
    items. Such users have excluded most of a catalog that is large beside ``n``, so the ranges hold about as many rows
    as ``exclude`` has of these users. Users are distinct; rows with a null user give none.
    """
    items = catalog.select("parent_asin").distinct()
    users = users.select("user_id").where(F.col("user_id").isNotNull())
    if n <= 0:
        return users.join(items, F.lit(False))
    places = store_table(number_keys(items, "parent_asin", "pos"))
    size = places.count()
    if size == 0:
        return users.join(items, F.lit(False))
    context = users.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = store_table(exclude.join(places, "parent_asin").select("user_id", "pos").distinct())

    def free(asked: DataFrame, tries: int) -> DataFrame:
        drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda j: _probe(seed, F.col("user_id"), j, size)))
        drawn = asked.repartition(tasks, "user_id").select("user_id", F.posexplode(drawn).alias("j", "pos"))
        return store_table(top_per_key(drawn.join(taken, ["user_id", "pos"], "left_anti"), ["user_id"], [F.col("j")], n, "_r").select("user_id", "pos"))

    def lacking(asked: DataFrame, got: DataFrame, wanted: Column) -> DataFrame:
        """Of the users asked those who need more, and how many."""
        had = got.groupBy("user_id").agg(F.count(F.lit(1)).alias("_c"))
        need = wanted - F.coalesce("_c", F.lit(0))
        return store_table(asked.join(had, "user_id", "left").where(need > 0).select("user_id", need.alias("_need")))

    tries = probes or 3 * n
    chosen = free(users, min(tries, n + n // 3 + 8))
    short = lacking(users, chosen, F.lit(n))
    if short.limit(1).count():
        again = free(short.select("user_id"), tries)
        chosen = chosen.join(short, "user_id", "left_anti").unionByName(again)
        short, low, width = lacking(short.select("user_id"), again, F.lit(n)), 0, 4 * n
        while low < size and short.limit(1).count():
            high = min(size, low + width)
            range_ = short.repartition(tasks, "user_id").select("user_id", "_need", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))).alias("pos"))
            range_ = range_.join(taken, ["user_id", "pos"], "left_anti").join(again, ["user_id", "pos"], "left_anti")
            got = range_.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("pos"))).where("_r <= _need").select("user_id", "pos")
            got = store_table(got)
            chosen = chosen.unionByName(got)
            short, low, width = lacking(short, got, F.col("_need")), high, 8 * width
    return chosen.join(places, "pos").select("user_id", "parent_asin")


def seen_or_relevant(train: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(user_id, parent_asin)``: what can't be a negative item of a user."""
    return train.select("user_id", "parent_asin").unionByName(relevant).distinct()


def candidates(train: DataFrame, test: DataFrame, n: int = 100, threshold: float = 4.0, seed: int = 42) -> DataFrame:
    """``(user_id, parent_asin, is_rel)``: each ranking user's relevant test items and ``n`` sampled negatives."""
    relevant = relevant_items(test, threshold)
    exclude = seen_or_relevant(train, relevant)
    users = relevant.select("user_id").distinct()
    negatives = sample_negatives(users, train, exclude, n, seed)
    return relevant.withColumn("is_rel", F.lit(1)).unionByName(negatives.withColumn("is_rel", F.lit(0)))


def rank_candidates(scored: DataFrame, seen: DataFrame, k: int, tie_break: str = "positives_first") -> DataFrame:
    """The top ``k`` unseen candidates of each user by descending ``score`` as ``rank``.

    Ties go to relevant items first ('positives_first', the order in which candidates are listed) or by item ('item_id').
    """
    if tie_break not in ("positives_first", "item_id"):
        raise ValueError(f"unknown tie break: {tie_break!r}")
    pool = scored.join(seen.select("user_id", "parent_asin").distinct(), ["user_id", "parent_asin"], "left_anti")
    order = [F.desc("score"), *([F.desc("is_rel")] if tie_break == "positives_first" else []), F.col("parent_asin")]
    return top_per_key(pool, ["user_id"], order, k)


def user_bundles(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per user with a relevant item: precision, recall, F1, hit rate, NDCG at ``k`` and the oracle's; precision is over ``k`` always."""
    hits = ranked.where("rank <= " + str(k)).join(relevant.select("user_id", "parent_asin"), ["user_id", "parent_asin"], "left_semi")
    hits = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    rows = relevant.groupBy("user_id").agg(F.countDistinct("parent_asin").alias("_n")).join(hits, "user_id", "left")
    h, n, dcg = F.coalesce("_h", F.lit(0)), F.col("_n"), F.coalesce("_dcg", F.lit(0.0))
    best = F.least(F.lit(k), n)
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    f1 = lambda p, r: F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    p, r, op, orc = h / F.lit(k), h / n, best / F.lit(k), best / n
    values = (p, r, f1(p, r), (h > 0).cast("double"), dcg / ideal, op, orc, f1(op, orc), F.lit(1.0), F.lit(1.0))
    return rows.select("user_id", *[v.alias(c) for v, c in zip(values, BUNDLE, strict=True)])


def aggregate_bundles(bundles: DataFrame, k: int) -> DataFrame:
    """One row: means over users and, of precision, recall and F1, the ratio of mean to mean oracle; nulls if there are no users."""
    out = bundles.agg(F.count(F.lit(1)).alias("n_eval_users"), *[F.avg(c).alias(c) for c in BUNDLE]).withColumn("k", F.lit(k))
    return out.withColumns({f"{m}_oracle_ratio_at_k": F.col(f"{m}_at_k") / F.nullif(F.col(f"oracle_{m}_at_k"), F.lit(0.0)) for m in ("precision", "recall", "f1")})


def linear_calibration(df: DataFrame, raw: str = "raw", actual: str = "rating") -> DataFrame:
    """One row (beta, intercept): least squares of the rating on a raw score; (0, mean rating) if the score is constant."""
    constant = F.coalesce(F.stddev_pop(raw), F.lit(0.0)) == 0
    return df.agg(F.when(constant, F.lit(0.0)).otherwise(F.regr_slope(actual, raw)).alias("beta"), F.when(constant, F.avg(actual)).otherwise(F.regr_intercept(actual, raw)).alias("intercept"))
