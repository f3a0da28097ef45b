"""The contract of all recommenders: set-oriented fit, predict and recommend."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.operators.metrics import rank_candidates

#: Catalogue items that one block of a whole-catalogue recommendation holds.
BLOCK = 5_000


def clip(x: Column) -> Column:
    """To the rating scale 1 to 5."""
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), x))


class Recommender(ABC):
    """``fit`` keeps small keyed tables; ``predict`` and ``recommend`` join with them, for any number of pairs at once."""

    is_fitted = False

    def fit(self, train: DataFrame, metadata: DataFrame | None = None) -> Recommender:
        """From training rows (user_id, parent_asin, rating) and, for some models, an item table."""
        self.remember(train)
        self._fit(train, metadata)
        self.is_fitted = True
        return self

    def remember(self, train: DataFrame) -> None:
        """What every model keeps of the training rows."""
        self.train = train
        self.item_means = train.groupBy("parent_asin").agg(F.avg("rating").alias("_im"))
        self.user_means = train.groupBy("user_id").agg(F.avg("rating").alias("_um"))
        self.global_mean = train.agg(F.avg("rating").alias("_gm"))

    def _fit(self, train: DataFrame, metadata: DataFrame | None) -> None:
        pass

    def with_fallback(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``_fallback``: the item's mean, else the user's, else the mean of all."""
        out = pairs.join(self.item_means, "parent_asin", "left").join(self.user_means, "user_id", "left")
        out = out.join(F.broadcast(self.global_mean), F.lit(True), "left")  # one row
        return out.withColumn("_fallback", F.coalesce("_im", "_um", "_gm")).select(*pairs.columns, "_fallback")

    @abstractmethod
    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (user_id, parent_asin and any others) with ``est``, a rating from 1 to 5."""

    def score(self, candidates: DataFrame) -> DataFrame:
        """``candidates`` with the ``score`` they are ranked by."""
        return self.predict(candidates).withColumnRenamed("est", "score")

    def recommend(self, candidates: DataFrame, k: int, tie_break: str = "item_id") -> DataFrame:
        """The ``k`` best unseen candidates of each user: (user_id, parent_asin, score, rank, ...)."""
        return rank_candidates(self.score(candidates), self.train, k, tie_break)

    def recommend_all(self, users: DataFrame, k: int) -> DataFrame:
        """The ``k`` best unseen items of the whole catalogue for each of the users given: users against the items in blocks."""
        catalog = self.item_means.select("parent_asin").withColumn("_b", F.pmod(F.xxhash64("parent_asin"), F.lit(max(1, -(-self.item_means.count() // BLOCK)))))
        blocks = catalog.agg((F.max("_b") + 1).alias("_m"))
        asked = users.select("user_id").distinct().join(F.broadcast(blocks), F.lit(True)).select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("_b"))
        return self.recommend(asked.join(catalog, "_b").select("user_id", "parent_asin"), k)
