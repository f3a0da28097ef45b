"""The closed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


INTERACTIONS = _struct("user_id string, parent_asin string, rating double, timestamp bigint")
METADATA = _struct("parent_asin string, title string, description string, text string, categories string, store string, price double, price_missing boolean, average_rating double, average_rating_missing boolean, rating_number bigint, rating_number_missing boolean")
SENTIMENT = _struct("user_id string, parent_asin string, timestamp bigint, sentiment_label string, sentiment_score double, positive_prob double, negative_prob double")
USER_AGGREGATES = _struct("user_id string, user_mean_rating double, user_rating_std double, user_review_sentiment_mean double, user_review_sentiment_std double, user_rating_minus_sentiment_gap double, user_strictness_score double")
ITEM_AGGREGATES = _struct("parent_asin string, item_mean_rating double, item_train_sentiment_mean double, item_train_sentiment_count bigint, item_rating_minus_sentiment_gap double")
VECTORS = _struct("id bigint, parent_asin string, title string, categories string, store string, price float, average_rating float, rating_number bigint, vector array<float>")
CO_RATED = _struct("a string, b string, weight_count int, weight_jaccard float")
