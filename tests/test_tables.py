"""Preparation, splits, features and metrics: hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from tesselon.functions import text as T
from tesselon.functions.vectors import cosine, hash_embedding, l2_normalize
from tesselon.operators import eda, features, metrics, prep
from tesselon.operators.ranking import add_position, sample_exactly

SCHEMA = "user_id string, parent_asin string, rating double, timestamp bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_invalid_rows_are_dropped(spark):
    records = spark.createDataFrame([("u1", "i1", 5.0, 1), ("u2", "i1", 4.0, None), (None, "i1", 3.0, 2), ("u3", "i2", None, 3)], SCHEMA).withColumn("text", F.lit("x"))
    assert sorted(r["rating"] for r in prep.load_interactions(records).collect()) == [4.0, 5.0]
    assert tuple(prep.raw_and_kept(records).first()) == (4, 2)
    assert prep.load_interactions(records.drop("timestamp")).first()["timestamp"] is None


def test_dedup(spark):
    df = frame(spark, [("u1", "i1", 3.0, 10), ("u1", "i1", 5.0, 20), ("u1", "i2", 4.0, 15), ("u2", "i1", 1.0, None), ("u2", "i1", 2.0, 1)])
    assert pairs(prep.deduplicate(df), "user_id", "parent_asin", "rating") == [("u1", "i1", 5.0), ("u1", "i2", 4.0), ("u2", "i1", 2.0)]
    assert pairs(prep.deduplicate(df, "first"), "user_id", "parent_asin", "rating") == [("u1", "i1", 3.0), ("u1", "i2", 4.0), ("u2", "i1", 1.0)]
    with pytest.raises(ValueError):
        prep.deduplicate(df, "middle")


def test_k_core(spark):
    cascade = frame(spark, [("u1", "i1", 1.0, 1), ("u1", "i2", 1.0, 1), ("u1", "i3", 1.0, 1), ("u2", "i1", 1.0, 1), ("u3", "i2", 1.0, 1)])
    assert prep.k_core(cascade, 2).count() == 0
    block = frame(spark, [(u, i, 1.0, 1) for u in ("u1", "u2") for i in ("i1", "i2")] + [("u3", "i1", 1.0, 1)])
    assert prep.k_core(block, 2).count() == 4


def test_splits(spark):
    df = frame(spark, [(u, f"{u}_i{t}", 4.0, t) for u in ("u1", "u2") for t in range(1, 6)])
    parts = prep.split_per_user(df, 0.2)
    assert pairs(parts.where("part = 'test'"), "parent_asin") == [("u1_i5",), ("u2_i5",)]
    assert prep.split_per_user(frame(spark, [("u", "i", 1.0, 1)])).first()["part"] == "train"
    gap = prep.split_per_user(frame(spark, [("u", f"i{k}", 1.0, None if k == 0 else k) for k in range(10)]), 0.2)
    assert gap.where("part = 'test'").count() == 2
    for n, want in ((5, (3, 1, 1)), (3, (1, 1, 1)), (2, (1, 0, 1)), (1, (1, 0, 0))):
        out = prep.split_leave_last_out(frame(spark, [("u", f"i{t}", 1.0, t) for t in range(n)]))
        assert tuple(out.where(f"part = '{p}'").count() for p in ("train", "validation", "test")) == want
    late = prep.split_leave_last_out(frame(spark, [("u", "i1", 1.0, 1), ("u", "i2", 1.0, None), ("u", "i3", 1.0, 3)]))
    assert late.where("part = 'test'").first()["parent_asin"] == "i2"
    val = prep.split_validation(frame(spark, [("u1", f"i{t}", 1.0, t) for t in range(1, 5)] + [("u2", f"i{t}", 1.0, t) for t in (1, 2)]), 0.25)
    assert pairs(val.where("part = 'validation'"), "parent_asin") == [("i2",), ("i4",)]
    with pytest.raises(ValueError):
        prep.split_validation(df, 1.0)


def test_positions_follow_order_over_slots(spark):
    df = spark.createDataFrame([("a", t) for t in (5, 1, 9, 3, 7)] + [("b", 2), (None, 1)], "k string, t int")
    got = pairs(add_position(df, "k", [F.col("t")], F.floor(F.col("t") / 4)), "k", "t", "_pos", "_cnt")
    assert got == [("a", 1, 1, 5), ("a", 3, 2, 5), ("a", 5, 3, 5), ("a", 7, 4, 5), ("a", 9, 5, 5), ("b", 2, 1, 1)]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(100)
    first = pairs(sample_exactly(df, 10, 1, F.col("id")))
    assert len(first) == 10 and first == pairs(sample_exactly(df.repartition(7), 10, 1, F.col("id"))) != pairs(sample_exactly(df, 10, 2, F.col("id")))
    assert prep.cap_users(frame(spark, [(f"u{k % 5}", "i", 1.0, k) for k in range(20)]), 2).count() == 8


def test_metadata(spark):
    records = spark.createDataFrame([("A1", "Great <b>album</b> &amp; more", ["one", "two"], ["Rock ", "Pop"], "$9.99", 4.5, 10), ("A2", None, None, None, None, None, None), (None, "x", None, None, None, None, None)], "parent_asin string, title string, description array<string>, categories array<string>, price string, average_rating double, rating_number bigint")
    a, b = prep.prepare_metadata(records).orderBy("parent_asin").collect()
    assert a["text"] == "Great album & more one two Rock Pop" and (a["price"], a["price_missing"], a["store"]) == (9.99, False, "")
    assert (b["price"], b["price_missing"], b["average_rating_missing"], b["rating_number"], b["text"]) == (0.0, True, True, 0, "")


def test_mixed_json_fields(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"parent_asin":"a","title":["x","y"],"description":"[z","price":12.5}\n\n{"parent_asin":"b","title":"t"}\n')
    a, b = prep.prepare_variant_metadata(spark.read.option("singleVariantColumn", "v").json(str(path))).orderBy("parent_asin").collect()
    assert (a["title"], a["description"], a["price"]) == ("x y", "[z", 12.5) and (b["title"], b["price_missing"]) == ("t", True)


def test_categories(spark):
    df = spark.createDataFrame([(["Movies & TV", "comedy", " ", None, "COMEDY", "dvd  rpg"],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(T.filter_categories(F.col("c"), ["Movies & TV"])).collect()] == [["Comedy", "DVD RPG"], []]
    path = spark.createDataFrame([("Video Games Xbox One",), ("Video Games",), ("Drama",), (" ",)], "c string")
    assert [r[0] for r in path.select(T.filter_category_path(F.col("c"), ["Video Games"])).collect()] == [["Xbox One"], [], ["Drama"], []]
    items = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", ["y", "x", "z"])], "i string, c array<string>")
    vocab = features.vocab_list(features.category_vocab(items, F.col("c"), 2, 2))
    assert vocab == ["y", "x"]
    assert [r[0] for r in items.orderBy("i").select(features.multi_hot(F.col("c"), vocab)).collect()] == [[1.0, 1.0], [1.0, 0.0], [1.0, 1.0]]


def test_sentiment(spark):
    df = spark.createDataFrame([("good GREAT bad",), ("",), (None,), ("nothing good!",), ("hate",)], "t string")
    assert [tuple(r[0]) for r in df.select(T.lexicon_sentiment(F.col("t"))).collect()] == [("POSITIVE", pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx(1 / 3)), ("NEUTRAL", 0.0, 0.5, 0.5), ("NEUTRAL", 0.0, 0.5, 0.5), ("NEUTRAL", 0.0, 0.5, 0.5), ("NEGATIVE", -1.0, 0.0, 1.0)]
    train = frame(spark, [("u", "i", 5.0, 1), ("u", "j", 3.0, 2)])
    reviews = spark.createDataFrame([("u", "i", 1, "good"), ("u", "j", 2, ""), ("u", "k", 3, "bad")], "user_id string, parent_asin string, timestamp bigint, text string")
    assert features.score_reviews(reviews, train).count() == 2
    with pytest.raises(ValueError):
        features.score_reviews(reviews, train, max_rows=0)


def test_aggregates(spark):
    train = frame(spark, [("u1", "i1", 5.0, 1), ("u1", "i2", 3.0, 2), ("u2", "i1", 4.0, 3)])
    sentiment = spark.createDataFrame([("u1", "i1", 1, 1.0), ("u1", "i2", 2, -1.0), ("u2", "i1", 3, 0.5), ("u2", "i1", 3, 0.5)], "user_id string, parent_asin string, timestamp bigint, sentiment_score double")
    users = {r["user_id"]: r for r in features.user_aggregates(train, sentiment).collect()}
    assert users["u1"]["user_rating_minus_sentiment_gap"] == 4.0 and users["u2"]["user_rating_std"] == 0.0
    items = {r["parent_asin"]: r for r in features.item_aggregates(train, sentiment).collect()}
    assert items["i1"]["item_rating_minus_sentiment_gap"] == 3.75 and items["i1"]["item_train_sentiment_count"] == 2
    gaps = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "user_id string, user_rating_minus_sentiment_gap double")
    assert pairs(features.generosity(gaps)) == [("a", -1.0), ("b", 1.0)]
    cold = features.user_node_features(train, spark.createDataFrame([("u1",), ("zz",)], "user_id string"), features.generosity(features.user_aggregates(train, sentiment)))
    assert [tuple(r) for r in cold.orderBy("user_id").collect()][1] == ("zz", 0.0, 0.0, 0.0, 0.0)
    assert features.structure_features(train, spark.createDataFrame([("i1",), ("q",)], "parent_asin string")).orderBy("parent_asin").first()["log_degree"] == pytest.approx(math.log(3))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(l2_normalize(F.col("a"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.96), None]
    import hashlib

    (got,) = spark.createDataFrame([("Foo bar  foo",)], "t string").select(hash_embedding(F.col("t"), 7)).first()
    want = [0.0] * 7
    for w in ("foo", "bar", "foo"):
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 7] += 1
    assert got == want


def test_item_features_lose_columns(spark):
    items = spark.createDataFrame([("a", "red one", ["X"], 1.0, 4.0, 3), ("b", "blue", ["X", "Y"], 2.0, 3.0, 5), ("b", "zzz", ["Y"], 0.0, 3.0, 5)], "parent_asin string, title string, categories array<string>, price double, average_rating double, rating_number bigint")
    size = lambda **o: {len(r["features"]) for r in features.item_node_features(items, [F.col("price")], dim=4, min_doc_freq=1, **o).collect()}
    assert size() == {4 + 2 + 3} and size(use_text=False) == {5} and size(use_categories=False, use_numeric=False) == {4}
    out = features.item_node_features(items, [F.col("price")], dim=4, min_doc_freq=1).collect()
    assert len(out) == 2 and all(sum(x * x for x in r["features"]) == pytest.approx(1) for r in out)


def test_eda(spark):
    df = frame(spark, [("u1", "i1", 5.0, 1), ("u1", "i2", 5.0, 2), ("u2", "i1", 3.0, 3), ("u2", "i2", 4.0, 4)])
    r = eda.table_facts(df, "x").first()
    assert (r["x_rows"], r["x_users"], r["x_items"], r["x_sparsity"], r["x_pct_relevant"]) == (4, 2, 2, 0.0, 0.75)
    assert pairs(eda.rating_histogram(df)) == [(3.0, 1), (4.0, 1), (5.0, 2)]
    e = eda.table_facts(df.limit(0), "x").first()
    assert (e["x_rows"], e["x_sparsity"], e["x_pct_relevant"], e["x_min_user_degree"]) == (0, None, None, 0)
    assert eda.summarize_values(spark.createDataFrame([(2,), (3,)], "v int"), "v", True).first()["median"] == 2


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "user_id string, parent_asin string, rank int")
    relevant = spark.createDataFrame([("u", "b"), ("u", "d"), ("u", "x"), ("v", "q")], "user_id string, parent_asin string")
    rows = {r["user_id"]: r for r in metrics.user_bundles(ranked, relevant, 2).collect()}
    assert rows["u"]["precision_at_k"] == 0.5 and rows["u"]["recall_at_k"] == pytest.approx(1 / 3) and rows["u"]["f1_at_k"] == pytest.approx(0.4)
    assert rows["u"]["ndcg_at_k"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert rows["v"]["f1_at_k"] == 0.0 and rows["v"]["oracle_precision_at_k"] == 0.5
    agg = metrics.aggregate_bundles(metrics.user_bundles(ranked, relevant, 2), 2).first()
    assert agg["precision_oracle_ratio_at_k"] == pytest.approx(0.25 / 0.75)
    none = metrics.aggregate_bundles(metrics.user_bundles(ranked, relevant.limit(0), 2), 2).first()
    assert none["n_eval_users"] == 0 and none["precision_at_k"] is None and none["f1_oracle_ratio_at_k"] is None
    errors = metrics.rating_errors(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (5.0, 3.0)], "rating double, est double")).first()
    assert errors["rmse"] == pytest.approx(math.sqrt(5 / 3)) and errors["mae"] == pytest.approx(1.0)


def test_negatives(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    catalog = spark.createDataFrame([(f"i{k:02d}",) for k in range(20)], "parent_asin string")
    exclude = spark.createDataFrame([("u", f"i{k:02d}") for k in range(15)] + [("v", "out of catalog")], "user_id string, parent_asin string")
    got = metrics.sample_negatives(users, catalog, exclude, 10, probes=12).collect()
    mine = sorted(r["parent_asin"] for r in got if r["user_id"] == "u")
    assert mine == [f"i{k:02d}" for k in range(15, 20)]
    theirs = [r["parent_asin"] for r in got if r["user_id"] == "v"]
    assert len(theirs) == len(set(theirs)) == 10
    assert metrics.sample_negatives(users, catalog, exclude, 0).count() == 0


def test_calibration(spark):
    beta, intercept = metrics.linear_calibration(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "raw double, rating double")).first()
    assert (beta, intercept) == (pytest.approx(2.0), pytest.approx(1.0))
    assert tuple(metrics.linear_calibration(spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "raw double, rating double")).first()) == (0.0, 4.0)
