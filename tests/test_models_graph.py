"""Recommenders, graphs, stores, pipeline and streaming on small tables."""

import gzip
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.config import Config
from tesselon.graph import analysis, build, communities
from tesselon.models.baselines import Popularity, RandomOrder
from tesselon.models.base import Recommender
from tesselon.models.collaborative import BiasedALS, ItemKNN
from tesselon.models.content import ContentBased, ContentEnriched
from tesselon.models.embeddings import EmbeddingRecommender
from tesselon.models.evaluate import build_models, evaluate_models
from tesselon.models.graphsage import GraphSAGE
from tesselon.models.hybrid import CalibratedHybrid, WeightedHybrid, tune_alpha
from tesselon.models.lightgcn import LightGCN
from tesselon.plans.preprocess import preprocess
from tesselon.report import graph_sample, load_dashboard, metric_table, search_items, to_json
from tesselon.sources import records as R
from tesselon.sources.stores import GraphStore, VectorStore, load_vector_artifacts, search_vectors, write_embedding_preview
from tesselon.streaming.incremental import item_means, item_means_sink, windowed_counts

SCHEMA = "user_id string, parent_asin string, rating double, timestamp bigint"
ITEMS = "parent_asin string, title string, text string, categories array<string>, store string, price double, average_rating double, rating_number bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def blocks(spark):
    """Two groups of users, each fond of its own items."""
    rng = random.Random(0)
    rows = [(f"{g}u{u}", f"{g}i{i}", 5.0 if rng.random() < 0.8 else 2.0, u * 10 + i) for g in "ab" for u in range(12) for i in range(8) if rng.random() < 0.7]
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(f"{g}i{i}", f"{'red' if g == 'a' else 'blue'} thing {i}", f"{'red red' if g == 'a' else 'blue blue'} item", ["Root", "Red" if g == "a" else "Blue"], None, float(i), 3.0, i) for g in "ab" for i in range(8)], ITEMS).cache()


def test_popularity(spark):
    train = frame(spark, [("u1", "i1", 5.0, 1), ("u2", "i1", 5.0, 1), ("u3", "i1", 5.0, 1), ("u1", "i2", 4.0, 1), ("u2", "i3", 4.0, 1)])
    model = Popularity().fit(train)
    users = spark.createDataFrame([("u1",), ("new",)], "user_id string")
    got = {(r["user_id"], r["rank"]): r["parent_asin"] for r in model.recommend_all(users, 1).collect()}
    assert got == {("u1", 1): "i3", ("new", 1): "i1"}
    assert {r["parent_asin"] for r in Recommender.recommend_all(model, users, 1).where("user_id = 'u1'").collect()} == {"i3"}
    est = model.predict(spark.createDataFrame([("x", "i2"), ("u3", "zz"), ("x", "zz")], "user_id string, parent_asin string"))
    assert {(r["user_id"], r["parent_asin"]): r["est"] for r in est.collect()} == {("x", "i2"): 4.0, ("u3", "zz"): 5.0, ("x", "zz"): pytest.approx(4.6)}


def test_random_is_stable(spark, blocks):
    pairs = blocks.select("user_id").distinct().join(blocks.select("parent_asin").distinct(), F.lit(True))
    first, second = (sorted(map(tuple, RandomOrder(s).fit(blocks).recommend(pairs, 3).select("user_id", "rank", "parent_asin").collect())) for s in (1, 1))
    assert first == second and first != sorted(map(tuple, RandomOrder(2).fit(blocks).recommend(pairs, 3).select("user_id", "rank", "parent_asin").collect()))


def test_content(spark, items):
    train = frame(spark, [("u", "ai0", 5.0, 1), ("u", "bi0", 1.0, 1), ("v", "ai1", 3.0, 1)])
    pairs = spark.createDataFrame([("u", "ai1"), ("u", "bi1"), ("nobody", "ai1"), ("u", "nothing")], "user_id string, parent_asin string")
    flat = items.withColumns({"price": F.lit(1.0), "rating_number": F.lit(1).cast("bigint")})
    est = {tuple(r)[:2]: r["est"] for r in ContentBased(dim=16).fit(train, flat).predict(pairs).collect()}
    assert est["u", "ai1"] > est["u", "bi1"] and est["nobody", "ai1"] == 3.0 and est["u", "nothing"] == 3.0
    with pytest.raises(ValueError):
        ContentBased().fit(train, None)
    offsets = spark.createDataFrame([("u", 0.5)], "user_id string, offset double")
    richer = {tuple(r)[:2]: r["est"] for r in ContentEnriched(dim=16, labels=F.col("categories"), offsets=offsets, min_doc_freq=1).fit(train, flat).predict(pairs).collect()}
    assert richer["u", "nothing"] == 3.5


def test_neighbours_against_brute_force(spark, blocks):
    rows = [tuple(r)[:3] for r in blocks.collect()]
    ratings = {(u, i): r for u, i, r in rows}
    by_item = {}
    for u, i, r in rows:
        by_item.setdefault(i, {})[u] = r
    mean = {i: np.mean(list(x.values())) for i, x in by_item.items()}
    pairs = [(u, i) for u in sorted({u for u, _, _ in rows})[:4] for i in by_item] + [("new", "ai0")]
    got = {tuple(r)[:2]: r["est"] for r in ItemKNN(3).fit(blocks).predict(spark.createDataFrame(pairs, "user_id string, parent_asin string")).collect()}
    for u, i in pairs:
        if u == "new":
            assert got[u, i] == pytest.approx(np.mean([r for _, _, r in rows]))
            continue
        near = []
        for j in by_item:
            common = by_item[i].keys() & by_item[j].keys()
            if (u, j) in ratings and common:
                near.append((-1 / (1 + np.mean([(by_item[i][c] - by_item[j][c]) ** 2 for c in common])), j))
        near = sorted(near)[:3]
        want = mean[i] + (sum(-s * (ratings[u, j] - mean[j]) for s, j in near) / sum(-s for s, _ in near) if near else 0)
        assert got[u, i] == pytest.approx(min(5, max(1, want)))


class Constant(Recommender):
    def __init__(self, value):
        self.value, self.fits = value, 0

    def _fit(self, train, metadata):
        self.fits += 1

    def predict(self, pairs):
        return pairs.withColumn("est", F.lit(float(self.value)) if not isinstance(self.value, dict) else F.element_at(F.create_map(*[F.lit(x) for kv in self.value.items() for x in kv]), F.col("parent_asin")))


def test_hybrids(spark, blocks):
    train = frame(spark, [("u", "i1", 5.0, 1), ("u", "i2", 1.0, 2)])
    calibrated = CalibratedHybrid(Constant({"i1": 2.0, "i2": 4.0}), Constant(3.0), alpha=1.0).fit(train)
    assert calibrated.predict(frame(spark, [("u", "i2", 1.0, 2)])).first()["est"] == 5.0
    flat = CalibratedHybrid(Constant(2.0), Constant(3.0), alpha=0.5).fit(train)
    assert flat.predict(train).first()["est"] == 3.0
    part = Constant(5.0)
    WeightedHybrid(part.fit(train), Constant(1.0)).fit(train)
    assert part.fits == 1
    high = blocks.withColumn("rating", F.lit(5.0))
    best, errors = tune_alpha(high, None, Constant(5.0), Constant(1.0), [0.0, 0.5, 1.0], 0.25)
    assert best == 1.0 and errors.count() == 3
    with pytest.raises(ValueError):
        tune_alpha(train.limit(0), None, Constant(5.0), Constant(1.0), [0.0], 0.25)


def test_learned_models_keep_their_promises(spark, blocks, items, tmp_path):
    test = blocks.select("user_id", "parent_asin", "rating").unionByName(spark.createDataFrame([("new", "ai0", 4.0), ("au0", "none", 4.0)], "user_id string, parent_asin string, rating double"))
    features = items.select("parent_asin", F.array(F.col("price") / 8, (F.col("text") == "red red item").cast("double"), F.lit(1.0)).alias("features"))
    models = [BiasedALS(rank=4, iterations=3), LightGCN(dim=8, epochs=4, lr=0.05), GraphSAGE(features, "mse", hidden=8, epochs=30), GraphSAGE(features, "bpr", hidden=8, epochs=10), GraphSAGE(None, "bpr", feature_set="structure_only", hidden=8, epochs=3)]
    for model in models:
        rows = model.fit(blocks, items).predict(test).collect()
        assert len(rows) == test.count() and all(1 <= r["est"] <= 5 for r in rows)
    gcn = models[1]
    pool = spark.createDataFrame([(f"{g}u{u}", f"{h}i{i}") for g in "ab" for u in range(12) for h in "ab" for i in range(8)], "user_id string, parent_asin string")
    top = gcn.recommend(pool, 1).collect()
    assert sum(r["user_id"][0] == r["parent_asin"][0] for r in top) > 0.7 * len(top)
    for k, model in enumerate(models[1:]):
        model.save(str(tmp_path / f"model{k}"))
        again = EmbeddingRecommender.load(spark, str(tmp_path / f"model{k}"), blocks)
        assert type(again) is type(model)
        assert sorted(map(tuple, again.predict(test).collect())) == sorted(map(tuple, model.predict(test).collect()))
        assert sorted(map(tuple, again.recommend(pool, 2).collect())) == sorted(map(tuple, model.recommend(pool, 2).collect()))
    with pytest.raises(ValueError):
        GraphSAGE(features, feature_set="nothing")


@pytest.mark.parametrize("negatives", [1, 2])
def test_lightgcn_in_a_task_equals_its_rounds(spark, monkeypatch, negatives):
    """Equal vectors either way; user a has rated every item but one and user z every item; a task runs as many jobs for more epochs."""
    from tesselon.models import lightgcn

    rng = random.Random(8)
    rows = [(f"u{u:02d}", f"i{i}", float(rng.randint(2, 5)), i) for u in range(20) for i in rng.sample(range(12), 5)]
    rows += [("a", f"i{i}", 5.0, i) for i in range(11)] + [("z", f"i{i}", 5.0, i) for i in range(12)]
    train = frame(spark, rows)
    fit = lambda epochs=3: lightgcn.LightGCN(dim=4, epochs=epochs, lr=0.05, weight_decay=0.01, negatives=negatives).fit(train)
    vectors = lambda m: {(r[0], k): v for k, r in enumerate(sorted(m.users.collect()) + sorted(m.items.collect())) for v in [r[1]]}
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    jobs = []
    for epochs in (1, 3):
        context.setJobGroup(f"epochs {epochs}", "")
        one = fit(epochs)
        jobs.append(len(tracker.getJobIdsForGroup(f"epochs {epochs}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] and jobs[1] <= jobs[0] + 2
    monkeypatch.setattr(lightgcn, "TASK_NUMBERS", 0)
    other = fit()
    want, got = vectors(other), vectors(one)
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-10) for k in want)
    assert (one.beta, one.intercept) == pytest.approx((other.beta, other.intercept), rel=1e-6)


def test_lightgcn_draws_equal_those_of_spark(spark):
    from tesselon.models.lightgcn import drawn_negatives, hash_unit, hashed_unit, negative_items

    ids = np.array([0, 1, 7, 2**40, 123456789012345], np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "id bigint").select(hash_unit(F.col("id"), F.col("id") + 1, F.lit(3), 42).alias("x")).collect()]
    assert hashed_unit(ids, ids + 1, 3, 42).tolist() == got
    pairs = sorted({(u, 6 + i) for u in range(6) for i in range(8) if u == 5 or (u * i + u) % (u + 2) != 1 or (u == 0 and i)})
    df = spark.createDataFrame(pairs, "src bigint, dst bigint")
    src, dst = (np.array(c) for c in zip(*pairs, strict=True))
    drawn = sorted(zip(*(x.tolist() for x in drawn_negatives(src, dst, 6, 8, 9, 3)), strict=True))
    assert drawn == sorted(map(tuple, negative_items(df, 6, 8, 9, 3).collect()))


def _graph_rows(seed):
    """Vertices (id, features), edges and rows of a made-up graph; users are 0 to 29 with two features, items 30 to 49 with six."""
    rng = np.random.default_rng(seed)
    x = np.zeros((50, 6))
    x[:30, :2], x[30:] = rng.normal(size=(30, 2)), rng.normal(size=(20, 6)) * (rng.random((20, 6)) < 0.6)
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 150), rng.integers(30, 50, 150), strict=True)})
    return x, pairs, [(u, i, float(rng.integers(1, 6))) for u, i in pairs[:90]]


def _batches(x, pairs, rows, size):
    import pyarrow as pa

    table = [(0, k, None, None, np.flatnonzero(v).astype(np.int32), v[v != 0]) for k, v in enumerate(x)]
    table += [(1, *e, None, None, None) for e in sorted(pairs + [(i, u) for u, i in pairs])] + [(2, *r, None, None) for r in sorted(rows)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
    for low in range(0, len(table), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table[low : low + size], strict=True), kinds, strict=True)], list("pabrvx"))


@pytest.mark.parametrize("loss", ["mse", "bpr"])
@pytest.mark.parametrize("layers", [1, 2, 3])
def test_graphsage_steps_equal_those_of_the_whole_graph(loss, layers, monkeypatch):
    """One step's slopes against differences of the loss over the whole graph, whose first layer isn't prepared."""
    from tesselon.models import graphsage

    x, pairs, rows = _graph_rows(5)
    near = np.zeros((50, 50))
    for u, i in pairs:
        near[u, i] = near[i, u] = 1
    near /= np.maximum(1, near.sum(axis=1))[:, None]
    options = {"size": 6, "width": 2, "first_item": 30, "loss": loss, "hidden": 4, "layers": layers, "epochs": 1, "lr": 0.01, "decay": 0.0, "negatives": 1, "seed": 3, "positive_from": 4.0}
    seen = []
    monkeypatch.setattr(graphsage.Layers, "step", lambda self, slopes, lr, decay: seen.append((self, slopes)))
    for bounds in ((16384, 200_000), (7, 5)):
        monkeypatch.setattr(graphsage, "BLOCK", bounds[0])
        monkeypatch.setattr(graphsage, "EDGES", bounds[1])
        graphsage.learned(_batches(x, pairs, rows, 11), **options)
    drawn = []
    if loss == "bpr":
        rng = np.random.default_rng(3)
        graphsage.Layers(6, 4, layers, False, rng)
        good, pool, taken = [r for r in sorted(rows) if r[2] >= 4], np.unique([i for _, i, _ in rows]), set(pairs)
        n = rng.choice(pool, len(good))
        while (bad := np.array([(u, k) in taken for (u, _, _), k in zip(good, n.tolist(), strict=True)])).any():
            n[bad] = rng.choice(pool, int(bad.sum()))
        drawn = [(u, i, k) for (u, i, _), k in zip(good, n.tolist(), strict=True)]

    def error(w):
        h = x
        for k in range(layers):
            h = np.maximum(h @ w[3 * k] + near @ h @ w[3 * k + 1] + w[3 * k + 2], 0)
        if loss == "bpr":
            return np.mean([np.log1p(np.exp(-h[u] @ (h[i] - h[k]))) for u, i, k in drawn])
        u, i, r = (np.array(c) for c in zip(*rows, strict=True))
        a, b, c, d = w[-4:]
        return np.mean(((np.maximum(np.concatenate((h[u], h[i]), axis=1) @ a + b, 0) @ c + d)[:, 0] - r) ** 2)

    assert len(seen) == 2
    for net, slopes in seen:
        w = [v.copy() for v in net.w]
        for v, g in zip(w, slopes, strict=True):
            assert v.shape == g.shape
            for at in list(np.ndindex(v.shape))[::3]:
                old = v[at]
                v[at] = old + 1e-6
                high = error(w)
                v[at] = old - 1e-6
                low, v[at] = error(w), old
                assert g[at] == pytest.approx((high - low) / 2e-6, rel=2e-3, abs=2e-5)


@pytest.mark.parametrize("loss", ["mse", "bpr"])
def test_graphsage_learns_without_features_on_the_driver(spark, blocks, items, monkeypatch, loss):
    """Neither Arrow tables nor rows with features come to the driver: its results are a few numbers beside the weights."""
    sent = []
    kind = type(blocks)
    collect = kind.collect
    monkeypatch.setattr(kind, "toArrow", lambda self: sent.append("toArrow"))
    monkeypatch.setattr(kind, "collect", lambda self: sent.append(self.columns) or collect(self))
    features = items.select("parent_asin", F.array(F.col("price") / 8, F.lit(1.0)).alias("features"))
    model = GraphSAGE(features, loss, hidden=4, epochs=2).fit(blocks, items)
    assert sum("shape" in c for c in sent) == 1 and "toArrow" not in sent and not any({"v", "features", "x"} & set(c) for c in sent)
    assert model.fit(blocks.limit(0), items).predict(blocks.limit(0)).count() == 0


@pytest.mark.parametrize("loss", ["mse", "bpr"])
def test_graphsage_learns_from_all_edges_and_neighbours(spark, loss):
    """The weights are those learned from the whole graph at hand, in which vertices have up to 100 neighbours."""
    from tesselon.models.graphsage import learned
    from tesselon.operators.prep import split_validation

    rng = np.random.default_rng(4)
    pairs = sorted({(int(u), 100 + int(i)) for u, i in zip(rng.integers(0, 100, 900), rng.integers(0, 20, 900), strict=True)} | {(u, 100) for u in range(100)})
    rated = {p: float(rng.integers(1, 6)) for p in pairs}
    train = frame(spark, [(f"u{u:03d}", f"i{i:03d}", r, k) for k, ((u, i), r) in enumerate(rated.items())])
    x = np.zeros((120, 5))
    x[100:] = rng.normal(size=(20, 5))
    for u in range(100):
        own = np.array([r for (k, _), r in rated.items() if k == u])
        x[u, :3] = own.mean(), len(own), (own >= 4).mean()
    features = spark.createDataFrame([(f"i{100 + k:03d}", v.tolist()) for k, v in enumerate(x[100:])], "parent_asin string, features array<double>")
    model = GraphSAGE(features, loss, hidden=4, epochs=2)
    assert model.sample is None and model.fan_out is None
    rows, edges = [(*p, r) for p, r in rated.items()], pairs
    if loss == "bpr":
        kept = split_validation(train, model.fraction).where("part = 'train'").collect()
        rows, edges = [(int(r["user_id"][1:]), int(r["parent_asin"][1:]), r["rating"]) for r in kept], [p for p in pairs if rated[p] >= 4]
    want = learned(_batches(x, edges, rows, 10_000), size=5, width=3, first_item=100, loss=loss, hidden=4, layers=2, epochs=2, lr=model.lr, decay=0.0, negatives=1, seed=model.seed, positive_from=4.0)
    got = model.fit(train).net
    assert len(got.w) == len(want.w) and all(np.allclose(a, b, rtol=1e-3, atol=1e-5) for a, b in zip(got.w, want.w, strict=True))


def test_sums_over_edges(monkeypatch):
    from tesselon.models import graphsage

    rng = np.random.default_rng(1)
    n = rng.permutation(np.concatenate((np.zeros(5, np.int64), rng.integers(1, 5, 40), [150, 64, 65])))
    ptr, rows = np.concatenate(([0], np.cumsum(n))), rng.normal(size=(30, 3))
    at = rng.integers(0, 30, ptr[-1])
    for edges in (200_000, 7):
        monkeypatch.setattr(graphsage, "EDGES", edges)
        got = graphsage._Sums(ptr, at)(rows)
        assert np.allclose(got, [rows[at[a:b]].sum(axis=0) for a, b in zip(ptr[:-1], ptr[1:], strict=True)])


def test_graphsage_learns_ratings(spark):
    """A rating depends on the item's colour and on the user's mood, which shows in the mean of their ratings; held-out rows."""
    rng = random.Random(6)
    rows = [(f"u{u:03d}", f"i{i:02d}", min(5.0, max(1.0, (4.0 if i % 2 else 2.0) + (1.0 if u % 2 else -1.0))), u) for u in range(120) for i in rng.sample(range(30), 14)]
    rng.shuffle(rows)
    features = spark.createDataFrame([(f"i{i:02d}", [float(i % 2), 1.0, 0.0]) for i in range(30)], "parent_asin string, features array<double>")
    model = GraphSAGE(features, "mse", hidden=16, epochs=120, lr=0.01, sample_edges=600, fan_out=6).fit(frame(spark, rows[:1200]))
    got = model.predict(frame(spark, rows[1200:])).collect()
    actual = np.array([r["rating"] for r in got])
    assert np.sqrt(np.mean((np.array([r["est"] for r in got]) - actual) ** 2)) < 0.6 * actual.std()


def test_evaluation(spark, blocks, tmp_path):
    rows = sorted(map(tuple, blocks.collect()))
    train, test = frame(spark, rows[::2]), frame(spark, rows[1::2])
    out = evaluate_models({"a": Popularity(), "perfect": Constant(5.0)}, train, test, None, k=3, negatives=4, metrics_path=str(tmp_path / "m.json")).collect()
    assert [r["model"] for r in out] == ["a", "perfect"] and len(json.loads((tmp_path / "m.json").read_text())) == 2
    # ties favour the relevant ones, so a constant reaches the ceiling
    assert out[1]["precision_oracle_ratio_at_k"] == 1.0
    fair = evaluate_models({"constant": Constant(5.0)}, train, test, None, k=3, negatives=4, tie_break="item_id").first()
    assert fair["precision_oracle_ratio_at_k"] < 1.0
    with pytest.raises(ValueError):
        build_models("nothing", {})


def test_evaluation_by_parts_of_users_leaves_rows_only(spark, blocks, monkeypatch):
    """A model gets bounded parts that together are all pairs, equal figures come out, and no later read computes anything."""
    from tesselon.models import evaluate

    rows = sorted(map(tuple, blocks.collect()))
    train, test = frame(spark, rows[::2]), frame(spark, rows[1::2])
    run = lambda: evaluate_models({"a": Popularity(), "perfect": Constant(5.0)}, train, test, None, k=3, negatives=4)
    whole = [r.asDict() for r in run().collect()]
    asked = []
    predict = Popularity.predict
    monkeypatch.setattr(evaluate, "PART_ROWS", 20)
    monkeypatch.setattr(Popularity, "predict", lambda self, pairs: asked.append(pairs.select("user_id", "parent_asin").collect()) or predict(self, pairs))
    out = run()
    assert len(asked) > 2 and sorted(r for part in asked for r in part) == sorted(test.select("user_id", "parent_asin").collect())
    assert all("Exchange" not in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines())
    for got, want in zip([r.asDict() for r in out.collect()], whole, strict=True):
        assert got == pytest.approx(want)


def test_blends_are_evaluated_with_their_parts_estimates(spark, blocks, monkeypatch):
    """Parts estimate test rows and candidates once, beside the calibration, and the figures are those of each model alone."""
    from tesselon.models import evaluate

    rows = sorted(map(tuple, blocks.collect()))
    train, test = frame(spark, rows[::2]), frame(spark, rows[1::2])

    def models():
        cf, content = ItemKNN(), Popularity()
        return {"cf": cf, "alone": Constant(5.0), "hybrid": WeightedHybrid(cf, content), "calibrated": CalibratedHybrid(cf, content), "popularity": content}

    assert evaluate._groups(models()) == [["cf", "hybrid", "calibrated", "popularity"], ["alone"]]
    want = [r.asDict() for name in models() for r in evaluate_models({name: models()[name]}, train, test, None, k=3, negatives=4).collect()]
    calls = []
    predict = ItemKNN.predict
    monkeypatch.setattr(ItemKNN, "predict", lambda self, pairs: calls.append(1) or predict(self, pairs))
    got = [r.asDict() for r in evaluate_models(models(), train, test, None, k=3, negatives=4).collect()]
    assert len(calls) == 3 and [r["model"] for r in got] == list(models())
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


# ---- graphs


@pytest.fixture(scope="module")
def toy(spark):
    """i1 is rated by four users who also rate i2; one of another pair shares i3."""
    return frame(spark, [(f"u{u}", i, 5.0, 1) for u in range(1, 5) for i in ("i1", "i2")] + [("u1", "i3", 4.0, 1), ("u5", "i3", 2.0, 1)])


def test_projection(spark, toy):
    nodes, edges = build.project_items(toy)
    assert {(r["a"], r["b"]): (r["weight_count"], round(r["weight_jaccard"], 6)) for r in edges.collect()} == {("i1", "i2"): (4, 1.0), ("i1", "i3"): (1, 0.2), ("i2", "i3"): (1, 0.2)}
    nodes, edges = build.project_items(toy, 2)
    assert edges.count() == 1 and nodes.count() == 3
    with pytest.raises(ValueError):
        build.project_items(toy, 0)
    # large baskets in chunks give the same
    rng = random.Random(1)
    rows = [(f"u{u}", f"i{i:02d}", 1.0, 1) for u in range(6) for i in range(40) if rng.random() < 0.7]
    small, large = (sorted(map(tuple, build.project_items(frame(spark, rows), 1, chunk=c)[1].collect())) for c in (5, 1000))
    assert small == large
    counts = {}
    for u in {r[0] for r in rows}:
        for p in itertools.combinations(sorted(i for v, i, *_ in rows if v == u), 2):
            counts[p] = counts.get(p, 0) + 1
    assert {(a, b): n for a, b, n, _ in small} == counts


def test_bipartite(spark, toy):
    vertices, edges = build.indexed_graph(toy)
    assert sorted(r["idx"] for r in vertices.collect()) == list(range(8)) and edges.where("positive").count() == 9
    facts = analysis.bipartite_facts(build.bipartite_graph(toy)).first()
    assert (facts["users"], facts["items"], facts["edges"], facts["components"], facts["largest"]) == (5, 3, 10, 1, 8)
    with pytest.raises(ValueError):
        build.bipartite_graph(toy.drop("rating"))


@pytest.fixture(scope="module")
def cliques(spark):
    rows = [(a, b, 3, 1.0) for g in "ab" for a, b in itertools.combinations([f"{g}{k}" for k in range(3)], 2)] + [("a0", "b0", 1, 0.1)]
    nodes = spark.createDataFrame([(f"{g}{k}", 2) for g in "ab" for k in range(3)] + [("z", 0)], "item string, degree int")
    return nodes, spark.createDataFrame(rows, "a string, b string, weight_count int, weight_jaccard double")


def test_components_and_clustering(spark, cliques):
    nodes, edges = cliques
    parts = {r["node"]: r["component"] for r in analysis.connected_components(nodes.select("item"), edges).collect()}
    assert parts == {**{f"{g}{k}": "a0" for g in "ab" for k in range(3)}, "z": "z"}
    path = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)], "a string, b string")
    assert analysis.connected_components(path.select("a").union(path.select("b")), path).select("component").distinct().count() == 1
    assert analysis.component_summary(analysis.connected_components(nodes.select("item"), edges.limit(0))).first()["components"] == 7
    # corners with only the clique's edges have 1; a0 and b0 have 3 neighbours and one triangle, 2/6
    assert analysis.clustering(nodes, edges).first()["clustering"] == pytest.approx((4 * 1 + 2 / 3) / 7)
    assert analysis.clustering(nodes, edges.limit(0)).first()["clustering"] == 0.0


def test_communities(spark, cliques):
    nodes, edges = cliques
    found = communities.louvain(nodes, edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2"], ["b0", "b1", "b2"], ["z"]]
    table = spark.createDataFrame([(r["node"], r["community"]) for r in found], "node string, community string")
    m = 6.1
    assert analysis.modularity(edges, table).first()["modularity"] == pytest.approx(2 * (3 / m - (6.1 / (2 * m)) ** 2))
    split = communities.girvan_newman(*cliques).collect()
    assert len({r["community"] for r in split}) == 3
    with pytest.raises(ValueError):
        communities.girvan_newman(nodes, edges, 3)
    labels = spark.createDataFrame([(f"{g}{k}", g) for g in "ab" for k in range(3)] + [("z", None)], "node string, label string")
    a = analysis.alignment(table, labels).first()
    assert (a["n"], a["purity"], a["nmi"]) == (6, 1.0, pytest.approx(1.0))
    assert analysis.alignment(table, labels.limit(0)).first()["purity"] == 0.0
    two = communities.spectral(nodes, edges, 2).collect()
    assert len(two) == 6
    with pytest.raises(ValueError):
        communities.spectral(nodes, edges, 1)
    with pytest.raises(ValueError):
        communities.spectral(nodes, edges, 50)
    assert communities.louvain(nodes, edges.limit(0)).count() == 7


def test_contracted_graphs_are_as_modular(spark):
    """A graph of 10,000 edges in 40 loose groups, contracted until a tenth of its edges are left, beside one task's way."""
    rng = random.Random(5)
    pairs = set()
    while len(pairs) < 10_000:
        a = rng.randrange(2000)
        b = rng.randrange(2000) if rng.random() < 0.25 else a // 50 * 50 + rng.randrange(50)
        if a != b:
            pairs.add((min(a, b), max(a, b)))
    edges = spark.createDataFrame([(f"n{a:04d}", f"n{b:04d}", 0.1 + rng.random()) for a, b in sorted(pairs)], "a string, b string, weight_jaccard double")
    nodes = edges.selectExpr("explode(array(a, b)) item").distinct()
    quality = [analysis.modularity(edges, communities.louvain(nodes, edges, one_task=limit)).first()["modularity"] for limit in (10**6, 1000)]
    assert quality[0] > 0.6 and quality[1] > quality[0] - 0.02


def test_contraction_keeps_weight(spark, cliques):
    nodes, edges = cliques
    groups = {}
    for r in communities.louvain(nodes, edges, one_task=2).collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sum(map(len, groups.values())) == 7 and len(groups) < 7


def test_analysis_orchestrates(spark, blocks, items):
    labels = items.select(F.col("parent_asin").alias("node"), F.element_at("categories", -1).alias("label"))
    out = communities.analyze(blocks, labels, min_shared_users=2, k_values=(2, 1), max_nodes=10)
    report = communities.analysis_report(out, {"min_shared_users": 2})
    assert json.loads(json.dumps(report)) == report and set(report["communities"]) == {"louvain", "leiden", "spectral_2", "spectral_1", "girvan_newman", "girvan_newman_largest"}
    found = report["communities"]["louvain"]
    assert found["n_communities"] == len(found["sizes"]) and sum(found["sizes"]) == 16 and found["modularity"] > 0.3 and found["alignment"]["purity"] == 1.0
    assert report["bipartite"]["user_degree"]["count"] == report["bipartite"]["users"] and report["projection"]["weight_count"]["count"] == report["projection"]["edges"]
    assert out["leiden"] is None and out["spectral_1"] is None and out["girvan_newman"] is None and out["louvain_alignment"].first()["purity"] == 1.0


# ---- stores and pipeline


def test_vector_store(spark, tmp_path):
    store, rng = VectorStore(spark, str(tmp_path)), np.random.default_rng(0)
    x = rng.normal(size=(50, 5))
    rows = spark.createDataFrame([(k, f"i{k}", v.tolist()) for k, v in enumerate(x)] + [(90, "n", None), (91, "z", [0.0] * 5), (92, "s", [1.0])], "id bigint, parent_asin string, vector array<double>")
    assert not store.has("c")
    store.insert("c", rows)
    store.insert("c", rows, reset=True)
    assert store.read("c").count() == 53
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    few, one = (sorted(map(tuple, search_vectors(rows, rows.where("id < 11"), 4, block=n).collect())) for n in (3, 100))
    assert few == one and len(few) == 44
    for r in store.search("c", rows.where("id < 3"), 4).collect():
        want = sorted(range(50), key=lambda k: (-round(float(unit[k] @ unit[r["query_id"]]), 12), k))[r["rank"] - 1]
        assert r["id"] == want
    assert search_vectors(rows, rows.limit(0), 3).count() == 0
    store.drop("c")
    assert not store.has("c")


def test_vector_artifacts(spark, tmp_path):
    good = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "parent_asin string, vector array<double>")
    good.write.parquet(str(tmp_path / "v"))
    assert load_vector_artifacts(spark, str(tmp_path / "none"), str(tmp_path / "v"), 2).count() == 2
    with pytest.raises(ValueError):
        load_vector_artifacts(spark, str(tmp_path / "v"), dim=3)
    with pytest.raises(FileNotFoundError):
        load_vector_artifacts(spark, str(tmp_path / "none"))
    write_embedding_preview(good, str(tmp_path / "p.csv"), 1, 3)
    assert (tmp_path / "p.csv").read_text().splitlines()[0] == "parent_asin,dim_0,dim_1,dim_2"


def test_graph_store(spark, toy, items, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    store.merge("users", toy.select("user_id").distinct(), "user_id")
    store.merge("users", spark.createDataFrame([("u1",), ("u9",)], "user_id string"), "user_id")
    assert store.read("users").count() == 6
    known = spark.createDataFrame([("i1",)], "parent_asin string")
    assert build.rated_edges(toy, known).count() == 4
    labels = spark.createDataFrame([("i1", "X"), ("i1", "A")], "parent_asin string, category string")
    r = build.top_items_of_user(toy, labels, 1).where("user_id = 'u1'").first()
    assert (r["parent_asin"], r["categories"]) == ("i1", ["A", "X"])
    payload = build.vector_payload(spark.createDataFrame([(1, "ai0", [1.0]), (2, "none", [1.0])], "id bigint, parent_asin string, vector array<float>"), items, [F.col("title")]).orderBy("id").collect()
    assert payload[0]["categories"] == "Root|Red" and (payload[1]["title"], payload[1]["price"]) == ("", None)


def test_records(spark, tmp_path):
    lines = '{"user_id":"u","parent_asin":"i","rating":5,"timestamp":1}\n\n{"user_id":"v","parent_asin":"i","rating":4.5}\n'
    (tmp_path / "a.jsonl").write_bytes(gzip.compress(lines.encode()))  # packed in spite of its name
    rows = R.variant_interactions(R.read_jsonl(spark, tmp_path / "a.jsonl.gz")).orderBy("user_id").collect()
    assert [(r["user_id"], r["rating"], r["timestamp"]) for r in rows] == [("u", 5.0, 1), ("v", 4.5, None)]
    assert R.read_jsonl(spark, tmp_path / "a.jsonl", limit=1).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"user_id": \n')
    with pytest.raises(Exception):  # noqa: B017
        R.read_jsonl(spark, tmp_path / "bad.jsonl").collect()
    with pytest.raises(FileNotFoundError):
        R.resolve_existing(tmp_path / "nothing.jsonl.gz")
    assert R.table_dir("x", "d", "leave_last_out") == R.table_dir("x", "d__leave_last_out", "leave_last_out") == "x/d__leave_last_out" and R.table_dir("s3a://b/", "d") == "s3a://b/d"
    one, two = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    assert R.key_hash(one, "k", "v") == R.key_hash(two, "k", "v") != R.key_hash(one, "k")
    calls = []
    R.download("url", tmp_path / "f", lambda u: (calls.append(u), open(tmp_path / "a.jsonl", "rb"))[1])
    R.download("url", tmp_path / "f", lambda u: calls.append(u))
    assert calls == ["url"]


def test_embedding_cache(spark, items, tmp_path):
    from tesselon.functions.vectors import hash_embedding

    made = R.store_embeddings(str(tmp_path), items, "parent_asin", F.col("text"), lambda c: hash_embedding(c, 4), "m")
    stamp = (tmp_path / "vectors.parquet").stat().st_mtime_ns
    assert made.count() == 16
    R.store_embeddings(str(tmp_path), items, "parent_asin", F.col("text"), lambda c: hash_embedding(c, 4), "m")
    assert (tmp_path / "vectors.parquet").stat().st_mtime_ns == stamp
    R.store_embeddings(str(tmp_path), items, "parent_asin", F.col("title"), lambda c: hash_embedding(c, 4), "m")
    assert (tmp_path / "vectors.parquet").stat().st_mtime_ns != stamp


def test_preprocess(spark, tmp_path):
    rows = frame(spark, [(f"u{u}", f"i{i}", 4.0, u * 10 + i) for u in range(3) for i in range(5)] + [(None, "i1", 1.0, 1)])
    meta = spark.createDataFrame([(f"i{i}", True, True, False) for i in range(7)], "parent_asin string, price_missing boolean, average_rating_missing boolean, rating_number_missing boolean")
    summary = preprocess(rows, meta, tmp_path, "d", k=2)
    assert (summary["raw_rows"], summary["valid_rows"], summary["train_rows"], summary["test_rows"], summary["price_missing_rate"]) == (16, 15, 12, 3, 1.0)
    assert spark.read.parquet(str(tmp_path / "d" / "metadata.parquet")).count() == 5
    preprocess(rows, meta, tmp_path, "d", k=2, protocol="leave_last_out")
    assert spark.read.parquet(str(tmp_path / "d__leave_last_out" / "validation.parquet")).count() == 3
    default = "per_user_chronological_80_20"
    assert R.split_protocol(spark, tmp_path, "d", "leave_last_out") == "leave_last_out" and R.split_protocol(spark, tmp_path, "d", default) == default
    assert R.split_protocol(spark, tmp_path, "d", "other") == default and R.split_protocol(spark, tmp_path, "none", "x") == "x"


def test_plugins_fall_back():
    from tesselon.models.plugins import build_embedder, build_scorer

    assert build_embedder(["no.such:thing", "json:nothing", "hash-32", "never"])[0] == "hash-32" and build_scorer(["lexicon"])[0] == "lexicon"
    with pytest.raises(RuntimeError):
        build_embedder(["no.such:thing"])


def test_category_artifacts(spark, tmp_path):
    from tesselon.operators import features

    items = spark.createDataFrame([("a", ["X", "Y"]), ("b", ["Y"]), ("c", None)], "parent_asin string, c array<string>")
    features.write_category_artifacts(str(tmp_path), items, F.coalesce("c", F.array().cast("array<string>")), "d", 10, 1)
    assert json.loads((tmp_path / "category_vocab.json").read_text()) == ["Y", "X"]
    assert {r["parent_asin"]: list(r["features"]) for r in spark.read.parquet(str(tmp_path / "item_features.parquet")).collect()} == {"a": [1.0, 1.0], "b": [1.0, 0.0], "c": [0.0, 0.0]}
    assert json.loads((tmp_path / "item_features_meta.json").read_text())["row_count"] == 3


def test_negatives_are_never_positive(spark):
    """Users with all but one, all, and few of 40 items positive."""
    from tesselon.models.lightgcn import free_items, negative_items

    rows = [(0, 3 + i) for i in range(40) if i != 37] + [(1, 3 + i) for i in range(40)] + [(2, 3), (2, 4), (2, 6)]
    positives = spark.createDataFrame(rows, "src bigint, dst bigint")
    assert {tuple(r) for r in free_items(positives, 3, 40).collect()} == {(0, 40), (2, 5)}
    got = negative_items(positives, 3, 40, 1, 2).collect()
    assert len(got) == 2 * len(rows) and all(3 <= r["neg"] < 43 for r in got)
    assert all((r["src"], r["neg"]) not in set(rows) for r in got if r["src"] != 1)


def test_sums_are_whole_however_little_is_gathered(spark, monkeypatch):
    from tesselon.models import propagation

    monkeypatch.setattr(propagation, "GATHER", 10)
    df = spark.range(3000).select((F.col("id") % 7).alias("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    want = {k: [float(sum(range(k, 3000, 7))), float(len(range(k, 3000, 7)))] for k in range(7)}
    assert {r["id"]: list(r["v"]) for r in propagation.sum_vectors(df).collect()} == want


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("active_dataset: g\nbase_url: http://x\ndatasets:\n  g: {category: G, k_core: 2}\npreprocessing: {test_size: 0.3}\n")
    c = Config.load(tmp_path / "c.yaml")
    assert (c.k_core, c["preprocessing"]["k_core"], c["preprocessing"]["test_size"], c.url("meta"), c.collection) == (2, 5, 0.3, "http://x/meta_categories/meta_G.jsonl.gz", "items_g_items")
    monkeypatch.delenv("GRAPH_PASSWORD", raising=False)
    with pytest.raises(RuntimeError):
        c.password()


def test_report(spark, tmp_path):
    items = spark.createDataFrame([("a", "Red Car"), ("b", None)], "i string, title string")
    assert [r["i"] for r in search_items(items, "red|blue", ("title",)).collect()] == ["a"] and search_items(items, "", ("title",)).count() == 2
    assert metric_table(spark.createDataFrame([("m", 1.0)], "model string, f1_at_k double"), ["f1_at_k", "none"]).columns == ["model", "f1_at_10"]
    nodes = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "id string, degree int")
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "source string, target string, weight double")
    assert graph_sample(nodes, edges, 2)[1].count() == 1
    to_json(items, tmp_path / "demo" / "x.json")
    out = load_dashboard(tmp_path / "local", tmp_path / "demo", ["x", "y"])
    assert out["mode"] == "demo" and len(out["x"]) == 2 and out["y"] is None and out["notes"] == ["y is missing"]
    with pytest.raises(ValueError):
        to_json(items, tmp_path / "z.json", 1)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("i1", 4.0, "2024-01-01 00:10:00"), ("i1", 2.0, "2024-01-01 00:50:00"), ("i2", None, "2024-01-01 05:00:00")], "parent_asin string, rating double, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", "parent_asin").writeStream.outputMode("append").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["parent_asin"], r["n"], r["total"]) for r in spark.table("w").collect()] == [("i1", 2, 6.0)]
    store = VectorStore(spark, str(tmp_path / "store"))
    q = stream.writeStream.foreachBatch(item_means_sink(store, "m")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["parent_asin"]: (r["n"], r["mean"]) for r in item_means(store, "m").collect()} == {"i1": (2, 3.0), "i2": (1, None)}
