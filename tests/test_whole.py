"""Queries do the whole job that their operators do."""

import json

import pytest
from sqlcheck import check

from tesselon.cli import main
from tesselon.models.evaluate import build_models
from tesselon.operators import features
from tesselon.plans import graph_queries, model_queries, table_queries, views
from tesselon.sources.stores import GraphStore


def test_calibration_takes_all_training_rows(spark, monkeypatch):
    assert "limit 2000" not in model_queries.SQL["calibrated_hybrid"]
    check(spark, model_queries, "calibrated_hybrid")
    made = {}
    monkeypatch.setattr(model_queries, "evaluate_models", lambda models, *a, **k: made.update(models))
    model_queries.evaluate_all(spark, "/root/testdata/sf0.001")
    assert made["calibrated_hybrid"].max_rows is None


@pytest.mark.parametrize(("module", "name"), [(table_queries, "category_multi_hot"), (model_queries, "content_enriched_predict"), (model_queries, "item_node_features")])
def test_whole_vocabulary_equals_its_sql(spark, module, name):
    check(spark, module, name)


def test_vocabulary_is_the_operators(spark, monkeypatch):
    """Of 300 labels, each in five items, 256 are flags in every query that isn't bound by its SQL."""
    rows = [(f"i{k:04d}", f"t{k}", [f"Label{k % 300}"], None, None, None, None) for k in range(1500)]
    items = spark.createDataFrame(rows, "parent_asin string, title string, categories array<string>, store string, price double, average_rating double, rating_number bigint")
    monkeypatch.setattr(views, "items", lambda spark, d: items)
    assert table_queries.category_multi_hot(spark, "").select("category").distinct().count() == 256
    asked = []
    monkeypatch.setattr(model_queries, "scored", lambda *a: None)
    for name in ("item_aggregates", "user_aggregates", "generosity"):
        monkeypatch.setattr(features, name, lambda *a: None)
    monkeypatch.setattr(features, "item_node_features", lambda *a, max_vocab=256, **k: asked.append(max_vocab))
    for loss, kind in (("mse", "full"), ("bpr", "no_sentiment")):
        model_queries._sage(spark, "", None, loss, kind)
    assert asked == [256, 256] and model_queries._enriched(spark, "", None).options["max_vocab"] == 256


def test_co_rated_edges_equal_their_sql(spark):
    assert "limit 50000" in graph_queries.SQL["graph_co_rated_edges"]
    check(spark, graph_queries, "graph_co_rated_edges")


def test_all_co_rated_edges_are_kept_and_ingested(spark, tmp_path, monkeypatch):
    """25 items that all users rated have 300 pairs."""
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "T.jsonl").write_text("\n".join(json.dumps({"user_id": f"u{u}", "parent_asin": f"i{i:02d}", "rating": 5.0 - (u + i) % 3, "timestamp": 100 * u + i, "text": "good" if i % 2 else "bad"}) for u in range(4) for i in range(25)))
    (raw / "meta_T.jsonl").write_text("\n".join(json.dumps({"parent_asin": f"i{i:02d}", "title": f"thing {i}", "categories": ["Root", "Red"], "price": "$3", "average_rating": 4.0, "rating_number": i}) for i in range(25)))
    config = tmp_path / "c.yaml"
    config.write_text(f"raw_dir: {raw}\nprocessed_dir: {tmp_path / 'p'}\nactive_dataset: t\ndatasets: {{t: {{category: T, k_core: 2}}}}\npreprocessing: {{test_size: 0.04}}\ngraph_analysis: {{min_shared_users: 1}}\nstorage: {{vector_root: {tmp_path / 'v'}, graph_root: {tmp_path / 'g'}}}\n")
    for step in ("preprocess", "ingest-graph"):
        assert main(["--config", str(config), step]) == 0
    edges = GraphStore(spark, str(tmp_path / "g")).read("co_rated_with")
    assert edges.count() > 200
    monkeypatch.setattr(graph_queries, "_graph", lambda *a: (None, edges))
    monkeypatch.setattr(views, "items", lambda *a: edges.selectExpr("explode(array(a, b)) parent_asin").distinct())
    assert graph_queries.graph_co_rated_edges(spark, "").count() == edges.count()


def test_evaluate_makes_every_model_of_a_set(spark, tmp_path, monkeypatch):
    with pytest.raises(KeyError):
        build_models("graph_only", {})
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "T.jsonl").write_text("\n".join(json.dumps({"user_id": f"u{u}", "parent_asin": f"i{i}", "rating": 5.0 - (u * i + i) % 4, "timestamp": 100 * u + i, "text": "good great" if (u + i) % 3 else "bad awful"}) for u in range(6) for i in range(6)))
    (raw / "meta_T.jsonl").write_text("\n".join(json.dumps({"parent_asin": f"i{i}", "title": f"thing {i}", "categories": ["Root", "Red"], "price": "$3", "average_rating": 4.0, "rating_number": i}) for i in range(6)))
    config = tmp_path / "c.yaml"
    config.write_text(f"raw_dir: {raw}\nprocessed_dir: {tmp_path / 'p'}\nactive_dataset: t\ndatasets: {{t: {{category: T, k_core: 2}}}}\nranking: {{negatives: 3, seed: 1}}\ngraph: {{epochs: 1}}\n")
    run = lambda *a: main(["--config", str(config), *a])
    assert run("preprocess") == 0 and run("sentiment") == 0

    made = {}
    monkeypatch.setattr("tesselon.models.evaluate.evaluate_models", lambda models, *a, **k: made.update(models) or spark.range(0))
    assert run("evaluate", "--models", "graph_only") == 0 and list(made) == ["lightgcn", "graphsage", "graphsage_bpr"]
    made.clear()
    assert run("evaluate", "--models", "ablation") == 0
    for name, sentiment, offset in (("content_enriched", True, True), ("content_enriched_no_sentiment", False, False), ("content_enriched_no_offset", True, False)):
        model = made[name]
        assert model.options["aggregates"].count() == 5 and model.options["use_item_sentiment"] is sentiment
        assert (model.offsets is not None and model.offsets.count() == 6) is offset


def test_lightgcn_is_registered_with_its_defaults(spark, monkeypatch):
    from tesselon.models import lightgcn

    class Made(Exception):
        pass

    def fit(self, train):
        raise Made(self.dim, self.layers, self.epochs)

    monkeypatch.setattr(lightgcn.LightGCN, "fit", fit)
    with pytest.raises(Made) as made:
        model_queries.lightgcn(spark, "/root/testdata/sf0.001")
    assert made.value.args == (64, 2, 10)


def test_girvan_newman_takes_the_largest_community(spark, monkeypatch):
    """Two halves of 90 items, joined by one edge, of a ring each; a smaller third part is left out."""
    ring = lambda c, n: [(f"{c}{i:03d}", f"{c}{(i + 1) % n:03d}") for i in range(n)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), 3, 0.5) for a, b in [*ring("a", 90), *ring("b", 90), ("a000", "b000"), *ring("c", 5)]], "a string, b string, weight_count bigint, weight_jaccard double")
    nodes = edges.selectExpr("explode(array(a, b)) item").distinct()
    asked = []
    monkeypatch.setattr(graph_queries, "_graph", lambda spark, d, *limits: asked.append(limits[1:]) or (nodes, edges))
    monkeypatch.setattr(graph_queries.communities, "louvain", lambda n, e: n.selectExpr("item node", "if(item < 'c', 'a', 'c') community"))
    got = {r["node"]: r["community"] for r in graph_queries.girvan_newman(spark, "").collect()}
    assert asked == [()] and len(got) == 180 and {v[0] for v in got.values()} == {"a", "b"}
