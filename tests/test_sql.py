import pytest
from sqlcheck import check

from tesselon.plans import core_queries, graph_queries, model_queries, table_queries

CASES = [(core_queries, n) for n in core_queries.SQL] + [(m, n) for m, names in (
    (table_queries, ("dedup_latest", "kcore", "split_8020", "split_llo", "eda_summary", "category_filter", "user_aggregates", "rating_metrics")),
    (model_queries, ("means_fallback", "content_predict", "item_knn_predict", "calibrated_hybrid")),
    (graph_queries, ("item_projection", "connected_components", "clustering_coefficient", "modularity", "vector_topk", "vector_payload")),
) for n in names]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query_equals_its_sql(spark, module, name):
    check(spark, module, name)
