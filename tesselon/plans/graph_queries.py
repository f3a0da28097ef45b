"""Queries over graphs and retrieval stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions import text as T
from tesselon.graph import analysis, build, communities
from tesselon.plans import views
from tesselon.plans.table_queries import L, six
from tesselon.plans.views import M, P, ROOTS
from tesselon.session import store_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_IDX = "us as (select user_id, row_number() over (order by user_id) - 1 as u from (select distinct user_id from tr)), it as (select parent_asin, row_number() over (order by parent_asin) - 1 + (select count(*) from us) as i from (select distinct parent_asin from tr)), ed as (select u as src, i as dst, rating from tr join us using (user_id) join it using (parent_asin))"


@query(f"with {P}, {_IDX} select src, dst, rating from ed union all select dst, src, rating from ed")
def graph_edges_observed(spark, d):
    _, edges = build.indexed_graph(views.parts(spark, d)[0])
    return build.both_ways(edges.select("src", "dst", "rating"))


@query(f"with {P}, {_IDX} select src, dst from ed where rating >= 4 union all select dst, src from ed where rating >= 4")
def graph_edges_positive(spark, d):
    _, edges = build.indexed_graph(views.parts(spark, d)[0])
    return build.both_ways(edges.where("positive").select("src", "dst"))


_DEG = "dg as materialized (select parent_asin as item, count(*) as degree from tr group by parent_asin)"


def _proj_sql(least: int, rows: str = "tr", out: str = "pe") -> str:
    return f"""{out}c as (select a.parent_asin as a, b.parent_asin as b, count(*) as weight_count from {rows} a join {rows} b on a.user_id = b.user_id and a.parent_asin < b.parent_asin group by all having count(*) >= {least}),
    {out} as materialized (select a, b, weight_count, weight_count / (x.degree + y.degree - weight_count) as weight_jaccard from {out}c join dg x on x.item = a join dg y on y.item = b)"""


LEAST = 3


def _graph(spark: SparkSession, d: str, least: int = LEAST, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    nodes, edges = build.project_items(views.parts(spark, d)[0], least, top)
    return store_table(nodes), store_table(edges)


@query(f"with {P}, {_DEG}, {_proj_sql(LEAST)} select a, b, weight_count, round(weight_jaccard, 6) as weight_jaccard from pe")
def item_projection(spark, d):
    return build.project_items(views.parts(spark, d)[0], LEAST)[1].withColumns(six("weight_jaccard"))


@query(f"with {P}, {_DEG}, tp as (select item from dg order by degree desc, item limit 100), t2 as (select * from tr where parent_asin in (select item from tp)), {_proj_sql(1, 't2')} select a, b, weight_count, round(weight_jaccard, 6) as weight_jaccard from pe")
def item_projection_topn(spark, d):
    return build.project_items(views.parts(spark, d)[0], 1, 100)[1].withColumns(six("weight_jaccard"))


@query(f"with {P}, {_DEG}, {_proj_sql(LEAST)} select a as row, b as col, round(weight_jaccard, 6) as value from pe union all select b, a, round(weight_jaccard, 6) from pe")
def sparse_adjacency(spark, d):
    return build.adjacency(_graph(spark, d)[1]).withColumns(six("value"))


def _components_sql(nodes: str, edges: str) -> str:
    return f"""ew as materialized (select a, b from {edges} union select b, a from {edges}), cc(node, comp) as (select n, n from {nodes} union select b, comp from cc join ew on node = a), co as materialized (select node, min(comp) as component from cc group by node)"""


@query(f"with recursive {P}, {_DEG}, {_proj_sql(LEAST)}, nn as (select item as n from dg), {_components_sql('nn', 'pe')} select node, component from co")
def connected_components(spark, d):
    nodes, edges = _graph(spark, d)
    return analysis.connected_components(nodes.select("item"), edges)


@query(f"""with recursive {P}, {_DEG}, {_proj_sql(LEAST)}, nn as (select item as n from dg), {_components_sql('nn', 'pe')}, cs as (select component, count(*) as n from co group by component), n as (select count(*)::double as n from dg), e as (select count(*) as e, avg(weight_count) as w from pe)
    select n::bigint as nodes, e as edges, round(2 * e / (n * (n - 1)), 9) as density, round(2 * e / n, 6) as mean_degree, round(w, 6) as mean_weight, (select count(*) from cs) as components, (select max(n) from cs) as largest from n, e""")
def projection_eda(spark, d):
    return analysis.projection_facts(*_graph(spark, d)).withColumns({"density": F.round("density", 9), **six("mean_degree", "mean_weight")})


@query(f"""with recursive {P}, be as (select 'u:' || user_id as a, 'i:' || parent_asin as b from tr), nn as (select a as n from be union select b from be), {_components_sql('nn', 'be')}, cs as (select component, count(*) as n from co group by component)
    select (select count(distinct a) from be) as users, (select count(distinct b) from be) as items, (select count(*) from be) as edges, round((select count(*) from be) / ((select count(distinct a) from be) * (select count(distinct b) from be)), 9) as density, (select count(*) from cs) as components, (select max(n) from cs) as largest""".replace("cc(node, comp) as (select n, n from nn union select b, comp from cc join ew on node = a)", "cc(node, comp) as (select n, n from nn union select b, min(comp) from cc join ew on node = a group by b)"))
def bipartite_eda(spark, d):
    return analysis.bipartite_facts(build.bipartite_graph(views.parts(spark, d)[0])).withColumn("density", F.round("density", 9))


@query(f"with {P}, {_DEG}, {_proj_sql(LEAST)}, ew as (select a as item from pe union all select b from pe), x as (select dg.item, count(ew.item) as d from dg left join ew using (item) group by dg.item) select count(d) as count, min(d) as min, max(d) as max, round(avg(d), 6) as mean, cast(floor(quantile_cont(d, 0.5)) as bigint) as median, round(stddev_pop(d), 6) as std from x")
def projection_degrees(spark, d):
    return analysis.degree_facts(*_graph(spark, d)).withColumns(six("mean", "std"))


def _summary_sql(**parts: tuple[str, str, bool]) -> str:
    """Rows of ``analysis.bipartite_summaries`` and ``projection_summaries``: (table, column, whole numbers) by name."""
    middle = lambda c, whole: f"floor(quantile_cont({c}, 0.5))" if whole else f"quantile_cont({c}, 0.5)"
    return " union all ".join(f"select '{n}' as value, count({c}) as count, round(min({c}), 6)::double as min, round(max({c}), 6)::double as max, round(avg({c}), 6) as mean, round({middle(c, w)}, 6)::double as median, round(stddev_pop({c}), 6) as std from {t}" for n, (t, c, w) in parts.items())


_NUMBERS = ("min", "max", "mean", "median", "std")


@query(f"with recursive {P}, {_DEG}, {_proj_sql(LEAST)}, nn as (select item as n from dg), {_components_sql('nn', 'pe')}, cs as (select component, count(*) as n from co group by component), ends as (select a as item from pe union all select b from pe), x as (select dg.item, count(ends.item) as d from dg left join ends using (item) group by dg.item) {_summary_sql(degree=('x', 'd', True), component_size=('cs', 'n', True), weight_count=('pe', 'weight_count', True), weight_jaccard=('pe', 'weight_jaccard', False))}")
def projection_summaries(spark, d):
    return analysis.projection_summaries(*_graph(spark, d)).withColumns(six(*_NUMBERS))


@query(SQL["bipartite_eda"].split(" select (select count(distinct a)")[0].split("\n    select (select")[0] + f", ud as (select a, count(*) as d from be group by a), im as (select b, count(*) as d from be group by b) {_summary_sql(user_degree=('ud', 'd', True), item_degree=('im', 'd', True), component_size=('cs', 'n', True))}")
def bipartite_summaries(spark, d):
    return analysis.bipartite_summaries(build.bipartite_graph(views.parts(spark, d)[0])).withColumns(six(*_NUMBERS))


@query(f"""with {P}, {_DEG}, {_proj_sql(LEAST)}, mx as (select max(weight_jaccard) as m from pe), w as materialized (select a, b, weight_jaccard / m as w from pe, mx), dd as (select n, count(*) as d from (select a as n from w union all select b from w) group by n),
    t as (select x.a as i, x.b as j, y.b as k, cbrt(x.w * y.w * z.w) as v from w x join w y on y.a = x.b join w z on z.a = x.a and z.b = y.b), sn as (select n, sum(v) as v from (select i as n, v from t union all select j, v from t union all select k, v from t) group by n)
    select round(coalesce(sum(2 * v / (d * (d - 1))), 0) / (select count(*) from dg), 6) as clustering from sn join dd using (n)""")
def clustering_coefficient(spark, d):
    return analysis.clustering(*_graph(spark, d)).withColumns(six("clustering"))


#: Communities by a fixed rule, the label of an item; items without one are communities of their own.
_COMM = f"{L[len(M) + 2:]}, lb as (select parent_asin, arg_max(category, pos) as label from l group by parent_asin), cm as materialized (select item as node, substr(item, 3, 1) as community, label from dg left join lb on lb.parent_asin = item)"


def _ruled(spark, d, nodes):
    return nodes.select(F.col("item").alias("node"), F.substring("item", 3, 1).alias("community"))


def _item_labels(spark, d):
    labels = T.filter_categories(F.col("categories"), ROOTS)
    return views.items(spark, d).select(F.col("parent_asin").alias("node"), F.when(F.size(labels) > 0, F.element_at(labels, -1)).alias("label"))


@query(f"with {P}, {M}, {_DEG}, {_proj_sql(LEAST)}, {_COMM}, e as (select weight_jaccard as w, x.community as ca, y.community as cb from pe join cm x on x.node = a join cm y on y.node = b), m as (select sum(w) as m from e), k as (select c, sum(w) as k from (select ca as c, w from e union all select cb, w from e) group by c), i as (select ca as c, sum(w) as l from e where ca = cb group by ca) select round(sum(coalesce(l, 0) / m.m - pow(k / (2 * m.m), 2)), 6) as modularity from k left join i using (c), m".replace("m as (select sum(w) as m from e)", "mm as (select sum(w) as m from e)").replace("(c), m", "(c), mm").replace("m.m", "mm.m"))
def modularity(spark, d):
    nodes, edges = _graph(spark, d)
    return analysis.modularity(edges, _ruled(spark, d, nodes)).withColumns(six("modularity"))


@query(f"""with {P}, {M}, {_DEG}, {_COMM}, cl as (select community, label, count(*) as n from cm where label is not null group by all), tt as (select sum(n) as t from cl), uu as (select community, sum(n) as nc, max(n) as best from cl group by 1), vv as (select label, sum(n) as nl from cl group by 1)
    select (select t from tt)::bigint as n, round((select sum(best) from uu) / (select t from tt), 6) as purity, round((select sum(n / t * ln(n * t / (nc * nl))) from cl join uu using (community) join vv using (label), tt) / (((select -sum(nc / t * ln(nc / t)) from uu, tt) + (select -sum(nl / t * ln(nl / t)) from vv, tt)) / 2), 6) as nmi""")
def community_alignment(spark, d):
    nodes = views.parts(spark, d)[0].select(F.col("parent_asin").alias("item")).distinct()
    return analysis.alignment(_ruled(spark, d, nodes), _item_labels(spark, d)).withColumns(six("purity", "nmi"))


@query()
def louvain(spark, d):
    return communities.louvain(*_graph(spark, d))


@query()
def louvain_quality(spark, d):
    nodes, edges = _graph(spark, d)
    found = store_table(communities.louvain(nodes, edges))
    return analysis.modularity(edges, found).join(analysis.alignment(found, _item_labels(spark, d)), F.lit(True))


@query()
def girvan_newman(spark, d):
    """Of the largest Louvain community, as in ``communities.analyze``."""
    nodes, edges = _graph(spark, d)
    found = store_table(communities.louvain(nodes, edges))
    return communities.girvan_newman(*communities.largest_community(nodes, edges, found))


@query()
def spectral_pic(spark, d):
    nodes, edges = _graph(spark, d)
    return communities.spectral(nodes, edges, 4)


# ---- retrieval


@query("""with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as sim from q, embeddings e)
    select query_id, rank, vec_id, round(sim, 6) as sim from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from s) where rank <= 10""")
def vector_topk(spark, d):
    """The queries are the vectors whose id is divisible by 100, against all vectors."""
    from tesselon.sources.stores import search_vectors

    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search_vectors(vectors, vectors.where("id % 100 = 0"), 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


_VP = "vp as (select row_pos as id, item_ids as parent_asin, embeddings as vector from vector_artifacts where embeddings is not null)"


@query(f"""with {M}, {_VP} select id, vp.parent_asin, coalesce(title, '') as title, coalesce(array_to_string(list_filter(categories, lambda c: c is not null and c <> ''), '|'), '') as categories, store, round(price::float, 4) as price, round(average_rating::float, 4) as average_rating, rating_number, len(vector) as dim from vp left join m using (parent_asin)""")
def vector_payload(spark, d):
    vectors = spark.read.parquet(f"{d}/vector_artifacts.parquet").where("embeddings is not null").select(F.col("row_pos").alias("id"), F.col("item_ids").alias("parent_asin"), F.col("embeddings").alias("vector"))
    out = build.vector_payload(vectors, views.items(spark, d), [F.col("parent_asin")])
    return out.select("id", "parent_asin", "title", "categories", "store", *[F.round(c, 4).alias(c) for c in ("price", "average_rating")], "rating_number", F.size("vector").cast("bigint").alias("dim"))


@query(f"with {P}, {M} select user_id, parent_asin, rating, timestamp, 'train' as split from tr semi join m using (parent_asin)")
def graph_rated_edges(spark, d):
    return build.rated_edges(views.parts(spark, d)[0], views.items(spark, d)).select("user_id", "parent_asin", "rating", "timestamp", "split")


@query(f"with {L} select distinct parent_asin, category from l")
def graph_category_edges(spark, d):
    return build.category_edges(views.items(spark, d), T.filter_categories(F.col("categories"), ROOTS))


@query(f"with {P}, {M}, {_DEG}, {_proj_sql(LEAST)} select a, b, weight_count, round(weight_jaccard, 6) as weight_jaccard from pe where a in (select parent_asin from m) and b in (select parent_asin from m) order by weight_count desc, a, b limit 50000")
def graph_co_rated_edges(spark, d):
    """With the operator's own number of edges."""
    return build.co_rated_edges(_graph(spark, d)[1], views.items(spark, d)).withColumns(six("weight_jaccard"))


@query(f"""with {P}, {M}, {L[len(M) + 2:]}, re as (select tr.* from tr semi join m using (parent_asin)), k as (select *, row_number() over (partition by user_id order by rating desc, parent_asin) as rank from re qualify rank <= 3), c as (select parent_asin, string_agg(distinct category, '|' order by category) as cs from l group by 1)
    select user_id, rank, parent_asin, rating, coalesce(cs, '') as categories from k left join c using (parent_asin)""")
def graph_user_top_items(spark, d):
    items = views.items(spark, d)
    rated = build.rated_edges(views.parts(spark, d)[0], items)
    out = build.top_items_of_user(rated, build.category_edges(items, T.filter_categories(F.col("categories"), ROOTS)), 3)
    return out.withColumn("categories", F.array_join("categories", "|"))


@query(f"""with {P}, {_DEG}, {_proj_sql(LEAST)}, nd as (select item as id, count(pe.a) as degree from dg left join pe on item = a or item = b group by item), kp as (select * from nd order by degree desc, id limit 60)
    select a as source, b as target, weight_count as weight from pe where a in (select id from kp) and b in (select id from kp) order by weight desc, source, target limit 150""")
def degree_cap(spark, d):
    from tesselon.report import graph_sample

    nodes, edges = _graph(spark, d)
    degree = build.both_ways(edges.select("a", "b"), "a", "b").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.select(F.col("item").alias("id")).join(degree, "id", "left").fillna(0, subset=["degree"])
    return graph_sample(nodes, edges.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("weight_count").alias("weight")), 60, 150)[1]
