"""Queries over single operators that the others use inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import text as T
from tesselon.graph import build, communities
from tesselon.models.baselines import Popularity
from tesselon.models.hybrid import CalibratedHybrid
from tesselon.operators import eda, features, metrics, prep, ranking
from tesselon.plans import views
from tesselon.plans.graph_queries import _DEG, _graph, _proj_sql, LEAST
from tesselon.plans.table_queries import _GENEROSITY, _REVIEWS, scored, six
from tesselon.plans.views import D, M, P, SEED
from tesselon.session import store_table
from tesselon.sources import stores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {P} select parent_asin, round(avg(rating), 6) as mean from tr group by parent_asin")
def item_means(spark, d):
    return Popularity().fit(views.parts(spark, d)[0]).item_means.select("parent_asin", F.round("_im", 6).alias("mean"))


@query(f"with {P} select parent_asin, count(*) as degree from tr group by parent_asin")
def popularity_counts(spark, d):
    return eda.degrees(views.parts(spark, d)[0], "parent_asin")


@query(f"with {D} select coalesce(min(n), 0) as min_degree from (select count(*) as n from d group by user_id)")
def min_user_degree(spark, d):
    return eda.min_degree(views.interactions(spark, d), "user_id")


@query(f"with {D} select distinct user_id, ('0x' || right(sha256(user_id), 8))::bigint + {SEED} as seed from d")
def stable_seeds(spark, d):
    return views.interactions(spark, d).select("user_id", T.stable_seed(F.col("user_id"), SEED).alias("seed")).distinct()


@query(f"with {P}, {M}, {_REVIEWS}, {_GENEROSITY} select user_id, round(off, 6) as offset from o")
def generosity_offsets(spark, d):
    train, _ = views.parts(spark, d)
    return features.generosity(features.user_aggregates(train, scored(spark, d, train))).withColumns(six("offset"))


@query(f"with {P}, {M}, {_REVIEWS} select user_id, parent_asin, timestamp, round(score, 6) as sentiment_score from ts where score is not null")
def sentiment_scored(spark, d):
    train, _ = views.parts(spark, d)
    return scored(spark, d, train).select("user_id", "parent_asin", "timestamp", F.round("sentiment_score", 6).alias("sentiment_score"))


@query("""select item_ids as parent_asin, coalesce(substr(model_name, 1, 4), '') as model, len(embeddings) as dim from vector_artifacts qualify row_number() over (partition by item_ids order by row_pos) = 1""")
def keep_first(spark, d):
    """The first landed row of each item."""
    rows = spark.read.parquet(f"{d}/vector_artifacts.parquet")
    out = prep.keep_one(rows, "item_ids", [F.col("row_pos")], last=False)
    return out.select(F.col("item_ids").alias("parent_asin"), F.coalesce(T.optional_text(F.col("model_name"), 4), F.lit("")).alias("model"), F.when(F.col("embeddings").isNotNull(), F.size("embeddings")).cast("bigint").alias("dim"))


@query("""select row_pos, case when isnan(x) then null else cast(trunc(x) as bigint) end as whole, case when isnan(x) then null else round(x, 6) end as number from (select row_pos, case when row_pos % 5 = 0 then 'nan'::double else embeddings[1]::double * 100 end as x from vector_artifacts)""")
def optional_numbers(spark, d):
    x = F.when(F.col("row_pos") % 5 == 0, F.lit(float("nan"))).otherwise(F.get("embeddings", F.lit(0)).cast("double") * 100)
    rows = spark.read.parquet(f"{d}/vector_artifacts.parquet").select("row_pos", x.alias("x"))
    return rows.select("row_pos", T.optional_number(F.col("x"), "bigint").alias("whole"), F.round(T.optional_number(F.col("x"), "double"), 6).alias("number"))


@query(f"with {M} select parent_asin, coalesce(array_to_string(list_filter(categories, lambda c: c is not null and c <> ''), '|'), '') as categories from m")
def categories_joined(spark, d):
    return views.items(spark, d).select("parent_asin", T.categories_to_string(F.col("categories")).alias("categories"))


@query(f"with {D}, {M} select parent_asin, title from m where parent_asin in (select parent_asin from d)")
def metadata_of_interactions(spark, d):
    return prep.restrict(views.items(spark, d), views.interactions(spark, d), "parent_asin").select("parent_asin", "title")


@query(f"with {P} select count(*) as n from (select user_id, parent_asin from tr union select user_id, parent_asin from te where rating >= 4)")
def seen_or_relevant(spark, d):
    train, test = views.parts(spark, d)
    return metrics.seen_or_relevant(train, metrics.relevant_items(test)).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {D} select user_id, parent_asin, row_number() over (partition by user_id order by timestamp nulls first, parent_asin) as pos, count(*) over (partition by user_id) as cnt from d")
def user_positions(spark, d):
    out = ranking.add_position(views.interactions(spark, d), "user_id", [F.col("timestamp"), F.col("parent_asin")], F.floor(F.col("timestamp") / prep.SLOT_MS))
    return out.select("user_id", "parent_asin", F.col("_pos").alias("pos"), F.col("_cnt").alias("cnt"))


@query(f"with {P}, {_DEG} select item, degree from dg order by degree desc, item limit 50")
def top_degree_items(spark, d):
    train, _ = views.parts(spark, d)
    return build.project_items(train, 1, 50)[0]


@query(f"with {P}, {_DEG}, {_proj_sql(LEAST)}, kp as (select item from dg order by degree desc, item limit 80) select a, b, weight_count from pe where a in (select item from kp) and b in (select item from kp)")
def induced_subgraph(spark, d):
    nodes, edges = _graph(spark, d)
    return build.induced(edges, nodes.orderBy(F.desc("degree"), "item").limit(80)).select("a", "b", "weight_count")


@query("select vec_id as parent_asin, " + ", ".join(f"round(embedding[{i + 1}]::double, 6) as dim_{i}" for i in range(20)) + " from embeddings order by vec_id limit 10")
def embedding_preview(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("parent_asin"), F.col("embedding").alias("vector"))
    return stores.embedding_preview(vectors).withColumns({f"dim_{i}": F.round(F.col(f"dim_{i}").cast("double"), 6) for i in range(20)})


@query("select vec_id as parent_asin, len(embedding) as dim, round(list_sum(embedding)::double, 4) as total from embeddings")
def vector_lengths(spark, d):
    """Stored vectors as they are loaded, from the second of two folders as the first isn't there."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("parent_asin"), F.col("embedding").alias("vector"))
    folder = store_table(rows).inputFiles()[0].rpartition("/")[0]
    loaded = stores.load_vector_artifacts(spark, folder + "-none", folder)
    return loaded.select("parent_asin", F.size("vector").cast("bigint").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(f"with {P}, {_DEG} select substr(item, 3, 1) as community, count(*) as size from dg group by 1")
def community_sizes(spark, d):
    nodes = views.parts(spark, d)[0].select(F.col("parent_asin").alias("node")).distinct()
    return communities.serialized(nodes.withColumn("community", F.substring("node", 3, 1)))


@query(f"with {P}, im as (select parent_asin, avg(rating) as i from tr group by parent_asin) select round(avg(i), 6) as mean, round(stddev_pop(i), 6) as std, round(stddev_pop(rating), 6) as target_std from tr join im using (parent_asin)")
def rating_scale(spark, d):
    """What a calibrated hybrid keeps of its parts' estimates and of the ratings."""
    model = CalibratedHybrid(Popularity(), Popularity()).fit(views.parts(spark, d)[0])
    return model.stats.select(F.round("_fm", 6).alias("mean"), F.round("_fs", 6).alias("std"), F.round("_ts", 6).alias("target_std"))


@query("""with e as (select * from events where user_id is not null and ts is not null) select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from e group by all""")
def event_windows(spark, d):
    """The batch form of the streaming counts."""
    from tesselon.streaming.incremental import windowed_counts

    events = spark.read.parquet(f"{d}/events.parquet").where("user_id is not null and ts is not null").withColumnRenamed("value", "rating")
    return windowed_counts(events, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select * from (values ('f1_at_10', 0.4), ('model', 1.0), ('precision_at_10', 0.5)) t(metric, value)")
def metric_names(spark, d):
    from tesselon.report import metric_table

    table = metric_table(spark.createDataFrame([(1.0, 0.5, 0.4, 9.0)], "model double, precision_at_k double, f1_at_k double, other double"), ["precision_at_k", "f1_at_k", "absent"])
    return table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in table.columns])).alias("s")).select("s.*")


@query()
def bpr_negatives(spark, d):
    from tesselon.models.lightgcn import negative_items

    vertices, edges = build.indexed_graph(views.parts(spark, d)[0])
    n_users, n_items = vertices.where("kind = 'user'").count(), vertices.where("kind = 'item'").count()
    return negative_items(edges.where("positive").select("src", "dst").distinct(), n_users, n_items, SEED)


@query()
def louvain_top_community(spark, d):
    nodes, edges = _graph(spark, d)
    found = communities.louvain(nodes, edges)
    return communities.largest_community(nodes, edges, found, 50)[0]
