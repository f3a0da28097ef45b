"""Queries over recommenders and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.models.baselines import Popularity, RandomOrder
from tesselon.models.collaborative import BiasedALS, ItemKNN
from tesselon.models.content import ContentBased, ContentEnriched
from tesselon.models.evaluate import evaluate_models
from tesselon.models.hybrid import CalibratedHybrid, WeightedHybrid, tune_alpha
from tesselon.operators import features
from tesselon.functions import text as T
from tesselon.plans import table_queries as tq, views
from tesselon.plans.table_queries import BUNDLES, CAND, L, MEANS, POP, _AVG_BUNDLE, _GENEROSITY, _REVIEWS, candidates, scored, six
from tesselon.plans.views import M, P, ROOTS, SEED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _est(df: DataFrame) -> DataFrame:
    return df.select("user_id", "parent_asin", F.round("est", 6).alias("est"))


def _text_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose ``text`` is what content models embed: title and description, which SQL can cut into words too."""
    items = views.items(spark, d)
    return items.withColumn("text", features.embed_text(items))


_CLIP = "least(5, greatest(1, {}))"
_FALL = "coalesce(im.i, um.u, gm.g)"


@query(f"with {P}, {MEANS} select te.user_id, te.parent_asin, round({_CLIP.format(_FALL)}, 6) as est from te left join im using (parent_asin) left join um using (user_id), gm")
def means_fallback(spark, d):
    train, test = views.parts(spark, d)
    return _est(Popularity().fit(train).predict(test))


@query(f"with {P}, {CAND}, {POP}, rr as (select cand.*, row_number() over (partition by user_id order by coalesce(n, 0) desc, parent_asin) as rank from cand left join pop using (parent_asin) anti join tr using (user_id, parent_asin)) select user_id, parent_asin, rank from rr where rank <= 10")
def popularity_topk(spark, d):
    train, test = views.parts(spark, d)
    return Popularity().fit(train).recommend(candidates(train, test), 10).select("user_id", "parent_asin", "rank")


@query(f"""with {P}, {POP}, q as (select parent_asin, row_number() over (order by n desc, parent_asin) as p from pop), u as (select t.user_id, count(distinct tr.parent_asin) as s from (select distinct user_id from te) t left join tr using (user_id) group by all),
    r as (select user_id, parent_asin, row_number() over (partition by user_id order by p) as rank from (select user_id, parent_asin, p from u join q on p <= 5 + s) anti join tr using (user_id, parent_asin)) select * from r where rank <= 5""")
def popularity_catalog(spark, d):
    """Over the whole catalogue."""
    train, test = views.parts(spark, d)
    return Popularity().fit(train).recommend_all(test, 5).select("user_id", "parent_asin", "rank")


@query(f"with {P}, {CAND}, r as (select cand.*, row_number() over (partition by user_id order by md5('{SEED}|' || user_id || '|' || parent_asin), parent_asin) as rank from cand anti join tr using (user_id, parent_asin)) select user_id, parent_asin, rank from r where rank <= 10")
def random_topk(spark, d):
    train, test = views.parts(spark, d)
    return RandomOrder(SEED).fit(train).recommend(candidates(train, test), 10).select("user_id", "parent_asin", "rank")


# ---- content


_E = tq.E
_NUMS = ", ".join(f"({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end as {c}" for c in features.NUMERIC)
#: ft(parent_asin, f): embedding of title and description, standardised numbers, of length 1.
_FT = f"""z as (select parent_asin, {_NUMS} from m), eb as (select parent_asin, list(coalesce(n, 0)::double order by b) as e from (select parent_asin, b from m, range(32) r(b)) left join em on em.parent_asin = parent_asin and em.bucket = b group by parent_asin),
    f0 as (select parent_asin, e || [price, average_rating, rating_number] as f from eb join z using (parent_asin)), ft as materialized (select parent_asin, list_transform(f, lambda x: x / case when list_dot_product(f, f) = 0 then 1 else sqrt(list_dot_product(f, f)) end) as f from f0)"""
_FT = _FT.replace("eb as (select parent_asin, list(coalesce(n, 0)::double order by b) as e from (select parent_asin, b from m, range(32) r(b)) left join em on em.parent_asin = parent_asin and em.bucket = b group by parent_asin)", "eb as (select x.parent_asin, list(coalesce(n, 0)::double order by b) as e from (select parent_asin, b from m, range(32) r(b)) x left join em on em.parent_asin = x.parent_asin and em.bucket = b group by x.parent_asin)")


def _content_sql(pairs: str, out: str, off: str = "0", ft: str = "ft", join: str = "") -> str:
    """``out``(user_id, parent_asin, est): for the pairs in ``pairs``."""
    return f"""{out}x as (select t.user_id, t.parent_asin, sum(list_dot_product(a.f, b.f) * h.rating) as w, sum(abs(list_dot_product(a.f, b.f))) as s from (select distinct user_id, parent_asin from {pairs}) t join {ft} a using (parent_asin) join tr h on h.user_id = t.user_id and h.parent_asin <> t.parent_asin join {ft} b on b.parent_asin = h.parent_asin group by all),
    {out} as materialized (select t.*, {_CLIP.format(f"coalesce(w / nullif(s, 0), {_FALL}) + {off}")} as est from {pairs} t left join {out}x using (user_id, parent_asin) left join im using (parent_asin) left join um using (user_id) {join}, gm)"""


@query(f"with {P}, {M}, {_E}, {MEANS}, {_FT}, {_content_sql('te', 'ce')} select user_id, parent_asin, round(est, 6) as est from ce")
def content_predict(spark, d):
    train, test = views.parts(spark, d)
    return _est(ContentBased(order=views.item_order()).fit(train, _text_items(spark, d)).predict(test))


#: fe(parent_asin, f): embedding, category flags, standardised numbers and sentiment, of length 1.
_VOC = tq._VOCAB.format(n=5, m=256)
_FE = f"""{_VOC}, ia as (select parent_asin, avg(rating) as r, coalesce(avg(score), 0) as s from ts group by parent_asin),
    s0 as (select m.parent_asin, coalesce(s, 0) as sm, coalesce(r - s, 0) as gp from m left join ia using (parent_asin)),
    s1 as (select parent_asin, [(sm - avg(sm) over ()) / case when stddev_pop(sm) over () = 0 then 1 else stddev_pop(sm) over () end, (gp - avg(gp) over ()) / case when stddev_pop(gp) over () = 0 then 1 else stddev_pop(gp) over () end] as sv from s0),
    mh as (select x.parent_asin, list((case when l.category is null then 0 else 1 end)::double order by x.col) as c from (select parent_asin, category, col from m, vocab) x left join l on l.parent_asin = x.parent_asin and l.category = x.category group by x.parent_asin),
    g0 as (select parent_asin, e || c || [price, average_rating, rating_number] || sv as f from eb join z using (parent_asin) join mh using (parent_asin) join s1 using (parent_asin)),
    fe as materialized (select parent_asin, list_transform(f, lambda x: x / case when list_dot_product(f, f) = 0 then 1 else sqrt(list_dot_product(f, f)) end) as f from g0)"""
_LABELS = L[len(M) + 2 :]


def _enriched(spark, d, train, max_vocab=256):
    sentiment = scored(spark, d, train)
    return ContentEnriched(order=views.item_order(), labels=T.filter_categories(F.col("categories"), ROOTS), aggregates=features.item_aggregates(train, sentiment), offsets=features.generosity(features.user_aggregates(train, sentiment)), max_vocab=max_vocab)


@query(f"with {P}, {M}, {_REVIEWS}, {_GENEROSITY}, {_LABELS}, {_E}, {MEANS}, {_FT}, {_FE}, {_content_sql('te', 'ce', 'coalesce(o.off, 0)', 'fe', 'left join o using (user_id)')} select user_id, parent_asin, round(est, 5) as est from ce")
def content_enriched_predict(spark, d):
    """With the operator's own size of vocabulary."""
    train, test = views.parts(spark, d)
    return _enriched(spark, d, train).fit(train, views.items(spark, d)).predict(test).select("user_id", "parent_asin", F.round("est", 5).alias("est"))


def _node_features(spark, d, max_vocab):
    train, _ = views.parts(spark, d)
    out = _enriched(spark, d, train, max_vocab).item_features(views.items(spark, d))
    return out.select("parent_asin", F.posexplode("features").alias("pos", "x")).select("parent_asin", (F.col("pos") + 1).alias("pos"), F.round("x", 5).alias("x"))


@query(f"with {P}, {M}, {_REVIEWS}, {_LABELS}, {_E}, {_FT}, {_FE} select parent_asin, pos, round(x, 5) as x from (select parent_asin, unnest(f) as x, generate_subscripts(f, 1) as pos from fe)")
def item_node_features(spark, d):
    """With the operator's own size of vocabulary."""
    return _node_features(spark, d, 256)


# ---- neighbourhoods and hybrids


def _knn_sql(pairs: str, out: str) -> str:
    return f"""{out}q as (select distinct user_id, parent_asin from {pairs}), {out}m as (select q.user_id, q.parent_asin, h.parent_asin as j, h.rating as rj from {out}q q join im using (parent_asin) join tr h using (user_id)),
    {out}s as (select a.parent_asin, b.parent_asin as j, 1 / (1 + avg(pow(a.rating - b.rating, 2))) as sim from tr a join tr b using (user_id) where a.parent_asin in (select parent_asin from {out}q) group by all),
    {out}n as (select x.*, sim, im.i as jm from {out}m x join {out}s using (parent_asin, j) join im on im.parent_asin = j qualify row_number() over (partition by user_id, x.parent_asin order by sim desc, j) <= 40),
    {out}d as (select user_id, parent_asin, sum(sim * (rj - jm)) / sum(sim) as dev from {out}n group by all),
    {out} as materialized (select t.*, {_CLIP.format("case when im.i is not null and um.u is not null then im.i + coalesce(dev, 0) else gm.g end")} as est from {pairs} t left join im using (parent_asin) left join um using (user_id) left join {out}d using (user_id, parent_asin), gm)"""


@query(f"with {P}, {MEANS}, {_knn_sql('te', 'kn')} select user_id, parent_asin, round(est, 6) as est from kn")
def item_knn_predict(spark, d):
    train, test = views.parts(spark, d)
    return _est(ItemKNN().fit(train).predict(test))


_BOTH = f"{_content_sql('te', 'ce')}, {_knn_sql('te', 'kn')}"
_HEAD = f"with {P}, {M}, {_E}, {MEANS}, {_FT}"


def _blend_parts():
    return ItemKNN(), ContentBased(order=views.item_order())


@query(f"{_HEAD}, {_BOTH} select user_id, parent_asin, round({_CLIP.format('0.3 * kn.est + 0.7 * ce.est')}, 6) as est from kn join ce using (user_id, parent_asin)")
def hybrid_blend(spark, d):
    train, test = views.parts(spark, d)
    return _est(WeightedHybrid(*_blend_parts(), alpha=0.3).fit(train, _text_items(spark, d)).predict(test))


_CAL = f"""cr as materialized (select * from tr), {_content_sql('cr', 'cc')}, {_knn_sql('cr', 'ck')},
    st as (select avg(ck.est) as fm, stddev_pop(ck.est) as fs, avg(cc.est) as cm, stddev_pop(cc.est) as cs, stddev_pop(ck.rating) as t from ck join cc using (user_id, parent_asin))"""


@query(f"{_HEAD}, {_BOTH}, {_CAL} select user_id, parent_asin, round({_CLIP.format('0.4 * (g + (kn.est - fm) / fs * t) + 0.6 * (g + (ce.est - cm) / cs * t)')}, 5) as est from kn join ce using (user_id, parent_asin), st, gm")
def calibrated_hybrid(spark, d):
    """Calibrated on all training rows, as the class does unless told otherwise."""
    train, test = views.parts(spark, d)
    model = CalibratedHybrid(*_blend_parts(), alpha=0.4, seed=SEED).fit(train, _text_items(spark, d))
    return model.predict(test).select("user_id", "parent_asin", F.round("est", 5).alias("est"))


GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
_VAL = """b0 as (select *, row_number() over (partition by user_id order by timestamp desc nulls first, parent_asin desc) as back, count(*) over (partition by user_id) as n from tr), b1 as (select *, floor(n * cast(0.1 as double)) as f from b0), b2 as materialized (select *, case when f = 0 and n >= 2 then 1 when f >= n then 0 else f end as n_val from b1)"""


def _tuning_sql() -> str:
    head = P.replace("tr as materialized", "tr0 as materialized")
    val = _VAL.replace("from tr)", "from tr0)")
    return f"with {head}, {val}, tr as materialized (select user_id, parent_asin, rating, timestamp from b2 where back > n_val), va as materialized (select user_id, parent_asin, rating from b2 where back <= n_val), {M}, {_E}, {MEANS}, {_FT}, {_content_sql('va', 'ce')}, {_knn_sql('va', 'kn')}, e as (select a as alpha, sqrt(avg(pow({_CLIP.format('a * kn.est + (1 - a) * ce.est')} - kn.rating, 2))) as rmse from kn join ce using (user_id, parent_asin), (values {', '.join(f'({a}::double)' for a in GRID)}) g(a) group by a) select alpha, round(rmse, 6) as rmse, cast(row_number() over (order by rmse, alpha) = 1 as int) as best from e"


@query(_tuning_sql())
def alpha_tuning(spark, d):
    train, _ = views.parts(spark, d)
    best, errors = tune_alpha(train, _text_items(spark, d), *_blend_parts(), GRID, 0.1, SEED)
    return errors.select("alpha", F.round("rmse", 6).alias("rmse"), (F.col("alpha") == best).cast("int").alias("best"))


# ---- evaluation of several models over the same candidates


def _evaluated_sql() -> str:
    return f"""with {P}, {CAND}, {POP}, {MEANS}, pe as (select te.rating, {_CLIP.format(_FALL)} as e from te left join im using (parent_asin) left join um using (user_id), gm),
    sco as (select user_id, c.parent_asin, is_rel, coalesce(n, 0) as score from cand c left join pop using (parent_asin)),
    rk as materialized (select *, row_number() over (partition by user_id order by score desc, parent_asin) as rank from sco anti join tr using (user_id, parent_asin) qualify rank <= 10), {BUNDLES}
    select 'popularity' as model, (select round(sqrt(avg(pow(rating - e, 2))), 6) from pe) as rmse, (select round(avg(abs(rating - e)), 6) from pe) as mae, count(*) as n_eval_users, 10 as k, {_AVG_BUNDLE} from bu"""


@query(_evaluated_sql())
def evaluate_popularity(spark, d):
    train, test = views.parts(spark, d)
    out = evaluate_models({"popularity": Popularity()}, train, test, None, k=10, negatives=50, seed=SEED)
    return out.select("model", *[F.round(c, 6).alias(c) if c in ("rmse", "mae") or c.endswith("_at_k") else F.col(c) for c in out.columns if c != "model"])


@query()
def evaluate_all(spark, d):
    """Every set-oriented model over the same candidates."""
    train, test = views.parts(spark, d)
    items = _text_items(spark, d)
    knn, content = _blend_parts()
    models = {"random": RandomOrder(SEED), "popularity": Popularity(), "content": content, "item_knn": knn, "svd": BiasedALS(), "hybrid": WeightedHybrid(knn, content), "calibrated_hybrid": CalibratedHybrid(knn, content)}
    return evaluate_models(models, train, test, items, k=10, negatives=50, seed=SEED)


@query()
def als_svd(spark, d):
    train, test = views.parts(spark, d)
    return _est(BiasedALS().fit(train).predict(test))


# ---- graph models


@query()
def lightgcn(spark, d):
    from tesselon.models.lightgcn import LightGCN

    train, test = views.parts(spark, d)
    return _est(LightGCN(seed=SEED).fit(train).predict(test))


def _sage(spark, d, train, loss, feature_set="full"):
    from tesselon.models.graphsage import GraphSAGE

    text, categories, numbers, sentiment, _ = features.FEATURE_SETS[feature_set]
    scores = scored(spark, d, train)
    item_features = None
    if feature_set != "structure_only":
        item_features = features.item_node_features(views.items(spark, d), views.item_order(), labels=T.filter_categories(F.col("categories"), ROOTS), aggregates=features.item_aggregates(train, scores), use_text=text, use_categories=categories, use_numeric=numbers, use_item_sentiment=sentiment)
    return GraphSAGE(item_features, loss, features.generosity(features.user_aggregates(train, scores)), feature_set, hidden=32, epochs=20, seed=SEED)


@query()
def graphsage(spark, d):
    train, test = views.parts(spark, d)
    return _est(_sage(spark, d, train, "mse").fit(train).predict(test))


@query()
def graphsage_bpr(spark, d):
    train, test = views.parts(spark, d)
    return _est(_sage(spark, d, train, "bpr", "no_sentiment").fit(train).predict(test))


@query()
def graphsage_structure_only(spark, d):
    train, test = views.parts(spark, d)
    return _est(_sage(spark, d, train, "bpr", "structure_only").fit(train).predict(test))
