"""Queries over tables: cleaning, splits, summaries, features, sampling and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions import text as T
from tesselon.functions.vectors import hash_bucket, hash_embedding
from tesselon.operators import eda, features, metrics, prep, ranking
from tesselon.plans import views
from tesselon.session import store_table
from tesselon.plans.views import D, M, NEGATIVE, P, POSITIVE, ROOTS, SEED, V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def six(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _landed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/train.parquet")


# ---- cleaning and splits


@query("select user_id, parent_asin, rating, timestamp from train where user_id is not null and parent_asin is not null and rating is not null")
def interactions_clean(spark, d):
    return prep.load_interactions(_landed(spark, d))


@query("select count(*) as raw, count(*) filter (user_id is not null and parent_asin is not null and rating is not null) as kept from train")
def interactions_counts(spark, d):
    return prep.raw_and_kept(_landed(spark, d))


@query(f"with {D} select * from d")
def dedup_latest(spark, d):
    return views.interactions(spark, d)


@query(f"with {V} select * from v qualify row_number() over (partition by user_id, parent_asin order by (timestamp is not null), timestamp, rating) = 1")
def dedup_first(spark, d):
    return prep.deduplicate(views.ratings(spark, d), "first")


@query(f"with {D}, {views.core_sql()} select * from core")
def kcore(spark, d):
    return prep.k_core(views.interactions(spark, d), views.CORE)


@query(f"with {D}, {views.split_sql('d', 's')} select user_id, parent_asin, part from s")
def split_8020(spark, d):
    return prep.split_per_user(views.interactions(spark, d), 0.2, SEED).select("user_id", "parent_asin", "part")


@query(f"""with {D}, r as (select *, row_number() over (partition by user_id order by timestamp desc nulls first, parent_asin desc) as back, count(*) over (partition by user_id) as n from d)
    select user_id, parent_asin, case when back = 1 and n >= 2 then 'test' when back = 2 and n >= 3 then 'validation' else 'train' end as part from r""")
def split_llo(spark, d):
    return prep.split_leave_last_out(views.interactions(spark, d)).select("user_id", "parent_asin", "part")


@query(f"""with {D}, r as (select *, row_number() over (partition by user_id order by timestamp desc nulls first, parent_asin desc) as back, count(*) over (partition by user_id) as n from d),
    k as (select *, floor(n * cast(0.25 as double)) as f from r), w as (select *, case when f = 0 and n >= 2 then 1 when f >= n then 0 else f end as n_val from k)
    select user_id, parent_asin, case when back <= n_val then 'validation' else 'train' end as part from w""")
def split_validation(spark, d):
    return prep.split_validation(views.interactions(spark, d), 0.25).select("user_id", "parent_asin", "part")


@query(f"with {D}, u as (select user_id from (select distinct user_id from d) order by md5('{SEED}|' || user_id), user_id limit 500) select user_id, count(*) as n from d where user_id in (select user_id from u) group by user_id")
def cap_users(spark, d):
    return prep.cap_users(views.interactions(spark, d), 500, SEED).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {D} select user_id, parent_asin from d order by md5('{SEED}|' || user_id || '|' || parent_asin), user_id, parent_asin limit 1000")
def cap_rows(spark, d):
    return prep.cap_rows(views.interactions(spark, d), 1000, SEED).select("user_id", "parent_asin")


@query(f"with {D} select user_id, parent_asin from d where rating >= 4")
def relevant_pairs(spark, d):
    return metrics.relevant_items(views.interactions(spark, d))


# ---- summaries


def _facts_sql(table: str, prefix: str, more: bool) -> str:
    users, items = f"(select count(distinct user_id) from {table})", f"(select count(distinct parent_asin) from {table})"
    out = f"(select count(*) from {table}) as {prefix}_rows, {users} as {prefix}_users, {items} as {prefix}_items, round(1 - (select count(*) from {table}) / ({users} * {items}), 9) as {prefix}_sparsity, (select string_agg(r::varchar || ':' || n, ',' order by r) from (select round_even(rating, 1) as r, count(*) as n from {table} group by 1)) as {prefix}_ratings"
    least = lambda c: f"(select min(n) from (select count(*) as n from {table} group by {c}))"
    return out + (f", round((select avg(cast(rating >= 4 as int)) from {table}), 9) as {prefix}_pct_relevant, {least('user_id')} as {prefix}_min_user_degree, {least('parent_asin')} as {prefix}_min_item_degree" if more else "")


def _summary(spark, d):
    dedup = store_table(views.interactions(spark, d))
    core = prep.k_core(dedup, views.CORE)
    split = store_table(prep.split_per_user(core, 0.2, SEED))
    return eda.summarize(_landed(spark, d), views.ratings(spark, d), dedup, core, split.where("part = 'train'"), split.where("part = 'test'"))


@query(f"with {D}, {views.core_sql()}, {views.split_sql('core', 's')} select (select count(*) from train) as raw_rows, (select count(*) from v) as valid_rows, {_facts_sql('d', 'dedup', False)}, {_facts_sql('core', 'kcore', True)}, (select count(*) from s where part = 'train') as train_rows, (select count(*) from s where part = 'test') as test_rows")
def eda_summary(spark, d):
    return _summary(spark, d).withColumns({c: F.round(c, 9) for c in ("dedup_sparsity", "kcore_sparsity", "kcore_pct_relevant")})


@query(f"with {D} select round_even(rating, 1) as rating, count(*) as n from d group by 1")
def rating_hist(spark, d):
    return eda.rating_histogram(views.interactions(spark, d))


@query(f"with {P} select count(*) as n from (select parent_asin from te except select parent_asin from tr)")
def test_items_not_in_train(spark, d):
    train, test = views.parts(spark, d)
    return eda.only_in(test, train, "parent_asin")


@query(f"with {M} select round(avg(price_missing::int), 9) as price_missing_rate, round(avg(average_rating_missing::int), 9) as average_rating_missing_rate, round(avg(rating_number_missing::int), 9) as rating_number_missing_rate from m")
def metadata_missingness(spark, d):
    out = eda.missingness(views.items(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(f"""with {D}, {views.core_sql()} select 0 as pos, 'raw_rows' as stage, (select count(*) from train) as n union all select 1, 'valid_rows', (select count(*) from v) union all select 2, 'dedup_rows', (select count(*) from d) union all select 3, 'kcore_rows', (select count(*) from core)""")
def funnel(spark, d):
    return eda.funnel(_summary(spark, d), ["raw_rows", "valid_rows", "absent", "dedup_rows", "kcore_rows"])


@query(f"with {D}, g as (select user_id, count(*) as x from d group by user_id) select count(x) as count, min(x) as min, max(x) as max, round(avg(x), 6) as mean, cast(floor(quantile_cont(x, 0.5)) as bigint) as median, round(stddev_pop(x), 6) as std from g")
def degree_summary(spark, d):
    return eda.summarize_values(eda.degrees(views.interactions(spark, d), "user_id"), "degree", True).withColumns(six("mean", "std"))


# ---- items and text


_CLEAN = r"trim(regexp_replace(replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))"


@query(f"with {M} select parent_asin, {_CLEAN.format(c='title')} as title, {_CLEAN.format(c='description')} as description from m")
def html_clean(spark, d):
    return views.items(spark, d).select("parent_asin", T.clean_text(F.col("title")).alias("title"), T.clean_text(F.col("description")).alias("description"))


_JOINED = "coalesce(array_to_string(categories, ' '), '')"


@query(f"""with {M} select parent_asin, title, description, {_CLEAN.format(c=f"title || ' ' || description || ' ' || {_JOINED}")} as text, {_JOINED} as categories, coalesce(store, '') as store, price, false as price_missing, average_rating, false as average_rating_missing, rating_number, false as rating_number_missing from m""")
def metadata_prepared(spark, d):
    return prep.prepare_metadata(views.items(spark, d))


_PRICES = ("$1,299.50", " 12 ", "", "   ", "free", "1.0f", "$", "-3.5", "1e3", ".5", "7.", "12.3.4", "1,2,3")


@query("select * from (values " + ", ".join(f"('{p}', {v}, {str(m).lower()})" for p, v, m in zip(_PRICES, (1299.5, 12.0, 0.0, 0.0, 0.0, 0.0, 0.0, -3.5, 1000.0, 0.5, 7.0, 0.0, 123.0), (False, False, True, True, True, True, True, False, False, False, False, True, False), strict=True)) + ") t(raw, price, price_missing)")
def price_parse(spark, d):
    price, missing = T.parse_price(F.col("raw"))
    return spark.createDataFrame([(p,) for p in _PRICES], "raw string").select("raw", price.alias("price"), missing.alias("price_missing"))


_WORD = "list_transform(string_split({x}, ' '), lambda w: case when lower(w) in (" + ", ".join(f"'{a}'" for a in T.ACRONYMS) + ") then upper(w) else upper(w[1:1]) || lower(w[2:]) end)"
_NORM = "array_to_string(" + _WORD.format(x=r"trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))") + ", ' ')"
_ROOTS_SQL = ", ".join(f"'{r.lower()}'" for r in ROOTS)
#: (parent_asin, category, pos) of the kept labels in order.
L = M + rf""", l0 as (select parent_asin, unnest(categories) as x, generate_subscripts(categories, 1) as pos from m), l1 as (select parent_asin, pos, {_NORM} as category from l0 where x is not null and regexp_replace(x, '[\s\p{{Z}}]+', '', 'g') <> ''),
    l as materialized (select * from l1 where lower(category) not in ({_ROOTS_SQL}) qualify row_number() over (partition by parent_asin, lower(category) order by pos) = 1)"""
_VOCAB = "vocab as materialized (select category, df, row_number() over (order by df desc, category) - 1 as col from (select category, count(*) as df from l group by category having count(*) >= {n}) order by df desc, category limit {m})"


def _labels():
    return T.filter_categories(F.col("categories"), ROOTS)


@query(f"with {L} select parent_asin, category, row_number() over (partition by parent_asin order by pos) as pos from l")
def category_filter(spark, d):
    return views.items(spark, d).select("parent_asin", F.posexplode(_labels()).alias("pos", "category")).withColumn("pos", F.col("pos") + 1)


def _path_sql() -> str:
    rest = " ".join(f"when starts_with(lower(norm), '{r.lower()} ') then trim(substr(norm, {len(r) + 2}))" for r in sorted(ROOTS, key=lambda r: -len(r)))
    norm = _NORM.replace("(x,", "(p,")
    return f"n as (select parent_asin, {norm} as norm from (select parent_asin, {_JOINED} as p from m)), r as (select parent_asin, case {rest} else norm end as category from n)"


@query(f"with {M}, {_path_sql()} select parent_asin, category from r where category <> '' and lower(category) not in ({_ROOTS_SQL})")
def category_path(spark, d):
    """Labels of prepared items, whose categories are one flattened text."""
    prepared = prep.prepare_metadata(views.items(spark, d))
    return prepared.select("parent_asin", F.explode(T.filter_category_path(F.col("categories"), ROOTS)).alias("category"))


@query(f"with {L}, {_VOCAB.format(n=5, m=256)} select category, df, col from vocab")
def category_vocab(spark, d):
    return features.category_vocab(views.items(spark, d), _labels())


def _multi_hot(spark, d, max_vocab):
    rows = views.items(spark, d).withColumn("_l", _labels())
    vocab = features.vocab_list(features.category_vocab(rows, F.col("_l"), max_vocab, 5))
    flags = F.transform(F.arrays_zip(F.array(*[F.lit(c) for c in vocab]).alias("c"), features.multi_hot(F.col("_l"), vocab).alias("v")), lambda x: x) if vocab else F.array()
    return rows.select("parent_asin", F.posexplode(flags).alias("col", "x")).select("parent_asin", F.col("x.c").alias("category"), "col", F.col("x.v").alias("v"))


@query(f"with {L}, {_VOCAB.format(n=5, m=256)} select m.parent_asin, v.category, v.col, cast(exists (select 1 from l where l.parent_asin = m.parent_asin and l.category = v.category) as int)::double as v from m, vocab v")
def category_multi_hot(spark, d):
    """With the operator's own size of vocabulary."""
    return _multi_hot(spark, d, 256)


@query(f"with {M} select parent_asin, list_filter(categories, lambda c: c is not null and trim(c) <> '' and c not in ({', '.join(f''' '{r}' '''.strip() for r in ROOTS)}))[-1] as label from m")
def item_labels(spark, d):
    return views.items(spark, d).select("parent_asin", T.last_label(F.col("categories"), ROOTS).alias("label"))


def _sentiment_sql(pos: tuple[str, ...], neg: tuple[str, ...]) -> str:
    has = lambda words: "len(list_filter(t, lambda w: w in (" + ", ".join(f"'{w}'" for w in words) + ")))"
    return rf"""with t as (select doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\s\p{{Z}}\x{{85}}\x0b\x1c-\x1f]+', ' ', 'g')), ' ') as t from documents),
    c as (select doc_id, {has(pos)} as p, {has(neg)} as n from t)
    select doc_id, case when p > n then 'POSITIVE' when n > p then 'NEGATIVE' else 'NEUTRAL' end as sentiment_label, round(case when p + n = 0 then 0 else (p - n) / (p + n) end, 6) as sentiment_score, round(case when p + n = 0 then 0.5 else p / (p + n) end, 6) as positive_prob, round(case when p + n = 0 then 0.5 else n / (p + n) end, 6) as negative_prob from c"""


def _sentiment(spark, d, *words):
    out = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.lexicon_sentiment(F.col("text"), *words).alias("s")).select("doc_id", "s.*")
    return out.withColumns(six("sentiment_score", "positive_prob", "negative_prob"))


@query(_sentiment_sql(POSITIVE, NEGATIVE))
def sentiment_lexicon(spark, d):
    return _sentiment(spark, d, POSITIVE, NEGATIVE)


@query(_sentiment_sql(T.POSITIVE_WORDS, T.NEGATIVE_WORDS))
def sentiment_default(spark, d):
    return _sentiment(spark, d)


# ---- sentiment-joined aggregates: here a review's text is its item's text

_REVIEWS = rf"""rv as (select tr.user_id, tr.parent_asin, tr.timestamp, string_split(trim(regexp_replace(lower(coalesce(m.text, '')), '[\s\p{{Z}}]+', ' ', 'g')), ' ') as t from tr left join m using (parent_asin)),
    sc as (select user_id, parent_asin, timestamp, len(list_filter(t, lambda w: w in ({', '.join(f"'{w}'" for w in POSITIVE)}))) as p, len(list_filter(t, lambda w: w in ({', '.join(f"'{w}'" for w in NEGATIVE)}))) as n from rv where timestamp is not null),
    se as (select user_id, parent_asin, timestamp, case when p + n = 0 then 0 else (p - n) / (p + n) end as score from sc), ts as materialized (select tr.*, se.score from tr left join se using (user_id, parent_asin, timestamp))"""


def scored(spark, d, train):
    texts = views.items(spark, d).select("parent_asin", F.substring("text", 1, 1000).alias("text"))
    reviews = train.join(texts, "parent_asin", "left")
    return features.score_reviews(reviews, train, lambda c: T.lexicon_sentiment(c, POSITIVE, NEGATIVE))


_REVIEWS = _REVIEWS.replace("coalesce(m.text, '')", "substr(coalesce(m.text, ''), 1, 1000)")


@query(f"""with {P}, {M}, {_REVIEWS}, g as (select user_id, avg(rating) as r, stddev_pop(rating) as rs, coalesce(avg(score), 0) as s, coalesce(stddev_pop(score), 0) as ss from ts group by user_id)
    select user_id, round(r, 6) as user_mean_rating, round(rs, 6) as user_rating_std, round(s, 6) as user_review_sentiment_mean, round(ss, 6) as user_review_sentiment_std, round(r - s, 6) as user_rating_minus_sentiment_gap, round(s - r, 6) as user_strictness_score from g""")
def user_aggregates(spark, d):
    train, _ = views.parts(spark, d)
    out = features.user_aggregates(train, scored(spark, d, train))
    return out.withColumns(six(*[c for c in out.columns if c != "user_id"]))


@query(f"""with {P}, {M}, {_REVIEWS}, g as (select parent_asin, avg(rating) as r, coalesce(avg(score), 0) as s, count(score) as n from ts group by parent_asin)
    select parent_asin, round(r, 6) as item_mean_rating, round(s, 6) as item_train_sentiment_mean, n as item_train_sentiment_count, round(r - s, 6) as item_rating_minus_sentiment_gap from g""")
def item_aggregates(spark, d):
    train, _ = views.parts(spark, d)
    out = features.item_aggregates(train, scored(spark, d, train))
    return out.withColumns(six(*[c for c in out.columns if c not in ("parent_asin", "item_train_sentiment_count")]))


_GENEROSITY = "g as (select user_id, avg(rating) - coalesce(avg(score), 0) as gap from ts group by user_id), o as materialized (select user_id, greatest(-1, least(1, gap - (select avg(gap) from g))) as off from g)"


@query(f"""with {P}, {M}, {_REVIEWS}, {_GENEROSITY}, f as (select user_id, avg(rating) as a, count(rating)::double as n, avg((rating >= 4)::int) as p from tr group by user_id)
    select u.user_id, round(coalesce(a, 0), 6) as mean_rating, coalesce(n, 0) as rating_count, round(coalesce(p, 0), 6) as positive_ratio, round(coalesce(off, 0), 6) as generosity_offset from (select distinct user_id from d) u left join f using (user_id) left join o using (user_id)""")
def user_node_features(spark, d):
    train, _ = views.parts(spark, d)
    offsets = features.generosity(features.user_aggregates(train, scored(spark, d, train)))
    out = features.user_node_features(train, views.interactions(spark, d).select("user_id").distinct(), offsets)
    return out.withColumns(six("mean_rating", "positive_ratio", "generosity_offset"))


@query(f"""with {P}, {M}, f as (select parent_asin, ln(1 + count(*)) as g, avg(rating) as a, avg((rating >= 4)::int) as p from tr group by parent_asin)
    select parent_asin, round(coalesce(g, 0), 6) as log_degree, round(coalesce(a, 0), 6) as mean_rating, round(coalesce(p, 0), 6) as positive_ratio from m left join f using (parent_asin)""")
def structure_only_features(spark, d):
    train, _ = views.parts(spark, d)
    return features.structure_features(train, views.items(spark, d).select("parent_asin")).withColumns(six("log_degree", "mean_rating", "positive_ratio"))


_STD = ", ".join(f"({c} - avg({c}) over ()) / case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end as {c}" for c in features.NUMERIC)


@query(f"with {M}, z as (select parent_asin, {_STD} from m) select parent_asin, round(price, 6) as price, round(average_rating, 6) as average_rating, round(rating_number, 6) as rating_number from z")
def numeric_standardized(spark, d):
    return features.standardized(views.items(spark, d).select("parent_asin", *features.NUMERIC), features.NUMERIC).withColumns(six(*features.NUMERIC))


@query("""with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), n as (select vec_id, sqrt(sum(x * x)) as l from v group by vec_id)
    select vec_id, pos, round(x / case when l = 0 then 1 else l end, 6) as x from v join n using (vec_id)""")
def l2_normalized(spark, d):
    from tesselon.functions.vectors import l2_normalize

    unit = l2_normalize(F.transform("embedding", lambda x: x.cast("double")))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(unit).alias("pos", "x")).select("vec_id", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


#: (parent_asin, bucket, n) of title and description by the low 32 bits of md5, which suffice as 32 divides 2 ** 32.
E = r"""tk as (select parent_asin, unnest(list_filter(string_split(regexp_replace(lower(title || ' ' || description), '[\s\p{Z}]+', ' ', 'g'), ' '), lambda t: t <> '')) as t from m),
    em as materialized (select parent_asin, ('0x' || substr(md5(t), 25, 8))::bigint % 32 as bucket, count(*) as n from tk group by all)"""


@query(f"with {M}, {E} select * from em")
def hash_embedding_items(spark, d):
    rows = views.items(spark, d)
    return rows.select("parent_asin", F.posexplode(hash_embedding(features.embed_text(rows))).alias("bucket", "n")).where("n > 0").withColumn("n", F.col("n").cast("bigint"))


@query("select t as token, (((('0x' || substr(md5(t), 1, 8))::hugeint * 4294967296 + ('0x' || substr(md5(t), 9, 8))::bigint) % 7 * 4294967296 + ('0x' || substr(md5(t), 17, 8))::bigint) % 7 * 4294967296 + ('0x' || substr(md5(t), 25, 8))::bigint) % 7 as bucket from (select distinct unnest(string_split(lower(title), ' ')) as t from metadata) where t <> ''")
def hash_buckets(spark, d):
    words = spark.read.parquet(f"{d}/metadata.parquet").select(F.explode(F.split(F.lower("title"), " ")).alias("token")).where("token <> ''").distinct()
    return words.select("token", hash_bucket(F.col("token"), 7).cast("bigint").alias("bucket"))


# ---- recommendation metrics

#: Popularity of training items.
POP = "pop as materialized (select parent_asin, count(*) as n from tr group by parent_asin)"
_PROBES = 150
CAND = f"""rel as materialized (select distinct user_id, parent_asin from te where rating >= 4), cat as materialized (select parent_asin, row_number() over (order by parent_asin) - 1 as pos from (select distinct parent_asin from tr)), nc as (select count(*) as n from cat),
    pr as (select user_id, ('0x' || substr(md5('{SEED}|' || user_id || '|' || j), 25, 8))::bigint % n as pos, min(j) as j from (select distinct user_id from rel), range({_PROBES}) r(j), nc group by all),
    ng as (select pr.user_id, parent_asin from pr join cat using (pos) where not exists (select 1 from tr x where x.user_id = pr.user_id and x.parent_asin = cat.parent_asin) and not exists (select 1 from rel x where x.user_id = pr.user_id and x.parent_asin = cat.parent_asin) qualify row_number() over (partition by pr.user_id order by j) <= 50),
    cand as materialized (select user_id, parent_asin, 1 as is_rel from rel union all select user_id, parent_asin, 0 from ng)"""


def candidates(train, test):
    return metrics.candidates(train, test, 50, 4.0, SEED)


@query(f"with {P}, {CAND} select * from cand")
def candidates_sampled(spark, d):
    return candidates(*views.parts(spark, d))


RANK = "rk as materialized (select *, row_number() over (partition by user_id order by score desc, is_rel desc, parent_asin) as rank from sco anti join tr using (user_id, parent_asin) qualify rank <= 10)"
BUNDLES = """h as (select user_id, count(*) as h, sum(1 / log2(rank + 1)) as dcg from rk where is_rel = 1 group by user_id), rn as (select user_id, count(*) as n from rel group by user_id),
    b0 as (select user_id, n, coalesce(h, 0) as h, coalesce(dcg, 0) as dcg, least(10, n) as best, list_sum(list_transform(range(1, least(10, n) + 1), lambda r: 1 / log2(r + 1))) as ideal from rn left join h using (user_id)),
    bu as (select user_id, h / 10 as precision_at_k, h / n as recall_at_k, case when h = 0 then 0 else 2 * (h / 10) * (h / n) / (h / 10 + h / n) end as f1_at_k, (h > 0)::int::double as hit_rate_at_k, dcg / ideal as ndcg_at_k, best / 10 as oracle_precision_at_k, best / n as oracle_recall_at_k, 2 * (best / 10) * (best / n) / (best / 10 + best / n) as oracle_f1_at_k, 1.0::double as oracle_hit_rate_at_k, 1.0::double as oracle_ndcg_at_k from b0)"""
_SIX_BUNDLE = ", ".join(f"round({c}, 6) as {c}" for c in metrics.BUNDLE)
_AVG_BUNDLE = ", ".join(f"round(avg({c}), 6) as {c}" for c in metrics.BUNDLE) + ", " + ", ".join(f"round(avg({m}_at_k) / avg(oracle_{m}_at_k), 6) as {m}_oracle_ratio_at_k" for m in ("precision", "recall", "f1"))
_POPSCORE = f"{POP}, sco as (select user_id, c.parent_asin, is_rel, coalesce(n, 0) as score from cand c left join pop using (parent_asin))"


def _popular(spark, d):
    train, test = views.parts(spark, d)
    cand = candidates(train, test)
    counts = train.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("score"))
    ranked = metrics.rank_candidates(cand.join(counts, "parent_asin", "left").fillna(0, subset=["score"]), train, 10)
    return metrics.user_bundles(ranked, metrics.relevant_items(test), 10)


@query(f"with {P}, {CAND}, {_POPSCORE}, {RANK}, {BUNDLES} select user_id, {_SIX_BUNDLE} from bu")
def ranking_metrics_user(spark, d):
    return _popular(spark, d).withColumns(six(*metrics.BUNDLE))


@query(f"with {P}, {CAND}, {_POPSCORE}, {RANK}, {BUNDLES} select count(*) as n_eval_users, 10 as k, {_AVG_BUNDLE} from bu")
def ranking_metrics(spark, d):
    out = metrics.aggregate_bundles(_popular(spark, d), 10)
    return out.withColumns(six(*[c for c in out.columns if c.endswith("_at_k")]))


MEANS = "gm as (select avg(rating) as g from tr), im as materialized (select parent_asin, avg(rating) as i from tr group by parent_asin), um as materialized (select user_id, avg(rating) as u from tr group by user_id)"


@query(f"with {P}, {MEANS} select round(sqrt(avg(pow(rating - e, 2))), 6) as rmse, round(avg(abs(rating - e)), 6) as mae from (select te.rating, least(5, greatest(1, coalesce(i, u, g))) as e from te left join im using (parent_asin) left join um using (user_id), gm)")
def rating_metrics(spark, d):
    from tesselon.models.baselines import Popularity

    train, test = views.parts(spark, d)
    scored_rows = Popularity().fit(train).predict(test)
    return metrics.rating_errors(scored_rows).withColumns(six("rmse", "mae"))


@query(f"with {P}, {POP} select round(regr_slope(rating, n), 6) as beta, round(regr_intercept(rating, n), 6) as intercept from te join pop using (parent_asin)")
def linear_calibration(spark, d):
    train, test = views.parts(spark, d)
    counts = train.groupBy("parent_asin").agg(F.count(F.lit(1)).cast("double").alias("raw"))
    return metrics.linear_calibration(test.join(counts, "parent_asin")).withColumns(six("beta", "intercept"))


# ---- item search and selections


@query(f"with {M} select parent_asin, title from m where regexp_matches(coalesce(title, ''), '(?i)tro+|rai') or regexp_matches(coalesce(store, ''), '(?i)tro+|rai')")
def item_search(spark, d):
    from tesselon.report import search_items

    return search_items(views.items(spark, d), "tro+|rai", ("title", "store")).select("parent_asin", "title")


@query(f"with {D} select user_id, parent_asin, rating from d qualify row_number() over (partition by user_id order by rating desc, parent_asin) <= 5")
def user_top_items(spark, d):
    return ranking.top_per_key(views.interactions(spark, d), ["user_id"], [F.desc("rating"), F.col("parent_asin")], 5).select("user_id", "parent_asin", "rating")
