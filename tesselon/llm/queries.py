"""The queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesselon.functions.keys import WHITE_SPACE, clean_key
from tesselon.llm.cooccurrence import cooccurrence
from tesselon.llm.leakage import leaks, removal_spans
from tesselon.llm.packing import CAPACITY, pack_texts, text_sizes
from tesselon.llm.similar_vectors import similar_vectors
from tesselon.llm.splitting import LIMIT, split_texts
from tesselon.llm.term_counts import term_counts
from tesselon.operators.ranking import top_per_key
from tesselon.session import store_table
from tesselon.sources.stores import search_vectors


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(spark.read.parquet(f"{d}/metadata.parquet"), clean_key("parent_asin"), F.col("categories"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


#: Numbers in a vector of vector_artifacts.
DIM = 64


def _similar(spark: SparkSession, d: str, **options: float) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{d}/vector_artifacts.parquet"), F.col("item_ids"), F.col("embeddings"), F.col("row_pos"), DIM, 10, **options)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = _similar(spark, d, min_cosine=0.92)
    return near.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d)


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether of the 10 neighbours of the rows whose position is divisible by 100, found by comparing with all, at least 0.9 come out."""
    rows = spark.read.parquet(f"{d}/vector_artifacts.parquet").where(F.size("embeddings") == DIM)
    first = rows.groupBy("item_ids").agg(F.min("row_pos").alias("id"), F.min_by("embeddings", "row_pos").alias("vector"))
    usable = store_table(first.where(F.exists("vector", lambda x: x != 0)))
    asked = usable.where("id % 100 = 0")
    true = search_vectors(usable.select("id", "vector"), asked.select("id", "vector"), 11).where("query_id <> id").select("query_id", "id", "rank")
    true = top_per_key(true, ["query_id"], [F.col("rank")], 10, "_r")
    names = usable.select("id", "item_ids")
    true = true.join(names.select(F.col("id").alias("query_id"), F.col("item_ids").alias("item")), "query_id").join(names.withColumnRenamed("item_ids", "neighbour"), "id")
    found = _similar(spark, d).select("item", "neighbour", F.lit(1).alias("_f"))
    met = true.join(found, ["item", "neighbour"], "left").agg(F.count_distinct("item").alias("queries"), (F.count("_f") / F.count(F.lit(1)) >= 0.9).alias("enough"))
    return met.select("queries", "enough")


def _together(spark: SparkSession, d: str, **limits: float) -> DataFrame:
    train = spark.read.parquet(f"{d}/train.parquet").where("rating is not null").select(clean_key("user_id").alias("u"), clean_key("parent_asin").alias("i")).where("u <> '' and i <> ''")
    return cooccurrence(train, F.col("u"), F.col("i"), **limits)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _together(spark, d, min_count=5, min_lift=10)
    return pairs.where(10 * F.col("weight_count") >= F.col("n_a") + F.col("n_b") - F.col("weight_count")).select("item_a", "item_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).withColumns({"weight_jaccard": F.round("weight_jaccard", 6), "lift": F.round("lift", 4)})


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(_documents(spark, d), "doc_id", "text")


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    return text_sizes(_documents(spark, d), "doc_id", "text")


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, what the packing placed of it, and whether all its containers keep the capacity."""
    placed = pack_texts(_documents(spark, d), "doc_id", "text")
    full = placed.groupBy("container").agg(F.sum("size").alias("held")).where(F.col("held") > CAPACITY)
    placed = placed.join(full, "container", "left").groupBy("doc_id")
    return placed.agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.count("held").alias("overfull"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_documents(spark, d), "doc_id", "text", spark.read.parquet(f"{d}/eval_items.parquet"), "item_id", "text")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers are but 2 % and ten more than the tokens would fill."""
    placed = pack_texts(_documents(spark, d), "doc_id", "text")
    held = placed.agg(F.sum("size").alias("tokens"), F.count_distinct(F.when(F.col("size") > 0, F.col("container"))).alias("n"))
    return held.select("tokens", (F.col("n") <= F.ceil(F.col("tokens") / CAPACITY) * 1.02 + 10).alias("tight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_removal(spark: SparkSession, d: str) -> DataFrame:
    return removal_spans(_leaks(spark, d), "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(_documents(spark, d), "doc_id", "text", only_long=True, with_text=False).where("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(_documents(spark, d), "doc_id", "text")


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, whether its pieces keep the limit and repeat the overlap, and the text put together again."""
    pieces = split_texts(_documents(spark, d), "doc_id", "text")
    kept = ((F.col("last_token") - F.col("first_token") <= LIMIT) & (F.col("fresh") >= F.col("start"))).cast("int")
    fresh = F.struct("piece", F.expr("substring(text, cast(fresh - start as int) + 1)").alias("t"))
    return pieces.groupBy("doc_id").agg(F.max("last_token").alias("tokens"), F.min(kept).alias("kept"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(fresh)), lambda p: p["t"]), "")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p3_found, p3_neighbours, p3_recall, p4_found, p4_pairs, p6_packing, p6_sizes, p6_placed, p6_fill, p7_found, p7_removal, p8_found, p8_pieces, p8_whole)}


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


_KEY = "upper(trim({c}, " + _chars(WHITE_SPACE) + "))"
_TERMS = f"""
    with m as (select {_KEY.format(c="parent_asin")} as r, categories from metadata where parent_asin is not null),
    e as (select r, trim(regexp_replace(lower(x), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+', ' ', 'g')) as term from (select r, unnest(categories) as x from m)),
    t as (select term, count(*) as occurrences, count(distinct r) as records from e where term <> '' group by term),
    n as (select count(distinct r) as n from m),
    marked as (select *, case when records < 5 then 'rare' when records > 0.1 * n then 'common' end as mark from t, n)"""
_PAIRS = f"""
    with v as (select distinct {_KEY.format(c="user_id")} as u, {_KEY.format(c="parent_asin")} as i from train where rating is not null),
    w as (select * from v where u <> '' and i <> ''), k as (select i, count(*) as n from w group by i), n as (select count(distinct u) as n_users from w),
    c as (select x.i as item_a, y.i as item_b, count(*) as weight_count from w x join w y on x.u = y.u and x.i < y.i group by all),
    p as (select item_a, item_b, weight_count, ka.n as n_a, kb.n as n_b, weight_count / (ka.n + kb.n - weight_count) as weight_jaccard, weight_count * n_users / (ka.n * kb.n) as lift, n_users
        from c join k ka on ka.i = item_a join k kb on kb.i = item_b, n)"""
#: The token of TESTDATA.md as a pattern of RE2.
_TOKEN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[\p{P}$+<=>^`|~]|[^\t\n\x0b\x0c\r \p{Z}\p{P}$+<=>^`|~\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]+"
_SIZE = f"len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'))"

SQL = {
    "p2_found": _TERMS + "select term, mark from marked where mark is not null",
    "p2_terms": _TERMS + "select term, occurrences, records, mark from marked",
    "p3_found": """
    with v as (select item_ids as item, arg_min(embeddings, row_pos) as v from vector_artifacts where embeddings is not null and len(embeddings) = 64 and list_max(list_transform(embeddings, lambda x: abs(x))) > 0 group by item_ids),
    c as (select a.item as x, b.item as y, list_cosine_similarity(a.v::double[], b.v::double[]) as c from v a join v b on a.item <> b.item),
    k as (select x, y, c from c qualify row_number() over (partition by x order by c desc) <= 10)
    select distinct least(x, y) as item_a, greatest(x, y) as item_b from k where c >= 0.92""",
    "p3_recall": """
    with v as (select item_ids, min(row_pos) as id, arg_min(embeddings, row_pos) as v from vector_artifacts where len(embeddings) = 64 group by item_ids)
    select count(*) as queries, true as enough from v where id % 100 = 0 and list_max(list_transform(v, lambda x: abs(x))) > 0""",
    "p4_found": _PAIRS + "select item_a, item_b from p where weight_count >= 5 and 10 * weight_count >= n_a + n_b - weight_count and weight_count * n_users >= 10 * n_a * n_b",
    "p4_pairs": _PAIRS + "select item_a, item_b, weight_count, n_a, n_b, round(weight_jaccard, 6) as weight_jaccard, round(lift, 4) as lift from p",
    "p6_sizes": f"select doc_id, {_SIZE} as tokens from documents",
    "p6_placed": f"with s as (select doc_id, {_SIZE} as tokens from documents) select doc_id, tokens, greatest(1, cast(ceil(tokens / 2048) as bigint)) as pieces, 0 as overfull from s",
    "p6_fill": f"select cast(sum({_SIZE}) as bigint) as tokens, true as tight from documents",
    "p8_found": f"select doc_id from documents where {_SIZE} > 512",
    "p8_whole": f"select doc_id, {_SIZE} as tokens, 1 as kept, md5(coalesce(text, '')) as text_md5 from documents",
}
