"""The user-item graph, the item-item projection, and the tables of a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselon.operators.pairs import basket_pairs, item_pair
from tesselon.operators.ranking import number_keys, top_per_key
from tesselon.session import store_table

REQUIRED = ("user_id", "parent_asin", "rating", "timestamp")


def indexed_graph(train: DataFrame, positive_from: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): users numbered from 0 in order, items after them; edges (src, dst, rating, positive)."""
    users, items = number_keys(train, "user_id", "_u"), number_keys(train, "parent_asin", "_i")
    n_users = users.count()
    vertices = users.select(F.col("user_id").alias("id"), F.lit("user").alias("kind"), F.col("_u").cast("bigint").alias("idx")).unionByName(items.select(F.col("parent_asin").alias("id"), F.lit("item").alias("kind"), (F.col("_i") + n_users).cast("bigint").alias("idx")))
    edges = train.join(users, "user_id").join(items, "parent_asin").select(F.col("_u").cast("bigint").alias("src"), (F.col("_i") + n_users).cast("bigint").alias("dst"), "rating", (F.col("rating").cast("float") >= positive_from).alias("positive"))
    return vertices, edges


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions, in one pass."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    pair = F.explode(F.array(F.struct(F.col(src).alias("s"), F.col(dst).alias("d")), F.struct(F.col(dst).alias("s"), F.col(src).alias("d"))))
    return edges.select(pair.alias("_p"), *rest).select(F.col("_p.s").alias(src), F.col("_p.d").alias(dst), *rest)


def bipartite_graph(train: DataFrame) -> DataFrame:
    """Edges (src, dst, rating) with namespaced ids 'u:...' and 'i:...'; of repeated pairs the latest; missing columns raise."""
    missing = [c for c in REQUIRED if c not in train.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    from tesselon.operators.prep import deduplicate

    return deduplicate(train.select(*REQUIRED)).select(F.concat(F.lit("u:"), "user_id").alias("src"), F.concat(F.lit("i:"), "parent_asin").alias("dst"), "rating")


def project_items(train: DataFrame, min_shared_users: int = 1, top_n_items: int | None = None, chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the item-item graph: edges (a, b, weight_count, weight_jaccard) with a < b.

    Two items are joined by the users that rated both, if these are at least ``min_shared_users``. The Jaccard weight is
    over all raters of either, even when only the ``top_n_items`` items of the highest degree are kept. Items without an
    edge stay as nodes.
    """
    if min_shared_users < 1:
        raise ValueError("min_shared_users must be at least 1")
    rows = store_table(train.select(F.col("user_id").alias("u"), F.col("parent_asin").alias("i")).where("u is not null and i is not null").distinct())
    degree = rows.groupBy("i").agg(F.count(F.lit(1)).alias("degree"))
    nodes = degree
    if top_n_items is not None:
        nodes = degree.orderBy(F.desc("degree"), "i").limit(top_n_items)
        rows = rows.join(nodes.select("i"), "i", "left_semi")
    shared = basket_pairs(rows.select(F.col("u").alias("basket"), F.col("i").alias("item")), item_pair, chunk).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight_count")).where(F.col("weight_count") >= min_shared_users)
    shared = shared.join(degree.select(F.col("i").alias("a"), F.col("degree").alias("_da")), "a").join(degree.select(F.col("i").alias("b"), F.col("degree").alias("_db")), "b")
    edges = shared.select("a", "b", "weight_count", (F.col("weight_count") / (F.col("_da") + F.col("_db") - F.col("weight_count"))).alias("weight_jaccard"))
    return nodes.select(F.col("i").alias("item"), "degree"), edges


def induced(edges: DataFrame, nodes: DataFrame, node: str = "item") -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(ids, F.col("a") == F.col("_n"), "left_semi").join(ids, F.col("b") == F.col("_n"), "left_semi")


def adjacency(edges: DataFrame, weight: str = "weight_jaccard") -> DataFrame:
    """Both directions of the edges whose weight isn't zero: (row, col, value)."""
    kept = edges.where(F.col(weight) != 0).select(F.col("a").alias("row"), F.col("b").alias("col"), F.col(weight).cast("double").alias("value"))
    return both_ways(kept, "row", "col")


def item_vertices(metadata: DataFrame, order: list[Column]) -> DataFrame:
    """One :Item per key, the first in ``order``."""
    from tesselon.operators.prep import keep_one

    return keep_one(metadata, "parent_asin", order, last=False)


def category_edges(items: DataFrame, labels: Column) -> DataFrame:
    """(:Item)-[:IN_CATEGORY]->(:Category), each once."""
    return items.select("parent_asin", F.explode(labels).alias("category")).distinct()


def rated_edges(train: DataFrame, items: DataFrame, split: str = "train") -> DataFrame:
    """(:User)-[:RATED]->(:Item): only to items that are vertices; of repeated pairs the latest."""
    from tesselon.operators.prep import deduplicate

    return deduplicate(train.select(*REQUIRED)).join(items.select("parent_asin").distinct(), "parent_asin", "left_semi").withColumn("split", F.lit(split))


def co_rated_edges(edges: DataFrame, items: DataFrame, max_edges: int | None = 50_000) -> DataFrame:
    """(:Item)-[:CO_RATED_WITH]->(:Item) of the greatest counts, between vertices only."""
    kept = induced(edges, items, "parent_asin")
    return kept.orderBy(F.desc("weight_count"), "a", "b").limit(max_edges) if max_edges is not None else kept


def top_items_of_user(rated: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    """Each user's ``k`` best rated items (ties by item) with their categories, sorted; none is an empty array."""
    best = top_per_key(rated, ["user_id"], [F.desc("rating"), F.col("parent_asin")], k)
    labels = categories.groupBy("parent_asin").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return best.join(labels, "parent_asin", "left").select("user_id", "rank", "parent_asin", "rating", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def vector_payload(vectors: DataFrame, metadata: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of the vector store: every vector (id, parent_asin, vector) with its item's fields, capped, or defaults."""
    from tesselon.functions import text as T

    meta = item_vertices(metadata, order)
    categories = T.categories_to_string(F.col("categories")) if meta.schema["categories"].dataType.typeName() == "array" else F.coalesce("categories", F.lit(""))
    fields = meta.select(
        "parent_asin", F.coalesce(T.optional_text(F.col("title"), 2048), F.lit("")).alias("title"), F.substring(categories, 1, 2048).alias("categories"), T.optional_text(F.col("store"), 512).alias("store"),
        T.optional_number(F.col("price"), "float").alias("price"), T.optional_number(F.col("average_rating"), "float").alias("average_rating"), T.optional_number(F.col("rating_number"), "bigint").alias("rating_number"),
    )
    out = vectors.select("id", "parent_asin", "vector").join(fields, "parent_asin", "left")
    return out.select("id", "parent_asin", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "categories")], "store", "price", "average_rating", "rating_number", "vector")
