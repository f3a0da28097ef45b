"""Structure of graphs: components, clustering, communities and their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tesselon.graph.build import both_ways
from tesselon.operators.eda import summarize_values
from tesselon.session import drop_table, store_table


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)``: the least node of each undirected component; isolated nodes are their own.

    Labels spread to neighbours and are then replaced by the label of the label, so long paths shorten quickly; each
    round's labels are a table in the shared folder. Neighbours' least labels are combined before the shuffle.
    """
    pairs = store_table(both_ways(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    labels = store_table(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = pairs.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("_n")).agg(F.min("component").alias("_c"))
        least = labels.join(near, F.col("node") == F.col("_n"), "left").select("node", "component", F.least("component", "_c").alias("_l"))
        jump = labels.select(F.col("node").alias("_j"), F.col("component").alias("_jc"))
        spread = store_table(least.join(jump, F.col("_l") == F.col("_j")).select("node", F.least("_l", "_jc").alias("new"), "component"))
        drop_table(labels)
        changed = spread.where("new <> component").limit(1).count()
        labels = spread.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def component_summary(components: DataFrame) -> DataFrame:
    """One row: the number of components and the size of the largest (0 for no nodes)."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def clustering(nodes: DataFrame, edges: DataFrame, weight: str = "weight_jaccard") -> DataFrame:
    """One row: the mean over all nodes of the weighted clustering coefficient.

    Of a node it is twice the sum over its triangles of the cubic root of the product of the three weights, each over
    the greatest of all, divided by d (d - 1). Each triangle is found once, from its two edges at the node that comes
    first by (degree, id), so a hub's edges aren't paired with each other.
    """
    top = edges.agg(F.max(weight).alias("_m"))
    w = edges.join(F.broadcast(top), F.lit(True)).select("a", "b", (F.col(weight) / F.col("_m")).alias("w"))  # one row
    degree = store_table(both_ways(w, "a", "b").groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d")))
    ranked = w.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = store_table(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"), "w"))
    left, right = out.select("s", F.col("t").alias("x"), F.col("w").alias("w1")), out.select("s", F.col("t").alias("y"), F.col("w").alias("w2"))
    wedges = left.join(right, "s").where("x < y")
    closing = out.select(F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"), F.col("w").alias("w3"))
    value = F.cbrt(F.col("w1") * F.col("w2") * F.col("w3"))
    corners = wedges.join(closing, ["x", "y"]).select(F.explode(F.array("s", "x", "y")).alias("n"), value.alias("v")).groupBy("n").agg(F.sum("v").alias("v"))
    per_node = degree.join(corners, "n").where("d > 1").select("n", (2 * F.col("v") / (F.col("d") * (F.col("d") - 1))).alias("c"))
    total = per_node.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("_t"))
    return nodes.agg(F.count(F.lit(1)).alias("_n")).join(total, F.lit(True)).select(F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_t") / F.col("_n")).alias("clustering"))


def modularity(edges: DataFrame, communities: DataFrame, weight: str = "weight_jaccard") -> DataFrame:
    """One row: the sum over communities of inner weight / m - (strength / 2m) squared; null without weight."""
    c = communities.select("node", "community")
    ends = edges.join(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    strength = ends.select(F.explode(F.array("ca", "cb")).alias("c"), F.col(weight).alias("w")).groupBy("c").agg(F.sum("w").alias("k"))
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("c2")).agg(F.sum(weight).alias("l"))
    m = edges.agg(F.sum(weight).alias("m"))
    part = strength.join(inner, F.col("c") == F.col("c2"), "left").join(F.broadcast(m), F.lit(True))  # one row
    return part.agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.nullif("m", F.lit(0.0)) - F.pow(F.col("k") / (2 * F.nullif("m", F.lit(0.0))), F.lit(2.0))).alias("modularity"))


def alignment(communities: DataFrame, labels: DataFrame, min_size: int = 1) -> DataFrame:
    """One row (n, purity, nmi) of communities against labels; nodes without a label are ignored.

    Purity is the share of nodes with the most frequent label of their community. The mutual information is over the
    arithmetic mean of both entropies, and 1 where both are zero. ``min_size`` leaves small communities out.
    """
    rows = communities.select("node", "community").join(labels.select("node", "label").where("label is not null"), "node")
    cells = rows.groupBy("community", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy("community").agg(F.sum("n").alias("nc"), F.max("n").alias("best")).where(F.col("nc") >= min_size)
    cells = store_table(cells.join(sizes, "community"))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("nl"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    entropy = lambda df, n: df.join(F.broadcast(total), F.lit(True)).agg(F.coalesce(-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t"))), F.lit(0.0)).alias("h"))
    own = cells.select("community", "nc", "best").distinct()
    hu, hv = entropy(own, "nc").withColumnRenamed("h", "hu"), entropy(by_label, "nl").withColumnRenamed("h", "hv")
    mi = cells.join(by_label, "label").join(F.broadcast(total), F.lit(True)).agg(F.coalesce(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nc") * F.col("nl")))), F.lit(0.0)).alias("mi"))
    best = own.agg(F.coalesce(F.sum("best"), F.lit(0)).alias("best"))
    one = total.join(best, F.lit(True)).join(hu, F.lit(True)).join(hv, F.lit(True)).join(mi, F.lit(True))
    mean = (F.col("hu") + F.col("hv")) / 2
    return one.select(F.col("t").alias("n"), F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.col("best") / F.col("t")).alias("purity"), F.when(F.col("t") == 0, F.lit(0.0)).when(mean < 1e-12, F.lit(1.0)).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0))).alias("nmi"))


def bipartite_facts(edges: DataFrame) -> DataFrame:
    """One row of a user-item graph: users, items, edges, density, components and the largest one."""
    users, items = edges.select("src").distinct(), edges.select("dst").distinct()
    counts = edges.agg(F.count(F.lit(1)).alias("edges")).join(users.agg(F.count(F.lit(1)).alias("users")), F.lit(True)).join(items.agg(F.count(F.lit(1)).alias("items")), F.lit(True))
    nodes = users.select(F.col("src").alias("node")).unionByName(items.select(F.col("dst").alias("node")))
    parts = component_summary(connected_components(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    density = F.when(F.col("users") * F.col("items") == 0, F.lit(0.0)).otherwise(F.col("edges") / (F.col("users") * F.col("items")))
    return counts.join(parts, F.lit(True)).select("users", "items", "edges", density.alias("density"), "components", "largest")


def projection_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of an item graph: nodes, edges, density, mean degree and count weight, components and the largest one."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.avg("weight_count"), F.lit(0.0)).alias("mean_weight")), F.lit(True))
    parts = component_summary(connected_components(nodes.select("item"), edges))
    n, e = F.col("nodes"), F.col("edges")
    return counts.join(parts, F.lit(True)).select("nodes", "edges", F.when(n < 2, F.lit(0.0)).otherwise(2 * e / (n * (n - 1))).alias("density"), F.when(n == 0, F.lit(0.0)).otherwise(2 * e / n).alias("mean_degree"), "mean_weight", "components", "largest")


def degree_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The summary of node degrees, isolated nodes counting as 0."""
    return summarize_values(_item_degrees(nodes, edges), "d", True)


def _item_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    degree = both_ways(edges.select("a", "b"), "a", "b").groupBy(F.col("a").alias("item")).agg(F.count(F.lit(1)).alias("d"))
    return nodes.select("item").join(degree, "item", "left").select(F.coalesce("d", F.lit(0)).alias("d"))


def _component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return connected_components(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("d"))


def _summaries(parts: dict[str, tuple[DataFrame, str, bool]]) -> DataFrame:
    """``(value, count, min, max, mean, median, std)``: a row per named column."""
    numbers = lambda df: df.select("value", "count", *[F.col(c).cast("double").alias(c) for c in ("min", "max", "mean", "median", "std")])
    return reduce(DataFrame.unionByName, [numbers(summarize_values(df, c, whole).withColumn("value", F.lit(name))) for name, (df, c, whole) in parts.items()])


def bipartite_summaries(edges: DataFrame) -> DataFrame:
    """Summaries of a user-item graph's user degrees, item degrees and component sizes."""
    degree = lambda c: edges.groupBy(c).agg(F.count(F.lit(1)).alias("d"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = _component_sizes(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return _summaries({"user_degree": (degree("src"), "d", True), "item_degree": (degree("dst"), "d", True), "component_size": (sizes, "d", True)})


def projection_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries of an item graph's degrees, component sizes and both weights."""
    sizes = _component_sizes(nodes.select("item"), edges)
    return _summaries({"degree": (_item_degrees(nodes, edges), "d", True), "component_size": (sizes, "d", True), "weight_count": (edges, "weight_count", True), "weight_jaccard": (edges, "weight_jaccard", False)})
