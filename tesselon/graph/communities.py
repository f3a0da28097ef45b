"""Community detection: Louvain, Girvan-Newman, spectral clustering."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tesselon.graph import analysis
from tesselon.graph.analysis import connected_components, modularity
from tesselon.graph.build import bipartite_graph, both_ways, induced, project_items
from tesselon.report import small_rows
from tesselon.session import drop_table, store_table

#: A graph up to this many edges is finished in one task; a larger one is first contracted by distributed rounds.
ONE_TASK_EDGES = 2_000_000


def _louvain_local(edges: dict, total: float, resolution: float = 1.0) -> dict:
    """Sweeps and contractions of one graph {node: {neighbour: weight}} until modularity no longer rises; {node: community}."""
    owner = {n: n for n in edges}
    graph = edges
    while True:
        community = {n: n for n in graph}
        strength = {n: sum(w for m, w in near.items() if m != n) + 2 * near.get(n, 0.0) for n, near in graph.items()}
        mass = dict(strength)
        moved_ever, moved = False, True
        while moved:
            moved = False
            for n in sorted(graph):
                here = community[n]
                links: dict = defaultdict(float)
                for m, w in graph[n].items():
                    if m != n:
                        links[community[m]] += w
                mass[here] -= strength[n]
                gain = lambda c, links=links, n=n: links.get(c, 0.0) - resolution * strength[n] * mass[c] / (2 * total)
                best, most = here, gain(here)
                for c in sorted(links):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                mass[best] += strength[n]
                if best != here:
                    community[n], moved, moved_ever = best, True, True
        if not moved_ever:
            return owner
        owner = {n: community[c] for n, c in owner.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for n, near in graph.items():
            merged[community[n]]
            for m, w in near.items():
                if n <= m:
                    a, b = sorted((community[n], community[m]))
                    merged[a][b] += w
                    if a != b:
                        merged[b][a] += w
        graph = {n: dict(near) for n, near in merged.items()}


def louvain(nodes: DataFrame, edges: DataFrame, weight: str = "weight_jaccard", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, community)``: communities of high modularity, a community being named by one of its nodes.

    Components are independent, as a merge across them never gains, so each is a group of its own, with the weight of
    the whole graph. Components above ``one_task`` edges are first contracted in distributed rounds, in which every node
    joins its neighbour with the greatest gain, and the contracted graphs are finished so; then each node moves once more
    to the neighbouring community that gains most. Where no node gains by joining a neighbour any more, a component is
    finished, whatever its size.
    """
    w = edges.select("a", "b", F.col(weight).cast("double").alias("w")).where("w > 0")
    total = w.agg(F.sum("w")).first()[0]
    base = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    if not total:
        return base.withColumn("community", F.col("node"))
    whole, owner, contracted = w, base.withColumn("community", F.col("node")), False
    while True:
        parts = connected_components(owner.select(F.col("community").alias("node")).distinct(), w)
        sized = w.join(parts, F.col("a") == F.col("node")).select("component", "a", "b", "w")
        large = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_task).select("component")
        if not large.limit(1).count():
            break
        before, contracted = w.count(), True
        owner, w = _contract(owner, w, float(total))
        if w.count() >= before:
            sized = sized.join(large, "component", "left_anti")
            break

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        graph: dict = defaultdict(dict)
        for a, b, x in part[["a", "b", "w"]].itertuples(index=False, name=None):
            graph[a][b] = graph[a].get(b, 0.0) + x
            graph[b][a] = graph[a][b]
        found = _louvain_local(dict(graph), float(total))
        return pd.DataFrame({"c": list(found), "community": list(found.values())})

    kind = base.schema["node"].dataType.simpleString()
    solved = sized.groupBy("component").applyInPandas(solve, f"c {kind}, community {kind}")
    out = owner.withColumnRenamed("community", "_o").join(solved, F.col("_o") == F.col("c"), "left")
    out = out.select("node", F.coalesce("community", "_o").alias("community"))
    return refine(out, whole) if contracted else out


def refine(owner: DataFrame, w: DataFrame, rounds: int = 8) -> DataFrame:
    """``owner`` (node, community) after rounds in which nodes move to the neighbouring community that gains most.

    Half of the nodes, by hash, may move in a round, as neighbours that move at once can undo each other's gain. A round
    that doesn't raise the modularity is not taken, and the last one so.
    """
    best = store_table(owner)
    quality = modularity(w, best, "w").first()[0]
    near = store_table(both_ways(w, "a", "b").where("a <> b"))
    strength = store_table(both_ways(w, "a", "b").groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k")))
    total = w.agg(F.sum("w")).first()[0]
    missed = 0
    for r in range(rounds):
        mass = best.join(strength, F.col("node") == F.col("n")).groupBy(F.col("community").alias("mc")).agg(F.sum("k").alias("mass"))
        links = near.join(best.select(F.col("node").alias("b"), F.col("community").alias("c")), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("l"))
        # the own community counts without the node, also if no link leads there
        own = best.join(strength, F.col("node") == F.col("n")).select("node", "community", "k")
        every = links.unionByName(best.select("node", F.col("community").alias("c"), F.lit(0.0).alias("l"))).groupBy("node", "c").agg(F.sum("l").alias("l"))
        rated = every.join(own, "node").join(mass, F.col("c") == F.col("mc"))
        gain = F.col("l") - F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("community"), F.col("k")).otherwise(0.0)) / F.lit(2.0 * total)
        to = rated.groupBy("node").agg(F.max_by("c", F.struct(F.round(gain, 12), F.col("c") == F.col("community"), "c")).alias("to"))
        moved = best.join(to, "node", "left").select("node", F.when(F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0, F.coalesce("to", "community")).otherwise(F.col("community")).alias("community"))
        moved = store_table(moved)
        now = modularity(w, moved, "w").first()[0]
        if now > quality + 1e-9:
            drop_table(best)
            best, quality, missed = moved, now, 0
        else:
            drop_table(moved)
            missed += 1
            if missed == 2:
                break
    return best


def _contract(owner: DataFrame, w: DataFrame, total: float) -> tuple[DataFrame, DataFrame]:
    """One distributed round of joining neighbours, and the graph of the joined nodes."""
    strength = both_ways(w, "a", "b").groupBy(F.col("a").alias("s")).agg(F.sum("w").alias("k"))
    near = both_ways(w, "a", "b").where("a <> b")
    gain = near.join(strength.select(F.col("s").alias("a"), F.col("k").alias("ka")), "a").join(strength.select(F.col("s").alias("b"), F.col("k").alias("kb")), "b").withColumn("g", F.col("w") - F.col("ka") * F.col("kb") / F.lit(2 * total))
    best = gain.where("g > 0").groupBy("a").agg(F.max_by("b", F.struct("g", "b")).alias("to"))
    root = store_table(best.select("a", F.least("a", "to").alias("to")))
    jump = root.select(F.col("a").alias("j"), F.col("to").alias("jt"))
    name = store_table(root.join(jump, F.col("to") == F.col("j"), "left").select("a", F.coalesce("jt", "to").alias("to")))
    owner = store_table(owner.join(name, F.col("community") == F.col("a"), "left").select("node", F.coalesce("to", "community").alias("community")))
    ends = w.join(name.select("a", F.col("to").alias("ta")), "a", "left").join(name.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b", "left")
    ends = ends.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "w")
    return owner, store_table(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))


def leiden(nodes: DataFrame, edges: DataFrame, weight: str = "weight_jaccard") -> None:
    """Not available without its optional library: None, so that reports carry no entry."""
    return None


def _betweenness(graph: dict) -> dict:
    """Unweighted edge betweenness."""
    out: dict = defaultdict(float)
    for s in graph:
        order, parents, paths, far = [], defaultdict(list), defaultdict(int, {s: 1}), {s: 0}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for u in graph[v]:
                if u not in far:
                    far[u] = far[v] + 1
                    queue.append(u)
                if far[u] == far[v] + 1:
                    paths[u] += paths[v]
                    parents[u].append(v)
        credit: dict = defaultdict(float)
        for v in reversed(order):
            for p in parents[v]:
                part = paths[p] / paths[v] * (1 + credit[v])
                credit[p] += part
                out[min(p, v), max(p, v)] += part
    return out


def _parts(graph: dict) -> list[set]:
    seen, out = set(), []
    for s in graph:
        if s not in seen:
            part, stack = set(), [s]
            while stack:
                v = stack.pop()
                if v not in part:
                    part.add(v)
                    stack += [u for u in graph[v] if u not in part]
            seen |= part
            out.append(part)
    return out


def girvan_newman(nodes: DataFrame, edges: DataFrame, max_nodes: int = 500) -> DataFrame:
    """``(node, community)`` after the first split: edges of the greatest betweenness are taken away until there is one more component.

    Betweenness takes no notice of weights; ties go to the first edge in order. A graph of more than ``max_nodes`` nodes raises.
    """
    base = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    n = base.count()
    if n > max_nodes:
        raise ValueError(f"{n} nodes are more than {max_nodes}")
    kind = base.schema["node"].dataType.simpleString()
    rows = base.select(F.col("node").alias("a"), F.lit(None).cast(kind).alias("b")).unionByName(edges.select("a", "b"))

    def split(part: pd.DataFrame) -> pd.DataFrame:
        graph: dict = {}
        for a, b in part[["a", "b"]].itertuples(index=False, name=None):
            graph.setdefault(a, set())
            if b is not None and b == b:
                graph.setdefault(b, set())
                graph[a].add(b)
                graph[b].add(a)
        graph = {v: graph[v] for v in sorted(graph)}
        start = len(_parts(graph))
        while any(graph.values()) and len(_parts(graph)) == start:
            a, b = min(_betweenness(graph).items(), key=lambda x: (-round(x[1], 9), x[0]))[0]
            graph[a].discard(b)
            graph[b].discard(a)
        return pd.DataFrame([(v, min(p)) for p in _parts(graph) for v in p], columns=["node", "community"])

    return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(split, f"node {kind}, community {kind}")


def largest_community(nodes: DataFrame, edges: DataFrame, communities: DataFrame, max_nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among the ``max_nodes`` nodes of the highest degree of the largest community (ties by name)."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community").limit(1)
    members = communities.join(sizes.select("community"), "community", "left_semi").select(F.col("node").alias("item"))
    degree = both_ways(edges.select("a", "b"), "a", "b").groupBy(F.col("a").alias("_n")).agg(F.count(F.lit(1)).alias("d"))
    kept = members.join(degree, F.col("item") == F.col("_n"), "left").orderBy(F.desc_nulls_last("d"), "item").limit(max_nodes).select("item")
    return kept, induced(edges, kept)


def spectral(nodes: DataFrame, edges: DataFrame, k: int, weight: str = "weight_jaccard", iterations: int = 30) -> DataFrame:
    """``(node, community)`` of the largest component by power iteration clustering, the distributed relative of spectral clustering."""
    from pyspark.ml.clustering import PowerIterationClustering

    from tesselon.operators.ranking import number_keys

    if k < 2:
        raise ValueError("k must be at least 2")
    parts = connected_components(nodes.select(nodes.columns[0]), edges)
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    members = parts.join(top.select("component"), "component", "left_semi").select(F.col("node").alias("item"))
    index = store_table(number_keys(members, "item", "id"))
    if index.count() < k:
        raise ValueError("the largest component has fewer nodes than k")
    inside = edges.join(index.select(F.col("item").alias("a"), F.col("id").cast("bigint").alias("src")), "a").join(index.select(F.col("item").alias("b"), F.col("id").cast("bigint").alias("dst")), "b")
    model = PowerIterationClustering(k=k, maxIter=iterations, weightCol="w")
    found = model.assignClusters(inside.select("src", "dst", F.col(weight).cast("double").alias("w")))
    return index.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select(F.col("item").alias("node"), F.col("cluster").alias("community"))


def serialized(communities: DataFrame) -> DataFrame:
    """``(rank, size, community)``: community sizes from the largest; their members stay in the table of communities."""
    sizes = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.desc("size"), "community")


def analyze(train: DataFrame, labels: DataFrame, *, min_shared_users: int = 3, top_n_items: int | None = None, weight: str = "weight_jaccard", k_values: tuple[int, ...] = (10, 25, 50), max_nodes: int = 500) -> dict[str, DataFrame | None]:
    """The whole graph analysis as tables by name; a method that refuses the graph (ValueError) has None.

    Beside the tables of communities (node, community) there are the facts and summaries of both graphs, and of each
    method its community sizes, modularity and alignment with the labels, by names such as ``louvain_sizes``.
    """
    nodes, edges = (store_table(x) for x in project_items(train, min_shared_users, top_n_items))
    pairs = store_table(bipartite_graph(train))
    found = store_table(louvain(nodes, edges, weight))
    out: dict[str, DataFrame | None] = {"bipartite": analysis.bipartite_facts(pairs), "bipartite_summaries": analysis.bipartite_summaries(pairs), "projection": analysis.projection_facts(nodes, edges), "projection_summaries": analysis.projection_summaries(nodes, edges), "clustering": analysis.clustering(nodes, edges)}
    largest = largest_community(nodes, edges, found, max_nodes)
    runs = {"louvain": (lambda: found, edges), "leiden": (lambda: leiden(nodes, edges), edges), **{f"spectral_{k}": (lambda k=k: spectral(nodes, edges, k, weight), edges) for k in k_values}}
    runs |= {"girvan_newman": (lambda: girvan_newman(nodes, edges, max_nodes), edges), "girvan_newman_largest": (lambda: girvan_newman(*largest, max_nodes), largest[1])}
    for name, (run, inside) in runs.items():
        try:
            out[name] = run()
        except ValueError:
            out[name] = None
        if out[name] is not None:
            out[name] = store_table(out[name])
            covered = inside.join(out[name].select(F.col("node").alias("a")), "a", "left_semi").join(out[name].select(F.col("node").alias("b")), "b", "left_semi")
            out |= {f"{name}_sizes": serialized(out[name]), f"{name}_modularity": analysis.modularity(covered, out[name], weight), f"{name}_alignment": analysis.alignment(out[name], labels)}
    return out


def community_tables(found: dict[str, DataFrame | None]) -> dict[str, DataFrame | None]:
    """The tables of communities among those of ``analyze``; all others are small."""
    return {k: v for k, v in found.items() if k in ("louvain", "leiden", "girvan_newman", "girvan_newman_largest") or k.startswith("spectral_") and k.removeprefix("spectral_").isdigit()}


def analysis_report(found: dict[str, DataFrame | None], settings: dict) -> dict:
    """The facts of ``analyze`` as one tree that JSON can hold; members stay in the tables of communities."""
    methods = community_tables(found)
    one = lambda name: small_rows(found[name])[0]
    by_value = lambda name: {r.pop("value"): r for r in small_rows(found[name])}

    def method(name: str) -> dict | None:
        if methods[name] is None:
            return None
        sizes = [r["size"] for r in small_rows(found[f"{name}_sizes"])]
        return {"n_communities": len(sizes), "sizes": sizes, "modularity": one(f"{name}_modularity")["modularity"], "alignment": one(f"{name}_alignment")}

    return {"settings": settings, "bipartite": one("bipartite") | by_value("bipartite_summaries"), "projection": one("projection") | one("clustering") | by_value("projection_summaries"), "communities": {name: method(name) for name in methods}}
