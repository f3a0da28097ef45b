"""The most similar vectors of every vector (problem 3): cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tesselon.operators.ranking import top_per_key
from tesselon.session import store_table

#: Vectors a bucket holds on average where the table adapts to their number: a part of them, between these.
BUCKET, BUCKET_PART, BUCKET_MOST = 1500, 120, 6000
#: The share of the true neighbours of a sample that the tables must find.
RECALL = 0.95
#: Vectors of that sample, whose true neighbours are found by comparing them with all vectors.
SAMPLE = 256
#: With a least cosine, the share of pairs at just that cosine that the tables must find.
SURE = 0.9995
#: Tables at most; if they don't find enough, buckets are made larger, until they hold everything.
TABLES_MOST = 32
#: Buckets with more vectors are cut by id and all parts compared with each other, so no task gets a bucket that grows with the data.
LARGE = 20_000
#: Large buckets that are cut at most, those with most vectors; any other has less than one vector in so many of all a table.
CUT_MOST = 50_000
#: With a least cosine vectors travel as whole numbers of 16 bits; cosines of these are off by less than SLACK.
STEPS, SLACK, SPARE = 32_767, 1e-4, 6
#: Ids of vectors that are sent to all tasks at most.
FEW = 500_000
SEED = 7


def bucket_dims(n: float, dim: int) -> list[int]:
    """Over how many coordinates each of a table's hashes chooses its axis, for buckets of the size wanted."""
    dims, left = [], max(1.0, n / min(BUCKET_MOST, max(BUCKET, n // BUCKET_PART)))
    while left > 1.5:
        d = int(min(dim, max(1, round(left / 2))))
        dims.append(d)
        left /= 2 * d
    return dims or [1]


def default_probes(dims: Sequence[int], dim: int) -> int:
    """Two buckets a table for one full hash; more as further hashes make buckets smaller."""
    extra = float(np.prod([2.0 * d for d in dims])) / (2 * dim)
    return 2 if extra <= 1 else int(np.ceil(2 * extra**0.75))


class Rotations:
    """Pseudo-rotations by rounds of random signs and a fast Hadamard transform, the same in every task."""

    def __init__(self, dim: int, seed: int = SEED) -> None:
        self.dim, self.seed = dim, seed
        self.size = 1 << max(0, dim - 1).bit_length()

    def turn(self, x: np.ndarray, which: tuple[int, ...]) -> np.ndarray:
        signs = np.random.default_rng([self.seed, *which]).choice(np.array([-1, 1], np.float32), (3, self.size))
        y = np.zeros((len(x), self.size), np.float32)
        y[:, : x.shape[1]] = x
        for row in signs:
            y *= row
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), self.size)
                h *= 2
            y /= np.sqrt(np.float32(self.size))
        return y

    def probes(self, x: np.ndarray, which: tuple[int, ...], dims: Sequence[int], most: int) -> np.ndarray:
        """The codes of the ``most`` nearest buckets of each vector (fewer columns if there are fewer), its own first.

        A bucket is a signed axis for each hash; buckets are ordered by how far they lie behind the vector's own ones.
        """
        code = np.zeros((len(x), 1), np.int64)
        behind = np.zeros((len(x), 1), np.float32)
        for level, d in enumerate(dims):
            y = self.turn(x, (*which, level))[:, :d]
            both = np.concatenate((y, -y), axis=1)
            keep = min(most, 2 * d)
            axes = np.argpartition(-both, keep - 1, axis=1)[:, :keep] if keep < 2 * d else np.broadcast_to(np.arange(2 * d), both.shape)
            gap = (both.max(axis=1, keepdims=True) - np.take_along_axis(both, axes, 1)) ** 2
            code = (code[:, :, None] * (2 * d) + axes[:, None, :]).reshape(len(x), -1)
            behind = (behind[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            best = np.argsort(behind, axis=1, kind="stable")[:, :most]
            code, behind = np.take_along_axis(code, best, 1), np.take_along_axis(behind, best, 1)
        return code


def tables_for(x: np.ndarray, y: np.ndarray, dim: int, dims: Sequence[int], probes: int, share: float) -> int | None:
    """The least number of tables in which that share of the pairs (a row of x and one of y) meet, or None.

    A pair meets where either is looked for in the other's bucket. The tables tried are those that are then used.
    """
    rotations, met = Rotations(dim), np.zeros(len(x), bool)
    for t in range(TABLES_MOST):
        a, b = (rotations.probes(v, (t,), dims, probes) for v in (x, y))
        met |= (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
        if met.mean() >= share:
            return t + 1
    return None


def fitted(x: np.ndarray, y: np.ndarray, n: int, dim: int, share: float, dims: Sequence[int] | None, probes: int | None) -> tuple[int, list[int], int]:
    """(tables, dims, probes) with which that share of the pairs meet: with the usual buckets, or as much larger ones as it takes."""
    wanted = float(n)
    while True:
        own = list(dims) if dims is not None else bucket_dims(wanted, dim)
        tries = probes or default_probes(own, dim)
        tables = tables_for(x, y, dim, own, tries, share)
        if tables is not None:
            return tables, own, tries
        if dims is not None or own == [1]:
            raise ValueError(f"with hashes over {own} coordinates and {tries} probes, {TABLES_MOST} tables find too few neighbours")
        wanted /= 2


def pairs_at(cosine: float, dim: int, n: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """Made-up pairs of vectors at just this cosine; more similar ones are found more surely."""
    rng = np.random.default_rng(SEED)
    x, y = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return x.astype(np.float32), y.astype(np.float32)


def true_pairs(vectors: DataFrame, dim: int, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample of the vectors (id, v), chosen by hash, and the ``k`` most similar ones of each among all vectors, as pairs."""
    chosen = vectors.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).toArrow()
    queries, ids = _unit(chosen["v"].combine_chunks(), dim).astype(np.float32), chosen["id"].to_numpy()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros((0, dim), np.float32))]
        for batch in batches:
            if len(batch):
                own, x = _matrix(batch, dim)
                order = np.argsort(own, kind="stable")
                q, at, c = candidates(queries, ids, x[order], own[order], k, None)
                held.append((q, own[order][at], c, x[order][at]))
                q, m, c, x = (np.concatenate(p) for p in zip(*held, strict=True))
                order = np.lexsort((m, -c, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                held = [tuple(v[order][place < k] for v in (q, m, c, x))]
        q, m, c, x = held[0]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.float32()), _binary(x)], ["q", "m", "c", "x"])

    found = top_per_key(vectors.mapInArrow(best, "q bigint, m bigint, c float, x binary"), ["q"], [F.desc("c"), F.col("m")], k).select("q", "x").toArrow()
    if not found.num_rows:
        return queries[:0], queries[:0]
    place = np.argsort(ids)
    return queries[place[np.searchsorted(ids[place], found["q"].to_numpy())]], _floats(found["x"], dim)


class Tables:
    """Where vectors are kept and looked for: buckets, numbered over all tables."""

    def __init__(self, dim: int, tables: int, dims: Sequence[int], probes: int) -> None:
        self.rotations, self.tables, self.dims, self.probes = Rotations(dim), tables, list(dims), probes
        self.cut, self.parts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # large buckets in order, and each one's parts by id

    def places(self, x: np.ndarray, ids: np.ndarray, probes: int) -> tuple[np.ndarray, ...]:
        """(row, bucket, part, own, asks): for each vector its own bucket in each table and, to look in, the next ones.

        In a bucket of ``many`` parts a part is a pair of one of members and one of queries: a member lies (``own``) in
        ``many`` of them and a query looks (``asks``) in as many, and each two of them meet in just one.
        """
        found = []
        for t in range(self.tables):
            code = self.rotations.probes(x, (t,), self.dims, probes)
            row, own = np.repeat(np.arange(len(x)), code.shape[1]), np.tile(np.arange(code.shape[1]) == 0, len(x))
            bucket = code.ravel() * TABLES_MOST + t
            part, asks = np.zeros(len(row), np.int64), np.ones(len(row), bool)
            if len(self.cut):
                at = np.minimum(np.searchsorted(self.cut, bucket), len(self.cut) - 1)
                many = np.where(self.cut[at] == bucket, self.parts[at], 1)
                # first as a query against all parts of members, then as a member for all other parts of queries
                times = many + np.where(own, many - 1, 0)
                first = np.cumsum(times) - times
                shift = np.arange(int(times.sum())) - np.repeat(first, times)
                row, bucket, own, many = (np.repeat(v, times) for v in (row, bucket, own, many))
                home = ids[row] % many
                asks = shift < many
                other = (home + np.where(asks, shift, shift - many + 1)) % many
                part = np.where(asks, other * many + home, home * many + other)
                own = own & (~asks | (shift == 0))
            found.append((row, bucket, part, own, asks))
        return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), _unit(batch.column(1), dim).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _floats(column: pa.ChunkedArray, dim: int, kind: type = np.float32) -> np.ndarray:
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets, size = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1], np.dtype(kind).itemsize
    return np.frombuffer(array.buffers()[2], kind)[offsets[0] // size : offsets[-1] // size].reshape(-1, dim)


def _at_least_kth(cosine: np.ndarray, k: int) -> np.ndarray:
    """Marks in each row the ``k`` greatest and some more: all that reach the k-th greatest of the maxima of 8 k groups of columns."""
    groups = 8 * k
    width = cosine.shape[1] // groups
    if width < 2:
        return cosine > -1.5
    most = cosine[:, : groups * width].reshape(len(cosine), width, groups).max(axis=1)
    return cosine >= np.maximum(np.partition(most, groups - k, axis=1)[:, groups - k, None], -1.5)


def candidates(queries: np.ndarray, query_ids: np.ndarray, members: np.ndarray, member_ids: np.ndarray, k: int, least: float | None, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of a query, place of a member, cosine): among these are the ``k`` members nearest to each query; never itself.

    With ``least`` only members at least so similar, and of a query's members about the ``k`` nearest if there are more.
    Members are in the order of their ids, each once.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    step = max(1, block // max(1, len(members)))
    for i in range(0, len(queries) if len(members) else 0, step):
        own, cosine = query_ids[i : i + step], queries[i : i + step] @ members.T
        at = np.minimum(np.searchsorted(member_ids, own), len(members) - 1)
        same = np.flatnonzero(member_ids[at] == own)
        cosine[same, at[same]] = -2
        if least is None:
            hit = _at_least_kth(cosine, k)
        else:
            hit = cosine >= least
            over = np.flatnonzero(hit.sum(axis=1) > 4 * k)
            if len(over):  # in a dense region all pairs are similar enough
                hit[over] &= _at_least_kth(cosine[over], k)
        q, m = np.nonzero(hit)
        out.append((own[q], m, cosine[q, m]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(query: np.ndarray, neighbour: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best distinct neighbours with their ranks from 1; ties by the lesser neighbour."""
    order = np.lexsort((-cosine, neighbour, query))
    query, neighbour, cosine = query[order], neighbour[order], cosine[order]
    new = np.concatenate(([True], (query[1:] != query[:-1]) | (neighbour[1:] != neighbour[:-1])))[: len(query)]
    query, neighbour, cosine = query[new], neighbour[new], cosine[new]
    order = np.lexsort((neighbour, -cosine, query))
    query, neighbour, cosine = query[order], neighbour[order], cosine[order]
    first = np.concatenate(([True], query[1:] != query[:-1]))[: len(query)]
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) + 1
    best = rank <= k
    return query[best], neighbour[best], cosine[best], rank[best]


def similar_vectors(df: DataFrame, item: Column, vector: Column, order: Column, dim: int, k: int = 10, *, min_cosine: float | None = None, recall: float = RECALL, tables: int | None = None, probes: int | None = None, dims: Sequence[int] | None = None, large: int = LARGE, sample: int = SAMPLE) -> DataFrame:
    """``(item, neighbour, rank, cosine)``: for each item up to ``k`` items with the most similar vectors.

    Every item is a query against all others. Null items and orders, null vectors, vectors of another length than ``dim``
    and those that are all zero or hold nulls, NaN or infinity, are left out. An item in several rows counts once, with the
    vector of the least ``order`` (a unique whole number). An empty table or a single vector gives no rows. Ties go to the
    lesser ``order``.

    A vector lies in one bucket of each table, that of the signed axes nearest to it after pseudo-rotations, and is
    looked for in ``probes`` buckets a table. The exact cosines of all pairs that meet so are computed, for both vectors,
    so the only loss is of neighbours that share no bucket. The number of buckets grows with that of vectors
    (``bucket_dims``). The number of tables is the least that finds a share of ``recall`` of the true neighbours of
    ``sample`` vectors, which are compared with all vectors first; with ``min_cosine`` (only neighbours at least that
    similar are looked for) the least that finds 99.95 % of made-up pairs at just that cosine. If ``TABLES_MOST`` tables
    don't do, buckets are made larger until they do. ``tables``, ``probes`` and ``dims`` set what is not to be found out.

    A bucket with more than ``large`` vectors is cut by id into parts of members and of queries, which are all compared:
    its size decides the tasks, not what is found. No bucket is cut short. With ``min_cosine`` vectors travel to the
    buckets in 16-bit numbers, and the pairs that come near enough are compared again with the vectors themselves.
    """
    valid = F.size("v") == dim
    valid = valid & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(item.alias("item"), vector.alias("v"), order.cast("bigint").alias("o")).where("item is not null and v is not null and o is not null").where(valid)
    base = store_table(rows.groupBy("item").agg(F.min("o").alias("id"), F.min_by("v", "o").alias("v")))
    n = base.count()
    vectors = base.select("id", "v")
    near = min_cosine is not None and min_cosine > 0
    if tables is None and n > 1:
        pairs = pairs_at(min_cosine, dim) if near else true_pairs(vectors, dim, k, sample)
        tables, dims, probes = fitted(*pairs, n, dim, SURE if near else recall, dims, probes or (2 if near else None))
    dims = list(dims) if dims is not None else bucket_dims(n, dim)
    where = Tables(dim, tables or 1, dims, probes or default_probes(dims, dim))
    kept, least = (k + SPARE, min_cosine - SLACK) if near else (k, min_cosine)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, x = _matrix(batch, dim)
                buckets, n_of = np.unique(where.places(x, ids, 1)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(n_of, pa.int64())], ["bucket", "n"])

    if n > large:
        hot = vectors.mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > large)
        cut = sorted((r["bucket"], -(-r["n"] // large)) for r in hot.orderBy(F.desc("n")).limit(CUT_MOST).collect())
        where.cut, where.parts = np.array(cut, np.int64).reshape(-1, 2).T.copy()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(20, 2000 // int(where.parts.max(initial=1)))
        for batch in batches:
            for start in range(0, len(batch), step):
                ids, x = _matrix(batch.slice(start, step), dim)
                row, bucket, part, own, asks = where.places(x, ids, where.probes)
                sent = np.round(x * STEPS).astype(np.int16) if near else x
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(part, pa.int32()), pa.array(ids[row], pa.int64()), pa.array(own), pa.array(asks), _binary(sent[row])], ["bucket", "part", "id", "own", "asks", "x"])

    def in_bucket(group: pa.Table) -> pa.Table:
        ids, own, asks = (group[c].to_numpy() for c in ("id", "own", "asks"))
        x = _floats(group["x"], dim, np.int16).astype(np.float32) / np.float32(STEPS) if near else _floats(group["x"], dim)
        inside, outside = np.flatnonzero(own), np.flatnonzero(asks & ~own)
        inside, outside = (v[np.argsort(ids[v], kind="stable")] for v in (inside, outside))
        found = []
        # members as queries among members, and both ways between members and the vectors that only look here
        for queries, members in ((np.flatnonzero(asks & own), inside), (outside, inside), (inside, outside)):
            q, m, c = candidates(x[queries], ids[queries], x[members], ids[members], kept, least)
            found.append((q, ids[members][m], c))
        query, neighbour, cosine, _ = top_k(*(np.concatenate(p) for p in zip(*found, strict=True)), kept)
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))[: len(query)])
        offsets = pa.array(np.append(starts, len(query)), pa.int32())
        return pa.table([pa.array(query[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(neighbour, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(cosine, pa.float32()))], ["q", "m", "c"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if len(batch):
                m = batch.column(1)
                sizes_of = np.diff(np.frombuffer(m.buffers()[1], np.int32)[m.offset : m.offset + len(m) + 1])
                held.append((np.repeat(batch.column(0).to_numpy(), sizes_of), m.flatten().to_numpy(), batch.column(2).flatten().to_numpy()))
        if held:
            query, neighbour, cosine, rank = top_k(*(np.concatenate(p) for p in zip(*held, strict=True)), kept)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(neighbour, pa.int64()), pa.array(rank, pa.int64()), pa.array(cosine.astype(np.float64), pa.float64())], ["q", "m", "rank", "cosine"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cosine = (_unit(batch.column(4), dim) * _unit(batch.column(5), dim)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(cosine)], ["q", "m", "item", "neighbour", "cosine"])

    spread = vectors.mapInArrow(placed, "bucket bigint, part int, id bigint, own boolean, asks boolean, x binary")
    lists = spread.groupBy("bucket", "part").applyInArrow(in_bucket, "q bigint, m array<bigint>, c array<float>")
    best = lists.repartition("q").mapInArrow(merged, "q bigint, m bigint, rank bigint, cosine double")
    if near:  # mostly few vectors have such neighbours, and only these are needed again
        best = store_table(best.select("q", "m"))
        if 2 * best.count() <= FEW:
            ids = best.select(F.explode(F.array("q", "m")).alias("id")).distinct()
            base = base.join(F.broadcast(ids), "id", "left_semi")
    named = lambda c, i, v: base.select(F.col("id").alias(c), F.col("item").alias(i), *([F.col("v").alias(v)] if near else []))
    best = best.join(named("q", "item", "_v"), "q").join(named("m", "neighbour", "_w"), "m")
    if near:
        kind = base.schema["item"].dataType.simpleString()
        best = best.select("q", "m", "item", "neighbour", "_v", "_w").mapInArrow(exact, f"q bigint, m bigint, item {kind}, neighbour {kind}, cosine double")
        best = top_per_key(best.where(F.col("cosine") >= F.lit(float(min_cosine))), ["q"], [F.desc("cosine"), F.col("m")], k)
    return best.select("item", "neighbour", F.col("rank").cast("bigint").alias("rank"), "cosine")
