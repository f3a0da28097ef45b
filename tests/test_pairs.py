"""Pairs within baskets, numbering and sampled negatives, with hot keys."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tesselon.models.collaborative import ItemKNN
from tesselon.operators import metrics, pairs
from tesselon.operators.ranking import number_keys, numbered, sample_exactly


def baskets(seed=0):
    rng = random.Random(seed)
    rows = {(f"u{rng.randrange(40)}", f"i{rng.randrange(60):02d}") for _ in range(400)}
    return sorted(rows | {("hot", f"i{k:02d}") for k in range(60)} | {("one", "i01")})


@pytest.mark.parametrize("small_side", [10_000, 0])
def test_basket_pairs_against_brute_force(spark, monkeypatch, small_side):
    monkeypatch.setattr(pairs, "SMALL_SIDE", small_side)
    rows = baskets()
    found = pairs.basket_pairs(spark.createDataFrame(rows, "basket string, item string"), pairs.item_pair, chunk=7)
    held = defaultdict(list)
    for u, i in rows:
        held[u].append(i)
    assert Counter((r["p"]["a"], r["p"]["b"]) for r in found.collect()) == Counter(p for own in held.values() for p in itertools.combinations(sorted(own), 2))
    assert pairs.basket_pairs(spark.createDataFrame([], "basket string, item string"), pairs.item_pair).count() == 0


def test_no_task_meets_a_hot_basket(spark):
    """One basket holds a tenth of all rows: its blocks are no larger than others', and its rows are dealt over all tasks."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 900).cast("string"))).alias("basket"), F.format_string("i%05d", F.col("id")).alias("item"))
    found = pairs.basket_pairs(rows, pairs.item_pair, chunk=64).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    counts = sorted(r["count"] for r in found)
    assert sum(counts) == 2000 * 1999 // 2 + 900 * 20 * 19 // 2 and counts[-1] <= 3 * counts[len(counts) // 2]


def test_item_neighbours_have_the_common_users_deviation(spark):
    rng = random.Random(1)
    rows = [(u, i, float(rng.randrange(2, 11)) / 2) for u, i in baskets()]
    train = spark.createDataFrame(rows, "user_id string, parent_asin string, rating double")
    asked = [("u1", "i05"), ("hot", "i07"), ("one", "i03"), ("u2", "unknown"), ("new", "i01")]
    got = {(r[0], r[1]): r["est"] for r in ItemKNN(k=5).fit(train).predict(spark.createDataFrame(asked, "user_id string, parent_asin string")).collect()}
    of, item = defaultdict(dict), defaultdict(dict)
    for u, i, r in rows:
        of[u][i] = item[i][u] = r
    mean = {i: sum(x.values()) / len(x) for i, x in item.items()}
    every = sum(r for *_, r in rows) / len(rows)
    for u, i in asked:
        if u not in of or i not in item:
            want = every
        else:
            near = []
            for j in of[u]:
                both = item[i].keys() & item[j].keys()
                if both:
                    near.append((-1 / (1 + sum((item[i][x] - item[j][x]) ** 2 for x in both) / len(both)), j))
            near = sorted(near)[:5]
            want = mean[i] + sum(-s * (of[u][j] - mean[j]) for s, j in near) / sum(-s for s, _ in near)
        assert got[u, i] == pytest.approx(min(5, max(1, want)))


def test_numbers_follow_the_order(spark):
    keys = [f"{'same prefix ' * 5}{k:04d}" for k in range(500)]
    random.Random(2).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "key string").repartition(7)
    assert {r["key"]: r["n"] for r in number_keys(df, "key", "n").collect()} == {k: n for n, k in enumerate(sorted(keys))}
    placed = numbered(df.where("key is not null").distinct().withColumn("c", F.lit(1)), "n", F.desc("c"), F.col("key"))
    assert [r["key"] for r in placed.orderBy("n").collect()] == sorted(keys)
    assert number_keys(df.limit(0), "key", "n").count() == 0


def test_samples_take_the_least_orders(spark):
    df = spark.createDataFrame([(k % 900,) for k in range(1000)], "k int")
    place = lambda k: hashlib.md5(f"3|{k}".encode()).hexdigest()
    for n in (0, 1, 40, 999, 1000, 2000):
        want = sorted((k % 900 for k in range(1000)), key=place)[:n]
        assert sorted(r["k"] for r in sample_exactly(df, n, 3, F.col("k")).collect()) == sorted(want)
    repeated = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "k int")
    assert sample_exactly(repeated, 60, 3, F.col("k")).count() == 60


def test_negatives_of_users_who_have_seen_much(spark):
    """Of 400 items users have seen from none to all; the rest of the probes, and then the catalog in order, fill up."""
    items = [f"i{k:03d}" for k in range(400)]
    rng, seen = random.Random(4), {}
    for k, share in enumerate((0, 0.3, 0.6, 0.8, 0.9, 0.97, 0.99, 1)):
        seen[f"u{k}"] = set(rng.sample(items, int(share * 400)))
    n, size = 20, len(items)
    users = spark.createDataFrame([(u,) for u in seen] + [(None,)], "user_id string")
    exclude = spark.createDataFrame([(u, i) for u, own in seen.items() for i in own], "user_id string, parent_asin string")
    got = defaultdict(list)
    for r in metrics.sample_negatives(users, spark.createDataFrame([(i,) for i in items * 2], "parent_asin string"), exclude, n, 7).collect():
        got[r["user_id"]].append(r["parent_asin"])
    for u, own in seen.items():
        want = []
        for j in range(3 * n):
            i = items[int(hashlib.md5(f"7|{u}|{j}".encode()).hexdigest()[24:32], 16) % size]
            if i not in own and i not in want:
                want.append(i)
        want = want[:n]
        want += [i for i in items if i not in own and i not in want][: n - len(want)]
        assert sorted(got[u]) == sorted(want)
    assert None not in got
    assert metrics.sample_negatives(users, exclude.limit(0), exclude, n).count() == 0 == metrics.sample_negatives(users, exclude, exclude, 0).count()
