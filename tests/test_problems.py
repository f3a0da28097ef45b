"""Per-key profiles under skew and bit-sliced event features."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.functions.bitmaps import Bitmap, SlicedCounter, TypeCounters
from tesselon.functions.keys import clean_key, epoch_millis, not_blank, utc_month
from tesselon.operators import event_features
from tesselon.operators.event_features import entity_features
from tesselon.operators.key_profile import hot_keys, key_history, key_profile


def test_keys_and_times(spark):
    row = spark.createDataFrame([("\t ab1 ", 1_600_000_000, None)], "k string, t bigint, n string").select(clean_key("k").alias("k"), epoch_millis("t").alias("ms"), utc_month(epoch_millis("t")).alias("m"), clean_key("n").alias("n")).first()
    assert tuple(row) == ("AB1", 1_600_000_000_000, 202009, None)
    odd = spark.createDataFrame([("",), (" \u3000",), ("\xa0é b\x85",), ("~x!",), ("x\x7f",), (None,), (" ~",), ("~ ",)], "k string")
    assert [r[0] for r in odd.select(clean_key("k")).collect()] == ["", "", "É B", "~X!", "X\x7f", None, "~", "~"]
    assert [r[0] for r in odd.select(not_blank("k")).collect()] == [False, False, True, True, True, None, True, True]
    assert spark.range(1).select(utc_month(F.lit(-1)).alias("m")).first()["m"] == 196912


def _rows(n=3000):
    rng = random.Random(0)
    return [(rng.choice([None, "hot", "hot", f"k{rng.randrange(50)}"]), None if rng.random() < 0.05 else rng.randrange(9) / 2, i * 7919 % 100_003, "clash") for i in range(n)]


@pytest.mark.parametrize("fine", [False, True])
def test_profile_against_brute_force(spark, fine):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, v double, t bigint, n_rows string")
    got = {r["k"]: r for r in key_profile(df, F.col("k"), F.col("t" if fine else "v"), key_name="k", percentiles=(0.01, 0.5, 1.0), window_values=0 if fine else 1000).collect()}
    by = defaultdict(list)
    for k, v, t, _ in rows:
        by[k].append(t if fine else v)
    assert set(got) == set(by)
    for k, values in by.items():
        real = sorted(v for v in values if v is not None)
        r, counts = got[k], Counter(real)
        assert (r["n_rows"], r["n_valued"], r["n_distinct"]) == (len(values), len(real), len(counts))
        assert r["mean"] == pytest.approx(np.mean(real)) and (r["minimum"], r["maximum"]) == (real[0], real[-1])
        assert (r["mode"], r["mode_count"]) == min(counts.items(), key=lambda x: (-x[1], x[0]))
        assert r["percentiles"] == [next(v for i, v in enumerate(real, 1) if i >= p * len(real)) for p in (0.01, 0.5, 1.0)]


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v double")
    r = key_profile(df, F.col("k"), F.col("v"), percentiles=(0.5,)).first()
    assert (r["n_rows"], r["n_valued"], r["n_distinct"], r["mode"], r["percentiles"]) == (2, 0, 0, None, None)
    assert key_profile(df.limit(0), F.col("k"), F.col("v"), percentiles=(0.5,)).count() == 0
    negative = spark.createDataFrame([("a", float(v)) for v in (-8, -3, -1, 0, 2, 9)], "k string, v double")
    assert key_profile(negative, F.col("k"), F.col("v"), percentiles=(0.5, 0.34), window_values=0).first()["percentiles"] == [-1.0, -1.0]
    with pytest.raises(ValueError):
        key_profile(df, F.col("k"), F.col("v"), percentiles=(0.0,))


def test_hot_keys(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [(None, "y"), ("", "y"), (" ", "z"), ("b", None), ("c", "x"), ("d", "q"), ("e", "q")], "u string, i string")
    got = {(r["field"], r["hot_key"], r["n_rows"]) for r in hot_keys(df, {"u": F.trim("u"), "i": F.col("i")}, F.lit(1), 0.3).collect()}
    assert got == {("u", "a", 3), ("i", "x", 4)}
    assert hot_keys(df.limit(0), {"u": F.col("u")}, F.lit(1), 0.5).count() == 0


def test_history_is_complete_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.randrange(10**12, 10**12 + 10**10)]), f"i{rng.randrange(5)}") for _ in range(400)]
    got = defaultdict(list)
    for r in key_history(spark.createDataFrame(rows, "k string, t bigint, i string"), F.col("k"), F.col("t"), 16, payload=("i",)).collect():
        assert {(e["seq"] - 1) // 16 for e in r["events"]} == {r["chunk"]} and len(r["events"]) <= 16
        got[r["key"]] += r["events"]
    for k in ("a", "b"):
        events = sorted(got[k], key=lambda e: e["seq"])
        assert [e["seq"] for e in events] == list(range(1, len(events) + 1))
        want = [(t, i) for key, t, i in rows if key == k]
        assert Counter((e["time"], e["i"]) for e in events) == Counter(want)
        times = [-1 if e["time"] is None else e["time"] for e in events]
        assert times == sorted(times)
    assert set(got) == {"a", "b"}


def test_bitmaps_and_carry_addition():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = (np.unique(rng.integers(0, 200_000, int(rng.integers(0, 30_000)))) for _ in range(2))
        x, y = Bitmap.of(a), Bitmap.of(b)
        assert (x ^ y).ordinals().tolist() == np.setxor1d(a, b).tolist()
        assert (x & y).ordinals().tolist() == np.intersect1d(a, b).tolist()
        again, _ = Bitmap.load(x.dump())
        assert again.ordinals().tolist() == a.tolist()
    n = 70_000
    total, counter = np.zeros(n, np.int64), SlicedCounter()
    for _ in range(12):
        at = np.unique(rng.integers(0, n, int(rng.integers(1, 40_000))))
        amount = rng.integers(0, 90, len(at))
        total[at] += amount
        counter.add(SlicedCounter.load(SlicedCounter.of(at, amount).dump())[0])
    assert counter.decode(np.arange(n)).tolist() == total.tolist()
    with pytest.raises(ValueError):
        SlicedCounter.of(np.array([1]), np.array([-1]))


def test_type_counters_merge():
    rng, parts, want = np.random.default_rng(1), [TypeCounters() for _ in range(3)], defaultdict(lambda: [0, 0, -1])
    for part in parts:
        at, amount, time = rng.integers(0, 50, 200), rng.integers(0, 9, 200), rng.integers(0, 1000, 200)
        part.add_events(at, np.ones(len(at), np.int64), amount, time)
        for o, v, t in zip(at.tolist(), amount.tolist(), time.tolist(), strict=True):
            want[o] = [want[o][0] + 1, want[o][1] + v, max(want[o][2], t)]
    whole = TypeCounters()
    for part in parts:
        whole.merge(TypeCounters.load(part.dump()))
    seen, n, total, latest = whole.decode()
    assert {o: list(x) for o, *x in zip(seen.tolist(), n.tolist(), total.tolist(), latest.tolist(), strict=True)} == dict(want)


@pytest.mark.parametrize("distinct", [True, False])
@pytest.mark.parametrize("hot", [0, 1, 20, None])
def test_entity_features_against_brute_force(spark, monkeypatch, distinct, hot):
    """With all entities dealt, all but rare ones, only the hot one, and that one just below the bound."""
    monkeypatch.setattr(event_features, "HOT_BLOCK", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small tables have several partitions
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "", f"u{rng.randrange(40)}", None]), f"i{rng.randrange(4)}", rng.choice([1.0, 4.5, None]), rng.choice([None, 5 + rng.randrange(300)])) for _ in range(2000)]
    n_hot = sum(u == "hot" for u, *_ in rows)
    df = spark.createDataFrame(rows, "u string, i string, r double, t bigint").withColumn("cells", F.lit("clash"))
    half = (2 * F.col("r")).cast("bigint")
    got = entity_features(df, F.col("u"), half, F.floor(F.col("t") / 50), half, F.col("t"), distinct_by=("i", "r", "t") if distinct else (), hot_rows={0: 0, 1: n_hot, 20: 20, None: n_hot + 1}[hot]).collect()
    want = defaultdict(lambda: defaultdict(lambda: [0, 0, -1]))
    for u, i, r, t in set(rows) if distinct else rows:
        if None not in (u, r, t):
            c = want[u][int(2 * r), t // 50]
            c[0] += 1
            c[1] += int(2 * r)
            c[2] = max(c[2], t)
    assert len(got) == len(want)
    for row in got:
        assert [(c["type_a"], c["type_b"], c["n"], c["total"], c["latest"]) for c in row["cells"]] == [(*k, *v) for k, v in sorted(want[row["entity"]].items())]
    assert entity_features(df.limit(0), F.col("u"), half, F.lit(1), half, F.col("t")).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("distinct", [(), ("v",)])
def test_negative_amounts_raise(spark, distinct):
    df = spark.createDataFrame([("a", -1)], "u string, v bigint")
    with pytest.raises(Exception, match="negative"):
        entity_features(df, F.col("u"), F.lit(1), F.lit(1), F.col("v"), F.lit(1), distinct_by=distinct).collect()


def test_names_that_would_clash(spark):
    df = spark.createDataFrame([(1, 2)], "k int, t bigint")
    with pytest.raises(ValueError):
        key_profile(df, F.col("k"), F.col("t"), key_name="MEAN")
    with pytest.raises(ValueError):
        key_history(df, F.col("k"), F.col("t"), payload=("time",))
    with pytest.raises(ValueError):
        entity_features(df, F.col("k"), F.col("t"), F.col("t"), F.col("t"), F.col("t"), entity_name="cells")
    assert entity_features(df, F.col("k"), F.col("t"), F.col("t"), F.col("t"), F.col("t")).first()["entity"] == "1"
