"""Hot keys are cut into pieces: results must not change."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators.asof import asof_join, validity_intervals
from orrery.operators.changes import apply_changes
from orrery.operators.history import merge_history
from orrery.operators.hot import CHUNK, heavy_keys, neighbours, split_hot
from orrery.operators.intervals import IntervalMap, periods_and_gaps
from orrery.runtime import cut

HOT = {"share": 0.1, "least": 10}


def skewed(n, seed, keys=(1, 1, 1, 2, 3, 4, 5, 6)):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(500)) for _ in range(n)]


def test_heavy_keys(spark):
    df = spark.createDataFrame(skewed(800, 1), "k int, t bigint")
    assert len(heavy_keys(df, ["k"], 0.2, 10)) == 1
    split = split_hot(df, ["k"], "t", 0.05, 10)
    sizes = [r["count"] for r in split.df.filter("k = 1").groupBy(CHUNK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 100  # of 300 rows
    assert heavy_keys(df, ["k"], 0.2, 10_000) == {}
    assert heavy_keys(df.limit(0), ["k"]) == {}


def test_neighbours(spark):
    rows = sorted(set(skewed(600, 2)))
    df = spark.createDataFrame(rows, "k int, t bigint")
    split = split_hot(df, ["k"], "t", **HOT)
    assert split.hot and split.df.select(CHUNK).distinct().count() >= 3
    got = {(r["k"], r["t"]): (r["n"], r["p"]) for r in neighbours(split.df, split, ["t"], lead={"n": "t"}, lag={"p": "t"}).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        ts = [t for kk, t in rows if kk == k]
        for i, t in enumerate(ts):
            want[k, t] = (ts[i + 1] if i + 1 < len(ts) else None, ts[i - 1] if i else None)
    assert got == want


@pytest.mark.parametrize("limits", [{}, HOT])
def test_history(spark, limits):
    rng = random.Random(3)
    rows = [(k, t, rng.choice("aab"), rng.randrange(3)) for k, t in skewed(700, 3)] + [(None, 5, "a", 1), (1, None, "a", 1)]
    df = spark.createDataFrame(rows, "k int, t bigint, v string, load int")
    got = sorted((r["k"], r["v"], r["valid_from_us"], r["valid_to_us"]) for r in merge_history(df, key="k", at="t", tracked=["v"], tie=["load"], **limits).collect())
    import hashlib

    digest = lambda v: hashlib.sha256(f"={v}".encode()).hexdigest()
    best = {}
    for k, t, v, load in rows:
        if k is not None and t is not None:
            best[k, t] = max(best.get((k, t), (-1, "", "")), (load, digest(v), v))
    want = []
    for k in {k for k, _ in best}:
        chain = []
        for t in sorted(t for kk, t in best if kk == k):
            if not chain or chain[-1][1] != best[k, t][2]:
                chain.append((t, best[k, t][2]))
        want += [(k, v, t, chain[i + 1][0] if i + 1 < len(chain) else 253402214400000000) for i, (t, v) in enumerate(chain)]
    assert got == sorted(want)


@pytest.mark.parametrize("limits", [{}, HOT])
def test_loads_one_after_the_other_give_the_history_of_all_at_once(spark, limits):
    """Late rows included: a history that keeps what confirmed a version knows that it held again after a late change."""
    rng = random.Random(13)
    rows = list({(k, t, load): (k, t, rng.choice("ab"), load) for k, t in skewed(300, 13) for load in [rng.randrange(4)]}.values())
    df = spark.createDataFrame(rows, "k int, t bigint, v string, load int")
    how = {"key": "k", "at": "t", "tracked": ["v"], "tie": ["load"], **limits}
    shown = lambda h: sorted(map(tuple, h.select("k", "v", "valid_from_us", "valid_to_us", "is_current").collect()))
    kept = None
    for load in range(4):
        kept = cut(merge_history(df.filter(F.col("load") == load), current=kept, repeats=True, **how))
    assert shown(kept.filter("is_version")) == shown(merge_history(df, **how)) and kept.filter("NOT is_version").count() > 0


def test_interval_map_keeps_its_gaps():
    rng = random.Random(15)
    for _ in range(200):
        m, units = IntervalMap(), set()
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(60)
            b = a + rng.choice([-1, 0, 1, 5, 20])
            m.insert(a, b)
            units |= set(range(a, b + 1))
            assert m.gaps() == [(e + 1, s - 1) for e, s in zip(m.ends, m.starts[1:], strict=False)]
        assert {x for a, b in m.periods() for x in range(a, b + 1)} == units and all(a <= b for a, b in m.gaps())
        assert IntervalMap.of(m.starts, m.ends).gaps() == m.gaps()


@pytest.mark.parametrize("limits", [{}, HOT])
def test_changes(spark, limits):
    rng = random.Random(4)
    rows = [(k, t, rng.randrange(3), rng.random() < 0.2, rng.choice(["x", "y", None])) for k, t in skewed(700, 4)]
    rows += rows[:100] + [(None, 1, 1, False, "x"), (9, None, 1, False, "z"), (9, 3, 1, False, "w")]
    df = spark.createDataFrame(rows, "k int, t bigint, v int, gone boolean, s string")
    base = spark.createDataFrame([(1, "old"), (77, "kept")], "k int, s string")
    got = {r["k"]: r["s"] for r in apply_changes(df, key="k", order=["t", "v", "gone"], deleted="gone", image=["s"], base=base, **limits).collect()}
    state = {1: "old", 77: "kept"}
    ordered = {}
    for k, t, v, gone, s in rows:
        if k is not None:
            rank = (k, -1 if t is None else t, v, gone)
            ordered[rank] = max(ordered.get(rank, (False, "")), (s is not None, s or ""))
    for (k, _, _, gone), (given, s) in sorted(ordered.items()):
        if gone:
            state.pop(k, None)
        else:
            state[k] = s if given else None
    assert got == state


@pytest.mark.parametrize("limits", [{}, HOT])
def test_periods_and_gaps(spark, limits):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b"]), t, t + rng.choice([-1, 0, 0, 1, 3, 40])) for k, t in skewed(900, 6, keys=(1, 1, 1, 1, 2, 3))]
    rows = [(1 if i % 3 else k, "a" if i % 3 else f, a, b) for i, (k, f, a, b) in enumerate(rows)]
    rows += [(1, "a", None, 5), (1, "a", 5, None), (None, None, 1, 2), (None, None, 4, 9), (2, "b", 10, 10_000)]
    df = spark.createDataFrame(rows, "k int, f string, a bigint, b bigint").withColumn("kind", F.lit("clash"))
    got = sorted((repr(r["k"]), repr(r["f"]), r["kind"], r["from_us"], r["to_us"]) for r in periods_and_gaps(df, ["k", "f"], "a", "b", held=50, **limits).collect())
    want = []
    for k, f in {r[:2] for r in rows}:
        m = IntervalMap([(a, b) for kk, ff, a, b in rows if (kk, ff) == (k, f) and a is not None and b is not None])
        units = sorted({x for kk, ff, a, b in rows if (kk, ff) == (k, f) and a is not None and b is not None for x in range(a, b + 1)})
        periods = [[units[0], units[0]]] if units else []
        for x in units[1:]:
            if x == periods[-1][1] + 1:
                periods[-1][1] = x
            else:
                periods.append([x, x])
        assert [list(p) for p in m.periods()] == periods
        want += [(repr(k), repr(f), "period", a, b) for a, b in periods]
        want += [(repr(k), repr(f), "gap", p[1] + 1, n[0] - 1) for p, n in zip(periods, periods[1:], strict=False)]
    assert got == sorted(want)


@pytest.mark.parametrize("limits", [{}, HOT, {"dense": 2, **HOT}])
def test_asof(spark, limits):
    rng = random.Random(7)
    burst = [(1, 10**15 + rng.randrange(3000)) for _ in range(150)]
    changes = [*skewed(200, 8), *burst, (None, 5), (1, None)]
    events = [(i, k, t) for i, (k, t) in enumerate([*skewed(300, 9), *[(1, 10**15 + rng.randrange(4000)) for _ in range(100)], (None, 5), (1, None), (99, 5), (1, -7)])]
    got = sorted((r["i"], r["known_at"]) for r in asof_join(
        spark.createDataFrame(events, "i int, k int, t bigint").withColumns({"lo": F.lit(1), "entity": F.lit("x"), "bucket": F.lit(2), "from_us": F.lit(3)}),
        spark.createDataFrame(changes, "k int, t bigint"), entity="k", event_at="t", change_entity="k", change_at="t", **limits).collect())
    want = []
    for i, k, t in events:
        known = [c for kk, c in changes if kk == k and k is not None and c is not None and t is not None and c <= t]
        if known:
            want.append((i, max(known)))
    assert got == sorted(want)


def test_empty_tables(spark):
    kt = spark.createDataFrame([], "k int, t bigint")
    assert validity_intervals(kt, "k", "t").count() == 0
    some = spark.createDataFrame([(1, 5)], "k int, t bigint")
    for events, changes in ((kt, some), (some, kt), (kt, kt)):
        assert asof_join(events, changes, entity="k", event_at="t", change_entity="k", change_at="t").count() == 0
    assert merge_history(kt.withColumn("v", F.lit("a")), key="k", at="t", tracked=["v"]).count() == 0
    assert periods_and_gaps(kt.withColumn("b", F.col("t")), ["k"], "t", "b").count() == 0
    feed = kt.withColumns({"gone": F.lit(False), "s": F.lit("x")})
    assert apply_changes(feed, key="k", order=["t", "gone"], deleted="gone", image=["s"]).count() == 0
    assert apply_changes(feed, key="k", order=["t", "gone"], deleted="gone", image=["s"], base=spark.createDataFrame([(1, "b")], "k int, s string")).count() == 1
