import random

import pytest

from orrery.operators.hierarchy import descendants, hierarchy

SCHEMA = "id int, boss int, us bigint"


def brute(rows):
    latest = {}
    for i, b, u in rows:
        if i is None:
            continue
        rank = (u is not None, u or 0, b is not None, b or 0)
        if i not in latest or rank > latest[i][0]:
            latest[i] = (rank, b)
    boss = {i: (b if b in latest else None) for i, (_, b) in latest.items()}
    out = {}
    for i in boss:
        chain, at = [], i
        while at is not None and at not in chain:
            chain.append(at)
            at = boss[at]
        if at is None:
            out[i] = (chain[-1], len(chain) - 1, "/".join(map(str, reversed(chain))))
        else:
            loop = chain[chain.index(at) :]
            out[i] = (min(loop), -1 if i in loop else -2, "")
    return out


def ours(spark, rows):
    placed = hierarchy(spark.createDataFrame(rows, SCHEMA), "id", "boss", "us")
    return {r["id"]: (r["root"], r["depth"], r["path"]) for r in placed.collect()}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, 5)],
        [(1, 1, 5), (2, 1, 5), (3, 2, 5)],
        [(1, 2, 5), (2, 3, 5), (3, 1, 5), (4, 1, 5), (5, 4, 5), (6, None, 5)],
        [(1, None, 5), (1, 2, 9), (2, None, 1), (1, None, None), (2, 99, 3), (None, 1, 4)],
        [(1, 2, None), (1, 3, None), (2, None, 1), (3, None, 1), (1, 3, None)],
    ],
)
def test_small(spark, rows):
    assert ours(spark, rows) == brute(rows)


def test_random(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(120), rng.choice([None, *range(130)]), rng.choice([None, *range(9)])) for _ in range(260)]
    rows = [*dict.fromkeys((i, u) for i, _, u in rows)] and list({(i, u): (i, b, u) for i, b, u in rows}.values())
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("stride", [1, 2, 5, 16])
def test_long_chains_with_any_stride(spark, stride):
    rng = random.Random(stride)
    rows = [(i, None if i == 0 else i - 1 if rng.random() < 0.7 else rng.randrange(i), 1) for i in range(60)]
    rows += [(100 + i, 100 + (i + 1) % 7, 1) for i in range(7)] + [(200 + i, 199 + i if i else 103, 1) for i in range(12)]
    placed = hierarchy(spark.createDataFrame(rows, SCHEMA), "id", "boss", "us", stride=stride)
    assert {r["id"]: (r["root"], r["depth"], r["path"]) for r in placed.collect()} == brute(rows)
    chain = placed.filter("id = 211").first()["chain"]
    assert chain == "/".join(map(str, [103, *range(200, 212)]))


def test_star_and_extra_columns(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 0, 1, "a", 7, "r") for i in range(500)], "id int, boss int, us bigint, path string, depth int, root string")
    placed = hierarchy(df, "id", "boss", "us")
    assert placed.filter("depth = 1").count() == 499
    assert descendants(placed).count() == 499


def test_descendants_of_trees_and_below_loops(spark):
    rows = [(1, None, 1), (2, 1, 1), (3, 2, 1), (10, 11, 1), (11, 10, 1), (12, 11, 1), (13, 12, 1)]
    pairs = {tuple(r) for r in descendants(hierarchy(spark.createDataFrame(rows, SCHEMA), "id", "boss", "us")).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (11, 12, 1), (11, 13, 2), (12, 13, 1)}
