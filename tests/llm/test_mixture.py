import random

import pytest
from pyspark.sql import functions as F

from orrery.llm.mixture import Target, mixture_report, pattern_sizes, plan_mixture, read_targets, select_documents, with_tokens


def taken(plan, source):
    return sum(n for (_, s), n in plan.items() if s == source)


def test_small_sources_repeat_and_fall_short():
    plan = plan_mixture({("a",): 600, ("b",): 300, ("c",): 100}, [Target("a", 0.3, 1), Target("b", 0.3, 1), Target("c", 0.4, 2)])
    assert taken(plan, "a") == pytest.approx(300)
    assert taken(plan, "b") == pytest.approx(300)
    assert taken(plan, "c") == pytest.approx(200)  # twice, though 400 are wanted


def test_shared_documents_go_where_they_are_needed():
    # the shared documents must all go to b: a has enough of its own
    plan = plan_mixture({("a",): 100, ("a", "b"): 100}, [Target("a", 0.5, 1), Target("b", 0.5, 1)], total=200)
    assert taken(plan, "a") == pytest.approx(100)
    assert taken(plan, "b") == pytest.approx(100)
    assert plan[("a", "b"), "b"] == pytest.approx(100)


def test_least_repetition_against_all_integer_plans():
    rng = random.Random(1)
    for _ in range(40):
        sizes = {("a",): rng.randint(1, 4), ("b",): rng.randint(1, 4), ("a", "b"): rng.randint(1, 4)}
        quota = {"a": rng.randint(0, 8), "b": rng.randint(0, 8)}
        cap = {"a": rng.randint(1, 3), "b": rng.randint(1, 3)}
        total = 16.0
        plan = plan_mixture(sizes, [Target(s, quota[s] / total, cap[s]) for s in "ab"], total=total)
        best = 0
        for own_a in range(min(quota["a"], sizes["a",] * cap["a"]) + 1):
            for own_b in range(min(quota["b"], sizes["b",] * cap["b"]) + 1):
                x = min(quota["a"] - own_a, sizes["a", "b"] * cap["a"])
                y = min(quota["b"] - own_b, sizes["a", "b"] * cap["b"])
                best = max(best, own_a + own_b + x + y)
        assert taken(plan, "a") + taken(plan, "b") == pytest.approx(best)
        assert all(-1e-9 <= n <= sizes[p] * cap[s] + 1e-9 for (p, s), n in plan.items())


def test_repetitions_beyond_the_quota_cost_nothing():
    sizes = {("a",): 50, ("a", "b"): 30, ("b",): 20}
    few, many = (plan_mixture(sizes, [Target("a", 0.6, r), Target("b", 0.4, r)], total=300.0) for r in (40, 10**9))
    assert few == many and taken(many, "a") == pytest.approx(180) and taken(many, "b") == pytest.approx(120)


def test_empty_and_odd():
    assert plan_mixture({}, []) == {}
    assert plan_mixture({(): 5, ("x",): 3}, [Target("a", 1.0, 2)]) == {}
    assert plan_mixture({("a",): 0}, [Target("a", 1.0, 2)]) == {}


def documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([["a"], ["a"], ["b"], ["c"], ["a", "b"], [], None]), rng.randint(0, 50)) for i in range(2000)] + [(None, ["a"], 10)]
    return spark.createDataFrame(rows, "id bigint, members array<string>, tokens bigint"), rows


@pytest.mark.parametrize("exact", [50_000, 2])
def test_selected_documents_reach_the_plan(spark, exact):
    df, rows = documents(spark)
    targets = [Target("a", 0.2, 1), Target("b", 0.5, 3), Target("c", 0.3, 1)]
    usable = df.filter("id IS NOT NULL")
    plan = plan_mixture(pattern_sizes(usable, "members"), targets)
    got = select_documents(df, "id", "members", targets, exact=exact).collect()
    tokens, members = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    assert len({(r["id"], r["source"]) for r in got}) == len(got)
    for t in targets:
        mine = [r for r in got if r["source"] == t.source]
        assert all(t.source in members[r["id"]] and 1 <= r["copies"] <= t.max_repeats for r in mine)
        n, patterns = sum(tokens[r["id"]] * r["copies"] for r in mine), len({p for p, s in plan if s == t.source})
        assert taken(plan, t.source) - 60 * patterns <= n <= taken(plan, t.source) + 1e-6
    assert select_documents(df, "id", "members", targets, exact=exact).exceptAll(select_documents(df.repartition(7), "id", "members", targets)).count() == 0
    assert select_documents(df.limit(0), "id", "members", targets).count() == 0


def test_report(spark):
    df, _ = documents(spark)
    report = {r["source"]: r for r in mixture_report(df, "members", [Target("a", 0.1, 1), Target("c", 0.8, 2), Target("none", 0.1, 9)])}
    assert report["a"]["reached"] and not report["none"]["reached"] and not report["c"]["reached"]
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)


def test_targets_and_tokens(spark, tmp_path):
    t = spark.createDataFrame([(" A ", 0.5, 2), ("a", 0.2, 9), (None, 1.0, 1), ("b", None, None)], "source string, weight double, max_repeats int")
    assert {x.source: (x.weight, x.max_repeats) for x in read_targets(t)} == {"a": (0.5, 2), "b": (0.0, 0)}
    docs = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, "x" * 300_000), (5, "<|endoftext|>")], "doc_id bigint, text string").withColumn("tokens", F.lit("clash"))
    counted = {r["doc_id"]: r["tokens"] for r in with_tokens(docs, ["doc_id"]).collect()}
    assert counted[1] == 2 and counted[2] == counted[3] == 0 and counted[4] > 1000 and counted[5] > 1
    words = {r["doc_id"]: r["tokens"] for r in with_tokens(docs, ["doc_id"], tokenizer=None).collect()}
    assert words == {1: 2, 2: 0, 3: 0, 4: 1, 5: 1}
    with pytest.raises(FileNotFoundError):
        with_tokens(docs, ["doc_id"], tokenizer=str(tmp_path / "none"))


def test_pieces_have_the_tokens_of_the_whole():
    from orrery.llm.mixture import TOKENIZER, _encoder, pieces

    rng = random.Random(3)
    encode = _encoder(TOKENIZER).encode_ordinary
    for _ in range(30):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " tail", "x1", ", ", "é", "don't", "\u3000"]) for _ in range(400))
        cut = list(pieces(text, rng.randint(1, 60)))
        assert "".join(cut) == text and sum(len(encode(p)) for p in cut) == len(encode(text))
    long = "some words of a text " * 12_000
    assert sum(len(encode(p)) for p in pieces(long)) == len(encode(long))


@pytest.mark.parametrize("exact", [50_000, 3])
def test_sources_of_one_pattern_take_different_documents(spark, exact):
    """Two sources want half each of the documents they share: every document once; at three quarters each, half of them twice."""
    df = spark.range(1000).select("id", F.array(F.lit("a"), F.lit("b")).alias("members"), F.lit(10).cast("bigint").alias("tokens"))
    once = select_documents(df, "id", "members", [Target("a", 0.25, 2), Target("b", 0.25, 2)], exact=exact).collect()
    assert len(once) == 1000 == len({r["id"] for r in once}) and {r["copies"] for r in once} == {1} and sum(r["source"] == "a" for r in once) == 500
    more = select_documents(df, "id", "members", [Target("a", 0.375, 2), Target("b", 0.375, 2)], exact=exact).collect()
    used = {}
    for r in more:
        used[r["id"]] = used.get(r["id"], 0) + r["copies"]
    assert len(used) == 1000 and sum(used.values()) == 1500 and max(used.values()) == 2


def test_report_counts_the_documents_selected(spark):
    from orrery.llm.mixture import selected_report

    long = spark.createDataFrame([(1, ["a"], 100), (2, ["a"], 100), (3, ["b"], 100), (4, ["b"], 100)], "id bigint, members array<string>, tokens bigint")
    targets = [Target("a", 0.125, 1), Target("b", 0.5, 1)]
    report = {r["source"]: r for r in selected_report(long, "id", "members", targets)}
    picked = {}
    for r in select_documents(long, "id", "members", targets).collect():
        picked[r["source"]] = picked.get(r["source"], 0) + 100 * r["copies"]
    assert {s: r["taken"] for s, r in report.items()} == {"a": 0, "b": 200} == {"a": 0} | picked
    assert {s: r["actual_share"] for s, r in report.items()} == {"a": 0.0, "b": 1.0}
    assert {s: (r["reached"], r["reachable"], r["planned"]) for s, r in report.items()} == {"a": (False, True, 50), "b": (True, True, 200)}
