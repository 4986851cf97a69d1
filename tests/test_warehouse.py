"""Feeds, dimensions, fact keys and quality on small tables; invariants of histories on random ones."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import dimensions as dim
from orrery.operators import facts as fct
from orrery.operators import feed as fd
from orrery.operators import quality as dq
from orrery.runtime import cut

TS = "timestamp_ntz"


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast(TS)


# ---------------------------------------------------------------- feeds


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, v string, _change_type string, _commit_version bigint")


def test_ties_within_a_commit(spark):
    rows = feed(spark, (1, "a", "update_postimage", 5), (1, "b", "delete", 5), (1, "c", "insert", 4), (None, "n", "insert", 1))
    assert {r["id"]: r["_change_type"] for r in fd.dedup_delete_wins(rows, ["id"]).collect()} == {1: "delete", None: "insert"}
    assert {r["id"]: r["v"] for r in fd.dedup_upsert_wins(rows, ["id"]).collect()} == {1: "a", None: "n"}
    with pytest.raises(ValueError):
        fd.dedup_upsert_wins(rows.select("id"), ["id"])
    assert fd.dedup_delete_wins(rows.limit(0), ["id"]).count() == 0


def test_diff_of_snapshots_rebuilds_the_new_one(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    rows = fd.changes_from_snapshots(old, new, ["id"], 7).collect()
    assert len(rows) == 4 and {(r["id"], r["v"], r["_change_type"]) for r in rows} == {(2, None, "update_preimage"), (2, "b", "update_postimage"), (3, "c", "insert"), (None, "x", "delete")}


@pytest.mark.parametrize("sql", ["", "UPDATE a SET x = 1", "SELECT 1", "SELECT * FROM a; DROP TABLE a", "WITH x AS (SELECT 1) DELETE FROM a"])
def test_sql_that_is_refused(sql):
    with pytest.raises(ValueError):
        fd.check_sql(sql, ["a"])


def test_sql_that_is_not(spark):
    fd.check_sql("SELECT 'drop it' AS note, update_time FROM a -- delete", ["a"])
    df = spark.createDataFrame([(1, "x")], "id int, _change_type string")
    assert fd.user_sql(spark, {"a": df}, None) is df
    with pytest.raises(ValueError):
        fd.user_sql(spark, {"a": df, "b": df}, None)
    assert fd.lost_change_type({"a": df}, df.select("id")) and not fd.lost_change_type({"a": df}, df)


def test_masking(spark):
    df = spark.createDataFrame([("ann@x",), (None,), ("",)], "email string").select("email", F.col("email").alias("t"), F.col("email").alias("m"), F.col("email").alias("h"))
    rules = {"t": {"method": "tokenize", "secret": "k"}, "m": {"method": "mask", "prefix": 2, "char": "#"}, "h": {"method": "hash"}, "none": {"method": "null"}}
    rows = {r["email"]: r for r in fd.mask_columns(df, rules).collect()}
    assert rows["ann@x"]["t"] == hmac.new(b"k", b"ann@x", hashlib.sha256).hexdigest() and rows[None]["t"] is None
    assert rows["ann@x"]["m"] == "an##########" and rows[None]["m"] is None and rows[""]["m"] == "##########"
    assert isinstance(rows["ann@x"]["h"], int)
    with pytest.raises(ValueError):
        fd.mask_columns(df, {"t": {"method": "guess"}})


def test_null_policy(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None)], "id int, s string, n int, b boolean, d date, _x string").withColumn("t", F.lit(None).cast(TS))
    row = fd.null_policy(df, ["id"], {"n": 9}).first()
    assert (row["s"], row["n"], row["b"], str(row["d"]), row["_x"], str(row["t"])) == ("Missing", 9, False, "1900-01-01", None, "1900-01-01 00:00:00")
    assert fd.null_policy(df, ["id"], policy="legacy").first()["s"] is None
    with pytest.raises(ValueError):
        fd.null_policy(df.withColumn("a", F.array(F.lit(1))), ["id"])
    assert fd.null_identities(df.withColumn("id", F.lit(None).cast("int")), ["id"]).count() == 1


# ---------------------------------------------------------------- dimensions


def test_overwrite_with_null_keys_and_returning_rows(spark):
    target = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b")], "id int, v string")
    source = feed(spark, (None, "m", "insert", 1), (1, "a", "update_postimage", 1), (2, None, "delete", 1), (3, None, "delete", 1))
    merged = dim.overwrite_merge(target, source, ["id"], deletes="soft")
    assert {r["id"]: (r["v"], r["__is_deleted"], r["__action"]) for r in merged.collect()} == {None: ("m", False, "update"), 1: ("a", False, "keep"), 2: ("b", True, "delete")}
    back = dim.overwrite_merge(dim.applied(merged, "soft"), feed(spark, (2, "b", "insert", 2)), ["id"], deletes="soft")
    assert {r["id"]: r["__action"] for r in back.collect()} == {None: "keep", 1: "keep", 2: "update"}
    assert dim.overwrite_merge(target.limit(0), source.limit(0), ["id"]).count() == 0
    wider = dim.overwrite_merge(target, spark.createDataFrame([(1, "a", 5)], "id int, v string, w int"), ["id"], schema_evolution=True)
    assert {r["id"]: r["w"] for r in wider.collect()} == {None: None, 1: 5, 2: None}
    with pytest.raises(ValueError):
        dim.overwrite_merge(target, source, ["id"], deletes="perhaps")


def versions_of(spark, rows):
    df = spark.createDataFrame(rows, "k int, v string, day int, _change_type string, _commit_version bigint")
    return df.withColumn("eff", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast(TS)).drop("day")


def merge(target, source, **more):
    target = dim.empty_versions(source, ["k"], ["v"], "eff") if target is None else target
    return cut(dim.versioned_merge(target, source, ["k"], at="eff", tracked=["v"], **more))


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select("sk", "k", "v", "__valid_from", "__valid_to", "__is_current", "__is_deleted").collect())


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {}), (3, {"share": 0.2, "least": 5})])
def test_versions_all_at_once_or_one_after_the_other(spark, seed, limits):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice("ab"), d, rng.choice(["insert", "update_postimage", "update_postimage", "delete"]), d) for d in range(40)]
    whole = merge(None, versions_of(spark, rows), **limits)
    parts = None
    for a, b in ((0, 15), (15, 30), (30, 40)):
        parts = merge(parts, versions_of(spark, rows[a:b]), **limits)
    assert shown(parts) == shown(whole)
    assert shown(merge(whole, versions_of(spark, rows), **limits)) == shown(whole)
    per_key = {}
    for r in whole.collect():
        per_key.setdefault(r["k"], []).append(r)
    for rs in per_key.values():
        rs.sort(key=lambda r: r["__valid_from"])
        assert sum(r["__is_current"] for r in rs) <= 1
        assert all(a["__valid_to"] <= b["__valid_from"] for a, b in zip(rs, rs[1:], strict=False)) and all(r["__valid_from"] < r["__valid_to"] for r in rs)
        assert len({r["sk"] for r in rs}) == len(rs)


def test_three_versions_in_a_batch_and_point_in_time(spark):
    seed = merge(None, versions_of(spark, [(1, "old", -100, "insert", 1)]))
    after = merge(seed, versions_of(spark, [(1, "a", 10, "update_postimage", 2), (1, "b", 20, "update_postimage", 3), (1, "c", 25, "update_postimage", 4)]))
    pit = lambda d: after.filter((F.col("__valid_from") <= at(d)) & (at(d) < F.col("__valid_to"))).first()["v"]
    assert after.count() == 4 and (pit(5), pit(15), pit(22), pit(28)) == ("old", "a", "b", "c")


def test_skeleton_keeps_its_key(spark):
    empty = dim.empty_versions(versions_of(spark, [(1, "x", 1, "insert", 1)]), ["k"], ["v"], "eff")
    facts = spark.range(1).select(F.lit(7).alias("fk"), at(5).alias("when"))
    made = fct.skeletons(fct.missing_members(facts, empty, {"fk": "k"}, "when"), empty, ["k"], "sk")
    before = made.first()
    assert before["v"] == "Not Yet Available" and before["__is_skeleton"]
    after = merge(made, versions_of(spark, [(7, "real", 9, "insert", 1), (7, "later", 12, "update_postimage", 2)])).orderBy("__valid_from").collect()
    assert [(r["v"], r["__is_skeleton"]) for r in after] == [("real", False), ("later", False)] and after[0]["sk"] == before["sk"] and after[0]["__valid_from"] == before["__valid_from"]
    earlier = merge(made, versions_of(spark, [(7, "first", 1, "insert", 1)])).orderBy("__valid_from").collect()
    assert [(r["v"], r["sk"] == before["sk"]) for r in earlier] == [("first", False), ("first", True)]


def test_snapshot_deletes_and_delete_of_nothing(spark):
    now = merge(None, versions_of(spark, [(1, "a", 1, "insert", 1), (2, "b", 1, "insert", 1)]))
    only = versions_of(spark, [(1, "a", 3, "insert", 2)]).drop("_change_type")
    after = {r["k"]: r for r in merge(now, only, full_snapshot=True, as_of=at(9)).collect()}
    assert after[1]["__is_current"] and not after[2]["__is_current"] and after[2]["__is_deleted"] and str(after[2]["__valid_to"]) == "2024-01-09 00:00:00"
    assert merge(now, versions_of(spark, [(5, None, 2, "delete", 2)])).count() == 2
    assert shown(merge(now, versions_of(spark, []))) == shown(now)


def test_collisions_and_members(spark):
    rows = spark.createDataFrame([(1, "x", False), (1, "y", False), (-2, "z", True), (-2, "z", False), (-3, "m", False), (4, "q", True)], "sk bigint, fp string, new boolean")
    assert {(r["key"], r["reserved"]) for r in dim.key_collisions(rows, "sk", "fp", "new").collect()} == {(1, False), (-2, True)}
    empty = merge(None, versions_of(spark, []))
    members = dim.default_members(spark, empty.schema, "sk", {"v": "?"}).collect()
    assert sorted(r["sk"] for r in members) == [-4, -3, -2, -1] and {r["v"] for r in members} == {"?"} and all(r["__is_current"] for r in members)
    assert dim.seeded(dim.seeded(empty, "sk"), "sk").count() == 4


def test_junk(spark):
    facts = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string")
    combos, keyed = dim.junk_dimension(facts, ["x", "y"], "j")
    assert combos.count() == 3 and keyed.select("j").distinct().count() == 3
    again, _ = dim.junk_dimension(facts, ["x", "y"], "j", existing=combos)
    assert again.count() == 3 and dim.junk_collisions(combos, keyed, ["x", "y"], "j").count() == 0
    forged = combos.withColumn("x", F.lit("other"))
    assert dim.junk_collisions(forged, keyed, ["x", "y"], "j").count() == 3


# ---------------------------------------------------------------- fact keys


def star(spark):
    d = merge(None, versions_of(spark, [(1, "Old A", -9000, "insert", 1), (1, "Current A", 0, "update_postimage", 2)]).withColumn("k", F.lit("A")))
    facts = spark.createDataFrame([(1, "A", -200, False), (2, "A", 100, False), (3, None, 100, False), (4, "N/A", 100, True), (5, "Z", 100, False), (6, "", 100, False)], "order_id int, customer string, day int, na boolean")
    return dim.with_dual_keys(d, ["k"]), facts.withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast(TS))


def resolved(spark, d, facts):
    return fct.resolve_keys(facts, d, {"customer": "k"}, {"sk": "row_key", "dk": "durable_key"}, event_at="at", not_applicable=F.col("na"))


def test_six_row_matrix_and_evidence(spark):
    d, facts = star(spark)
    keys = {r["v"]: (r["row_key"], r["durable_key"]) for r in d.collect()}
    rows = resolved(spark, d, facts)
    got = {r["order_id"]: (r["sk"], r["dk"]) for r in rows.collect()}
    assert got == {1: keys["Old A"], 2: keys["Current A"], 3: (-1, -1), 4: (-2, -2), 5: (-3, -3), 6: (-4, -4)} and keys["Old A"][1] == keys["Current A"][1]
    evidence = fct.unresolved_registry(None, rows, fact="f", relationship="c", grain=["order_id"], key="sk", batch="b1")
    assert sorted((r["member"], r["status"]) for r in evidence.collect()) == [(-4, "OPEN"), (-3, "OPEN")]
    arrived = rows.withColumns({"sk": F.when(F.col("order_id") == 5, 77).otherwise(F.col("sk"))})
    after = fct.unresolved_registry(evidence, arrived, fact="f", relationship="c", grain=["order_id"], key="sk", batch="b2")
    assert {r["grain_json"]: (r["status"], r["opened_batch"], r["closed_batch"]) for r in after.collect()} == {'{"order_id":5}': ("RESOLVED", "b1", "b2"), '{"order_id":6}': ("OPEN", "b1", None)}
    stats = fct.resolution_stats(rows, "sk").first()
    assert (stats["total"], stats["resolved"]) == (6, 2)
    with pytest.raises(fct.UnresolvedKeys):
        fct.enforce(rows, "sk", early_arriving="error")
    with pytest.raises(fct.UnresolvedKeys):
        fct.enforce(rows, "sk", invalid_action="error")
    assert fct.enforce(rows, "sk") is rows
    assert fct.resolution_stats(rows.limit(0), "sk").first()["rate"] == 1.0


def test_fanout_is_judged_by_the_whole_condition(spark):
    d, facts = star(spark)
    assert fct.fanout(facts, d, {"customer": "k"}, ["order_id"], "at").count() == 0
    assert fct.fanout(facts, d, {"customer": "k"}, ["order_id"]).count() == 2


def test_identity_maps(spark):
    m = spark.createDataFrame([("s1", "c", 1, 9), ("s1", "c", 5, 12), ("s2", "s1", 1, 2), ("s3", "c", 4, 4), (None, "c", 1, 2)], "source_identity string, canonical_identity string, valid_from int, valid_to int")
    assert sorted((str(r["source_identity"]), r["problem"]) for r in fct.identity_overlaps(m).collect()) == [("None", "null"), ("s1", "overlap"), ("s2", "chain"), ("s3", "empty")]
    facts = spark.createDataFrame([("s2", 1), ("s2", 2), ("q", 1), (None, 1)], "id string, t int")
    assert sorted(map(str, (r["id"] for r in fct.canonical_ids(facts, m, "id", "t").collect()))) == ["None", "q", "s1", "s2"]


def test_roll_up(spark):
    df = spark.createDataFrame([("a", 1, 10, 1), ("a", 2, 20, 1), ("b", 1, 5, 2)], "k string, month int, balance int, n int")
    got = {r["k"]: (r["balance"], r["n"]) for r in fct.roll_up(df, ["k"], {"balance": ("sum", "semi_additive"), "n": ("sum", "additive")}, "month").collect()}
    assert got == {"a": (20, 2), "b": (5, 2)}
    for bad in ({"n": ("sum", "non_additive")}, {"n": ("sum", "semi_additive")}):
        with pytest.raises(ValueError):
            fct.roll_up(df, ["k"], bad)
    assert {r["k"]: r["n"] for r in fct.roll_up(df, ["k"], {"n": ("max", "non_additive")}).collect()} == {"a": 1, "b": 2}


# ---------------------------------------------------------------- quality


def test_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z")], "id int, v string")
    rules = [dq.Rule("nn", "not_null", "id"), dq.Rule("rate", "null_rate", "v", limit=0.3), dq.Rule("acc", "accepted_values", "v", values=["a"], severity="warn"), dq.Rule("ex", "expression", sql="id > 0"), dq.Rule("u", "unique", columns=["id"], severity="warn")]
    got = {o.rule: (o.ok, o.failed) for o in dq.run_rules(df, rules)}
    assert got == {"nn": (False, 1), "rate": (True, 1), "acc": (False, 1), "ex": (True, 0), "u": (False, 1)}
    with pytest.raises(dq.QualityError, match="nn"):
        dq.report(dq.run_rules(df, rules))
    assert dq.report(dq.run_rules(df, rules[1:])) == {"error": [], "warn": ["acc", "u"]}
    assert [r.name for r in dq.plan_actions(rules, 1)] == ["nn", "rate", "acc", "ex"] and len(dq.plan_actions(rules, 2)) == 5 and dq.plan_actions(rules, 0) == []
    row = dq.unique_rule(df, ["id"]).first()
    assert row["failed"] == 1 and row["samples"] == ['{"id":1}']
    assert dq.unique_rule(df.limit(0), ["id"]).first()["failed"] == 0
    for bad in ("DROP TABLE x", "1=1; SELECT 1"):
        with pytest.raises(ValueError):
            dq.expression(df, bad)
    assert dq.expression(df, "v <> 'delete me'").count() == 0
    assert dq.approximately_unique(df.limit(0), ["id"]).first()["ok"]
    assert dq.relationships(df, "id", spark.createDataFrame([(1, True), (2, False)], "k int, __is_current boolean"), "k").count() == 1
    assert dq.orphan_keys(spark.createDataFrame([(-1,), (5,), (None,)], "k bigint"), "k", df.select(F.col("id").cast("bigint").alias("id")), "id").count() == 1


def test_disorder_within_and_across_batches(spark):
    df = spark.createDataFrame([(7, 12, 10), (7, 11, 11)], "k int, h int, v bigint").withColumn("t", F.make_timestamp_ntz(F.lit(2030), F.lit(1), F.lit(1), F.col("h"), F.lit(0), F.lit(0)))
    now = F.lit("2030-01-02").cast(TS)
    one = dq.temporal_findings(df, ["k"], "t", "v", now=now, lateness="1 HOUR").first()
    assert (one["late"], one["disorder"], one["cross_batch"]) == (2, 1, 0)
    state = dq.latest_per_key(df.filter("v = 10"), ["k"], "t", "v")
    assert dq.temporal_findings(df.filter("v = 11"), ["k"], "t", "v", now=now, lateness="1 HOUR", state=state).first()["cross_batch"] == 1
    again = dq.merged_state(state, dq.latest_per_key(df.filter("v = 11"), ["k"], "t", "v"), ["k"]).first()
    assert (again["max_event"].hour, again["max_version"]) == (12, 11)


def test_interval_stream(spark, tmp_path):
    from orrery.streaming.intervals import stream_periods

    path = str(tmp_path / "in")
    for rows in ([(1, 0, 5), (1, 10, 12), (2, 1, 1)], [(1, 6, 8), (1, None, 3), (None, 1, 2)]):
        spark.createDataFrame(rows, "k bigint, a bigint, b bigint").coalesce(1).write.mode("append").parquet(path)
        stream = stream_periods(spark.readStream.schema("k bigint, a bigint, b bigint").parquet(path), "k", "a", "b")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        query.awaitTermination()
    out = [(r["key"], r["periods"], r["gaps"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert (1, ["0-8", "10-12"], ["9-9"]) in out and (2, ["1-1"], []) in out and (1, ["0-5", "10-12"], ["6-9"]) in out


def test_rules_beyond_the_budget_of_actions_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    rules = [dq.Rule("nn", "not_null", "id"), dq.Rule("u", "unique", columns=["id"]), dq.Rule("w", "unique", columns=["v"])]
    for few in (0, 1, 2):
        with pytest.raises(ValueError, match="need 3 actions"):
            dq.run_rules(df, rules, max_actions=few)
    assert [(o.rule, o.ok) for o in dq.run_rules(df, rules, max_actions=3)] == [("nn", True), ("u", False), ("w", True)]
    assert dq.run_rules(df, [], max_actions=0) == []


def test_initial_load_and_noop_of_the_whole_feed(spark, tmp_path):
    from orrery.queries.warehouse import scd1_initial_whole, scd1_noop_whole

    rows = [(1, "open", "2024-01-01", "insert", 1), (1, "paid", "2024-09-01", "update_postimage", 3), (2, "open", "2024-09-01", "insert", 3), (3, "open", "2024-01-01", "insert", 1), (3, "open", "2024-09-02", "delete", 4)]
    feed = spark.createDataFrame(rows, "order_id int, status string, updated_at string, _change_type string, _commit_version bigint")
    feed.withColumn("_commit_timestamp", F.col("updated_at").cast("timestamp_ntz")).write.parquet(str(tmp_path / "order_feed.parquet"))
    assert sorted(tuple(r) for r in scd1_initial_whole(spark, str(tmp_path)).collect()) == [(1, "paid", "insert"), (2, "open", "insert")]
    assert [tuple(r) for r in scd1_noop_whole(spark, str(tmp_path)).collect()] == [("keep", 2)]
