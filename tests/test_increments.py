import pytest
from pyspark.sql import functions as F

from orrery.operators.incremental import KeyHashState, hashed_records, incremental_run, pending_changes
from orrery.runtime import fresh_path


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id int, a string, b int")


def test_only_new_and_changed_records_and_survival(spark):
    state = KeyHashState(spark, fresh_path(spark, "t"), ["id"])
    first = rows(spark, (1, "x", 1), (2, None, 1), (2, None, 1), (None, "n", 0))
    with incremental_run(state, first, ["a", "b"]) as todo:
        assert sorted(str(r["id"]) for r in todo.collect()) == ["1", "2", "None"]
    second = rows(spark, (1, "x", 1), (2, "", 1), (3, "z", 1), (None, "n", 0))
    with pytest.raises(RuntimeError), incremental_run(state, second, ["a", "b"]) as todo:
        assert sorted(r["id"] for r in todo.collect()) == [2, 3]
        raise RuntimeError("lost")
    assert state.version() == 1
    with incremental_run(state, second, ["a", "b"]) as todo:
        assert sorted(r["id"] for r in todo.collect()) == [2, 3]
    with incremental_run(state, second, ["a", "b"]) as todo:
        assert todo.count() == 0
    assert state.version() == 3


def test_two_runs_cannot_swap_the_same_version(spark):
    state = KeyHashState(spark, fresh_path(spark, "t"), ["id"])
    done = hashed_records(rows(spark, (1, "x", 1)), ["id"], ["a"])
    state.swap(done, 0)
    with pytest.raises(FileExistsError):
        state.swap(done, 0)
    assert state.version() == 1 and state.read().count() == 1


def test_claim_of_a_dead_run_is_taken_over(spark):
    path = fresh_path(spark, "t")
    state = KeyHashState(spark, path, ["id"])
    done = hashed_records(rows(spark, (1, "x", 1)), ["id"], ["a"])
    assert state._exclusive("_claim/1", "dead")
    done.write.parquet(f"{path}/v=1")  # it died after its data were in place
    with pytest.raises(FileExistsError):
        state.swap(done, 0)
    assert state.version() == 0 and state.read() is None
    assert KeyHashState(spark, path, ["id"], patience=0).swap(done, 0) == 1
    assert state.read().count() == 1


def test_a_newer_row_is_never_hidden_by_an_older_one(spark):
    """20 keys, each with a processed row and a newer one: all 20 come out, in order or not, and once."""
    keys = F.col("id").cast("int").alias("id")
    old, new = (spark.range(20).select(keys, F.concat(F.lit(v), F.col("id").cast("string")).alias("a"), F.lit(n).alias("b")) for v, n in (("x", 3), ("y", 7)))
    for order in (None, ["b"]):
        state = KeyHashState(spark, fresh_path(spark, "t"), ["id"])
        with incremental_run(state, old, ["a"], order) as todo:
            assert todo.count() == 20
        both = old.unionByName(new).unionByName(new)
        with incremental_run(state, both, ["a"], order) as todo:
            assert todo.count() == 20
        with incremental_run(state, both.repartition(3), ["a"], order) as todo:
            assert todo.count() == 0


def test_the_first_owner_of_a_claim_that_was_taken_over_fails(spark):
    path = fresh_path(spark, "t")
    slow, other = KeyHashState(spark, path, ["id"]), KeyHashState(spark, path, ["id"], patience=0)
    a, b = (hashed_records(rows(spark, (i, "x", 1)), ["id"], ["a"]) for i in (1, 2))
    paused = slow._text

    def meanwhile(name):  # another run takes the claim over before the first owner goes on
        slow._text = paused
        assert other.swap(b, 0) == 1
        return paused(name)

    slow._text = meanwhile
    with pytest.raises(FileExistsError):
        slow.swap(a, 0)
    assert slow.version() == 1 and [r["id"] for r in slow.read().collect()] == [2]
    with pytest.raises(ValueError):
        KeyHashState(spark, "s3a://bucket/state", ["id"])


def test_hash_tells_null_from_values_and_places(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "", "a"), (4, "a", "")], "id int, x string, y string")
    assert hashed_records(df, ["id"], ["x", "y"]).select("content_hash").distinct().count() == 4


def test_empty_input(spark):
    state = KeyHashState(spark, fresh_path(spark, "t"), ["id"])
    with incremental_run(state, rows(spark), ["a"]) as todo:
        assert todo.count() == 0
    assert state.read().count() == 0


CONTROL = "target_table string, source_table string, batch_id string, updated_at timestamp_ntz, batch_completed_at timestamp_ntz, batch_status string, last_processed_version bigint"


def test_pending_changes(spark):
    at = lambda h: F.lit(f"2024-01-01 {h:02d}:00:00").cast("timestamp_ntz")
    images = [("T", "`S`.a ", "b1", 1, True, " success", 10), ("t", "s.A", "b2", 2, False, "RUNNING", None), ("t", "s.a", "b2", 3, True, "FAILED", 30), ("t", "s.a", "b3", 4, True, "SUCCESS", 7), ("u", "s.a", "b9", 1, False, "RUNNING", None), (None, "s.a", "b9", 1, False, "SUCCESS", 1)]
    control = None
    for t, s, b, h, done, status, v in images:
        one = spark.range(1).select(F.lit(t).cast("string").alias("target_table"), F.lit(s).alias("source_table"), F.lit(b).alias("batch_id"), at(h).alias("updated_at"), F.when(F.lit(done), at(h)).alias("batch_completed_at"), F.lit(status).alias("batch_status"), F.lit(v).cast("bigint").alias("last_processed_version"))
        control = one if control is None else control.unionByName(one)
    changes = spark.createDataFrame([(1, "s.a", "insert", 7, "{}"), (2, " S.`a`", "insert", 8, "{}"), (2, "s.a", "insert", 8, "{}"), (3, "s.a", "insert", None, "{}"), (4, "other", "insert", 9, "{}"), (5, None, "insert", 9, "{}")], "change_id bigint, source_table string, _change_type string, _commit_version bigint, payload string")
    got = sorted(tuple(r) for r in pending_changes(control, changes, fresh_path(spark, "s")).collect())
    assert got == [("t", "s.a", 2), ("u", "s.a", 1), ("u", "s.a", 2)]
    assert pending_changes(control.limit(0), changes, fresh_path(spark, "s")).count() == 0
    assert pending_changes(control, changes.limit(0), fresh_path(spark, "s")).count() == 0


def test_changes_delivered_again_above_the_watermark_are_pending(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    control = spark.range(1).select(F.lit("t").alias("target_table"), F.lit("s").alias("source_table"), F.lit("b").alias("batch_id"), at.alias("updated_at"), at.alias("batch_completed_at"), F.lit("SUCCESS").alias("batch_status"), F.lit(10).cast("bigint").alias("last_processed_version"))
    ids = F.col("id").alias("change_id"), F.lit("s").alias("source_table"), F.lit("insert").alias("_change_type")
    old, new = (spark.range(50).select(*ids, F.lit(v).cast("bigint").alias("_commit_version"), F.col("id").cast("string").alias("payload")) for v in (7, 12))
    got = pending_changes(control, old.unionByName(new.filter("change_id < 40")), fresh_path(spark, "s")).collect()
    assert sorted(tuple(r) for r in got) == [("t", "s", i) for i in range(40)]


def test_pending_changes_are_processed_once(spark):
    """The cycle: two runs over one state give every pending change once; a later delivery comes out again, and only it."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    control = spark.range(1).select(F.lit("t").alias("target_table"), F.lit("s").alias("source_table"), F.lit("b").alias("batch_id"), at.alias("updated_at"), at.alias("batch_completed_at"), F.lit("SUCCESS").alias("batch_status"), F.lit(5).cast("bigint").alias("last_processed_version"))
    one = lambda ids, v: ids.select(F.col("id").alias("change_id"), F.lit("s").alias("source_table"), F.lit("update").alias("_change_type"), F.lit(v).cast("bigint").alias("_commit_version"), F.lit("{}").alias("payload"))
    both, path = one(spark.range(20), 3).unionByName(one(spark.range(20), 7)), fresh_path(spark, "s")
    assert pending_changes(control, both, path).count() == 20
    assert pending_changes(control, both, path).count() == 0
    later = both.unionByName(one(spark.range(4), 9)).unionByName(one(spark.range(20, 23), 4))
    assert sorted(r["change_id"] for r in pending_changes(control, later, path).collect()) == [0, 1, 2, 3, 20, 21, 22]
