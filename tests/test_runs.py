"""What a run does beside the merge: contracts, lateness, gates, unresolved keys, evidence, reloads, retries, buckets; batch and stream."""

import pytest
from pyspark.sql import functions as F

from orrery.__main__ import main
from orrery.operators import facts as fct
from orrery.operators import feed as fd
from orrery.operators.quality import QualityError
from orrery.plans.config import SourceContract, TableSpec, load_project
from orrery.plans.graph import compile_project, job
from orrery.plans.pipeline import Warehouse
from orrery.plans.retry import Retriable, attempt, retriable
from orrery.runtime import fresh_path
from orrery.streaming.feeds import run_stream

READINGS = "meter int, site string, taken timestamp, kwh double, note string"


@pytest.fixture
def warehouse(spark):
    return Warehouse(spark, fresh_path(spark, "wh"), wait=0.0)


def land(warehouse, name, rows, schema):
    df = warehouse.spark.createDataFrame([tuple(r) for r in rows], schema.replace("timestamp", "string"))
    df = df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    table = warehouse.table(name)
    if not table.exists():
        table.create(df.schema)
    return table.commit(df, append=True)


def readings(**more):
    contract = more.pop("contract", {"columns": {"meter": "int", "taken": "timestamp", "kwh": "double"}, "rules": [{"name": "given", "kind": "not_null", "column": "site"}, {"name": "sane", "kind": "expression", "sql": "kwh < 1000", "severity": "warn"}], "temporal": {"keys": ["meter"], "event_at": "taken", "lateness": "9999 days"}})
    source = {"name": "readings", "cdc_strategy": "cdf", "primary_keys": ["meter"], "streaming": True, "contract": contract}
    return TableSpec(**({"table_name": "dim_meter", "table_type": "dimension", "surrogate_key": "sk", "natural_keys": ["meter"], "sources": [source], "buckets": 4} | more))


def events(warehouse):
    return {(r["rule"], r["ok"]) for r in warehouse.table("etl_quality_events").snapshot().collect()}


@pytest.mark.parametrize("run", ["batch", "stream"])
def test_contracts_and_lateness(warehouse, run):
    def go():
        if run == "batch":
            return warehouse.run(readings()).warnings
        summary = run_stream(warehouse, readings())
        if summary.errors:
            raise QualityError(summary.errors[0])
        return summary.warnings

    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None), (2, "b", "2024-05-02 00:00:00", 5000.0, None)], READINGS)
    assert go() == ["contract.readings.sane"]
    assert {("contract.readings.schema", True), ("contract.readings.given", True), ("contract.readings.sane", False), ("contract.readings.late", True), ("contract.readings.cross_batch", True)} <= events(warehouse)
    state = warehouse.table("etl_temporal_state__dim_meter__readings").snapshot()
    assert {r["meter"]: str(r["max_event"]) for r in state.collect()} == {1: "2024-05-02 00:00:00", 2: "2024-05-02 00:00:00"}
    land(warehouse, "readings", [(1, "a", "2024-04-01 00:00:00", 6.0, None), (3, "c", "2024-05-01 00:00:00", 6.0, None)], READINGS)
    assert go() == ["contract.readings.cross_batch"]
    assert {r["meter"]: str(r["max_event"])[:10] for r in warehouse.table("etl_temporal_state__dim_meter__readings").snapshot().collect()} == {1: "2024-05-02", 2: "2024-05-02", 3: "2024-05-01"}
    land(warehouse, "readings", [(4, None, "2024-05-03 00:00:00", 6.0, None)], READINGS)
    before = warehouse.table("dim_meter").latest()
    with pytest.raises(QualityError, match="given"):
        go()
    assert warehouse.table("dim_meter").latest() == before and ("contract.readings.given", False) in events(warehouse)
    assert warehouse.control.watermark("dim_meter", "readings") == 2


def test_schema_contract_and_monitor(warehouse):
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    spec = readings(contract={"columns": {"meter": "bigint", "gone": "string"}})
    found = warehouse.monitor([spec, readings()])
    assert found["dim_meter"] == [] or "TYPE_CHANGED meter" in found["dim_meter"][0]
    assert "MISSING_COLUMN gone" in warehouse.monitor([spec])["dim_meter"][0]
    with pytest.raises(QualityError, match="schema"):
        warehouse.run(spec)
    for bad in ({}, {"temporal": {"keys": ["k"], "event_at": "t", "lateness": "soon"}}, {"rules": [{"name": "r", "kind": "relationships"}]}):
        with pytest.raises(ValueError):
            SourceContract(**bad)


SALES = "sale int, meter int, at timestamp, amount double"


def sales(**fk):
    keys = {"column": "meter_sk", "references": "dim_meter", "lookup": {"meter": "meter"}, "dimension_key": "sk"} | fk
    return TableSpec(table_name="fact_sales", table_type="fact", merge_keys=["sale"], sources=[{"name": "sales", "cdc_strategy": "cdf", "primary_keys": ["sale"]}], foreign_keys=[keys], buckets=4)


def test_unresolved_keys_are_kept_and_closed(warehouse):
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    land(warehouse, "sales", [(10, 1, "2024-05-03 00:00:00", 1.0), (11, 7, "2024-05-03 00:00:00", 1.0), (12, None, "2024-05-03 00:00:00", 1.0)], SALES)
    warehouse.run(readings()), warehouse.run(sales())
    registry = lambda: {r["grain_json"]: (r["member"], r["status"]) for r in warehouse.table("etl_unresolved_keys").snapshot().collect()}
    assert registry() == {'{"sale":11}': (-3, "OPEN")}
    land(warehouse, "readings", [(7, "b", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    land(warehouse, "sales", [(11, 7, "2024-05-03 00:00:00", 2.0)], SALES)
    warehouse.run(readings()), warehouse.run(sales())
    assert registry() == {'{"sale":11}': (-3, "RESOLVED")}
    land(warehouse, "sales", [(13, 99, "2024-05-03 00:00:00", 2.0)], SALES)
    with pytest.raises(QualityError, match="1 identities, of which 0"):
        warehouse.run(sales(validate_resolution=True))
    assert [o.rule for o in warehouse.validate(sales()) if not o.ok] == [] and {o.rule for o in warehouse.validate(readings(), approximate=True)} == {"derived.sk.unique"}


def test_one_grain_with_a_resolved_and_an_unresolved_fact(spark):
    facts = spark.createDataFrame([(1, 5), (1, -3), (2, 5)], "g int, k bigint")
    for rows in (facts, facts.orderBy(F.desc("k"))):
        assert [r["member"] for r in fct.unresolved_registry(None, rows, fact="f", relationship="r", grain=["g"], key="k", batch="b").collect()] == [-3]


def test_gates(warehouse):
    warehouse.table("flat").create(warehouse.spark.createDataFrame([], "id int, v string").schema).commit(warehouse.spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), append=True)
    twice = TableSpec(table_name="d", table_type="dimension", surrogate_key="sk", natural_keys=["id"], sources=[{"name": "flat"}])
    with pytest.raises(QualityError, match='several rows for one id, such as {"id":1}'):
        warehouse.run(twice)
    assert warehouse.run(twice.model_copy(update={"grain_check": "warn"})).warnings == ["grain"]
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    warehouse.run(readings())
    land(warehouse, "sales", [(10, 12345, "2024-05-03 00:00:00", 1.0)], SALES)
    with pytest.raises(QualityError, match="keys that dim_meter lacks, such as 12345"):
        warehouse.run(sales(column="meter", lookup={}))


def test_early_facts_of_a_known_member(warehouse):
    """A member valid from May, facts of March, April and June: one skeleton until May, no two versions at one time."""
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    versions = readings(scd_type=2, effective_at="taken", track_history_columns=["site"])
    land(warehouse, "sales", [(10, 1, "2024-04-03 00:00:00", 1.0), (11, 1, "2024-03-03 00:00:00", 1.0), (12, 1, "2024-06-03 00:00:00", 1.0), (13, 1, "2024-06-04 00:00:00", 1.0)], SALES)
    warehouse.run(versions)
    warehouse.run(sales(event_at="at", early_arriving="skeleton"))
    rows = warehouse.table("dim_meter").snapshot().filter("meter = 1").orderBy("__valid_from").collect()
    assert [(str(r["__valid_from"])[:10], str(r["__valid_to"])[:10], r["__is_current"], r["__is_skeleton"]) for r in rows] == [("2024-03-03", "2024-05-02", False, True), ("2024-05-02", "9999-12-31", True, False)]
    facts = {r["sale"]: r["meter_sk"] for r in warehouse.table("fact_sales").snapshot().collect()}
    assert facts == {10: rows[0]["sk"], 11: rows[0]["sk"], 12: rows[1]["sk"], 13: rows[1]["sk"]}


def test_only_touched_buckets_and_reload(warehouse):
    land(warehouse, "readings", [(i, "a", "2024-05-02 00:00:00", 5.0, None) for i in range(40)], READINGS)
    spec = readings(scd_type=2, effective_at="taken", track_history_columns=["kwh"], preserve_all_changes=True)
    warehouse.run(spec)
    before = warehouse.table("dim_meter").entry().buckets
    land(warehouse, "readings", [(3, "a", "2024-05-09 00:00:00", 6.0, None)], READINGS)
    warehouse.run(spec)
    after = warehouse.table("dim_meter").entry().buckets
    assert len(before) == 4 and sum(before[k] != after[k] for k in after) == 1
    assert warehouse.table("dim_meter").snapshot().filter("meter >= 0").count() == 41
    feed = warehouse.table("dim_meter").changes(warehouse.table("dim_meter").latest()).collect()
    assert sorted(r["_change_type"] for r in feed) == ["insert", "update_postimage", "update_preimage"]
    broken = spec.model_copy(update={"tests": [type(readings(tests=[{"name": "no", "kind": "expression", "sql": "kwh < 0"}]).tests[0])(name="no", kind="expression", sql="kwh < 0")]})
    with pytest.raises(QualityError):
        warehouse.run(broken, full_reload=True)
    assert warehouse.table("dim_meter").snapshot().filter("meter >= 0").count() == 41 and not warehouse.table("dim_meter__reload").exists()
    warehouse.run(spec, full_reload=True)
    assert warehouse.table("dim_meter").snapshot().filter("meter >= 0").count() == 41 and warehouse.control.watermark("dim_meter", "readings") == 2


def test_metadata_that_the_sql_lost_is_taken_again(spark, warehouse):
    feed = spark.createDataFrame([(1, None, "insert", 1), (2, "b", "delete", 2), (2, "b", "insert", 1)], "id int, v string, _change_type string, _commit_version bigint")
    got = {r["id"]: (r["_change_type"], r["_commit_version"]) for r in fd.reattach({"s": feed}, feed.select("id", "v", F.lit(1).alias("more")).distinct()).collect()}
    assert got == {1: ("insert", 1), 2: ("delete", 2)}
    assert fd.reattach({"s": feed, "t": feed}, feed.select("id")) is None and fd.reattach({"s": feed}, feed.select(F.lit(1).alias("n"))) is None
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    result = warehouse.run(readings(transformation_sql="SELECT meter, site FROM readings"))
    assert result.warnings == ["the transformation lost _change_type: it was taken from the source again"]
    assert warehouse.dry_run(readings(transformation_sql="SELECT meter, site FROM readings")) == ["meter", "site"]
    with pytest.raises(ValueError, match="nothing_like_it"):
        warehouse.dry_run(readings(transformation_sql="SELECT nothing_like_it FROM readings"))


def test_masks_for_readers_samples_and_old_versions(warehouse):
    land(warehouse, "readings", [(i, "north", "2024-05-02 00:00:00", 5.0, None) for i in range(60)], READINGS)
    contract = {"rules": [{"name": "none", "kind": "expression", "sql": "kwh > 9", "severity": "warn"}, {"name": "once", "kind": "unique", "columns": ["meter"]}], "sample": 0.5}
    spec = readings(contract=contract, read_masks=[{"column": "site", "method": "mask", "prefix": 1}], retain_versions=2)
    warehouse.run(spec)
    failed = {r["rule"]: r["failed"] for r in warehouse.table("etl_quality_events").snapshot().collect()}
    assert 0 < failed["contract.readings.none"] < 60 and failed["contract.readings.once"] == 0
    assert {r["site"] for r in warehouse.read(spec, view=True).filter("meter >= 0").collect()} == {"n**********"}
    assert warehouse.spark.table("dim_meter").count() == 64 and warehouse.table("dim_meter").snapshot().filter("site = 'north'").count() == 60
    warehouse.spark.catalog.dropTempView("dim_meter")
    with pytest.raises(ValueError, match="need 2 actions"):
        warehouse.run(readings(table_name="other", contract=contract | {"max_actions": 1}))
    for n in range(3):
        land(warehouse, "readings", [(n, f"s{n}", "2024-05-02 00:00:00", 5.0, None)], READINGS)
        warehouse.run(spec)
    target = warehouse.table("dim_meter")
    assert len(target.versions()) == 2 and target.snapshot().count() == 64
    # the source's feed is kept as far as its slowest reader is behind
    warehouse.vacuum("readings", 1, older=0)
    assert len(warehouse.table("readings").versions()) == 5  # the run that failed has read nothing yet
    warehouse.control.reset("other")
    warehouse.control.complete("slow", {"readings": 1})
    warehouse.vacuum("readings", 1, older=0)
    assert warehouse.table("readings").versions() == [2, 3, 4] and warehouse.table("readings").changes(2).count() == 3 and warehouse.table("readings").snapshot().count() == 63
    # a definition with another number of buckets deals the table anew
    land(warehouse, "readings", [(1, "zz", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    warehouse.run(spec.model_copy(update={"buckets": 2}))
    assert target.bucketing() == (["meter"], 2) and target.snapshot().filter("site = 'zz'").count() == 1 and target.snapshot().count() == 64


def test_retries():
    waits, tries = [], []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise Retriable("later")
        return "done"

    assert attempt(work, 3, 30.0, waits.append) == "done" and waits == [30.0, 60.0]
    with pytest.raises(ValueError):
        attempt(lambda: (_ for _ in ()).throw(ValueError("wrong")), 3, 30.0, waits.append)
    assert len(waits) == 2 and retriable(RuntimeError("java.net.SocketTimeoutException")) and not retriable(QualityError("rule"))


def test_project_goes_on_where_it_stopped(warehouse):
    land(warehouse, "readings", [(1, "a", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    land(warehouse, "sales", [(10, 9, "2024-05-03 00:00:00", 1.0)], SALES)
    project = compile_project([readings(), sales(early_arriving="error")])
    assert [r.status for r in warehouse.run_project(project, pipeline="p")] == ["SUCCESS", "FAILED"]
    land(warehouse, "readings", [(9, "b", "2024-05-02 00:00:00", 5.0, None)], READINGS)
    resumed = warehouse.run_project(project, pipeline="p")
    assert resumed[0].metrics == {"skipped": True} and resumed[1].status == "FAILED"
    warehouse.run(readings())
    assert [r.status for r in warehouse.run_project(project, pipeline="p")] == ["SUCCESS", "SUCCESS"]


def test_command_line_targets_and_job(tmp_path, capsys):
    (tmp_path / "targets.yml").write_text("dev: {src: silver}\n")
    (tmp_path / "d.yml").write_text("table_name: d\ntable_type: dimension\nsurrogate_key: sk\nnatural_keys: [id]\nsources: [{name: \"{{ src | lower }}.{{ t | default('x') }}\"}]\n")
    assert load_project(tmp_path, target="dev")[0].sources[0].name == "silver.x" and load_project(tmp_path, {"src": "A"}, "dev")[0].sources[0].name == "a.x"
    assert main(["validate", str(tmp_path)]) == 1 and main(["validate", str(tmp_path / "none")]) == 1 and main(["validate", str(tmp_path), "--target", "prod"]) == 1
    capsys.readouterr()
    assert main(["job", str(tmp_path), "--target", "dev", "--warehouse", "/wh dir"]) == 0
    assert f"run {tmp_path} --warehouse '/wh dir' --table d" in capsys.readouterr().out
    assert job(compile_project(load_project(tmp_path, target="dev")), "j")["tasks"][0]["command"] == "python -m orrery run d"
    with pytest.raises(SystemExit):
        main(["run", str(tmp_path), "--target", "dev"])
    (tmp_path / "c.yaml").write_text("kind: DataContract\nid: c\nversion: 1.0.0\nschema: [{name: o, properties: [{name: a}]}]\n")
    assert main(["contract", "validate", str(tmp_path / "c.yaml")]) == 0 and main(["contract", "validate", str(tmp_path / "d.yml")]) == 1


def test_semi_additive_by_member(spark):
    df = spark.createDataFrame([("a", "x", 1, 10), ("a", "x", 2, 20), ("a", "y", 1, 5)], "k string, account string, month int, balance int")
    how = {"balance": ("sum", "semi_additive")}
    assert fct.roll_up(df, ["k"], how, "month").first()["balance"] == 20 and fct.roll_up(df, ["k"], how, "month", members=["account"]).first()["balance"] == 25
