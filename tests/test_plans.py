import pytest
import yaml

from orrery.__main__ import main
from orrery.plans.config import TableSpec, load_table, render, seconds
from orrery.plans.contracts import Registry, compare, gate, load_contract, version_problem
from orrery.plans.graph import bus_matrix, compile_project, conformance_warnings, job, manifest, manifest_diff
from orrery.runtime import fresh_path


def spec(name, kind="dimension", **more):
    base = {"table_name": name, "table_type": kind, "sources": [{"name": f"s_{name}"}]}
    base |= {"surrogate_key": "sk", "natural_keys": ["id"]} if kind == "dimension" else {"merge_keys": ["id"]}
    return TableSpec(**(base | more))


def fk(to, column="k", **more):
    return {"column": column, "references": to, "lookup": {"id": "id"}, "dimension_key": "sk"} | more


@pytest.mark.parametrize(
    "bad",
    [
        {"natural_keys": []}, {"surrogate_key": None}, {"scd_type": 2}, {"scd_type": 4}, {"unknown": 1}, {"scd_type": 3}, {"append_only": True},
        {"sources": [{"name": "a"}, {"name": "b"}]}, {"sources": [{"name": "a", "cdc_strategy": "cdf"}]}, {"transformation_sql": "DELETE FROM s_x"}, {"transformation_sql": "SELECT 1"},
        {"freshness": "soon"}, {"foreign_keys": [fk("d")]}, {"sources": []}, {"sources": [{"name": "a", "streaming": True}]},
    ],
)
def test_rules_of_definitions(bad):
    with pytest.raises(ValueError):
        spec("x", **bad)


def test_render_and_load(tmp_path):
    assert render("{{ a.b }}/{{c}}", {"a": {"b": 1}, "c": "x"}) == "1/x"
    with pytest.raises(ValueError):
        render("{{ typo }}", {})
    assert seconds("15m") == 900 and seconds("2 hours") == 7200
    (tmp_path / "q.sql").write_text("SELECT * FROM {{ alias }}")
    (tmp_path / "t.yml").write_text("table_name: t\ntable_type: dimension\nkeys: {surrogate_key: sk, natural_keys: [id]}\nsources: [{name: db.src}]\ntransformation_sql: 'file:q.sql'\n")
    t = load_table(tmp_path / "t.yml", {"alias": "src"})
    assert t.natural_keys == ["id"] and t.transformation_sql == "SELECT * FROM src" and t.sources[0].alias == "src"
    assert t.fingerprint() == t.model_copy(update={"description": "other"}).fingerprint() != t.model_copy(update={"cluster_by": ["id"]}).fingerprint()


def test_graph():
    d, f = spec("d"), spec("f", "fact", foreign_keys=[fk("d"), fk("d", "k2", event_at="at", durable_column="dk"), fk("elsewhere")])
    agg = spec("agg", "fact", sources=[{"name": "f"}])
    p = compile_project([agg, f, d])
    assert p.ok and p.levels == [["d"], ["f"], ["agg"]] and p.downstream("d") == {"f", "agg"}
    assert [i.code for i in p.issues] == ["MISSING_UPSTREAM"]
    loop = compile_project([spec("a", sources=[{"name": "b"}]), spec("b", sources=[{"name": "a"}])])
    assert not loop.ok and {i.code for i in loop.issues} == {"DEPENDENCY_CYCLE"}
    assert {i.code for i in compile_project([d, d]).issues} == {"TARGET_WRITER_CONFLICT"}
    assert {i.code for i in compile_project([d, spec("e"), spec("g", "fact", foreign_keys=[fk("d")], depends_on=["e"])]).issues} == {"UNDECLARED_DEPENDENCY"}
    assert {i.code for i in compile_project([spec("g", depends_on=["nowhere"])]).issues} == {"MISSING_UPSTREAM"}
    assert job(p, "j")["tasks"][1] == {"task_key": "f", "command": "python -m orrery run f", "depends_on": ["d"]}
    matrix = bus_matrix([d, f, agg])
    assert "X (k); H+C (k2)" in matrix and "| agg |" in matrix
    assert conformance_warnings([d, f]) == ["elsewhere is not defined in this project"]


def test_manifests():
    d, f = spec("d"), spec("f", "fact", foreign_keys=[fk("d")])
    old = manifest(compile_project([d, f]))
    assert manifest(compile_project([f, d]))["digest"] == old["digest"] and manifest_diff(old, old) == {}
    diff = lambda *t: manifest_diff(old, manifest(compile_project(list(t))))
    assert diff(spec("d", natural_keys=["other"]), f)["d"] == {"kind": "changed", "impact": "breaking", "fields": ["natural_keys"], "reaches": ["f"]}
    assert diff(spec("d", description="x"), f)["d"]["impact"] == "metadata_only"
    assert diff(spec("d", transformation_sql="SELECT * FROM s_d"), f)["d"]["impact"] == "requires_backfill"
    assert diff(spec("d", delete_strategy="hard"), f)["d"]["impact"] == "requires_validation"
    assert diff(f)["d"]["kind"] == "removed" and diff(d, f, spec("n"))["n"]["kind"] == "added"


def contract(version="1.0.0", **change):
    doc = {
        "kind": "DataContract", "id": "customers", "version": version,
        "schema": [{"name": "customers", "properties": [
            {"name": "customer_id", "logicalType": "integer", "physicalType": "int", "primaryKey": True, "primaryKeyPosition": 1, "required": True},
            {"name": "email", "logicalType": "string", "quality": [{"metric": "nullValues", "mustBeLessOrEqualTo": 5, "unit": "percent"}]},
            {"name": "status", "logicalType": "string", "quality": [{"metric": "invalidValues", "arguments": {"validValues": ["a"]}, "severity": "warning"}]},
        ]}],
    }
    for i, p in change.items():
        doc["schema"][0]["properties"][int(i[1:])] |= p
    return yaml.safe_dump(doc)


def test_contracts(spark, tmp_path):
    c = load_contract(contract())
    assert c.primary_key == ["customer_id"] and {r.kind for r in c.rules()} == {"not_null", "unique", "null_rate", "accepted_values"}
    good = spark.createDataFrame([(1, "e", "a")], "customer_id int, email string, status string")
    assert c.findings(good) == [] and ("TYPE_CHANGED", "email") in c.findings(good.selectExpr("customer_id", "1 AS email", "status"))
    assert ("MISSING_COLUMN", "status") in c.findings(good.drop("status")) and ("CDF_METADATA", "_change_type") in c.findings(good, cdf=True)
    for broken in ("kind: Other", "kind: DataContract\nid: x\nversion: 1.0.0", contract("1.0")):
        with pytest.raises(ValueError):
            load_contract(broken)
    wider = load_contract(contract("1.1.0", _1={"required": True}))
    assert compare(c, wider) == [("NOW_REQUIRED", "email", False)] and version_problem(c, wider) is None
    typed = load_contract(contract("1.1.0", _1={"logicalType": "integer"}))
    assert "major" in version_problem(c, typed)
    assert "above" in version_problem(c, load_contract(contract("1.0.0", _1={"required": True})))
    for d, text in (("old", contract()), ("new", contract("1.1.0", _1={"logicalType": "integer"}))):
        (tmp_path / d).mkdir()
        (tmp_path / d / "c.yaml").write_text(text)
    (tmp_path / "none").mkdir()
    assert len(gate(tmp_path / "old", tmp_path / "new")) == 1 and gate(tmp_path / "old", tmp_path / "old") == [] and gate(tmp_path / "old", tmp_path / "none") == ["customers: removed"]
    assert main(["gate", str(tmp_path / "old"), str(tmp_path / "new")]) == 1
    r = Registry(spark, fresh_path(spark, "registry"))
    assert r.publish(c) and not r.publish(c) and r.publish(wider)
    with pytest.raises(ValueError):
        r.publish(load_contract(contract("1.0.0", _1={"required": True})))
    r.subscribe("customers", "me"), r.subscribe("customers", "me")
    assert len(r.find("consumer")) == 1


def test_command_line(tmp_path, capsys):
    (tmp_path / "d.yml").write_text("table_name: d\ntable_type: dimension\nsurrogate_key: sk\nnatural_keys: [id]\nsources: [{name: '{{ src }}'}]\n")
    assert main(["validate", str(tmp_path)]) == 1
    assert main(["validate", str(tmp_path), "--set", "src=s"]) == 0
    assert main(["compile", str(tmp_path), "--set", "src=s"]) == 0
    assert "digest" in capsys.readouterr().out
    assert main(["matrix", str(tmp_path), "--set", "src=s"]) == 0
