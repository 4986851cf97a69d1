"""The two-day star: customers with history and masking, products overwritten, orders as facts, events appended; batch and stream."""

import pytest
from pyspark.sql import functions as F

from orrery.operators.dimensions import applied, overwrite_merge
from orrery.operators.quality import QualityError
from orrery.plans.config import TableSpec
from orrery.plans.graph import compile_project
from orrery.plans.pipeline import Warehouse
from orrery.runtime import fresh_path
from orrery.streaming.feeds import reload_stream, run_stream

CUSTOMERS = "customer_id int, first_name string, last_name string, email string, address string, updated_at string"
PRODUCTS = "product_id int, name string, category string, unit_cost double, updated_at string"
ORDERS = "order_id int, customer_id int, order_date string, status string, updated_at string"
ITEMS = "order_item_id int, order_id int, product_id int, quantity int, sales_amount double"
DAY1 = {
    "customers": (CUSTOMERS, [(1, "Ines", "Moura", "ines@post.example", "7 Quay Lane, Porto", "2023-03-05T10:00:00"), (2, "Tomas", "Claes", "tomas@post.example", "31 Mill Row, Gent", "2023-03-05T10:00:00")]),
    "products": (PRODUCTS, [(31, "Lamp", "home", 42.5, "2023-03-05T10:00:00"), (32, "Vase", "home", 8.25, "2023-03-05T10:00:00")]),
    "orders": (ORDERS, [(641, 1, "2023-03-05T12:00:00", "paid", "2023-03-05T12:00:00"), (642, 2, "2023-03-05T13:00:00", "open", "2023-03-05T13:00:00")]),
    "order_items": (ITEMS, [(811, 641, 31, 1, 51.0), (812, 642, 32, 2, 17.75)]),
}
DAY2 = {
    "customers": (CUSTOMERS, [(1, "Ines", "Moura", "ines@post.example", "88 Dock Rd, Brno", "2023-03-06T09:00:00"), (2, "Tomas", "Claes", "tomas@post.example", "31 Mill Row, Gent", "2023-03-05T10:00:00"), (3, "Yaw", "Boateng", "yaw@post.example", "4 Fern Way, Turku", "2023-03-06T10:00:00")]),
    "products": (PRODUCTS, [(31, "Lamp", "home", 39.0, "2023-03-06T10:00:00"), (32, "Vase", "home", 8.25, "2023-03-05T10:00:00"), (33, "Stool", "home", 17.75, "2023-03-06T10:00:00")]),
    "orders": (ORDERS, [(643, 1, "2023-03-06T11:00:00", "open", "2023-03-06T11:00:00"), (644, 3, "2023-03-06T14:00:00", "sent", "2023-03-06T14:00:00")]),
    "order_items": (ITEMS, [(813, 643, 32, 1, 9.5), (814, 644, 33, 1, 20.0)]),
}
KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id"}

DIM_CUSTOMER = TableSpec(
    table_name="dim_customer", table_type="dimension", scd_type=7, surrogate_key="customer_sk", durable_key="customer_dk", natural_keys=["customer_id"], effective_at="updated_at", preserve_all_changes=True,
    track_history_columns=["first_name", "last_name", "email", "address"], sources=[{"name": "customers", "cdc_strategy": "cdf", "primary_keys": ["customer_id"], "streaming": True}],
    pii=[{"column": "email", "method": "fast_hash"}, {"column": "address", "method": "mask", "prefix": 5}],
)
DIM_PRODUCT = TableSpec(table_name="dim_product", table_type="dimension", scd_type=1, surrogate_key="product_sk", natural_keys=["product_id"], sources=[{"name": "products", "cdc_strategy": "cdf", "primary_keys": ["product_id"]}], tests=[{"name": "cost", "kind": "expression", "sql": "unit_cost >= 0"}])
FACT = TableSpec(
    table_name="fact_sales", table_type="fact", merge_keys=["order_item_id"], sources=[{"name": "orders", "alias": "o", "format": "versioned"}, {"name": "order_items", "alias": "i", "cdc_strategy": "cdf", "primary_keys": ["order_item_id"]}],
    transformation_sql="SELECT i.order_item_id, o.order_id, o.customer_id, i.product_id, CAST(o.order_date AS TIMESTAMP) AS order_at, i.quantity, i.sales_amount, i._change_type, i._commit_version FROM i JOIN o ON i.order_id = o.order_id",
    foreign_keys=[
        {"column": "customer_sk", "references": "dim_customer", "lookup": {"customer_id": "customer_id"}, "dimension_key": "customer_sk", "durable_column": "customer_dk", "dimension_durable_key": "customer_dk", "event_at": "order_at", "early_arriving": "skeleton"},
        {"column": "product_sk", "references": "dim_product", "lookup": {"product_id": "product_id"}, "dimension_key": "product_sk", "early_arriving": "error"},
    ],
    measures=[{"name": "sales_amount", "aggregation": "sum"}], degenerate_dimensions=["order_id"],
)
EVENTS = TableSpec(table_name="fact_events", table_type="fact", append_only=True, sources=[{"name": "order_items", "cdc_strategy": "append"}])


def land(warehouse, day):
    for name, (schema, rows) in day.items():
        df, table, key = warehouse.spark.createDataFrame(rows, schema), warehouse.table(name), [KEYS[name]]
        if not table.exists():
            table.create(df.schema)
        merged = overwrite_merge(table.snapshot(), df, key)
        kind = F.when(F.col("__action") == "update", "update_postimage").otherwise(F.col("__action"))
        table.commit(applied(merged).drop("__is_deleted"), merged.filter("__action <> 'keep'").withColumn("_change_type", kind).drop("__action", "__is_deleted"))


@pytest.fixture
def warehouse(spark):
    return Warehouse(spark, fresh_path(spark, "wh"))


def test_two_days(warehouse):
    project = compile_project([FACT, DIM_PRODUCT, DIM_CUSTOMER, EVENTS])
    assert project.ok and project.levels == [["dim_customer", "dim_product", "fact_events"], ["fact_sales"]]
    land(warehouse, DAY1)
    results = warehouse.run_project(project)
    assert [r.status for r in results] == ["SUCCESS"] * 4, results
    customers = warehouse.table("dim_customer").snapshot()
    assert customers.count() == 6 and warehouse.table("dim_product").snapshot().count() == 6 and warehouse.table("fact_sales").snapshot().count() == 2
    ines1 = customers.filter("customer_id = 1").first()
    assert ines1["address"] == "7 Qua**********" and ines1["__is_current"] and not ines1["__is_skeleton"]
    assert warehouse.table("fact_events").snapshot().count() == 2
    # nothing new: nothing is written
    before = {n: warehouse.table(n).latest() for n in project.tables}
    warehouse.run_project(project)
    assert before == {n: warehouse.table(n).latest() for n in project.tables}
    land(warehouse, DAY2)
    results = warehouse.run_project(project)
    assert [r.status for r in results] == ["SUCCESS"] * 4, results
    customers = warehouse.table("dim_customer").snapshot()
    ines = customers.filter("customer_id = 1").orderBy("__valid_from").collect()
    assert [r["address"] for r in ines] == ["7 Qua**********", "88 Do**********"] and ines[0]["customer_dk"] == ines[1]["customer_dk"] and ines[0]["customer_sk"] == ines1["customer_sk"]
    assert [r["__is_current"] for r in ines] == [False, True] and ines[0]["__valid_to"] == ines[1]["__valid_from"]
    products = {r["product_id"]: r["unit_cost"] for r in warehouse.table("dim_product").snapshot().collect()}
    assert products[31] == 39.0 and products[33] == 17.75
    facts = {r["order_id"]: r for r in warehouse.table("fact_sales").snapshot().collect()}
    assert len(facts) == 4
    assert facts[641]["customer_sk"] == ines[0]["customer_sk"] and facts[643]["customer_sk"] == ines[1]["customer_sk"] and facts[641]["customer_dk"] == facts[643]["customer_dk"]
    assert warehouse.table("fact_events").snapshot().count() == 4


def test_skeleton_is_made_then_filled_in_place(warehouse):
    land(warehouse, DAY1)
    warehouse.run(DIM_CUSTOMER)
    warehouse.run(DIM_PRODUCT)
    late = {"orders": (ORDERS, [(649, 7, "2023-03-05T15:00:00", "open", "x")]), "order_items": (ITEMS, [(819, 649, 31, 1, 1.0)])}
    land(warehouse, late)
    warehouse.run(FACT)
    made = warehouse.table("dim_customer").snapshot().filter("customer_id = 7").collect()
    assert len(made) == 1 and made[0]["__is_skeleton"] and made[0]["first_name"] == "Not Yet Available"
    land(warehouse, {"customers": (CUSTOMERS, [*DAY1["customers"][1], (7, "Lena", "Vogt", "lena@post.example", "6 Oak Hill", "2023-03-07T00:00:00")])})
    warehouse.run(DIM_CUSTOMER)
    filled = warehouse.table("dim_customer").snapshot().filter("customer_id = 7").collect()
    assert len(filled) == 1 and filled[0]["first_name"] == "Lena" and not filled[0]["__is_skeleton"] and filled[0]["customer_sk"] == made[0]["customer_sk"]
    fact = warehouse.table("fact_sales").snapshot().filter("order_item_id = 819").first()
    assert fact["customer_sk"] == filled[0]["customer_sk"]


def test_failure_leaves_the_target_and_skips_dependents(warehouse):
    land(warehouse, DAY1 | {"products": (PRODUCTS, [(31, "Lamp", "home", -5.0, "x")])})
    results = {r.table: r for r in warehouse.run_project(compile_project([FACT, DIM_PRODUCT, DIM_CUSTOMER]))}
    assert results["dim_product"].status == "FAILED" and "cost" in results["dim_product"].error
    assert results["fact_sales"].status == "SKIPPED" and results["dim_customer"].status == "SUCCESS"
    assert not warehouse.table("dim_product").exists()
    assert warehouse.control.rows()["dim_product", "products"]["batch_status"] == "FAILED"
    with pytest.raises(QualityError):
        warehouse.run(DIM_PRODUCT)


def test_type_4_and_6(warehouse):
    land(warehouse, DAY1)
    four = TableSpec(table_name="d4", table_type="dimension", scd_type=4, surrogate_key="sk", natural_keys=["customer_id"], history_table="d4_history", track_history_columns=["email", "address"], sources=[{"name": "customers"}])
    six = TableSpec(table_name="d6", table_type="dimension", scd_type=6, surrogate_key="sk", natural_keys=["customer_id"], effective_at="updated_at", track_history_columns=["address"], current_value_columns=["address"], sources=[{"name": "customers"}])
    warehouse.run(four), warehouse.run(six)
    assert warehouse.table("d4_history").snapshot().count() == 4
    land(warehouse, DAY2)
    warehouse.run(four), warehouse.run(six)
    history = warehouse.table("d4_history").snapshot()
    assert history.count() == 7 and history.filter("NOT __is_current").count() == 1
    rows = warehouse.table("d6").snapshot().filter("customer_id = 1").collect()
    assert len(rows) == 2 and {r["current_address"] for r in rows} == {"88 Dock Rd, Brno"}


@pytest.mark.parametrize("per_version", [False, True])
def test_stream_gives_what_the_batch_gives(warehouse, per_version):
    land(warehouse, DAY1)
    first = run_stream(warehouse, DIM_CUSTOMER, per_version=per_version)
    assert first.errors == [] and first.batches >= 1
    land(warehouse, DAY2)
    assert run_stream(warehouse, DIM_CUSTOMER, per_version=per_version).errors == []
    shown = lambda: sorted(tuple(map(str, r)) for r in warehouse.table("dim_customer").snapshot().select("customer_sk", "customer_id", "address", "__valid_from", "__valid_to", "__is_current").collect())
    streamed = shown()
    assert len(streamed) == 8
    reload_stream(warehouse, DIM_CUSTOMER)
    assert shown() == streamed
    assert run_stream(warehouse, DIM_PRODUCT).errors == []
    assert warehouse.table("dim_product").snapshot().count() == 7
