"""Queries of the warehouse operators: change feeds, dimensions, facts, quality and contracts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.keys import VALID_TO, hash_key, hashdiff, payload
from orrery.functions.times import instant_us, ntz_of_us, stamp_us
from orrery.operators import dimensions as dim
from orrery.operators import facts as fct
from orrery.operators import feed as fd
from orrery.operators import quality as dq
from orrery.operators.asof import interval_join
from orrery.operators.history import loose, merge_history
from orrery.queries import query, table
from orrery.queries.dealt import _sql_loose, sql_us
from orrery.runtime import cut, fresh_path

#: Where the queries cut the tables' history into what was there and what arrives.
CUT = "2024-06-01 00:00:00"
_CUT_US = 1717200000000000
HIGH_US = 253402214400000000
NTZ = "TIMESTAMP_NTZ"


def us(column: str):
    return stamp_us(F.col(column))


# ---------------------------------------------------------------- flagship


@query("revenue_by_segment_asof", """
WITH feed AS (SELECT o_custkey AS customer_id, o_orderdate AS eff, o_orderpriority AS segment,
       row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders),
chg AS (SELECT *, lag(segment) OVER (PARTITION BY customer_id ORDER BY eff) AS prev FROM feed WHERE rn = 1),
d AS (SELECT customer_id, segment, eff AS valid_from, coalesce(lead(eff) OVER (PARTITION BY customer_id ORDER BY eff), TIMESTAMP '9999-12-31') AS valid_to
       FROM chg WHERE prev IS NULL OR prev <> segment)
SELECT coalesce(d.segment, 'Not Yet Available') AS segment, count(*) AS line_count,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4)) AS revenue
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
LEFT JOIN d ON o_custkey = customer_id AND l_shipdate >= valid_from AND l_shipdate < valid_to GROUP BY 1
""")  # fmt: skip
def revenue_by_segment_asof(spark, folder) -> DataFrame:
    """Revenue by the segment that was valid for the customer when each line shipped."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", us("o_orderdate").alias("at"))
    segments = merge_history(orders, key="o_custkey", at="at", tracked=["o_orderpriority"], tie=["o_orderkey"])
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", us("l_shipdate").alias("shipped"))
    facts = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    valid = segments.withColumnRenamed("o_orderpriority", "segment")
    joined = interval_join(facts, valid, on={"o_custkey": "o_custkey"}, at=F.col("shipped"), start=F.col("valid_from_us"), end=F.col("valid_to_us"), carry=["segment"], how="left", moments=lines.select("shipped"))
    price = F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    return joined.groupBy(F.coalesce("segment", F.lit("Not Yet Available")).alias("segment")).agg(F.count(F.lit(1)).alias("line_count"), F.sum(price).cast("decimal(38,4)").alias("revenue"))


# ---------------------------------------------------------------- change feeds


def order_feed(spark, folder) -> DataFrame:
    at = F.coalesce(instant_us(F.col("updated_at")), us("_commit_timestamp"))
    rows = table(spark, folder, "order_feed").filter("_change_type <> 'update_preimage'")
    return rows.select("order_id", F.lower(F.trim(F.col("status"))).alias("status"), at.alias("at"), "_change_type", "_commit_version", "_commit_timestamp")


_FEED = f"""feed AS (SELECT order_id, lower(trim(status)) AS status, coalesce({sql_us("updated_at")}, epoch_us(_commit_timestamp)) AS moment, _change_type AS t, _commit_version AS v, _commit_timestamp AS ts
  FROM order_feed WHERE _change_type <> 'update_preimage')"""


@query("cdf_dedup_delete_wins", f"""WITH {_FEED} SELECT order_id, v AS version, t AS change_type FROM feed
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC, CASE t WHEN 'delete' THEN 2 WHEN 'update_postimage' THEN 1 ELSE 0 END DESC) = 1""")  # fmt: skip
def cdf_dedup_delete_wins(spark, folder) -> DataFrame:
    return fd.dedup_delete_wins(order_feed(spark, folder), ["order_id"]).select("order_id", F.col("_commit_version").alias("version"), F.col("_change_type").alias("change_type"))


@query("cdf_dedup_upsert_wins", f"""WITH {_FEED} SELECT order_id, v AS version, t = 'delete' AS gone FROM feed
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC, t <> 'delete' DESC) = 1""")  # fmt: skip
def cdf_dedup_upsert_wins(spark, folder) -> DataFrame:
    return fd.dedup_upsert_wins(order_feed(spark, folder), ["order_id"]).select("order_id", F.col("_commit_version").alias("version"), (F.col("_change_type") == "delete").alias("gone"))


@query("cdf_reattach", "SELECT order_id, status, max(_commit_version) AS version FROM order_feed GROUP BY 1, 2")
def cdf_reattach(spark, folder) -> DataFrame:
    """Rows whose SQL dropped the feed's metadata get it back from the latest change that had their values."""
    feed = table(spark, folder, "order_feed").select("order_id", "status", "_change_type", "_commit_version")
    return fd.reattach({"feed": feed}, feed.select("order_id", "status").distinct()).select("order_id", "status", F.col("_commit_version").alias("version"))


@query("cdf_range", f"""WITH {_FEED} SELECT t AS change_type, count(*) AS n, min(v) AS first_version, max(v) AS last_version FROM feed
WHERE v BETWEEN (SELECT min(v) FROM feed) + 1000 AND (SELECT max(v) FROM feed) - 1000 GROUP BY 1""")  # fmt: skip
def cdf_range(spark, folder) -> DataFrame:
    feed = table(spark, folder, "order_feed")
    ends = feed.filter("_change_type <> 'update_preimage'").agg(F.min("_commit_version"), F.max("_commit_version")).first()
    rows = fd.changes_between(feed, ends[0] + 1000, ends[1] - 1000)
    return rows.groupBy(F.col("_change_type").alias("change_type")).agg(F.count(F.lit(1)).alias("n"), F.min("_commit_version").alias("first_version"), F.max("_commit_version").alias("last_version"))


def _day(spark, folder, first: bool) -> DataFrame:
    """The customers as the loads until the cut, or all loads, left them: one row per customer."""
    rows = customers(spark, folder)
    rows = rows.filter(F.col("at") < _CUT_US) if first else rows
    return rows.groupBy("customer_id").agg(F.max_by(F.struct("email", "address"), F.struct("at", "_commit_version", "email", "address")).alias("r")).select("customer_id", "r.*")


def customers(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customers").select("customer_id", instant_us(F.col("updated_at")).alias("at"), "_commit_version", loose(F.col("email")).alias("email"), loose(F.col("address")).alias("address"))
    return rows.filter("customer_id IS NOT NULL AND at IS NOT NULL")


_CUST = f"""cust AS (SELECT * FROM (SELECT customer_id, {sql_us("updated_at")} AS moment, _commit_version AS v, {_sql_loose("email")} AS email, {_sql_loose("address")} AS address FROM customers) WHERE customer_id IS NOT NULL AND moment IS NOT NULL),
day1 AS (SELECT customer_id, email, address, moment FROM cust WHERE moment < {_CUT_US} QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY moment DESC, v DESC) = 1),
day2 AS (SELECT customer_id, email, address, moment FROM cust QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY moment DESC, v DESC) = 1)"""


@query("change_feed_diff", f"""WITH {_CUST}
SELECT d2.customer_id, d2.email, 'insert' AS change_type FROM day2 d2 ANTI JOIN day1 d1 ON d1.customer_id = d2.customer_id
UNION ALL SELECT d1.customer_id, unnest([d1.email, d2.email]), unnest(['update_preimage', 'update_postimage']) FROM day1 d1 JOIN day2 d2 ON d1.customer_id = d2.customer_id
WHERE d1.email IS DISTINCT FROM d2.email OR d1.address IS DISTINCT FROM d2.address""")  # fmt: skip
def change_feed_diff(spark, folder) -> DataFrame:
    diff = fd.changes_from_snapshots(_day(spark, folder, True), _day(spark, folder, False), ["customer_id"], 2)
    return diff.select("customer_id", "email", F.col("_change_type").alias("change_type"))


# ---------------------------------------------------------------- type 1


def _halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    feed = order_feed(spark, folder).select("order_id", "status", "at", "_change_type", "_commit_version", "_commit_timestamp")
    early = F.col("_commit_timestamp") < F.lit(CUT).cast("timestamp_ntz")
    return feed.filter(early), feed.filter(~early)


#: Which of a commit's changes of one order counts.
_TIE = ("at", "status")


def _no_orders(spark) -> DataFrame:
    return spark.createDataFrame([], "order_id int, status string")


_HALVES = f"""WITH {_FEED},
a AS (SELECT order_id, status, t FROM feed WHERE ts < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC, t <> 'delete' DESC, moment DESC, status DESC NULLS LAST) = 1),
b AS (SELECT order_id, status, t FROM feed WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC, t <> 'delete' DESC, moment DESC, status DESC NULLS LAST) = 1),
a1 AS (SELECT order_id, status FROM a WHERE t <> 'delete')"""


@query("scd1_initial", _HALVES + " SELECT order_id, status, 'insert' AS action FROM a1")
def scd1_initial(spark, folder) -> DataFrame:
    return dim.overwrite_merge(_no_orders(spark), _halves(spark, folder)[0], ["order_id"], tie=_TIE).select("order_id", "status", F.col("__action").alias("action"))


@query("scd1_changed", _HALVES + """ SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.order_id IS NULL THEN 'keep' WHEN a1.order_id IS NULL THEN CASE WHEN b.t = 'delete' THEN 'ignore' ELSE 'insert' END
  WHEN b.t = 'delete' THEN 'delete' WHEN a1.status IS DISTINCT FROM b.status THEN 'update' ELSE 'keep' END AS action
  FROM a1 FULL JOIN b ON a1.order_id = b.order_id) WHERE action <> 'ignore' GROUP BY 1""")  # fmt: skip
def scd1_changed(spark, folder) -> DataFrame:
    first, second = _halves(spark, folder)
    target = dim.applied(dim.overwrite_merge(_no_orders(spark), first, ["order_id"], tie=_TIE))
    return dim.overwrite_merge(target, second, ["order_id"], tie=_TIE).groupBy(F.col("__action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("scd1_noop", _HALVES + " SELECT 'keep' AS action, count(*) AS n FROM a1 HAVING count(*) > 0")
def scd1_noop(spark, folder) -> DataFrame:
    first, _ = _halves(spark, folder)
    target = dim.applied(dim.overwrite_merge(_no_orders(spark), first, ["order_id"], tie=_TIE))
    return dim.overwrite_merge(target, target.drop("__is_deleted"), ["order_id"]).groupBy(F.col("__action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def _whole(spark, folder) -> DataFrame:
    return order_feed(spark, folder).select("order_id", "status", "at", "_change_type", "_commit_version")


_WHOLE = f"""WITH {_FEED},
a AS (SELECT order_id, status, t FROM feed QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY v DESC, t <> 'delete' DESC, moment DESC, status DESC NULLS LAST) = 1),
a1 AS (SELECT order_id, status FROM a WHERE t <> 'delete')"""


@query("scd1_initial_whole", _WHOLE + " SELECT order_id, status, 'insert' AS action FROM a1")
def scd1_initial_whole(spark, folder) -> DataFrame:
    """The initial load of the whole feed; ``scd1_initial`` has the part before the cut."""
    return dim.overwrite_merge(_no_orders(spark), _whole(spark, folder), ["order_id"], tie=_TIE).select("order_id", "status", F.col("__action").alias("action"))


@query("scd1_noop_whole", _WHOLE + " SELECT 'keep' AS action, count(*) AS n FROM a1 HAVING count(*) > 0")
def scd1_noop_whole(spark, folder) -> DataFrame:
    """The whole feed's orders again change nothing; ``scd1_noop`` has those before the cut."""
    target = dim.applied(dim.overwrite_merge(_no_orders(spark), _whole(spark, folder), ["order_id"], tie=_TIE))
    return dim.overwrite_merge(target, target.drop("__is_deleted"), ["order_id"]).groupBy(F.col("__action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("scd1_delete_hard", _HALVES + """ SELECT coalesce(b.order_id, a1.order_id) AS order_id, CASE WHEN b.order_id IS NULL THEN a1.status ELSE b.status END AS status
FROM a1 FULL JOIN b ON a1.order_id = b.order_id WHERE b.t IS NULL OR b.t <> 'delete'""")  # fmt: skip
def scd1_delete_hard(spark, folder) -> DataFrame:
    first, second = _halves(spark, folder)
    target = dim.applied(dim.overwrite_merge(_no_orders(spark), first, ["order_id"], tie=_TIE))
    return dim.applied(dim.overwrite_merge(target, second, ["order_id"], tie=_TIE)).select("order_id", "status")


@query("scd1_delete_soft", _HALVES + """ SELECT coalesce(b.order_id, a1.order_id) AS order_id, CASE WHEN b.order_id IS NULL OR b.t = 'delete' THEN a1.status ELSE b.status END AS status, coalesce(b.t = 'delete', false) AS is_deleted
FROM a1 FULL JOIN b ON a1.order_id = b.order_id WHERE b.t IS NULL OR b.t <> 'delete' OR a1.order_id IS NOT NULL""")  # fmt: skip
def scd1_delete_soft(spark, folder) -> DataFrame:
    first, second = _halves(spark, folder)
    target = dim.applied(dim.overwrite_merge(_no_orders(spark), first, ["order_id"], tie=_TIE))
    return dim.applied(dim.overwrite_merge(target, second, ["order_id"], deletes="soft", tie=_TIE), "soft").select("order_id", "status", F.col("__is_deleted").alias("is_deleted"))


# ---------------------------------------------------------------- type 2


def _versions(spark, folder) -> DataFrame:
    return customers(spark, folder).withColumn("eff", ntz_of_us(F.col("at")))


def _merge(target: DataFrame | None, source: DataFrame, **more) -> DataFrame:
    tracked = ["address", "email"]
    # as in a warehouse, what a merge starts from is a table
    target = dim.empty_versions(source, ["customer_id"], tracked, "eff") if target is None else cut(target, "dimension")
    return dim.versioned_merge(target, source, ["customer_id"], at="eff", tracked=tracked, strategy="portable", **more)


def _shown(versions: DataFrame) -> DataFrame:
    return versions.select("sk", "customer_id", "email", us("__valid_from").alias("from_us"), us("__valid_to").alias("to_us"), F.col("__is_current").alias("is_current"), F.col("__is_deleted").alias("is_deleted"))


_ONCE = f"""WITH {_CUST}, once AS (SELECT * FROM cust QUALIFY row_number() OVER (PARTITION BY customer_id, moment ORDER BY v DESC) = 1)"""
_CHAIN = """chain AS (SELECT *, lead(moment) OVER (PARTITION BY customer_id ORDER BY moment) AS nxt FROM
  (SELECT *, row_number() OVER w AS n, lag(email) OVER w AS pe, lag(address) OVER w AS pa FROM once WINDOW w AS (PARTITION BY customer_id ORDER BY moment))
  WHERE n = 1 OR email IS DISTINCT FROM pe OR address IS DISTINCT FROM pa)"""
_SK = "CAST('0x' || substr(md5(concat_ws(chr(0), 'customer_id:' || customer_id, '__valid_from:' || CAST(make_timestamp(moment) AS VARCHAR))), 1, 15) AS BIGINT)"
_SHOW = f"SELECT {_SK} AS sk, customer_id, email, moment AS from_us, coalesce(nxt, {HIGH_US}) AS to_us, nxt IS NULL AS is_current, false AS is_deleted FROM chain"


@query("scd2_chain", f"{_ONCE}, {_CHAIN} {_SHOW}")
def scd2_chain(spark, folder) -> DataFrame:
    """All versions of all customers in one batch."""
    return _shown(_merge(None, _versions(spark, folder)))


@query("scd2_initial", f"{_ONCE.replace('SELECT * FROM cust QUALIFY', f'SELECT * FROM cust WHERE moment < {_CUT_US} QUALIFY')}, {_CHAIN} {_SHOW}")
def scd2_initial(spark, folder) -> DataFrame:
    return _shown(_merge(None, _versions(spark, folder).filter(F.col("at") < _CUT_US)))


@query("scd2_incremental_equals_full", f"{_ONCE}, {_CHAIN} {_SHOW}")
def scd2_incremental_equals_full(spark, folder) -> DataFrame:
    rows = _versions(spark, folder)
    return _shown(_merge(_merge(None, rows.filter(F.col("at") < _CUT_US)), rows.filter(F.col("at") >= _CUT_US)))


@query("scd2_noop", f"{_ONCE}, {_CHAIN} {_SHOW}")
def scd2_noop(spark, folder) -> DataFrame:
    """The same rows again change nothing."""
    rows = _versions(spark, folder)
    return _shown(_merge(_merge(None, rows), rows))


@query("scd2_change", f"""{_ONCE}, {_CHAIN} SELECT customer_id, count(*) AS opened, CAST(sum((nxt IS NOT NULL)::INT) AS BIGINT) AS closed FROM chain WHERE moment >= {_CUT_US} GROUP BY 1""")
def scd2_change(spark, folder) -> DataFrame:
    """Versions that the second batch opened and closed, per customer."""
    rows = _versions(spark, folder)
    after = _merge(_merge(None, rows.filter(F.col("at") < _CUT_US)), rows.filter(F.col("at") >= _CUT_US))
    return after.filter(us("__valid_from") >= _CUT_US).groupBy("customer_id").agg(F.count(F.lit(1)).alias("opened"), F.sum((~F.col("__is_current")).cast("bigint")).alias("closed"))


@query("scd2_late_version", f"""{_ONCE},
k AS (SELECT customer_id, moment, email, address FROM (SELECT *, row_number() OVER w AS n, lag(email) OVER w AS pe, lag(address) OVER w AS pa FROM once WHERE moment >= {_CUT_US} WINDOW w AS (PARTITION BY customer_id ORDER BY moment))
  WHERE n = 1 OR email IS DISTINCT FROM pe OR address IS DISTINCT FROM pa),
u AS (SELECT *, true AS held FROM k UNION ALL SELECT customer_id, moment, email, address, false FROM once WHERE moment < {_CUT_US}),
chain AS (SELECT *, lead(moment) OVER (PARTITION BY customer_id ORDER BY moment) AS nxt FROM
  (SELECT *, row_number() OVER w AS n, lag(email) OVER w AS pe, lag(address) OVER w AS pa FROM u WINDOW w AS (PARTITION BY customer_id ORDER BY moment))
  WHERE held OR n = 1 OR email IS DISTINCT FROM pe OR address IS DISTINCT FROM pa) {_SHOW}""")  # fmt: skip
def scd2_late_version(spark, folder) -> DataFrame:
    """The earlier rows arrive after the later ones."""
    rows = _versions(spark, folder)
    return _shown(_merge(_merge(None, rows.filter(F.col("at") >= _CUT_US)), rows.filter(F.col("at") < _CUT_US)))


@query("scd2_snapshot_delete", f"""{_ONCE}, {_CHAIN},
late AS (SELECT DISTINCT customer_id FROM once WHERE moment >= {_CUT_US})
SELECT c.customer_id, moment AS from_us, CASE WHEN nxt IS NULL AND l.customer_id IS NULL THEN {_CUT_US} ELSE coalesce(nxt, {HIGH_US}) END AS to_us,
  nxt IS NULL AND l.customer_id IS NOT NULL AS is_current, nxt IS NULL AND l.customer_id IS NULL AS is_deleted FROM chain c LEFT JOIN late l ON l.customer_id = c.customer_id""")  # fmt: skip
def scd2_snapshot_delete(spark, folder) -> DataFrame:
    """The rows since the cut are taken as a full snapshot: customers without one end there."""
    rows = _versions(spark, folder)
    first = _merge(None, rows.filter(F.col("at") < _CUT_US))
    after = _merge(first, rows.filter(F.col("at") >= _CUT_US), full_snapshot=True, as_of=F.lit(CUT).cast("timestamp_ntz"))
    return _shown(after).drop("sk", "email")


@query("scd2_cdf_delete", f"""WITH {_FEED},
o AS (SELECT *, t = 'delete' AS gone FROM feed QUALIFY row_number() OVER (PARTITION BY order_id, moment ORDER BY v DESC, t = 'delete' DESC) = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, lag(status) OVER w AS ps, lag(gone) OVER w AS pg FROM o WINDOW w AS (PARTITION BY order_id ORDER BY moment))
  WHERE CASE WHEN gone THEN n > 1 ELSE n = 1 OR pg OR status IS DISTINCT FROM ps END),
c AS (SELECT *, lead(moment) OVER w AS nxt, lead(gone) OVER w AS ng FROM k WINDOW w AS (PARTITION BY order_id ORDER BY moment))
SELECT order_id, status, moment AS from_us, coalesce(nxt, {HIGH_US}) AS to_us, nxt IS NULL AS is_current, coalesce(ng, false) AS is_deleted FROM c WHERE NOT gone""")  # fmt: skip
def scd2_cdf_delete(spark, folder) -> DataFrame:
    """Every status an order had, from the whole feed with its deletes."""
    feed = order_feed(spark, folder).withColumn("eff", ntz_of_us(F.col("at")))
    out = dim.versioned_merge(dim.empty_versions(feed, ["order_id"], ["status"], "eff"), feed, ["order_id"], at="eff", tracked=["status"])
    return out.select("order_id", "status", us("__valid_from").alias("from_us"), us("__valid_to").alias("to_us"), F.col("__is_current").alias("is_current"), F.col("__is_deleted").alias("is_deleted"))


@query("scd2_hydrate", f"""WITH {_CUST}, h AS (SELECT DISTINCT customer_id, order_id FROM order_headers WHERE customer_id IS NOT NULL),
m AS (SELECT DISTINCT customer_id FROM h WHERE customer_id NOT IN (SELECT customer_id FROM day1))
SELECT m.customer_id, d.email, d.customer_id IS NULL AS is_skeleton FROM m LEFT JOIN day2 d ON d.customer_id = m.customer_id""")  # fmt: skip
def scd2_hydrate(spark, folder) -> DataFrame:
    """Customers whom orders name before they are on file become skeletons, which the later rows fill."""
    first = _day(spark, folder, True)
    empty = dim.empty_versions(_versions(spark, folder), ["customer_id"], ["address", "email"], "eff")
    known = first.select(hash_key(payload(["customer_id"]), "portable").alias("sk"), "customer_id", "address", "email", F.lit("1900-01-01").cast("timestamp_ntz").alias("__valid_from"), F.lit(VALID_TO).cast("timestamp_ntz").alias("__valid_to"), F.lit(True).alias("__is_current"), F.lit(False).alias("__is_deleted"), F.lit(False).alias("__is_skeleton"), F.lit(0).cast("bigint").alias("hashdiff"))
    dimension = empty.unionByName(known)
    orders = table(spark, folder, "order_headers").select("customer_id", ntz_of_us(F.coalesce(instant_us(F.col("order_date")), F.lit(0))).alias("at"))
    added = fct.skeletons(fct.missing_members(orders, dimension, {"customer_id": "customer_id"}), dimension, ["customer_id"], "sk", strategy="portable")
    filled = fct.hydrate(added, _day(spark, folder, False), ["customer_id"], ["address", "email"])
    return filled.select("customer_id", F.when(~F.col("__is_skeleton"), F.col("email")).alias("email"), F.col("__is_skeleton").alias("is_skeleton"))


# ---------------------------------------------------------------- types 4, 6 and 7


def _effective(rows: DataFrame, at: int) -> DataFrame:
    return rows.withColumn("eff", ntz_of_us(F.lit(at)))


@query("scd4_current", f"WITH {_CUST} SELECT customer_id, email, address FROM day2")
def scd4_current(spark, folder) -> DataFrame:
    target = dim.applied(dim.overwrite_merge(spark.createDataFrame([], "customer_id int, email string, address string"), _day(spark, folder, True), ["customer_id"]))
    return dim.applied(dim.overwrite_merge(target, _day(spark, folder, False), ["customer_id"])).select("customer_id", "email", "address")


@query("scd4_history", f"""WITH {_CUST},
e1 AS (SELECT customer_id, unnest(['email', 'address']) AS field, unnest([email, address]) AS value FROM day1),
e2 AS (SELECT customer_id, unnest(['email', 'address']) AS field, unnest([email, address]) AS value FROM day2),
j AS (SELECT coalesce(e1.customer_id, e2.customer_id) AS k, coalesce(e1.field, e2.field) AS field, e1.value AS a, e2.value AS b, e1.customer_id IS NOT NULL AS o, e2.customer_id IS NOT NULL AS n FROM e1 FULL JOIN e2 ON e1.customer_id = e2.customer_id AND e1.field = e2.field)
SELECT k AS surrogate_key, field, a AS value, 0 AS from_us, CASE WHEN a IS DISTINCT FROM b THEN {_CUT_US} - 1 ELSE 253402300799000000 END AS to_us, a IS NOT DISTINCT FROM b AS is_current FROM j WHERE o
UNION ALL SELECT k, field, b, {_CUT_US}, 253402300799000000, true FROM j WHERE n AND (NOT o OR a IS DISTINCT FROM b)""")  # fmt: skip
def scd4_history(spark, folder) -> DataFrame:
    fields = ["email", "address"]
    first = dim.attribute_history(None, _effective(_day(spark, folder, True), 0), "customer_id", fields, "eff")
    after = dim.attribute_history(first, _effective(_day(spark, folder, False), _CUT_US), "customer_id", fields, "eff")
    return after.select("surrogate_key", "field", "value", us("valid_from").alias("from_us"), us("valid_to").alias("to_us"), F.col("__is_current").alias("is_current"))


@query("scd6_current_columns", f"""{_ONCE}, {_CHAIN} SELECT customer_id, moment AS from_us, email, last_value(email) OVER (PARTITION BY customer_id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_email FROM chain""")
def scd6_current_columns(spark, folder) -> DataFrame:
    versions = dim.current_columns(_merge(None, _versions(spark, folder)), ["customer_id"], ["email"])
    return versions.select("customer_id", us("__valid_from").alias("from_us"), "email", "current_email")


def _dual(spark, folder) -> DataFrame:
    return dim.with_dual_keys(cut(_merge(None, _versions(spark, folder)), "versions"), ["customer_id"], "portable")


_DURABLE = "sha256('customer_id:' || c.customer_id)"
_ROWFP = f"sha256({_DURABLE} || chr(0) || CAST(make_timestamp(c.moment) AS VARCHAR))"


@query("scd7_keys", f"{_ONCE}, {_CHAIN} SELECT customer_id, {_DURABLE} AS durable_fingerprint, {_ROWFP} AS row_fingerprint FROM chain c")
def scd7_keys(spark, folder) -> DataFrame:
    return _dual(spark, folder).select("customer_id", "durable_fingerprint", "row_fingerprint")


def _order_facts(spark, folder) -> DataFrame:
    rows = table(spark, folder, "order_headers").select("order_id", "customer_id", instant_us(F.col("order_date")).alias("u"), F.lower(F.trim(F.col("status"))).alias("status"))
    return rows.withColumn("at", ntz_of_us(F.col("u"))).drop("u")


_HEADS = f"heads AS (SELECT order_id, customer_id, {sql_us('order_date')} AS moment, lower(trim(status)) AS status FROM order_headers)"
_MD5KEY = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_DK = _MD5KEY.format("'customer_id:' || c.customer_id")
_RK = _MD5KEY.format(f"{_DURABLE} || chr(0) || CAST(make_timestamp(c.moment) AS VARCHAR)")


@query("broker_asof", f"""{_ONCE}, {_CHAIN}, {_HEADS}
SELECT h.order_id, CASE WHEN h.status = 'cancelled' THEN -2 WHEN h.customer_id IS NULL THEN -1 ELSE coalesce({_RK}, -3) END AS customer_sk, CASE WHEN h.status = 'cancelled' THEN -2 WHEN h.customer_id IS NULL THEN -1 ELSE coalesce({_DK}, -3) END AS customer_dk
FROM heads h LEFT JOIN chain c ON c.customer_id = h.customer_id AND h.moment >= c.moment AND h.moment < coalesce(c.nxt, {HIGH_US})""")  # fmt: skip
def broker_asof(spark, folder) -> DataFrame:
    """Orders with the row and durable key of the customer version at their date; cancelled orders need none."""
    return fct.resolve_keys(_order_facts(spark, folder), _dual(spark, folder), {"customer_id": "customer_id"}, {"customer_sk": "row_key", "customer_dk": "durable_key"}, event_at="at", not_applicable=F.col("status") == "cancelled").select("order_id", "customer_sk", "customer_dk")


@query("scd7_asis", f"""{_ONCE}, {_CHAIN}, {_HEADS}, r AS (SELECT h.order_id, c.customer_id AS k FROM heads h LEFT JOIN chain c ON c.customer_id = h.customer_id AND h.moment >= c.moment AND h.moment < coalesce(c.nxt, {HIGH_US}))
SELECT n.email, count(*) AS orders FROM r LEFT JOIN (SELECT * FROM chain WHERE nxt IS NULL) n ON n.customer_id = r.k GROUP BY 1""")  # fmt: skip
def scd7_asis(spark, folder) -> DataFrame:
    dual = _dual(spark, folder)
    facts = fct.resolve_keys(_order_facts(spark, folder), dual, {"customer_id": "customer_id"}, {"customer_dk": "durable_key"}, event_at="at")
    return fct.as_is(facts.select("order_id", "customer_dk"), dual, "customer_dk").groupBy("email").agg(F.count(F.lit(1)).alias("orders"))


@query("scd7_aswas", f"""{_ONCE}, {_CHAIN}, {_HEADS} SELECT c.email, count(*) AS orders FROM heads h LEFT JOIN chain c ON c.customer_id = h.customer_id AND h.moment >= c.moment AND h.moment < coalesce(c.nxt, {HIGH_US}) GROUP BY 1""")
def scd7_aswas(spark, folder) -> DataFrame:
    dual = _dual(spark, folder)
    facts = fct.resolve_keys(_order_facts(spark, folder), dual, {"customer_id": "customer_id"}, {"customer_sk": "row_key"}, event_at="at")
    return fct.as_was(facts.select("order_id", "customer_sk"), dual, "customer_sk", "row_key").groupBy("email").agg(F.count(F.lit(1)).alias("orders"))


@query("key_collision_gate", f"WITH {_CUST} SELECT customer_id AS key, count(DISTINCT email) AS fingerprints, false AS reserved FROM cust GROUP BY 1 HAVING count(DISTINCT email) > 1")
def key_collision_gate(spark, folder) -> DataFrame:
    """E-mail as fingerprint: the keys under which two were seen."""
    return dim.key_collisions(customers(spark, folder), "customer_id", "email")


@query("hash_payload_sha", """SELECT c_custkey, sha256(concat_ws(chr(0), 'c_custkey:' || c_custkey, 'c_mktsegment:' || coalesce(c_mktsegment, '__NULL_KEY__'))) AS fingerprint FROM customer""")
def hash_payload_sha(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.sha2(payload(["c_custkey", "c_mktsegment"]), 256).alias("fingerprint"))


@query("hashdiff_changes", f"""WITH {_CUST} SELECT count(*) AS changed FROM day1 a JOIN day2 b ON a.customer_id = b.customer_id WHERE a.email IS DISTINCT FROM b.email OR a.address IS DISTINCT FROM b.address""")
def hashdiff_changes(spark, folder) -> DataFrame:
    a = _day(spark, folder, True).select("customer_id", hashdiff(["email", "address"]).alias("a"))
    b = _day(spark, folder, False).select("customer_id", hashdiff(["email", "address"]).alias("b"))
    return a.join(b, "customer_id").agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("changed"))


# ---------------------------------------------------------------- fact keys


def _members(spark, folder) -> DataFrame:
    """The customers on file, one row each."""
    return _day(spark, folder, False).select(hash_key(payload(["customer_id"]), "portable").alias("sk"), "customer_id", "email", "address")


def _resolved(spark, folder) -> DataFrame:
    return fct.resolve_keys(_order_facts(spark, folder), _members(spark, folder), {"customer_id": "customer_id"}, {"customer_sk": "sk"}, not_applicable=F.col("status") == "cancelled")


_SKEY = _MD5KEY.format("'customer_id:' || d.customer_id")
_RESOLVED = f"""{_HEADS}, resolved AS (SELECT h.order_id, h.customer_id, h.status, CASE WHEN h.status = 'cancelled' THEN -2 WHEN h.customer_id IS NULL THEN -1 WHEN d.customer_id IS NULL THEN -3 ELSE {_SKEY} END AS customer_sk
  FROM heads h LEFT JOIN day2 d ON d.customer_id = h.customer_id)"""


@query("broker_standard", f"WITH {_CUST}, {_RESOLVED} SELECT order_id, customer_sk FROM resolved")
def broker_standard(spark, folder) -> DataFrame:
    return _resolved(spark, folder).select("order_id", "customer_sk")


@query("broker_members", f"WITH {_CUST}, {_RESOLVED} SELECT CASE WHEN customer_sk IN (-1, -2, -3, -4) THEN customer_sk ELSE 0 END AS member, count(*) AS facts FROM resolved GROUP BY 1")
def broker_members(spark, folder) -> DataFrame:
    member = F.when(F.col("customer_sk").isin(-1, -2, -3, -4), F.col("customer_sk")).otherwise(0)
    return _resolved(spark, folder).groupBy(member.alias("member")).agg(F.count(F.lit(1)).alias("facts"))


@query("broker_resolution_stats", f"WITH {_CUST}, {_RESOLVED} SELECT count(*) AS total, CAST(sum((customer_sk NOT IN (-1, -2, -3, -4))::INT) AS BIGINT) AS resolved, sum((customer_sk NOT IN (-1, -2, -3, -4))::INT) / count(*) AS rate FROM resolved")
def broker_resolution_stats(spark, folder) -> DataFrame:
    return fct.resolution_stats(_resolved(spark, folder), "customer_sk")


@query("broker_distinct_resolution", f"""WITH {_CUST}, {_RESOLVED} SELECT count(DISTINCT customer_id) AS given, count(DISTINCT CASE WHEN customer_sk NOT IN (-1, -2, -3, -4) THEN customer_id END) AS resolved
FROM resolved WHERE customer_id IS NOT NULL AND customer_sk <> -2""")  # fmt: skip
def broker_distinct_resolution(spark, folder) -> DataFrame:
    """Distinct customers that orders name, and those of orders that got a key."""
    n = fct.unmatched_identities(_resolved(spark, folder), ["customer_id"], "customer_sk")
    return spark.createDataFrame([(n["given"], n["resolved"])], "given bigint, resolved bigint")


@query("broker_missing", f"WITH {_CUST}, {_HEADS} SELECT customer_id, min(moment) AS first_us FROM heads WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM day2) GROUP BY 1")
def broker_missing(spark, folder) -> DataFrame:
    return fct.missing_members(_order_facts(spark, folder), _members(spark, folder), {"customer_id": "customer_id"}, first="at").select("customer_id", us("__first").alias("first_us"))


#: Orders without a version of their customer, by the version that starts next; a skeleton for each, which ends there.
_EARLY = f"""lonely AS (SELECT h.customer_id, h.moment, (SELECT min(c.moment) FROM chain c WHERE c.customer_id = h.customer_id AND c.moment > h.moment) AS until FROM (SELECT DISTINCT customer_id, moment FROM heads WHERE customer_id IS NOT NULL) h
  WHERE CASE WHEN h.moment IS NULL THEN h.customer_id NOT IN (SELECT customer_id FROM chain) AND NOT EXISTS (SELECT 1 FROM heads g WHERE g.customer_id = h.customer_id AND g.moment IS NOT NULL)
    ELSE NOT EXISTS (SELECT 1 FROM chain c WHERE c.customer_id = h.customer_id AND h.moment >= c.moment AND h.moment < coalesce(c.nxt, {HIGH_US})) END),
gaps AS (SELECT customer_id, until, min(moment) AS first FROM lonely GROUP BY 1, 2)"""


@query("broker_skeletons", f"""{_ONCE}, {_CHAIN}, {_HEADS}, {_EARLY} SELECT customer_id, 'Not Yet Available' AS email, first AS from_us, coalesce(until, {HIGH_US}) AS to_us, until IS NULL AS is_current, true AS is_skeleton FROM gaps""")
def broker_skeletons(spark, folder) -> DataFrame:
    """Inferred members for customers whom an order names when they have no version; they end where the next version starts."""
    versions = cut(_merge(None, _versions(spark, folder)), "versions")
    missing = fct.missing_members(_order_facts(spark, folder), versions, {"customer_id": "customer_id"}, "at")
    made = fct.skeletons(missing, versions, ["customer_id"], "sk", strategy="portable")
    return made.select("customer_id", "email", us("__valid_from").alias("from_us"), us("__valid_to").alias("to_us"), F.col("__is_current").alias("is_current"), F.col("__is_skeleton").alias("is_skeleton"))


@query("broker_early_facts", f"""{_ONCE}, {_CHAIN}, {_HEADS}, {_EARLY}, every AS (SELECT customer_id, moment AS a, coalesce(nxt, {HIGH_US}) AS b, false AS made FROM chain UNION ALL SELECT customer_id, first, coalesce(until, {HIGH_US}), true FROM gaps WHERE first IS NOT NULL)
SELECT made AS skeleton, count(*) AS orders FROM heads h JOIN every e ON e.customer_id = h.customer_id AND h.moment >= e.a AND h.moment < e.b GROUP BY 1""")
def broker_early_facts(spark, folder) -> DataFrame:
    """Orders by whether their customer's version is real or a skeleton: every dated order of a known customer finds exactly one."""
    versions, facts = cut(_merge(None, _versions(spark, folder)), "versions"), _order_facts(spark, folder)
    made = fct.skeletons(fct.missing_members(facts, versions, {"customer_id": "customer_id"}, "at"), versions, ["customer_id"], "sk", strategy="portable")
    whole = cut(versions.unionByName(made), "versions").withColumn("flag", F.col("__is_skeleton").cast("int"))
    found = interval_join(facts, whole, on={"customer_id": "customer_id"}, at=us("at"), start=us("__valid_from"), end=us("__valid_to"), carry=["flag"])
    return found.groupBy((F.col("flag") == 1).alias("skeleton")).agg(F.count(F.lit(1)).alias("orders"))


_IDS = """ids AS (SELECT customer_id AS s, min(customer_id) OVER (PARTITION BY email) AS c FROM day2 WHERE email IS NOT NULL)"""


def _identities(spark, folder) -> DataFrame:
    people = _day(spark, folder, False).filter("email IS NOT NULL").select("customer_id", "email")
    least = people.groupBy(F.col("email").alias("e")).agg(F.min("customer_id").alias("c"))
    pairs = people.join(least, F.col("email") == F.col("e")).filter("customer_id <> c")
    return pairs.select(F.col("customer_id").alias("source_identity"), F.col("c").alias("canonical_identity"), F.lit("1900-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit("2025-01-01").cast("timestamp_ntz").alias("valid_to"))


@query("broker_identity_map", f"""WITH {_CUST}, {_HEADS}, {_IDS} SELECT h.order_id, coalesce(i.c, h.customer_id) AS customer_id FROM heads h LEFT JOIN ids i ON i.s = h.customer_id AND i.s <> i.c AND h.moment < 1735689600000000""")
def broker_identity_map(spark, folder) -> DataFrame:
    """Customers with the same e-mail are one person until 2025: the smallest id."""
    return fct.canonical_ids(_order_facts(spark, folder), _identities(spark, folder), "customer_id", "at").select("order_id", "customer_id")


@query("identity_overlap", f"""WITH {_CUST}, p AS (SELECT customer_id, moment AS a, lead(moment) OVER (PARTITION BY customer_id ORDER BY moment, v) AS b FROM cust QUALIFY b IS NOT NULL)
SELECT customer_id AS source_identity, a AS from_us, CASE WHEN b <= a THEN 'empty' ELSE 'overlap' END AS problem FROM (SELECT *, max(b) OVER (PARTITION BY customer_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM p) WHERE b <= a OR a < latest""")
def identity_overlap(spark, folder) -> DataFrame:
    """Map entries from one customer row to the next; repeated rows give empty ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("customer_id").orderBy("at", "_commit_version")
    rows = customers(spark, folder).withColumn("b", F.lead("at").over(w)).filter("b IS NOT NULL")
    entries = rows.select(F.col("customer_id").alias("source_identity"), F.lit(-1).alias("canonical_identity"), F.col("at").alias("valid_from"), F.col("b").alias("valid_to"))
    return fct.identity_overlaps(entries).select("source_identity", F.col("valid_from").alias("from_us"), "problem")


@query("broker_fanout", f"WITH {_CUST}, {_HEADS}, n AS (SELECT customer_id, count(*) AS n FROM cust GROUP BY 1 HAVING count(*) > 1) SELECT h.order_id, CAST(sum(n) AS BIGINT) AS matches FROM heads h JOIN n ON n.customer_id = h.customer_id GROUP BY 1")
def broker_fanout(spark, folder) -> DataFrame:
    return fct.fanout(_order_facts(spark, folder), customers(spark, folder), {"customer_id": "customer_id"}, ["order_id"])


def _opened(spark, folder) -> DataFrame:
    facts = fct.resolve_keys(_order_facts(spark, folder).dropDuplicates(["order_id"]), _day(spark, folder, True).select(hash_key(payload(["customer_id"]), "portable").alias("sk"), "customer_id"), {"customer_id": "customer_id"}, {"customer_sk": "sk"})
    return fct.unresolved_registry(None, facts, fact="orders", relationship="customer", grain=["order_id"], key="customer_sk", batch="b1")


_UNRES = """h AS (SELECT order_id, max(customer_id) AS customer_id FROM order_headers GROUP BY 1),
opened AS (SELECT order_id, customer_id FROM h WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM day1))"""
_GRAIN = "sha256('{\"order_id\":' || order_id || '}')"


@query("unresolved_open", f"WITH {_CUST}, {_UNRES} SELECT {_GRAIN} AS grain_hash, CAST(-3 AS BIGINT) AS member, 'OPEN' AS status FROM opened")
def unresolved_open(spark, folder) -> DataFrame:
    return _opened(spark, folder).select("grain_hash", "member", "status")


@query("unresolved_resolved", f"WITH {_CUST}, {_UNRES} SELECT {_GRAIN} AS grain_hash, CASE WHEN customer_id IN (SELECT customer_id FROM day2) THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN customer_id IN (SELECT customer_id FROM day2) THEN 'b2' END AS closed_batch FROM opened")
def unresolved_resolved(spark, folder) -> DataFrame:
    facts = fct.resolve_keys(_order_facts(spark, folder).dropDuplicates(["order_id"]), _members(spark, folder), {"customer_id": "customer_id"}, {"customer_sk": "sk"})
    after = fct.unresolved_registry(_opened(spark, folder), facts, fact="orders", relationship="customer", grain=["order_id"], key="customer_sk", batch="b2")
    return after.select("grain_hash", "status", "closed_batch")


# ---------------------------------------------------------------- members, junk, policies, masking


@query("junk_dimension", f"SELECT DISTINCT {_MD5KEY.format('concat_ws(chr(0), l_returnflag, l_linestatus)')} AS junk_sk, l_returnflag, l_linestatus FROM lineitem")
def junk_dimension(spark, folder) -> DataFrame:
    return dim.junk_dimension(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "junk_sk", "portable")[0]


@query("junk_fact_fk", f"SELECT {_MD5KEY.format('concat_ws(chr(0), l_returnflag, l_linestatus)')} AS junk_sk, count(*) AS facts FROM lineitem GROUP BY 1")
def junk_fact_fk(spark, folder) -> DataFrame:
    combos, facts = dim.junk_dimension(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "junk_sk", "portable")
    return facts.join(combos.select("junk_sk"), "junk_sk").groupBy("junk_sk").agg(F.count(F.lit(1)).alias("facts"))


@query("default_members", """SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT k, n, n FROM (VALUES (-1, 'Missing'), (-2, 'Not Applicable'), (-3, 'Not Yet Available'), (-4, 'Bad Value')) t(k, n)""")
def default_members(spark, folder) -> DataFrame:
    once = dim.seeded(table(spark, folder, "customer"), "c_custkey")
    return dim.seeded(once, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("null_policy", "SELECT customer_id, coalesce(first_name, 'Missing') AS first_name, coalesce(last_name, 'Missing') AS last_name, coalesce(email, 'Missing') AS email, coalesce(address, 'None') AS address, coalesce(updated_at, 'Missing') AS updated_at FROM customers")
def null_policy(spark, folder) -> DataFrame:
    return fd.null_policy(table(spark, folder, "customers"), ["customer_id"], {"address": "None"}).drop("_commit_version")


@query("null_identities", "SELECT count(*) AS refused FROM customers WHERE customer_id IS NULL")
def null_identities(spark, folder) -> DataFrame:
    return fd.null_identities(table(spark, folder, "customers"), ["customer_id"]).agg(F.count(F.lit(1)).alias("refused"))


@query("pii_mask", "SELECT customer_id, CASE WHEN address IS NOT NULL THEN substr(address, 1, 5) || '**********' END AS address, CASE WHEN email IS NOT NULL THEN '##########' END AS email FROM customers")
def pii_mask(spark, folder) -> DataFrame:
    rows = table(spark, folder, "customers").select("customer_id", "address", "email")
    return fd.mask_columns(rows, {"address": {"method": "mask", "prefix": 5}, "email": {"method": "mask", "char": "#"}, "gone": {"method": "drop"}})


@query("pii_null", "SELECT customer_id, CAST(NULL AS VARCHAR) AS email FROM customers")
def pii_null(spark, folder) -> DataFrame:
    return fd.mask_columns(table(spark, folder, "customers").select("customer_id", "email"), {"email": {"method": "null"}})


@query("pii_drop", "SELECT customer_id, first_name FROM customers")
def pii_drop(spark, folder) -> DataFrame:
    return fd.mask_columns(table(spark, folder, "customers").select("customer_id", "first_name", "email"), {"email": {"method": "drop"}})


@query("pii_fast_hash", "SELECT count(*) AS n, count(email) AS given, count(DISTINCT email) AS different FROM customers")
def pii_fast_hash(spark, folder) -> DataFrame:
    rows = fd.mask_columns(table(spark, folder, "customers").select("email", F.col("email").alias("h")), {"h": {"method": "fast_hash"}})
    return rows.agg(F.count("h").alias("n"), F.count("email").alias("given"), F.count_distinct(F.when(F.col("email").isNotNull(), F.col("h"))).alias("different"))


_SECRET = "a-test-secret"
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("pii_tokenize", f"SELECT customer_id, CASE WHEN email IS NOT NULL THEN sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(email)))) END AS email FROM customers")
def pii_tokenize(spark, folder) -> DataFrame:
    return fd.mask_columns(table(spark, folder, "customers").select("customer_id", "email"), {"email": {"method": "tokenize", "secret": _SECRET}})


@query("unpivot_eav", "SELECT customer_id, unnest(['email', 'address']) AS field, unnest([email, address]) AS value FROM customers")
def unpivot_eav(spark, folder) -> DataFrame:
    return fd.unpivot(table(spark, folder, "customers"), "customer_id", ["email", "address"])


@query("adaptive_prune", "SELECT o_orderkey, o_orderstatus FROM orders")
def adaptive_prune(spark, folder) -> DataFrame:
    return fd.prune(table(spark, folder, "orders"), ["o_orderstatus"], ["o_orderkey"])


@query("schema_evolve", "SELECT c_custkey, c_name, 'Missing' AS email, 0 AS points FROM customer")
def schema_evolve(spark, folder) -> DataFrame:
    target = table(spark, folder, "customer").select("c_custkey", "c_name")
    return fd.evolve(target, spark.createDataFrame([], "c_custkey bigint, email string, points int, __x int"), fill=True)


# ---------------------------------------------------------------- facts


@query("fact_upsert", _HALVES + " SELECT status, count(*) AS orders FROM (SELECT CASE WHEN b.order_id IS NULL THEN a1.status ELSE b.status END AS status FROM a1 FULL JOIN b ON a1.order_id = b.order_id WHERE b.t IS NULL OR b.t <> 'delete') GROUP BY 1")
def fact_upsert(spark, folder) -> DataFrame:
    return scd1_delete_hard(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


@query("fact_append", "SELECT order_id, status FROM order_feed WHERE _change_type <> 'update_preimage'")
def fact_append(spark, folder) -> DataFrame:
    """An append-only fact takes every row of the feed but before-images."""
    return fd.append_rows(fd.changes_between(table(spark, folder, "order_feed"), 0)).select("order_id", "status")


@query("periodic_snapshot", "SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total FROM orders GROUP BY ALL")
def periodic_snapshot(spark, folder) -> DataFrame:
    measures = {"orders": F.count(F.lit(1)), "total": F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("decimal(38,2)")}
    return fct.periodic_snapshot(table(spark, folder, "orders").withColumnRenamed("o_custkey", "customer"), ["customer"], "o_orderdate", "month", measures)


@query("accumulating_snapshot", """WITH e AS (SELECT user_id, event_type, min(ts) AS t, ts < TIMESTAMP '2024-01-15' AS early FROM events GROUP BY 1, 2, 4)
SELECT user_id, epoch_us(coalesce(min(t) FILTER (event_type = 'signup' AND early), min(t) FILTER (event_type = 'signup' AND NOT early))) AS signup, epoch_us(coalesce(min(t) FILTER (event_type = 'purchase' AND early), min(t) FILTER (event_type = 'purchase' AND NOT early))) AS purchase FROM e GROUP BY 1""")
def accumulating_snapshot(spark, folder) -> DataFrame:
    """First sign-up and purchase of each user, the earlier half of the events first."""
    events = table(spark, folder, "events")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    reached = lambda rows: rows.groupBy("user_id").agg(*[F.min(F.when(F.col("event_type") == m, us("ts"))).alias(m) for m in ("signup", "purchase")])
    return fct.accumulate(reached(events.filter(early)), reached(events.filter(~early)), ["user_id"], ["signup", "purchase"])


@query("measure_semi_additive", """WITH p AS (SELECT o_custkey AS customer, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS balance, count(*) AS orders FROM orders GROUP BY ALL)
SELECT customer, arg_max(balance, period) AS balance, CAST(sum(orders) AS BIGINT) AS orders FROM p GROUP BY 1""")
def measure_semi_additive(spark, folder) -> DataFrame:
    snapshot = periodic_snapshot(spark, folder).withColumnRenamed("total", "balance")
    rolled = fct.roll_up(snapshot, ["customer"], {"balance": ("sum", "semi_additive"), "orders": ("sum", "additive")}, "period")
    return rolled.select("customer", F.col("balance").cast("decimal(38,2)").alias("balance"), "orders")


@query("role_playing_dates", """SELECT coalesce(a.y, b.y) AS year, coalesce(a.n, 0) AS ordered, coalesce(b.n, 0) AS shipped FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY 1) b ON a.y = b.y""")
def role_playing_dates(spark, folder) -> DataFrame:
    """One date dimension in two roles."""
    ordered = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("ordered"))
    shipped = table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("shipped"))
    return fd.full_outer(ordered, shipped, ["year"]).select("year", F.coalesce("ordered", F.lit(0)).alias("ordered"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


@query("sql_transform", "SELECT n_name AS nation, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_transform(spark, folder) -> DataFrame:
    """A table's own SQL over its sources."""
    sources = {a: table(spark, folder, t) for a, t in (("o", "orders"), ("c", "customer"), ("n", "nation"))}
    return fd.user_sql(spark, sources, "SELECT n_name AS nation, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total FROM o JOIN c ON o_custkey = c_custkey LEFT JOIN n ON c_nationkey = n_nationkey GROUP BY 1")


# ---------------------------------------------------------------- quality and contracts


@query("dq_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark, folder) -> DataFrame:
    return dq.duplicate_groups(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("topk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 5")
def topk_duplicates(spark, folder) -> DataFrame:
    return dq.top_duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_grain", "SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM order_headers GROUP BY order_id HAVING count(*) > 1)")
def dq_grain(spark, folder) -> DataFrame:
    return dq.duplicate_groups(table(spark, folder, "order_headers"), ["order_id"]).agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("surplus"))


@query("dq_nk", "SELECT customer_id, updated_at, count(*) AS n FROM customers GROUP BY 1, 2 HAVING count(*) > 1")
def dq_nk(spark, folder) -> DataFrame:
    return dq.duplicate_groups(table(spark, folder, "customers"), ["customer_id", "updated_at"])


@query("dq_not_null", "SELECT order_id, status FROM order_headers WHERE customer_id IS NULL")
def dq_not_null(spark, folder) -> DataFrame:
    return dq.not_null(table(spark, folder, "order_headers"), "customer_id").select("order_id", "status")


@query("dq_accepted", "SELECT order_id, status FROM order_headers WHERE status NOT IN ('Placed', 'Processing', 'Shipped', 'Delivered')")
def dq_accepted(spark, folder) -> DataFrame:
    return dq.accepted_values(table(spark, folder, "order_headers"), "status", ["Placed", "Processing", "Shipped", "Delivered"]).select("order_id", "status")


@query("dq_relationships", "SELECT order_id, customer_id FROM order_headers o WHERE customer_id IS NOT NULL AND customer_id NOT IN (-1, -2, -3, -4) AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id)")
def dq_relationships(spark, folder) -> DataFrame:
    return dq.relationships(table(spark, folder, "order_headers"), "customer_id", table(spark, folder, "customers"), "customer_id").select("order_id", "customer_id")


@query("dq_fk_orphans", "SELECT DISTINCT CAST(customer_id AS BIGINT) AS key FROM order_headers WHERE customer_id IS NOT NULL AND customer_id NOT IN (-1, -2, -3, -4) AND customer_id NOT IN (SELECT customer_id FROM customers WHERE customer_id IS NOT NULL)")
def dq_fk_orphans(spark, folder) -> DataFrame:
    return dq.orphan_keys(table(spark, folder, "order_headers"), "customer_id", table(spark, folder, "customers"), "customer_id").select(F.col("key").cast("bigint").alias("key"))


@query("dq_expression", "SELECT l_orderkey, l_quantity FROM lineitem WHERE NOT (l_quantity < 45 AND l_discount >= 0)")
def dq_expression(spark, folder) -> DataFrame:
    return dq.expression(table(spark, folder, "lineitem"), "l_quantity < 45 AND l_discount >= 0").select("l_orderkey", "l_quantity")


@query("approx_unique", "SELECT count(DISTINCT o_orderkey) >= 0.97 * count(*) AS unique_order, count(DISTINCT o_custkey) >= 0.97 * count(*) AS unique_customer FROM orders")
def approx_unique(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    a = dq.approximately_unique(orders, ["o_orderkey"], 0.97).select(F.col("ok").alias("unique_order"))
    return a.join(F.broadcast(dq.approximately_unique(orders, ["o_custkey"], 0.97).select(F.col("ok").alias("unique_customer"))), F.lit(True), "left")


@query("contract_rules", """SELECT 'customer_given' AS rule, count(*) FILTER (customer_id IS NULL) AS failed, count(*) AS total, count(*) FILTER (customer_id IS NULL) = 0 AS ok FROM order_headers
UNION ALL SELECT 'dates_mostly', count(*) FILTER (order_date IS NULL), count(*), count(*) FILTER (order_date IS NULL) <= 0.05 * count(*) FROM order_headers
UNION ALL SELECT 'status_known', count(*) FILTER (status NOT IN ('Placed', 'Shipped')), count(*), count(*) FILTER (status NOT IN ('Placed', 'Shipped')) = 0 FROM order_headers
UNION ALL SELECT 'ids_positive', count(*) FILTER (NOT (customer_id > 0)), count(*), count(*) FILTER (NOT (customer_id > 0)) = 0 FROM order_headers""")
def contract_rules(spark, folder) -> DataFrame:
    rules = [
        dq.Rule("customer_given", "not_null", "customer_id"),
        dq.Rule("dates_mostly", "null_rate", "order_date", limit=0.05),
        dq.Rule("status_known", "accepted_values", "status", values=["Placed", "Shipped"]),
        dq.Rule("ids_positive", "expression", sql="customer_id > 0"),
    ]
    return dq.scalar_rules(table(spark, folder, "order_headers"), rules)


@query("contract_unique", "SELECT CAST(sum(n - 1) AS BIGINT) AS failed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def contract_unique(spark, folder) -> DataFrame:
    return dq.unique_rule(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).select("failed")


@query("contract_unique_samples", """SELECT '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 ORDER BY count(*) DESC, key LIMIT 5""")
def contract_unique_samples(spark, folder) -> DataFrame:
    """The keys that a failed uniqueness rule shows: the five most repeated."""
    return dq.unique_rule(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.explode("samples").alias("key"))


@query("temporal_findings", f"""WITH {_FEED}, f AS (SELECT *, lag(moment) OVER (PARTITION BY order_id ORDER BY v, moment, t, status) AS p FROM (SELECT DISTINCT order_id, moment, v, NULL AS t, NULL AS status FROM feed)),
s AS (SELECT order_id, max(moment) AS m FROM feed WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1)
SELECT count(*) FILTER (moment < {_CUT_US}) AS late, count(*) FILTER (moment < p) AS disorder, count(*) FILTER (moment < m) AS cross_batch FROM f LEFT JOIN s ON s.order_id = f.order_id""")
def temporal_findings(spark, folder) -> DataFrame:
    feed = order_feed(spark, folder)
    early = feed.filter(F.col("_commit_timestamp") < F.lit(CUT).cast("timestamp_ntz")).select("order_id", ntz_of_us(F.col("at")).alias("at"), "_commit_version")
    state = dq.latest_per_key(early, ["order_id"], "at", "_commit_version")
    rows = feed.select("order_id", ntz_of_us(F.col("at")).alias("at"), "_commit_version").distinct()
    return dq.temporal_findings(rows, ["order_id"], "at", "_commit_version", now=F.lit("2024-06-02").cast("timestamp_ntz"), lateness="1 DAY", state=state)


@query("temporal_state_merge", f"WITH {_FEED} SELECT order_id, max(moment) AS max_event_us, max(v) AS max_version FROM feed GROUP BY 1")
def temporal_state_merge(spark, folder) -> DataFrame:
    feed = order_feed(spark, folder)
    early = F.col("_commit_timestamp") < F.lit(CUT).cast("timestamp_ntz")
    part = lambda rows: dq.latest_per_key(rows, ["order_id"], "at", "_commit_version")
    state = dq.merged_state(part(feed.filter(early)), part(feed.filter(~early)), ["order_id"])
    return state.select("order_id", F.col("max_event").alias("max_event_us"), "max_version")


# ---------------------------------------------------------------- storage, control and streams


def _landed(spark, folder, name: str) -> tuple[object, DataFrame]:
    """A versioned table in shared storage with the customers as the loads until the cut, then all loads, left them."""
    from orrery.sources.versioned import VersionedTable

    first, last = _day(spark, folder, True), _day(spark, folder, False)
    table_ = VersionedTable(spark, fresh_path(spark, name)).create(first.schema)
    table_.commit(first, append=True)
    merged = dim.overwrite_merge(table_.snapshot(), last, ["customer_id"])
    kind = F.when(F.col("__action") == "update", "update_postimage").otherwise(F.col("__action"))
    feed = merged.filter("__action <> 'keep'").withColumn("_change_type", kind)
    table_.commit(dim.applied(merged).drop("__is_deleted"), feed)
    return table_, last


@query("scan_full", f"WITH {_CUST} SELECT customer_id, email, address FROM day2")
def scan_full(spark, folder) -> DataFrame:
    return _landed(spark, folder, "scan")[0].snapshot().select("customer_id", "email", "address")


@query("scan_time_travel", f"WITH {_CUST} SELECT customer_id, email, address FROM day1")
def scan_time_travel(spark, folder) -> DataFrame:
    return _landed(spark, folder, "travel")[0].snapshot(1).select("customer_id", "email", "address")


@query("scan_cdf", f"""WITH {_CUST} SELECT d2.customer_id, CASE WHEN d1.customer_id IS NULL THEN 'insert' ELSE 'update_postimage' END AS change_type, CAST(2 AS BIGINT) AS version FROM day2 d2 LEFT JOIN day1 d1 ON d1.customer_id = d2.customer_id
WHERE d1.customer_id IS NULL OR d1.email IS DISTINCT FROM d2.email OR d1.address IS DISTINCT FROM d2.address""")  # fmt: skip
def scan_cdf(spark, folder) -> DataFrame:
    rows = fd.changes_between(_landed(spark, folder, "cdf")[0].changes(2, 2), 2)
    return rows.select("customer_id", F.col("_change_type").alias("change_type"), F.col("_commit_version").alias("version"))


@query("scan_append", f"WITH {_CUST} SELECT customer_id, email, address FROM day1")
def scan_append(spark, folder) -> DataFrame:
    return fd.append_rows(_landed(spark, folder, "append")[0].changes(1, 1)).select("customer_id", "email", "address")


@query("sink_system_columns", f"""WITH {_CUST} SELECT 'customer' AS kind, customer_id, email, false AS is_deleted FROM day2
UNION ALL SELECT 'member', k, n, false FROM (VALUES (-1, 'Missing'), (-2, 'Not Applicable'), (-3, 'Not Yet Available'), (-4, 'Bad Value')) t(k, n)""")
def sink_system_columns(spark, folder) -> DataFrame:
    """A type-1 dimension as a run leaves it: the customers and the reserved members, with the columns that the engine adds."""
    from orrery.plans.config import TableSpec
    from orrery.plans.pipeline import Warehouse

    warehouse = Warehouse(spark, fresh_path(spark, "created"), strategy="portable")
    rows = _day(spark, folder, False)
    warehouse.table("customers").create(rows.schema).commit(rows, append=True)
    warehouse.run(TableSpec(table_name="dim_customer", table_type="dimension", surrogate_key="sk", natural_keys=["customer_id"], sources=[{"name": "customers"}]))
    kind = F.when(F.col("sk").isin(-1, -2, -3, -4), "member").otherwise("customer")
    return warehouse.table("dim_customer").snapshot().select(kind.alias("kind"), "customer_id", "email", F.col("__is_deleted").alias("is_deleted"))


@query("scan_cdf_restored", f"""WITH {_CUST}, changed AS (SELECT d2.customer_id, d1.customer_id IS NULL AS fresh FROM day2 d2 LEFT JOIN day1 d1 ON d1.customer_id = d2.customer_id
  WHERE d1.customer_id IS NULL OR d1.email IS DISTINCT FROM d2.email OR d1.address IS DISTINCT FROM d2.address)
SELECT customer_id, CASE WHEN fresh THEN 'delete' ELSE 'update_postimage' END AS change_type FROM changed""")  # fmt: skip
def scan_cdf_restored(spark, folder) -> DataFrame:
    """What the feed says after the second load was undone."""
    landed = _landed(spark, folder, "restored")[0]
    version = landed.restore(1, keys=["customer_id"])
    return fd.changes_between(landed.changes(version), version).select("customer_id", F.col("_change_type").alias("change_type"))


@query("merge_touched_buckets", f"WITH {_CUST} SELECT customer_id, email, address FROM day2")
def merge_touched_buckets(spark, folder) -> DataFrame:
    """The second load merged into a table with buckets: only those that hold changed customers are rewritten."""
    from orrery.sources.versioned import VersionedTable

    first, last = _day(spark, folder, True), cut(_day(spark, folder, False), "load")
    target = VersionedTable(spark, fresh_path(spark, "buckets")).create(first.schema, {"buckets": {"by": ["customer_id"], "n": 64}, "keys": ["customer_id"]})
    target.commit(first, append=True)
    before = target.snapshot()
    changed = last.join(before, [last[c].eqNullSafe(before[c]) for c in last.columns], "left_anti")
    touched = target.touched(changed)
    merged = cut(dim.overwrite_merge(target.snapshot(buckets=touched), changed, ["customer_id"]), "merged")
    target.commit(dim.applied(merged).drop("__is_deleted"), replace=touched)
    return target.snapshot().select("customer_id", "email", "address")


@query("control_table_progress", """WITH i AS (SELECT lower(trim(replace(target_table, '`', ''))) AS t, lower(trim(replace(source_table, '`', ''))) AS s, batch_id, updated_at, batch_completed_at, upper(trim(batch_status)) AS st, last_processed_version AS v FROM etl_control),
b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY t, s, batch_id ORDER BY updated_at DESC, batch_completed_at IS NOT NULL DESC) = 1),
w AS (SELECT t, s, v FROM b WHERE st = 'SUCCESS' QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY updated_at DESC) = 1)
SELECT DISTINCT b.t AS target_table, b.s AS source_table, w.v AS watermark FROM b LEFT JOIN w ON w.t = b.t AND w.s = b.s""")
def control_table_progress(spark, folder) -> DataFrame:
    from orrery.operators.incremental import watermarks

    return watermarks(table(spark, folder, "etl_control"))


def _streamed(spark, folder, per_version: bool) -> DataFrame:
    from orrery.plans.config import TableSpec
    from orrery.plans.pipeline import Warehouse
    from orrery.streaming.feeds import run_stream

    warehouse = Warehouse(spark, fresh_path(spark, "streamed"), strategy="portable")
    source = warehouse.table("customers")
    rows = _versions(spark, folder).select("customer_id", "email", "address", "eff")
    source.create(rows.schema)
    source.commit(rows.filter(F.col("eff") < F.lit(CUT).cast("timestamp_ntz")), append=True)
    source.commit(rows.filter(F.col("eff") >= F.lit(CUT).cast("timestamp_ntz")), append=True)
    spec = TableSpec(
        table_name="dim_customer", table_type="dimension", scd_type=2, surrogate_key="sk", natural_keys=["customer_id"], effective_at="eff", track_history_columns=["address", "email"],
        sources=[{"name": "customers", "cdc_strategy": "cdf", "primary_keys": ["customer_id", "eff"], "streaming": True}],
    )
    summary = run_stream(warehouse, spec, per_version=per_version)
    if summary.errors:
        raise RuntimeError(summary.errors[0])
    return _shown(warehouse.table("dim_customer").snapshot().filter("sk NOT IN (-1, -2, -3, -4)"))


@query("stream_final_state", f"{_ONCE}, {_CHAIN} {_SHOW}")
def stream_final_state(spark, folder) -> DataFrame:
    """The dimension after its change feed was streamed: what one batch gives."""
    return _streamed(spark, folder, False)


@query("stream_per_version", f"{_ONCE}, {_CHAIN} {_SHOW}")
def stream_per_version(spark, folder) -> DataFrame:
    return _streamed(spark, folder, True)
