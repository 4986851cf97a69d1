"""Queries p1 to p7: hierarchies, point-in-time joins, change feeds, increments, intervals, histories, wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.times import OPEN_SPAN_US, instant_us, stamp_us
from orrery.operators.asof import asof_join
from orrery.operators.changes import apply_changes
from orrery.operators.hierarchy import descendants, hierarchy
from orrery.operators.history import loose, merge_history
from orrery.operators.incremental import pending_changes
from orrery.operators.intervals import periods_and_gaps
from orrery.operators.widen import field_name, widen
from orrery.queries import query, table
from orrery.runtime import cut, fresh_path


def sql_us(x: str) -> str:
    """SQL for ``instant_us``."""
    t = rf"regexp_replace(regexp_replace(trim({x}), '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3T\4:\5:\6'), '^(\d{{4}})/(\d{{2}})/', '\1-\2-')"
    part = rf"regexp_extract({t}, '([+-])(\d{{2}}):(\d{{2}})$', %d)"
    return rf"""(CASE WHEN regexp_full_match(trim({x}), '[0-9]{{9,11}}') THEN CAST(trim({x}) AS BIGINT) * 1000000
      WHEN regexp_full_match({t}, '\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:\d{{2}})?)?')
      THEN epoch_us(TRY_CAST(regexp_replace({t}, '(Z|[+-]\d{{2}}:\d{{2}})$', '') AS TIMESTAMP))
        - CASE WHEN {part % 1} = '' THEN 0 ELSE (CASE WHEN {part % 1} = '-' THEN -1 ELSE 1 END)
            * (CAST({part % 2} AS BIGINT) * 3600 + CAST({part % 3} AS BIGINT) * 60) * 1000000 END END)"""


_LINKS = f"""
WITH RECURSIVE rows AS (SELECT employee_id, manager_id, {sql_us("updated_at")} AS us FROM employees WHERE employee_id IS NOT NULL),
latest AS (SELECT employee_id AS id, manager_id AS m FROM rows
  QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY us DESC NULLS LAST, manager_id DESC NULLS LAST) = 1),
links AS (SELECT l.id, k.id AS parent FROM latest l LEFT JOIN latest k ON l.m = k.id),
tree AS (SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || '/' || CAST(l.id AS VARCHAR) FROM links l JOIN tree t ON l.parent = t.id),
lost AS (SELECT l.* FROM links l ANTI JOIN tree t ON l.id = t.id),
up AS (SELECT id, parent AS above FROM lost UNION SELECT u.id, l.parent FROM up u JOIN lost l ON u.above = l.id)
"""


@query("p1_found", _LINKS + """
, loops AS (SELECT id FROM up WHERE id = above)
SELECT id AS employee_id, root AS root_id, depth, path FROM tree
UNION ALL
SELECT u.id, min(u.above), CASE WHEN bool_or(u.above = u.id) THEN -1 ELSE -2 END, '' FROM up u JOIN loops c ON u.above = c.id GROUP BY u.id
""")  # fmt: skip
def p1_found(spark, folder) -> DataFrame:
    placed = _placed(spark, folder)
    return placed.select(F.col("id").alias("employee_id"), F.col("root").alias("root_id"), "depth", "path")


def _placed(spark, folder) -> DataFrame:
    rows = table(spark, folder, "employees").select("employee_id", "manager_id", instant_us(F.col("updated_at")).alias("us"))
    return hierarchy(rows, "employee_id", "manager_id", "us")


@query("p1_descendants", _LINKS + """
, loops AS (SELECT id FROM up WHERE id = above),
hang AS (SELECT id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM loops
  UNION ALL SELECT l.id, h.depth + 1, h.path || '/' || CAST(l.id AS VARCHAR) FROM lost l JOIN hang h ON l.parent = h.id WHERE l.id NOT IN (SELECT id FROM loops)),
every AS (SELECT id, string_split(path, '/') AS p FROM tree UNION ALL SELECT id, string_split(path, '/') FROM hang),
steps AS (SELECT id, p, unnest(range(1, len(p))) AS i FROM every)
SELECT CAST(p[i] AS BIGINT) AS ancestor, CAST(id AS BIGINT) AS descendant, CAST(len(p) - i AS INTEGER) AS distance FROM steps
""")  # fmt: skip
def p1_descendants(spark, folder) -> DataFrame:
    return descendants(_placed(spark, folder))


_VERSIONS = f"SELECT DISTINCT customer_id, {sql_us('updated_at')} AS us FROM customers WHERE customer_id IS NOT NULL"
_EVENTS = f"SELECT DISTINCT order_id, customer_id, {sql_us('order_date')} AS at FROM order_headers"


def _asof(spark, folder, *carry: str) -> DataFrame:
    orders = table(spark, folder, "order_headers").select("order_id", "customer_id", instant_us(F.col("order_date")).alias("at"))
    changes = table(spark, folder, "customers").select("customer_id", instant_us(F.col("updated_at")).alias("us"), *carry, *(["_commit_version"] if carry else []))
    return asof_join(orders.distinct(), changes, entity="customer_id", event_at="at", change_entity="customer_id", change_at="us", carry=carry, tie=["_commit_version"] if carry else [], moments=orders.select("at"))


@query("p2_found", f"""
WITH v AS ({_VERSIONS}), e AS ({_EVENTS})
SELECT e.order_id, e.customer_id, max(v.us) AS updated_at_us FROM e JOIN v ON v.customer_id = e.customer_id AND v.us <= e.at GROUP BY ALL
""")  # fmt: skip
def p2_found(spark, folder) -> DataFrame:
    return _asof(spark, folder).select("order_id", "customer_id", F.col("known_at").alias("updated_at_us"))


@query("p2_attributes", f"""
WITH v AS ({_VERSIONS}), e AS ({_EVENTS}),
f AS (SELECT e.order_id, e.customer_id, e.at, max(v.us) AS us FROM e JOIN v ON v.customer_id = e.customer_id AND v.us <= e.at GROUP BY ALL),
a AS (SELECT customer_id, {sql_us("updated_at")} AS us, email, address, _commit_version FROM customers
  QUALIFY row_number() OVER (PARTITION BY customer_id, {sql_us("updated_at")} ORDER BY _commit_version DESC NULLS LAST, email DESC NULLS LAST, address DESC NULLS LAST) = 1)
SELECT f.order_id, f.at AS order_at_us, f.customer_id, f.us AS known_at_us, a.email, a.address FROM f JOIN a ON a.customer_id = f.customer_id AND a.us = f.us
""")  # fmt: skip
def p2_attributes(spark, folder) -> DataFrame:
    """Orders with the e-mail and address known at their date, carried by the validity intervals."""
    return _asof(spark, folder, "email", "address").select("order_id", F.col("at").alias("order_at_us"), "customer_id", F.col("known_at").alias("known_at_us"), "email", "address")


@query("p3_found", f"""
WITH f AS (SELECT order_id, lower(trim(status)) AS status, coalesce({sql_us("updated_at")}, epoch_us(_commit_timestamp)) AS us, _commit_version AS v, _change_type = 'delete' AS gone
  FROM order_feed WHERE order_id IS NOT NULL AND _change_type <> 'update_preimage')
SELECT order_id, status FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY us DESC, v DESC, gone DESC, status DESC NULLS LAST) = 1) WHERE NOT gone
""")  # fmt: skip
def p3_found(spark, folder) -> DataFrame:
    feed = table(spark, folder, "order_feed").filter("_change_type IN ('insert', 'update_postimage', 'delete')")
    status = F.lower(F.trim(F.col("status")))
    at = F.coalesce(instant_us(F.col("updated_at")), stamp_us(F.col("_commit_timestamp")))
    changes = feed.select("order_id", at.alias("at"), F.col("_commit_version").alias("version"), (F.col("_change_type") == "delete").alias("gone"), status.alias("status"))
    return apply_changes(changes, key="order_id", order=["at", "version", "gone"], deleted="gone", image=["status"])


def _sql_name(x: str) -> str:
    return f"lower(trim(replace({x}, '`', '')))"


@query("p4_found", f"""
WITH i AS (SELECT {_sql_name("target_table")} AS t, {_sql_name("source_table")} AS s, batch_id, updated_at, batch_completed_at, upper(trim(batch_status)) AS st, last_processed_version AS v FROM etl_control),
b AS (SELECT * FROM i WHERE t IS NOT NULL AND s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t, s, batch_id ORDER BY updated_at DESC NULLS LAST, batch_completed_at IS NOT NULL DESC, st DESC NULLS LAST, v DESC NULLS LAST) = 1),
w AS (SELECT t, s, v FROM b WHERE st = 'SUCCESS' QUALIFY row_number() OVER (PARTITION BY t, s ORDER BY updated_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
p AS (SELECT DISTINCT b.t, b.s, w.v FROM b LEFT JOIN w ON b.t = w.t AND b.s = w.s)
SELECT DISTINCT p.t AS target_table, p.s AS source_table, c.change_id FROM source_changes c JOIN p ON {_sql_name("c.source_table")} = p.s
WHERE c._commit_version IS NOT NULL AND (p.v IS NULL OR c._commit_version > p.v)
""")  # fmt: skip
def p4_found(spark, folder) -> DataFrame:
    return pending_changes(table(spark, folder, "etl_control"), table(spark, folder, "source_changes"), fresh_path(spark, "state"))


_SQL_FIELD = "replace(replace(lower(trim(field)), ' ', '_'), '-', '_')"
_SQL_SPANS = f"""SELECT surrogate_key, {_SQL_FIELD} AS field, value, valid_from, __etl_processed_at AS seen, epoch_us(valid_from) AS a,
  coalesce(epoch_us(valid_to), {OPEN_SPAN_US}) AS b FROM attribute_history WHERE valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= valid_from)"""


def _spans(spark, folder) -> DataFrame:
    rows = table(spark, folder, "attribute_history").select("surrogate_key", field_name(F.col("field")).alias("field"), "value", "valid_from", "__etl_processed_at", stamp_us(F.col("valid_from")).alias("a"), F.coalesce(stamp_us(F.col("valid_to")), F.lit(OPEN_SPAN_US)).alias("b"))
    return rows.filter("b >= a")


@query("p5_found", f"""
WITH s AS (SELECT DISTINCT surrogate_key, field, a, b FROM ({_SQL_SPANS})),
n AS (SELECT surrogate_key, field, a, b, max(b) OVER (PARTITION BY surrogate_key, field ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY surrogate_key, field ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n),
p AS (SELECT surrogate_key, field, min(a) AS from_us, max(b) AS to_us FROM g GROUP BY surrogate_key, field, island),
l AS (SELECT *, lead(from_us) OVER (PARTITION BY surrogate_key, field ORDER BY from_us) AS nxt FROM p)
SELECT 'period' AS kind, surrogate_key, field, from_us, to_us FROM p
UNION ALL SELECT 'gap', surrogate_key, field, to_us + 1, nxt - 1 FROM l WHERE nxt IS NOT NULL
""")  # fmt: skip
def p5_found(spark, folder) -> DataFrame:
    return periods_and_gaps(_spans(spark, folder), ["surrogate_key", "field"], "a", "b").select("kind", "surrogate_key", "field", "from_us", "to_us")


def _sql_loose(x: str) -> str:
    return rf"nullif(lower(regexp_replace({x}, '\s+', '', 'g')), '')"


@query("p6_found", f"""
WITH r AS (SELECT customer_id, {sql_us("updated_at")} AS us, _commit_version AS v, {_sql_loose("address")} AS a, {_sql_loose("email")} AS e FROM customers WHERE customer_id IS NOT NULL),
o AS (SELECT * FROM r WHERE us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY customer_id, us ORDER BY v DESC NULLS LAST, a DESC, e DESC) = 1),
c AS (SELECT *, lag(a) OVER w AS pa, lag(e) OVER w AS pe, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY customer_id ORDER BY us)),
k AS (SELECT * FROM c WHERE n = 1 OR a IS DISTINCT FROM pa OR e IS DISTINCT FROM pe)
SELECT customer_id, us AS valid_from_us, coalesce(lead(us) OVER (PARTITION BY customer_id ORDER BY us), 253402214400000000) AS valid_to_us FROM k
""")  # fmt: skip
def p6_found(spark, folder) -> DataFrame:
    """The first half of the loads makes the history, the rest is merged into it: changed versions are closed, new ones opened, late rows put in their place."""
    raw = table(spark, folder, "customers")
    load = F.coalesce("_commit_version", F.lit(0))
    ends = raw.agg(F.min(load), F.max(load)).first()
    middle = F.lit(((ends[0] or 0) + (ends[1] or 0)) // 2)
    rows = lambda of: raw.filter(of).select("customer_id", instant_us(F.col("updated_at")).alias("at"), "_commit_version", loose(F.col("address")).alias("address"), loose(F.col("email")).alias("email"))
    how = {"key": "customer_id", "at": "at", "tracked": ["address", "email"], "tie": ["_commit_version"]}
    first = cut(merge_history(rows(load <= middle), repeats=True, **how), "history")
    return merge_history(rows(load > middle), current=first, **how).select("customer_id", "valid_from_us", "valid_to_us")


_WIDE = {"city": "text", "credit_limit": "decimal", "loyalty_points": "integer", "is_active": "boolean", "birth_date": "date"}
_SQL_NUMBER = r"""CASE WHEN regexp_full_match(t, '[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]{1,2})?') THEN replace(t, ',', '')
  WHEN regexp_full_match(t, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,2})?') THEN t END"""
_SQL_DATE = r"""CASE WHEN regexp_full_match(lower(t), '[0-9]{4}-[0-9]{2}-[0-9]{2}([t ][0-9:.]+z?)?') THEN t[1:10]
  WHEN regexp_full_match(t, '[0-9]{8}') THEN t[1:4] || '-' || t[5:6] || '-' || t[7:8]
  WHEN regexp_full_match(t, '[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}') THEN regexp_replace(t, '([0-9]+)\.([0-9]+)\.([0-9]+)', '\3-\2-\1')
  WHEN regexp_full_match(t, '[0-9]{1,2} [A-Za-z]{3} [0-9]{4}') THEN t[-4:] || '-' || lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract(t, '[A-Za-z]{3}'))) + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(t, '^[0-9]+'), 2, '0') END"""


@query("p7_found", rf"""
WITH s AS ({_SQL_SPANS}),
l AS (SELECT surrogate_key, field, value FROM s QUALIFY row_number() OVER (PARTITION BY surrogate_key, field ORDER BY a DESC, seen DESC NULLS LAST, value DESC NULLS LAST) = 1),
v AS (SELECT surrogate_key, field, CASE WHEN lower(trim(value)) IN ('', 'n/a', 'unknown', 'none', 'null', 'tbd', '-', '?') THEN NULL ELSE trim(regexp_replace(value, '\s+', ' ', 'g')) END AS t FROM l),
c AS (SELECT surrogate_key, field, CASE field WHEN 'city' THEN t
  WHEN 'credit_limit' THEN CAST(TRY_CAST(TRY_CAST({_SQL_NUMBER} AS DOUBLE) AS DECIMAL(28,2)) AS VARCHAR)
  WHEN 'loyalty_points' THEN CASE WHEN TRY_CAST({_SQL_NUMBER} AS DOUBLE) = floor(TRY_CAST({_SQL_NUMBER} AS DOUBLE)) THEN CAST(TRY_CAST(TRY_CAST({_SQL_NUMBER} AS DOUBLE) AS BIGINT) AS VARCHAR) END
  WHEN 'is_active' THEN CASE WHEN lower(t) IN ('true','yes','y','t','1') THEN 'true' WHEN lower(t) IN ('false','no','n','f','0') THEN 'false' END
  WHEN 'birth_date' THEN CAST(TRY_CAST({_SQL_DATE} AS DATE) AS VARCHAR) END AS x FROM v)
SELECT surrogate_key, {", ".join(f"coalesce(max(CASE WHEN field = '{f}' THEN x END), '') AS {f}" for f in _WIDE)}, CAST(count(*) AS INTEGER) AS n_fields FROM c GROUP BY surrogate_key
""")  # fmt: skip
def p7_found(spark, folder) -> DataFrame:
    wide = widen(_spans(spark, folder), entity="surrogate_key", field="field", value="value", order=["a", "__etl_processed_at"], fields=_WIDE)
    return wide.select(F.col("entity").alias("surrogate_key"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in _WIDE], "n_fields")
