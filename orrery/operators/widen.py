"""Attribute-value rows into wide tables by positional stitching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.runtime import broadcast_if_small, cut

#: Entities in one ordinal range: a range's columns are assembled in one task's memory.
RANGE = 50_000
#: Ranges whose first ordinals are summed up in one task.
GROUP = 10_000

_NONE = ("", "n/a", "unknown", "none", "null", "tbd", "-", "?")
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def field_name(name: Column) -> Column:
    """Lower case, outer blanks removed, inner blanks and hyphens as ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s", " "))), r"[ -]", "_")


def _said(value: Column) -> Column:
    """The trimmed value; NULL where it says there is none."""
    t = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(~F.lower(t).isin(*_NONE), t)


def as_text(value: Column) -> Column:
    """Outer blanks removed, inner ones single."""
    return _said(value)


def as_number(value: Column) -> Column:
    """DECIMAL(38,10) of a number with sign, decimals, thousands commas in their places, or exponent; else NULL."""
    t = _said(value)
    plain = F.when(t.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]{1,2})?$"), F.replace(t, F.lit(","), F.lit(""))).when(
        t.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"), t
    )
    return plain.try_cast("decimal(38,10)")


def as_decimal(value: Column) -> Column:
    """Text of a number with two decimals, halves rounded away from zero."""
    return as_number(value).try_cast("decimal(28,2)").cast("string")


def as_integer(value: Column) -> Column:
    """Text of a whole number; a number with a fraction is malformed."""
    n = as_number(value)
    return F.when(n == F.floor(n), n.try_cast("bigint").cast("string"))


def as_boolean(value: Column) -> Column:
    t = F.lower(_said(value))
    return F.when(t.isin("true", "yes", "y", "t", "1"), "true").when(t.isin("false", "no", "n", "f", "0"), "false")


def as_date(value: Column) -> Column:
    """Text ``YYYY-MM-DD`` of a real date in ISO form (a midnight time allowed), compact, day-first dotted, or with the month's name."""
    t = F.lower(_said(value))
    month = F.lpad(((F.instr(F.lit(_MONTHS), F.regexp_extract(t, r"^[0-9]{1,2} ([a-z]{3})", 1)) + 2) / 3).cast("int").cast("string"), 2, "0")
    iso = (
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([t ][0-9:.]+z?)?$"), F.regexp_extract(t, r"^[0-9-]+", 0))
        .when(t.rlike(r"^[0-9]{8}$"), F.regexp_replace(t, r"^(....)(..)(..)$", "$1-$2-$3"))
        .when(t.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.translate(t, "/", "-"))
        .when(t.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.regexp_replace(t, r"^([0-9]+)\.([0-9]+)\.([0-9]+)$", "$3-$2-$1"))
        .when(t.rlike(r"^[0-9]{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{4}$"), F.concat(F.substring(t, -4, 4), F.lit("-"), month, F.lit("-"), F.regexp_extract(t, r"^[0-9]+", 0)))
    )
    return iso.try_cast("date").cast("string")


#: kind -> (canonical text of a value, Spark type of the stitched column, Arrow type)
KINDS = {
    "text": (as_text, T.StringType(), pa.string()),
    "decimal": (as_decimal, T.DecimalType(28, 2), pa.decimal128(28, 2)),
    "integer": (as_integer, T.LongType(), pa.int64()),
    "boolean": (as_boolean, T.BooleanType(), pa.bool_()),
    "date": (as_date, T.DateType(), pa.date32()),
}


def _stitch(fields: list[str], kinds: list[str]):
    """Assembles the columns of each ordinal range by position; rows come sorted by range and entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(fields)}
        key_type, part, entity, start = None, None, None, 0
        keys, counts, columns = [], [], []

        def assemble() -> pa.RecordBatch:
            n = len(keys)
            typed = [pa.array([c.get(i) for i in range(n)], pa.string()).cast(KINDS[k][2]) for c, k in zip(columns, kinds, strict=True)]
            ordinals = pa.array(range(start, start + n), pa.int64())
            return pa.RecordBatch.from_arrays([ordinals, pa.array(keys, key_type), pa.array(counts, pa.int32()), *typed], names=["ordinal", "entity", "n_fields", *fields])

        for batch in batches:
            key_type = batch.schema.field("entity").type
            for p, at0, k, f, v in zip(*[batch.column(c).to_pylist() for c in ("part", "start", "entity", "field", "value")], strict=True):
                if p != part:
                    if keys:
                        yield assemble()
                    part, start, entity, keys, counts, columns = p, at0, None, [], [], [{} for _ in fields]
                if not keys or k != entity:
                    entity = k
                    keys.append(k)
                    counts.append(0)
                counts[-1] += 1
                if v is not None and (i := at.get(f)) is not None:
                    columns[i][len(keys) - 1] = v
        if keys:
            yield assemble()

    return run


def widen(rows: DataFrame, *, entity: str, field: str, value: str, order: list[str], fields: dict[str, str], range_size: int = RANGE) -> DataFrame:
    """One row per entity: (ordinal, entity, n_fields, a typed column for each of ``fields``: name -> kind of ``KINDS``).

    Of several rows of an entity and field the one with the largest ``order`` columns counts, NULL being smallest; if those tie, the largest value.
    Field names are compared by ``field_name``; ``n_fields`` counts an entity's different ones. Values that are NULL, malformed or
    say there is none give NULL. Rows with NULL entity or field are left out; an entity with rows but none of ``fields`` has NULL columns.

    Entities get global ordinals: a hash deals them into ranges, a range's first ordinal is the number of entities in
    the ranges before it, and within the range they follow their key. Each field becomes a typed column aligned to the
    range's ordinals and the columns are put side by side by position, so no join and no wide aggregation is needed. Rows are
    reduced to one per entity and field, combined before the shuffle, so no entity or field is a hot group.
    """
    named = rows.filter(F.col(entity).isNotNull() & F.col(field).isNotNull()).select(F.col(entity).alias("entity"), field_name(F.col(field)).alias("field"), F.struct(*order, F.col(value).alias("__value")).alias("m"))
    cells = named.groupBy("entity", "field").agg(F.max("m").alias("m")).select("entity", "field", F.col("m.__value").alias("raw"))
    typed = F.lit(None).cast("string")
    for name, kind in fields.items():
        typed = F.when(F.col("field") == name, KINDS[kind][0](F.col("raw"))).otherwise(typed)
    many = max(1, -(-named.agg(F.approx_count_distinct("entity")).first()[0] // range_size))
    laid = cut(cells.select(F.pmod(F.xxhash64("entity"), F.lit(many)).cast("int").alias("part"), "entity", "field", typed.alias("value")), "cells")
    # a row per range: where its ordinals start. Ranges are numbered in groups, so that no task holds all of them
    sizes = laid.groupBy("part").agg(F.count_distinct("entity").alias("n"))
    grouped = sizes.withColumn("g", (F.col("part") / GROUP).cast("int"))
    inside, across = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = grouped.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))  # a row per GROUP x RANGE entities
    starts = grouped.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "g").select("part", (F.col("before") + F.col("within")).alias("start"))
    starts = cut(starts, "starts")
    schema = T.StructType([
        T.StructField("ordinal", T.LongType()), T.StructField("entity", laid.schema["entity"].dataType), T.StructField("n_fields", T.IntegerType()),
        *[T.StructField(f, KINDS[k][1]) for f, k in fields.items()],
    ])
    located = laid.join(broadcast_if_small(starts), "part").select("start", "part", "entity", "field", "value")
    return located.repartition("part").sortWithinPartitions("part", "entity", "field").mapInArrow(_stitch(list(fields), list(fields.values())), schema)
