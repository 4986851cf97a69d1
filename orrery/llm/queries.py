"""Queries p8 to p10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.leakage import leaked_items
from orrery.llm.mixture import mixture_report, read_targets, select_documents, selected_report, with_tokens
from orrery.llm.reading import fit_languages, fit_ranker, labelled_features, reading_levels

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(f):
        LLM_QUERIES[name] = f
        if oracle:
            LLM_ORACLES[name] = oracle
        return f

    return keep


def _table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("p8_found")
def p8_found(spark, folder) -> DataFrame:
    # eight words in common are asked for: passages of fewer words have none
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "eval_id")


@_query("p8_whole_items")
def p8_whole_items(spark, folder) -> DataFrame:
    """Documents that hold a whole item's passage, verbatim or nearly (similarity of five-word shingles 0.8 or more, in a window of any length)."""
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), window=None, least=0.8)


def _sized(spark, folder) -> DataFrame:
    label = F.lower(F.trim(F.col("source")))
    rows = _table(spark, folder, "documents").filter("source IS NOT NULL").select("doc_id", F.array(label).alias("members"), "text")
    return with_tokens(rows, ["doc_id", "members"])


_SIZES = """WITH d AS (SELECT lower(trim(source)) AS source, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT lower(trim(source)) AS source, weight, max_repeats FROM mix_targets),
s AS (SELECT t.source, weight, max_repeats, coalesce(sum(n), 0) AS size FROM t LEFT JOIN d ON d.source = t.source GROUP BY ALL)
"""


@_query("p9_found", _SIZES + "SELECT source FROM s WHERE size * max_repeats < weight * (SELECT sum(size) FROM s)")
def p9_found(spark, folder) -> DataFrame:
    report = mixture_report(_sized(spark, folder), "members", read_targets(_table(spark, folder, "mix_targets")))
    return spark.createDataFrame([(r["source"],) for r in report if not r["reached"]], "source string")


@_query("p9_shares")
def p9_shares(spark, folder) -> DataFrame:
    """Per source the target and the share reached, in tokens of the documents selected; also the tokens planned and whether they reach the quota."""
    from orrery.runtime import cut

    report = selected_report(cut(_sized(spark, folder), "sized"), "doc_id", "members", read_targets(_table(spark, folder, "mix_targets")))
    rows = [(r["source"], r["size"], float(r["quota"]), float(r["taken"]), r["target_share"], float(r["actual_share"]), r["reached"], float(r["planned"]), r["reachable"]) for r in report]
    return spark.createDataFrame(rows, "source string, size bigint, quota double, taken double, target_share double, actual_share double, reached boolean, planned double, reachable boolean")


@_query("p9_selected")
def p9_selected(spark, folder) -> DataFrame:
    """How often each document goes into the mixture."""
    from orrery.runtime import cut

    return select_documents(cut(_sized(spark, folder), "sized"), "doc_id", "members", read_targets(_table(spark, folder, "mix_targets")))


def _levels(spark, folder) -> DataFrame:
    documents = _table(spark, folder, "documents")
    x, y = labelled_features(documents, _table(spark, folder, "reading_labels"))
    return reading_levels(documents, fit_ranker(x, y), keep=["doc_id", "source"], languages=fit_languages(documents)).filter("english AND words >= 40")


@_query("p10_found")
def p10_found(spark, folder) -> DataFrame:
    return _levels(spark, folder).select("doc_id", "level")


@_query("p10_profile")
def p10_profile(spark, folder) -> DataFrame:
    """English documents, their words and mean score per source and level."""
    label = F.lower(F.trim(F.col("source"))).alias("source")
    return _levels(spark, folder).groupBy(label, "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.avg("score").alias("mean_score"))
