"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.runtime import cut

#: File of the tokenizer's ranks, on every machine.
TOKENIZER = os.environ.get("ORRERY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pattern by which the byte-level vocabulary of 50k cuts a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters tokenized at once, more where no blank stands between two words: bounds the work on texts without end.
_PIECE = 100_000
#: Where a text can be cut without changing its tokens: before a single blank between two words, which belongs to the second.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Bits of the seeded order that one histogram resolves, and the documents that may be ordered exactly in one task.
BITS, EXACT = 10, 50_000

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """A text in pieces of at least ``size`` characters whose tokens are those of the whole."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _counter(path: str | None):
    if path is not None and not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}; name another file, or None to count blank-separated words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path) if path is not None else None
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            n = []
            for t in batch.column(at).to_pylist():
                if not t:
                    n.append(0)
                elif encoder is None:
                    n.append(len(t.split()))
                else:
                    n.append(sum(len(encoder.encode_ordinary(p)) for p in pieces(t)))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], pa.array(n, pa.int64())], names=[*[batch.schema.names[i] for i in rest], "tokens"])

    return run


def with_tokens(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str | None = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the text's size in tokens; 0 for NULL and empty texts. Whole texts are counted.

    ``tokenizer``: a file of ranks, which the driver and all executors must have (FileNotFoundError); None counts blank-separated words instead.
    """
    rows = documents.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(_counter(tokenizer), T.StructType([*[rows.schema[k] for k in keep], T.StructField("tokens", T.LongType())]))


@dataclass
class Target:
    source: str
    weight: float
    max_repeats: int


class _Flow:
    """Min-cost flow by shortest augmenting paths (Bellman-Ford); the graph has a node per pattern and source."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: float, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int, least: float) -> None:
        n = len(self.out)
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[s], todo = 0.0, [s]
            waiting = {s}
            while todo:
                x = todo.pop(0)
                waiting.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > least and far[x] + self.cost[e] < far[y] - 1e-12:
                        far[y], via[y] = far[x] + self.cost[e], e
                        if y not in waiting:
                            waiting.add(y)
                            todo.append(y)
            if via[t] < 0:
                return
            push, y = float("inf"), t
            while y != s:
                push, y = min(push, self.room[via[y]]), self.to[via[y] ^ 1]
            y = t
            while y != s:
                self.room[via[y]] -= push
                self.room[via[y] ^ 1] += push
                y = self.to[via[y] ^ 1]


def plan_mixture(patterns: dict[tuple[str, ...], int], targets: list[Target], total: float | None = None) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens that each source takes from each membership pattern: (pattern, source) -> tokens.

    ``patterns`` has the tokens of the documents that belong to exactly those sources. Each source takes up to weight x total
    (by default the tokens of all patterns that hold a target source, each pattern once per source it counts in), using a
    document at most ``max_repeats`` times. The r-th use of a pattern by a source costs r, and so does its r-th use by anyone: repetition is spread
    as evenly as the quotas allow, and fresh documents go before repeated ones.
    """
    named = {t.source: t for t in targets}
    use = {tuple(sorted(set(p) & set(named))): 0 for p in patterns}
    for p, n in patterns.items():
        use[tuple(sorted(set(p) & set(named)))] += n
    use = {p: n for p, n in use.items() if p and n}
    if total is None:
        total = float(sum(n * len(p) for p, n in use.items()))
    flow = _Flow(2 + len(use) + len(named))
    source_at = {s: 2 + len(use) + i for i, s in enumerate(named)}
    arcs: dict[tuple[tuple[str, ...], str], list[int]] = {}
    # an arc per repetition, but no more than a source's quota can fill: as costs rise the r-th is used only when those before it are full
    quota = {s: max(0.0, t.weight) * total for s, t in named.items()}
    for i, (p, n) in enumerate(use.items()):
        times = {s: min(max(0, named[s].max_repeats), int(quota[s] // n) + 1) for s in p}
        for r in range(1, sum(times.values()) + 1):
            flow.arc(0, 2 + i, n, float(r) if len(p) > 1 else 0.0)
        for s in p:
            arcs[p, s] = [flow.arc(2 + i, source_at[s], n, float(r)) for r in range(1, times[s] + 1)]
    for s in named:
        flow.arc(source_at[s], 1, quota[s], 0.0)
    flow.run(0, 1, 1e-9 * max(total, 1.0))
    return {k: sum(flow.room[e ^ 1] for e in es) for k, es in arcs.items()}


def read_targets(targets: DataFrame) -> list[Target]:
    """One target per source name (trimmed, lower case), of repeated ones the largest; NULL weights and repeats are 0. The flow has a node per source: the driver holds a row for each."""
    rows = targets.filter("source IS NOT NULL").groupBy(F.lower(F.trim("source")).alias("s")).agg(F.max(F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))).alias("t")).select("s", "t.*").collect()
    best: dict[str, Target] = {}
    for r in sorted(rows, key=lambda r: (r["weight"] or 0.0, r["max_repeats"] or 0)):
        best[r["s"]] = Target(r["s"], float(r["weight"] or 0.0), int(r["max_repeats"] or 0))
    return list(best.values())


def pattern_sizes(sized: DataFrame, members: str) -> dict[tuple[str, ...], int]:
    """Tokens per set of sources that documents belong to. Combined before the shuffle; one row per pattern that occurs."""
    rows = sized.groupBy(F.array_sort(F.array_distinct(members)).alias("p")).agg(F.sum("tokens").alias("n")).collect()
    return {tuple(r["p"]): r["n"] for r in rows if r["p"]}


def mixture_report(sized: DataFrame, members: str, targets: list[Target]) -> list[dict]:
    """Per target source: its size, quota, the tokens the plan takes, both shares, and whether the quota is reached."""
    sizes = pattern_sizes(sized, members)
    plan = plan_mixture(sizes, targets)
    size = {t.source: sum(n for p, n in sizes.items() if t.source in p) for t in targets}
    total = sum(size.values())
    taken = {t.source: sum(n for (_, s), n in plan.items() if s == t.source) for t in targets}
    mixed = sum(taken.values())
    return [
        {"source": t.source, "size": size[t.source], "quota": t.weight * total, "taken": taken[t.source], "target_share": t.weight,
         "actual_share": taken[t.source] / mixed if mixed else 0.0, "reached": t.weight * total - taken[t.source] <= 1e-6 * max(total, 1)}
        for t in targets
    ]


def select_documents(sized: DataFrame, key: str, members: str, targets: list[Target], seed: int = 17, exact: int = EXACT) -> DataFrame:
    """(key, source, copies) of ``picked_documents``."""
    return picked_documents(sized, key, members, targets, seed, exact).select(key, "source", "copies")


def selected_report(sized: DataFrame, key: str, members: str, targets: list[Target], seed: int = 17) -> list[dict]:
    """``mixture_report`` of the documents that ``select_documents`` picks: tokens taken, share and whether the quota is reached count their copies.

    Selection stops short of a quota by less than a document per pattern, so a quota is mostly not reached to the token; ``planned`` has
    the plan's tokens and ``reachable`` whether they reach the quota.
    """
    rows = picked_documents(sized, key, members, targets, seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("n")).collect()  # a row per source
    picked = {r["source"]: r["n"] or 0 for r in rows}
    mixed = sum(picked.values())
    report = mixture_report(sized, members, targets)
    total = sum(r["size"] for r in report)
    out = []
    for r in report:
        taken = picked.get(r["source"], 0)
        out.append(r | {"taken": taken, "actual_share": taken / mixed if mixed else 0.0, "reached": r["quota"] - taken <= 1e-6 * max(total, 1), "planned": r["taken"], "reachable": r["reached"]})
    return out


def _ranges(plan: dict, sizes: dict[str, float], groups: dict[tuple[str, ...], list[str]]) -> list[tuple]:
    """What each source takes of each pattern: (pattern, source, whole uses, and up to two ranges of the seeded order in tokens).

    The parts of a pattern that sources use once more follow one another around its order, so that two sources share documents only where all of them are in use.
    """
    out, offset = [], {}
    for (group, source), tokens in sorted(plan.items()):
        whole = sum(sizes[p] for p in groups[group])
        for p in groups[group]:
            full, left, w = int(tokens // whole), (tokens % whole) / whole * sizes[p], sizes[p]
            a = offset.get(p, 0.0)
            b = a + left
            offset[p] = b % w
            out.append((p, source, full, a, min(b, w), 0.0, max(0.0, b - w)))
    return out


def picked_documents(sized: DataFrame, key: str, members: str, targets: list[Target], seed: int = 17, exact: int = EXACT) -> DataFrame:
    """(key, source, copies, tokens): how often each document goes into the mixture for each source; documents not used have no row.

    A pattern's documents are used whole as often as the plan fills it; the rest of the plan's tokens is a range of the pattern's seeded order (a hash), and the ranges of
    its sources follow one another, so that no document is used twice for what fresh ones could give. A document is picked if it lies wholly in the range, so a
    source falls short of the plan by less than a document at each end of a range. Where a document lies is told by a histogram of the hash's first ten bits (1,024 cells a pattern, as a table); a cell in which a range ends
    is resolved by the next ten bits while it holds more than ``exact`` documents, and only then ordered exactly. NULL keys are left out.
    """
    from pyspark.sql import Window

    spark = sized.sparkSession
    rows = sized.filter(F.col(key).isNotNull()).select(key, F.concat_ws("\u0001", F.array_sort(F.array_distinct(members))).alias("p"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    sizes = {r["p"]: float(r["n"] or 0) for r in rows.groupBy("p").agg(F.sum("tokens").alias("n")).collect()}  # a number per pattern, as the flow needs
    named = {t.source for t in targets}
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in sorted(sizes):
        if sizes[p]:
            groups.setdefault(tuple(sorted(set(p.split("\u0001")) & named)), []).append(p)
    plan = plan_mixture({tuple(p.split("\u0001")): n for p, n in sizes.items() if p}, targets)
    shares = spark.createDataFrame(_ranges({k: n for k, n in plan.items() if n > 0}, sizes, groups), "p string, source string, full int, a double, b double, c double, d double")
    ends = shares.select("p", F.explode(F.array("a", "b", "c", "d")).alias("end")).distinct()

    def cell(depth: int) -> Column:
        return F.shiftrightunsigned("h", 64 - BITS * depth)

    def cells(part: DataFrame, depth: int) -> DataFrame:
        """The cells of a depth: where they start and end in the pattern's order, and whether a range ends inside. ``part`` has the place ``base`` where its next coarser cell starts."""
        within = Window.partitionBy("p", "base").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows
        found = part.groupBy("p", "base", cell(depth).alias("cell")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
        placed = found.withColumn("x", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("y", F.col("x") + F.col("n"))
        split = placed.join(ends, "p", "left").groupBy("p", "base", "cell", "n", "docs", "x", "y").agg(F.max(((F.col("end") > F.col("x")) & (F.col("end") < F.col("y"))).cast("int")).alias("mixed"))
        return cut(split.select("p", "cell", "docs", "x", "y", (F.coalesce("mixed", F.lit(0)) > 0).alias("mixed")), "cells")

    parts, depth, part = [], 1, rows.withColumn("base", F.lit(0).cast("bigint"))
    while True:
        known = cells(part, depth)
        last = BITS * (depth + 1) > 60
        deeper = F.col("mixed") & (F.col("docs") > exact) & F.lit(not last)
        located = part.drop("base").withColumn("cell", cell(depth)).join(known.withColumnRenamed("p", "__p"), (F.col("p") == F.col("__p")) & (cell(depth) == known["cell"])).drop("__p", known["cell"])
        within = Window.partitionBy("p", "cell").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0)
        ordered = located.filter(F.col("mixed") & ~deeper).withColumn("y", F.col("x") + F.sum("tokens").over(within)).withColumn("x", F.col("y") - F.col("tokens"))
        parts += [located.filter(~F.col("mixed")).select(key, "p", "tokens", "x", "y"), ordered.select(key, "p", "tokens", "x", "y")]
        if known.filter(deeper).limit(1).isEmpty():
            break
        part, depth = located.filter(deeper).select(key, "p", "h", "tokens", F.col("x").alias("base")), depth + 1
    placed = reduce(DataFrame.unionByName, parts)
    inside = lambda a, b: (F.col("x") >= F.col(a)) & (F.col("y") <= F.col(b))
    more = (F.col("tokens") > 0) & (inside("a", "b") | inside("c", "d"))
    picked = placed.join(shares, "p").withColumn("copies", F.col("full") + more.cast("int"))
    return picked.filter("copies > 0").select(key, "source", "copies", "tokens")
