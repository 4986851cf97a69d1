"""Parent-child links to full hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orrery.runtime import counted_cut, cut, drop_cut


def latest_links(rows: DataFrame, node: str, parent: str, instant: str) -> DataFrame:
    """One link per node: (id, parent), ``parent`` NULL where it is NULL or no node of the table.

    The row with the latest ``instant`` counts; rows without an instant count only where a node has
    no other; of rows with the same instant the largest parent counts, NULL being smallest. Rows with a
    NULL node are left out. The latest row is found by a maximum, which Spark combines before it
    shuffles, so that a node with very many rows is no burden.
    """
    newest = (
        rows.filter(F.col(node).isNotNull())
        .groupBy(F.col(node).alias("id"))
        .agg(F.max(F.struct(F.col(instant).isNotNull(), F.col(instant), F.col(parent).alias("p"))).alias("m"))
        .select("id", F.col("m.p").alias("parent"))
    )
    newest = cut(newest, "links")
    known = newest.select(F.col("id").alias("known"))
    return newest.join(known, newest["parent"] == known["known"], "left").select("id", F.col("known").alias("parent"))


#: Levels that one frontier join may span.
STRIDE = 32


def _descend(links: DataFrame, start: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Level-wise frontier joins: ``start`` (id, root, depth, path) and all that hangs below it.

    ``links`` has the nodes with a parent that aren't in ``start``. Each node first learns its nearest ancestors, up to ``stride`` of them or to the start node its chain meets, by
    doubling, so that a frontier join carries paths over that many levels: the frontier, the nodes reached last, is joined with the nodes whose farthest known ancestor lies in it.
    A node joins once. Joins: the depth / ``stride`` + the logarithm of ``stride``, fewer for shallow trees. Both sides have one row per node; an ancestor of very many nodes is a skewed join partition, which adaptive
    execution splits (there is one row to match).
    """
    up = links.select("id", F.array("parent").alias("up"), F.col("parent").alias("far"))
    known, more, left = 1, True, -1
    while known < stride and more:
        step = up.select(F.col("id").alias("mid"), F.col("up").alias("on"), F.col("far").alias("beyond"))
        last = up
        # chains that met a start node are shorter than ``known`` and stay as they are
        farther = up.join(step, up["far"] == step["mid"], "left").select("id", F.when(F.col("on").isNull(), F.col("up")).otherwise(F.concat("up", "on")).alias("up"), F.coalesce("beyond", "far").alias("far"))
        grown = Observation()
        up = cut(farther.observe(grown, F.max(F.size("up")).alias("n"), F.count(F.lit(1)).alias("rows")), "ancestors")
        drop_cut(last)
        known, more, left = 2 * known, (grown.get["n"] or 0) == 2 * known, grown.get["rows"]
    levels = [start]
    while True:
        frontier = levels[-1].select(F.col("id").alias("above"), "root", "depth", F.col("path").alias("path"))
        between = F.reverse(F.slice("up", 1, F.size("up") - 1)).cast("array<string>")
        below = up.join(frontier, up["far"] == frontier["above"]).select(
            "id", "root", (F.col("depth") + F.size("up")).alias("depth"), F.concat_ws("/", "path", between, F.col("id").cast("string")).alias("path")
        )
        below, n = counted_cut(below, "level")
        left -= n
        if n:
            levels.append(below)
        if not n or not left:  # no node joins any more, or all have
            return reduce(DataFrame.unionByName, levels)


def _on_loops(links: DataFrame) -> DataFrame:
    """(id, loop) of every node of ``links`` that lies on a loop; ``loop`` is the loop's smallest id.

    Every node of ``links`` has a parent in ``links``, so every chain of parents ends in a loop. Chains are
    followed by doubling: after round k, ``far`` is the node 2^k steps up and ``least`` the smallest id among
    the first 2^k. Once the set of far nodes no longer shrinks it is the set of nodes that repeat, i.e. that lie on
    loops, and once ``least`` no longer changes on them it is the loop's smallest id. Rounds: the logarithm of the longest chain.
    """
    jump = cut(links.select("id", F.col("parent").alias("far"), F.col("id").alias("least")), "jump")
    ends = -1
    while True:
        step = jump.select(F.col("id").alias("mid"), F.col("far").alias("far2"), F.col("least").alias("least2"))
        doubled = jump.join(step, jump["far"] == step["mid"]).select(
            "id", F.col("far2").alias("far"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell")
        )
        doubled = cut(doubled, "jump")
        now = doubled.agg(F.count_distinct("far").alias("ends"), F.max(F.col("fell").cast("int")).alias("fell")).first()
        drop_cut(jump)
        jump = doubled.select("id", "far", "least")
        jump._orrery_path = doubled._orrery_path  # noqa: SLF001
        if now["ends"] == ends and not now["fell"]:
            break
        ends = now["ends"]
    repeated = jump.select(F.col("far").alias("id")).distinct()
    return jump.join(repeated, "id", "left_semi").select("id", F.col("least").alias("loop"))


def hierarchy(rows: DataFrame, node: str, parent: str, instant: str, stride: int = STRIDE) -> DataFrame:
    """Every node with its place: (id, root, depth, path, chain).

    * A node whose parent is NULL or not on file is a root: depth 0.
    * ``path`` has the ids from root to node joined by ``/``.
    * On a loop (its own parent included): depth -1. Not on it but with a loop above: depth -2. Both have the
      loop's smallest id as root and path ``''``; ``chain`` still has the ids from the loop's node to the node.

    Empty input gives an empty result. Other columns of ``rows`` are ignored, whatever their names.
    """
    links = cut(latest_links(rows, node, parent, instant), "links")
    roots = links.filter(F.col("parent").isNull()).select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    linked = links.filter(F.col("parent").isNotNull())
    reached = _descend(linked, roots, stride)
    trees = reached.withColumn("chain", F.col("path"))
    lost, n = counted_cut(linked.join(reached.select("id"), "id", "left_anti"), "lost")
    if not n:
        return trees
    loops = cut(_on_loops(lost), "loops")
    start = loops.select("id", F.col("loop").alias("root"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"))
    hanging = _descend(lost.join(loops.select("id"), "id", "left_anti"), start, stride)
    below = hanging.select("id", "root", F.when(F.col("depth") == 0, -1).otherwise(-2).alias("depth"), F.lit("").alias("path"), F.col("path").alias("chain"))
    return trees.unionByName(below)


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node and each node above it, from ``hierarchy``'s result.

    Nodes below a loop count their ancestors up to and including the node where their chain leaves the loop; the
    members of a loop are one class (all have depth -1 and the loop's smallest id as root) and are not expanded into pairs.
    The result has one row per step of every path, which is its least size.
    """
    ids = F.split("chain", "/")
    return (
        placed.select(F.col("id").alias("descendant"), F.posexplode(ids).alias("pos", "above"), F.size(ids).alias("n"))
        .filter(F.col("pos") < F.col("n") - 1)
        .select(F.col("above").cast("bigint").alias("ancestor"), F.col("descendant").cast("bigint"), (F.col("n") - 1 - F.col("pos")).alias("distance"))
    )
