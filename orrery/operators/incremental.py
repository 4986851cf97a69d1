"""Processing only new or changed records, with state that survives failures."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.runtime import cut, delete, fresh_path, refuse_object_store


class KeyHashState:
    """Key and content hash of every record already processed, as numbered versions below a folder.

    A version is a Parquet table ``v=N`` and takes effect with the marker file ``_live/N``, which is created exclusively:
    of two runs that swap at once one fails, and a run that dies before its marker leaves the former version in force; what it claimed is free again after ``patience`` seconds.
    A claim that was taken over is noticed by its first owner, who fails before anything of the new owner's is touched: every run writes into a folder of its own,
    whose name the marker holds. Needs a file system with exclusive create (local, HDFS and the like); object stores are refused.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], patience: float = 60.0):
        self.spark, self.path, self.keys, self.patience = spark, path.rstrip("/"), keys, patience
        refuse_object_store(self.path)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def version(self) -> int:
        """The number of the version in force; 0 before the first."""
        live = self._path(f"{self.path}/_live")
        if not self._fs.exists(live):
            return 0
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(live) if x.getPath().getName().isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """Keys and ``content_hash`` in force (or of a version); None before the first version."""
        n = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self._text(f'_live/{n}')}") if n else None

    def swap(self, state: DataFrame, expected: int) -> int:
        """Write ``state`` as the version after ``expected`` and put it in force. FileExistsError if another run was first."""
        n, own = expected + 1, uuid.uuid4().hex
        folder = f"v={n}.{own}"
        state.write.parquet(f"{self.path}/{folder}")
        marker, claim = f"_live/{n}", f"_claim/{n}"
        lost = FileExistsError(f"version {n} of {self.path} was swapped in by another run")
        if self.version() != expected or not (self._exclusive(claim, own) or self._take_over(claim, marker, own)):
            delete(self.spark, f"{self.path}/{folder}")
            raise lost
        # the marker appears whole, by a rename, which fails where one is there
        part = f"_live/.{own}"
        self._exclusive(part, folder)
        if self._text(claim) != own or not self._fs.rename(self._path(f"{self.path}/{part}"), self._path(f"{self.path}/{marker}")) or self._text(marker) != folder:
            self._fs.delete(self._path(f"{self.path}/{part}"), False)
            delete(self.spark, f"{self.path}/{folder}")
            raise lost
        return n

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders of all but the newest ``keep`` versions; their markers stay. Goes back until a version that is deleted already."""
        for n in range(self.version() - keep, 0, -1):
            if not self._fs.exists(self._path(f"{self.path}/{self._text(f'_live/{n}')}")):
                break
            delete(self.spark, f"{self.path}/{self._text(f'_live/{n}')}")

    def _take_over(self, claim: str, marker: str, own: str) -> bool:
        """Whether a claim is dead (old, and its version never came into force) and could be claimed anew."""
        at = self._path(f"{self.path}/{claim}")
        if self._fs.exists(self._path(f"{self.path}/{marker}")) or not self._fs.exists(at) or time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 < self.patience:
            return False
        self._fs.delete(at, False)
        return self._exclusive(claim, own)

    def _exclusive(self, name: str, text: str) -> bool:
        """Create a file that isn't there; False if it is."""
        try:
            out = self._fs.create(self._path(f"{self.path}/{name}"), False)
        except Exception as e:  # noqa: BLE001 - py4j wraps the file system's own class
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
        finally:
            stream.close()


def content_hash(columns: list[str]) -> Column:
    """BIGINT hash of several columns in which NULL differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def hashed_records(rows: DataFrame, keys: list[str], content: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows once per key with ``content_hash``; NULL keys are kept as a key.

    With ``order`` a key's latest row counts (the largest ``order`` columns, then the largest hash). Without, its rows have no order and the
    hash is one of the set of its different contents: whatever content is added or disappears changes it, repeated rows don't.
    """
    hashed = rows.select(*keys, *(order or []), content_hash(content).alias("__h"))
    if order:
        return hashed.groupBy(*keys).agg(F.max(F.struct(*order, "__h")).alias("__m")).select(*keys, F.col("__m.__h").alias("content_hash"))
    # different contents of a key: summed as decimals, since a sum of BIGINT might overflow
    once = hashed.groupBy(*keys, "__h").agg(F.lit(1).alias("__one"))
    summed = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("__h").cast("decimal(20,0)")).alias("__s"), F.first("__h").alias("__h"))
    return summed.select(*keys, F.when(F.col("__n") == 1, F.col("__h")).otherwise(F.xxhash64("__n", "__s")).alias("content_hash"))


def _same(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[f"__s_{k}"])
    return out


def new_or_changed(rows: DataFrame, keys: list[str], content: list[str], state: DataFrame | None, order: list[str] | None = None) -> DataFrame:
    """Keys and ``content_hash`` of the records that ``state`` lacks or holds with other content. An empty table has none.

    Rows are combined per key before the join (see ``hashed_records``), so a key with many rows is one row there, and an older row of a key never hides a newer one.
    """
    current = hashed_records(rows, keys, content, order)
    if state is None:
        return current
    known = state.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("content_hash").alias("__s_hash"))
    joined = current.join(known, _same(keys, current, known), "left")
    return joined.filter(F.col("__s_hash").isNull() | (F.col("__s_hash") != F.col("content_hash"))).select(*keys, "content_hash")


def merged_state(state: DataFrame | None, processed: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with the processed records added or replaced."""
    if state is None:
        return processed.select(*keys, "content_hash")
    both = state.select(*keys, "content_hash", F.lit(0).alias("n")).unionByName(processed.select(*keys, "content_hash", F.lit(1).alias("n")))
    return both.groupBy(*keys).agg(F.max(F.struct("n", "content_hash")).alias("m")).select(*keys, F.col("m.content_hash").alias("content_hash"))


@contextmanager
def incremental_run(state: KeyHashState, rows: DataFrame, content: list[str], order: list[str] | None = None):
    """``with incremental_run(state, rows, content) as todo:`` gives the new and changed records and, if the body ends well, swaps the state.

    If the body fails the state stays as it was, and the next run gives the same records again; after the swap none of them.
    """
    n = state.version()
    before = state.read(n)
    path = fresh_path(state.spark, "todo")
    new_or_changed(rows, state.keys, content, before, order).write.parquet(path)
    todo = state.spark.read.parquet(path)
    try:
        yield todo
        state.swap(merged_state(before, todo, state.keys), n)
        state.vacuum()
    finally:
        delete(state.spark, path)


def plain_name(name: Column) -> Column:
    """A table name for comparison: no backticks, no outer blanks, lower case."""
    return F.lower(F.trim(F.translate(name, "`\t\r\n", "")))


def watermarks(control: DataFrame) -> DataFrame:
    """(target_table, source_table, watermark) of every pair in the control table's images; NULL if never successful.

    A batch ends as its image with the latest ``updated_at`` says (at the same moment a finished image counts before a
    running one); the pair's successful batch with the latest such moment gives the mark, even if lower than an earlier one.
    Rows without a name belong to no pair.
    """
    status = F.upper(F.trim(F.col("batch_status")))
    images = control.select(
        plain_name(F.col("target_table")).alias("target_table"), plain_name(F.col("source_table")).alias("source_table"), "batch_id",
        F.struct("updated_at", F.col("batch_completed_at").isNotNull().alias("done"), status.alias("status"), "last_processed_version").alias("image"),
    ).filter(F.col("target_table").isNotNull() & F.col("source_table").isNotNull())
    ended = images.groupBy("target_table", "source_table", "batch_id").agg(F.max("image").alias("image"))
    won = F.when(F.col("image.status") == "SUCCESS", F.struct("image.updated_at", "image.last_processed_version"))
    return ended.groupBy("target_table", "source_table").agg(F.max(won).alias("w")).select("target_table", "source_table", F.col("w.last_processed_version").alias("watermark"))


def pending_changes(control: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """(target_table, source_table, change_id) of every committed change that a pair has not processed, once each; processes them.

    A whole run over the state below ``path``. Where there is none yet, the pairs' watermarks say what was processed before key-and-hash state was kept: of each
    change the latest delivery at or below the pair's watermark becomes the state's first version. Then the ordinary run follows: the changes' current deliveries are
    hashed and joined with the state, those it lacks or holds with other content (the version is content, so a change delivered again above the watermark counts)
    are written out, and the state with them is swapped in. A run that dies before the swap gives the same changes again, a further run none of them.
    Uncommitted changes (NULL version) and sources of no pair have no row. NULL change ids are a change.
    """
    keys, order = ["pair", "change_id"], ["_commit_version"]
    # a row per pair; inside, a pair is the hash of its names
    marks = cut(watermarks(control).withColumn("pair", F.xxhash64("target_table", "source_table")), "marks")
    # hashed before the pairs of a source multiply its changes
    hashed = changes.filter(F.col("_commit_version").isNotNull()).select(plain_name(F.col("source_table")).alias("__source"), "change_id", "_commit_version", content_hash(["_change_type", "_commit_version", "payload"]).alias("digest"))
    committed = hashed.join(marks, F.col("__source") == F.col("source_table")).select(*keys, "_commit_version", "digest", "watermark")
    state = KeyHashState(changes.sparkSession, path, keys)
    if state.version() == 0:
        state.swap(hashed_records(committed.filter(F.col("_commit_version") <= F.col("watermark")), keys, ["digest"], order), 0)
    with incremental_run(state, committed, ["digest"], order) as todo:
        return cut(todo.join(marks, "pair").select("target_table", "source_table", "change_id"), "pending")
