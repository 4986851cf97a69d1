"""Lineage cuts in shared storage, and other things that need the session.

Iterative operators write intermediate tables instead of keeping them in executor memory, so that
a lost executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_FOLDERS: dict[str, str] = {}
_SCRATCH: ContextVar[str | None] = ContextVar("orrery_scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and Spark runs in one process (tests, single machine) a
    temporary folder of this machine is made and set; on a cluster that would be another disk for every executor, so there
    RuntimeError asks for the setting. The folder is deleted when Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="orrery-")
            spark.conf.set(_SETTING, base)
        _FOLDERS[app] = f"{base.rstrip('/')}/orrery-{uuid.uuid4().hex}"
        atexit.register(_delete_quietly, spark, _FOLDERS[app])
    return _FOLDERS[app]


#: Stores without exclusive create and atomic rename.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "oss", "cos", "cosn", "wasb", "wasbs", "swift")


def refuse_object_store(path: str) -> None:
    """ValueError where files can't be created exclusively and renamed at once, on which commits rest."""
    scheme = path.split("://", 1)[0] if "://" in path else ""
    if scheme in OBJECT_STORES:
        raise ValueError(f"{scheme} has no exclusive create and atomic rename; use a local, HDFS or other file system that has: {path}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder (in a ``scratch`` block, in the block's folder) that nothing uses yet."""
    return f"{_SCRATCH.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: a durable lineage cut."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orrery_path = path  # noqa: SLF001
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Within the block cuts go to a folder of their own, which is deleted at its end: for work that leaves nothing but tables elsewhere, such as a run or a micro-batch."""
    shared_folder(spark)
    app = spark.sparkContext.applicationId
    outer = _FOLDERS[app]
    own = f"{outer}/run-{uuid.uuid4().hex}"
    token = _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.reset(token)
        _delete_quietly(spark, own)


def counted_cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """A ``cut`` and its number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


#: Bytes of files up to which a written table is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def bytes_of(df: DataFrame) -> int:
    """The size of a cut's files."""
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._orrery_path)  # noqa: SLF001
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()  # noqa: SLF001


def broadcast_if_small(cut_: DataFrame, rows: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (made of a cut without joins; by default the cut itself), to be broadcast if the cut's files are no larger than ``limit``; else the join is left to Spark."""
    rows = cut_ if rows is None else rows
    return F.broadcast(rows) if bytes_of(cut_) <= limit else rows


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a cut that no later result needs."""
    if path := getattr(df, "_orrery_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may have gone already
        pass
