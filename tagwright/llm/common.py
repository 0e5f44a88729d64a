"""Shared plumbing of the training-data operators.

Rules that every operator here follows:

* inputs are read and intermediates written by Spark only, so any store that
  Spark can open works;
* lineage is cut by tables written under ``spark.checkpoint.dir`` (shared by
  the driver and all executors), never by local checkpoints;
* words are ``[^\\x20\\x09-\\x0D]+`` - runs of anything but ASCII white space.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of the white space that separates words.
SPACE_CLASS = r"[\x20\x09-\x0D]"


_own_dirs: dict[str, str] = {}
_kept: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tagwright-")
    return _own_dirs[app]


def _own_tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tagwright/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_tables(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared table and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors' disks; what a lost executor held is computed again.

    For small results of a narrow pass that are read twice; they stay for the session, as they are read lazily. Those that
    were released elsewhere (clearCache) are let go here, else the driver would hold their plans and the broadcasts of these.
    """
    _kept[:] = [x for x in _kept if x.storageLevel.useDisk]
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def drop_tables(spark: SparkSession) -> None:
    """Removes all that ``materialize`` and ``keep`` have left for this application; for when nothing that reads them is needed any more."""
    while _kept:
        _kept.pop().unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """Array of the words of a text column; NULL text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.array_remove(parts, "")


def slim_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches small enough that long documents do not pile up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def smallest_hashes(df: DataFrame, most: int, where=None) -> DataFrame:
    """At most ``most`` rows of df(doc_id, ...): those whose doc_id has the smallest hash, if they meet ``where``.

    Rows are first cut to the share that is expected to hold them, so that the
    ordered limit gathers a bounded number of rows whatever the number of tasks.
    """
    df = df.filter("doc_id IS NOT NULL").withColumn("_h", F.xxhash64("doc_id"))
    n = df.select("doc_id").count()
    share = min(1.0, (most + 8 * most**0.5 + 50) / max(n, 1))
    few = df.filter(F.pmod(F.col("_h"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    few = few if where is None else few.filter(where)
    return few.orderBy(F.pmod(F.col("_h"), F.lit(1 << 30)), "_h", "doc_id").limit(most).drop("_h")


def release_memory() -> None:
    """Gives freed memory back to the machine; Python workers outlive their tasks and would keep it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run):
    """An Arrow function that releases memory when its partition is done."""

    def wrapped(batches):
        yield from run(batches)
        release_memory()

    return wrapped
