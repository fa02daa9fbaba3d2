"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and \t..\r.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir (or the context's checkpoint folder). Only a session with a
    local master and neither of them, as in tests, gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting, for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors lose none of it.

    The shuffle files of the write go as soon as it is done.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's own bound of an Arrow batch, and the one that is set where a session has left it.
BATCH, BATCH_HERE = "67108864b", "4m"


def give_back() -> None:
    """Free memory goes back to the system: Spark keeps a task's Python worker for tasks of other operators."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def collect_garbage(spark: SparkSession) -> None:
    """Executors' JVMs collect their garbage, too, and what of their heaps is free goes back to the system.

    A heap keeps the size that earlier work gave it, for a session's life, and with it classes of plans that are done.
    There is a short task for each core, so idle executors get one each; one that gets none keeps its memory.
    """
    n = spark.sparkContext.defaultParallelism
    done = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(done.alias("done")).write.format("noop").mode("overwrite").save()


def through(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of a few MB, however long the texts, and with nothing held after a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, BATCH) == BATCH:
        df.sparkSession.conf.set(key, BATCH_HERE)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; ids that are null count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Just (doc_id, text) and what else is asked for, whatever else docs holds."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[c.alias(n) for n, c in more.items()])


def free(df: DataFrame, name: str) -> str:
    """name, or name_ and so on: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commonest(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the greatest `by`: all from the least step of a log scale on that leaves at most `most`.

    A sorted limit would send the driver that many rows from every task; this sends about a thousand steps' totals.
    """
    step = F.floor(F.log2(F.col(by).cast("double")) * 16).cast("int")
    left, least = most, None
    for r in counts.where(F.col(by) > 0).groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return counts.where((F.col(by) > 0) & (step >= least)) if least is not None else counts.limit(0)
