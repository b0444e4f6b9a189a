"""What several operators share: reading, checkpoints, numbers of partitions."""

import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_BYTES = 8 << 20
# A model is learnt from at most so many bytes of packed features, whatever the length of the sampled texts.
MAX_FIT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where the session names none and runs in one process.

    A cluster without that setting is an error: what one machine writes in a folder of its own no other could read again."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="/tmp/spark-"))
    return context.getCheckpointDir()


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands rows to Python workers in batches of BATCH_BYTES or less (a longer row comes alone)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", conf.get(name)).group()) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def saved(df: DataFrame) -> DataFrame:
    """df, written to the folder that driver and executors share (spark.checkpoint.dir), with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """For loops of many small jobs, once a round: Spark gives up broadcasts, shuffle files and checkpoints of tables that nobody holds only when the driver's JVM collects its garbage,
    and a heap that grows over the rounds isn't given back before that either."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_part(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def sampled_labels(labels: DataFrame, train: Column, rows: int, balanced: bool = False) -> DataFrame:
    """(doc_id, y) of at most rows documents with a label in {0, 1} where train holds, picked by a hash of doc_id: small enough to broadcast.

    balanced: at most half of them of either class."""
    clean = labels.where("doc_id is not null and label in (0, 1)").where(train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("y"))
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    if balanced:
        return F.broadcast(first(clean.where("y = 1"), rows // 2).unionByName(first(clean.where("y = 0"), rows // 2)))
    return F.broadcast(first(clean, rows))


def gathered(encoded: DataFrame, max_bytes: int = MAX_FIT_BYTES):
    """(doc_id, f, y) of the sample on the driver, in order of doc_id, a document once however often its row is repeated.

    f is packed features. Documents come in order of a hash while their features have at most max_bytes together; one with more than a
    hundredth of that is passed over, so that no single text crowds out the others."""
    own = saved(encoded.groupBy("doc_id").agg(F.min(F.struct("f", "y")).alias("s")).select("doc_id", "s.f", "s.y"))
    sizes = own.select("doc_id", F.length("f").alias("n")).where(F.col("n") <= max_bytes // 100)
    ahead = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # a row for each sampled document, with its size alone
    few = sizes.withColumn("ahead", ahead).where(F.col("ahead") <= max_bytes).select("doc_id")
    return own.join(F.broadcast(few), "doc_id").toArrow().sort_by("doc_id")


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows, saved in order of group and order (nulls first), with place (from 0 within its group) and total (rows of the group).

    Rows are dealt out by ranges of all these columns, so a group that holds most rows takes many partitions; what joins the partitions are counts of rows
    by group and partition. Rows that tie in all columns come in any order."""
    keys = [F.col(c) for c in (*group, *order)]
    numbered = saved(rows).withColumn("_row", F.monotonically_increasing_id())  # so that many equal rows can be told apart
    laid = saved(numbered.repartitionByRange(*keys, F.col("_row")).sortWithinPartitions(*keys, "_row").drop("_row"))
    laid = laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = laid.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each partition that the group is in
    earlier = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_of"), (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    met = F.col("_part") == F.col("_of")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return laid.join(parts, met).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_of", "_shift", *[f"_{c}" for c in group])


def release() -> None:
    """Give freed memory of a worker, Arrow's too, back to the system, where the C library can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
