"""Tables that are written once and read several times."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The folder that driver and executors share. Where the session names none one is made, in one process only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="/tmp/spark-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df as a checkpoint: written to the folder that driver and executors share, its lineage cut."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet files in that folder: compressed, and readers take just the columns that they need.

    A checkpoint hands on the estimated size of its plan, which a join multiplies: in rounds of joins the planner would soon work on numbers of millions of digits. Files have their own size."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt out over all cores where its files come in fewer parts than there are cores (few files of one row group); else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def running(rows: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """rows with place (from 0, in order, nulls first) and before, the sum of value over the rows of the group that come earlier.

    A prefix sum on two levels: rows are dealt out by ranges of group and order, each range sums its own, and the sums of ranges (a row for each group and range) are added up. No group
    comes to one task, whatever share of the rows it has."""
    numbered = saved(rows).withColumn("_row", F.monotonically_increasing_id())
    keys = [F.col(c) for c in (group, *order, "_row")]
    laid = saved(numbered.repartitionByRange(*keys).withColumns({"_value": value, "_range": F.spark_partition_id()}))
    sums = laid.groupBy(group, "_range").agg(F.sum("_value").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_sum", "_n")])
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_row")
    own = laid.withColumns({"_at": F.row_number().over(inside) - 1, "_own": F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    whole = own.join(sums, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return whole.select(*rows.columns, (F.col("_n_before") + F.col("_at")).alias("place"), (F.col("_sum_before") + F.col("_own")).alias("before"))
