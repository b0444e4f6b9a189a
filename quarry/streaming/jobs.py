"""The measures that run as streams: ingest of changed files, activity windows, offenders, job states."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_files(files: DataFrame) -> DataFrame:
    """files (repo_id, path, content_hash, seen_at): each content of a path once, over a watermark of a day."""
    return files.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["repo_id", "path", "content_hash"])


def activity(events: DataFrame, length: str = "24 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """events (created_at, action): rows by action in tumbling windows, or sliding ones."""
    span = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return events.withWatermark("created_at", late).groupBy(span.alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def offenders(events: DataFrame, most: int, length: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """events (created_at, actor_id): actors with more than `most` rows in a window. A report; nothing is stopped."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", length).alias("w"), "actor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("w.start").alias("window_start"), "actor_id", "n")


def daily_commits(commits: DataFrame, burst_lines: int = 1500, late: str = "2 days") -> DataFrame:
    days = commits.withWatermark("committed_at", late).groupBy(F.window("committed_at", "1 day").alias("w"), "repo_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("insertions") + F.col("deletions")).alias("size"))
    return days.select(F.col("w.start").alias("day"), "repo_id", "n", "size", (F.col("size") > burst_lines).alias("burst"))


def job_states(updates: DataFrame) -> DataFrame:
    """updates (job_id, status, at): the last status of each job; for update or complete mode."""
    return updates.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def into_snapshot(files: DataFrame, path: str, checkpoint: str, parts: int = 256) -> StreamingQuery:
    """Append each micro-batch's files that the snapshot doesn't have yet: a path with a content that it had before isn't new.

    The snapshot is an index by hash of (repo_id, path) in `parts` folders, and a batch reads only the keys of the folders that it touches. A batch that is run again after a loss finds what it has written
    and adds the rest. Which folders those are, `parts` numbers at most, is all that comes to the driver."""
    key = ["repo_id", "path", "content_hash"]
    schema = files.withColumn("part", F.lit(0)).schema
    files.sparkSession.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(path)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(key).withColumn("part", F.pmod(F.xxhash64("repo_id", "path"), F.lit(parts)).cast("int")).persist()
        touched = [r.part for r in rows.select("part").distinct().collect()]
        if touched:
            known = batch.sparkSession.read.schema(schema).parquet(path).where(F.col("part").isin(touched)).select("part", *key)
            rows.join(known, ["part", *key], "left_anti").repartition("part", F.pmod(F.xxhash64("path"), F.lit(8))).select(*schema.names).write.mode("append").partitionBy("part").parquet(path)
        rows.unpersist()

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
