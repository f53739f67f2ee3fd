"""Extraction jobs as streams: states by event, stale jobs, windowed counts, idempotent replacement per document."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import own_dir

# Minutes after which a running job is given up; states in order.
STALE_MINUTES = 15
STATES = ("queued", "running", "succeeded", "failed")
# End of fixed values.


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """File stream over one table of a folder, kept as one file or as a folder of files."""
    now = spark.read.parquet(f"{folder}/{name}")
    schema, files = now.schema, now.inputFiles()
    if not files or not files[0].endswith(f"/{name}"):
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def settle(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream over all that is there and return its result table, one row per key.

    Each batch stores only the rows it changed, under its own number, so a batch that runs again replaces itself and
    none rewrites the table; the newest row of a key holds.
    """
    spark = stream.sparkSession
    base = f"{own_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    run = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/table/batch={n}"))
        .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{base}/table").parquet(f"{base}/table")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)


def job_states(events: DataFrame, job: str, when: str, state: Column) -> DataFrame:
    """Latest state of every job with its time and number of events; works on streams and tables. Events without a state are ignored."""
    e = events.withColumn("_s", state).filter("_s is not null")
    return e.groupBy(job).agg(F.max_by("_s", F.struct(when, "_s")).alias("state"), F.max(when).alias("since"), F.count("*").alias("events"))


def fail_stale(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Running jobs that started before the cut-off become failed; the rest is untouched."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("error_message", F.when(stale, F.lit("worker stopped before the job ended")).otherwise(F.col("error_message"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def windowed_counts(events: DataFrame, when: str, key: str, width: str, late: str) -> DataFrame:
    """Events per window and key; in update mode a window's state is freed, and events for it are dropped, once it ends
    more than ``late`` before the newest event of an earlier batch."""
    timed = events.withColumn(when, F.col(when).cast("timestamp"))
    return timed.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def replace_document(batch: DataFrame, _: int, path: str) -> None:
    """foreachBatch sink: rows of a document replace those of an earlier run."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)
