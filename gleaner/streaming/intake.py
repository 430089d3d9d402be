"""Incremental runs as Structured Streaming (STM-1, STM-2).

STM-1 incremental intake: landed postings arrive as files; each micro-batch
runs the decision cascade against the *current* ``jobs`` table (so a URL once
stored is never stored again, whatever its status) plus WIN-1 inside the
batch, and appends the accepted rows. The dedup state lives in the ``jobs``
table, not in the state store, so it does not grow with the stream.

STM-2 status life cycle: second-pass details arrive as files; each batch
writes the pending rows that they change (JN-6, SNK-2/3) as an update by batch id.

Both sinks are idempotent by ``batchId``: batch N always (over)writes the
same directory, so a batch replayed after a failure yields the same files.
Checkpoints go under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decide import FilterConfig, decide
from ..plans.collection import listings_of
from ..sources.sinks import append_hashes, new_jobs, stored_hashes, updated_rows
from ..sources.updates import current_rows, read_updates, write_update


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def _read_jobs(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path)


def intake_batch(planned: DataFrame, cfg: FilterConfig, jobs_path: str, run_ts: Column,
                 prior: DataFrame | None = None, hashes_table: str | None = None, buckets: int = 200):
    """foreachBatch body for STM-1. ``hashes_table``: as in ``plans.jobs.run_collection``. ``planned`` may be a function that gives the
    planned sources; it is asked for each batch, so that sources added after the
    stream's start are taken in."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sources = planned() if callable(planned) else planned
        # a replayed batch must not see its own earlier (partial) output
        if hashes_table is not None:
            stored = stored_hashes(spark, hashes_table, batch_id)
        else:
            current = _read_jobs(spark, jobs_path)
            stored = (current.where(F.col("batch_id") != batch_id).select("url_hash")
                      if current is not None else None)
        if prior is not None:
            stored = prior if stored is None else stored.unionByName(prior)
        decided = decide(listings_of(sources, batch), cfg, stored, dedup=True, land=True)
        written = f"{jobs_path}/batch_id={batch_id}"
        new_jobs(decided, run_ts).write.mode("overwrite").parquet(written)
        if hashes_table is not None:
            append_hashes(spark.read.parquet(written), hashes_table, batch_id, buckets)
    return run


def start_intake(spark: SparkSession, landing_path: str, schema, planned: DataFrame, cfg: FilterConfig,
                 jobs_path: str, checkpoint: str, run_ts: Column, prior: DataFrame | None = None,
                 files_per_batch: int = 1, available_now: bool = True):
    """STM-1: file-source stream of landed postings -> foreachBatch intake."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(landing_path))
    w = (stream.writeStream.foreachBatch(intake_batch(planned, cfg, jobs_path, run_ts, prior))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def details_batch(jobs_path: str, updates_path: str, run_ts: Column):
    """foreachBatch body for STM-2: write the rows that a batch of details changes as
    the update of its batch id, judged on the jobs as they were before this batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        jobs = latest_jobs(batch.sparkSession, jobs_path, updates_path, before=batch_id)
        if jobs is not None:
            write_update(updated_rows(jobs, batch, run_ts), updates_path, batch_id)
    return run


def latest_jobs(spark: SparkSession, jobs_path: str, updates_path: str, before: int | None = None) -> DataFrame | None:
    """The stored jobs with their latest updates (only versions below ``before`` if given)."""
    jobs = _read_jobs(spark, jobs_path)
    if jobs is None:
        return None
    return current_rows(jobs.drop("batch_id"), read_updates(spark, updates_path, "url_hash", before), "url_hash")


def start_details(spark: SparkSession, landing_path: str, schema, jobs_path: str, updates_path: str,
                  checkpoint: str, run_ts: Column, files_per_batch: int = 1, available_now: bool = True):
    """STM-2: file-source stream of second-pass details -> updates by batch."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(landing_path))
    w = (stream.writeStream.foreachBatch(details_batch(jobs_path, updates_path, run_ts))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
