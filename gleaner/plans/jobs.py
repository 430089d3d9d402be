"""End-to-end jobs with their reads and writes (JOB-1, JOB-2, JOB-3, JOB-5).

These are what a scheduler calls: read the tables, run the plan, write the
results. Tables are Parquet directories; the ``jobs`` table is appended per
run (one directory per run id, so a retried run overwrites its own output
and never duplicates rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decide import FilterConfig
from ..sources.logs import number_lines, read_log, write_lines
from ..sources.sinks import append_hashes, new_jobs, stored_hashes, updated_rows
from ..sources.updates import current_rows, read_updates, write_update
from .collection import collection_run, dry_run, plan, run_log, touch_sources
from .rundiff import run_diff
from .second_pass import page_details, pending_pages


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_jobs(spark: SparkSession, jobs_path: str) -> DataFrame | None:
    return spark.read.parquet(jobs_path) if _exists(spark, jobs_path) else None


def run_collection(spark: SparkSession, sources: DataFrame, postings: DataFrame, jobs_path: str,
                   log_path: str, sources_out: str, cfg: FilterConfig, run_id: int, run_ts: Column,
                   source_id: int | None = None, hashes_table: str | None = None, buckets: int = 200) -> DataFrame:
    """JOB-1: decide against the stored jobs, append the accepted rows
    (``jobs_path/run_id=N``), append the run log and write the re-stamped
    sources. Returns the per-source results. ``hashes_table`` names the catalog table
    of stored hashes, which is probed in place of the jobs and kept up to date; give
    it from the first run on, with as many ``buckets`` as shuffle partitions."""
    # a retried run must not count its own earlier output as stored
    if hashes_table is not None:
        stored = stored_hashes(spark, hashes_table, run_id)
    else:
        current = read_jobs(spark, jobs_path)
        stored = current.where(F.col("run_id") != run_id).select("url_hash") if current is not None else None
    decided, results = collection_run(sources, postings, stored, cfg, source_id, land=True)
    written = f"{jobs_path}/run_id={run_id}"
    new_jobs(decided, run_ts).write.mode("overwrite").parquet(written)
    if hashes_table is not None:
        append_hashes(spark.read.parquet(written), hashes_table, run_id, buckets)
    results = results.persist()
    run_log(results, run_id, run_ts).write.mode("overwrite").parquet(f"{log_path}/run_id={run_id}")
    touch_sources(sources, results, run_ts).write.mode("overwrite").parquet(sources_out)
    return results


def current_jobs(spark: SparkSession, jobs_path: str, updates_path: str, before: int | None = None) -> DataFrame | None:
    """The stored jobs as they stand: the rows that runs appended, with the latest updates."""
    jobs = read_jobs(spark, jobs_path)
    return None if jobs is None else current_rows(jobs, read_updates(spark, updates_path, "url_hash", before), "url_hash")


def run_second_pass(spark: SparkSession, jobs_path: str, updates_path: str, details: DataFrame, version: int,
                    run_ts: Column) -> DataFrame:
    """JOB-2: complete pending rows from second-pass details; only the rows that change
    are written, as version ``version``. A repeated pass writes the same version again."""
    jobs = current_jobs(spark, jobs_path, updates_path, before=version)
    write_update(updated_rows(jobs, details, run_ts), updates_path, version)
    return current_jobs(spark, jobs_path, updates_path)


def run_second_pass_from_pages(spark: SparkSession, sources: DataFrame, jobs_path: str, updates_path: str,
                               pages: DataFrame, version: int, run_ts: Column) -> DataFrame:
    """JOB-2 from landed detail pages ``(url, fetch_no, html, error)``."""
    jobs = current_jobs(spark, jobs_path, updates_path, before=version)
    platforms = plan(sources).select(F.col("id").alias("source_id"), "platform")
    details = page_details(pending_pages(jobs, platforms, pages))
    return run_second_pass(spark, jobs_path, updates_path, details, version, run_ts)


def export_decisions(decided: DataFrame, lines_out: str) -> None:
    """The decision lines as text, numbered in run order (source, then place in it)."""
    from ..operators.decide import decision_line
    lines = decided.select("source_order", "ord", decision_line(F.col("source_company"), F.col("decision"), F.col("reason"),
                                                                F.col("title")).alias("line"))
    write_lines(number_lines(lines, ["source_order", "ord", "line"]), lines_out)


def run_dry(sources: DataFrame, postings: DataFrame, cfg: FilterConfig, lines_out: str | None = None):
    """JOB-3: decisions and counters; optionally the decision lines as text."""
    decided, counters = dry_run(sources, postings, cfg)
    if lines_out:
        export_decisions(decided, lines_out)
    return decided, counters


def run_dry_from_payloads(sources: DataFrame, payloads: DataFrame, cfg: FilterConfig, now: Column,
                          lines_out: str | None = None):
    """JOB-3 from landed payload rows; optionally the decision lines as text."""
    from .payload_runs import dry_run as payload_dry_run
    decided, counters = payload_dry_run(sources, payloads, cfg, now)
    if lines_out:
        export_decisions(decided, lines_out)
    return decided, counters


def diff_logs(spark: SparkSession, run1_path: str, run2_path: str, numbered: bool = True) -> DataFrame:
    """JOB-5 on two exported decision logs."""
    a = read_log(spark, run1_path, numbered).select(F.lit(1).alias("run_id"), "line_no", "line")
    b = read_log(spark, run2_path, numbered).select(F.lit(2).alias("run_id"), "line_no", "line")
    return run_diff(a.unionByName(b))
