"""Curated-table sinks: SNK-1 new jobs, SNK-2 second-pass details, SNK-3
failures, PRJ-3 job projection, JN-6 / JN-7 (pending restriction and update
join), FLT-16.

Parquet has no row-level UPDATE, so SNK-2/3 give the changed rows, which
``updates`` keeps as small files by version beside the ``jobs`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import reportable
from ..functions.salary import extract_salary
from ..functions.text import cut, strip
from .updates import current_rows

JOB_COLUMNS = ["source_id", "title", "job_url", "url_hash", "company", "location", "job_type", "salary",
               "description", "requirements", "role", "scrape_status", "scraped_at"]


def requirements_json(req: Column) -> Column:
    """JSN-4: requirement lines as JSON array text (NULL when none). Spark
    writes compact JSON (no blank after commas) and raw UTF-8."""
    return F.when(F.size(req) > 0, F.to_json(req))


def _col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _cut(c: Column, cap: int | None) -> Column:
    return c if cap is None else cut(c, cap)


def as_job(accepted: DataFrame, run_ts: Column, location_cap: int | None = None) -> DataFrame:
    """PRJ-3 / SNK-1: the 13 inserted columns of an accepted posting.

    Status ``scraped`` when the description is nonblank, else ``pending``;
    salary falls back to the description text; location cut to
    ``location_cap`` characters when given;
    ``scraped_at`` only when described; company = detail company else source
    company; requirements kept as JSON text (JSN-4)."""
    desc = _col_or_null(accepted, "description")
    has_desc = F.coalesce(strip(desc) != "", F.lit(False))
    salary = _col_or_null(accepted, "salary")
    salary = F.when(F.coalesce(salary, F.lit("")) != "", salary).when(has_desc, extract_salary(desc))
    req = _col_or_null(accepted, "requirements", "array<string>")
    return accepted.select(
        "source_id", "title", F.col("url").alias("job_url"), "url_hash",
        F.coalesce(F.when(_col_or_null(accepted, "company") != "", _col_or_null(accepted, "company")),
                   F.col("source_company")).alias("company"),
        F.when(F.col("location") != "", _cut(F.col("location"), location_cap)).alias("location"),
        _col_or_null(accepted, "job_type").alias("job_type"),
        salary.alias("salary"),
        F.when(has_desc, desc).alias("description"),
        requirements_json(req).alias("requirements"),
        "role",
        F.when(has_desc, F.lit("scraped")).otherwise(F.lit("pending")).alias("scrape_status"),
        F.when(has_desc, run_ts).alias("scraped_at"))


def new_jobs(decided: DataFrame, run_ts: Column, location_cap: int | None = None) -> DataFrame:
    """SNK-1: jobs to append from a decided run."""
    return as_job(decided.where(F.col("step") == "added"), run_ts, location_cap)


def pending_details(details: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN-6: second pass only touches rows pending from pass 1 (left semi)."""
    pending = jobs.where(F.col("scrape_status") == "pending").select("url_hash")
    return details.join(pending, "url_hash", "left_semi")


def updated_rows(jobs: DataFrame, details: DataFrame, run_ts: Column, error_cap: int | None = None) -> DataFrame:
    """SNK-2 + SNK-3 via JN-7: the rows that second-pass details change, whole.

    details: url_hash, location, job_type, salary, description, error. Only rows
    pending from pass 1 are touched (JN-6). A row with ``error`` is marked failed
    (error cut to ``error_cap`` when given); otherwise location, job_type, salary are
    ``COALESCE(new, old)``, description is replaced and the status is scraped / failed
    by the description (Q17)."""
    d = details.select(
        "url_hash", F.col("location").alias("_loc"), F.col("job_type").alias("_jt"), F.col("salary").alias("_sal"),
        F.col("description").alias("_desc"), F.col("error").alias("_err"))
    j = jobs.where(F.col("scrape_status") == "pending").join(d, "url_hash")
    err, upd = F.col("_err").isNotNull(), F.col("_err").isNull()
    described = F.coalesce(strip(F.col("_desc")) != "", F.lit(False))
    new = {"location": F.when(upd, F.coalesce("_loc", "location")).otherwise(F.col("location")),
           "job_type": F.when(upd, F.coalesce("_jt", "job_type")).otherwise(F.col("job_type")),
           "salary": F.when(upd, F.coalesce("_sal", "salary")).otherwise(F.col("salary")),
           "description": F.when(upd, F.col("_desc")).otherwise(F.col("description")),
           "scrape_status": F.when(upd & described, F.lit("scraped")).otherwise(F.lit("failed")),
           "scraped_at": run_ts, "scrape_error": F.when(err, _cut(F.col("_err"), error_cap))}
    columns = [*jobs.columns, *(["scrape_error"] if "scrape_error" not in jobs.columns else [])]
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def apply_details(jobs: DataFrame, details: DataFrame, run_ts: Column, error_cap: int | None = None) -> DataFrame:
    """The jobs after SNK-2 and SNK-3: untouched rows, and those of ``updated_rows``."""
    return current_rows(jobs, updated_rows(jobs, details, run_ts, error_cap), "url_hash")


def reported_errors(details: DataFrame) -> DataFrame:
    """FLT-16: detail errors worth a warning (not containing '406')."""
    return details.where(reportable(F.col("error")))


def append_jobs_table(df: DataFrame, table: str, buckets: int) -> None:
    """SNK-1 into a catalog table bucketed and sorted by ``url_hash``: later
    runs read the stored hashes already partitioned for the dedup join
    (JN-1), so the history is not shuffled again. Use as many buckets as the
    job's shuffle partitions."""
    (df.write.mode("append").format("parquet").bucketBy(buckets, "url_hash").sortBy("url_hash")
       .saveAsTable(table))


def append_hashes(accepted: DataFrame, table: str, run_id: int, buckets: int) -> None:
    """The URL hashes that a run stored, into a catalog table partitioned by run and
    bucketed by ``url_hash``. A repeated run replaces its own hashes. Write it after the
    run's jobs: a hash must not be known before its job is."""
    spark = accepted.sparkSession
    rows = accepted.select("url_hash", F.lit(run_id).cast("long").alias("run_id"))
    if not spark.catalog.tableExists(table):
        (rows.limit(0).write.format("parquet").partitionBy("run_id").bucketBy(buckets, "url_hash")
         .sortBy("url_hash").saveAsTable(table))
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (run_id = {int(run_id)})")
    rows.write.mode("append").insertInto(table)


def stored_hashes(spark: SparkSession, table: str, but_run: int) -> DataFrame | None:
    """The hashes that other runs than ``but_run`` stored, as bucketed by ``append_hashes``."""
    if not spark.catalog.tableExists(table):
        return None
    return spark.table(table).where(F.col("run_id") != but_run).select("url_hash")
