"""JOB-4 discovery profile (AGG-3, AGG-4, AGG-5, AGG-9, SRT-3, SET-4) and
JOB-6 department profile (NRM-22, SRT-4).

Values are kept as rows ``(platform, company, kind, value)``, not collected
into per-company arrays, so a company with a third of all postings is just
many rows of one partial aggregate, never one unbounded list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def platform_label(extractor_type_col: str = "extractor_type"):
    """AGG-9: missing platform -> 'unknown'."""
    return F.coalesce(F.col(extractor_type_col), F.lit("unknown"))


def profile_values(listings: DataFrame) -> DataFrame:
    """AGG-3: distinct (platform, company, kind, value): locations split on
    ' | ' and stripped, departments as given; blanks dropped."""
    loc = listings.select("platform_label", "company",
                          F.lit("location").alias("kind"),
                          F.explode(F.split(F.col("location"), r" \| ")).alias("value"))
    loc = loc.withColumn("value", strip(F.col("value")))
    dep = listings.select("platform_label", "company", F.lit("department").alias("kind"),
                          F.explode(F.col("departments")).alias("value"))
    return (loc.unionByName(dep).where(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct())


def profile_counts(values: DataFrame) -> DataFrame:
    """AGG-4: distinct counts per (platform, company) and consolidated per
    platform: GROUPING SETS ((platform, company), (platform))."""
    v = values.select("platform_label", "company",
                      F.when(F.col("kind") == "location", F.col("value")).alias("loc"),
                      F.when(F.col("kind") == "department", F.col("value")).alias("dept"))
    g = v.groupingSets([["platform_label", "company"], ["platform_label"]], "platform_label", "company").agg(
        F.count_distinct("loc").alias("n_locations"), F.count_distinct("dept").alias("n_departments"))
    return g


def total_jobs(planned: DataFrame, listings: DataFrame) -> DataFrame:
    """AGG-5: listings per source (0 and the error for a failed source)."""
    n = listings.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_jobs"))
    return (planned.select(F.col("id").alias("source_id"), "company", "error", "status")
            .join(n, "source_id", "left")
            .select("source_id", "company",
                    F.when(F.col("status") == "success", F.coalesce("total_jobs", F.lit(0).cast("bigint")))
                     .otherwise(F.lit(0).cast("bigint")).alias("total_jobs"),
                    F.when(F.col("status") == "failed", F.col("error")).alias("error")))


def sources_by_platform(sources: DataFrame) -> DataFrame:
    """AGG-9: sources grouped by platform ('unknown' when missing)."""
    return sources.groupBy(platform_label().alias("platform_label")).agg(F.count(F.lit(1)).alias("n_sources"))


def consolidated(values: DataFrame, kind: str) -> DataFrame:
    """SET-4 / SRT-3: the accumulated distinct set over all sources of a
    platform, sorted (code-point order)."""
    return (values.where(F.col("kind") == kind).select("platform_label", "value").distinct()
            .orderBy("platform_label", "value"))


GH_DEPARTMENTS = "struct<departments:array<struct<id:bigint,name:string,jobs:array<string>>>>"


def greenhouse_departments(payloads: DataFrame) -> DataFrame:
    """NRM-22 / JOB-6 / SRT-4: (source, id, stripped name, number of jobs),
    id and name present, ordered by name. A board's departments may be
    landed in several chunks; the job counts are summed (partial aggregate)."""
    d = payloads.select("source_id", F.explode(F.from_json("body", GH_DEPARTMENTS)["departments"]).alias("d"))
    name = strip(F.coalesce(F.col("d.name"), F.lit("")))
    out = d.select("source_id", F.col("d.id").alias("dept_id"), name.alias("name"),
                   F.size(F.coalesce(F.col("d.jobs"), F.array().cast("array<string>"))).alias("n"))
    out = out.where(F.col("dept_id").isNotNull() & (F.col("dept_id") != 0) & (F.col("name") != ""))
    return (out.groupBy("source_id", "dept_id", "name").agg(F.sum("n").cast("int").alias("n_jobs"))
            .orderBy("name"))
