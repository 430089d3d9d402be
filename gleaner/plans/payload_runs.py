"""JOB-1, JOB-3 and JOB-4 from landed payload rows: normalise, attach the source,
decide. A source with a listing body that cannot be used ends as failed (AGG-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decide import FilterConfig, decide
from ..operators.normalize import normalise_all
from ..session import cut_lineage
from ..sources.sources import active_sources
from .collection import dry_run_counters, listings_of, plan, run_counters, run_results
from .discovery import platform_label, profile_counts, profile_values

POSTING = ["source_id", "ord", "title", "url", "company", "location", "departments", "job_type", "salary",
           "description", "requirements"]


def payload_postings(payloads: DataFrame, now: Column, target_locations: Sequence[str] | None = None,
                     extra: dict | None = None, convert: bool = True) -> DataFrame:
    """Postings of all payload rows. ``ord`` is their order within a source: page,
    then place on the page; a decimal, so that no two places share a number."""
    detail = normalise_all(payloads, now, target_locations, extra, convert)
    order = F.col("page_no").cast("decimal(18,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col("pos")
    return detail.withColumn("ord", order.cast("decimal(38,0)")).select(*POSTING)


# The key of a listing body that holds its rows, per platform. A body is
# an object whose key, if there, is a list; platforms not named here land pages.
ROWS_KEY = {"greenhouse": "jobs", "ashby": None, "bamboohr": "result", "workday": "jobPostings", "phenom": None,
            "oracle": "items", "netflix": "positions", "lever": None}


def payload_problem(platform: Column, body: Column) -> Column:
    """Why a listing body cannot be used, else NULL: empty, no JSON (an error page,
    a body cut short), or JSON of another shape than the platform's."""
    api = platform.isin(list(ROWS_KEY))
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    value = F.try_parse_json(body)
    rows = F.coalesce(*[F.when(platform == p, F.ltrim(F.get_json_object(body, f"$.{key}"))) for p, key in ROWS_KEY.items() if key])
    other = (platform != "lever") & (~F.ltrim(body).startswith("{") | F.coalesce(~rows.startswith("["), F.lit(False)))
    return (F.when(api & blank, "Empty payload").when(api & value.isNull(), "Unreadable payload")
            .when(api & other, "Unexpected payload"))


def unreadable_sources(payloads: DataFrame) -> DataFrame:
    """``source_id, problem`` of sources with a listing page that cannot be used; the
    first such page is named."""
    bad = payloads.where(F.col("kind") == "list").select(
        "source_id", "page_no", payload_problem(F.col("platform"), F.col("body")).alias("what")).where(F.col("what").isNotNull())
    first = bad.groupBy("source_id").agg(F.min(F.struct("page_no", "what")).alias("f"))
    return first.select("source_id", F.concat(F.col("f.what"), F.lit(" on page "), F.col("f.page_no")).alias("problem"))


def plan_with_payloads(sources: DataFrame, payloads: DataFrame) -> DataFrame:
    """The planned sources; those with a listing page that cannot be used fail."""
    planned = plan(sources).join(unreadable_sources(payloads).withColumnRenamed("source_id", "id"), "id", "left")
    failed = (F.col("status") == "success") & F.col("problem").isNotNull()
    return planned.withColumns({"error": F.when(failed, F.col("problem")).otherwise(F.col("error")),
                                "status": F.when(failed, "failed").otherwise(F.col("status"))}).drop("problem")


def collection_run(sources: DataFrame, payloads: DataFrame, stored: DataFrame | None, cfg: FilterConfig, now: Column,
                   source_id: int | None = None, extra: dict | None = None,
                   convert: bool = True) -> tuple[DataFrame, DataFrame]:
    """JOB-1 from payloads: (decided postings, per-source results)."""
    planned = plan_with_payloads(active_sources(sources, source_id), payloads)
    # the cascade reads its postings more than once: they are normalised once and landed
    postings = cut_lineage(payload_postings(payloads, now, cfg.locations, extra, convert))
    decided = decide(listings_of(planned, postings), cfg, stored, dedup=True)
    return decided, run_results(planned, run_counters(decided))


def dry_run(sources: DataFrame, payloads: DataFrame, cfg: FilterConfig, now: Column, extra: dict | None = None,
            locations: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JOB-3 from payloads: (decisions, per-source and total counters). ``locations``
    chooses the variants of a job with several; the configuration's if not given."""
    planned = plan_with_payloads(sources, payloads)
    postings = cut_lineage(payload_postings(payloads, now, locations or cfg.locations, extra, convert=False))
    decided = decide(listings_of(planned, postings), cfg, None, dedup=False, dry_run=True)
    per_source = decided.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("step") == "added").alias("would_add"),
        F.count_if(F.col("step").isin("role", "location", "department")).alias("filtered"),
        F.count_if(F.col("step") == "blocked_title").alias("blocked"))
    return decided, dry_run_counters(planned, per_source)


def discovery(sources: DataFrame, payloads: DataFrame, now: Column, extra: dict | None = None) -> DataFrame:
    """JOB-4 from payloads: distinct locations and departments per company and platform."""
    planned = plan_with_payloads(sources, payloads)
    # read for the locations and for the departments: normalised once and landed
    postings = cut_lineage(payload_postings(payloads, now, None, extra, convert=False).select("source_id", "location", "departments"))
    return profile_counts(profile_values(listings_of(planned, postings).select(
        platform_label().alias("platform_label"), F.col("source_company").alias("company"), "location", "departments")))
