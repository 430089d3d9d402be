"""JOB-1 collection run, JOB-3 dry run and their counters (AGG-1, AGG-2,
AGG-10, PRJ-4, SNK-4, SNK-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decide import FilterConfig, decide
from ..operators.routing import plan_sources
from ..sources.sources import active_sources, small_table

FILTER_STEPS = ["role", "blocked_title", "location", "department"]


def listings_of(planned: DataFrame, postings: DataFrame) -> DataFrame:
    """JN-3: attach source company/order to the postings of collectable
    sources. ``planned`` comes from ``plan(…)``: materialised and broadcast
    only after a row-count check."""
    ok = (planned.where(F.col("status") == "success")
          .select(F.col("id").alias("source_id"), F.col("company").alias("source_company"),
                  F.col("id").alias("source_order"), "platform", "extractor_type"))
    return postings.join(ok, "source_id")


def run_counters(decided: DataFrame) -> DataFrame:
    """AGG-1: found / added / filtered (blocked counts as filtered) / skipped."""
    return decided.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if(F.col("step") == "added").alias("jobs_added"),
        F.count_if(F.col("step").isin(FILTER_STEPS)).alias("jobs_filtered"),
        F.count_if(F.col("step") == "duplicate").alias("jobs_skipped"))


def run_results(planned: DataFrame, counters: DataFrame) -> DataFrame:
    """AGG-10 + SET-3: one result row per active source (skipped / failed /
    success) with its counters; failed and skipped sources count nothing."""
    c = counters.withColumnRenamed("source_id", "id")
    out = planned.join(c, "id", "left")
    zero = F.lit(0).cast("bigint")
    cols = [F.when(F.col("status") == "success", F.coalesce(F.col(k), zero)).otherwise(zero).alias(k)
            for k in ("jobs_found", "jobs_added", "jobs_filtered", "jobs_skipped")]
    return out.select(F.col("id").alias("source_id"), "company", "status", *cols, "error")


def plan(sources: DataFrame) -> DataFrame:
    """Route and check the selected sources; small by nature, so it is
    materialised once and broadcast behind a size check."""
    return small_table(plan_sources(sources))


def collection_run(sources: DataFrame, postings: DataFrame, stored: DataFrame | None,
                   cfg: FilterConfig, source_id: int | None = None, land: bool = False) -> tuple[DataFrame, DataFrame]:
    """JOB-1 (pass 1): returns (decided postings, per-source results)."""
    planned = plan(active_sources(sources, source_id))
    decided = decide(listings_of(planned, postings), cfg, stored, dedup=True, land=land)
    return decided, run_results(planned, run_counters(decided))


def run_summary(results: DataFrame) -> DataFrame:
    """PRJ-4 / AGG-8: number of sources in the run and the totals."""
    return results.agg(F.count(F.lit(1)).alias("sources_scraped"),
                       F.sum("jobs_found").alias("jobs_found"), F.sum("jobs_added").alias("jobs_added"),
                       F.sum("jobs_filtered").alias("jobs_filtered"), F.sum("jobs_skipped").alias("jobs_skipped"))


def run_log(results: DataFrame, run_id: int, run_ts: Column) -> DataFrame:
    """SNK-5: run-log rows (JS-skipped sources get no log row, Q14)."""
    return (results.where(F.col("status") != "skipped")
            .select(F.lit(run_id).cast("bigint").alias("run_id"), "source_id", "status",
                    run_ts.alias("started_at"), run_ts.alias("finished_at"),
                    "jobs_found", "jobs_added", "jobs_filtered", "jobs_skipped",
                    F.col("error").alias("error_message")))


def touch_sources(sources: DataFrame, results: DataFrame, run_ts: Column) -> DataFrame:
    """SNK-4: stamp ``last_scraped_at`` of sources whose run succeeded."""
    ok = results.where(F.col("status") == "success").select(F.col("source_id").alias("id"), F.lit(True).alias("_ok"))
    base = sources if "last_scraped_at" in sources.columns else sources.withColumn(
        "last_scraped_at", F.lit(None).cast("timestamp"))
    return (base.join(ok, "id", "left")
            .withColumn("last_scraped_at", F.when(F.col("_ok"), run_ts).otherwise(F.col("last_scraped_at")))
            .drop("_ok"))


# ----------------------------------------------------------------- dry run
def dry_run(sources: DataFrame, postings: DataFrame, cfg: FilterConfig,
            planned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """JOB-3: the cascade without the duplicate step. ``sources`` is already
    the selection (SRC-3/4/5); ``planned`` reuses routed sources from an
    earlier call. Returns (decisions, per-source + total counters)."""
    planned = planned if planned is not None else plan(sources)
    decided = decide(listings_of(planned, postings), cfg, None, dedup=False, dry_run=True)
    per_source = decided.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("step") == "added").alias("would_add"),
        F.count_if(F.col("step").isin("role", "location", "department")).alias("filtered"),
        F.count_if(F.col("step") == "blocked_title").alias("blocked"))
    return decided, dry_run_counters(planned, per_source)


def dry_run_counters(planned: DataFrame, per_source: DataFrame) -> DataFrame:
    """AGG-2: per-source counters plus a grand total (GROUPING SETS)."""
    base = planned.select(F.col("id").alias("source_id"), "company", "status").join(per_source, "source_id", "left")
    zero = F.lit(0).cast("bigint")
    base = base.select("source_id", "company", *[
        F.when(F.col("status") == "success", F.coalesce(F.col(k), zero)).otherwise(zero).alias(k)
        for k in ("found", "would_add", "filtered", "blocked")])
    agg = base.groupingSets([["source_id", "company"], []], "source_id", "company").agg(
        F.sum("found").alias("found"), F.sum("would_add").alias("would_add"),
        F.sum("filtered").alias("filtered"), F.sum("blocked").alias("blocked"),
        F.grouping_id().alias("gid"))
    return agg.select(F.when(F.col("gid") > 0, F.lit("TOTAL")).otherwise(F.col("company")).alias("company"),
                      "source_id", *[F.col(k).cast("bigint").alias(k) for k in ("found", "would_add", "filtered", "blocked")])
