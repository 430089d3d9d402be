"""JOB-5 run diff and JOB-7 run-log query, plus the text fixtures they read:
F5 (decisions of two dry runs), F6 (dry-run log lines) and the run log of a
collection run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as DF
from ..operators.decide import FilterConfig, decide_runs, decision_line
from ..sources.logs import log_lines, tail
from .collection import listings_of, plan

LINE_STRIDE = 1_000_000_000_000  # line numbers: source order, then posting order


def decisions(sources: DataFrame, postings: DataFrame, runs: list[tuple[int, FilterConfig]]) -> DataFrame:
    """(run_id, source_id, line_no, company, title, decision, reason) of dry runs,
    all decided in one pass over the postings."""
    decided = decide_runs(listings_of(plan(sources), postings), runs)
    return decided.select("run_id", "source_id", "source_order", "ord", (F.col("ord") * 2 + 1).alias("line_no"),
                          F.col("source_company").alias("company"), "title", "decision", "reason", "step")


def dry_run_log(dec: DataFrame) -> DataFrame:
    """the dry-run log as (run_id, line_no, line): one decision line per
    posting, plus per source a 'Found N listings' heading and a counter line
    (neither parses as a decision)."""
    lines = dec.select("run_id", "line_no", decision_line(F.col("company"), F.col("decision"),
                                                          F.col("reason"), F.col("title")).alias("line"))
    per = dec.groupBy("run_id", "source_id", "company").agg(
        F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("step") == "added").alias("would_add"),
        F.count_if(F.col("step").isin("role", "location", "department")).alias("filtered"),
        F.count_if(F.col("step") == "blocked_title").alias("blocked"))
    head = per.select("run_id", (F.col("lo") * 2).alias("line_no"),
                      F.format_string("[%s] Found %d listings", "company", "found").alias("line"))
    summ = per.select("run_id", (F.col("hi") * 2 + 2).alias("line_no"),
                      F.format_string("[%s] found=%d  would_add=%d  filtered=%d  blocked=%d",
                                      "company", "found", "would_add", "filtered", "blocked").alias("line"))
    return lines.unionByName(head).unionByName(summ)


def run_diff(lines: DataFrame) -> DataFrame:
    """JOB-5: parse both runs' lines, keep the last line per key, full outer
    join, classify. ``lines`` has run_id (1 / 2), line_no, line."""
    parsed = DF.parse_lines(lines)
    last = DF.last_per_key(parsed, ["run_id", "company", "title"])
    r1 = last.where(F.col("run_id") == 1).drop("run_id")
    r2 = last.where(F.col("run_id") == 2).drop("run_id")
    return DF.compare(r1, r2)


def run_log_lines(decided: DataFrame, results: DataFrame, ts_text: str) -> DataFrame:
    """The collection run's log (timestamped, levelled lines) as (line_no, line)."""
    prefix = F.lit(f"{ts_text},000 [INFO] ")
    msg = decision_line(F.col("source_company"), F.col("decision"), F.col("reason"), F.col("title"))
    dl = decided.select((F.col("source_order") * LINE_STRIDE + F.col("ord") * 2 + 1).alias("line_no"),
                        F.concat(prefix, msg).alias("line"))
    err = results.where(F.col("status") == "failed").select(
        (F.col("source_id") * LINE_STRIDE).alias("line_no"),
        F.concat(F.lit(f"{ts_text},000 [ERROR] ["), F.col("company"), F.lit("] Scrape failed: "), F.col("error")).alias("line"))
    skip = results.where(F.col("status") == "skipped").select(
        (F.col("source_id") * LINE_STRIDE).alias("line_no"),
        F.concat(F.lit(f"{ts_text},000 [INFO] ["), F.col("company"),
                 F.lit("] Skipping — requires_js=TRUE")).alias("line"))
    found = results.where(F.col("status") == "success").select(
        (F.col("source_id") * LINE_STRIDE).alias("line_no"),
        F.concat(F.lit(f"{ts_text},000 [INFO] ["), F.col("company"), F.lit("] Found "),
                 F.col("jobs_found").cast("string"), F.lit(" listings")).alias("line"))
    return dl.unionByName(err).unionByName(skip).unionByName(found)


def log_query(lines: DataFrame, source: str | None = None, level: str | None = None,
              filtered_only: bool = False, limit: int | None = None) -> DataFrame:
    """JOB-7: FLT-15 filters, LIM-1 tail, AGG-8 number of lines in the answer."""
    ans = tail(log_lines(lines, source, level, filtered_only), limit)
    total = ans.agg(F.count(F.lit(1)).alias("total")).scalar()
    return ans.select("*", total.alias("total"))
