"""Run diff (JOB-5 parts): STR-30 line parsing, AGG-7 last line per key,
JN-5 full outer join, SET-1/2/5 classification, AGG-6 bucket sizes, SRT-2.

Skew: the per-key reduction uses ``max_by`` (partial aggregation, so a key
holding a third of the lines is combined map-side); after it each side has
unique keys, so the full outer join cannot skew on a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the decision-line pattern (company, decision, reason, title).
LINE_RE = r"^\[([^\]]+)\]\s+(WOULD ADD|FILTERED)\s+([^:]+):\s+'(.+)'$"
BUCKETS = ["newly_added", "newly_filtered", "reason_changed", "only_in_run1", "only_in_run2", "unchanged"]


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """STR-30: lines -> (company, decision, reason, title); others dropped.
    Lines are stripped first, as when read from a file."""
    from ..functions.text import strip
    s = strip(F.col(line_col))
    p = "(?U)" + LINE_RE
    return (lines.withColumn("_l", s).where(F.col("_l").rlike(p))
            .withColumn("company", F.regexp_extract("_l", p, 1))
            .withColumn("decision", F.regexp_extract("_l", p, 2))
            .withColumn("reason", strip(F.regexp_extract("_l", p, 3)))
            .withColumn("title", F.regexp_extract("_l", p, 4))
            .drop("_l"))


def last_per_key(parsed: DataFrame, keys: list[str] | None = None, order_col: str = "line_no") -> DataFrame:
    """AGG-7: the later line for the same (company, title) replaces the earlier."""
    keys = keys or ["company", "title"]
    last = F.max_by(F.struct("decision", "reason"), F.col(order_col))
    return parsed.groupBy(*keys).agg(last.alias("_d")).select(*keys, "_d.decision", "_d.reason")


def compare(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """JN-5 + SET-5: full outer join on (company, title) and the bucket,
    tested in the order presence -> decision flip -> reason."""
    a = run1.select("company", "title", F.col("decision").alias("decision1"), F.col("reason").alias("reason1"))
    b = run2.select("company", "title", F.col("decision").alias("decision2"), F.col("reason").alias("reason2"))
    return with_bucket(a.join(b, ["company", "title"], "full"))


def with_bucket(j: DataFrame) -> DataFrame:
    """SET-5: the bucket from the two runs' decisions and reasons."""
    bucket = (F.when(F.col("decision2").isNull(), "only_in_run1")
               .when(F.col("decision1").isNull(), "only_in_run2")
               .when((F.col("decision1") == "FILTERED") & (F.col("decision2") == "WOULD ADD"), "newly_added")
               .when((F.col("decision1") == "WOULD ADD") & (F.col("decision2") == "FILTERED"), "newly_filtered")
               .when(F.col("reason1") != F.col("reason2"), "reason_changed")
               .otherwise("unchanged"))
    return j.withColumn("bucket", bucket)


def compare_decisions(decisions: DataFrame) -> DataFrame:
    """The diff of two runs from their decisions (``run_id`` 1 and 2), without the way
    through text: no title is lost to the line pattern. One aggregate gives the last
    decision of each run per (company, title); a hot key is combined map-side."""
    def last(run: int, field: str):
        mine = F.col("run_id") == run
        return F.max_by(F.when(mine, F.col(field)), F.when(mine, F.struct("source_order", "ord")))

    return with_bucket(decisions.groupBy("company", "title").agg(
        *[last(run, field).alias(f"{field}{run}") for run in (1, 2) for field in ("decision", "reason")]))


def bucket_sizes(diff: DataFrame) -> DataFrame:
    """AGG-6: rows per bucket plus the number of keys seen in each run."""
    return diff.agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS],
        F.count_if(F.col("decision1").isNotNull()).alias("run1_jobs"),
        F.count_if(F.col("decision2").isNotNull()).alias("run2_jobs"))


def union_keys(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """SET-1: union of the (company, title) keys of two runs."""
    return run1.select("company", "title").union(run2.select("company", "title")).distinct()


def only_in(run1: DataFrame, run2: DataFrame) -> DataFrame:
    """SET-2: keys only in run 1 (anti join; call with arguments swapped for run 2)."""
    return run1.select("company", "title").join(run2.select("company", "title"), ["company", "title"], "left_anti")


def render_line(company: Column, decision: Column, reason: Column, title: Column) -> Column:
    from ..operators.decide import decision_line
    return decision_line(company, decision, reason, title)
