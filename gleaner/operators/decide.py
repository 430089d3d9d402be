"""The decision cascade (FLT-8) with the duplicate step (JN-1 + WIN-1).

Per posting, the first failing test names the reason:
role -> blocked title -> duplicate -> location -> department -> added.

Duplicate means: the URL hash is already in ``jobs`` (JN-1), or an *earlier
accepted* posting of this run has the same hash (WIN-1; earlier = run order
``(source_order, ord)``). A posting is accepted iff it passes every test, so
"an earlier accepted twin exists" equals "an earlier twin passes role, title,
location and department" (the first such twin cannot itself be a duplicate).

Scale: instead of a window partitioned by ``url_hash`` (one task would sort
every copy of a hot URL), the earliest passing position and the stored flag
are computed by one aggregate over ``(url_hash, position)`` pairs (map-side
partial aggregation, so a URL with a third of all rows costs nothing extra).
Hashes and positions alone are grouped and joined; whole postings meet only the
positions of the duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import department_targeted, location_targeted, role_targeted, title_blocked
from ..functions.roles import classify_role
from ..functions.text import hash_url, py_list_repr, py_repr
from ..session import cut_lineage


def _parse(raw: str | None, trim: bool, lower: bool) -> list[str] | None:
    """FLT-7 for job parameters (same rules as ``functions.text.parse_list``)."""
    raw = (raw or "").strip()
    if not raw:
        return None
    out = []
    for item in raw.split("|"):
        if trim:
            item = item.strip()
        if not item:
            continue
        out.append(item.lower() if lower else item)
    return out


@dataclass(frozen=True)
class FilterConfig:
    roles: list[str] | None = None
    blocked: list[str] | None = None
    locations: list[str] | None = None
    departments: list[str] | None = None

    @classmethod
    def parse(cls, roles: str | None = None, blocked: str | None = None,
              locations: str | None = None, departments: str | None = None) -> "FilterConfig":
        return cls(roles=_parse(roles, True, False), blocked=_parse(blocked, True, True),
                   locations=_parse(locations, False, True), departments=_parse(departments, True, True))

    @classmethod
    def from_dict(cls, d: dict) -> "FilterConfig":
        return cls.parse(d.get("roles"), d.get("blocked"), d.get("locations"), d.get("departments"))


def add_flags(postings: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Role (STR-3) and the four tests (FLT-2..5) as columns."""
    with_role = postings.select("*", hash_url(F.col("url")).alias("url_hash"),
                                classify_role(F.col("title")).alias("role"))
    return with_role.select(
        "*", role_targeted(F.col("role"), cfg.roles).alias("role_ok"),
        title_blocked(F.col("title"), cfg.blocked).alias("blocked"),
        location_targeted(F.col("location"), cfg.locations).alias("location_ok"),
        department_targeted(F.col("departments"), cfg.departments).alias("department_ok"))


def _pos() -> Column:
    return F.struct(F.col("source_order").cast("bigint").alias("s"), F.col("ord").alias("o"))


def _candidates(flagged: DataFrame) -> DataFrame:
    """URL hash and position of every posting, and whether it passes the other tests."""
    return flagged.select(
        "url_hash", F.col("source_order").cast("bigint").alias("source_order"), "ord",
        (F.col("role_ok") & ~F.col("blocked") & F.col("location_ok") & F.col("department_ok")).alias("passes"))


def stored_hits(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """JN-1: the distinct hashes of this run that are stored already. The history is only
    filtered by the run's hashes: where those are few enough to be broadcast, or the
    history is bucketed by ``url_hash`` (see ``sources.sinks.append_hashes``), it is
    read once and not shuffled."""
    return stored.select("url_hash").join(candidates.select("url_hash").distinct(), "url_hash", "left_semi").distinct()


def duplicate_positions(candidates: DataFrame, stored: DataFrame | None) -> DataFrame:
    """``url_hash, source_order, ord, already_stored, earlier_twin`` of the postings that are
    duplicates: stored in an earlier run (JN-1), or after a posting of this run with
    the same URL that passes every test (WIN-1). A URL that holds a third of all rows
    is one row per task in the aggregate, and its postings go by their positions."""
    pos = F.struct(F.col("source_order").alias("s"), F.col("ord").alias("o"))
    keys = candidates.groupBy("url_hash").agg(F.min(F.when(F.col("passes"), pos)).alias("first_ok"), F.count("*").alias("n"))
    if stored is None:
        keys = keys.withColumn("stored", F.lit(None).cast("boolean"))
    else:
        keys = keys.join(stored_hits(candidates, stored).withColumn("stored", F.lit(True)), "url_hash", "left")
    # only keys that can make a duplicate meet the postings again
    keys = keys.where(F.col("stored") | (F.col("first_ok").isNotNull() & (F.col("n") > 1))).drop("n")
    twin = F.coalesce(F.col("first_ok") < pos, F.lit(False))
    out = candidates.join(keys, "url_hash").select(
        "url_hash", "source_order", "ord", F.coalesce(F.col("stored"), F.lit(False)).alias("already_stored"), twin.alias("earlier_twin"))
    return out.where("already_stored OR earlier_twin").distinct()


def mark_duplicates(flagged: DataFrame, stored: DataFrame | None, land: bool = False) -> DataFrame:
    """Adds ``already_stored`` and ``earlier_twin`` (WIN-1) flags.

    Hashes and positions alone are grouped and joined; whole postings meet the
    positions of the duplicates in the end. With ``land`` both narrow tables are
    written first, so that Spark knows their sizes when it plans: few duplicates are
    broadcast, and then no description crosses an exchange."""
    candidates = _candidates(flagged)
    candidates = cut_lineage(candidates) if land else candidates
    found = duplicate_positions(candidates, stored)
    found = cut_lineage(found) if land else found
    flags = ["already_stored", "earlier_twin"]
    found = found.select(F.col("url_hash").alias("_u"), F.col("source_order").alias("_s"), F.col("ord").alias("_o"), *flags)
    same = ((F.col("url_hash") == F.col("_u")) & (F.col("source_order").cast("bigint") == F.col("_s")) & (F.col("ord") == F.col("_o")))
    out = flagged.join(found, same, "left")
    return out.select(*flagged.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def decide(postings: DataFrame, cfg: FilterConfig, stored: DataFrame | None = None,
           dedup: bool = True, dry_run: bool = False, land: bool = False) -> DataFrame:
    """FLT-8. ``postings`` needs source_id, source_order, ord, title, url,
    location, departments. Adds url_hash, role, step, decision, reason.

    ``step`` is one of role / blocked_title / duplicate / location / department
    / added; ``decision`` is FILTERED / SKIPPED / ADDED (WOULD ADD in a dry run).
    """
    df = add_flags(postings, cfg)
    if dedup:
        df = mark_duplicates(df, stored, land)
        dup = F.col("already_stored") | F.col("earlier_twin")
    else:
        dup = F.lit(False)
    return _with_decision(df, dup, dry_run)


def decide_runs(postings: DataFrame, runs: list[tuple[int, FilterConfig]]) -> DataFrame:
    """Dry-run decisions of several configurations in one pass over the postings: a
    posting's tests under each configuration are an array, which is exploded. Columns
    as from ``decide``, and ``run_id``."""
    tests = [F.struct(F.lit(run_id).alias("run_id"), role_targeted(F.col("role"), cfg.roles).alias("role_ok"),
                      title_blocked(F.col("title"), cfg.blocked).alias("blocked"),
                      location_targeted(F.col("location"), cfg.locations).alias("location_ok"),
                      department_targeted(F.col("departments"), cfg.departments).alias("department_ok")) for run_id, cfg in runs]
    # the role is worked out below the explode, once a posting
    df = postings.select("*", classify_role(F.col("title")).alias("role")).select("*", F.explode(F.array(*tests)).alias("_t"))
    return _with_decision(df.select("*", "_t.*").drop("_t"), F.lit(False), dry_run=True)


def _with_decision(df: DataFrame, dup: Column, dry_run: bool) -> DataFrame:
    """Step, decision and reason from the flags."""
    step = (F.when(~F.col("role_ok"), "role").when(F.col("blocked"), "blocked_title").when(dup, "duplicate")
             .when(~F.col("location_ok"), "location").when(~F.col("department_ok"), "department")
             .otherwise("added"))
    df = df.select("*", step.alias("step"))
    added = "WOULD ADD" if dry_run else "ADDED"
    decision = (F.when(F.col("step") == "added", F.lit(added))
                 .when(F.col("step") == "duplicate", F.lit("SKIPPED")).otherwise(F.lit("FILTERED")))
    role_txt = F.coalesce(F.col("role"), F.lit("None"))
    reason = (F.when(F.col("step") == "role", F.concat(F.lit("role="), role_txt))
               .when(F.col("step") == "blocked_title", F.lit("blocked_title"))
               .when(F.col("step") == "duplicate", F.lit("duplicate"))
               .when(F.col("step") == "location", F.concat(F.lit("location="), py_repr(F.col("location"))))
               .when(F.col("step") == "department", F.concat(F.lit("dept="), py_list_repr(F.col("departments"))))
               .otherwise(F.concat(F.lit("role="), role_txt, F.lit(" location="), py_repr(F.col("location")))))
    return df.select("*", decision.alias("decision"), reason.alias("reason"))


def decision_line(company: Column, decision: Column, reason: Column, title: Column) -> Column:
    """STR-29: ``[Company] DECISION reason: 'title'`` (title as Python repr)."""
    return F.concat(F.lit("["), company, F.lit("] "), decision, F.lit(" "), reason, F.lit(": "), py_repr(title))
