"""Row predicates of the filter cascade and page parsing (FLT-1..5, FLT-9..16).

Configuration lists are job parameters (Python lists) and become literals in
the plan, so Catalyst folds them (``ConstantFolding`` / ``OptimizeIn``).
``None`` or an empty list means "no restriction" as in the reference; NULLs
are resolved explicitly with ``coalesce`` so three-valued logic never drops a
row by accident.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# URL path fragments that mark a job link (FLT-11).
JOB_PATH_PATTERNS = [
    "/job/", "/jobs/", "/careers/", "/position/", "/positions/",
    "/opening/", "/openings/", "/role/", "/roles/", "/posting/",
    "/postings/", "/vacancy/", "/vacancies/", "/apply/",
]
# Anchor text bounds (FLT-12), thin-page guard (FLT-13).
ANCHOR_MIN, ANCHOR_MAX = 4, 120
MIN_PAGE_TEXT = 500


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def title_matches(title: Column, filters: Sequence[str] | None) -> Column:
    """FLT-1: substring (case-insensitive) or, for '^…', regex on the lower title."""
    if not filters:
        return F.lit(True)
    t = F.lower(title)
    conds = [t.rlike("(?dU)" + f) if f.startswith("^") else t.contains(f.lower()) for f in filters]
    return F.coalesce(_any(conds), F.lit(False))


def role_targeted(role: Column, roles: Sequence[str] | None) -> Column:
    """FLT-2: no targets -> accept; NULL role -> reject; else membership."""
    if not roles:
        return F.lit(True)
    return F.coalesce(role.isin(list(roles)), F.lit(False))


def title_blocked(title: Column, keywords: Sequence[str] | None) -> Column:
    """FLT-3: any keyword is a substring of the lower title."""
    if not keywords:
        return F.lit(False)
    t = F.lower(title)
    return F.coalesce(_any([t.contains(k) for k in keywords]), F.lit(False))


def location_targeted(location: Column, keywords: Sequence[str] | None) -> Column:
    """FLT-4: no targets or NULL/empty location -> accept; else substring."""
    if not keywords:
        return F.lit(True)
    loc = F.lower(location)
    return (F.coalesce(location, F.lit("")) == "") | F.coalesce(_any([loc.contains(k) for k in keywords]), F.lit(False))


def department_targeted(departments: Column, keywords: Sequence[str] | None) -> Column:
    """FLT-5 / ARR-1: no targets or no departments -> accept; else any keyword
    in any department (nested ``exists`` over two arrays)."""
    if not keywords:
        return F.lit(True)
    kws = F.array(*[F.lit(k) for k in keywords])
    hit = F.exists(departments, lambda d: F.exists(kws, lambda k: F.lower(d).contains(k)))
    return (F.coalesce(F.size(departments), F.lit(0)) <= 0) | F.coalesce(hit, F.lit(False))


def valid_record(title: Column, url: Column, listed: Column | None = None) -> Column:
    """FLT-9: nonblank title and URL after strip; optionally isListed not false."""
    ok = (F.coalesce(strip(title), F.lit("")) != "") & (F.coalesce(strip(url), F.lit("")) != "")
    if listed is not None:
        ok = ok & F.coalesce(listed, F.lit(True))
    return ok


def recent(posted: Column, now: Column, days: int = 30) -> Column:
    """FLT-10 / DT-1 / DT-3: keep rows posted on/after now - days; NULL or
    unparsable dates stay. A zone-less timestamp is read as UTC (session zone)."""
    ts = F.try_to_timestamp(posted)
    return F.coalesce(ts >= now - F.make_interval(days=F.lit(days)), F.lit(True))


def is_job_link(url: Column, fragments: Sequence[str] | None = None) -> Column:
    """FLT-11: lower-cased URL contains one of the path fragments."""
    u = F.lower(url)
    return F.coalesce(_any([u.contains(p) for p in (fragments or JOB_PATH_PATTERNS)]), F.lit(False))


def anchor_ok(text: Column) -> Column:
    """FLT-12: anchor text length within 4..120."""
    return F.coalesce(F.length(text).between(ANCHOR_MIN, ANCHOR_MAX), F.lit(False))


def min_text(desc: Column, n: int = MIN_PAGE_TEXT) -> Column:
    """FLT-13: text under n characters counts as no description."""
    return F.when(F.length(desc) >= n, desc)


def lever_location(location: Column, wanted: str | None) -> Column:
    """FLT-14: exact location string from the source URL, or no restriction."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(location == F.lit(wanted), F.lit(False))


def reportable(err: Column) -> Column:
    """FLT-16: detail errors that contain '406' are not reported."""
    return err.isNotNull() & ~err.contains("406")
