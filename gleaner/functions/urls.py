"""URL functions: platform slugs and ids (STR-19), Workday URL parsing
(STR-20/21/22), query parameters (STR-26, MAP-1), URL templates (STR-24),
href resolution (STR-25), '/apply' stripping (STR-23).

All native: ``regexp_extract``, ``parse_url``, ``split``/``filter``,
``url_decode``; the error text is a column where the reference raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extract(c: Column, pattern: str, idx: int = 1) -> Column:
    v = F.regexp_extract(c, pattern, idx)
    return F.when(v == "", F.lit(None).cast("string")).otherwise(v)


# Per-platform slug patterns and error texts.
def greenhouse_slug(url: Column) -> Column:
    return F.coalesce(_extract(url, r"boards\.greenhouse\.io/([^/?#]+)"),
                      _extract(url, r"([^/.]+)\.greenhouse\.io"))


def lever_slug(url: Column) -> Column:
    return _extract(url, r"jobs\.lever\.co/([^/?#]+)")


def ashby_slug(url: Column) -> Column:
    return _extract(url, r"jobs\.ashbyhq\.com/([^/?#]+)")


def bamboohr_subdomain(url: Column) -> Column:
    return _extract(url, r"([^/.]+)\.bamboohr\.com")


def bamboohr_job_id(url: Column) -> Column:
    return _extract(url, r"([^/.]+)\.bamboohr\.com/careers/(\d+)", 2)


def greenhouse_job_id(url: Column) -> Column:
    return _extract(url, r"/jobs/(\d+)")


def workday_job_id(external_path: Column) -> Column:
    """'/job/San-Jose/Principal-Product-Manager_R164308' -> 'R164308'."""
    return _extract(F.regexp_replace(external_path, "/+$", ""), r"_([A-Z0-9]+)$")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def oracle_tenant(url: Column) -> Column:
    h = host(url)
    return F.when(h == "careers.oracle.com", F.lit("eeho.fa.us2.oraclecloud.com")).otherwise(
        _extract(h, r"^([^.]+\.fa\.[^.]+\.oraclecloud\.com)"))


def _path_parts(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(path, "/"), lambda p: p != "")


def workday_source(url: Column) -> Column:
    """STR-20: struct(base_url, company, board) of a Workday board URL.

    Shape 1 ``{company}.wd{N}.myworkday(jobs|site).com/...``: path parts
    without ``en-US``/``recruiting``, a leading company part dropped, board =
    first remaining part (else the company). Shape 2
    ``wd{N}.myworkday(jobs|site).com/recruiting/{company}/{board}``.
    """
    h = host(url)
    base = F.concat(F.lit("https://"), h)
    parts = F.filter(_path_parts(url), lambda p: ~p.isin("en-US", "recruiting"))
    c1 = _extract(h, r"^([^.]+)\.(wd\d+)\.myworkday(?:jobs|site)\.com")
    p1 = F.when(F.lower(F.try_element_at(parts, F.lit(1))) == F.lower(c1), F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0)))).otherwise(parts)
    board1 = F.coalesce(F.try_element_at(p1, F.lit(1)), c1)
    shape2 = h.rlike(r"^(wd\d+)\.myworkday(?:jobs|site)\.com")
    c2 = F.try_element_at(parts, F.lit(1))
    b2 = F.coalesce(F.try_element_at(parts, F.lit(2)), c2)
    company = F.when(c1.isNotNull(), c1).when(shape2, c2)
    board = F.when(c1.isNotNull(), board1).when(shape2 & (F.size(parts) >= 1), b2)
    return F.struct(F.when(company.isNotNull(), base).alias("base_url"),
                    company.alias("company"), board.alias("board"))


def workday_job(url: Column) -> Column:
    """STR-21: struct(base_url, company, board, job_path) of a Workday job URL;
    NULL fields when there is no 'job' segment or the host does not parse."""
    h = host(url)
    parts = _path_parts(url)
    idx = F.array_position(parts, "job")
    job_path = F.when(idx > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.greatest(idx, F.lit(1)).cast("int"), F.greatest(F.size(parts), F.lit(0))), "/")))
    c1 = _extract(h, r"^([^.]+)\.(wd\d+)\.myworkday(?:jobs|site)\.com")
    board1 = F.when(idx > 1, F.try_element_at(parts, (idx - 1).cast("int"))).otherwise(c1)
    clean = F.filter(parts, lambda p: ~p.isin("recruiting", "en-US"))
    shape2 = h.rlike(r"^(wd\d+)\.myworkday(?:jobs|site)\.com") & (F.size(clean) >= 2)
    company = F.when(c1.isNotNull(), c1).when(shape2, F.try_element_at(clean, F.lit(1)))
    board = F.when(c1.isNotNull(), board1).when(shape2, F.try_element_at(clean, F.lit(2)))
    ok = (idx > 0) & company.isNotNull()
    return F.struct(F.when(ok, F.concat(F.lit("https://"), h)).alias("base_url"),
                    F.when(ok, company).alias("company"), F.when(ok, board).alias("board"),
                    F.when(ok, job_path).alias("job_path"))


def location_slug(descriptor: Column) -> Column:
    """STR-22: whitespace runs -> '-' after strip."""
    from .text import strip
    return F.regexp_replace(strip(descriptor), r"(?U)\s+", "-")


def rewrite_city(external_path: Column, city_slug: Column) -> Column:
    """STR-22: replace the city segment of '/job/<city>/...'."""
    m = F.regexp_extract(external_path, r"^(/job/)[^/]+(/.*)$", 2)
    return F.when(m != "", F.concat(F.lit("/job/"), city_slug, m)).otherwise(external_path)


def strip_apply(url: Column) -> Column:
    """STR-23: drop trailing '/', then a trailing '/apply'."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/apply$", "")


def resolve_href(href: Column, page_url: Column) -> Column:
    """STR-25: '/x' (and protocol-relative '//h/x') -> scheme://host + href;
    'http…' kept; anything else dropped (NULL)."""
    scheme = F.try_parse_url(page_url, F.lit("PROTOCOL"))
    authority = F.try_parse_url(page_url, F.lit("AUTHORITY"))
    return (F.when(href.startswith("/"), F.concat(scheme, F.lit("://"), authority, href))
             .when(href.startswith("http"), href))


def query_pairs(url: Column) -> Column:
    """array<struct<k, v>> of decoded query pairs in order, blank values dropped
    (percent and '+' decoding as ``parse_qs``)."""
    q = F.try_parse_url(url, F.lit("QUERY"))
    # value = text after the first '='
    pairs = F.transform(F.split(q, "&"), lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.try_url_decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p)))
                          .otherwise(F.lit(""))).alias("v")))
    return F.filter(pairs, lambda s: F.coalesce(s["v"], F.lit("")) != "")


def query_map(url: Column, allow: list[str] | None = None) -> Column:
    """STR-26 / MAP-1: map<key, array<value>> with repeated keys kept as a list,
    optionally limited to an allow-list of keys."""
    pairs = query_pairs(url)
    if allow:
        keys = F.array(*[F.lit(k) for k in allow])
        pairs = F.filter(pairs, lambda s: F.array_contains(keys, s["k"]))
    ks = F.array_distinct(F.transform(pairs, lambda s: s["k"]))
    return F.when(F.size(ks) > 0, F.map_from_arrays(
        ks, F.transform(ks, lambda k: F.transform(F.filter(pairs, lambda s: s["k"] == k), lambda s: s["v"]))))


def query_first(url: Column, key: str) -> Column:
    """First decoded value of a query key (``parse_qs(q)[k][0]``)."""
    return F.try_element_at(F.filter(query_pairs(url), lambda s: s["k"] == key), F.lit(1))["v"]


# Workday facet names carried from the source URL (STR-26).
WORKDAY_FACETS = [
    "locations", "timeType", "workerSubType", "jobFamilyGroup", "locationHierarchy1",
    "locationHierarchy2", "locationRegionStateProvince", "locationCountry", "jobFamily",
    "departments", "category", "remoteType",
]
