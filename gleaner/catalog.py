"""Registered queries (one per SURVEY §2 id) and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the driver tables (or fixtures
Spark derives from them) in full, and returns a DataFrame whose column names
match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import oracle as O
from .functions import filters as FL
from .functions import roles as R
from .functions import salary as SAL
from .functions import text as T
from .operators import decide as D
from .operators import paging as PGN
from .operators import routing as RT
from .operators import source_filters as SF
from .plans import collection as C
from .sources import sources as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle_sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle_sql is not None:
            ORACLE[name] = oracle_sql
        return fn
    return deco


CFG_A = D.FilterConfig.from_dict(fx.CONFIG_A)
CFG_B = D.FilterConfig.from_dict(fx.CONFIG_B)
SRC_COLS = ["id", "company", "url", "extractor_type", "requires_js", "active"]


def _run_ts(spark: SparkSession):
    return F.lit(fx.RUN_TS).cast("timestamp")


def _postings(spark, d):
    return fx.postings_df(spark, d)


def _sources(spark, d):
    return fx.sources_df(spark, d)


# ------------------------------------------------------------------ 2.1 scans
@register("src_1", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 WHERE active")
def src_1(spark, d):
    return S.active_sources(_sources(spark, d)).select(*SRC_COLS)


@register("src_2", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 WHERE id = 4 AND active")
def src_2(spark, d):
    return S.active_sources(_sources(spark, d), 4).select(*SRC_COLS)


@register("src_3", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 "
          "WHERE active AND NOT requires_js AND extractor_type = 'workday' ORDER BY company")
def src_3(spark, d):
    return S.sources_of_type(_sources(spark, d), "workday").select(*SRC_COLS)


@register("src_4", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 "
          "WHERE active AND NOT requires_js AND (company ILIKE '%supplier#0000000_1%' OR company ILIKE '%PLIER#%12%') "
          "ORDER BY company")
def src_4(spark, d):
    return S.sources_like(_sources(spark, d), ["supplier#0000000_1", "PLIER#%12"]).select(*SRC_COLS)


@register("src_5", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 "
          "WHERE active AND NOT requires_js ORDER BY extractor_type, company")
def src_5(spark, d):
    return S.sources_all(_sources(spark, d), by_type=True).select(*SRC_COLS)


@register("src_6", O.duck_with() + "SELECT id, company, url, extractor_type, requires_js, active FROM f1 "
          "WHERE active AND extractor_type = 'Greenhouse' ORDER BY company")
def src_6(spark, d):
    return S.sources_of_type(_sources(spark, d), "Greenhouse", include_js=True).select(*SRC_COLS)


@register("srt_1", O.duck_with() + "SELECT id, company FROM f1 WHERE active AND NOT requires_js ORDER BY company")
def srt_1(spark, d):
    return S.sources_all(_sources(spark, d)).select("id", "company")


# ---------------------------------------------------------- routing / status
@register("jn_8", O.duck_with() + f"SELECT id, {O.platform_sql()} AS platform FROM f1")
def jn_8(spark, d):
    s = _sources(spark, d)
    return s.select("id", RT.route(F.col("url"), F.col("extractor_type")).alias("platform"))


@register("jn_8_table", O.duck_with() + f"SELECT id, {O.platform_sql()} AS platform FROM f1")
def jn_8_table(spark, d):
    return RT.route_by_table(_sources(spark, d), RT.domain_table(spark))


@register("str_19", O.with_planned("true") + f"""
SELECT id, platform,
  CASE platform
    WHEN 'greenhouse' THEN coalesce(nullif(regexp_extract(url, 'boards\\.greenhouse\\.io/([^/?#]+)', 1), ''),
                                    nullif(regexp_extract(url, '([^/.]+)\\.greenhouse\\.io', 1), ''))
    WHEN 'lever' THEN nullif(regexp_extract(url, 'jobs\\.lever\\.co/([^/?#]+)', 1), '')
    WHEN 'ashby' THEN nullif(regexp_extract(url, 'jobs\\.ashbyhq\\.com/([^/?#]+)', 1), '')
    WHEN 'bamboohr' THEN nullif(regexp_extract(url, '([^/.]+)\\.bamboohr\\.com', 1), '')
  END AS slug,
  {O.error_sql()} AS error
FROM p0""")
def str_19(spark, d):
    s = _sources(spark, d)
    p = RT.route(F.col("url"), F.col("extractor_type"))
    slug = RT.source_slug(p, F.col("url"))
    return s.select("id", p.alias("platform"),
                    F.when(p.isin("greenhouse", "lever", "ashby", "bamboohr"), slug).alias("slug"),
                    RT.source_error(p, F.col("url")).alias("error"))


@register("str_19_ids", O.duck_with() + """
SELECT ord, CASE WHEN ord % 4 = 0 THEN 'co' || source_id WHEN ord % 4 = 1 THEN 'board' || source_id END AS slug,
       CASE ord % 4 WHEN 2 THEN 'R' || ord WHEN 3 THEN NULL ELSE CAST(ord AS VARCHAR) END AS job_id
FROM f2""")
def str_19_ids(spark, d):
    """Job ids from the URLs of postings: BambooHR, Greenhouse, Workday, and a URL without one."""
    p = _postings(spark, d).withColumn("u", F.expr("""CASE ord % 4
        WHEN 0 THEN 'https://co' || source_id || '.bamboohr.com/careers/' || ord || '?source=x'
        WHEN 1 THEN 'https://boards.greenhouse.io/board' || source_id || '/jobs/' || ord || '?gh_src=a'
        WHEN 2 THEN '/job/Salt-Lake-City/Product-Manager_R' || ord || '/' ELSE url END"""))
    u, kind = F.col("u"), F.col("ord") % 4
    return p.select("ord", F.coalesce(U.bamboohr_subdomain(u), U.greenhouse_slug(u)).alias("slug"),
                    F.when(kind == 2, U.workday_job_id(u)).otherwise(
                        F.coalesce(U.bamboohr_job_id(u), U.greenhouse_job_id(u))).alias("job_id"))


@register("flt_6", O.with_planned() + "SELECT id AS source_id, company, status, error FROM planned WHERE status = 'skipped'")
def flt_6(spark, d):
    planned = RT.plan_sources(S.active_sources(_sources(spark, d)))
    return planned.where(F.col("status") == "skipped").select(
        F.col("id").alias("source_id"), "company", "status", "error")


@register("agg_10", O.with_planned() + "SELECT id AS source_id, status, error FROM planned")
def agg_10(spark, d):
    planned = RT.plan_sources(S.active_sources(_sources(spark, d)))
    return planned.select(F.col("id").alias("source_id"), "status", "error")


@register("jn_3", O.with_planned() + """
SELECT f2.ord, f2.source_id, s.company AS source_company, s.platform
FROM f2 JOIN planned s ON f2.source_id = s.id AND s.status = 'success'""")
def jn_3(spark, d):
    planned = C.plan(S.active_sources(_sources(spark, d)))
    return C.listings_of(planned, _postings(spark, d)).select("ord", "source_id", "source_company", "platform")


# ------------------------------------------------------------- predicates
@register("str_3", O.duck_with() + "SELECT ord, role_expected AS role FROM f2")
def str_3(spark, d):
    return _postings(spark, d).select("ord", R.classify_role(F.col("title")).alias("role"))


@register("jn_9", O.duck_with() + "SELECT ord, role_expected AS role FROM f2")
def jn_9(spark, d):
    return R.classify_role_by_table(_postings(spark, d), "title", ["ord"], R.rules_table(spark))


@register("str_1", O.duck_with() + "SELECT page_id, sha256(trim(url)) AS url_hash FROM pages")
def str_1(spark, d):
    return fx.load(spark, d, "pages").select("page_id", T.hash_url(F.col("url")).alias("url_hash"))


@register("flt_1", O.duck_with() + """
SELECT ord, (contains(lower(title), 'developer') OR regexp_matches(lower(title), '^(senior|sr\\.) ')
             OR contains(lower(title), 'product manager')) AS title_match FROM f2""")
def flt_1(spark, d):
    return _postings(spark, d).select("ord", FL.title_matches(
        F.col("title"), ["Developer", r"^(senior|sr\.) ", "product manager"]).alias("title_match"))


@register("flt_2", O.duck_with() + "SELECT ord, coalesce(role_expected IN ('engineering_manager', 'product_manager', 'engineer'), false) AS role_ok FROM f2")
def flt_2(spark, d):
    p = _postings(spark, d)
    return p.select("ord", FL.role_targeted(R.classify_role(F.col("title")), CFG_A.roles).alias("role_ok"))


@register("flt_3", O.duck_with() + f"SELECT ord, {O.like_any('title', CFG_A.blocked)} AS blocked FROM f2")
def flt_3(spark, d):
    return _postings(spark, d).select("ord", FL.title_blocked(F.col("title"), CFG_A.blocked).alias("blocked"))


@register("flt_4", O.duck_with() + f"SELECT ord, (coalesce(location, '') = '' OR {O.like_any('location', CFG_B.locations)}) AS location_ok FROM f2")
def flt_4(spark, d):
    return _postings(spark, d).select("ord", FL.location_targeted(F.col("location"), CFG_B.locations).alias("location_ok"))


@register("flt_5", O.duck_with() + f"SELECT ord, (department IS NULL OR {O.like_any('department', CFG_A.departments)}) AS department_ok FROM f2")
def flt_5(spark, d):
    return _postings(spark, d).select("ord", FL.department_targeted(F.col("departments"), CFG_A.departments).alias("department_ok"))


@register("arr_1", O.duck_with() + f"SELECT ord, (department IS NULL OR {O.like_any('department', CFG_B.departments)}) AS any_match FROM f2")
def arr_1(spark, d):
    return _postings(spark, d).select("ord", FL.department_targeted(F.col("departments"), CFG_B.departments).alias("any_match"))


_FLT7_RAW = "'  Engineer | ' || company || ' ||  ' || lower(company) || ' | ' || CAST(id AS STRING) || ' '"


@register("flt_7", O.duck_with() + f"""
SELECT id,
  array_to_string(list_filter(list_transform(string_split(trim(raw), '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS roles,
  array_to_string(list_filter(list_transform(string_split(trim(raw), '|'), lambda x: lower(x)), lambda x: x <> ''), ';') AS locations,
  array_to_string(list_filter(list_transform(string_split(trim(raw), '|'), lambda x: lower(trim(x))), lambda x: x <> ''), ';') AS departments
FROM (SELECT id, {_FLT7_RAW} AS raw FROM f1)""")
def flt_7(spark, d):
    s = _sources(spark, d).select("id", F.expr(_FLT7_RAW).alias("raw"))
    return s.select("id",
                    F.array_join(T.parse_list(F.col("raw"), True, False), ";").alias("roles"),
                    F.array_join(T.parse_list(F.col("raw"), False, True), ";").alias("locations"),
                    F.array_join(T.parse_list(F.col("raw"), True, True), ";").alias("departments"))


# ------------------------------------------------------ cascade, dedup, runs
def _decided(spark, d, cfg=CFG_A):
    p = _postings(spark, d)
    decided, _ = C.collection_run(_sources(spark, d), p, fx.stored_df(p), cfg)
    return decided


@register("flt_8", O.with_cascade() + "SELECT ord, source_id, step, decision, reason FROM decided")
def flt_8(spark, d):
    return _decided(spark, d).select("ord", "source_id", "step", "decision", "reason")


@register("jn_1", O.with_planned() + """
SELECT f2.ord, sha256(f2.url) AS url_hash FROM f2 JOIN planned s ON f2.source_id = s.id AND s.status = 'success'
WHERE sha256(f2.url) NOT IN (SELECT url_hash FROM stored)""")
def jn_1(spark, d):
    p = _postings(spark, d)
    planned = C.plan(S.active_sources(_sources(spark, d)))
    listings = C.listings_of(planned, p).withColumn("url_hash", T.hash_url(F.col("url")))
    return listings.join(fx.stored_df(p), "url_hash", "left_anti").select("ord", "url_hash")


@register("win_1", O.with_cascade() + "SELECT ord, already_stored, earlier_twin FROM twins")
def win_1(spark, d):
    return _decided(spark, d).select("ord", "already_stored", "earlier_twin")


_RESULTS_SQL = """,
counts AS (
  SELECT source_id, count(*) AS found, count(*) FILTER (WHERE step = 'added') AS added,
         count(*) FILTER (WHERE step IN ('role', 'blocked_title', 'location', 'department')) AS filtered,
         count(*) FILTER (WHERE step = 'duplicate') AS skipped
  FROM decided GROUP BY source_id),
results AS (
  SELECT p.id AS source_id, p.company, p.status,
         CAST(CASE WHEN p.status = 'success' THEN coalesce(c.found, 0) ELSE 0 END AS BIGINT) AS jobs_found,
         CAST(CASE WHEN p.status = 'success' THEN coalesce(c.added, 0) ELSE 0 END AS BIGINT) AS jobs_added,
         CAST(CASE WHEN p.status = 'success' THEN coalesce(c.filtered, 0) ELSE 0 END AS BIGINT) AS jobs_filtered,
         CAST(CASE WHEN p.status = 'success' THEN coalesce(c.skipped, 0) ELSE 0 END AS BIGINT) AS jobs_skipped,
         p.error
  FROM planned p LEFT JOIN counts c ON c.source_id = p.id)
"""


def _results(spark, d, cfg=CFG_A):
    p = _postings(spark, d)
    _, results = C.collection_run(_sources(spark, d), p, fx.stored_df(p), cfg)
    return results


@register("agg_1", O.with_cascade() + _RESULTS_SQL + "SELECT * FROM results")
def agg_1(spark, d):
    return _results(spark, d)


@register("job_1", O.with_cascade() + _RESULTS_SQL + "SELECT * FROM results")
def job_1(spark, d):
    return _results(spark, d)


@register("set_3", O.with_cascade() + _RESULTS_SQL + "SELECT source_id, status FROM results")
def set_3(spark, d):
    return _results(spark, d).select("source_id", "status")


@register("prj_4", O.with_cascade() + _RESULTS_SQL + """
SELECT count(*) AS sources_scraped, CAST(sum(jobs_found) AS BIGINT) AS jobs_found,
       CAST(sum(jobs_added) AS BIGINT) AS jobs_added, CAST(sum(jobs_filtered) AS BIGINT) AS jobs_filtered,
       CAST(sum(jobs_skipped) AS BIGINT) AS jobs_skipped FROM results""")
def prj_4(spark, d):
    return C.run_summary(_results(spark, d))


@register("agg_8", O.with_cascade() + _RESULTS_SQL + """
SELECT count(*) AS sources_scraped, CAST(sum(jobs_found) AS BIGINT) AS jobs_found,
       CAST(sum(jobs_added) AS BIGINT) AS jobs_added, CAST(sum(jobs_filtered) AS BIGINT) AS jobs_filtered,
       CAST(sum(jobs_skipped) AS BIGINT) AS jobs_skipped FROM results""")
def agg_8(spark, d):
    return C.run_summary(_results(spark, d))


@register("snk_5", O.with_cascade() + _RESULTS_SQL + f"""
SELECT CAST(1 AS BIGINT) AS run_id, source_id, status, TIMESTAMP '{fx.RUN_TS}' AS started_at,
       TIMESTAMP '{fx.RUN_TS}' AS finished_at, jobs_found, jobs_added, jobs_filtered, jobs_skipped,
       error AS error_message
FROM results WHERE status <> 'skipped'""")
def snk_5(spark, d):
    return C.run_log(_results(spark, d), 1, _run_ts(spark))


@register("snk_4", O.with_cascade() + _RESULTS_SQL + f"""
SELECT f1.id, CASE WHEN r.status = 'success' THEN TIMESTAMP '{fx.RUN_TS}' END AS last_scraped_at
FROM f1 LEFT JOIN results r ON r.source_id = f1.id""")
def snk_4(spark, d):
    return C.touch_sources(_sources(spark, d), _results(spark, d), _run_ts(spark)).select("id", "last_scraped_at")


_DRY_SQL = """,
dry_counts AS (
  SELECT source_id, count(*) AS found, count(*) FILTER (WHERE step = 'added') AS would_add,
         count(*) FILTER (WHERE step IN ('role', 'location', 'department')) AS filtered,
         count(*) FILTER (WHERE step = 'blocked_title') AS blocked
  FROM decided GROUP BY source_id),
dry_base AS (
  SELECT p.id AS source_id, p.company,
         CASE WHEN p.status = 'success' THEN coalesce(c.found, 0) ELSE 0 END AS found,
         CASE WHEN p.status = 'success' THEN coalesce(c.would_add, 0) ELSE 0 END AS would_add,
         CASE WHEN p.status = 'success' THEN coalesce(c.filtered, 0) ELSE 0 END AS filtered,
         CASE WHEN p.status = 'success' THEN coalesce(c.blocked, 0) ELSE 0 END AS blocked
  FROM planned p LEFT JOIN dry_counts c ON c.source_id = p.id)
SELECT CASE WHEN grouping(source_id, company) > 0 THEN 'TOTAL' ELSE company END AS company, source_id,
       CAST(sum(found) AS BIGINT) AS found, CAST(sum(would_add) AS BIGINT) AS would_add,
       CAST(sum(filtered) AS BIGINT) AS filtered, CAST(sum(blocked) AS BIGINT) AS blocked
FROM dry_base GROUP BY GROUPING SETS ((source_id, company), ())
"""

_DRY_WHERE = "active AND NOT requires_js"


def _dry(spark, d, cfg=CFG_A):
    return C.dry_run(S.sources_all(_sources(spark, d)), _postings(spark, d), cfg)


@register("agg_2", O.with_cascade(CFG_A, False, _DRY_WHERE) + _DRY_SQL)
def agg_2(spark, d):
    return _dry(spark, d)[1]


@register("job_3", O.with_cascade(CFG_A, False, _DRY_WHERE) + _DRY_SQL)
def job_3(spark, d):
    return _dry(spark, d)[1]


@register("str_29", O.with_cascade(CFG_A, False, _DRY_WHERE) + f"""
SELECT ord, '[' || source_company || '] ' || decision || ' ' || reason || ': ' || {O.repr_sql('title')} AS line
FROM decided""")
def str_29(spark, d):
    decided = _dry(spark, d)[0]
    return decided.select("ord", D.decision_line(F.col("source_company"), F.col("decision"),
                                                 F.col("reason"), F.col("title")).alias("line"))


# ------------------------------------------------------------------ salary
@register("str_4", O.duck_with() + "SELECT ord, salary_expected AS salary FROM f2")
def str_4(spark, d):
    return _postings(spark, d).select("ord", SAL.extract_salary(F.col("description")).alias("salary"))


@register("str_4_5", O.duck_with() + "SELECT ord, salary_expected AS salary FROM f2")
def str_4_5(spark, d):
    return _postings(spark, d).select("ord", SAL.extract_salary(F.col("description")).alias("salary"))


@register("str_5", O.duck_with() + "SELECT ord, CASE WHEN contains(salary_expected, 'USD') THEN salary_expected END AS salary FROM f2")
def str_5(spark, d):
    p = _postings(spark, d)
    return p.select("ord", SAL.usd_salary(F.regexp_replace(F.col("description"), r"\*", "")).alias("salary"))


@register("mth_2", O.duck_with() + "SELECT ord, CAST(length(regexp_replace(salary_expected, '[^0-9]', '', 'g')) AS INT) AS digits FROM f2")
def mth_2(spark, d):
    p = _postings(spark, d)
    return p.select("ord", SAL.digit_count(SAL.extract_salary(F.col("description"))).alias("digits"))


# ------------------------------------------------------------ run diff (JOB-5)
from .operators import diff as DIF  # noqa: E402
from .plans import rundiff as RD  # noqa: E402
from .sources import logs as LG  # noqa: E402
from .session import cut_lineage, ensure_checkpoint_dir  # noqa: E402


def _f5(spark, d):
    return RD.decisions(S.sources_all(_sources(spark, d)), _postings(spark, d), [(1, CFG_A), (2, CFG_B)])


def _f6(spark, d):
    return RD.dry_run_log(_f5(spark, d))


def _diff(spark, d):
    return RD.run_diff(_f6(spark, d))


@register("str_30", O.diff_ctes() + "SELECT run_id, line_no, company, decision, reason, title FROM parsed")
def str_30(spark, d):
    return DIF.parse_lines(_f6(spark, d)).select("run_id", "line_no", "company", "decision", "reason", "title")


@register("agg_7", O.diff_ctes() + "SELECT * FROM last")
def agg_7(spark, d):
    return DIF.last_per_key(DIF.parse_lines(_f6(spark, d)), ["run_id", "company", "title"])


_DIFF_COLS = "company, title, decision1, reason1, decision2, reason2, bucket"


@register("jn_5", O.diff_ctes() + f"SELECT {_DIFF_COLS} FROM diff")
def jn_5(spark, d):
    return _diff(spark, d).select(*_DIFF_COLS.split(", "))


@register("set_5", O.diff_ctes() + "SELECT company, title, bucket FROM diff")
def set_5(spark, d):
    return _diff(spark, d).select("company", "title", "bucket")


@register("job_5", O.diff_ctes() + f"SELECT {_DIFF_COLS} FROM diff ORDER BY company, title")
def job_5(spark, d):
    return _diff(spark, d).select(*_DIFF_COLS.split(", ")).orderBy("company", "title")


@register("job_5_lossless", O.diff_ctes() + f""",
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, company, title ORDER BY source_id DESC, ord DESC) AS rn FROM dec) WHERE rn = 1)
SELECT coalesce(a.company, b.company) AS company, coalesce(a.title, b.title) AS title, a.decision AS decision1, a.reason AS reason1,
       b.decision AS decision2, b.reason AS reason2,
       CASE WHEN b.decision IS NULL THEN 'only_in_run1' WHEN a.decision IS NULL THEN 'only_in_run2'
            WHEN a.decision = 'FILTERED' AND b.decision = 'WOULD ADD' THEN 'newly_added'
            WHEN a.decision = 'WOULD ADD' AND b.decision = 'FILTERED' THEN 'newly_filtered'
            WHEN a.reason <> b.reason THEN 'reason_changed' ELSE 'unchanged' END AS bucket
FROM (SELECT * FROM ends WHERE run_id = 1) a FULL JOIN (SELECT * FROM ends WHERE run_id = 2) b ON a.company = b.company AND a.title = b.title""")
def job_5_lossless(spark, d):
    """Two configurations decided in one pass, compared without the way through text."""
    return DIF.compare_decisions(_f5(spark, d)).select(*_DIFF_COLS.split(", "))


@register("srt_2", O.diff_ctes() + "SELECT company, title, bucket FROM diff WHERE bucket <> 'unchanged' ORDER BY company, title")
def srt_2(spark, d):
    return _diff(spark, d).where(F.col("bucket") != "unchanged").select("company", "title", "bucket").orderBy("company", "title")


@register("agg_6", O.diff_ctes() + """
SELECT count(*) FILTER (WHERE bucket = 'newly_added') AS newly_added,
       count(*) FILTER (WHERE bucket = 'newly_filtered') AS newly_filtered,
       count(*) FILTER (WHERE bucket = 'reason_changed') AS reason_changed,
       count(*) FILTER (WHERE bucket = 'only_in_run1') AS only_in_run1,
       count(*) FILTER (WHERE bucket = 'only_in_run2') AS only_in_run2,
       count(*) FILTER (WHERE bucket = 'unchanged') AS unchanged,
       count(*) FILTER (WHERE decision1 IS NOT NULL) AS run1_jobs,
       count(*) FILTER (WHERE decision2 IS NOT NULL) AS run2_jobs
FROM diff""")
def agg_6(spark, d):
    return DIF.bucket_sizes(_diff(spark, d))


@register("set_1", O.diff_ctes() + "SELECT DISTINCT company, title FROM last")
def set_1(spark, d):
    last = DIF.last_per_key(DIF.parse_lines(_f6(spark, d)), ["run_id", "company", "title"])
    return DIF.union_keys(last.where("run_id = 1"), last.where("run_id = 2"))


@register("set_2", O.diff_ctes() + """
SELECT 'run1' AS side, company, title FROM last l WHERE run_id = 1
  AND NOT EXISTS (SELECT 1 FROM last r WHERE r.run_id = 2 AND r.company = l.company AND r.title = l.title)
UNION ALL
SELECT 'run2' AS side, company, title FROM last l WHERE run_id = 2
  AND NOT EXISTS (SELECT 1 FROM last r WHERE r.run_id = 1 AND r.company = l.company AND r.title = l.title)""")
def set_2(spark, d):
    last = DIF.last_per_key(DIF.parse_lines(_f6(spark, d)), ["run_id", "company", "title"])
    r1, r2 = last.where("run_id = 1"), last.where("run_id = 2")
    return (DIF.only_in(r1, r2).select(F.lit("run1").alias("side"), "company", "title")
            .unionByName(DIF.only_in(r2, r1).select(F.lit("run2").alias("side"), "company", "title")))


def _scratch(spark, name: str) -> str:
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("snk_7", O.diff_ctes() + "SELECT company, title, bucket FROM diff")
def snk_7(spark, d):
    path = _scratch(spark, "diff")
    LG.write_diff(_diff(spark, d).select("company", "title", "bucket"), path)
    return spark.read.parquet(path).select("company", "title", "bucket")


@register("snk_6", O.diff_ctes() + "SELECT run_id, line_no, line FROM lines")
def snk_6(spark, d):
    out = None
    f6 = _f6(spark, d)
    for run_id in (1, 2):
        path = _scratch(spark, f"dry-run-{run_id}")
        LG.write_lines(f6.where(F.col("run_id") == run_id), path)
        back = LG.read_log(spark, path).select(F.lit(run_id).alias("run_id"), "line_no", "line")
        out = back if out is None else out.unionByName(back)
    return out


@register("src_9", O.diff_ctes() + "SELECT line_no, line FROM lines WHERE run_id = 1")
def src_9(spark, d):
    path = _scratch(spark, "run-log")
    LG.write_lines(_f6(spark, d).where(F.col("run_id") == 1), path)
    return LG.read_log(spark, path).select("line_no", "line")


# ------------------------------------------------------------ run log (JOB-7)
_TS = fx.RUN_TS


def _runlog(spark, d):
    p = _postings(spark, d)
    decided, results = C.collection_run(_sources(spark, d), p, fx.stored_df(p), CFG_A)
    return RD.run_log_lines(decided, results, _TS)


@register("flt_15", O.runlog_ctes(_TS) + """
SELECT line_no, line FROM runlog
WHERE (contains(line, '[Supplier#000000004]') OR contains(lower(line), 'supplier#000000004'))
  AND contains(line, '[INFO]') AND contains(line, 'FILTERED')""")
def flt_15(spark, d):
    return LG.log_lines(_runlog(spark, d), "Supplier#000000004", "info", True).select("line_no", "line")


@register("lim_1", O.runlog_ctes(_TS) + "SELECT line_no, line FROM (SELECT line_no, line FROM runlog ORDER BY line_no DESC LIMIT 200) ORDER BY line_no")
def lim_1(spark, d):
    return LG.tail(_runlog(spark, d), 200).select("line_no", "line")


@register("job_7", O.runlog_ctes(_TS) + """
SELECT line_no, line, count(*) OVER () AS total FROM (
  SELECT line_no, line FROM runlog WHERE contains(line, 'FILTERED') ORDER BY line_no DESC LIMIT 2000)
ORDER BY line_no""")
def job_7(spark, d):
    return RD.log_query(_runlog(spark, d), filtered_only=True, limit=2000).select("line_no", "line", "total")


@register("agg_8_log", O.runlog_ctes(_TS) + "SELECT count(*) AS total FROM runlog WHERE contains(line, '[ERROR]')")
def agg_8_log(spark, d):
    return LG.log_lines(_runlog(spark, d), level="error").agg(F.count(F.lit(1)).alias("total"))


# ------------------------------------------------------- sinks, second pass
from .sources import sinks as SK  # noqa: E402
from .sources import updates as UP  # noqa: E402
from .plans import discovery as DS  # noqa: E402
from .plans import second_pass as P2  # noqa: E402

_NEWJOBS_SQL = f""",
newjobs AS (
  SELECT source_id, title, url AS job_url, url_hash, source_company AS company,
         CASE WHEN location <> '' THEN location END AS location,
         CAST(NULL AS VARCHAR) AS job_type,
         CASE WHEN coalesce(trim(description) <> '', false) THEN salary_expected END AS salary,
         CASE WHEN coalesce(trim(description) <> '', false) THEN description END AS description,
         CAST(NULL AS VARCHAR) AS requirements, role,
         CASE WHEN coalesce(trim(description) <> '', false) THEN 'scraped' ELSE 'pending' END AS scrape_status,
         CASE WHEN coalesce(trim(description) <> '', false) THEN TIMESTAMP '{fx.RUN_TS}' END AS scraped_at
  FROM decided WHERE step = 'added')
"""


def _new_jobs(spark, d):
    return SK.new_jobs(_decided(spark, d), _run_ts(spark))


@register("snk_1", O.with_cascade() + _NEWJOBS_SQL + "SELECT * FROM newjobs")
def snk_1(spark, d):
    return _new_jobs(spark, d)


@register("prj_3", O.with_cascade() + _NEWJOBS_SQL + "SELECT url_hash, company, scrape_status FROM newjobs")
def prj_3(spark, d):
    return _new_jobs(spark, d).select("url_hash", "company", "scrape_status")


def _jsn_4_sql() -> str:
    return (O.pay_with() + ", lv AS (SELECT * FROM pf2 WHERE pplat = 'lever' AND title_ok)\n"
            + """SELECT CAST(ord AS VARCHAR) AS id,
       CASE WHEN (ord // 20) % 2 = 0 THEN '["Q1","Q2"]' ELSE '["Need A"]' END AS requirements FROM lv""")


@register("jsn_4", _jsn_4_sql())
def jsn_4(spark, d):
    from .operators import normalize as NZ
    from . import payloads as PLD
    pay = PLD.payloads(_postings(spark, d), fx.RUN_TS).where(F.col("platform") == "lever")
    det = NZ.lever(pay, convert=False)
    return det.select("id", SK.requirements_json(F.col("requirements")).alias("requirements"))


_PASS2_SQL = f""",
hit AS (SELECT d.* FROM details d WHERE d.url_hash IN (SELECT url_hash FROM newjobs WHERE scrape_status = 'pending')),
pass2 AS (
  SELECT j.source_id, j.title, j.job_url, j.url_hash, j.company, j.requirements, j.role,
    CASE WHEN h.url_hash IS NOT NULL AND h.error IS NULL THEN coalesce(h.location, j.location) ELSE j.location END AS location,
    CASE WHEN h.url_hash IS NOT NULL AND h.error IS NULL THEN coalesce(h.job_type, j.job_type) ELSE j.job_type END AS job_type,
    CASE WHEN h.url_hash IS NOT NULL AND h.error IS NULL THEN coalesce(h.salary, j.salary) ELSE j.salary END AS salary,
    CASE WHEN h.url_hash IS NOT NULL AND h.error IS NULL THEN h.description ELSE j.description END AS description,
    CASE WHEN h.error IS NOT NULL THEN 'failed'
         WHEN h.url_hash IS NOT NULL AND coalesce(trim(h.description) <> '', false) THEN 'scraped'
         WHEN h.url_hash IS NOT NULL THEN 'failed' ELSE j.scrape_status END AS scrape_status,
    CASE WHEN h.url_hash IS NOT NULL THEN TIMESTAMP '{fx.RUN_TS}' ELSE j.scraped_at END AS scraped_at,
    CASE WHEN h.error IS NOT NULL THEN h.error END AS scrape_error
  FROM newjobs j LEFT JOIN hit h ON h.url_hash = j.url_hash)
"""


def _pass2(spark, d):
    """The jobs after a second pass whose changed rows were written and read back."""
    p = _postings(spark, d)
    path, jobs = _scratch(spark, "updates"), _new_jobs(spark, d)
    UP.write_update(SK.updated_rows(jobs, fx.details_df(spark, p), _run_ts(spark)), path, 1)
    return UP.current_rows(jobs, UP.read_updates(spark, path, "url_hash"), "url_hash")


_PASS2_COLS = ["url_hash", "location", "job_type", "salary", "description", "scrape_status", "scraped_at", "scrape_error"]


@register("job_2_details", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL + f"SELECT {', '.join(_PASS2_COLS)} FROM pass2")
def job_2_details(spark, d):
    return _pass2(spark, d).select(*_PASS2_COLS)


#: JOB-2 from pages: nothing is filtered, and the platforms with job pages list no descriptions.
CFG_ALL = D.FilterConfig()
_PAGED = "('workday', 'phenom', 'netflix', 'generic')"


def _page_jobs(spark, d):
    p = _postings(spark, d)
    planned = C.plan(S.active_sources(_sources(spark, d)))
    decided = D.decide(C.listings_of(planned, p), CFG_ALL, fx.stored_df(p), dedup=True)
    bare = F.when(~F.expr(f"platform IN {_PAGED}"), F.col("description"))
    return planned, SK.new_jobs(decided.withColumn("description", bare), _run_ts(spark))


def _page_pass(spark, d):
    planned, jobs = _page_jobs(spark, d)
    jobs = cut_lineage(jobs)
    platforms = planned.select(F.col("id").alias("source_id"), "platform")
    details = P2.page_details(P2.pending_pages(jobs, platforms, fx.detail_pages_df(spark, _postings(spark, d))))
    path = _scratch(spark, "updates")
    UP.write_update(SK.updated_rows(jobs, details, _run_ts(spark)), path, 1)
    return UP.current_rows(jobs, UP.read_updates(spark, path, "url_hash"), "url_hash")


def _page_pass_sql() -> str:
    """Expected rows in closed form: what each platform's reader makes of each kind of page."""
    tele = lambda loc: O.tele_sql(loc, "json_extract_string(ldt, '$.jobLocationType')")
    return O.duck_with(O.cascade_ctes(CFG_ALL, True)) + f""",
nj AS (SELECT *, CASE WHEN platform IN {_PAGED} THEN NULL ELSE description END AS d1, CASE WHEN location <> '' THEN location END AS l1
       FROM decided WHERE step = 'added'),
jobs AS (SELECT *, coalesce(trim(d1) <> '', false) AS described FROM nj),
kinds AS ({fx.page_kinds_sql('duckdb')}),
ld AS (SELECT *, CASE WHEN kind IN (0, 2) THEN {fx.page_block('duckdb')} END AS ldt FROM kinds),
x AS (SELECT j.url_hash, j.platform, j.l1, k.kind, k.ldt, k.t, k.u FROM jobs j JOIN ld k ON k.url_hash = j.url_hash WHERE NOT j.described),
got AS (
  SELECT url_hash,
    CASE WHEN platform = 'workday' AND kind IN (0, 2) THEN {tele("coalesce(l1, 'Lehi')")}
         WHEN platform = 'netflix' AND kind = 0 THEN {tele("'Lehi, UT'")} END AS loc,
    CASE WHEN platform IN ('workday', 'netflix') AND (kind = 0 OR kind = 2 AND platform = 'workday') THEN 'FULL_TIME' END AS jt,
    CASE WHEN platform IN ('workday', 'netflix') AND (kind = 0 OR kind = 2 AND platform = 'workday') THEN {O.salary_sql('ldt', False)} END AS sal,
    CASE WHEN platform = 'workday' AND kind IN (0, 2) OR platform = 'netflix' AND kind = 0
           THEN 'About ' || t || chr(10) || chr(10) || '- Build things'
         WHEN platform IN ('netflix', 'generic') AND kind = 1 THEN {fx.page_body('duckdb')}
         WHEN platform = 'generic' AND kind IN (0, 2) THEN 'Short note' END AS descr,
    CASE WHEN platform = 'generic' AND kind = 4 THEN 'Timeout after 20 s: ' || u END AS err
  FROM x)
SELECT j.url_hash, CASE WHEN g.err IS NULL THEN coalesce(g.loc, j.l1) ELSE j.l1 END AS location, g.jt AS job_type,
       CASE WHEN j.described THEN j.salary_expected ELSE g.sal END AS salary,
       CASE WHEN j.described THEN j.d1 ELSE g.descr END AS description,
       CASE WHEN j.described OR g.descr IS NOT NULL THEN 'scraped' ELSE 'failed' END AS scrape_status,
       TIMESTAMP '{fx.RUN_TS}' AS scraped_at, g.err AS scrape_error
FROM jobs j LEFT JOIN got g ON g.url_hash = j.url_hash"""


@register("job_2", _page_pass_sql())
def job_2(spark, d):
    """The second pass from landed pages, over all platforms."""
    return _page_pass(spark, d).select(*_PASS2_COLS)


@register("snk_2", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL +
          "SELECT url_hash, location, job_type, salary, scrape_status FROM pass2 WHERE scrape_error IS NULL")
def snk_2(spark, d):
    return _pass2(spark, d).where(F.col("scrape_error").isNull()).select(
        "url_hash", "location", "job_type", "salary", "scrape_status")


@register("snk_3", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL +
          "SELECT url_hash, scrape_status, scrape_error, scraped_at FROM pass2 WHERE scrape_error IS NOT NULL")
def snk_3(spark, d):
    return _pass2(spark, d).where(F.col("scrape_error").isNotNull()).select(
        "url_hash", "scrape_status", "scrape_error", "scraped_at")


@register("jn_7", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL + "SELECT url_hash, scrape_status FROM pass2")
def jn_7(spark, d):
    return _pass2(spark, d).select("url_hash", "scrape_status")


@register("jn_6", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL + "SELECT url_hash, description, error FROM hit")
def jn_6(spark, d):
    p = _postings(spark, d)
    return SK.pending_details(fx.details_df(spark, p), _new_jobs(spark, d)).select("url_hash", "description", "error")


@register("flt_16", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL +
          "SELECT url_hash, error FROM hit WHERE error IS NOT NULL AND NOT contains(error, '406')")
def flt_16(spark, d):
    p = _postings(spark, d)
    return SK.reported_errors(SK.pending_details(fx.details_df(spark, p), _new_jobs(spark, d))).select("url_hash", "error")


@register("lim_2", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL +
          """SELECT p.url_hash, substr(p.scrape_error, 1, 30) AS scrape_error,
       CASE WHEN h.url_hash IS NOT NULL AND h.error IS NULL THEN coalesce(h.location, substr(p.location, 1, 4))
            ELSE substr(p.location, 1, 4) END AS location
FROM pass2 p LEFT JOIN hit h ON h.url_hash = p.url_hash""")
def lim_2(spark, d):
    jobs = SK.new_jobs(_decided(spark, d), _run_ts(spark), location_cap=4)
    out = SK.apply_details(jobs, fx.details_df(spark, _postings(spark, d)), _run_ts(spark), error_cap=30)
    return out.select("url_hash", "scrape_error", "location")


# ------------------------------------------------------ discovery (JOB-4)
_DISC_WHERE = "active AND NOT requires_js"
_DISC_SQL = """,
values0 AS (
  SELECT coalesce(extractor_type, 'unknown') AS platform_label, source_company AS company, 'location' AS kind,
         trim(unnest(string_split(location, ' | '))) AS value
  FROM (SELECT f.*, s.extractor_type FROM flagged f JOIN planned s ON s.id = f.source_id)
  UNION ALL
  SELECT coalesce(s.extractor_type, 'unknown'), f.source_company, 'department', f.department
  FROM flagged f JOIN planned s ON s.id = f.source_id),
pvalues AS (SELECT DISTINCT * FROM values0 WHERE value IS NOT NULL AND value <> '')
"""


def _disc(spark, d):
    planned = C.plan(S.sources_all(_sources(spark, d)))
    listings = C.listings_of(planned, _postings(spark, d)).withColumn(
        "platform_label", DS.platform_label()).withColumnRenamed("source_company", "company")
    return planned, listings


@register("agg_3", O.with_cascade(CFG_A, False, _DISC_WHERE) + _DISC_SQL + "SELECT * FROM pvalues")
def agg_3(spark, d):
    return DS.profile_values(_disc(spark, d)[1])


_COUNTS_SQL = """
SELECT platform_label, company, count(DISTINCT CASE WHEN kind = 'location' THEN value END) AS n_locations,
       count(DISTINCT CASE WHEN kind = 'department' THEN value END) AS n_departments
FROM pvalues GROUP BY GROUPING SETS ((platform_label, company), (platform_label))"""


@register("agg_4", O.with_cascade(CFG_A, False, _DISC_WHERE) + _DISC_SQL + _COUNTS_SQL)
def agg_4(spark, d):
    return DS.profile_counts(DS.profile_values(_disc(spark, d)[1]))


@register("job_4", O.with_cascade(CFG_A, False, _DISC_WHERE) + _DISC_SQL + _COUNTS_SQL)
def job_4(spark, d):
    return DS.profile_counts(DS.profile_values(_disc(spark, d)[1]))


@register("agg_5", O.with_cascade(CFG_A, False, _DISC_WHERE) + """,
n AS (SELECT source_id, count(*) AS c FROM flagged GROUP BY source_id)
SELECT p.id AS source_id, p.company,
       CAST(CASE WHEN p.status = 'success' THEN coalesce(n.c, 0) ELSE 0 END AS BIGINT) AS total_jobs,
       CASE WHEN p.status = 'failed' THEN p.error END AS error
FROM planned p LEFT JOIN n ON n.source_id = p.id""")
def agg_5(spark, d):
    planned, listings = _disc(spark, d)
    return DS.total_jobs(planned, listings)


@register("agg_9", O.duck_with() + "SELECT coalesce(extractor_type, 'unknown') AS platform_label, count(*) AS n_sources "
          "FROM f1 WHERE active AND NOT requires_js GROUP BY 1")
def agg_9(spark, d):
    return DS.sources_by_platform(S.sources_all(_sources(spark, d)))


@register("srt_3", O.with_cascade(CFG_A, False, _DISC_WHERE) + _DISC_SQL +
          "SELECT DISTINCT platform_label, value FROM pvalues WHERE kind = 'location' ORDER BY 1, 2")
def srt_3(spark, d):
    return DS.consolidated(DS.profile_values(_disc(spark, d)[1]), "location")


@register("set_4", O.with_cascade(CFG_A, False, _DISC_WHERE) + _DISC_SQL +
          "SELECT DISTINCT platform_label, value FROM pvalues WHERE kind = 'department'")
def set_4(spark, d):
    return DS.consolidated(DS.profile_values(_disc(spark, d)[1]), "department")


# --------------------------------------------------- payloads / normalisers
from . import payloads as PL  # noqa: E402
from .operators import normalize as N  # noqa: E402


def _payloads(spark, d):
    return PL.payloads(_postings(spark, d), fx.RUN_TS)


def _by(pay, platform):
    return pay.where(F.col("platform") == platform)


def _join(c: str):
    return F.array_join(F.col(c), "|").alias(c)


_GH_LOC = """CASE WHEN trim(gl) = 'United States' THEN 'Remote - United States' ELSE gl END"""
_GH_SQL = O.pay_with() + """,
gh AS (
  SELECT *, CASE WHEN ord % 3 = 0 THEN (CASE WHEN pp IS NULL THEN 'Lehi, UT' WHEN pp = 'Lehi, UT' THEN pp
                                            ELSE pp || ' | Lehi, UT' END) ELSE pp END AS gl
  FROM (SELECT *, CASE WHEN ord % 17 = 0 THEN 'United States'
                       WHEN coalesce(location, '') <> '' THEN trim(location) END AS pp
        FROM pf2 WHERE pplat = 'greenhouse' AND title_ok))
"""


@register("nrm_1", _GH_SQL + "SELECT source_id, CAST(ord AS VARCHAR) AS id, title, url FROM gh")
def nrm_1(spark, d):
    return N.greenhouse(_by(_payloads(spark, d), "greenhouse"), convert=False).select("source_id", "id", "title", "url")


@register("nrm_2", _GH_SQL + f"SELECT CAST(ord AS VARCHAR) AS id, {_GH_LOC} AS location, coalesce(department, '') AS departments FROM gh")
def nrm_2(spark, d):
    return N.greenhouse(_by(_payloads(spark, d), "greenhouse")).select("id", "location", _join("departments"))


@register("str_14", _GH_SQL + f"SELECT CAST(ord AS VARCHAR) AS id, {_GH_LOC} AS location FROM gh")
def str_14(spark, d):
    return N.greenhouse(_by(_payloads(spark, d), "greenhouse"), convert=False).select("id", "location")


@register("str_15", _GH_SQL + f"SELECT CAST(ord AS VARCHAR) AS id, coalesce({_GH_LOC} = 'Remote - United States', false) AS us_remote FROM gh")
def str_15(spark, d):
    return N.greenhouse(_by(_payloads(spark, d), "greenhouse"), convert=False).select(
        "id", F.coalesce(F.col("location") == "Remote - United States", F.lit(False)).alias("us_remote"))


_LEVER_SQL = O.pay_with() + ", lv AS (SELECT * FROM pf2 WHERE pplat = 'lever' AND title_ok)\n"


@register("nrm_3", _LEVER_SQL + "SELECT source_id, CAST(ord AS VARCHAR) AS id, title, url FROM lv")
def nrm_3(spark, d):
    return N.lever(_by(_payloads(spark, d), "lever"), convert=False).select("source_id", "id", "title", "url")


@register("nrm_4", _LEVER_SQL + """
SELECT CAST(ord AS VARCHAR) AS id, location, CASE WHEN (ord // 20) % 2 = 0 THEN 'Full-time' ELSE 'Contract' END AS job_type,
       coalesce(department, '') AS departments, CASE WHEN (ord // 20) % 2 = 0 THEN 'Q1|Q2' ELSE 'Need A' END AS requirements
FROM lv""")
def nrm_4(spark, d):
    return N.lever(_by(_payloads(spark, d), "lever"), convert=False).select(
        "id", "location", "job_type", _join("departments"), _join("requirements"))


@register("str_28", _LEVER_SQL + "SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN (ord // 20) % 2 = 0 THEN 2 ELSE 1 END AS n_requirements FROM lv")
def str_28(spark, d):
    return N.lever(_by(_payloads(spark, d), "lever"), convert=False).select(
        "id", F.size("requirements").alias("n_requirements"))


@register("str_31", _LEVER_SQL + "SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN (ord // 20) % 2 = 0 THEN 'Perks' END AS other_section FROM lv")
def str_31(spark, d):
    df = N.lever(_by(_payloads(spark, d), "lever"), convert=False)
    return df.select("id", F.when(F.col("description").contains("Perks\nPerk one"), F.lit("Perks")).alias("other_section"))


@register("flt_14", O.pay_with() + """
SELECT source_id, CAST(ord AS VARCHAR) AS id, location FROM pf2 WHERE pplat = 'lever' AND title_ok
  AND CASE source_id % 3 WHEN 0 THEN location = 'Remote - United States' WHEN 1 THEN location = 'Lehi, UT' ELSE true END
UNION ALL
SELECT source_id, 'R' || CAST(ord AS VARCHAR), nullif(location, '') FROM pf2 WHERE pplat = 'workday' AND title_ok AND (ord // 20) % 4 <> 0
  AND (source_id % 3 <> 0 OR location IN ('Remote - United States', 'Lehi, UT'))""")
def flt_14(spark, d):
    """Postings of Lever and Workday sources, each held to its own URL's parameters."""
    pay = _payloads(spark, d)
    urls = F.expr("""CASE WHEN platform = 'lever' THEN 'https://jobs.lever.co/co' || id ||
        CASE id % 3 WHEN 0 THEN '?location=Remote+-+United+States&location=Lehi%2C%20UT' WHEN 1 THEN '?x=1&location=Lehi%2C%20UT' ELSE '?team=a' END
      ELSE 'https://co' || id || '.wd5.myworkdayjobs.com/Board' ||
        CASE id % 3 WHEN 0 THEN '?locations=Remote%20-%20United%20States&locations=Lehi%2C+UT&workerSubType=z' ELSE '?q=b' END END""")
    sources = (pay.where("platform IN ('lever', 'workday')").select(F.col("source_id").alias("id"), "platform").distinct()
               .withColumn("url", urls))
    cols = ["source_id", "id", "location", "job_type", "departments"]
    wd = N.workday(_by(pay, "workday"), CFG_A.locations)
    postings = N.lever(_by(pay, "lever"), convert=False).select(*cols).unionByName(wd.where(~F.col("multi_location")).select(*cols))
    return SF.apply_source_filters(postings, SF.source_filters(sources)).select("source_id", "id", "location")


@register("flt_14_table", O.duck_with() + """,
u AS (SELECT id, CASE WHEN contains(lower(url), 'lever') THEN 'lever' ELSE 'workday' END AS platform, url FROM f1
      WHERE contains(url, 'jobs.lever.co') OR contains(url, 'myworkday'))
SELECT id AS source_id, platform, 'location' AS field, 'Lehi, UT' AS wanted FROM u WHERE platform = 'lever'
UNION ALL SELECT id, platform, 'locations', 'a1b2|c3 d4' FROM u WHERE id % 10 = 4
UNION ALL SELECT id, platform, 'timeType', 'full' FROM u WHERE id % 10 = 4
UNION ALL SELECT id, platform, 'jobFamilyGroup', 'x y|z' FROM u WHERE id % 10 = 5""")
def flt_14_table(spark, d):
    sources = _sources(spark, d).withColumn("platform", F.expr(
        "CASE WHEN contains(url, 'jobs.lever.co') THEN 'lever' WHEN contains(url, 'myworkday') THEN 'workday' END"))
    return SF.source_filters(sources).withColumn("wanted", F.array_join("wanted", "|"))


_ASHBY_SQL = O.pay_with() + """,
ab0 AS (SELECT * FROM pf2 WHERE pplat = 'ashby' AND title_ok AND ord % 9 <> 0),
ab1 AS (
  SELECT *, CASE WHEN (ord // 20) % 2 = 0 THEN (CASE WHEN coalesce(location, '') <> '' THEN [trim(location)] ELSE [] END)
                 ELSE list_transform(list_filter([location, ' Remote '], lambda x: coalesce(x, '') <> ''), lambda x: trim(x)) END AS firstl,
         CASE WHEN ord % 3 = 0 THEN ['Lehi, UT'] ELSE [] END AS secl FROM ab0),
ab AS (
  SELECT *, list_concat(firstl, list_filter(secl, lambda s: NOT list_contains(firstl, s))) AS parts FROM ab1)
"""


@register("nrm_5", _ASHBY_SQL + "SELECT source_id, CAST(ord AS VARCHAR) AS id, title, url FROM ab")
def nrm_5(spark, d):
    return N.ashby(_by(_payloads(spark, d), "ashby"), convert=False).select("source_id", "id", "title", "url")


@register("nrm_6", _ASHBY_SQL + f"""
SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' | ') END AS location,
       coalesce(department, '') AS departments, 'FullTime' AS job_type,
       CASE WHEN (ord // 20) % 4 = 0 THEN 'USD ' || {O.thousands('100000 + ord')} || '–' || {O.thousands('150000 + ord')} || ' 1 YEAR' END AS salary
FROM ab""")
def nrm_6(spark, d):
    return N.ashby(_by(_payloads(spark, d), "ashby"), convert=False).select(
        "id", "location", _join("departments"), "job_type", "salary")


@register("str_18", _ASHBY_SQL + f"""
SELECT CAST(ord AS VARCHAR) AS id,
       'USD ' || {O.thousands('100000 + ord')} || '–' || {O.thousands('150000 + ord')} || ' 1 YEAR' AS salary
FROM ab WHERE (ord // 20) % 4 = 0""")
def str_18(spark, d):
    return N.ashby(_by(_payloads(spark, d), "ashby"), convert=False).where(F.col("salary").isNotNull()).select("id", "salary")


@register("arr_2", _ASHBY_SQL + """SELECT CAST(ord AS VARCHAR) AS id,
       CAST(CASE WHEN len(parts) = 0 THEN 0 ELSE len(string_split(array_to_string(parts, ' | '), ' | ')) END AS INT) AS n_locations FROM ab""")
def arr_2(spark, d):
    df = N.ashby(_by(_payloads(spark, d), "ashby"), convert=False)
    return df.select("id", F.coalesce(F.size(F.split("location", r" \| ")), F.lit(0)).cast("int").alias("n_locations"))


@register("arr_3", _ASHBY_SQL + "SELECT CASE WHEN (ord // 400) % 2 = 0 THEN 'jobPostings' ELSE 'jobs' END AS used_key, count(*) AS n FROM ab GROUP BY 1")
def arr_3(spark, d):
    df = N.ashby(_by(_payloads(spark, d), "ashby"), convert=False)
    return df.groupBy(F.when(F.col("page_no") % 2 == 0, "jobPostings").otherwise("jobs").alias("used_key")).agg(
        F.count(F.lit(1)).alias("n"))


@register("jsn_5", _ASHBY_SQL + "SELECT count(*) AS listed FROM ab")
def jsn_5(spark, d):
    return N.ashby(_by(_payloads(spark, d), "ashby"), convert=False).agg(F.count(F.lit(1)).alias("listed"))


_BAMBOO_SQL = O.pay_with() + """,
bb AS (SELECT * FROM pf2 WHERE pplat = 'bamboohr' AND title_ok AND ord % 19 <> 0)
"""


@register("nrm_7", _BAMBOO_SQL + """
SELECT source_id, CAST(ord AS VARCHAR) AS id, title,
       'https://co' || CAST(source_id AS VARCHAR) || '.bamboohr.com/careers/' || CAST(ord AS VARCHAR) AS url FROM bb""")
def nrm_7(spark, d):
    return N.bamboohr_listing(_by(_payloads(spark, d), "bamboohr")).select("source_id", "id", "title", "url")


_BAMBOO_DETAIL = """
SELECT CAST(ord AS VARCHAR) AS id, title,
       CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 3 = 0 THEN 'Lehi, UT' WHEN ord % 3 = 1 THEN 'CA' ELSE nullif(location, '') END AS location,
       CASE WHEN ord % 7 <> 0 THEN 'Full-Time' END AS job_type,
       CASE WHEN ord % 7 <> 0 THEN 'About ' || title || chr(10) || 'One' || chr(10) || 'Two' END AS description
FROM bb"""


@register("nrm_8", _BAMBOO_SQL + _BAMBOO_DETAIL)
def nrm_8(spark, d):
    pay = _by(_payloads(spark, d), "bamboohr")
    return N.bamboohr_detail(N.bamboohr_listing(pay), pay).select("id", "title", "location", "job_type", "description")


@register("jn_2", _LEVER_SQL + """,
lastd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY ord DESC) AS rn FROM lv) WHERE rn = 1)
SELECT l.source_id, CAST(l.ord AS VARCHAR) AS id, l.url, d.location,
       CASE WHEN (d.ord // 20) % 2 = 0 THEN 'Full-time' ELSE 'Contract' END AS job_type
FROM lv l JOIN lastd d ON d.source_id = l.source_id AND d.url = l.url""")
def jn_2(spark, d):
    det = N.lever(_by(_payloads(spark, d), "lever"), convert=False)
    listings = det.select("source_id", "page_no", "pos", "id", "title", "url")
    return N.attach_detail(listings, det).select("source_id", "id", "url", "location", "job_type")


@register("str_27", _BAMBOO_SQL + "SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 3 = 0 THEN 'Lehi, UT' WHEN ord % 3 = 1 THEN 'CA' ELSE nullif(location, '') END AS location FROM bb")
def str_27(spark, d):
    pay = _by(_payloads(spark, d), "bamboohr")
    return N.bamboohr_detail(N.bamboohr_listing(pay), pay).select("id", "location")


@register("str_11", _BAMBOO_SQL + "SELECT CAST(ord AS VARCHAR) AS id, CASE WHEN ord % 7 <> 0 THEN 'About ' || title || chr(10) || 'One' || chr(10) || 'Two' END AS description FROM bb")
def str_11(spark, d):
    pay = _by(_payloads(spark, d), "bamboohr")
    return N.bamboohr_detail(N.bamboohr_listing(pay), pay).select("id", "description")


_WD_PATH = ("'/job/' || CASE ord % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Lehi' ELSE 'New-York' END || "
            "'/Role-' || CAST(ord AS VARCHAR) || '_R' || CAST(ord AS VARCHAR)")
_WD_PREFIX = "'https://co' || CAST(source_id AS VARCHAR) || '.wd5.myworkdayjobs.com/en-US/Board' || CAST(source_id AS VARCHAR)"
_WD_SQL = O.pay_with() + f""",
wd AS (SELECT *, {_WD_PATH} AS path, {_WD_PREFIX} AS prefix FROM pf2 WHERE pplat = 'workday' AND title_ok),
wd_single AS (SELECT source_id, 'R' || CAST(ord AS VARCHAR) AS id, title, prefix || path AS url,
                     nullif(location, '') AS location FROM wd WHERE (ord // 20) % 4 <> 0),
wd_var AS (
  SELECT source_id, 'R' || CAST(ord AS VARCHAR) AS id, title,
         prefix || regexp_replace(path, '^/job/[^/]+/', '/job/' || regexp_replace(trim(v), '\\s+', '-', 'g') || '/') AS url,
         v AS location
  FROM wd, unnest(['Lehi', 'Remote - US']) AS t(v) WHERE (ord // 20) % 8 = 0),
wd_none AS (SELECT source_id, 'R' || CAST(ord AS VARCHAR) AS id, title, prefix || path AS url, CAST(NULL AS VARCHAR) AS location
            FROM wd WHERE (ord // 20) % 4 = 0 AND (ord // 20) % 8 <> 0),
wd_all AS (SELECT * FROM wd_single UNION ALL SELECT * FROM wd_var UNION ALL SELECT * FROM wd_none)
"""


def _workday(spark, d):
    return N.workday(_by(_payloads(spark, d), "workday"), CFG_A.locations)


@register("nrm_9", _WD_SQL + "SELECT * FROM wd_single")
def nrm_9(spark, d):
    return _workday(spark, d).where(~F.col("multi_location")).select("source_id", "id", "title", "url", "location")


@register("nrm_10", _WD_SQL + "SELECT * FROM wd_var UNION ALL SELECT * FROM wd_none")
def nrm_10(spark, d):
    return _workday(spark, d).where(F.col("multi_location")).select("source_id", "id", "title", "url", "location")


@register("jn_4", _WD_SQL + "SELECT * FROM wd_all")
def jn_4(spark, d):
    return _workday(spark, d).select("source_id", "id", "title", "url", "location")


@register("win_4", _WD_SQL + "SELECT id, count(*) AS n FROM wd_all GROUP BY id")
def win_4(spark, d):
    return _workday(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("arr_4", _WD_SQL + "SELECT id, location FROM wd_var")
def arr_4(spark, d):
    return _workday(spark, d).where(F.col("location").isin("Lehi", "Remote - US")).select("id", "location")


@register("str_22", _WD_SQL + "SELECT url FROM wd_var")
def str_22(spark, d):
    return _workday(spark, d).where(F.col("location").isin("Lehi", "Remote - US")).select("url")


@register("str_24", _WD_SQL + "SELECT url FROM wd_single")
def str_24(spark, d):
    return nrm_9(spark, d).select("url")


_PHENOM_SQL = O.pay_with() + """,
ph0 AS (
  SELECT *, CASE ord % 3 WHEN 2 THEN 'https://co' || CAST(source_id AS VARCHAR) || '.phenompeople.com/job/SEQ' || CAST(ord AS VARCHAR)
                 ELSE url END AS eurl
  FROM pf2 WHERE pplat = 'phenom' AND title_ok),
ph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, eurl ORDER BY ord) AS rn FROM ph0) WHERE rn = 1)
"""


@register("nrm_13", _PHENOM_SQL + """
SELECT source_id, 'SEQ' || CAST(ord AS VARCHAR) AS id, title, eurl AS url,
       CASE WHEN (ord // 20) % 5 = 0 THEN coalesce(location, 'Unknown') || ' | Remote' ELSE location END AS location,
       'Full time' AS job_type FROM ph""")
def nrm_13(spark, d):
    return N.phenom(_by(_payloads(spark, d), "phenom"), convert=False).select(
        "source_id", "id", "title", "url", "location", "job_type")


@register("win_3", _PHENOM_SQL + "SELECT source_id, eurl AS url FROM ph")
def win_3(spark, d):
    return N.phenom(_by(_payloads(spark, d), "phenom"), convert=False).select("source_id", "url")


@register("str_23", O.pay_with() + """
SELECT source_id, url FROM pf2 WHERE pplat = 'phenom' AND ord % 3 = 0""")
def str_23(spark, d):
    pay = _by(_payloads(spark, d), "phenom")
    j = pay.select("source_id", F.explode(F.from_json("body", N.PHENOM_SCHEMA)["data"]["jobs"]).alias("j"))
    return j.where(F.col("j.applyUrl").isNotNull()).select("source_id", U.strip_apply(F.col("j.applyUrl")).alias("url"))


@register("win_6", _PHENOM_SQL + """,
doubled AS (SELECT DISTINCT source_id FROM pf2 WHERE source_id % 16 = 13),
sized AS (SELECT source_id, ord // 200 AS page_no, count(*) AS n FROM pf2 WHERE pplat = 'phenom' GROUP BY 1, 2),
heads AS (SELECT source_id, ord // 200 AS page_no, count(*) AS n_jobs FROM ph GROUP BY 1, 2),
landed AS (
  SELECT s.source_id, CASE WHEN d.source_id IS NULL THEN page_no ELSE 2 * page_no END AS page_no, n, coalesce(n_jobs, 0) AS n_jobs
  FROM sized s LEFT JOIN doubled d USING (source_id) LEFT JOIN heads USING (source_id, page_no)
  UNION ALL SELECT source_id, 2 * page_no + 1, n, 0 FROM sized SEMI JOIN doubled USING (source_id)),
stops AS (SELECT source_id, min(page_no) AS stop FROM landed WHERE page_no < 3 AND (n < 10 OR n_jobs = 0) GROUP BY 1)
SELECT source_id, CAST(sum(n_jobs) AS BIGINT) AS n_jobs, CAST(max(page_no) AS INT) AS last_page
FROM (SELECT l.* FROM landed l LEFT JOIN stops USING (source_id) WHERE page_no < 3 AND page_no <= coalesce(stop, page_no) AND n_jobs > 0)
GROUP BY source_id""")
def win_6(spark, d):
    """Short page, page limit, and nothing new: some sources land every page twice."""
    pay = _by(_payloads(spark, d), "phenom")
    twice = F.col("source_id") % 16 == 13
    first = F.when(twice, 2 * F.col("page_no")).otherwise(F.col("page_no")).cast("int")
    again = pay.where(twice).withColumn("page_no", (2 * F.col("page_no") + 1).cast("int"))
    pay = pay.withColumn("page_no", first).unionByName(again)
    jobs = N.phenom(pay, convert=False, page_size=10, max_pages=3, stop_without_news=True)
    return jobs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_jobs"), F.max("page_no").alias("last_page"))


@register("win_6_offsets", O.pay_with() + """,
sized AS (SELECT pplat AS platform, source_id, ord // 400 AS page_no, count(*) AS n FROM pf2 WHERE pplat IN ('workday', 'netflix') GROUP BY ALL),
totals AS (SELECT source_id, sum(n) AS total FROM sized GROUP BY 1),
stops AS (SELECT source_id, min(page_no) AS stop FROM sized JOIN totals USING (source_id)
          WHERE CASE platform WHEN 'workday' THEN (page_no + 1) * 50 >= total ELSE n < 15 OR page_no * 15 + n >= total END GROUP BY 1)
SELECT platform, source_id, count(*) AS pages_used FROM sized LEFT JOIN stops USING (source_id)
WHERE page_no <= coalesce(stop, page_no) GROUP BY ALL""")
def win_6_offsets(spark, d):
    """The offset rules of Workday and Netflix, with other page sizes than the landed ones."""
    pay = _payloads(spark, d)
    wd = N.workday_run(_by(pay, "workday").where(F.col("kind") == "list"), 50)
    used = wd.unionByName(N.netflix_run(_by(pay, "netflix"), 15))
    return used.groupBy("platform", "source_id").agg(F.count(F.lit(1)).alias("pages_used"))


_ORACLE_SQL = O.pay_with() + """,
orc AS (SELECT * FROM pf2 WHERE pplat = 'oracle' AND title_ok AND ord % 29 <> 0 AND (ord // 20) % 5 <> 0)
"""


@register("nrm_16", _ORACLE_SQL + """
SELECT source_id, CAST(ord AS VARCHAR) AS id, title,
       'https://careers.oracle.com/en/sites/jobsearch/jobs/preview/' || CAST(ord AS VARCHAR) AS url,
       CASE WHEN (ord // 20) % 6 = 0 THEN 'Remote - United States' ELSE location END AS location FROM orc""")
def nrm_16(spark, d):
    return N.oracle(_by(_payloads(spark, d), "oracle"), _run_ts(spark), convert=False).select(
        "source_id", "id", "title", "url", "location")


@register("flt_10", _ORACLE_SQL + "SELECT CAST(ord AS VARCHAR) AS id FROM orc")
def flt_10(spark, d):
    return N.oracle(_by(_payloads(spark, d), "oracle"), _run_ts(spark), convert=False).select("id")


@register("dt_1", O.pay_with() + """
SELECT CAST(ord AS VARCHAR) AS id, CASE (ord // 20) % 5 WHEN 0 THEN 45 WHEN 3 THEN 3 WHEN 4 THEN 10 END AS age_days
FROM pf2 WHERE pplat = 'oracle' AND title_ok AND ord % 29 <> 0""")
def dt_1(spark, d):
    pay = _by(_payloads(spark, d), "oracle")
    p = pay.withColumn("_p", F.from_json("body", N.ORACLE_SCHEMA))
    j = p.select(F.posexplode(F.element_at("_p.items", 1)["requisitionList"]).alias("pos", "j"))
    j = j.where((F.coalesce(F.col("j.Id"), F.lit("")) != "") & (F.coalesce(T.strip(F.col("j.Title")), F.lit("")) != ""))
    ts = F.try_to_timestamp(F.col("j.PostedDate"))
    age = F.datediff(_run_ts(spark), ts).cast("int")
    return j.select(F.col("j.Id").alias("id"), age.alias("age_days"))


@register("dt_3", O.pay_with() + f"""
SELECT CAST(ord AS VARCHAR) AS id, TIMESTAMP '{fx.RUN_TS}' - INTERVAL 30 DAYS AS cutoff
FROM pf2 WHERE pplat = 'oracle' AND title_ok AND ord % 29 <> 0 AND (ord // 20) % 5 <> 0""")
def dt_3(spark, d):
    kept = N.oracle(_by(_payloads(spark, d), "oracle"), _run_ts(spark), convert=False)
    return kept.select("id", (_run_ts(spark) - F.make_interval(days=F.lit(30))).alias("cutoff"))


@register("dt_2", O.with_cascade() + _NEWJOBS_SQL + "SELECT DISTINCT scraped_at AS run_ts FROM newjobs WHERE scraped_at IS NOT NULL")
def dt_2(spark, d):
    return _new_jobs(spark, d).where(F.col("scraped_at").isNotNull()).select(F.col("scraped_at").alias("run_ts")).distinct()


_NETFLIX_SQL = O.pay_with() + """,
nf AS (SELECT *, CASE WHEN (ord // 20) % 4 = 1 THEN title ELSE CASE WHEN ord % 23 = 0 THEN '' ELSE title END END AS etitle
       FROM pf2 WHERE pplat = 'netflix')
"""


@register("nrm_17", _NETFLIX_SQL + """
SELECT source_id, CASE WHEN ord % 37 = 0 THEN 'JR' || CAST(ord AS VARCHAR) ELSE CAST(ord AS VARCHAR) END AS id, etitle AS title,
       CASE WHEN ord % 3 <> 0 THEN url
            ELSE 'https://explore.jobs.netflix.net/careers/job/' || CASE WHEN ord % 37 = 0 THEN 'JR' ELSE '' END || CAST(ord AS VARCHAR) END AS url
FROM nf WHERE etitle <> ''""")
def nrm_17(spark, d):
    return N.netflix(_by(_payloads(spark, d), "netflix")).select("source_id", "id", "title", "url")


def _with(*parts: str) -> str:
    """Several of the payload oracles' CTEs after their common head."""
    return O.pay_with() + "".join(p.removeprefix(O.pay_with()) for p in parts)


@register("str_24_all", _with(_BAMBOO_SQL, _WD_SQL, _PHENOM_SQL, _ORACLE_SQL, _NETFLIX_SQL) + """
SELECT 'bamboohr' AS platform, 'https://co' || source_id || '.bamboohr.com/careers/' || ord AS url FROM bb
UNION ALL SELECT 'workday', url FROM wd_all
UNION ALL SELECT 'phenom', eurl FROM ph
UNION ALL SELECT 'oracle', 'https://careers.oracle.com/en/sites/jobsearch/jobs/preview/' || ord FROM orc
UNION ALL SELECT 'netflix', CASE WHEN ord % 3 <> 0 THEN url ELSE 'https://explore.jobs.netflix.net/careers/job/' ||
  CASE WHEN ord % 37 = 0 THEN 'JR' ELSE '' END || ord END FROM nf WHERE etitle <> ''""")
def str_24_all(spark, d):
    """The URL templates of all platforms that have one."""
    pay = cut_lineage(_payloads(spark, d))
    made = {"bamboohr": N.bamboohr_listing(_by(pay, "bamboohr")), "workday": N.workday(_by(pay, "workday"), CFG_A.locations),
            "phenom": N.phenom(_by(pay, "phenom"), convert=False),
            "oracle": N.oracle(_by(pay, "oracle"), _run_ts(spark), convert=False), "netflix": N.netflix(_by(pay, "netflix"))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(p).alias("platform"), "url") for p, df in made.items()])


@register("mth_3", O.pay_with() + """,
sized AS (SELECT source_id, ord // 400 AS page_no, count(*) AS n FROM pf2 WHERE pplat = 'workday' GROUP BY 1, 2),
totals AS (SELECT source_id, sum(n) AS total FROM sized GROUP BY 1),
landed AS (SELECT source_id, page_no FROM sized WHERE page_no % 3 <> 1 UNION ALL SELECT source_id, page_no + 1000000 FROM sized WHERE page_no % 4 = 0),
wanted AS (SELECT source_id, unnest(generate_series(0, (CAST(total AS BIGINT) - 1) // 20)) AS page_no FROM totals)
SELECT CAST(coalesce(w.source_id, l.source_id) AS INT) AS source_id, CAST(coalesce(w.page_no, l.page_no) AS BIGINT) AS page_no,
       CASE WHEN l.source_id IS NULL THEN 'missing' ELSE 'surplus' END AS state
FROM wanted w FULL JOIN landed l ON l.source_id = w.source_id AND l.page_no = w.page_no
WHERE w.source_id IS NULL OR l.source_id IS NULL""")
def mth_3(spark, d):
    """Landed Workday pages with holes and pages too many, against the stated totals."""
    pay = _by(_payloads(spark, d), "workday").where(F.col("kind") == "list")
    totals = pay.groupBy("source_id").agg(F.max(F.get_json_object("body", "$.total").cast("long")).alias("total"))
    landed = pay.where("page_no % 3 <> 1").select("source_id", "page_no").unionByName(
        pay.where("page_no % 4 = 0").select("source_id", (F.col("page_no") + 1000000).alias("page_no")))
    return PGN.page_gaps(totals, landed, 20)


@register("mth_3_pages", O.pay_with() + """
SELECT source_id, CAST(count(*) AS INT) AS total, CAST((count(*) + 19) // 20 AS INT) AS n_pages
FROM pf2 WHERE pplat = 'workday' GROUP BY source_id""")
def mth_3_pages(spark, d):
    pay = _by(_payloads(spark, d), "workday").where(F.col("kind") == "list")
    tot = pay.select("source_id", F.from_json("body", N.WD_LIST)["total"].alias("total")).groupBy("source_id").agg(
        F.max("total").cast("int").alias("total"))
    return tot.select("source_id", "total", F.size(N.pages_complete(F.col("total"), 20)).cast("int").alias("n_pages"))


@register("prj_1", _GH_SQL + "SELECT source_id, title, url FROM gh")
def prj_1(spark, d):
    return N.as_listing(N.greenhouse(_by(_payloads(spark, d), "greenhouse"), convert=False)).select("source_id", "title", "url")


@register("prj_2", _GH_SQL + "SELECT CAST(ord AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS job_type, CAST(NULL AS VARCHAR) AS salary FROM gh")
def prj_2(spark, d):
    return N.greenhouse(_by(_payloads(spark, d), "greenhouse"), convert=False).select("id", "company", "job_type", "salary")




_COUNT_EXPECT = O.pay_with() + """,
cnt AS (
  SELECT 'greenhouse' AS platform, count(*) AS n FROM pf2 WHERE pplat = 'greenhouse' AND title_ok
  UNION ALL SELECT 'lever', count(*) FROM pf2 WHERE pplat = 'lever' AND title_ok
  UNION ALL SELECT 'ashby', count(*) FROM pf2 WHERE pplat = 'ashby' AND title_ok AND ord % 9 <> 0
  UNION ALL SELECT 'bamboohr', count(*) FROM pf2 WHERE pplat = 'bamboohr' AND title_ok AND ord % 19 <> 0
  UNION ALL SELECT 'workday', count(*) + count(*) FILTER (WHERE (ord // 20) % 8 = 0) FROM pf2 WHERE pplat = 'workday' AND title_ok
  UNION ALL SELECT 'phenom', count(*) FROM (SELECT DISTINCT source_id, CASE ord % 3 WHEN 2 THEN 'SEQ' || CAST(ord AS VARCHAR) ELSE url END
                                            FROM pf2 WHERE pplat = 'phenom' AND title_ok)
  UNION ALL SELECT 'oracle', count(*) FROM pf2 WHERE pplat = 'oracle' AND title_ok AND ord % 29 <> 0 AND (ord // 20) % 5 <> 0
  UNION ALL SELECT 'netflix', count(*) FROM pf2 WHERE pplat = 'netflix' AND ((ord // 20) % 4 = 1 OR ord % 23 <> 0))
"""


@register("flt_9", _COUNT_EXPECT + "SELECT platform, n AS n_valid FROM cnt")
def flt_9(spark, d):
    return _all_norm(spark, d).where(FL.valid_record(F.col("title"), F.col("url"))).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n_valid"))


_FOUND_SQL = O.pay_with() + O.planned_cte() + """,
good AS (
  SELECT source_id, count(*) AS n FROM pf2 WHERE
    CASE pplat WHEN 'netflix' THEN (ord // 20) % 4 = 1 OR ord % 23 <> 0
               WHEN 'ashby' THEN title_ok AND ord % 9 <> 0 WHEN 'bamboohr' THEN title_ok AND ord % 19 <> 0
               WHEN 'oracle' THEN title_ok AND ord % 29 <> 0 AND (ord // 20) % 5 <> 0
               WHEN 'phenom' THEN false ELSE title_ok END GROUP BY 1
  UNION ALL SELECT source_id, count(*) FROM pf2 WHERE pplat = 'workday' AND title_ok AND (ord // 20) % 8 = 0 GROUP BY 1
  UNION ALL SELECT source_id, count(DISTINCT CASE ord % 3 WHEN 2 THEN 'SEQ' || CAST(ord AS VARCHAR) ELSE url END)
  FROM pf2 WHERE pplat = 'phenom' AND title_ok GROUP BY 1)
SELECT id AS source_id, company, CASE WHEN id % 9 IN (1, 2, 3, 4) AND status = 'success' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'success' AND id % 9 NOT IN (1, 2, 3, 4)
         THEN CAST(coalesce((SELECT sum(n) FROM good g WHERE g.source_id = p.id), 0) AS BIGINT) ELSE 0 END AS jobs_found,
  CASE WHEN id % 9 IN (1, 2, 3, 4) AND status = 'success' THEN
         CASE id % 9 WHEN 2 THEN 'Empty' WHEN 3 THEN 'Unexpected' ELSE 'Unreadable' END || ' payload on page 0' ELSE error END AS error
FROM planned p"""


from .plans import payload_runs as PR  # noqa: E402


def _spoilt_payloads(spark, d):
    pay = _payloads(spark, d)
    some = F.col("source_id") % 9
    spoilt = some.isin(1, 2, 3, 4) & (F.col("page_no") == 0)
    body = F.when(some == 1, "<html><body>502 Bad Gateway</body></html>").when(some == 2, " ").when(some == 3, "[]") \
        .otherwise('{"jobs": [{"title"')
    extra = pay.where(some.isin(1, 2, 3, 4)).select("source_id", "platform").distinct().select(
        "source_id", "platform", F.lit("list").alias("kind"), F.lit(0).alias("page_no"), F.lit("").alias("key"), body.alias("body"))
    return cut_lineage(pay.where(~spoilt).unionByName(extra))  # landed once, read by every platform's branch


_DRY_PAY_SQL = _PHENOM_SQL + O.planned_cte("active AND NOT requires_js") + f""",
rows AS (
  SELECT source_id, title, role_expected, CASE WHEN pplat = 'workday' AND (ord // 20) % 8 = 0 THEN 2 ELSE 1 END AS m FROM pf2 WHERE
    CASE pplat WHEN 'netflix' THEN (ord // 20) % 4 = 1 OR ord % 23 <> 0
               WHEN 'ashby' THEN title_ok AND ord % 9 <> 0 WHEN 'bamboohr' THEN title_ok AND ord % 19 <> 0
               WHEN 'oracle' THEN title_ok AND ord % 29 <> 0 AND (ord // 20) % 5 <> 0
               WHEN 'phenom' THEN false ELSE title_ok END
  UNION ALL SELECT source_id, title, role_expected, 1 FROM ph),
counts AS (
  SELECT source_id, sum(m) AS found,
    sum(m) FILTER (WHERE role_expected IN ('engineering_manager', 'product_manager')) AS ok,
    sum(m) FILTER (WHERE role_expected IN ('engineering_manager', 'product_manager') AND {O.like_any('title', CFG_A.blocked)}) AS blocked
  FROM rows GROUP BY 1),
base AS (
  SELECT p.id AS source_id, p.company, p.status = 'success' AND p.id % 9 NOT IN (1, 2, 3, 4) AS fine, c.*  EXCLUDE (source_id)
  FROM planned p LEFT JOIN counts c ON c.source_id = p.id),
b AS (SELECT source_id, company, CASE WHEN fine THEN coalesce(found, 0) ELSE 0 END AS found,
             CASE WHEN fine THEN coalesce(ok, 0) - coalesce(blocked, 0) ELSE 0 END AS would_add,
             CASE WHEN fine THEN coalesce(found, 0) - coalesce(ok, 0) ELSE 0 END AS filtered,
             CASE WHEN fine THEN coalesce(blocked, 0) ELSE 0 END AS blocked FROM base)
SELECT CASE WHEN grouping(source_id, company) > 0 THEN 'TOTAL' ELSE company END AS company, source_id,
       CAST(sum(found) AS BIGINT) AS found, CAST(sum(would_add) AS BIGINT) AS would_add,
       CAST(sum(filtered) AS BIGINT) AS filtered, CAST(sum(blocked) AS BIGINT) AS blocked
FROM b GROUP BY GROUPING SETS ((source_id, company), ())"""


def _payload_dry(spark, d):
    """The dry run by role and blocklist; locations only choose among a job's variants."""
    cfg = D.FilterConfig(roles=["engineering_manager", "product_manager"], blocked=CFG_A.blocked)
    planned = S.sources_all(_sources(spark, d))
    return PR.dry_run(planned, _spoilt_payloads(spark, d), cfg, _run_ts(spark), locations=CFG_A.locations)


@register("job_3_payloads", _DRY_PAY_SQL)
def job_3_payloads(spark, d):
    return _payload_dry(spark, d)[1]


_DISC_PAY_SQL = _with(_GH_SQL, _ASHBY_SQL, _BAMBOO_SQL, _PHENOM_SQL, _ORACLE_SQL) + O.planned_cte("active AND NOT requires_js") + f""",
wanted AS (
  SELECT source_id, {_GH_LOC} AS location, department FROM gh
  UNION ALL SELECT source_id, location, department FROM pf2 WHERE pplat = 'lever' AND title_ok
  UNION ALL SELECT source_id, array_to_string(parts, ' | '), department FROM ab
  UNION ALL SELECT source_id, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 3 = 0 THEN 'Lehi, UT' WHEN ord % 3 = 1 THEN 'CA' ELSE location END, NULL FROM bb
  UNION ALL SELECT source_id, CASE (ord // 20) % 16 WHEN 0 THEN 'Lehi | San Jose | Remote - US' WHEN 8 THEN 'Lehi | San Jose | Remote - US'
                                   WHEN 12 THEN 'Salt Lake City | Austin' WHEN 4 THEN NULL ELSE location END, NULL
            FROM pf2 WHERE pplat = 'workday' AND title_ok
  UNION ALL SELECT source_id, CASE WHEN (ord // 20) % 5 = 0 THEN coalesce(location, 'Unknown') || ' | Remote' ELSE location END, NULL FROM ph
  UNION ALL SELECT source_id, CASE WHEN (ord // 20) % 6 = 0 THEN 'Remote - United States' ELSE location END, NULL FROM orc),
listed AS (SELECT coalesce(s.extractor_type, 'unknown') AS platform_label, s.company, w.location, w.department
           FROM wanted w JOIN planned s ON s.id = w.source_id AND s.status = 'success' AND s.id % 9 NOT IN (1, 2, 3, 4)),
pvalues AS (
  SELECT DISTINCT * FROM (
    SELECT platform_label, company, 'location' AS kind, trim(unnest(string_split(location, ' | '))) AS value FROM listed
    UNION ALL SELECT platform_label, company, 'department', department FROM listed) WHERE value IS NOT NULL AND value <> '')
""" + _COUNTS_SQL


@register("job_4_payloads", _DISC_PAY_SQL)
def job_4_payloads(spark, d):
    """JOB-4 on landed payload rows; sources with an unusable payload are left out."""
    return PR.discovery(S.sources_all(_sources(spark, d)), _spoilt_payloads(spark, d), _run_ts(spark))


@register("job_1_payloads", _FOUND_SQL)
def job_1_payloads(spark, d):
    """JOB-1 on landed payload rows; the first payloads of some sources are an error
    page, empty, of another shape, or cut short."""
    pay = _spoilt_payloads(spark, d)
    _, results = PR.collection_run(_sources(spark, d), pay, None, CFG_A, _run_ts(spark), convert=False)
    return results.select("source_id", "company", "status", "jobs_found", "error")


def all_payloads(spark, d):
    """Every column of every platform's postings, descriptions converted, from
    payload rows that are landed once (the benchmark's EXT-1 job)."""
    from .session import cut_lineage
    return N.normalise_all(cut_lineage(_payloads(spark, d)), _run_ts(spark), CFG_A.locations)


def _all_norm(spark, d):
    return N.normalise_all(_payloads(spark, d), _run_ts(spark), CFG_A.locations, convert=False)


@register("set_3_payloads", _COUNT_EXPECT + "SELECT platform, n FROM cnt")
def set_3_payloads(spark, d):
    return _all_norm(spark, d).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


@register("ext_1", O.pay_with() + """
SELECT 'mine' AS platform, source_id, title, url, location FROM pf2 WHERE pplat = 'netflix'""")
def ext_1(spark, d):
    """A platform that the library does not know, added by its function; its
    payloads carry the postings of one fixture platform as plain rows."""
    own = "array<struct<title:string,url:string,location:string>>"
    p = _postings(spark, d).join(_sources_by_platform(spark, d, "netflix"), "source_id")
    body = F.to_json(F.collect_list(F.struct("title", "url", "location")))
    pay = p.groupBy("source_id", (F.col("ord") / 200).cast("int").alias("page_no")).agg(body.alias("body")).select(
        "source_id", F.lit("mine").alias("platform"), F.lit("list").alias("kind"), "page_no",
        F.lit("").alias("key"), "body")

    def mine(payloads):
        j = payloads.select("source_id", "page_no", F.posexplode(F.from_json("body", own)).alias("pos", "j"))
        return j.select("source_id", "page_no", "pos", "j.title", "j.url", "j.location")

    out = N.normalise_all(_payloads(spark, d).unionByName(pay), _run_ts(spark), CFG_A.locations,
                          extra={"mine": mine}, convert=False)
    return out.where(F.col("platform") == "mine").select("platform", "source_id", "title", "url", "location")


def _sources_by_platform(spark, d, platform):
    return _by(_payloads(spark, d), platform).select("source_id").distinct()


@register("src_7", _COUNT_EXPECT + "SELECT platform, n FROM cnt")
def src_7(spark, d):
    path = _scratch(spark, "payloads")
    _payloads(spark, d).write.mode("overwrite").parquet(path)
    landed = N.read_payloads(spark, path)
    return N.normalise_all(landed, _run_ts(spark), CFG_A.locations, convert=False).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ pages (F3)
from .functions import html as HT  # noqa: E402
from .functions import urls as U  # noqa: E402
from .operators import pages as PG  # noqa: E402


def _f3(spark, d):
    return fx.job_pages_df(spark, d)


_WD_LOC = """CASE WHEN json_type(ldt, '$.jobLocation') = 'OBJECT' THEN nullif(json_extract_string(ldt, '$.jobLocation.address.addressLocality'), '')
                 WHEN json_type(ldt, '$.jobLocation') = 'ARRAY' THEN nullif(array_to_string(list_filter(list_transform(
                      TRY_CAST(json_extract(ldt, '$.jobLocation') AS JSON[]), lambda e: json_extract_string(e, '$.address.addressLocality')),
                      lambda x: coalesce(x, '') <> ''), ' | '), '') END"""


@register("nrm_11", O.pages_with() + f"""
SELECT page_id, {O.tele_sql(_WD_LOC, "json_extract_string(ldt, '$.jobLocationType')")} AS location,
       json_extract_string(ldt, '$.employmentType') AS job_type, {O.salary_sql('ldt', False)} AS salary
FROM pg WHERE ldt IS NOT NULL""")
def nrm_11(spark, d):
    return PG.workday_page(_f3(spark, d), convert=False).select("page_id", "location", "job_type", "salary")


@register("str_17", O.pages_with() + f"SELECT page_id, {O.salary_sql('ldt', False)} AS salary FROM pg WHERE ldt IS NOT NULL")
def str_17(spark, d):
    return PG.workday_page(_f3(spark, d), convert=False).select("page_id", "salary")


@register("mth_1", O.pages_with() + f"""
SELECT page_id, {O.thousands("CAST(floor(TRY_CAST(json_extract_string(obj, '$.baseSalary.value.minValue') AS DOUBLE)) AS BIGINT)")} AS min_text
FROM pj WHERE TRY_CAST(json_extract_string(obj, '$.baseSalary.value.minValue') AS DOUBLE) IS NOT NULL""")
def mth_1(spark, d):
    p = _f3(spark, d).withColumn("_o", PG.unwrap_graph(PG.json_ld(F.col("html"))))
    bs = F.from_json(F.get_json_object("_o", "$.baseSalary.value"), "struct<minValue:string>")
    return p.where(bs["minValue"].isNotNull()).select("page_id", PG._int_commas(bs["minValue"]).alias("min_text"))


_PH_LOC = """CASE WHEN json_type(ldt, '$.jobLocation') = 'OBJECT' THEN nullif(json_extract_string(ldt, '$.jobLocation.address.addressLocality'), '') END"""
_PH_SQL = O.pages_with() + f""",
ph AS (
  SELECT page_id, {O.tele_sql(_PH_LOC, "json_extract_string(ldt, '$.jobLocationType')")} AS location,
         json_extract_string(ldt, '$.employmentType') AS job_type, trim(json_extract_string(ldt, '$.description')) AS description,
         coalesce(json_extract_string(ldt, '$."@type"') = 'JobPosting' AND coalesce(trim(json_extract_string(ldt, '$.description')), '') <> '', false) AS use_ld
  FROM pg)
"""


@register("nrm_14", _PH_SQL + "SELECT page_id, location, job_type, description FROM ph WHERE use_ld")
def nrm_14(spark, d):
    return PG.phenom_page(_f3(spark, d)).where(F.col("via") == "json_ld").select("page_id", "location", "job_type", "description")


def _f7(spark, d):
    """F7 detail pages that were fetched, the last fetch of each."""
    pages = P2.last_pages(fx.detail_pages_df(spark, _postings(spark, d))).where("error IS NULL")
    return pages.withColumn("url", F.lit("")).withColumnRenamed("url_hash", "page_id")


_F7_SQL = O.duck_with() + f""",
kinds AS ({fx.page_kinds_sql('duckdb')}),
f7 AS (SELECT url_hash AS page_id, kind, t, {fx.page_body('duckdb')} AS body, 'About ' || t || chr(10) || chr(10) || '- Build things' AS about
       FROM kinds WHERE kind <> 4)
"""


@register("nrm_11_text", _F7_SQL + "SELECT page_id, about AS description FROM f7 WHERE kind IN (0, 2)")
def nrm_11_text(spark, d):
    return PG.workday_page(_f7(spark, d)).select("page_id", "description")


@register("nrm_15", _F7_SQL + """SELECT page_id, 'page' AS via, CASE WHEN kind = 1 THEN 'Menu' || chr(10) || chr(10) || body END AS description
FROM f7 WHERE kind <> 0""")
def nrm_15(spark, d):
    return PG.phenom_page(_f7(spark, d)).where(F.col("via") == "page").select("page_id", "via", "description")


@register("nrm_18_text", _F7_SQL + "SELECT page_id, about AS description FROM f7 WHERE kind = 0")
def nrm_18_text(spark, d):
    return PG.netflix_page(_f7(spark, d)).where(F.col("via") == "json_ld").select("page_id", "description")


_NF_LOC = """CASE WHEN json_type(obj, '$.jobLocation') = 'OBJECT' THEN nullif(concat_ws(', ',
                 nullif(trim(coalesce(json_extract_string(obj, '$.jobLocation.address.addressLocality'), '')), ''),
                 nullif(trim(coalesce(json_extract_string(obj, '$.jobLocation.address.addressRegion'), '')), '')), '') END"""
_NF_SQL = O.pages_with() + f""",
nf AS (
  SELECT page_id, {O.tele_sql(_NF_LOC, "upper(json_extract_string(obj, '$.jobLocationType'))")} AS location,
         json_extract_string(obj, '$.employmentType') AS job_type, {O.salary_sql('obj', True)} AS salary,
         coalesce(json_extract_string(obj, '$."@type"') = 'JobPosting', false) AS is_post
  FROM pj)
"""


@register("nrm_18", _NF_SQL + "SELECT page_id, location, job_type, salary FROM nf WHERE is_post")
def nrm_18(spark, d):
    return PG.netflix_page(_f3(spark, d), convert=False).where(F.col("via") == "json_ld").select(
        "page_id", "location", "job_type", "salary")


@register("nrm_19", _F7_SQL + "SELECT page_id, 'page' AS via, CASE WHEN kind = 1 THEN body END AS description FROM f7 WHERE kind <> 0")
def nrm_19(spark, d):
    return PG.netflix_page(_f7(spark, d)).where(F.col("via") == "page").select("page_id", "via", "description")


@register("str_16", _NF_SQL + ", wdl AS (SELECT page_id, " + O.tele_sql(_WD_LOC, "json_extract_string(ldt, '$.jobLocationType')") +
          """ AS wd_location FROM pg WHERE ldt IS NOT NULL)
SELECT w.page_id, w.wd_location, n.location AS nf_location FROM wdl w JOIN nf n ON n.page_id = w.page_id AND n.is_post""")
def str_16(spark, d):
    pg = _f3(spark, d)
    w = PG.workday_page(pg, convert=False).select("page_id", F.col("location").alias("wd_location"))
    n = PG.netflix_page(pg, convert=False).where(F.col("via") == "json_ld").select("page_id", F.col("location").alias("nf_location"))
    return w.join(n, "page_id")


@register("jsn_1", O.pages_with() + "SELECT page_id, ldt AS json_ld FROM pg")
def jsn_1(spark, d):
    return _f3(spark, d).select("page_id", PG.json_ld(F.col("html")).alias("json_ld"))


@register("jsn_2", O.pages_with() + "SELECT page_id, json_extract_string(obj, '$.title') AS title, json_extract_string(obj, '$.\"@type\"') AS type FROM pj")
def jsn_2(spark, d):
    o = PG.unwrap_graph(PG.json_ld(F.col("html")))
    t = F.from_json(o, "struct<title:string,`@type`:string>")
    return _f3(spark, d).select("page_id", t["title"].alias("title"), t["@type"].alias("type"))


_BLOB_SQL = O.pages_with() + """,
blob AS (
  SELECT page_id AS source_id, 'Phenom role ' || CAST(page_id AS VARCHAR) || '-1' AS title,
         'https://co.example.org/job/' || CAST(page_id AS VARCHAR) || '-1' AS url, 'Lehi, UT' AS location FROM pg WHERE page_id % 2 = 0
  UNION ALL
  SELECT page_id, 'Phenom role ' || CAST(page_id AS VARCHAR) || '-2', scheme || '://' || host || '/job/S' || CAST(page_id AS VARCHAR),
         'Austin, TX | Remote' FROM pg WHERE page_id % 2 = 0)
"""


@register("nrm_12", _BLOB_SQL + "SELECT CAST(source_id AS INT) AS source_id, title, url, location FROM blob")
def nrm_12(spark, d):
    return PG.phenom_blob_listing(_f3(spark, d)).select("source_id", "title", "url", "location")


@register("jsn_3", _BLOB_SQL + "SELECT CAST(source_id AS INT) AS source_id, count(*) AS n_jobs FROM blob GROUP BY 1")
def jsn_3(spark, d):
    return PG.phenom_blob_listing(_f3(spark, d)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_jobs"))


_JOB_FRAG = " OR ".join(f"contains(lower(job_url), '{p}')" for p in FL.JOB_PATH_PATTERNS)
_GL_SQL = O.pages_with() + f""",
gl0 AS (SELECT * FROM anc2 WHERE length(text) BETWEEN 4 AND 120 AND job_url IS NOT NULL AND ({_JOB_FRAG})),
gl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, job_url ORDER BY pos) AS rn FROM gl0) WHERE rn = 1)
"""


@register("nrm_20", _GL_SQL + "SELECT page_id, job_url, pos, text AS title FROM gl")
def nrm_20(spark, d):
    return PG.generic_listing(_f3(spark, d)).select("page_id", "job_url", "pos", "title")


@register("win_2", _GL_SQL + "SELECT page_id, count(*) AS n_links FROM gl GROUP BY page_id")
def win_2(spark, d):
    return PG.generic_listing(_f3(spark, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


@register("udtf_1", O.pages_with() + "SELECT page_id, pos, text, href FROM anc2")
def udtf_1(spark, d):
    return PG.page_anchors(_f3(spark, d)).select("page_id", "pos", "text", "href")


@register("udtf_1_lateral", O.pages_with() + "SELECT page_id, pos, text, href FROM anc2")
def udtf_1_lateral(spark, d):
    HT.register_anchor_udtf(spark)
    return spark.sql("SELECT p.page_id, a.pos, a.text, a.href FROM {pg} p, LATERAL html_anchors(p.html) a",
                     pg=_f3(spark, d))


@register("flt_11", O.pages_with() + f"SELECT page_id, pos, ({_JOB_FRAG}) AS is_job FROM anc2 WHERE job_url IS NOT NULL")
def flt_11(spark, d):
    a = PG.page_anchors(_f3(spark, d)).withColumn("job_url", U.resolve_href(F.col("href"), F.col("url")))
    return a.where(F.col("job_url").isNotNull()).select("page_id", "pos", FL.is_job_link(F.col("job_url")).alias("is_job"))


@register("flt_12", O.pages_with() + "SELECT page_id, pos, coalesce(length(text) BETWEEN 4 AND 120, false) AS anchor_ok FROM anc2")
def flt_12(spark, d):
    return PG.page_anchors(_f3(spark, d)).select("page_id", "pos", FL.anchor_ok(F.col("text")).alias("anchor_ok"))


@register("str_25", O.pages_with() + "SELECT page_id, pos, job_url FROM anc2")
def str_25(spark, d):
    a = PG.page_anchors(_f3(spark, d))
    return a.select("page_id", "pos", U.resolve_href(F.col("href"), F.col("url")).alias("job_url"))


@register("src_8", O.duck_with() + "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def src_8(spark, d):
    from .operators.normalize import read_pages
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@register("str_13", O.duck_with() + "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'main' WHEN 4 THEN 'body' ELSE 'div' END AS content_tag FROM f3")
def str_13(spark, d):
    # the content element under another name in four of five pages, so that each choice is taken
    name = F.element_at(F.array(*[F.lit(x) for x in ('article', 'main', 'div id="Job-box"', 'div class="a jobs"', 'section')]),
                        (F.col("page_id") % 5 + 1).cast("int"))
    html = F.regexp_replace(F.regexp_replace(F.col("html"), F.lit("<article"), F.concat(F.lit("<"), name)),
                            F.lit("</article"), F.concat(F.lit("</"), F.split_part(name, F.lit(" "), F.lit(1))))
    html = F.when(F.col("page_id") % 5 == 4, F.regexp_replace(html, "job-links", "links")).otherwise(html)
    return _f3(spark, d).select("page_id", HT.content_tag(html).alias("content_tag"))


@register("str_9", O.duck_with() + """
SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
       '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages""")
def str_9(spark, d):
    t = F.regexp_extract(F.col("html"), "<title>(.*?)</title>", 1)
    return fx.load(spark, d, "pages", balance=True).select("page_id", HT.unescape(t).alias("title"))


@register("str_9_native", O.duck_with() + """
SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
       '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages""")
def str_9_native(spark, d):
    t = F.regexp_extract(F.col("html"), "<title>(.*?)</title>", 1)
    return fx.load(spark, d, "pages").select("page_id", T.decode_basic_entities(t).alias("title"))


# Markdown / text of pages and documents: no SQL form (rows-only check)
@register("udf_1")
def udf_1(spark, d):
    return _f3(spark, d).select("page_id", HT.page_markdown(F.col("html"), mode=None).alias("markdown"))


@register("udf_2")
def udf_2(spark, d):
    return _f3(spark, d).select("page_id", HT.page_text(F.col("html")).alias("text"))


@register("nrm_21")
def nrm_21(spark, d):
    return PG.generic_detail(_f3(spark, d)).select("page_id", "description")


@register("str_6")
def str_6(spark, d):
    return _f3(spark, d).select("page_id", HT.clean_html(F.col("html")).alias("markdown"))


@register("str_7")
def str_7(spark, d):
    return fx.load(spark, d, "documents", balance=True).select("doc_id", HT.clean_html(F.col("text")).alias("markdown"))


@register("str_12")
def str_12(spark, d):
    return _f3(spark, d).select("page_id", HT.page_markdown(F.col("html"), mode="generic").alias("markdown"))


@register("flt_13", O.duck_with() + "SELECT doc_id, CASE WHEN length(text) >= 500 THEN text END AS description FROM documents")
def flt_13(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", FL.min_text(F.col("text"), 500).alias("description"))


# ------------------------------------------------------------ documents text
@register("str_2", O.duck_with() + "SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def str_2(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", T.strip(F.col("text")).alias("text"))


@register("str_10", O.duck_with() + """
SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'),
                     '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '') AS text FROM documents""")
def str_10(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", T.collapse_text(F.col("text")).alias("text"))


@register("str_8", O.duck_with() + """
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[^\\x{00}-\\x{ff}]|[\\x{81}\\x{8d}\\x{8f}\\x{90}\\x{9d}]') THEN text
       ELSE translate(text, chr(128)||chr(130)||chr(131)||chr(132)||chr(133)||chr(134)||chr(135)||chr(136)||chr(137)||chr(138)||chr(139)||chr(140)||chr(142)||chr(145)||chr(146)||chr(147)||chr(148)||chr(149)||chr(150)||chr(151)||chr(152)||chr(153)||chr(154)||chr(155)||chr(156)||chr(158)||chr(159),
                      '€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ') END) AS h FROM documents""")
def str_8(spark, d):
    return fx.load(spark, d, "documents").select("doc_id", F.md5(T.repair_cp1252(F.col("text"))).alias("h"))


# ------------------------------------------------------ URLs and facets
_WD_SRC_SQL = O.duck_with() + """,
wdu AS (
  SELECT id, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'),
                     lambda x: x <> '' AND x NOT IN ('en-US', 'recruiting')) AS parts
  FROM f1 WHERE contains(url, 'myworkday')),
wdp AS (
  SELECT id, host, parts, nullif(regexp_extract(host, '^([^.]+)\\.(wd[0-9]+)\\.myworkday(jobs|site)\\.com', 1), '') AS c1,
         regexp_matches(host, '^(wd[0-9]+)\\.myworkday(jobs|site)\\.com') AS shape2
  FROM wdu)
"""


@register("str_20", _WD_SRC_SQL + """
SELECT id, 'https://' || host AS base_url, CASE WHEN c1 IS NOT NULL THEN c1 WHEN shape2 THEN parts[1] END AS company,
       CASE WHEN c1 IS NOT NULL THEN coalesce(CASE WHEN lower(parts[1]) = lower(c1) THEN parts[2] ELSE parts[1] END, c1)
            WHEN shape2 THEN coalesce(parts[2], parts[1]) END AS board
FROM wdp""")
def str_20(spark, d):
    s = _sources(spark, d).where(F.col("url").contains("myworkday"))
    w = U.workday_source(F.col("url"))
    return s.select("id", w["base_url"].alias("base_url"), w["company"].alias("company"), w["board"].alias("board"))


@register("str_21", _WD_SQL + """
SELECT 'https://co' || CAST(source_id AS VARCHAR) || '.wd5.myworkdayjobs.com' AS base_url, 'co' || CAST(source_id AS VARCHAR) AS company,
       'Board' || CAST(source_id AS VARCHAR) AS board, substr(url, strpos(url, '/job/')) AS job_path, url
FROM wd_all""")
def str_21(spark, d):
    j = _workday(spark, d)
    w = U.workday_job(F.col("url"))
    return j.select(w["base_url"].alias("base_url"), w["company"].alias("company"), w["board"].alias("board"),
                    w["job_path"].alias("job_path"), "url")


_QP_SQL = O.duck_with() + """,
qs AS (SELECT id, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS kvs FROM f1 WHERE contains(url, '?')),
qp AS (SELECT id, unnest(kvs) AS kv, unnest(range(len(kvs))) AS i FROM qs),
qd AS (
  SELECT id, i, url_decode(replace(split_part(kv, '=', 1), '+', ' ')) AS k,
         url_decode(replace(CASE WHEN strpos(kv, '=') > 0 THEN substr(kv, strpos(kv, '=') + 1) ELSE '' END, '+', ' ')) AS v
  FROM qp)
"""


@register("str_26", _QP_SQL + "SELECT id, k AS key, string_agg(v, '|' ORDER BY i) AS vals FROM qd WHERE v <> '' GROUP BY id, k")
def str_26(spark, d):
    s = _sources(spark, d).select("id", F.explode(U.query_map(F.col("url"))).alias("key", "v"))
    return s.select("id", "key", F.array_join("v", "|").alias("vals"))


@register("map_1", _QP_SQL + "SELECT id, k AS key, string_agg(v, '|' ORDER BY i) AS vals FROM qd WHERE v <> '' AND k IN (" +
          ", ".join(f"'{k}'" for k in U.WORKDAY_FACETS) + ") GROUP BY id, k")
def map_1(spark, d):
    s = _sources(spark, d).select("id", F.explode(U.query_map(F.col("url"), U.WORKDAY_FACETS)).alias("key", "v"))
    return s.select("id", "key", F.array_join("v", "|").alias("vals"))


# ---------------------------------------------------- departments (JOB-6)
_DEPT_SQL = O.pay_with() + """,
dep AS (
  SELECT source_id, CAST(source_id * 100 + CASE department WHEN 'Engineering' THEN 1 WHEN 'Data Science' THEN 2
                                                     WHEN 'Product' THEN 3 WHEN 'Sales' THEN 4 END AS BIGINT) AS dept_id,
         department AS name, count(*) AS n_jobs
  FROM pf2 WHERE pplat = 'greenhouse' AND department IS NOT NULL GROUP BY source_id, department)
"""


def _depts(spark, d):
    return DS.greenhouse_departments(PL.greenhouse_departments(_postings(spark, d)))


@register("nrm_22", _DEPT_SQL + "SELECT source_id, dept_id, name, CAST(n_jobs AS INT) AS n_jobs FROM dep")
def nrm_22(spark, d):
    return _depts(spark, d).select("source_id", "dept_id", "name", "n_jobs")


@register("job_6", _DEPT_SQL + "SELECT source_id, dept_id, name, CAST(n_jobs AS INT) AS n_jobs FROM dep ORDER BY name")
def job_6(spark, d):
    return _depts(spark, d).select("source_id", "dept_id", "name", "n_jobs")


@register("srt_4", _DEPT_SQL + "SELECT DISTINCT name FROM dep ORDER BY name")
def srt_4(spark, d):
    return _depts(spark, d).select("name").distinct().orderBy("name")


# ------------------------------------------------ last detail per URL (WIN-5)
@register("win_5", _LEVER_SQL + """
SELECT source_id, url, CAST(max(ord) AS VARCHAR) AS id FROM lv GROUP BY source_id, url""")
def win_5(spark, d):
    det = N.lever(_by(_payloads(spark, d), "lever"), convert=False)
    return N.last_detail_per_url(det).select("source_id", "url", "id")


@register("nrm_23", _BAMBOO_SQL + """
SELECT CAST(ord AS VARCHAR) AS id, title, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS description
FROM bb WHERE ord % 7 = 0""")
def nrm_23(spark, d):
    pay = _by(_payloads(spark, d), "bamboohr")
    out = N.bamboohr_detail(N.bamboohr_listing(pay), pay)
    return out.where(F.col("job_type").isNull()).select("id", "title", "location", "description")


# ------------------------------------------------------------ streaming
from .streaming import intake as ST  # noqa: E402

_STM_GROUPS = 4


def _stream_intake(spark, d):
    """Land the postings in source-order groups and let an availableNow
    stream take each landing in turn (as repeated runs would)."""
    p = _postings(spark, d)
    sources = _sources(spark, d)

    def planned():
        return C.plan(S.active_sources(sources))

    base = _scratch(spark, "stm")
    landing, jobs, ck = f"{base}/landing", f"{base}/jobs", f"{base}/ck-intake"
    prior = fx.stored_df(p)
    low, high = p.agg(F.min("source_id"), F.max("source_id")).first()
    for g in range(_STM_GROUPS):
        part = p.where(F.floor((F.col("source_id") - low) * _STM_GROUPS / (high - low + 1)) == g)
        part.write.mode("append").parquet(landing)
        q = ST.start_intake(spark, landing, p.schema, planned, CFG_A, jobs, ck, _run_ts(spark), prior=prior,
                            files_per_batch=1 << 20)
        q.awaitTermination()
    return base, jobs


@register("stm_1", O.with_cascade() + _NEWJOBS_SQL + "SELECT url_hash, source_id, title, scrape_status FROM newjobs")
def stm_1(spark, d):
    _, jobs = _stream_intake(spark, d)
    return spark.read.parquet(jobs).select("url_hash", "source_id", "title", "scrape_status")


@register("stm_2", O.with_cascade() + _NEWJOBS_SQL + _PASS2_SQL +
          "SELECT url_hash, location, job_type, salary, scrape_status, scrape_error FROM pass2")
def stm_2(spark, d):
    base, jobs = _stream_intake(spark, d)
    det = fx.details_df(spark, _postings(spark, d))
    landing, updates = f"{base}/details", f"{base}/updates"
    for g in range(2):
        det.where(F.abs(F.hash("url_hash")) % 2 == g).write.mode("append").parquet(landing)
        q = ST.start_details(spark, landing, det.schema, jobs, updates, f"{base}/ck-details", _run_ts(spark),
                             files_per_batch=1 << 20)
        q.awaitTermination()
    return ST.latest_jobs(spark, jobs, updates).select("url_hash", "location", "job_type", "salary", "scrape_status",
                                                       "scrape_error")
