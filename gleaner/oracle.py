"""DuckDB oracle SQL fragments for the registered queries.

These are independent re-statements of each operator in plain SQL over the
same fixtures (the window form of WIN-1, ``LIKE`` chains for the tests,
``CASE`` for routing), used only to check the Spark jobs.
"""

from __future__ import annotations

from .fixtures import CONFIG_A, CONFIG_B, duck_with
from .operators.decide import FilterConfig
from .operators.routing import DOMAINS, FALLBACK, JS_SKIP_ERROR, PLATFORMS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def like_any(col: str, kws: list[str] | None) -> str:
    if not kws:
        return "false"
    return "(" + " OR ".join(f"contains(lower({col}), {q(k)})" for k in kws) + ")"


def platform_sql(url: str = "url", etype: str = "extractor_type") -> str:
    plats = ", ".join(q(p) for p in PLATFORMS)
    whens = " ".join(f"WHEN contains(lower({url}), {q(d)}) THEN {q(p)}" for d, p in DOMAINS)
    return f"CASE WHEN lower({etype}) IN ({plats}) THEN lower({etype}) {whens} ELSE {q(FALLBACK)} END"


def host_sql(url: str = "url") -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)"


def error_sql(plat: str = "platform", url: str = "url") -> str:
    h = host_sql(url)
    path_parts = (f"list_filter(string_split(regexp_extract({url}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/'), "
                  "lambda x: x <> '' AND x NOT IN ('en-US', 'recruiting'))")
    wd_ok = (f"(regexp_matches({h}, '^[^.]+\\.wd[0-9]+\\.myworkday(jobs|site)\\.com') OR "
             f"(regexp_matches({h}, '^wd[0-9]+\\.myworkday(jobs|site)\\.com') AND len({path_parts}) >= 1))")
    return f"""CASE
      WHEN {plat} = 'greenhouse' AND NOT regexp_matches({url}, 'boards\\.greenhouse\\.io/[^/?#]+|[^/.]+\\.greenhouse\\.io')
        THEN 'Could not extract Greenhouse slug from URL: ' || {url}
      WHEN {plat} = 'lever' AND NOT regexp_matches({url}, 'jobs\\.lever\\.co/[^/?#]+')
        THEN 'Could not extract Lever slug from URL: ' || {url}
      WHEN {plat} = 'ashby' AND NOT regexp_matches({url}, 'jobs\\.ashbyhq\\.com/[^/?#]+')
        THEN 'Could not extract Ashby slug from URL: ' || {url}
      WHEN {plat} = 'bamboohr' AND NOT regexp_matches({url}, '[^/.]+\\.bamboohr\\.com')
        THEN 'Could not extract BambooHR subdomain from URL: ' || {url}
      WHEN {plat} = 'workday' AND NOT {wd_ok} THEN 'Could not parse Workday URL: ' || {url}
      WHEN {plat} = 'oracle' AND NOT ({h} = 'careers.oracle.com' OR regexp_matches({h}, '^[^.]+\\.fa\\.[^.]+\\.oraclecloud\\.com'))
        THEN 'Could not parse Oracle HCM URL: ' || {url}
    END"""


def planned_cte(where: str = "active") -> str:
    """planned: active sources with platform, error, status."""
    return f""",
p0 AS (SELECT *, {platform_sql()} AS platform FROM f1 WHERE {where}),
planned AS (
  SELECT *, CASE WHEN coalesce(requires_js, false) THEN {q(JS_SKIP_ERROR)} ELSE {error_sql()} END AS error,
         CASE WHEN coalesce(requires_js, false) THEN 'skipped'
              WHEN ({error_sql()}) IS NOT NULL THEN 'failed' ELSE 'success' END AS status
  FROM p0)"""


def repr_sql(col: str) -> str:
    """Python repr of a str without backslashes/newlines (fixture titles)."""
    return (f"CASE WHEN {col} IS NULL THEN 'None' "
            f"WHEN contains({col}, '''') AND NOT contains({col}, '\"') THEN '\"' || {col} || '\"' "
            f"ELSE '''' || replace({col}, '''', '\\''') || '''' END")


def cascade_ctes(cfg: FilterConfig, dedup: bool, where: str = "active", sfx: str = "", planned: bool = True) -> str:
    """planned + flagged + decided CTEs for the cascade over F2 (role from the
    closed-form expected value)."""
    roles = ", ".join(q(r) for r in (cfg.roles or []))
    role_ok = f"coalesce(role_expected IN ({roles}), false)" if cfg.roles else "true"
    loc_ok = (f"(coalesce(location, '') = '' OR {like_any('location', cfg.locations)})"
              if cfg.locations else "true")
    dept_ok = (f"(department IS NULL OR {like_any('department', cfg.departments)})"
               if cfg.departments else "true")
    blocked = like_any("title", cfg.blocked)
    dup = ("(already_stored OR earlier_twin)" if dedup else "false")
    added = "ADDED" if dedup else "WOULD ADD"
    twin = """coalesce(max(CASE WHEN role_ok AND NOT blocked AND location_ok AND department_ok THEN 1 ELSE 0 END)
               OVER (PARTITION BY url_hash ORDER BY source_order, ord
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1""" if dedup else "false"
    return (planned_cte(where) if planned else "") + f""",
flagged{sfx} AS (
  SELECT f2.*, s.company AS source_company, s.id AS source_order, s.platform,
         sha256(f2.url) AS url_hash, role_expected AS role,
         {role_ok} AS role_ok, {blocked} AS blocked, {loc_ok} AS location_ok, {dept_ok} AS department_ok
  FROM f2 JOIN planned s ON f2.source_id = s.id AND s.status = 'success'),
twins{sfx} AS (
  SELECT *, url_hash IN (SELECT url_hash FROM stored) AS already_stored, {twin} AS earlier_twin FROM flagged{sfx}),
stepped{sfx} AS (
  SELECT *, CASE WHEN NOT role_ok THEN 'role' WHEN blocked THEN 'blocked_title' WHEN {dup} THEN 'duplicate'
                 WHEN NOT location_ok THEN 'location' WHEN NOT department_ok THEN 'department' ELSE 'added' END AS step
  FROM twins{sfx}),
decided{sfx} AS (
  SELECT *, CASE step WHEN 'added' THEN '{added}' WHEN 'duplicate' THEN 'SKIPPED' ELSE 'FILTERED' END AS decision,
         CASE step WHEN 'role' THEN 'role=' || coalesce(role, 'None')
                   WHEN 'blocked_title' THEN 'blocked_title'
                   WHEN 'duplicate' THEN 'duplicate'
                   WHEN 'location' THEN 'location=' || {repr_sql('location')}
                   WHEN 'department' THEN 'dept=' || CASE WHEN department IS NULL THEN '[]' ELSE '[' || {repr_sql('department')} || ']' END
                   ELSE 'role=' || coalesce(role, 'None') || ' location=' || {repr_sql('location')} END AS reason
  FROM stepped{sfx})"""


CFG_A = FilterConfig.from_dict(CONFIG_A)
CFG_B = FilterConfig.from_dict(CONFIG_B)


def with_cascade(cfg: FilterConfig = CFG_A, dedup: bool = True, where: str = "active") -> str:
    return duck_with(cascade_ctes(cfg, dedup, where))


def with_planned(where: str = "active") -> str:
    return duck_with(planned_cte(where))


def with_two_dry_runs() -> str:
    """decided1 (CONFIG_A) and decided2 (CONFIG_B), dry-run form."""
    w = "active AND NOT requires_js"
    return duck_with(cascade_ctes(CFG_A, False, w, "1") + cascade_ctes(CFG_B, False, w, "2", planned=False))


LINE_PATTERN = "^\\[([^\\]]+)\\]\\s+(WOULD ADD|FILTERED)\\s+([^:]+):\\s+'(.+)'$"


def diff_ctes() -> str:
    """dec (F5), lines (F6), parsed, last, diff over the two dry runs."""
    pat = q(LINE_PATTERN)
    return with_two_dry_runs() + f""",
dec AS (
  SELECT 1 AS run_id, source_id, ord, ord * 2 + 1 AS line_no, source_company AS company, title, decision, reason, step FROM decided1
  UNION ALL
  SELECT 2 AS run_id, source_id, ord, ord * 2 + 1 AS line_no, source_company AS company, title, decision, reason, step FROM decided2),
lines AS (
  SELECT run_id, line_no, '[' || company || '] ' || decision || ' ' || reason || ': ' || {repr_sql('title')} AS line FROM dec
  UNION ALL
  SELECT run_id, min(ord) * 2, '[' || company || '] Found ' || CAST(count(*) AS VARCHAR) || ' listings' FROM dec GROUP BY run_id, source_id, company
  UNION ALL
  SELECT run_id, max(ord) * 2 + 2, '[' || company || '] found=' || CAST(count(*) AS VARCHAR)
         || '  would_add=' || CAST(count(*) FILTER (WHERE step = 'added') AS VARCHAR)
         || '  filtered=' || CAST(count(*) FILTER (WHERE step IN ('role', 'location', 'department')) AS VARCHAR)
         || '  blocked=' || CAST(count(*) FILTER (WHERE step = 'blocked_title') AS VARCHAR)
  FROM dec GROUP BY run_id, source_id, company),
parsed AS (
  SELECT run_id, line_no, regexp_extract(line, {pat}, 1) AS company, regexp_extract(line, {pat}, 2) AS decision,
         trim(regexp_extract(line, {pat}, 3)) AS reason, regexp_extract(line, {pat}, 4) AS title
  FROM lines WHERE regexp_matches(line, {pat})),
last AS (
  SELECT run_id, company, title, decision, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, company, title ORDER BY line_no DESC) AS rn FROM parsed) WHERE rn = 1),
diff AS (
  SELECT coalesce(a.company, b.company) AS company, coalesce(a.title, b.title) AS title,
         a.decision AS decision1, a.reason AS reason1, b.decision AS decision2, b.reason AS reason2,
         CASE WHEN b.decision IS NULL THEN 'only_in_run1' WHEN a.decision IS NULL THEN 'only_in_run2'
              WHEN a.decision = 'FILTERED' AND b.decision = 'WOULD ADD' THEN 'newly_added'
              WHEN a.decision = 'WOULD ADD' AND b.decision = 'FILTERED' THEN 'newly_filtered'
              WHEN a.reason <> b.reason THEN 'reason_changed' ELSE 'unchanged' END AS bucket
  FROM (SELECT * FROM last WHERE run_id = 1) a FULL OUTER JOIN (SELECT * FROM last WHERE run_id = 2) b
    ON a.company = b.company AND a.title = b.title)
"""


def runlog_ctes(ts_text: str) -> str:
    """runlog (line_no, line) of the collection run (cascade A with dedup)."""
    from .fixtures import duck_with as _dw
    stride = 1_000_000_000_000
    return with_cascade() + f""",
counts AS (
  SELECT source_id, count(*) AS found FROM decided GROUP BY source_id),
runlog AS (
  SELECT source_order * {stride} + ord * 2 + 1 AS line_no,
         '{ts_text},000 [INFO] [' || source_company || '] ' || decision || ' ' || reason || ': ' || {repr_sql('title')} AS line
  FROM decided
  UNION ALL
  SELECT id * {stride}, '{ts_text},000 [ERROR] [' || company || '] Scrape failed: ' || error FROM planned WHERE status = 'failed'
  UNION ALL
  SELECT id * {stride}, '{ts_text},000 [INFO] [' || company || '] Skipping — requires_js=TRUE' FROM planned WHERE status = 'skipped'
  UNION ALL
  SELECT p.id * {stride}, '{ts_text},000 [INFO] [' || p.company || '] Found ' || CAST(coalesce(c.found, 0) AS VARCHAR) || ' listings'
  FROM planned p LEFT JOIN counts c ON c.source_id = p.id WHERE p.status = 'success')
"""


PAY_PLATFORMS = ["greenhouse", "lever", "ashby", "bamboohr", "workday", "phenom", "oracle", "netflix"]


def thousands(x: str) -> str:
    """'123,456' text of a 4..6 digit integer expression."""
    return (f"CASE WHEN ({x}) >= 1000 THEN CAST(({x}) // 1000 AS VARCHAR) || ',' || "
            f"lpad(CAST(({x}) % 1000 AS VARCHAR), 3, '0') ELSE CAST(({x}) AS VARCHAR) END")


def pay_with() -> str:
    """pf2: F2 with its payload platform (source_id % 8) and the valid-title flag."""
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PAY_PLATFORMS))
    return duck_with() + f""",
pf2 AS (SELECT f2.*, CASE source_id % 8 {whens} END AS pplat, (ord % 23 <> 0) AS title_ok FROM f2)
"""


LD_RE_SQL = "'(?s)<script[^>]*type=\"application/ld\\+json\"[^>]*>(.*?)</script>'"
ANCHOR_RE_SQL = "'<a href=\"([^\"]*)\">([^<]*)</a>'"


def pages_with() -> str:
    """pg: F3 pages with scheme, host and the first JSON-LD block; obj: the
    @graph-unwrapped posting."""
    return duck_with() + f""",
pg AS (
  SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme,
         regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host,
         nullif(regexp_extract(html, {LD_RE_SQL}, 1), '') AS ldt
  FROM f3),
pj AS (
  SELECT *, CASE WHEN json_type(ldt, '$."@graph"') = 'ARRAY'
                 THEN coalesce(list_filter(TRY_CAST(json_extract(ldt, '$."@graph"') AS JSON[]),
                                           lambda g: json_extract_string(g, '$."@type"') = 'JobPosting')[1], ldt)
                 ELSE ldt END AS obj
  FROM pg),
anc AS (
  SELECT page_id, url, scheme, host,
         unnest(regexp_extract_all(html, {ANCHOR_RE_SQL}, 1)) AS href0,
         unnest(regexp_extract_all(html, {ANCHOR_RE_SQL}, 2)) AS text0,
         unnest(range(len(regexp_extract_all(html, {ANCHOR_RE_SQL}, 1)))) AS pos
  FROM pg),
anc2 AS (
  SELECT page_id, CAST(pos AS INT) AS pos, trim(text0) AS text, trim(href0) AS href,
         CASE WHEN starts_with(trim(href0), '/') THEN scheme || '://' || host || trim(href0)
              WHEN starts_with(trim(href0), 'http') THEN trim(href0) END AS job_url
  FROM anc)
"""


def salary_sql(j: str, open_ended: bool) -> str:
    mn = f"TRY_CAST(json_extract_string({j}, '$.baseSalary.value.minValue') AS DOUBLE)"
    mx = f"TRY_CAST(json_extract_string({j}, '$.baseSalary.value.maxValue') AS DOUBLE)"
    unit = f"json_extract_string({j}, '$.baseSalary.value.unitText')"
    cur = f"coalesce(json_extract_string({j}, '$.baseSalary.currency'), 'USD')"
    rng = (f"{cur} || ' ' || {thousands(f'CAST(floor({mn}) AS BIGINT)')} || '–' || {thousands(f'CAST(floor({mx}) AS BIGINT)')}"
           f" || CASE WHEN coalesce({unit}, '') <> '' THEN ' / ' || lower({unit}) ELSE '' END")
    out = f"CASE WHEN coalesce({mn}, 0) <> 0 AND coalesce({mx}, 0) <> 0 THEN {rng}"
    if open_ended:
        out += f" WHEN coalesce({mn}, 0) <> 0 THEN {cur} || ' ' || {thousands(f'CAST(floor({mn}) AS BIGINT)')} || '+'"
    return out + " END"


def tele_sql(loc: str, flag: str) -> str:
    return (f"CASE WHEN {flag} = 'TELECOMMUTE' THEN CASE WHEN coalesce({loc}, '') <> '' THEN {loc} || ' | Remote, US' "
            f"ELSE 'Remote, US' END ELSE {loc} END")
