"""Derived fixtures F1 (sources) and F2 (postings), built from the driver tables.

The text is plain SQL that both Spark and DuckDB run, so a Spark query and its
DuckDB oracle start from the same rows. Only ``CASE``, ``%``, ``||``,
``substr``, ``lower`` and SHA-256 are used; ``{sha}`` is the one dialect
difference. Every row of ``documents`` becomes one posting, so the work grows
with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values for the fixtures: title templates with the role the rules give
# them, locations, departments and the two filter configurations.
TITLES = [
    ("Senior Software Engineer", "engineer"),
    ("Product Manager, Payments", "product_manager"),
    ("Engineering Manager, Security Platform", "engineering_manager"),
    ("Technical Program Manager", "tpm"),
    ("Sr. Product Manager, AI/ML", "product_manager"),
    ("Manager II, Machine Learning Engineering", "engineering_manager"),
    ("Account Executive", None),
    ("Data Scientist, Compliance", "engineer"),
    ("Manager, Product Engineering", "engineering_manager"),
    ("Director of Product", "product_manager"),
    ("Senior Manager, People's Operations", "engineering_manager"),
    ("Staff Developer Advocate", "engineer"),
]
LOCATIONS = ["Remote - United States", "Lehi, UT", "New York, NY | Austin, TX |  New York, NY "]
DEPARTMENTS = ["Engineering", "Data Science", "Product", "Sales", None]

CONFIG_A = {
    "roles": "engineering_manager|product_manager|engineer",
    "blocked": "security|compliance",
    "locations": "remote|lehi",
    "departments": "engineering|data|product",
}
CONFIG_B = {
    "roles": "engineering_manager | product_manager | tpm",
    "blocked": "security| sales ",
    "locations": "remote|new york",
    "departments": "engineering|product",
}
RUN_TS = "2026-01-15 12:00:00"


def _sha(x: str, dialect: str) -> str:
    return f"sha2({x}, 256)" if dialect == "spark" else f"sha256({x})"


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _case(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def f1_sql(dialect: str, documents: str = "documents", supplier: str = "supplier") -> str:
    """F1 sources: one per distinct documents.source (srcN -> id N+1)."""
    slug = "lower(replace(sp.s_name, '#', ''))"
    url = f"""CASE n.id % 10
      WHEN 0 THEN 'https://boards.greenhouse.io/' || {slug} || '?department_id=41&department_id=7'
      WHEN 1 THEN 'https://jobs.lever.co/' || {slug} || '?location=Lehi%2C%20UT'
      WHEN 2 THEN 'https://jobs.ashbyhq.com/' || {slug}
      WHEN 3 THEN 'https://' || {slug} || '.bamboohr.com/careers'
      WHEN 4 THEN 'https://' || {slug} || '.wd5.myworkdayjobs.com/en-US/' || {slug} || '_External?locations=a1b2&locations=c3+d4&timeType=full&q=x'
      WHEN 5 THEN 'https://wd1.myworkdaysite.com/recruiting/' || {slug} || '/External_Careers?jobFamilyGroup=x%20y&jobFamilyGroup=z&ref=workday.com'
      WHEN 6 THEN 'https://' || {slug} || '.phenompeople.com/us/en/search-results?from=0&s=1'
      WHEN 7 THEN 'https://eeho.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_45001/requisitions?locationId=300&mode=job'
      WHEN 8 THEN 'https://explore.jobs.netflix.net/careers?domain=netflix.com&location=Remote'
      ELSE 'https://careers.' || {slug} || '.example.com/open-roles'
    END"""
    etype = """CASE WHEN n.id % 2 = 1 THEN NULL ELSE CASE n.id % 10
      WHEN 0 THEN 'Greenhouse' WHEN 2 THEN 'ashby' WHEN 4 THEN 'workday'
      WHEN 6 THEN 'lever' ELSE 'bogus' END END"""
    return f"""
SELECT CAST(n.id AS INT) AS id,
       sp.s_name AS company,
       {url} AS url,
       {etype} AS extractor_type,
       (n.id % 9 = 0) AS requires_js,
       (n.id % 7 <> 0) AS active
FROM (SELECT id, (id - 1) % (SELECT count(*) FROM {supplier}) AS sk
      FROM (SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS id
            FROM (SELECT DISTINCT source FROM {documents}) s) s2) n
JOIN {supplier} sp ON sp.s_suppkey = n.sk
"""


def f2_sql(dialect: str, documents: str = "documents") -> str:
    """F2 postings: one row per document; url carries the SHA-256 of the whole
    text, so exact copies of a document share a URL (real duplicates). Title
    template, department and salary phrase follow the position within the
    source, so every source sees all of them."""
    k = "CAST(floor(d.doc_id / 20) AS BIGINT)"  # position within the source (sources take every 20th id)
    a = "(90 + d.doc_id % 97)"
    b = "(120 + d.doc_id % 97 + d.doc_id % 13)"
    sa, sb = f"CAST({a} AS STRING)", f"CAST({b} AS STRING)"
    phrase = f"""CASE {k} % 16
      WHEN 0 THEN 'Salary: $' || {sa} || ',000 - $' || {sb} || ',000 per year.'
      WHEN 4 THEN 'Rate $' || CAST(20 + d.doc_id % 30 AS STRING) || '/hr or base $' || {sa} || ',500+ total.'
      WHEN 8 THEN 'Pay ' || {sa} || ',000 USD - ' || {sb} || ',000 USD yearly.'
      ELSE 'Range: $' || {sa} || 'K-$' || {sb} || 'K.' END"""
    expected = f"""CASE {k} % 16
      WHEN 0 THEN '$' || {sa} || ',000 - $' || {sb} || ',000'
      WHEN 4 THEN '$' || {sa} || ',500+'
      WHEN 8 THEN {sa} || ',000 USD - ' || {sb} || ',000 USD'
      ELSE '$' || {sa} || 'K-$' || {sb} || 'K' END"""
    title = _case(f"{k} % 12", [t for t, _ in TITLES])
    role = _case(f"{k} % 12", [r for _, r in TITLES])
    loc = _case("d.doc_id % 3", LOCATIONS)
    dept = _case(f"{k} % 5", DEPARTMENTS)
    return f"""
SELECT d.doc_id AS ord,
       CAST(CAST(substr(d.source, 4) AS BIGINT) + 1 AS INT) AS source_id,
       {title} || ' - Team ' || CAST(d.doc_id % 7 AS STRING) AS title,
       {role} AS role_expected,
       'https://jobs.example.com/posting/' || {_sha('d.text', dialect)} AS url,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE {loc} END AS location,
       {dept} AS department,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL
            WHEN {k} % 4 = 0 THEN {phrase} || ' ' || d.text
            ELSE d.text END AS description,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL
            WHEN {k} % 4 = 0 THEN {expected}
            ELSE NULL END AS salary_expected
FROM {documents} d
"""


def stored_sql(f2: str, dialect: str) -> str:
    """Jobs already in the curated table before the run: the URLs of every
    13th document (a prior state of the table, not a sample of the input)."""
    return f"SELECT DISTINCT {_sha('url', dialect)} AS url_hash FROM {f2} WHERE ord % 13 = 0"


def f3b_sql(dialect: str, f2: str = "f2") -> str:
    """F3b second-pass details, one per distinct URL of F2: a third full, a
    third with a blank description, a third failing (some errors contain
    '406', some are longer than 500 characters)."""
    first = "min_by" if dialect == "spark" else "arg_min"
    return f"""
SELECT url_hash,
  CASE WHEN o % 3 = 0 THEN 'Lehi, UT' END AS location,
  CASE WHEN o % 3 = 0 THEN 'Full-time' WHEN o % 3 = 1 THEN 'Contract' END AS job_type,
  CASE WHEN o % 3 = 0 THEN '$' || CAST(100 + o % 50 AS STRING) || ',000' END AS salary,
  CASE WHEN o % 3 = 0 THEN 'Full description of ' || t WHEN o % 3 = 1 THEN '   ' END AS description,
  CASE WHEN o % 3 = 2 THEN CASE WHEN o % 2 = 0 THEN 'HTTP error 406 Not Acceptable: ' || u
                                ELSE 'Timeout after 20 s: ' || repeat('x', 600) END END AS error
FROM (SELECT {_sha('url', dialect)} AS url_hash, min(ord) AS o, {first}(title, ord) AS t, {first}(url, ord) AS u
      FROM {f2} GROUP BY {_sha('url', dialect)}) g
"""


def page_kinds_sql(dialect: str, f2: str = "f2") -> str:
    """F7 the kind of detail page of each distinct URL of F2: 0 a job posting block,
    1 a long text, 2 a block of another type, 3 an empty page, 4 a failed fetch, 5 a
    short text. Every fifth URL was fetched before, in vain."""
    first = "min_by" if dialect == "spark" else "arg_min"
    return f"""
SELECT url_hash, o, replace(t, '"', '') AS t, u, o % 6 AS kind
FROM (SELECT {_sha('url', dialect)} AS url_hash, min(ord) AS o, {first}(title, ord) AS t, {first}(url, ord) AS u
      FROM {f2} GROUP BY {_sha('url', dialect)}) g"""


def page_block(dialect: str) -> str:
    """The JSON-LD text of kinds 0 and 2."""
    o = "CAST(o AS STRING)" if dialect == "spark" else "CAST(o AS VARCHAR)"
    return f"""('{{"@type": "' || CASE kind WHEN 0 THEN 'JobPosting' ELSE 'WebPage' END || '", "description": "<p>About ' || t
      || '</p><ul><li>Build things</li></ul>", "employmentType": "FULL_TIME", '
      || '"jobLocation": {{"address": {{"addressLocality": "Lehi", "addressRegion": "UT"}}}}, '
      || CASE WHEN o % 4 = 0 THEN '"jobLocationType": "TELECOMMUTE", ' ELSE '' END
      || '"baseSalary": {{"currency": "USD", "value": {{"minValue": ' || {o} || '100, "maxValue": ' || {o} || '900, "unitText": "YEAR"}}}}}}')"""


def page_body(dialect: str) -> str:
    """The text of kind 1: over 500 characters."""
    return "('Role of ' || t || repeat(' and more', 60))"


def f7_sql(dialect: str, f2: str = "f2") -> str:
    """F7 detail pages ``(url, fetch_no, html, error)`` of all URLs of F2."""
    return f"""
WITH kinds AS ({page_kinds_sql(dialect, f2)})
SELECT u AS url, CAST(1 AS INT) AS fetch_no,
  CASE WHEN kind IN (0, 2) THEN '<html><head><script type="application/ld+json">' || {page_block(dialect)}
         || '</script></head><body><nav>Menu</nav><main><p>Short note</p></main></body></html>'
       WHEN kind = 1 THEN '<html><body><nav>Menu</nav><main><p>' || {page_body(dialect)} || '</p></main></body></html>'
       WHEN kind = 3 THEN '' WHEN kind = 5 THEN '<html><body><main></main></body></html>' END AS html,
  CASE WHEN kind = 4 THEN 'Timeout after 20 s: ' || u END AS error
FROM kinds
UNION ALL SELECT u, CAST(0 AS INT), NULL, 'First try failed' FROM kinds WHERE o % 5 = 0"""


def f3_template() -> str:
    """F3 job pages: every page of ``pages`` with job links, one JSON-LD block
    and (even ids) a listing script blob inserted before ``</article>``.
    Values come from page_id. Braces are doubled for the SQL formatter."""
    p = "CAST(page_id AS STRING)"
    loc_obj = '{{"address": {{"addressLocality": "Lehi", "addressRegion": " UT "}}}}'
    loc_list = ('[{{"address": {{"addressLocality": "Lehi", "addressRegion": "UT"}}}}, '
                '{{"address": {{"addressLocality": "Provo"}}}}, {{"address": {{}}}}]')
    posting = f"""'{{{{"@type": "' || CASE WHEN page_id % 13 = 0 THEN 'WebPage' ELSE 'JobPosting' END
      || '", "title": "Role ' || {p} || '", "description": "<p>About role ' || {p} || '</p><ul><li>Build things</li></ul>"'
      || CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 3 = 0 THEN ', "jobLocation": {loc_list}'
              ELSE ', "jobLocation": {loc_obj}' END
      || CASE WHEN page_id % 5 = 0 THEN ', "jobLocationType": "TELECOMMUTE"'
              WHEN page_id % 10 = 1 THEN ', "jobLocationType": "telecommute"' ELSE '' END
      || ', "employmentType": "FULL_TIME"'
      || CASE WHEN page_id % 7 = 0 THEN ''
              WHEN page_id % 7 = 1 THEN ', "baseSalary": {{{{"currency": "USD", "value": {{{{"minValue": 120000.75}}}}}}}}'
              ELSE ', "baseSalary": {{{{"currency": "USD", "value": {{{{"minValue": ' || CAST(100000 + page_id AS STRING)
                   || '.9, "maxValue": ' || CAST(150000 + page_id AS STRING) || ', "unitText": "YEAR"}}}}}}}}' END
      || '}}}}'"""
    ld = f"""CASE WHEN page_id % 4 = 0
      THEN '{{{{"@context": "https://schema.org", "@graph": [{{{{"@type": "Organization", "name": "Acme"}}}}, ' || {posting} || ']}}}}'
      ELSE {posting} END"""
    blob = f"""CASE WHEN page_id % 2 = 0 THEN
      '<script type="text/javascript">var phApp = phApp || {{{{}}}}; phApp.ddo = {{{{"siteConfig": {{{{"a": 1}}}}, "eagerLoadRefineSearch": {{{{"status": 200, "data": {{{{"jobs": ['
      || '{{{{"title": "Phenom role ' || {p} || '-1", "applyUrl": "https://co.example.org/job/' || {p} || '-1/apply", "cityState": "Lehi, UT"}}}}, '
      || '{{{{"title": "Phenom role ' || {p} || '-2", "jobSeqNo": "S' || {p} || '", "multi_location": ["Austin, TX", "Remote"]}}}}'
      || ']}}}}, "totalHits": 2}}}}}}}}; track(' || {p} || ');</script>' ELSE '' END"""
    links = f"""'<div class="job-links">'
      || '<a href="/jobs/' || {p} || '">Open role ' || {p} || '</a>'
      || '<a href="/jobs/' || {p} || '">Open role again ' || {p} || '</a>'
      || '<a href="/careers/x' || {p} || '">Go</a>'
      || '<a href="https://jobs.example.org/positions/' || {p} || '">' || repeat('Long title ', 12) || '</a>'
      || '<a href=" https://jobs.example.org/positions/' || {p} || '?ref=1 ">Position ' || {p} || ' at example</a>'
      || '<a href="//cdn.example.org/openings/' || {p} || '">CDN opening ' || {p} || '</a>'
      || '<a href="apply/' || {p} || '">Relative apply link</a>'
      || '<a href="/about">About us page</a>'
      || '</div>'"""
    return f"""
SELECT page_id, url,
       replace(html, '</article>', {links}
               || '<script type="application/ld+json">' || {ld} || '</script>' || {blob} || '</article>') AS html
FROM {{pages}}
"""


# ---------------------------------------------------------------- Spark side
def load(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    """A driver table. ``balance`` spreads an under-split scan before
    per-row Python work (the HTML UDFs); native-only plans skip it."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if not balance:
        return df
    from .session import balance_input
    return balance_input(df, key=path)


def sources_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 sources."""
    return spark.sql(f1_sql("spark", "{documents}", "{supplier}"),
                     documents=load(spark, sf_dir, "documents"),
                     supplier=load(spark, sf_dir, "supplier"))


def postings_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 postings, with ``departments`` as an array (empty when unknown)."""
    df = spark.sql(f2_sql("spark", "{documents}"), documents=load(spark, sf_dir, "documents"))
    return df.withColumn(
        "departments",
        F.when(F.col("department").isNull(), F.array().cast("array<string>"))
         .otherwise(F.array(F.col("department"))))


def stored_df(postings: DataFrame) -> DataFrame:
    """Prior state of the jobs table (url_hash only)."""
    from .functions.text import hash_url
    return postings.where(F.col("ord") % 13 == 0).select(hash_url(F.col("url")).alias("url_hash")).distinct()


def job_pages_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 job pages."""
    return spark.sql(f3_template(), pages=load(spark, sf_dir, "pages", balance=True))


def detail_pages_df(spark: SparkSession, postings: DataFrame) -> DataFrame:
    """F7 detail pages."""
    return spark.sql(f7_sql("spark", "{f2}").replace("{", "{{").replace("}", "}}").replace("{{f2}}", "{f2}"),
                     f2=postings.select("ord", "title", "url"))


def details_df(spark: SparkSession, postings: DataFrame) -> DataFrame:
    """F3b details."""
    return spark.sql(f3b_sql("spark", "{f2}"), f2=postings.select("ord", "title", "url"))


# ---------------------------------------------------------------- DuckDB side
def duck_with(extra: str = "") -> str:
    """WITH-clause prefix defining f1, f2, f2a (f2 + departments list) and stored."""
    return f"""WITH f1 AS ({f1_sql('duckdb')}),
f2 AS ({f2_sql('duckdb')}),
stored AS ({stored_sql('f2', 'duckdb')}),
details AS ({f3b_sql('duckdb', 'f2')}),
f3 AS ({f3_template().format(pages='pages')}){extra}
"""
