"""JN-8 platform routing, STR-19 per-platform source checks, FLT-6 JS routing,
AGG-10 run status.

Routing is a first-match rule list; like the role rules it is a short literal
``CASE`` (9 + 9 branches), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.roles import read_rules

# Explicit platform names, then URL domain fragments in order
# (first match wins), then the fallback.
PLATFORMS = ["greenhouse", "lever", "ashby", "bamboohr", "workday", "phenom", "oracle", "netflix", "generic"]
DOMAINS = [
    ("greenhouse.io", "greenhouse"),
    ("lever.co", "lever"),
    ("ashbyhq.com", "ashby"),
    ("bamboohr.com", "bamboohr"),
    ("myworkdayjobs.com", "workday"),
    ("workday.com", "workday"),
    ("phenompeople.com", "phenom"),
    ("oraclecloud.com", "oracle"),
    ("netflix.net", "netflix"),
]
FALLBACK = "generic"
JS_SKIP_ERROR = "requires_js — awaiting Playwright service"


def route(url: Column, extractor_type: Column) -> Column:
    """JN-8: explicit known type first, else first domain in the URL, else generic."""
    t = F.lower(extractor_type)
    u = F.lower(url)
    expr = F.when(t.isin(PLATFORMS), t)
    for dom, plat in DOMAINS:
        expr = expr.when(u.contains(dom), F.lit(plat))
    return expr.otherwise(F.lit(FALLBACK))


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d, p) for i, (d, p) in enumerate(DOMAINS)],
                                 "priority INT, domain STRING, platform STRING")


def route_by_table(sources: DataFrame, domains: DataFrame) -> DataFrame:
    """JN-8 table form: ``id`` and ``platform`` by domains that are kept in a table,
    read once with its size checked; the first domain in the URL, by priority, counts."""
    t, url = F.lower(F.col("extractor_type")), F.lower(F.col("url"))
    platform = F.when(t.isin(PLATFORMS), t)
    for r in read_rules(domains):
        platform = platform.when(url.contains(F.lit(r.domain)), F.lit(r.platform))
    return sources.select("id", F.coalesce(platform, F.lit(FALLBACK)).alias("platform"))


def source_error(platform: Column, url: Column) -> Column:
    """STR-19 / STR-20: the error the platform raises on this source URL, else NULL."""
    def err(msg: str) -> Column:
        return F.concat(F.lit(msg), url)
    wd = U.workday_source(url)
    return (F.when((platform == "greenhouse") & U.greenhouse_slug(url).isNull(),
                   err("Could not extract Greenhouse slug from URL: "))
             .when((platform == "lever") & U.lever_slug(url).isNull(), err("Could not extract Lever slug from URL: "))
             .when((platform == "ashby") & U.ashby_slug(url).isNull(), err("Could not extract Ashby slug from URL: "))
             .when((platform == "bamboohr") & U.bamboohr_subdomain(url).isNull(),
                   err("Could not extract BambooHR subdomain from URL: "))
             .when((platform == "workday") & wd["board"].isNull(), err("Could not parse Workday URL: "))
             .when((platform == "oracle") & U.oracle_tenant(url).isNull(), err("Could not parse Oracle HCM URL: ")))


def source_slug(platform: Column, url: Column) -> Column:
    """STR-19: the board slug / subdomain / Workday company for the platform."""
    return (F.when(platform == "greenhouse", U.greenhouse_slug(url))
             .when(platform == "lever", U.lever_slug(url))
             .when(platform == "ashby", U.ashby_slug(url))
             .when(platform == "bamboohr", U.bamboohr_subdomain(url))
             .when(platform == "workday", U.workday_source(url)["company"])
             .when(platform == "oracle", U.oracle_tenant(url)))


def plan_sources(sources: DataFrame) -> DataFrame:
    """Active sources with platform, slug, error and the run status they will
    get: FLT-6 JS sources -> 'skipped'; a source whose URL its platform cannot
    read -> 'failed' (AGG-10); otherwise it will be collected."""
    plat = route(F.col("url"), F.col("extractor_type"))
    return (sources
            .withColumn("platform", plat)
            .withColumn("slug", source_slug(F.col("platform"), F.col("url")))
            .withColumn("error", F.when(F.coalesce(F.col("requires_js"), F.lit(False)), F.lit(JS_SKIP_ERROR))
                        .otherwise(source_error(F.col("platform"), F.col("url"))))
            .withColumn("status", F.when(F.coalesce(F.col("requires_js"), F.lit(False)), F.lit("skipped"))
                        .when(F.col("error").isNotNull(), F.lit("failed"))
                        .otherwise(F.lit("success"))))
