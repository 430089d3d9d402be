"""Normalisers over landed HTML pages (NRM-11, 12, 14, 15, 18, 19, 20, 21;
JSN-1, JSN-2; STR-16, STR-17; WIN-2; FLT-11..13; STR-25).

JSON-LD is found with one native ``regexp_extract`` and parsed with
``from_json``; only the markup work (anchors, page text, Markdown, the
script blob) goes through the Arrow UDFs of ``functions.html``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..functions.salary import extract_salary
from .normalize import first_per_key, phenom

# The JSON-LD script patterns (double quotes only; either quote,
# any case for the Netflix pages).
LD_RE = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
LD_RE_ANY = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
LD_SCHEMA = ("struct<`@type`:string,description:string,jobLocation:string,jobLocationType:string,"
             "employmentType:string,baseSalary:string,`@graph`:array<string>>")
ADDR = "struct<address:struct<addressLocality:string,addressRegion:string>>"
REMOTE_US = "Remote, US"


def json_ld(html: Column, any_quote: bool = False) -> Column:
    """JSN-1: text of the first application/ld+json script."""
    v = F.regexp_extract(html, LD_RE_ANY if any_quote else LD_RE, 1)
    return F.when(v != "", v)


def parse_ld(text: Column) -> Column:
    return F.from_json(text, LD_SCHEMA, {"mode": "PERMISSIVE"})


def unwrap_graph(text: Column) -> Column:
    """JSN-2: if the block has @graph, its first JobPosting object (as text)."""
    ld = parse_ld(text)
    graph = ld["@graph"]
    first = F.try_element_at(F.filter(graph, lambda g: F.from_json(g, "struct<`@type`:string>")["@type"] == "JobPosting"),
                             F.lit(1))
    return F.when(graph.isNotNull(), F.coalesce(first, text)).otherwise(text)


def _loc_dict(raw: Column) -> Column:
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, ADDR))


def _loc_list(raw: Column) -> Column:
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{ADDR}>"))


def telecommute(loc: Column, flag: Column, case_insensitive: bool = False) -> Column:
    """STR-16: '… | Remote, US' suffix (or 'Remote, US' alone)."""
    t = F.upper(flag) if case_insensitive else flag
    on = F.coalesce(t == "TELECOMMUTE", F.lit(False))
    return F.when(on & F.coalesce(loc != "", F.lit(False)), F.concat(loc, F.lit(" | " + REMOTE_US))) \
            .when(on, F.lit(REMOTE_US)).otherwise(loc)


def _num_true(v: Column) -> Column:
    return F.coalesce(v.try_cast("double") != 0, F.lit(False))


def _int_commas(v: Column) -> Column:
    """MTH-1: truncate to an integer, thousands separators."""
    return F.format_number(v.try_cast("decimal(38,6)").try_cast("bigint"), 0)


def salary_range(base_salary_raw: Column, open_ended: bool = False) -> Column:
    """STR-17: 'CUR min–max[ / unit]'; with ``open_ended`` a lone minimum gives
    'CUR min+' (Netflix)."""
    bs = F.when(F.ltrim(base_salary_raw).startswith("{"),
                F.from_json(base_salary_raw, "struct<currency:string,value:string>"))
    val = F.when(F.ltrim(bs["value"]).startswith("{"),
                 F.from_json(bs["value"], "struct<minValue:string,maxValue:string,unitText:string>"))
    cur = F.coalesce(bs["currency"], F.lit("USD"))
    both = _num_true(val["minValue"]) & _num_true(val["maxValue"])
    rng = F.concat(cur, F.lit(" "), _int_commas(val["minValue"]), F.lit("–"), _int_commas(val["maxValue"]))
    unit = val["unitText"]
    rng = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(rng, F.lit(" / "), F.lower(unit))).otherwise(rng)
    out = F.when(both, rng)
    if open_ended:
        out = out.when(_num_true(val["minValue"]), F.concat(cur, F.lit(" "), _int_commas(val["minValue"]), F.lit("+")))
    return out


def _with_listing(pages: DataFrame, listing: DataFrame | None) -> DataFrame:
    if "l_location" in pages.columns:  # the listing's values came with the page
        return pages
    if listing is None:
        return pages.withColumn("l_location", F.lit(None).cast("string")).withColumn(
            "l_job_type", F.lit(None).cast("string"))
    return pages.join(listing.select("page_id", F.col("location").alias("l_location"),
                                     F.col("job_type").alias("l_job_type")), "page_id", "left")


def workday_page(pages: DataFrame, listing: DataFrame | None = None, convert: bool = True) -> DataFrame:
    """NRM-11: first ld+json block (no @graph unwrap); description to
    Markdown; listing location preferred, else locality (object) or the
    localities of a list; telecommute suffix; pay range. A page without a
    block gives no detail row (the listing's own detail is used, NRM-23)."""
    p = _with_listing(pages, listing).withColumn("_ldt", json_ld(F.col("html"))).where(F.col("_ldt").isNotNull())
    p = p.withColumn("_ld", parse_ld(F.col("_ldt"))).where(F.col("_ld").isNotNull())
    raw = F.col("_ld.jobLocation")
    d, lst = _loc_dict(raw), _loc_list(raw)
    from_list = F.array_join(F.filter(F.transform(lst, lambda e: e["address"]["addressLocality"]),
                                      lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    ld_loc = (F.when(d.isNotNull(), F.when(F.coalesce(d["address"]["addressLocality"], F.lit("")) != "",
                                          d["address"]["addressLocality"]))
               .when(lst.isNotNull(), F.when(from_list != "", from_list)))
    # a missing jobLocation reads as {} -> no locality
    loc = F.coalesce(F.when(F.coalesce(F.col("l_location"), F.lit("")) != "", F.col("l_location")), ld_loc)
    loc = telecommute(loc, F.col("_ld.jobLocationType"))
    desc_raw = F.coalesce(F.col("_ld.description"), F.lit(""))
    desc = H.clean_html(desc_raw) if convert else F.when(desc_raw != "", desc_raw)
    return p.select("page_id", "url", loc.alias("location"), F.col("_ld.employmentType").alias("job_type"),
                    salary_range(F.col("_ld.baseSalary")).alias("salary"),
                    F.when(X.strip(desc) != "", X.strip(desc)).alias("description"))


def phenom_page(pages: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """NRM-14 (+ NRM-15 fallback): JSON-LD only when @type is JobPosting;
    description kept as raw HTML text (Q10); locality of an object; telecommute;
    listing fallbacks. Without a usable block the whole page goes to Markdown
    and counts only with >= 500 characters (FLT-13)."""
    p = _with_listing(pages, listing).withColumn("_ldt", json_ld(F.col("html")))
    p = p.withColumn("_ld", parse_ld(F.col("_ldt")))
    is_post = F.coalesce(F.col("_ld.`@type`") == "JobPosting", F.lit(False))
    d = _loc_dict(F.col("_ld.jobLocation"))
    loc = F.when(F.coalesce(d["address"]["addressLocality"], F.lit("")) != "", d["address"]["addressLocality"])
    loc = telecommute(loc, F.col("_ld.jobLocationType"))
    loc = F.coalesce(F.when(F.coalesce(loc, F.lit("")) != "", loc), F.col("l_location"))
    ld_desc = X.strip(F.coalesce(F.col("_ld.description"), F.lit("")))
    use_ld = is_post & (ld_desc != "")
    ld_rows = p.where(use_ld).select(
        "page_id", "url", loc.alias("location"),
        F.coalesce(F.when(F.col("_ld.employmentType") != "", F.col("_ld.employmentType")), F.col("l_job_type")).alias("job_type"),
        ld_desc.alias("description"), F.lit("json_ld").alias("via"))
    fb = p.where(~use_ld)
    md = H.page_markdown(F.col("html"), mode=None)
    fb_rows = fb.select("page_id", "url", F.col("l_location").alias("location"), F.col("l_job_type").alias("job_type"),
                        FL.min_text(md).alias("description"), F.lit("page").alias("via"))
    return ld_rows.unionByName(fb_rows)


def netflix_page(pages: DataFrame, convert: bool = True) -> DataFrame:
    """NRM-18 (+ NRM-19 fallback): first block (either quote, any case); the
    first JobPosting of @graph; locality + region; pay range or 'CUR min+';
    else the salary found in the description text. Without a JobPosting the
    page's content node (noise dropped) goes to Markdown, >= 500 characters."""
    p = pages.withColumn("_ldt", unwrap_graph(json_ld(F.col("html"), any_quote=True)))
    p = p.withColumn("_ld", parse_ld(F.col("_ldt")))
    is_post = F.coalesce(F.col("_ld.`@type`") == "JobPosting", F.lit(False))
    d = _loc_dict(F.col("_ld.jobLocation"))
    parts = F.filter(F.array(X.strip(F.coalesce(d["address"]["addressLocality"], F.lit(""))),
                             X.strip(F.coalesce(d["address"]["addressRegion"], F.lit("")))), lambda x: x != "")
    loc = F.when(F.size(parts) > 0, F.array_join(parts, ", "))
    loc = telecommute(loc, F.coalesce(F.col("_ld.jobLocationType"), F.lit("")), case_insensitive=True)
    raw = F.coalesce(F.col("_ld.description"), F.lit(""))
    desc = X.strip(H.clean_html(raw)) if convert else X.strip(raw)
    desc = F.when(raw != "", F.when(desc != "", desc))
    ld_rows = p.where(is_post).withColumn("_desc", desc).select(
        "page_id", "url", loc.alias("location"), F.col("_ld.employmentType").alias("job_type"),
        F.coalesce(salary_range(F.col("_ld.baseSalary"), open_ended=True),
                   extract_salary(F.col("_desc"))).alias("salary"),
        F.col("_desc").alias("description"), F.lit("json_ld").alias("via"))
    fb = p.where(~is_post).withColumn("_desc", FL.min_text(H.page_markdown(F.col("html"), mode="netflix")))
    fb_rows = fb.select("page_id", "url", F.lit(None).cast("string").alias("location"),
                        F.lit(None).cast("string").alias("job_type"),
                        extract_salary(F.col("_desc")).alias("salary"),
                        F.col("_desc").alias("description"), F.lit("page").alias("via"))
    return ld_rows.unionByName(fb_rows)


def phenom_blob_listing(pages: DataFrame) -> DataFrame:
    """NRM-12 + NRM-13: the eager-load JSON object of a ``text/javascript``
    script, then the Phenom listing rules (key = the page's scheme://host)."""
    base = F.concat(F.try_parse_url(F.col("url"), F.lit("PROTOCOL")), F.lit("://"),
                    F.try_parse_url(F.col("url"), F.lit("AUTHORITY")))
    payload = pages.select(F.col("page_id").cast("int").alias("source_id"), F.lit("phenom").alias("platform"),
                           F.lit("list").alias("kind"), F.lit(0).alias("page_no"), base.alias("key"),
                           H.phenom_blob(F.col("html")).alias("body")).where(F.col("body").isNotNull())
    return phenom(payload, convert=False)


def page_anchors(pages: DataFrame) -> DataFrame:
    """UDTF-1 (array form + posexplode): (page_id, url, pos, text, href)."""
    a = pages.select("page_id", "url", F.explode(H.html_anchors(F.col("html"))).alias("a"))
    return a.select("page_id", "url", F.col("a.pos").alias("pos"), F.col("a.text").alias("text"),
                    F.col("a.href").alias("href"))


def generic_listing(pages: DataFrame, fragments: list[str] | None = None) -> DataFrame:
    """NRM-20: every <a href> in order; text length 4..120 (FLT-12);
    root-relative resolved, other relative dropped (STR-25); job-link test
    (FLT-11); first passing anchor per href wins (WIN-2)."""
    a = page_anchors(pages)
    a = a.where(F.coalesce(F.col("text"), F.lit("")) != "").where(FL.anchor_ok(F.col("text")))
    a = a.withColumn("job_url", U.resolve_href(F.col("href"), F.col("url"))).where(F.col("job_url").isNotNull())
    a = a.where(FL.is_job_link(F.col("job_url"), fragments))
    a = a.select("page_id", "job_url", "pos", F.col("text").alias("title"))
    return first_per_key(a, ["page_id", "job_url"], ["pos"])


def generic_detail(pages: DataFrame, text_cap: int | None = None) -> DataFrame:
    """NRM-21: drop noise elements, choose the content node, newline text, cut
    to ``text_cap`` characters when given (UDF-2 + LIM-2)."""
    t = H.page_text(F.col("html"))
    kept = t if text_cap is None else X.cut(t, text_cap)
    return pages.select("page_id", "url", F.when(F.coalesce(t, F.lit("")) != "", kept).alias("description"))
