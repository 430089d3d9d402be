"""Payload normalisers (NRM-1..23, PRJ-1/2, SRC-7, EXT-1).

Each is a DataFrame -> DataFrame function over landed payload rows
``(source_id, platform, kind, page_no, key, body)``: ``from_json`` with an
explicit schema (PERMISSIVE, so a missing field is NULL), ``posexplode`` to
keep the order within a page, then native expressions. Union-typed fields
(string or object / list) are read as STRING -- Spark keeps the JSON text of
an object or array there -- and decoded a second time when they are one.

Output (PRJ-2, uniform detail): source_id, page_no, pos, id, title, url,
company, location, job_type, salary, description, requirements, departments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters as FL
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..session import cut_lineage
from .paging import at_total, before_stop, without_news

DETAIL_COLS = ["source_id", "page_no", "pos", "id", "title", "url", "company", "location", "job_type",
               "salary", "description", "requirements", "departments"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def _null() -> Column:
    return F.lit(None).cast("string")

PAYLOAD_SCHEMA = "source_id INT, platform STRING, kind STRING, page_no INT, key STRING, body STRING"


# ------------------------------------------------------------------- sources
def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-7: landed payload rows (one per response). JSON-lines landing is
    read with the same explicit schema (no inference)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(PAYLOAD_SCHEMA).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: landed HTML pages (page_id, url, html)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def _json_text_field(raw: Column, field: str) -> Column:
    """Value of ``field`` when ``raw`` is a JSON object, else ``raw`` itself."""
    obj = F.from_json(raw, f"struct<{field}:string>")
    return F.when(F.ltrim(raw).startswith("{"), obj[field]).otherwise(raw)


def _explode(df: DataFrame, schema: str, path: Callable[[Column], Column]) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json("body", schema, {"mode": "PERMISSIVE"}))
    return parsed.select("*", F.posexplode_outer(path(F.col("_p"))).alias("pos", "j")).where(F.col("j").isNotNull())


def _detail(df: DataFrame, **cols: Column) -> DataFrame:
    base = {"id": _null(), "company": _null(), "location": _null(), "job_type": _null(), "salary": _null(),
            "description": _null(), "requirements": _empty(), "departments": _empty()}
    base.update(cols)
    return df.select("source_id", "page_no", "pos", *[base[c].alias(c) if c in base else F.col(c)
                                                       for c in DETAIL_COLS[3:]])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key by ``order`` (WIN-2/3/4 set form): one
    ``min_by`` aggregate, combined map-side, so a key that holds a third of
    all rows never lands in one sort."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def as_listing(detail: DataFrame) -> DataFrame:
    """PRJ-1: uniform listing projection (order made explicit)."""
    return detail.select("source_id", "page_no", "pos", "title", "url")


# ---------------------------------------------------------------- Greenhouse
GH_SCHEMA = ("struct<jobs:array<struct<id:bigint,title:string,absolute_url:string,content:string,"
             "location:string,otherLocations:array<string>,departments:array<struct<name:string>>>>>")


def greenhouse(payloads: DataFrame, convert: bool = True) -> DataFrame:
    """NRM-1 + NRM-2: listing and detail from the one board payload."""
    j = _explode(payloads, GH_SCHEMA, lambda p: p["jobs"])
    title, url = X.strip(F.col("j.title")), X.strip(F.col("j.absolute_url"))
    j = j.where(FL.valid_record(F.col("j.title"), F.col("j.absolute_url")))
    primary = _json_text_field(F.col("j.location"), "name")
    first = F.when(F.coalesce(primary, F.lit("")) != "", F.array(X.strip(primary))).otherwise(_empty())
    others = F.transform(F.coalesce(F.col("j.otherLocations"), _empty()), lambda o: X.strip(_json_text_field(o, "name")))
    others = F.filter(others, lambda o: F.coalesce(o, F.lit("")) != "")
    parts = F.array_distinct(F.concat(first, others))
    loc = F.when(F.size(parts) > 0, F.array_join(parts, " | "))
    loc = X.us_remote(loc)
    depts = F.filter(F.transform(F.coalesce(F.col("j.departments"), F.array()), lambda d: d["name"]),
                     lambda n: F.coalesce(n, F.lit("")) != "")
    desc = H.clean_html(F.coalesce(F.col("j.content"), F.lit(""))) if convert else F.col("j.content")
    return _detail(j, id=F.col("j.id").cast("string"), title=title, url=url, location=loc,
                   departments=depts, description=desc)


# --------------------------------------------------------------------- Lever
LEVER_SCHEMA = ("array<struct<id:string,text:string,hostedUrl:string,lists:array<struct<text:string,content:string>>,"
                "descriptionPlain:string,description:string,"
                "categories:struct<location:string,team:string,commitment:string>>>")
# Section-name keywords that mark requirements (STR-31).
REQUIREMENT_KEYS = ["requirement", "qualif", "what you'll need", "what we're looking for"]


def section_is_requirements(name: Column) -> Column:
    """STR-31: section-name keyword test."""
    kws = F.array(*[F.lit(k) for k in REQUIREMENT_KEYS])
    return F.exists(kws, lambda k: F.lower(F.coalesce(name, F.lit(""))).contains(k))


def lever(payloads: DataFrame, location: str | None = None, convert: bool = True) -> DataFrame:
    """NRM-3 + NRM-4 (+ FLT-14 when the source URL names a location). A body
    that is not a top-level array gives no rows."""
    is_array = F.ltrim(F.col("body")).startswith("[")
    j = _explode(payloads.where(is_array), LEVER_SCHEMA, lambda p: p)
    j = j.where(FL.valid_record(F.col("j.text"), F.col("j.hostedUrl")))
    if location is not None:
        j = j.where(FL.lever_location(F.col("j.categories.location"), location))
    lists = F.coalesce(F.col("j.lists"), F.array().cast("array<struct<text:string,content:string>>"))
    # one Python call per posting for the text of all its sections (UDF-2)
    j = j.withColumn("_texts", H.html_text_array(F.transform(lists, lambda s: F.coalesce(s["content"], F.lit("")))))
    secs = F.zip_with(lists, F.col("_texts"), lambda s, t: F.struct(
        s["text"].alias("name"), t.alias("items"), section_is_requirements(s["text"]).alias("is_req")))
    j = j.withColumn("_secs", secs)
    req_secs = F.filter("_secs", lambda s: s["is_req"])
    last_req = F.try_element_at(req_secs, F.lit(-1))
    requirements = F.when(F.size(req_secs) > 0, X.requirement_lines(last_req["items"])).otherwise(_empty())
    others = F.transform(F.filter("_secs", lambda s: ~s["is_req"]),
                         lambda s: F.concat(F.coalesce(s["name"], F.lit("")), F.lit("\n"), s["items"]))
    raw = F.coalesce(F.when(F.col("j.descriptionPlain") != "", F.col("j.descriptionPlain")),
                     F.when(F.col("j.description") != "", F.col("j.description")), F.lit(""))
    plain = H.clean_html(raw) if convert else F.when(raw != "", raw)
    parts = F.concat(F.when(plain.isNotNull(), F.array(plain)).otherwise(_empty()), others)
    desc = X.strip(F.array_join(parts, "\n\n"))
    team = F.col("j.categories.team")
    return _detail(j, id=F.col("j.id"), title=X.strip(F.col("j.text")), url=X.strip(F.col("j.hostedUrl")),
                   location=F.col("j.categories.location"), job_type=F.col("j.categories.commitment"),
                   departments=F.when(F.coalesce(team, F.lit("")) != "", F.array(team)).otherwise(_empty()),
                   requirements=requirements,
                   description=F.when(desc != "", desc))


# --------------------------------------------------------------------- Ashby
ASHBY_JOB = ("struct<id:string,title:string,jobUrl:string,isListed:boolean,locationName:string,location:string,"
             "secondaryLocations:array<struct<location:string>>,otherLocations:array<string>,department:string,"
             "compensation:struct<minValue:string,maxValue:string,currencyCode:string,interval:string>,"
             "employmentType:string,descriptionHtml:string,description:string>")
ASHBY_SCHEMA = f"struct<jobPostings:array<{ASHBY_JOB}>,jobs:array<{ASHBY_JOB}>>"


def first_nonempty(a: Column, b: Column) -> Column:
    """ARR-3: first non-empty of two arrays."""
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)


def pay_range(min_v: Column, max_v: Column, currency: Column, unit: Column, decimals: bool = False) -> Column:
    """STR-17 / STR-18 / MTH-1: 'CUR min–max[ / unit]' with thousands commas.

    ``decimals=False`` truncates to int (Workday/Netflix); ``True`` keeps the
    number as given (Ashby), integral values without a decimal part."""
    def fmt(v: Column) -> Column:
        d = v.try_cast("decimal(38,6)")
        if not decimals:
            return F.format_number(d.try_cast("bigint"), 0)
        frac = F.regexp_extract(v, r"\.(\d+)$", 1)
        whole = F.format_number(d.try_cast("bigint"), 0)
        return F.when(frac != "", F.concat(whole, F.lit("."), frac)).otherwise(whole)
    return F.concat(F.coalesce(currency, F.lit("USD")), F.lit(" "), fmt(min_v), F.lit("–"), fmt(max_v))


def _truthy_num(v: Column) -> Column:
    return F.coalesce(v.try_cast("double") != 0, F.lit(False))


def ashby(payloads: DataFrame, convert: bool = True) -> DataFrame:
    """NRM-5 + NRM-6: jobPostings else jobs (empty list falls through),
    listed only; union-typed location and department; pay text."""
    p = payloads.withColumn("_p", F.from_json("body", ASHBY_SCHEMA, {"mode": "PERMISSIVE"}))
    jobs = first_nonempty(F.col("_p.jobPostings"), F.col("_p.jobs"))
    j = p.select("*", F.posexplode_outer(jobs).alias("pos", "j")).where(F.col("j").isNotNull())
    j = j.where(FL.valid_record(F.col("j.title"), F.col("j.jobUrl"), F.col("j.isListed")))
    raw_loc = F.coalesce(F.when(F.col("j.locationName") != "", F.col("j.locationName")),
                         F.when(F.col("j.location") != "", F.col("j.location")))
    as_list = F.from_json(raw_loc, "array<string>")
    first = (F.when(F.ltrim(raw_loc).startswith("["),
                    F.transform(F.filter(as_list, lambda x: F.coalesce(x, F.lit("")) != ""), X.strip))
              .when(raw_loc.isNotNull(), F.array(X.strip(raw_loc))).otherwise(_empty()))
    sec = F.filter(F.transform(F.coalesce(F.col("j.secondaryLocations"), F.array()), lambda s: X.strip(s["location"])),
                   lambda s: F.coalesce(s, F.lit("")) != "")
    oth = F.filter(F.transform(F.coalesce(F.col("j.otherLocations"), _empty()),
                               lambda o: X.strip(_json_text_field(o, "name"))), lambda s: F.coalesce(s, F.lit("")) != "")
    # the first list is kept as is; later ones are added only when new (ARR-2)
    j = j.withColumn("_first", first)
    extra = F.array_distinct(F.filter(F.concat(sec, oth), lambda s: ~F.array_contains(F.col("_first"), s)))
    parts = F.concat(F.col("_first"), extra)
    loc = F.when(F.size(parts) > 0, F.array_join(parts, " | "))
    dept_raw = F.col("j.department")
    dept_name = _json_text_field(dept_raw, "name")
    depts = F.when(F.coalesce(dept_name, F.lit("")) != "", F.array(dept_name)).otherwise(_empty())
    comp = F.col("j.compensation")
    salary = F.when(_truthy_num(comp["minValue"]) & _truthy_num(comp["maxValue"]),
                    X.strip(F.concat(pay_range(comp["minValue"], comp["maxValue"], comp["currencyCode"], None, True),
                                     F.lit(" "), F.coalesce(comp["interval"], F.lit(""))))).alias("salary")
    raw_desc = F.coalesce(F.when(F.col("j.descriptionHtml") != "", F.col("j.descriptionHtml")),
                          F.when(F.col("j.description") != "", F.col("j.description")), F.lit(""))
    desc = H.clean_html(raw_desc) if convert else raw_desc
    return _detail(j, id=F.col("j.id"), title=X.strip(F.col("j.title")), url=X.strip(F.col("j.jobUrl")),
                   location=loc, departments=depts, job_type=F.col("j.employmentType"), salary=salary,
                   description=desc).drop("_first")


# ------------------------------------------------------------------ BambooHR
BAMBOO_LIST = "struct<result:array<struct<id:string,jobOpeningName:string>>>"
BAMBOO_DETAIL = "struct<jobOpeningName:string,title:string,description:string,location:string,employmentType:string>"


def bamboohr_listing(payloads: DataFrame) -> DataFrame:
    """NRM-7: result[] -> title, URL from subdomain (payload key) + id."""
    j = _explode(payloads.where(F.col("kind") == "list"), BAMBOO_LIST, lambda p: p["result"])
    j = j.where((F.coalesce(X.strip(F.col("j.jobOpeningName")), F.lit("")) != "")
                & (F.coalesce(F.col("j.id"), F.lit("")) != "") & (F.col("j.id") != "0"))
    url = F.concat(F.lit("https://"), F.col("key"), F.lit(".bamboohr.com/careers/"), F.col("j.id"))
    return _detail(j, id=F.col("j.id"), title=X.strip(F.col("j.jobOpeningName")), url=url)


def bamboohr_detail(listing: DataFrame, payloads: DataFrame, text_cap: int | None = None) -> DataFrame:
    """NRM-8 (+ JN-2 / NRM-23): detail by job id; text description, cut to
    ``text_cap`` when one is given (LIM-2); 'city, state' stripped of commas/blanks; no detail -> bare listing."""
    det = payloads.where(F.col("kind") == "detail").select(
        F.col("source_id").alias("_sid"), F.col("key").alias("_id"),
        F.from_json("body", BAMBOO_DETAIL).alias("d"))
    j = listing.join(det, (listing["source_id"] == det["_sid"]) & (listing["id"] == det["_id"]), "left")
    raw_loc = F.col("d.location")
    obj = F.from_json(raw_loc, "struct<city:string,state:string>")
    loc = F.when(F.ltrim(raw_loc).startswith("{"), X.city_state(obj["city"], obj["state"])) \
           .when(F.coalesce(raw_loc, F.lit("")) != "", raw_loc)
    text = H.html_text(F.col("d.description"))
    desc = F.when(F.coalesce(text, F.lit("")) != "", text if text_cap is None else X.cut(text, text_cap))
    has = F.col("_id").isNotNull()
    return j.select(*[c for c in ("source_id", "page_no", "pos", "id") if c in listing.columns],
                    F.when(has, X.strip(F.coalesce(F.col("d.jobOpeningName"), F.col("d.title"), F.lit(""))))
                     .otherwise(F.col("title")).alias("title"),
                    "url", F.lit(None).cast("string").alias("company"),
                    F.when(has, loc).alias("location"), F.when(has, F.col("d.employmentType")).alias("job_type"),
                    _null().alias("salary"), F.when(has, desc).alias("description"),
                    _empty().alias("requirements"), _empty().alias("departments"))


# ------------------------------------------------------------------- Workday
WD_LIST = "struct<total:bigint,jobPostings:array<struct<title:string,externalPath:string,locationsText:string>>>"
WD_FACETS = ("struct<facets:array<struct<facetParameter:string,values:array<struct<descriptor:string,"
             "facetParameter:string,values:array<struct<descriptor:string>>>>>>>")


def workday_multi(loc_text: Column) -> Column:
    return F.coalesce(loc_text.rlike(r"(?i)^\d+ Locations?$"), F.lit(False))


def facet_locations(facets_body: Column) -> Column:
    """ARR-4: descriptors of the 'locations' facet, top level first, else
    nested one level down (first facet that has it)."""
    f = F.from_json(facets_body, WD_FACETS)["facets"]
    per_facet = F.transform(f, lambda x: F.when(x["facetParameter"] == "locations",
                                                F.transform(x["values"], lambda v: v["descriptor"]))
                            .otherwise(F.try_element_at(F.transform(
                                F.filter(x["values"], lambda v: v["facetParameter"] == "locations"),
                                lambda v: F.transform(v["values"], lambda w: w["descriptor"])), F.lit(1))))
    found = F.filter(per_facet, lambda a: F.coalesce(F.size(a), F.lit(0)) > 0)
    return F.try_element_at(found, F.lit(1))


def workday_run(payloads: DataFrame, page_size: int) -> DataFrame:
    """WIN-6 for Workday: listing pages up to the first empty one, or the one whose next
    offset reaches the stated total; other rows stay."""
    lists = payloads.where(F.col("kind") == "list")
    p = lists.withColumn("_p", F.from_json("body", WD_LIST))
    empty = F.coalesce(F.size("_p.jobPostings"), F.lit(0)) <= 0
    stop = empty | at_total(F.col("page_no"), page_size, F.coalesce(F.col("_p.total"), F.lit(0)))
    return before_stop(lists, p.where(stop)).unionByName(payloads.where(F.col("kind") != "list"))


def workday(payloads: DataFrame, target_locations: Sequence[str] | None, page_size: int | None = None) -> DataFrame:
    """NRM-9 + NRM-10 (+ JN-4, WIN-4, STR-22): listing pages; a multi-location
    job is looked up once in its facet payload and expanded to one posting
    per targeted location (URL city rewritten); no variant -> original URL
    with NULL location; later sightings of a resolved job are dropped. All landed
    pages count unless ``page_size`` asks for the offset rule (WIN-6)."""
    payloads = payloads if page_size is None else workday_run(payloads, page_size)
    j = _explode(payloads.where(F.col("kind") == "list"), WD_LIST, lambda p: p["jobPostings"])
    j = j.where(FL.valid_record(F.col("j.title"), F.col("j.externalPath")))
    path = X.strip(F.col("j.externalPath"))
    j = j.select("source_id", "page_no", "pos", "key", X.strip(F.col("j.title")).alias("title"),
                 path.alias("path"), F.col("j.locationsText").alias("loc_text"),
                 U.workday_job_id(path).alias("job_id"))
    j = j.withColumn("_multi", workday_multi(F.col("loc_text")))
    # WIN-4: the first sighting of a multi-location job id (per source) is
    # resolved; later sightings are dropped; rows without an id always pass.
    once = j.where(F.col("_multi") & F.col("job_id").isNotNull())
    j = j.where(~F.col("_multi") | F.col("job_id").isNull()).unionByName(
        first_per_key(once, ["source_id", "job_id"], ["page_no", "pos"]).select(*j.columns))
    facets = payloads.where(F.col("kind") == "facets").select(
        F.col("source_id").alias("_fsid"), F.col("key").alias("_fid"), facet_locations(F.col("body")).alias("_locs"))
    # JN-4: facet payload by job id (left join; only multi-location rows look it up)
    j = j.join(facets, (F.col("_multi")) & (j["source_id"] == facets["_fsid"]) & (j["job_id"] == facets["_fid"]), "left")
    targeted = F.filter(F.coalesce(F.col("_locs"), _empty()),
                        lambda d: (F.coalesce(d, F.lit("")) != "") & FL.location_targeted(d, target_locations))
    j = j.withColumn("_variants", F.when(F.col("_multi"), targeted).otherwise(_empty()))
    j = j.select("*", F.posexplode_outer(F.when(F.size("_variants") > 0, F.col("_variants"))).alias("_vpos", "_v"))
    url_path = F.when(F.col("_v").isNotNull(), U.rewrite_city(F.col("path"), U.location_slug(F.col("_v")))) \
                .otherwise(F.col("path"))
    loc = F.when(F.col("_v").isNotNull(), F.col("_v")).when(F.col("_multi"), _null()) \
           .otherwise(F.when(F.coalesce(F.col("loc_text"), F.lit("")) != "", F.col("loc_text")))
    out = j.select("source_id", "page_no", (F.shiftleft(F.col("pos").cast("bigint"), 32) + F.coalesce(F.col("_vpos"), F.lit(0))).alias("pos"),
                   F.col("job_id").alias("id"), "title", F.concat(F.col("key"), url_path).alias("url"),
                   _null().alias("company"), loc.alias("location"), _null().alias("job_type"),
                   _null().alias("salary"), _null().alias("description"), _empty().alias("requirements"),
                   _empty().alias("departments"), F.col("_multi").alias("multi_location"))
    return out


# -------------------------------------------------------------------- Phenom
PHENOM_SCHEMA = ("struct<data:struct<jobs:array<struct<title:string,applyUrl:string,absoluteUrl:string,"
                 "jobSeqNo:string,jobId:string,descriptionTeaser:string,"
                 "ml_job_parser:struct<descriptionTeaser_first200:string>,multi_location:array<string>,"
                 "cityState:string,type:string>>>>")


def phenom(payloads: DataFrame, convert: bool = True, page_size: int | None = None,
           max_pages: int | None = None, stop_without_news: bool = False) -> DataFrame:
    """NRM-13 (+ WIN-3 fixed form): apply URL, else absolute, else built from
    the sequence number; trailing '/apply' stripped; first sighting of a URL
    per source kept. All landed pages count; ``page_size`` (stop at the first
    shorter page), ``max_pages`` and ``stop_without_news`` (stop at the first page
    without a URL that is new to the source) cut the run only when given (WIN-6)."""
    p = payloads.withColumn("_p", F.from_json("body", PHENOM_SCHEMA))
    if max_pages is not None:
        p = p.where(F.col("page_no") < max_pages)
    landed = p
    j = p.select("*", F.posexplode_outer("_p.data.jobs").alias("pos", "j")).where(F.col("j").isNotNull())
    seq = F.coalesce(F.when(F.col("j.jobSeqNo") != "", F.col("j.jobSeqNo")), F.when(F.col("j.jobId") != "", F.col("j.jobId")))
    built = F.when(seq.isNotNull(), F.concat(F.col("key"), F.lit("/job/"), seq))
    url = F.coalesce(F.when(F.col("j.applyUrl") != "", F.col("j.applyUrl")),
                     F.when(F.col("j.absoluteUrl") != "", F.col("j.absoluteUrl")), built)
    j = j.withColumn("_url", U.strip_apply(url)).where(
        (F.coalesce(X.strip(F.col("j.title")), F.lit("")) != "") & F.col("_url").isNotNull() & (F.col("_url") != ""))
    j = j.select("source_id", "page_no", "pos", "key", "j", "_url")
    j = first_per_key(j, ["source_id", "_url"], ["page_no", "pos"])
    stops = phenom_stops(landed, j, page_size, stop_without_news)
    j = j if stops is None else before_stop(j, stops)
    teaser = F.coalesce(F.when(F.col("j.descriptionTeaser") != "", F.col("j.descriptionTeaser")),
                        F.when(F.col("j.ml_job_parser.descriptionTeaser_first200") != "",
                               F.col("j.ml_job_parser.descriptionTeaser_first200")), F.lit(""))
    ml = F.col("j.multi_location")
    loc = F.when(F.coalesce(F.size(ml), F.lit(0)) > 0, F.array_join(ml, " | ")).otherwise(F.col("j.cityState"))
    return _detail(j, id=seq, title=X.strip(F.col("j.title")), url=F.col("_url"), location=loc,
                   job_type=F.col("j.type"), description=H.clean_html(teaser) if convert else teaser)


def phenom_stops(landed: DataFrame, firsts: DataFrame, page_size: int | None, stop_without_news: bool) -> DataFrame | None:
    """Pages that end a source's run: shorter than ``page_size``, or without a new URL."""
    stops = []
    if page_size is not None:
        short = F.coalesce(F.size("_p.data.jobs"), F.lit(0)) < page_size
        stops.append(landed.where(short).select("source_id", "page_no"))
    if stop_without_news:
        stops.append(without_news(landed, firsts))
    return None if not stops else stops[0] if len(stops) == 1 else stops[0].unionByName(stops[1])


def page_run(pages: DataFrame, keys: list[str], stop: Column, max_pages: int | None = None) -> DataFrame:
    """WIN-6: keep pages in order up to and including the first page that
    stops the run (empty / short / nothing new), at most ``max_pages``.

    Written as an aggregate (first stopping page per source) joined back,
    so a source with very many pages is combined map-side, not sorted in one
    window partition."""
    pages = pages.withColumn("_stop", stop)
    if max_pages is not None:
        pages = pages.where(F.col("page_no") < max_pages)
    first_stop = pages.where("_stop").groupBy(*keys).agg(F.min("page_no").alias("_first_stop"))
    out = pages.join(first_stop, keys, "left")
    return out.where(F.col("_first_stop").isNull() | (F.col("page_no") <= F.col("_first_stop"))).drop("_stop", "_first_stop")


def pages_complete(total: Column, page_size: int) -> Column:
    """MTH-3: offsets 0, size, 2*size, ... below total (pages to expect)."""
    return F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"), F.lit(page_size)))


# -------------------------------------------------------------------- Oracle
ORACLE_SCHEMA = ("struct<items:array<struct<TotalJobsCount:bigint,requisitionList:array<struct<Id:string,Title:string,"
                 "PostedDate:string,PrimaryLocation:string,ShortDescriptionStr:string>>>>>")
# Fixed value: the address of a posting before its id.
ORACLE_JOB_URL = "https://careers.oracle.com/en/sites/jobsearch/jobs/preview/"


def oracle(payloads: DataFrame, now: Column, page_size: int | None = None, days: int = 30, convert: bool = True) -> DataFrame:
    """NRM-16 (+ FLT-10, STR-15): items[0].requisitionList, URL from id, recency
    cut, 'United States' rewrite, short description. All landed pages count; with
    ``page_size``, pages whose offset lies beyond a stated total do not (WIN-6)."""
    p = payloads.withColumn("_p", F.from_json("body", ORACLE_SCHEMA))
    item = F.try_element_at(F.col("_p.items"), F.lit(1))
    if page_size is not None:
        p = p.where(F.coalesce(F.col("page_no") * page_size < item["TotalJobsCount"], F.lit(True)))
    j = p.select("*", F.posexplode_outer(item["requisitionList"]).alias("pos", "j")).where(F.col("j").isNotNull())
    jid = X.strip(F.coalesce(F.col("j.Id"), F.lit("")))
    j = j.where((jid != "") & (F.coalesce(X.strip(F.col("j.Title")), F.lit("")) != ""))
    j = j.where(FL.recent(F.col("j.PostedDate"), now, days))
    desc = H.clean_html(F.coalesce(F.col("j.ShortDescriptionStr"), F.lit(""))) if convert else F.col("j.ShortDescriptionStr")
    return _detail(j, id=jid, title=X.strip(F.col("j.Title")), url=F.concat(F.lit(ORACLE_JOB_URL), jid),
                   location=X.us_remote(F.col("j.PrimaryLocation")), description=desc)


# ------------------------------------------------------------------- Netflix
NETFLIX_SCHEMA = ("struct<count:bigint,positions:array<struct<id:string,name:string,posting_name:string,"
                  "ats_job_id:string,canonicalPositionUrl:string>>>")
# Fixed value: where postings without an address of their own are shown.
NETFLIX_JOB_URL = "https://explore.jobs.netflix.net/careers/job/"


def netflix_run(payloads: DataFrame, page_size: int) -> DataFrame:
    """WIN-6 for Netflix: pages up to the first that is short, or whose items reach the
    stated total."""
    p = payloads.withColumn("_p", F.from_json("body", NETFLIX_SCHEMA))
    n = F.greatest(F.coalesce(F.size("_p.positions"), F.lit(0)), F.lit(0))
    stop = (n < page_size) | at_total(F.col("page_no"), page_size, F.coalesce(F.col("_p.count"), F.lit(0)), n)
    return before_stop(payloads, p.where(stop))


def netflix(payloads: DataFrame, page_size: int | None = None) -> DataFrame:
    """NRM-17: name else posting_name; canonical URL else id URL. All landed pages
    count unless ``page_size`` asks for the offset rule (WIN-6)."""
    payloads = payloads if page_size is None else netflix_run(payloads, page_size)
    j = _explode(payloads, NETFLIX_SCHEMA, lambda p: p["positions"])
    name = F.coalesce(F.when(F.col("j.name") != "", F.col("j.name")),
                      F.when(F.col("j.posting_name") != "", F.col("j.posting_name")), F.lit(""))
    title = X.strip(name)
    canon = X.strip(F.coalesce(F.col("j.canonicalPositionUrl"), F.lit("")))
    jid = F.coalesce(F.when(F.col("j.id") != "", F.col("j.id")), F.when(F.col("j.ats_job_id") != "", F.col("j.ats_job_id")))
    url = F.when(canon != "", canon).when(jid.isNotNull(), F.concat(F.lit(NETFLIX_JOB_URL), jid))
    j = j.where((title != "") & url.isNotNull())
    return _detail(j, id=jid, title=title, url=url)


# ---------------------------------------------------------------- EXT-1
def normalise_all(payloads: DataFrame, now: Column, target_locations: Sequence[str] | None = None,
                  extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                  convert: bool = True) -> DataFrame:
    """SET-3 / EXT-1: every platform's postings as one uniform detail frame.
    A new platform is one more entry in ``extra`` (platform -> function)."""
    registry: dict[str, Callable[[DataFrame], DataFrame]] = {
        "greenhouse": lambda p: greenhouse(p, convert),
        "lever": lambda p: lever(p, convert=convert),
        "ashby": lambda p: ashby(p, convert),
        "bamboohr": lambda p: bamboohr_detail(bamboohr_listing(p), p),
        "workday": lambda p: workday(p, target_locations),
        "phenom": lambda p: phenom(p, convert),
        "oracle": lambda p: oracle(p, now, convert=convert),
        "netflix": netflix,
        **(extra or {}),
    }
    known = F.col("platform").isin(list(registry))
    parts = [fn(payloads.where(F.col("platform") == name)).withColumn("platform", F.lit(name))
             for name, fn in registry.items()]
    # rows of any other platform are landed pages: their job links (NRM-20)
    parts.append(generic_payload(payloads.where(F.coalesce(~known, F.lit(True)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def generic_payload(payloads: DataFrame) -> DataFrame:
    """Payload rows of unknown platforms: ``body`` is a page, ``key`` its address.
    Each job link is a posting with its text as the title; the first link to a URL
    per source counts (WIN-2)."""
    a = payloads.select("source_id", "platform", "page_no", "key", F.posexplode(H.html_anchors(F.col("body"))).alias("pos", "a"))
    a = a.withColumn("url", U.resolve_href(F.col("a.href"), F.col("key")))
    a = a.where(FL.anchor_ok(F.col("a.text")) & F.col("url").isNotNull() & FL.is_job_link(F.col("url")))
    a = first_per_key(a.select("source_id", "platform", "page_no", "pos", F.col("a.text").alias("title"), "url"),
                      ["source_id", "url"], ["page_no", "pos"])
    return _detail(a, title=F.col("title"), url=F.col("url")).withColumn("platform", F.lit("generic"))


def last_detail_per_url(details: DataFrame, order: list[str] | None = None) -> DataFrame:
    """WIN-5 / JN-2 helper: the last detail seen for a URL within a source wins; of
    details at one place (a page landed twice) one stays.

    Keys and places alone are grouped. URLs seen more than once are landed, so Spark
    knows their size when it joins them; details of other URLs pass as they are.
    """
    order = order or ["page_no", "pos"]
    keys = ["source_id", "url"]
    places = details.groupBy(*keys, *order).agg(F.count("*").alias("n"))
    at = F.struct(*order)
    repeated = cut_lineage(places.groupBy(*keys).agg(F.max(at).alias("_at"), F.max_by("n", at).alias("_same"), F.sum("n").alias("_n"))
                           .where("_n > 1").withColumnsRenamed({k: f"_{k}" for k in keys}).drop("_n"))
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    kept = details.join(repeated, same_key, "left").where(F.col("_at").isNull() | (F.col("_at") == at))
    cols = [c for c in details.columns if c not in keys]
    out = kept.where(F.coalesce("_same", F.lit(1)) == 1).select(*keys, *cols)
    if repeated.where("_same > 1").isEmpty():
        return out
    one = kept.where("_same > 1").groupBy(*keys).agg(F.first(F.struct(*cols)).alias("_d"))
    return out.unionByName(one.select(*keys, "_d.*"))


def attach_detail(listings: DataFrame, details: DataFrame) -> DataFrame:
    """JN-2 + NRM-23: listing left join its detail (last per URL wins);
    missing detail -> bare title + url."""
    d = last_detail_per_url(details).select(
        "source_id", "url", *[F.col(c).alias(f"d_{c}") for c in ("location", "job_type", "salary", "description",
                                                                 "requirements", "departments")])
    j = listings.join(d, ["source_id", "url"], "left")
    return j.select(*listings.columns, *[F.col(f"d_{c}").alias(c) for c in (
        "location", "job_type", "salary", "description")],
        F.coalesce(F.col("d_requirements"), _empty()).alias("requirements"),
        F.coalesce(F.col("d_departments"), _empty()).alias("departments"))
