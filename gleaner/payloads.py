"""landed payloads rendered from the F2 postings by Spark.

Every source is assigned one platform (``source_id % 8``) and its postings are
rendered, page by page, in that platform's JSON shape with ``to_json``. Pages
group at most ``PAGE_SPAN`` consecutive ``ord`` values of a source, so a page
is a bounded group even for a source holding a third of all postings.
Variants are derived from ``ord`` (blank titles, union-typed fields, unlisted
rows, old dates, multi-location jobs) so every branch of a normaliser runs;
the oracle recomputes the expected values from F2 with the same rules.

Columns: source_id INT, platform STRING, kind STRING, page_no INT,
key STRING, body STRING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAY_PLATFORMS = ["greenhouse", "lever", "ashby", "bamboohr", "workday", "phenom", "oracle", "netflix"]
PAGE_SPAN = 400          # ord values per page -> at most 20 postings per source and page
PHENOM_PAGE_SPAN = 200   # 10 postings per source and page (the platform's page size)


def platform_of(source_id: Column) -> Column:
    expr = None
    for i, p in enumerate(PAY_PLATFORMS):
        cond = (source_id % len(PAY_PLATFORMS)) == i
        expr = F.when(cond, F.lit(p)) if expr is None else expr.when(cond, F.lit(p))
    return expr


def pos_in_source(ord_: Column) -> Column:
    """Sources take every 20th ord, so parity-like variants use ord div 20."""
    return F.floor(ord_ / 20)


def raw_title(ord_: Column, title: Column) -> Column:
    """Blank title every 23rd posting (fails FLT-9); padded every 5th."""
    return (F.when(ord_ % 23 == 0, F.lit("   "))
             .when(pos_in_source(ord_) % 5 == 0, F.concat(F.lit("  "), title, F.lit(" "))).otherwise(title))


def _pages(rows: DataFrame, entry: Column, span: int = PAGE_SPAN) -> DataFrame:
    """(source_id, page_no, items) with items ordered by ord."""
    g = rows.groupBy("source_id", F.floor(F.col("ord") / span).cast("int").alias("page_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("ord").alias("_o"), entry.alias("e")))).alias("_items"),
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("items", F.transform("_items", lambda x: x["e"])).drop("_items")


def _frame(df: DataFrame, platform: str, kind: str, key: Column, body: Column) -> DataFrame:
    return df.select(F.col("source_id").cast("int"), F.lit(platform).alias("platform"), F.lit(kind).alias("kind"),
                     F.col("page_no").cast("int"), key.alias("key"), body.alias("body"))


def _rename_keys(body: Column, pairs: list[tuple[str, str]]) -> Column:
    """Turn helper field names into the platform's union-typed field."""
    for a, b in pairs:
        body = F.regexp_replace(body, f'"{a}":', f'"{b}":')
    return body


def greenhouse(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    primary = F.when(o % 17 == 0, F.lit(" United States ")).otherwise(F.col("location"))
    others_s = F.when(o % 3 == 0, F.array(F.lit("Lehi, UT"), F.lit(" "), F.lit("Lehi, UT")))
    entry = F.struct(
        o.alias("id"), raw_title(o, F.col("title")).alias("title"), F.col("url").alias("absolute_url"),
        F.col("description").alias("content"),
        F.when(k % 2 == 0, F.struct(primary.alias("name"))).alias("location__obj"),
        F.when(k % 2 == 1, primary).alias("location__str"),
        F.when(k % 2 == 0, F.transform(others_s, lambda x: F.struct(x.alias("name")))).alias("otherLocations__obj"),
        F.when(k % 2 == 1, others_s).alias("otherLocations__str"),
        F.when(F.col("department").isNull(), F.array().cast("array<struct<name:string>>"))
         .otherwise(F.array(F.struct(F.col("department").alias("name")))).alias("departments"))
    p = _pages(rows, entry)
    body = _rename_keys(F.to_json(F.struct(F.col("items").alias("jobs"))),
                        [("location__obj", "location"), ("location__str", "location"),
                         ("otherLocations__obj", "otherLocations"), ("otherLocations__str", "otherLocations")])
    return _frame(p, "greenhouse", "list", F.concat(F.lit("board"), F.col("source_id")), body)


def lever(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    lists = F.when(k % 2 == 0, F.array(
        F.struct(F.lit("Requirements").alias("text"),
                 F.concat(F.lit("Req "), o.cast("string"), F.lit("\n  Second req\n")).alias("content")),
        F.struct(F.lit("Perks").alias("text"), F.lit("Perk one").alias("content")),
        F.struct(F.lit("Basic Qualifications").alias("text"), F.lit("<li>Q1</li><li> Q2 </li>").alias("content")),
    )).otherwise(F.array(
        F.struct(F.lit("What you'll need").alias("text"), F.lit("Need A").alias("content"))))
    entry = F.struct(
        o.cast("string").alias("id"), raw_title(o, F.col("title")).alias("text"), F.col("url").alias("hostedUrl"),
        lists.alias("lists"), F.col("description").alias("descriptionPlain"),
        F.struct(F.col("location").alias("location"), F.col("department").alias("team"),
                 F.when(k % 2 == 0, F.lit("Full-time")).otherwise(F.lit("Contract")).alias("commitment")
                 ).alias("categories"))
    p = _pages(rows, entry)
    return _frame(p, "lever", "list", F.concat(F.lit("board"), F.col("source_id")), F.to_json(F.col("items")))


def ashby(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    entry = F.struct(
        o.cast("string").alias("id"), raw_title(o, F.col("title")).alias("title"), F.col("url").alias("jobUrl"),
        F.when(o % 9 == 0, F.lit(False)).when(k % 2 == 0, F.lit(True)).alias("isListed"),
        F.when(k % 2 == 0, F.col("location")).alias("locationName"),
        F.when(k % 2 == 1, F.array(F.col("location"), F.lit(" Remote "))).alias("location"),
        F.when(o % 3 == 0, F.array(F.struct(F.lit("Lehi, UT").alias("location")))).alias("secondaryLocations"),
        F.when(k % 2 == 0, F.col("department")).alias("department__str"),
        F.when((k % 2 == 1) & F.col("department").isNotNull(),
               F.struct(F.col("department").alias("name"))).alias("department__obj"),
        F.when(k % 4 == 0, F.struct((F.lit(100000) + o).alias("minValue"), (F.lit(150000) + o).alias("maxValue"),
                                    F.lit("USD").alias("currencyCode"), F.lit("1 YEAR").alias("interval"))
               ).alias("compensation"),
        F.lit("FullTime").alias("employmentType"),
        F.concat(F.lit("<p>"), F.col("title"), F.lit("</p>")).alias("descriptionHtml"))
    p = _pages(rows, entry)
    body = F.when(F.col("page_no") % 2 == 0, F.to_json(F.struct(F.col("items").alias("jobPostings")))) \
            .otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("jobPostings"),
                                          F.col("items").alias("jobs"))))
    body = _rename_keys(body, [("department__str", "department"), ("department__obj", "department")])
    return _frame(p, "ashby", "list", F.concat(F.lit("board"), F.col("source_id")), body)


def bamboohr(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    entry = F.struct(F.when(o % 19 != 0, o).alias("id"), raw_title(o, F.col("title")).alias("jobOpeningName"))
    p = _pages(rows, entry)
    listing = _frame(p, "bamboohr", "list", F.concat(F.lit("co"), F.col("source_id")),
                     F.to_json(F.struct(F.col("items").alias("result"))))
    det_body = F.to_json(F.struct(
        F.col("title").alias("jobOpeningName"),
        F.concat(F.lit("<p>About "), F.col("title"), F.lit("</p><ul><li>One</li><li> Two </li></ul>")).alias("description"),
        F.when(o % 3 == 0, F.struct(F.lit("Lehi").alias("city"), F.lit("UT").alias("state")))
         .when(o % 3 == 1, F.struct(F.lit("").alias("city"), F.lit("CA").alias("state"))).alias("location__obj"),
        F.when(o % 3 == 2, F.coalesce(F.col("location"), F.lit(""))).alias("location__str"),
        F.lit("Full-Time").alias("employmentType")))
    det_body = _rename_keys(det_body, [("location__obj", "location"), ("location__str", "location")])
    detail = rows.where(o % 7 != 0).select(F.col("source_id").cast("int"), F.lit("bamboohr").alias("platform"),
                         F.lit("detail").alias("kind"), F.lit(0).alias("page_no"),
                         o.cast("string").alias("key"), det_body.alias("body"))
    return listing.unionByName(detail)


def workday_path(o: Column) -> Column:
    city = F.when(o % 3 == 0, F.lit("Remote")).when(o % 3 == 1, F.lit("Lehi")).otherwise(F.lit("New-York"))
    return F.concat(F.lit("/job/"), city, F.lit("/Role-"), o.cast("string"), F.lit("_R"), o.cast("string"))


def workday(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    entry = F.struct(raw_title(o, F.col("title")).alias("title"), workday_path(o).alias("externalPath"),
                     F.when(k % 4 == 0, F.lit("3 Locations")).otherwise(F.col("location")).alias("locationsText"))
    p = _pages(rows, entry)
    total = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    p = p.join(total, "source_id")
    key = F.concat(F.lit("https://co"), F.col("source_id"), F.lit(".wd5.myworkdayjobs.com/en-US/Board"), F.col("source_id"))
    listing = _frame(p, "workday", "list", key,
                     F.to_json(F.struct("total", F.col("items").alias("jobPostings"))))
    multi = rows.where((k % 4 == 0) & (k % 16 != 4))
    desc = lambda *names: F.array(*[F.struct(F.lit(n).alias("descriptor")) for n in names])
    nested = F.to_json(F.struct(F.array(F.struct(
        F.lit("locationMainGroup").alias("facetParameter"),
        F.array(F.struct(F.lit("locations").alias("facetParameter"),
                         desc("Lehi", "San Jose", "Remote - US").alias("values"))).alias("values"))).alias("facets")))
    top = F.to_json(F.struct(F.array(
        F.struct(F.lit("timeType").alias("facetParameter"), desc("Full time").alias("values")),
        F.struct(F.lit("locations").alias("facetParameter"), desc("Salt Lake City", "Austin").alias("values")),
    ).alias("facets")))
    facets = multi.select(F.col("source_id").cast("int"), F.lit("workday").alias("platform"),
                          F.lit("facets").alias("kind"), F.lit(0).alias("page_no"),
                          F.concat(F.lit("R"), o.cast("string")).alias("key"),
                          F.when(k % 8 == 0, nested).otherwise(top).alias("body"))
    return listing.unionByName(facets)


def phenom(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    entry = F.struct(
        raw_title(o, F.col("title")).alias("title"),
        F.when(o % 3 == 0, F.concat(F.col("url"), F.lit("/apply"))).alias("applyUrl"),
        F.when(o % 3 == 1, F.concat(F.col("url"), F.lit("/"))).alias("absoluteUrl"),
        F.concat(F.lit("SEQ"), o.cast("string")).alias("jobSeqNo"),
        F.when(k % 2 == 0, F.concat(F.lit("Teaser "), o.cast("string"))).alias("descriptionTeaser"),
        F.struct(F.concat(F.lit("First 200 of "), o.cast("string")).alias("descriptionTeaser_first200")).alias("ml_job_parser"),
        F.when(k % 5 == 0, F.array(F.coalesce(F.col("location"), F.lit("Unknown")), F.lit("Remote"))).alias("multi_location"),
        F.col("location").alias("cityState"),
        F.lit("Full time").alias("type"))
    p = _pages(rows, entry, PHENOM_PAGE_SPAN)
    body = F.to_json(F.struct(F.struct(F.col("items").alias("jobs")).alias("data")))
    return _frame(p, "phenom", "list", F.concat(F.lit("https://co"), F.col("source_id"), F.lit(".phenompeople.com")), body)


def oracle_hcm(rows: DataFrame, run_ts: str) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    ts = F.lit(run_ts).cast("timestamp")
    posted = (F.when(k % 5 == 0, F.date_format(ts - F.expr("INTERVAL 45 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(k % 5 == 1, F.lit("not a date"))
               .when(k % 5 == 3, F.date_format(ts - F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(k % 5 == 4, F.date_format(ts - F.expr("INTERVAL 10 DAYS"), "yyyy-MM-dd'T'HH:mm:ss")))
    entry = F.struct(F.when(o % 29 != 0, o).alias("Id"), raw_title(o, F.col("title")).alias("Title"),
                     posted.alias("PostedDate"),
                     F.when(k % 6 == 0, F.lit("United States")).otherwise(F.col("location")).alias("PrimaryLocation"),
                     F.concat(F.lit("Short: "), F.col("title")).alias("ShortDescriptionStr"))
    p = _pages(rows, entry)
    total = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    p = p.join(total, "source_id")
    body = F.to_json(F.struct(F.array(F.struct(F.col("total").alias("TotalJobsCount"),
                                               F.col("items").alias("requisitionList"))).alias("items")))
    return _frame(p, "oracle", "list", F.lit("eeho.fa.us2.oraclecloud.com"), body)


def netflix(rows: DataFrame) -> DataFrame:
    o = F.col("ord")
    k = pos_in_source(o)
    entry = F.struct(
        F.when(o % 37 != 0, o).alias("id"),
        F.when(k % 4 == 1, F.lit("")).otherwise(raw_title(o, F.col("title"))).alias("name"),
        F.col("title").alias("posting_name"),
        F.concat(F.lit("JR"), o.cast("string")).alias("ats_job_id"),
        F.when(o % 3 != 0, F.col("url")).alias("canonicalPositionUrl"))
    p = _pages(rows, entry)
    total = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"))
    p = p.join(total, "source_id")
    body = F.to_json(F.struct(F.col("total").alias("count"), F.col("items").alias("positions")))
    return _frame(p, "netflix", "list", F.lit("netflix.com"), body)


def payloads(postings: DataFrame, run_ts: str) -> DataFrame:
    """All platforms' landed payload rows (SET-3 style union)."""
    rows = postings.withColumn("_platform", platform_of(F.col("source_id")))
    parts = [
        greenhouse(rows.where(F.col("_platform") == "greenhouse")),
        lever(rows.where(F.col("_platform") == "lever")),
        ashby(rows.where(F.col("_platform") == "ashby")),
        bamboohr(rows.where(F.col("_platform") == "bamboohr")),
        workday(rows.where(F.col("_platform") == "workday")),
        phenom(rows.where(F.col("_platform") == "phenom")),
        oracle_hcm(rows.where(F.col("_platform") == "oracle"), run_ts),
        netflix(rows.where(F.col("_platform") == "netflix")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def greenhouse_departments(postings: DataFrame, block: int = 256) -> DataFrame:
    """Departments payload per Greenhouse source (JOB-6 input), landed in
    bounded chunks: each row lists, per department, the jobs among ``block``
    postings of the source, plus a nameless entry. A department's job count is
    the sum over its chunks."""
    rows = postings.where(platform_of(F.col("source_id")) == "greenhouse")
    chunk = F.floor(pos_in_source(F.col("ord")) / block).cast("int")
    per = (rows.groupBy("source_id", "department", chunk.alias("chunk"))
           .agg(F.array_sort(F.collect_list("ord")).alias("jobs")))
    idx = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ["Engineering", "Data Science", "Product", "Sales"]]),
                                      F.col("department")), F.lit(9))
    entry = F.struct((F.col("source_id") * 100 + idx).alias("id"),
                     F.concat(F.lit("  "), F.coalesce(F.col("department"), F.lit("")), F.lit(" ")).alias("name"),
                     F.col("jobs").alias("jobs"))
    g = per.groupBy("source_id", "chunk").agg(F.array_sort(F.collect_list(entry)).alias("departments"))
    return g.select(F.col("source_id").cast("int"), F.lit("greenhouse").alias("platform"),
                    F.lit("departments").alias("kind"), F.col("chunk").alias("page_no"),
                    F.concat(F.lit("board"), F.col("source_id")).alias("key"),
                    F.to_json(F.struct("departments")).alias("body"))
