"""JOB-2: the second pass from landed detail pages.

Each pending job's page goes to the reader of its platform (NRM-11, 14, 15, 18, 19,
21); what no reader can tell comes from the listing (NRM-23). Landed pages are rows
``(url, fetch_no, html, error)``: the last fetch of a URL counts, and ``error`` says
why there is no page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_url
from ..operators import pages as PG
from ..session import ensure_checkpoint_dir

#: Platforms whose jobs have a page of their own; the listings of these hold all that there is.
LISTING_ONLY = ["greenhouse", "lever", "ashby", "bamboohr", "oracle"]
DETAIL = ["url_hash", "location", "job_type", "salary", "description"]


def last_pages(pages: DataFrame) -> DataFrame:
    """``url_hash, html, error`` of the last fetch of each URL. The fetch is chosen
    on keys alone; pages are joined to the choice."""
    keyed = pages.select(hash_url(F.col("url")).alias("url_hash"), "fetch_no", "html", "error")
    last = keyed.groupBy("url_hash").agg(F.max("fetch_no").alias("fetch_no"))
    return keyed.join(last, ["url_hash", "fetch_no"], "left_semi").drop("fetch_no")


def pending_pages(jobs: DataFrame, platforms: DataFrame, pages: DataFrame) -> DataFrame:
    """Pending jobs with their source's platform (``source_id, platform``) and page.
    Jobs of platforms with pages stay pending until a fetch has landed."""
    pending = (jobs.where("scrape_status = 'pending'")
               .select("url_hash", F.col("job_url").alias("url"), "source_id",
                       F.col("location").alias("l_location"), F.col("job_type").alias("l_job_type")))
    wanted = pending.join(platforms, "source_id").drop("source_id")
    alone = F.col("platform").isin(LISTING_ONLY)
    fetched = last_pages(pages).withColumn("fetched", F.lit(True))
    found = wanted.where(~alone).join(fetched, "url_hash")
    return wanted.where(alone).unionByName(found, allowMissingColumns=True)


def _by_platform(rows: DataFrame) -> DataFrame:
    """Rows landed by platform, so that each reader scans its own pages only."""
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/pending-pages-{uuid.uuid4().hex}"
    rows.write.partitionBy("platform").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def page_details(rows: DataFrame) -> DataFrame:
    """Details of pending pages: ``url_hash, location, job_type, salary, description, error``.

    A job gets one row: from its platform's reader when that finds something on the
    page, else the listing's location and type. A failed fetch is an ``error`` only
    where no listing can stand in (pages of unknown platforms)."""
    landed = _by_platform(rows)
    whole = landed.where(F.col("error").isNull() & (F.trim(F.coalesce("html", F.lit(""))) != ""))
    whole = whole.withColumn("page_id", F.col("url_hash"))
    known = ["workday", "phenom", "netflix", *LISTING_ONLY]
    read = [PG.workday_page(whole.where("platform = 'workday'")),
            PG.phenom_page(whole.where("platform = 'phenom'")).withColumn("salary", F.lit(None).cast("string")),
            PG.netflix_page(whole.where("platform = 'netflix'")),
            PG.generic_detail(whole.where(~F.col("platform").isin(known)))]
    details = None
    for part in read:
        part = part.select(F.col("page_id").alias("url_hash"), *[c for c in DETAIL[1:] if c in part.columns])
        details = part if details is None else details.unionByName(part, allowMissingColumns=True)
    failed = F.when(F.col("error").isNotNull() & ~F.col("platform").isin(known), F.col("error"))
    bare = landed.select("url_hash", "l_location", "l_job_type", failed.alias("error"))
    out = bare.join(details, "url_hash", "left")
    return out.select("url_hash", F.coalesce("location", "l_location").alias("location"),
                      F.coalesce("job_type", "l_job_type").alias("job_type"), "salary", "description", "error")
