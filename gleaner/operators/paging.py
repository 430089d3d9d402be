"""Pages of a source's listing: where a run over them ends (WIN-6), and whether all
of them have landed (MTH-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_total(page_no: Column, page_size: int, total: Column, n_items: Column | None = None) -> Column:
    """Whether the offset after a page reaches the stated total. Without ``n_items`` the
    offset goes on by ``page_size``, with it by the items of the page (those before it
    were full, else they had ended the run)."""
    step = F.lit(page_size) if n_items is None else n_items
    return F.coalesce(page_no.cast("long") * page_size + step >= total, F.lit(False))


def without_news(pages: DataFrame, firsts: DataFrame) -> DataFrame:
    """``source_id, page_no`` of the pages that hold no first sighting. ``firsts``: the
    source's rows at the page where their URL stands first."""
    return pages.select("source_id", "page_no").distinct().join(
        firsts.select("source_id", "page_no").distinct(), ["source_id", "page_no"], "left_anti")


def before_stop(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows on the pages up to and including the first page of ``stops``
    (``source_id, page_no``) of their source: an aggregate and a join, no window."""
    first = stops.groupBy("source_id").agg(F.min("page_no").alias("_stop"))
    out = rows.join(first, "source_id", "left")
    return out.where(F.col("_stop").isNull() | (F.col("page_no") <= F.col("_stop"))).drop("_stop")


def page_gaps(totals: DataFrame, landed: DataFrame, page_size: int) -> DataFrame:
    """MTH-3: ``source_id, page_no, state`` of pages that are ``missing`` (an offset
    below the source's ``total`` without a landed page) or ``surplus`` (a landed page
    beyond it). Totals that are null or not positive expect no page."""
    pages = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / page_size).cast("long"))
    wanted = totals.where("total > 0").select("source_id", F.explode(pages).alias("page_no"))
    there = landed.select("source_id", F.col("page_no").cast("long").alias("page_no")).distinct()
    key = ["source_id", "page_no"]
    both = wanted.withColumn("wanted", F.lit(True)).join(there.withColumn("there", F.lit(True)), key, "full")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("wanted").isNull(), "surplus")
    return both.select(*key, state.alias("state")).where(F.col("state").isNotNull())
