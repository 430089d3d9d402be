"""Streaming sinks are idempotent by batch id: replaying a batch after a
failure rewrites the same directory and adds no rows."""

from pyspark.sql import functions as F

from gleaner import fixtures as fx
from gleaner.operators.decide import FilterConfig
from gleaner.plans.collection import plan
from gleaner.sources.sources import active_sources
from gleaner.streaming import intake as ST


def test_replayed_batch_is_idempotent(spark, sf_small, tmp_path):
    postings = fx.postings_df(spark, sf_small)
    planned = plan(active_sources(fx.sources_df(spark, sf_small)))
    jobs = str(tmp_path / "jobs")
    ts = F.lit(fx.RUN_TS).cast("timestamp")
    run = ST.intake_batch(planned, FilterConfig.from_dict(fx.CONFIG_A), jobs, ts)
    batch = postings.where(F.col("source_id") <= 10)
    run(batch, 0)
    first = spark.read.parquet(jobs).count()
    assert first > 0
    run(batch, 0)  # replay of the same batch id
    assert spark.read.parquet(jobs).count() == first
    run(batch, 1)  # the same postings again in a new batch: all already stored
    assert spark.read.parquet(jobs).count() == first


def test_replayed_details_batch_is_idempotent(spark, sf_small, tmp_path):
    postings = fx.postings_df(spark, sf_small)
    planned = plan(active_sources(fx.sources_df(spark, sf_small)))
    jobs, snaps = str(tmp_path / "jobs"), str(tmp_path / "snaps")
    ts = F.lit(fx.RUN_TS).cast("timestamp")
    ST.intake_batch(planned, FilterConfig.from_dict(fx.CONFIG_A), jobs, ts)(postings, 0)
    details = fx.details_df(spark, postings)
    run = ST.details_batch(jobs, snaps, ts)
    run(details, 0)
    once = {tuple(r) for r in ST.latest_jobs(spark, jobs, snaps).select("url_hash", "scrape_status").collect()}
    run(details, 0)  # replay
    again = {tuple(r) for r in ST.latest_jobs(spark, jobs, snaps).select("url_hash", "scrape_status").collect()}
    assert once == again and len(once) > 0
