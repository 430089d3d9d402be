"""Plan shape: anti/semi joins where the reference probed row by row, no
cartesian product, filters below the Python (Arrow) node, pushed scans."""

from pyspark.sql import functions as F

from gleaner import fixtures as fx
from gleaner.catalog import QUERIES
from gleaner.functions import html as H


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anti_join_for_stored_urls(spark, sf_small):
    p = _plan(QUERIES["jn_1"](spark, sf_small))
    assert "LeftAnti" in p
    assert "CartesianProduct" not in p


def test_dedup_is_aggregate_not_window(spark, sf_small):
    p = _plan(QUERIES["win_1"](spark, sf_small))
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_native_filter_below_python_udf(spark, sf_small):
    pages = fx.load(spark, sf_small, "pages")
    df = pages.select("page_id", H.page_markdown(F.col("html"), mode=None).alias("md")).where(F.col("page_id") < 10)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the filter on page_id sits under the Arrow evaluation node
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")


def test_scan_prunes_columns(spark, sf_small):
    df = QUERIES["str_3"](spark, sf_small)
    p = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p or "text" not in p.split("ReadSchema")[1].split("\n")[0]


def test_second_pass_uses_semi_join(spark, sf_small):
    assert "LeftSemi" in _plan(QUERIES["jn_6"](spark, sf_small))


def test_source_filters_reach_the_scan(spark, sf_small, tmp_path):
    from gleaner.sources.sources import sources_of_type
    path = str(tmp_path / "sources")
    fx.sources_df(spark, sf_small).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = sources_of_type(spark.read.parquet(path), "workday")
    p = _plan(df)
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(active,true)" in pushed and "requires_js" in pushed
    assert "EqualTo(extractor_type,workday)" in pushed


def test_bucketed_jobs_table_is_not_shuffled(spark, sf_small):
    from gleaner.operators.decide import FilterConfig
    from gleaner.plans.collection import collection_run
    from gleaner.sources.sinks import append_jobs_table
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = fx.postings_df(spark, sf_small)
    spark.sql("DROP TABLE IF EXISTS gleaner_jobs_bucketed")
    append_jobs_table(fx.stored_df(postings), "gleaner_jobs_bucketed", n)
    stored = spark.table("gleaner_jobs_bucketed")
    cfg = FilterConfig.from_dict(fx.CONFIG_A)
    decided, _ = collection_run(fx.sources_df(spark, sf_small), postings, stored, cfg)
    # emulate a large history: no broadcast, no runtime re-plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = decided._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [ln for ln in plan.splitlines() if "gleaner_jobs_bucketed" in ln or "SelectedBucketsCount" in ln]
    assert any("Bucketed: true" in ln or "SelectedBucketsCount" in ln for ln in scan), scan
    # the stored side reaches the join without an exchange of its own
    lines = plan.splitlines()
    i = max(k for k, ln in enumerate(lines) if "FileScan" in ln and "url_hash" in ln and "Bucketed" in ln)
    above = lines[max(0, i - 4):i]
    assert not any("Exchange" in ln for ln in above), "\n".join(lines[max(0, i - 6):i + 1])
    spark.sql("DROP TABLE IF EXISTS gleaner_jobs_bucketed")


def _decided_with_history(spark, sf_small, stored, land=True):
    from gleaner.operators.decide import FilterConfig
    from gleaner.plans.collection import collection_run
    postings = fx.postings_df(spark, sf_small)
    return collection_run(fx.sources_df(spark, sf_small), postings, stored, FilterConfig.from_dict(fx.CONFIG_A), land=land)[0]


def test_duplicates_are_found_without_moving_descriptions(spark, sf_small):
    plan = _plan(_decided_with_history(spark, sf_small, fx.stored_df(fx.postings_df(spark, sf_small))))
    assert "description" in plan
    assert not [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln], plan


def test_whole_postings_never_enter_the_duplicate_aggregates(spark, sf_small):
    stored = fx.stored_df(fx.postings_df(spark, sf_small))
    plan = _decided_with_history(spark, sf_small, stored, land=False)._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [ln for ln in plan.splitlines() if "Aggregate [url_hash" in ln]
    assert aggregates and not any("description" in ln for ln in aggregates)


def test_history_is_probed_without_an_exchange(spark, sf_small, tmp_path):
    """Few candidates are broadcast; many meet the history in its buckets."""
    from gleaner.operators.decide import stored_hits
    from gleaner.session import cut_lineage
    from gleaner.sources.sinks import append_hashes, stored_hashes
    postings = fx.postings_df(spark, sf_small)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql("DROP TABLE IF EXISTS gleaner_hashes")
    for _ in range(2):  # a repeated run replaces its own hashes
        append_hashes(fx.stored_df(postings), "gleaner_hashes", 1, n)
    append_hashes(fx.stored_df(postings).limit(0), "gleaner_hashes", 2, n)
    assert spark.table("gleaner_hashes").count() == fx.stored_df(postings).count()
    assert stored_hashes(spark, "gleaner_hashes", 1).count() == 0
    stored = stored_hashes(spark, "gleaner_hashes", 3)
    from gleaner.functions.text import hash_url
    candidates = cut_lineage(postings.select(hash_url(F.col("url")).alias("url_hash")))

    def exchanges_over_history():
        lines = _plan(stored_hits(candidates, stored)).splitlines()
        scan = next(i for i, ln in enumerate(lines) if "gleaner_hashes" in ln)
        depth = lambda ln: len(ln) - len(ln.lstrip(" :|+-*(0123456789)"))
        above, out = depth(lines[scan]), []
        for ln in reversed(lines[:scan]):  # the nodes on the way from the scan to the join
            if depth(ln) < above:
                above = depth(ln)
                if "Join" in ln:
                    return out, ln
                if "Exchange" in ln:
                    out.append(ln)
        return out, ""

    found, join = exchanges_over_history()
    assert not found and "BroadcastHashJoin" in join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, join = exchanges_over_history()
        assert not found and "SortMergeJoin" in join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE IF EXISTS gleaner_hashes")


def test_two_configurations_are_decided_in_one_scan(spark, sf_small):
    diff = QUERIES["job_5_lossless"](spark, sf_small)
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [doc_id" in ln for ln in plan.splitlines()) <= 1, plan


def test_titles_that_the_line_pattern_loses_stay_in_the_lossless_diff(spark):
    from gleaner.operators import diff as DIF
    from gleaner.operators.decide import FilterConfig, decide_runs, decision_line
    postings = spark.createDataFrame(
        [(1, i, "Co", t, "u", None, []) for i, t in enumerate(["Head of People's Team", "Product Manager", "Product Manager"])],
        "source_order int, ord long, company string, title string, url string, location string, departments array<string>")
    dec = decide_runs(postings, [(1, FilterConfig.parse(roles="product_manager")), (2, FilterConfig.parse(blocked="manager"))])
    whole = DIF.compare_decisions(dec)
    assert sorted((r.title, r.bucket) for r in whole.collect()) == [("Head of People's Team", "newly_added"), ("Product Manager", "newly_filtered")]
    lines = dec.select("run_id", (F.col("ord") + 1).alias("line_no"), decision_line(F.col("company"), F.col("decision"), F.col("reason"), F.col("title")).alias("line"))
    assert {r.title for r in DIF.parse_lines(lines).collect()} == {"Product Manager"}


def test_descriptions_are_made_in_the_queries_that_claim_them(spark, sf_small):
    for name in ("nrm_11_text", "nrm_15", "nrm_18_text", "nrm_19"):
        df = QUERIES[name](spark, sf_small)
        assert "description" in df.columns and "ArrowEvalPython" in _plan(df), name
