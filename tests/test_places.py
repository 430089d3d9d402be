"""Lines numbered by splits, details kept by place, rules kept in tables, job counts."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions.roles import MOST_RULES, classify_role_by_table, read_rules, rules_table
from gleaner.operators.normalize import attach_detail, last_detail_per_url
from gleaner.operators.routing import route_by_table
from gleaner.payloads import greenhouse_departments as department_payloads
from gleaner.plans.discovery import greenhouse_departments
from gleaner.sources.logs import read_log

DETAIL = ("source_id int, page_no int, pos int, id string, url string, location string, job_type string, salary string, "
          "description string, requirements array<string>, departments array<string>")


def test_plain_logs_are_numbered_by_splits(spark, tmp_path):
    texts = {"a.log": "".join(f"[INFO] line {i} {'x' * (i % 50)}\n" for i in range(3000)), "b.log": "one\n\n\ttwo\r\nlast",
             "c.log": "", "d.log": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        log = read_log(spark, str(tmp_path), numbered=False)
        raw = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert raw.select("_metadata.file_block_start").distinct().count() > 10 and raw.rdd.getNumPartitions() > 10
        got = {}
        for r in log.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
        found = log.where(F.col("line").contains("line 2999 ")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {}
    for name, text in texts.items():
        lines = text.removesuffix("\n").split("\n") if text else []
        if lines:
            want[name] = list(enumerate(lines, 1))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [r.line_no for r in found] == [3000]


def details(spark, rows):
    return spark.createDataFrame([(s, p, i, f"id{p}-{i}", u, t, None, None, f"about {t}", ["r"], None) for s, p, i, u, t in rows], DETAIL)


def test_last_detail_by_place(spark):
    rows = [(1, 0, 0, "u", "first"), (1, 2, 0, "u", "last"), (1, 1, 9, "u", "middle"), (2, 0, 0, "u", "other source"),
            (1, 0, 1, None, "null a"), (1, 0, 2, None, "null b"), (3, 5, 5, "v", "alone")]
    got = last_detail_per_url(details(spark, rows))
    assert {(r.source_id, r.url): r.location for r in got.collect()} == {
        (1, "u"): "last", (2, "u"): "other source", (1, None): "null b", (3, "v"): "alone"}
    assert got.count() == 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "max_by" not in plan  # no description in a buffer
    # a page that is landed twice
    got = last_detail_per_url(details(spark, rows + [(1, 2, 0, "u", "last"), (3, 5, 5, "v", "alone")]))
    assert sorted((r.source_id, r.location) for r in got.collect()) == [(1, "last"), (1, "null b"), (2, "other source"), (3, "alone")]
    assert last_detail_per_url(details(spark, [])).collect() == []


def test_attach_detail(spark):
    listings = spark.createDataFrame([(1, 0, 0, "T", "u"), (1, 0, 1, "T", "w")], "source_id int, page_no int, pos int, title string, url string")
    out = attach_detail(listings, details(spark, [(1, 0, 0, "u", "x"), (1, 1, 0, "u", "y")])).orderBy("pos").collect()
    assert [(r.url, r.location, r.requirements, r.departments) for r in out] == [("u", "y", ["r"], []), ("w", None, [], [])]


def test_rules_kept_in_tables(spark):
    titles = spark.createDataFrame([(1, "Senior Engineer"), (2, "Product Manager"), (3, "Cook"), (4, None), (4, "Engineer")], "k int, title string")
    got = classify_role_by_table(titles, "title", ["k"], rules_table(spark))
    assert sorted((r.k, r.role or "") for r in got.collect()) == [(1, "engineer"), (2, "product_manager"), (3, ""), (4, ""), (4, "engineer")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    own = spark.createDataFrame([(2, "cook", "late"), (1, "c.*k", "first"), (0, None, "never")], "priority int, pattern string, role string")
    assert [r.role for r in classify_role_by_table(titles.where("k = 3"), "title", ["k"], own).collect()] == ["first"]
    assert [r.role for r in classify_role_by_table(titles.where("k = 3"), "title", ["k"], own.limit(0)).collect()] == [None]
    many = spark.range(MOST_RULES + 1).select(F.col("id").alias("priority"), F.lit("x").alias("pattern"), F.lit("r").alias("role"))
    assert len(read_rules(many.limit(MOST_RULES))) == MOST_RULES
    with pytest.raises(ValueError):
        classify_role_by_table(titles, "title", ["k"], many)
    sources = spark.createDataFrame([(1, "https://a.lever.co/x", None), (2, "https://q.example", "LEVER"), (3, None, None)],
                                    "id int, url string, extractor_type string")
    domains = spark.createDataFrame([(2, "lever.co", "lever"), (1, "a.lever", "own")], "priority int, domain string, platform string")
    assert sorted(map(tuple, route_by_table(sources, domains).collect())) == [(1, "own"), (2, "lever"), (3, "generic")]


def test_department_counts_are_job_counts(spark):
    posts = spark.range(8 * 20 * 300).where("id % 20 = 7").select(
        F.col("id").alias("ord"), F.lit(8).alias("source_id"), F.when(F.col("id") % 3 == 0, "Sales").when(F.col("id") % 3 == 1, "Product").alias("department"))
    pay = department_payloads(posts)
    assert pay.count() > 5
    got = {r.name: r.n_jobs for r in greenhouse_departments(pay).collect()}
    assert got == {r.department: r.n for r in posts.where("department IS NOT NULL").groupBy("department").agg(F.count("*").alias("n")).collect()}
