"""Listing runs, landed pages, URL filters, payload checks and numbered lines."""

from pyspark.sql import functions as F

from gleaner.operators import paging as PG
from gleaner.operators.source_filters import apply_source_filters, source_filters
from gleaner.plans.payload_runs import payload_problem, unreadable_sources
from gleaner.sources.logs import number_lines, read_log, write_lines


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_run_ends_at_the_first_stop_of_each_source(spark):
    pages = spark.createDataFrame([(s, p) for s in (1, 2, 3) for p in range(5)], "source_id int, page_no int")
    firsts = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0), *[(3, p) for p in range(5)]], "source_id int, page_no int")
    quiet = PG.without_news(pages, firsts)
    assert rows(quiet) == [(1, 2), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert rows(PG.before_stop(pages, quiet)) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), *[(3, p) for p in range(5)]]
    plan = PG.before_stop(pages, quiet)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_gaps_of_landed_pages(spark):
    totals = spark.createDataFrame([(1, 41), (2, 40), (3, 0), (4, None), (5, 1)], "source_id int, total long")
    landed = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (6, 1)], "source_id int, page_no int")
    assert rows(PG.page_gaps(totals, landed, 20)) == [(1, 1, "missing"), (2, 2, "surplus"), (3, 0, "surplus"), (5, 0, "missing"), (6, 1, "surplus")]


def test_url_parameters_restrict_their_own_source(spark):
    sources = spark.createDataFrame([
        (1, "lever", "https://jobs.lever.co/a?location=Lehi%2C+UT&location=Rome"), (2, "lever", "https://jobs.lever.co/b?team=x"),
        (3, "workday", "https://c.wd5.myworkdayjobs.com/B?locations=Rome&locations=Lehi%2C%20UT&timeType=full&q=z"),
        (4, "ashby", "https://jobs.ashbyhq.com/d?location=Rome")], "id int, platform string, url string")
    found = source_filters(sources)
    assert rows(found.select("source_id", "field", F.array_join("wanted", "|"))) == [
        (1, "location", "Lehi, UT"), (3, "locations", "Rome|Lehi, UT"), (3, "timeType", "full")]
    postings = spark.createDataFrame([
        (1, "a", "Lehi, UT", None, []), (1, "b", "Rome", None, []), (1, "c", None, None, []), (2, "d", None, None, []),
        (3, "e", "Rome", "full", ["X"]), (3, "f", "Rome", None, []), (3, "g", "Oslo", "full", []), (4, "h", "Oslo", None, [])],
        "source_id int, id string, location string, job_type string, departments array<string>")
    assert [r[0] for r in rows(apply_source_filters(postings, found).select("id"))] == ["a", "d", "e", "h"]


def test_problems_of_payloads(spark):
    cases = [("greenhouse", '{"jobs": []}', None), ("greenhouse", '{"jobs": {}}', "Unexpected payload"), ("greenhouse", "{}", None),
             ("greenhouse", '{"jobs": null}', None), ("workday", "[]", "Unexpected payload"), ("lever", "[]", None), ("lever", "{}", None),
             ("lever", "", "Empty payload"), ("ashby", None, "Empty payload"), ("oracle", "<html></html>", "Unreadable payload"),
             ("netflix", '{"positions": [', "Unreadable payload"), ("phenom", '"text"', "Unexpected payload"),
             ("somewhere", "<html></html>", None), (None, "", None)]
    frame = spark.createDataFrame([(i, p, b) for i, (p, b, _) in enumerate(cases)], "i int, platform string, body string")
    got = frame.select("i", payload_problem(F.col("platform"), F.col("body")).alias("what")).orderBy("i").collect()
    assert [r.what for r in got] == [c[2] for c in cases]
    pages = spark.createDataFrame([(1, "lever", "list", 3, ""), (1, "lever", "list", 2, "x"), (2, "bamboohr", "detail", 0, ""),
                                   (3, "lever", "list", 0, "[]")], "source_id int, platform string, kind string, page_no int, body string")
    assert rows(unreadable_sources(pages)) == [(1, "Unreadable payload on page 2")]


def test_lines_are_numbered_by_several_tasks(spark, tmp_path):
    """Any sortable place will do: here a decimal too large for a long."""
    place = (F.col("id") * F.lit(1 << 62).cast("decimal(19,0)")).cast("decimal(38,0)")
    lines = spark.range(5000).select((F.col("id") % 7).alias("source_order"), place.alias("ord"), F.concat(F.lit("line "), "id").alias("line"))
    numbered = number_lines(lines.repartition(5), ["source_order", "ord"])
    expected = [f"line {i}" for s in range(7) for i in range(s, 5000, 7)]
    got = sorted((r.line_no, r.line) for r in numbered.collect())
    assert got == list(enumerate(expected, 1))
    assert numbered.rdd.getNumPartitions() > 1
    write_lines(numbered, str(tmp_path / "log"))
    back = read_log(spark, str(tmp_path / "log"))
    assert sorted((r.line_no, r.line) for r in back.collect()) == got


def test_dry_run_of_payloads_exports_its_lines(spark, sf_small, tmp_path):
    from gleaner import fixtures as fx
    from gleaner import payloads as PL
    from gleaner.operators.decide import FilterConfig
    from gleaner.plans.jobs import run_dry_from_payloads
    from gleaner.sources.sources import sources_all
    pay = PL.payloads(fx.postings_df(spark, sf_small), fx.RUN_TS)
    ts = F.lit(fx.RUN_TS).cast("timestamp")
    decided, counters = run_dry_from_payloads(sources_all(fx.sources_df(spark, sf_small)), pay, FilterConfig.from_dict(fx.CONFIG_A),
                                              ts, str(tmp_path / "log"))
    lines = read_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()
    found = counters.where("company = 'TOTAL'").first().found
    assert [r.line_no for r in lines] == list(range(1, found + 1)) and found == decided.count() > 0
    runs = [r.line.split("]")[0] for r in lines]
    order = {r.source_company: r.source_order for r in decided.select("source_company", "source_order").distinct().collect()}
    if len(order) == decided.select("source_order").distinct().count():
        places = [order[x[1:]] for x in runs]
        assert places == sorted(places)  # source after source, not mixed
