"""Second pass from landed pages, and the update files that it writes."""

from pyspark.sql import functions as F

from gleaner.functions.text import hash_url
from gleaner.plans import second_pass as P2
from gleaner.sources import updates as UP

BLOCK = ('<html><script type="application/ld+json">{"@type": "%s", "description": "<p>Do</p><ul><li>it</li></ul>", '
         '"employmentType": "FULL_TIME", "jobLocation": {"address": {"addressLocality": "Lehi", "addressRegion": "UT"}}}'
         '</script><body><nav>Menu</nav><main><p>Text</p></main></body></html>')
LONG = "<html><body><main><p>" + "long text " * 60 + "</p></main></body></html>"


def details(spark, cases):
    """cases: (platform, listing location, [(fetch_no, html, error)])"""
    jobs = [(i, f"u{i}", loc, "pending") for i, (_, loc, _) in enumerate(cases)]
    frame = spark.createDataFrame(jobs, "source_id int, job_url string, location string, scrape_status string")
    frame = frame.withColumn("url_hash", hash_url(F.col("job_url"))).withColumn("job_type", F.lit("Listed"))
    platforms = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "source_id int, platform string")
    pages = spark.createDataFrame([(f"u{i}", *f) for i, c in enumerate(cases) for f in c[2]],
                                  "url string, fetch_no int, html string, error string")
    found = P2.page_details(P2.pending_pages(frame, platforms, pages)).join(frame.select("url_hash", "job_url"), "url_hash")
    return {int(r.job_url[1:]): (r.location, r.job_type, r.salary, r.description, r.error) for r in found.collect()}


def test_pages_go_to_their_platforms_reader(spark):
    post, page = [(1, BLOCK % "JobPosting", None)], [(1, BLOCK % "WebPage", None)]
    got = details(spark, [
        ("workday", "Provo", post), ("workday", None, page), ("phenom", "Provo", post), ("phenom", "Provo", page),
        ("netflix", "Provo", post), ("netflix", None, [(1, LONG, None)]), ("somewhere", None, post), ("somewhere", None, [(1, LONG, None)]),
        ("phenom", None, [(1, LONG, None)]), ("lever", "Provo", post)])
    md, text = "Do\n\n- it", ("long text " * 60).strip()
    assert got == {
        0: ("Provo", "FULL_TIME", None, md, None), 1: ("Lehi", "FULL_TIME", None, md, None),
        2: ("Lehi", "FULL_TIME", None, "<p>Do</p><ul><li>it</li></ul>", None), 3: ("Provo", "Listed", None, None, None),
        4: ("Lehi, UT", "FULL_TIME", None, md, None), 5: (None, "Listed", None, text, None),
        6: (None, "Listed", None, "Text", None), 7: (None, "Listed", None, text, None),
        8: (None, "Listed", None, text, None), 9: ("Provo", "Listed", None, None, None)}


def test_failed_and_missing_pages(spark):
    post, bad = (BLOCK % "JobPosting", None), (None, "Timeout")
    got = details(spark, [("workday", "Provo", [(1, *bad)]), ("somewhere", None, [(1, *bad)]), ("netflix", None, [(1, *bad)]),
                          ("workday", None, [(1, *bad), (2, *post)]), ("somewhere", None, [(1, *post), (2, *bad)]),
                          ("workday", None, []), ("phenom", "Provo", [(1, " ", None)])])
    assert got[0] == ("Provo", "Listed", None, None, None)  # the listing stands in
    assert got[1] == (None, "Listed", None, None, "Timeout")
    assert got[2] == (None, "Listed", None, None, None)
    assert got[3][3] == "Do\n\n- it" and got[4][4] == "Timeout"  # the last fetch counts
    assert 5 not in got  # not fetched yet: the job stays pending
    assert got[6] == ("Provo", "Listed", None, None, None)


def test_updates_by_version(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda xs: spark.createDataFrame(xs, "k string, v string")
    base = rows([("a", "0"), ("b", "0"), ("c", "0")])
    now = lambda before=None: sorted(map(tuple, UP.current_rows(base, UP.read_updates(spark, path, "k", before), "k").collect()))
    assert now() == [("a", "0"), ("b", "0"), ("c", "0")]
    UP.write_update(rows([("a", "1"), ("b", "1")]), path, 1)
    UP.write_update(rows([("a", "2")]), path, 2)
    UP.write_update(rows([("a", "2")]), path, 2)  # replayed
    assert now() == [("a", "2"), ("b", "1"), ("c", "0")]
    assert now(2) == [("a", "1"), ("b", "1"), ("c", "0")]
    UP.compact(spark, path, "k", 2)
    assert now() == [("a", "2"), ("b", "1"), ("c", "0")]
    UP.write_update(rows([("c", "10")]), path, 10)
    assert now() == [("a", "2"), ("b", "1"), ("c", "10")]
    (tmp_path / "v=11").mkdir()  # a version that did not end is not read
    assert now() == [("a", "2"), ("b", "1"), ("c", "10")]


def test_latest_update_is_chosen_on_keys_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text")], "url_hash string, description string")
    for n in (1, 2):
        UP.write_update(rows, str(tmp_path), n)
    plan = UP.read_updates(spark, str(tmp_path), "url_hash")._jdf.queryExecution().optimizedPlan().toString()
    (aggregate,) = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert "description" not in aggregate
