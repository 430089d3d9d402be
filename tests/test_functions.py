"""Column functions against the documented examples."""

import re

import pytest
from pyspark.sql import functions as F

from gleaner.fixtures import TITLES
from gleaner.functions import filters as FL
from gleaner.functions import roles as R
from gleaner.functions import salary as SAL
from gleaner.functions import text as T


def _one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def _py_role(title):
    t = title.lower()
    for p, r in R.ROLE_RULES:
        if re.search(p, t):
            return r
    return None


DOC_TITLES = [
    ("Sr. Product Manager, AI/ML", "product_manager"),
    ("Manager II, Machine Learning Engineering", "engineering_manager"),
    ("Manager II, Machine Learning-Search", "engineering_manager"),
    ("Product Engineering Manager", "engineering_manager"),
    ("Manager, Product Engineering", "engineering_manager"),
    ("Technical Program Manager", "tpm"),
    ("Head of Product", "product_manager"),
    ("Account Executive", None),
    ("Données: analyste senior", "engineer"),
]


def test_roles_documented_examples(spark):
    got = _one(spark, R.classify_role, [t for t, _ in DOC_TITLES])
    assert got == [r for _, r in DOC_TITLES]


def test_roles_agree_with_python_re_on_fixture_titles(spark):
    titles = [t + suffix for t, _ in TITLES for suffix in ("", " - Team 3", " (TPM) ")]
    got = _one(spark, R.classify_role, titles)
    assert got == [_py_role(t) for t in titles]
    assert [r for _, r in TITLES] == [_py_role(t) for t, _ in TITLES]


SALARIES = [
    ("We pay $120,000 - $150,000 per year", "$120,000 - $150,000"),
    ("Range $120K-$150K DOE", "$120K-$150K"),
    ("$120k to $150k", "$120k to $150k"),
    ("Starting at $120,000+ and up", "$120,000+"),
    ("Base of $150,000/year", "$150,000"),
    ("Pay 224,000 USD - 356,500 USD", "224,000 USD - 356,500 USD"),
    ("Pay 224,000 - 356,500 USD", "224,000 - 356,500 USD"),
    ("Earn $45/hour on weekends", None),
    ("Only $120K alone", None),
    ("Rate $25.50/hr", "$25.50"),
    ("**$130,000** - $160,000 base", "$130,000 - $160,000"),
    ("$40 / hr or $90,000 yearly", "$90,000"),
    (None, None),
    ("", None),
]


def test_salary_examples(spark):
    got = _one(spark, SAL.extract_salary, [s for s, _ in SALARIES])
    assert got == [e for _, e in SALARIES]


def test_strip_unicode(spark):
    vals = ["\t x \n", " y ", "\x1cz\x1f", "a b", None]
    assert _one(spark, T.strip, vals) == [v.strip() if v is not None else None for v in vals]


def test_hash_url(spark):
    import hashlib
    vals = [" https://a.example/x ", "https://b.example/é"]
    assert _one(spark, T.hash_url, vals) == [hashlib.sha256(v.strip().encode()).hexdigest() for v in vals]


def test_parse_list(spark):
    raw = [" Engineer | Product_Manager ||  tpm ", "", None, "Remote|  Lehi |"]
    roles = _one(spark, lambda c: T.parse_list(c, True, False), raw)
    locs = _one(spark, lambda c: T.parse_list(c, False, True), raw)
    assert roles == [["Engineer", "Product_Manager", "tpm"], None, None, ["Remote", "Lehi"]]
    assert locs == [["engineer ", " product_manager ", "  tpm"], None, None, ["remote", "  lehi "]]


def test_py_repr(spark):
    vals = ["plain", "it's", "say \"hi\"", "both ' and \"", "back\\slash", None]
    assert _one(spark, T.py_repr, vals) == [repr(v) for v in vals]


def test_repair_cp1252(spark):
    raw = ["worldâ\x80\x99s", "café", "x\x81y", "€ already"]
    expect = []
    for v in raw:
        try:
            expect.append(v.encode("latin-1").decode("cp1252"))
        except (UnicodeEncodeError, UnicodeDecodeError):
            expect.append(v)
    assert _one(spark, T.repair_cp1252, raw) == expect


def test_location_and_department_filters(spark):
    locs = _one(spark, lambda c: FL.location_targeted(c, ["remote", "lehi"]), ["Lehi, UT", "", None, "Austin"])
    assert locs == [True, True, True, False]
    df = spark.createDataFrame([(0, ["Data Science"]), (1, []), (2, None), (3, ["Sales", "HR"])],
                               "i INT, d ARRAY<STRING>")
    got = [r[0] for r in df.orderBy("i").select(FL.department_targeted(F.col("d"), ["data", "engineering"])).collect()]
    assert got == [True, True, True, False]


@pytest.mark.parametrize("roles,role,expected", [(None, None, True), (["engineer"], None, False),
                                                 (["engineer"], "engineer", True), (["tpm"], "engineer", False)])
def test_role_targeted(spark, roles, expected, role):
    df = spark.createDataFrame([(role,)], "r STRING")
    assert df.select(FL.role_targeted(F.col("r"), roles)).first()[0] is expected


def test_workday_ids_and_rewrites(spark):
    from gleaner.functions import urls as U
    df = spark.createDataFrame([("/job/San-Jose/Principal-Product-Manager_R164308/",)], "p STRING")
    row = df.select(U.workday_job_id(F.col("p")).alias("id"),
                    U.rewrite_city(F.col("p"), U.location_slug(F.lit(" Lehi "))).alias("lehi"),
                    U.location_slug(F.lit("Remote - US")).alias("slug")).first()
    assert row["id"] == "R164308"
    assert row["lehi"] == "/job/Lehi/Principal-Product-Manager_R164308/"
    assert row["slug"] == "Remote---US"


def test_slugs_and_errors(spark):
    from gleaner.functions import urls as U
    from gleaner.operators.routing import route, source_error
    urls = ["https://boards.greenhouse.io/acme?x=1", "https://acme.greenhouse.io/", "https://jobs.lever.co/acme/",
            "https://jobs.ashbyhq.com/acme", "https://acme.bamboohr.com/careers", "https://careers.acme.com/",
            "https://acme.wd5.myworkdayjobs.com/en-US/acme/External", "https://wd1.myworkdaysite.com/recruiting/acme/Ext"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i INT, u STRING")
    got = df.orderBy("i").select(
        U.greenhouse_slug(F.col("u")), U.lever_slug(F.col("u")), U.ashby_slug(F.col("u")),
        U.bamboohr_subdomain(F.col("u")), U.workday_source(F.col("u"))["company"], U.workday_source(F.col("u"))["board"],
        route(F.col("u"), F.lit(None).cast("string")), source_error(F.lit("ashby"), F.col("u"))).collect()
    assert [r[0] for r in got][:2] == ["acme", "acme"]
    assert got[2][1] == "acme" and got[3][2] == "acme" and got[4][3] == "acme"
    assert (got[6][4], got[6][5]) == ("acme", "External")
    assert (got[7][4], got[7][5]) == ("acme", "Ext")
    assert [r[6] for r in got] == ["greenhouse", "greenhouse", "lever", "ashby", "bamboohr", "generic", "workday", "generic"]
    assert got[5][7] == "Could not extract Ashby slug from URL: https://careers.acme.com/"
    assert got[3][7] is None


def test_query_params(spark):
    from gleaner.functions import urls as U
    df = spark.createDataFrame([("https://x.example/a?locations=a1&locations=c3+d4&q=&timeType=full%20time&z",)], "u STRING")
    m = df.select(U.query_map(F.col("u"), U.WORKDAY_FACETS).alias("m")).first()["m"]
    assert m == {"locations": ["a1", "c3 d4"], "timeType": ["full time"]}
    assert df.select(U.query_first(F.col("u"), "locations")).first()[0] == "a1"
