"""Source divergence against plain Python and its oracle."""

import random

import pytest

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, p long, i int, value string"


def sample():
    rng = random.Random(3)
    out = [(None, None, None), ("", "", ""), ("alpha beta", "xx", "only"), ("123 456 !", "en", "s9"), (None, "en", "s8")]
    for _ in range(160):
        lang, source = rng.choice(["en", "en", "de", "a\x00b", None]), rng.choice(["s1", "s1", "s2", "s3", "é\x00", None])
        words = rng.choices(["the", "The", "ÄRA", "ära", "don't", "x1y", "naïve", "日本", "of", "𝒳"], k=rng.randint(0, 12))
        out.append((rng.choice([" ", "\n", "-", "\x7f"]).join(words), lang, source))
    return out + [out[20]] * 3


@pytest.mark.parametrize("min_docs", [1, 10, 1000])
def test_divergence_matches_brute_force(spark, min_docs):
    from gleaner.llm.divergence import source_divergence
    rows = sample()
    docs = spark.createDataFrame([(i, *r, "x", 1, 2, 3, "y") for i, r in enumerate(rows)], SCHEMA)
    got = source_divergence(docs, min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = sorted(brute.divergence(rows, min_docs))
    assert any(r[2] == "pair" for r in expected)
    assert sorted(map(tuple, got.collect())) == expected


def test_divergence_of_nothing(spark):
    from gleaner.llm.divergence import source_divergence
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from gleaner.llm.divergence import share
    n, total, kept = 3 * 10**15 + 7, 9 * 10**15 + 11, 12345
    row = spark.createDataFrame([(n, total, kept)], "n long, t long, k long").select(share(F.col("n"), F.col("t"), F.col("k"))).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_terms_are_landed_as_one_string_a_document_and_numbered(spark):
    import glob

    from gleaner.llm.divergence import TermCounts, source_divergence
    from gleaner.session import ensure_checkpoint_dir
    # names that hold what separates fitted terms, and one that looks like another's hexadecimal form
    rows = [(f"alpha {'beta ' * (k % 3)}Ä{k % 2}", lang, f"s{k % 4}") for k in range(24) for lang in ("a\x01b", "a", "a\n", "\x00", "61", "")]
    docs = spark.createDataFrame([(k, *r, "x", 1, 2, 3, "y") for k, r in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, source_divergence(docs, 2).collect())) == sorted(brute.divergence(rows, 2))
    where = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/gleaner-tagged-terms-"
    before = set(glob.glob(where + "*"))
    terms = TermCounts(docs, 2).terms
    (landed,) = set(glob.glob(where + "*")) - before
    assert dict(spark.read.parquet(landed).dtypes) == {"source": "string", "text": "string"}
    assert terms.select("i").distinct().count() == terms.select("lang", "term").distinct().count()
