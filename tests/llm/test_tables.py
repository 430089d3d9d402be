"""Operators on pages and embeddings, the queries' oracles, and the pipeline."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_url_filter"])
def test_oracle(spark, name):
    from gleaner.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    cols = sorted(c[0] for c in cur.description)
    names = [c[0] for c in cur.description]
    expected = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == expected


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/",
        "https://xexample.com/de/1", "https://m.example.com/de/1", "https://m.example.com/des", "ftp://a.org/fr/",
        "ftp://a.org/fr", "x://a.org?/fr/", "x://org/fr/q", "x://net#/", "a://b://c.net/d", "x:///en/"]


@pytest.mark.parametrize("size", [10**6, 0])
def test_urls(spark, size):
    from gleaner.llm.queries import URL_RULES
    from gleaner.llm.url_filter import judge_urls, split_url
    pages = spark.createDataFrame([(i, u, "mine", 5) for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, rank long")
    rules = [*URL_RULES, ("example.com", "/d", "allow")]

    def plain(url):
        host, path = split_url(url)
        fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return (host, path, best and best[0] + best[1], best[2] if best else "allow")

    got = judge_urls(pages, rules, max_broadcast_chars=size)
    assert got.columns == ["page_id", "url", "rank", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert judge_urls(pages.where("false"), rules, max_broadcast_chars=size).count() == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # equal vectors: ties go to the smaller id
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [math.nan] + [1.0] * 15), (2300, [None] + [1.0] * 15),
             (2400, [math.inf] * 16), (None, rows[5][1]), rows[7], (2500, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_nearest(spark, monkeypatch):
    from gleaner.llm import graph_ann
    monkeypatch.setattr(graph_ann, "SHARD", 200)
    frame = vectors(spark)
    found = graph_ann.nearest(v := graph_ann.usable(frame), v.where("vec_id % 100 = 0")).collect()
    data = {r.vec_id: np.array(r.v) for r in v.where("size(v) = 16").collect()}
    assert not {2000, 2100, 2200, 2300, 2400} & set(data)
    hit = total = 0
    for q in [i for i in data if i % 100 == 0]:
        near = sorted((float(np.sqrt(((x - data[q]) ** 2).sum())), i) for i, x in data.items() if i != q)[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11))
        assert all(g[2] == pytest.approx(float(np.sqrt(((data[g[1]] - data[q]) ** 2).sum())), abs=1e-12) for g in got)
        hit, total = hit + len({g[1] for g in got} & {n[1] for n in near}), total + 10
    assert hit / total >= 0.9
    assert not [r for r in found if r.query_id == 2500]  # no other vector of its length
    ties = graph_ann.nearest(v, v.where("vec_id = 3")).collect()
    assert sorted(r.vec_id for r in ties) == list(range(1000, 1010))
    assert graph_ann.nearest(v.where("false"), v.where("false")).count() == 0


def test_pipeline_stages(spark, docs, rows, no_docs):
    """Each stage against plain Python, on the edge rows and on a small table."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "repeated_substrings", "personal_data", "packed_sequences"]
    real = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = real.select("doc_id", "text", "lang", "source", "n_chars").union(
        docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars"))
    now = [(r.doc_id, r.text) for r in mixed.collect()]
    frame = mixed
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    by_id = lambda xs: sorted(xs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    frame = corpus_pipeline.quality_rules(spark, frame, SF).cache()
    now = [(d, t) for d, t in now if brute.keeps(t)]
    assert texts(frame) == by_id(now)
    frame = corpus_pipeline.near_duplicates(spark, frame, SF).cache()
    sets = [brute.shingles(t) for _, t in now]
    groups = {}
    for row, r in zip(now, brute.components(sets)):
        groups.setdefault(r, []).append(row)
    got = texts(frame)
    assert sorted(d for d, _ in got if d is not None) == sorted(
        min(d for d, _ in g if d is not None) for g in groups.values() if any(d is not None for d, _ in g))
    now = got
    frame = corpus_pipeline.repeated_substrings(spark, frame, SF).cache()
    left = {d: n for d, _, n, *_ in brute.removed_bytes(now)}
    out = dict(texts(frame))
    for d, t in now:
        if left[d] == 0:
            assert out[d] == t
        elif d in out:
            assert len(t.encode()) - left[d] - 6 * 20 <= len(out[d].encode()) <= len(t.encode()) - left[d]
    frame = corpus_pipeline.personal_data(spark, frame, SF).cache()
    assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = dict(texts(frame))
    for d, t in out.items():
        spans = brute.pii(t)
        assert (clean[d] == t) if not spans and not any(c in "0123456789@" for c in t) else True
        for a, _, z in spans:
            assert t[a:z] not in clean[d]
    packed = corpus_pipeline.packed_sequences(spark, frame, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}


def test_pipeline_of_nothing(spark, no_docs):
    import corpus_pipeline
    frame = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
