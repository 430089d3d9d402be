"""The scans of repeated paragraphs and passages: blocks of texts against plain versions, and what is sent and kept."""

import time

import numpy as np
import pyarrow as pa
import pytest

from . import brute
from .conftest import prose


def plain_units(text, min_words, short=40):
    """``(number, last, run, start, end)`` of lines and of runs of short neighbours."""
    out, run, at = [], [], 0
    lines = text.split("\n")
    for number, line in enumerate([*lines, None]):
        n = len(brute.words(line or ""))
        if 0 < n < short:
            run.append((number, at, at + len(line), n))
        else:
            if len(run) > 1 and sum(r[3] for r in run) >= min_words:
                out.append((run[0][0], run[-1][0], run[0][0], run[0][1], run[-1][2]))
            run = []
        if n >= max(min_words, 1):
            out.append((number, number, run[0][0] if run else number, at, at + len(line)))
        at += len(line or "") + 1
    return sorted(out)


@pytest.mark.parametrize("min_words", [1, 4])
def test_units_and_sets_of_blocks(rows, min_words, monkeypatch):
    from gleaner.llm import repeats, shingles
    texts = [t or "" for _, t in rows] + ["é日 " + prose(i, 30 + i) + "\n\n" + prose(i, 45) + "\na\nb c\n" * (i % 3) for i in range(12)]
    for size in (1, 3000, 1 << 18):  # a block per text, some texts a block, all texts in one
        monkeypatch.setattr(repeats, "parts", lambda starts, ends, size=size: shingles.parts(starts, ends, size))
        found = {i: [] for i in range(len(texts))}
        for b in repeats.blocks(pa.array(texts)):
            doc, place, first, end = repeats.units(b, min_words)
            if not len(doc):
                continue
            tokens, sizes, _ = repeats.unit_sets(b, first, end)
            sets = np.split(tokens, np.cumsum(sizes)[:-1])
            for d, p, s in zip((doc + b.low).tolist(), place.tolist(), sets):
                found[d].append(tuple(p))
                want, = shingles.shingle_sets(pa.array([texts[d][p[3]:p[4]]]))
                assert np.array_equal(s, want)
        assert {i: sorted(x) for i, x in found.items()} == {i: plain_units(t, min_words) for i, t in enumerate(texts)}


def test_only_what_meets_is_landed(spark):
    """Buckets of paragraphs that stand alone and anchors that stand once end with the first scan."""
    from gleaner.llm import repeats
    texts = [prose(i, 120) for i in range(20)]
    near = texts[0].split()
    near[60] = "changed"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(near)])), "doc_id long, text string")
    found = repeats.repeats(docs)
    assert found.places.count() == 21
    assert {(r.size, r.n) for r in found.members.groupBy("bucket", "size").count().withColumnRenamed("count", "n").collect()} == {(2, 2)}
    assert found.members.select("pid").distinct().count() == found.sets.count() == 2
    assert {r.did for r in found.stretches.select("did").distinct().collect()} == {0, 20}


def test_shuffle_files_go_with_their_write(spark):
    from gleaner.llm.common import FREED, landed
    before = _files(spark)
    df = spark.range(1000).repartition(3, "id")
    out = landed(df, "test", release=True)
    end = time.time() + 10
    while _files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _files(spark) - before
    assert spark.conf.get(FREED, "false") == "false"
    assert out.count() == df.count() == 1000


def _files(spark):
    """Shuffle data files of this session."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x and x.endswith(".data")}
