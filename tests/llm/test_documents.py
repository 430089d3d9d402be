"""Operators on documents, against plain Python versions, on edge rows."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import brute
from .conftest import prose as brute_prose

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


# ------------------------------------------------------------------- 1 suffixes
def suffix_result(docs):
    from gleaner.llm.suffix import dedup_substrings
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return listed(dedup_substrings(docs), F.col("row.doc_id"), F.col("n_bytes"), removed, F.size("spans"), F.sha2("kept", 256))


def test_suffix_dedup_matches_brute_force(docs, rows):
    assert suffix_result(docs) == sorted(brute.removed_bytes(rows), key=key)


@pytest.mark.parametrize("most_kinds", [1, 10**6])
def test_suffix_dedup_with_anchors_dealt_out(docs, rows, monkeypatch, most_kinds):
    from gleaner.llm import suffix
    some = frozenset(r[0] for r in suffix.find_stretches(
        suffix.keyed(docs).select(F.lit(1).cast("long").alias("did"), F.lit(0).cast("long").alias("rid"), "text"))
        .groupBy("anchor").count().where("count > 1").collect())
    monkeypatch.setattr(suffix, "hot_anchors", lambda _: some)
    monkeypatch.setattr(suffix, "MOST_KINDS", most_kinds)
    assert suffix_result(docs) == sorted(brute.removed_bytes(rows), key=key)


def test_long_text_in_overlapping_parts(spark, monkeypatch):
    from gleaner.llm import suffix
    monkeypatch.setattr(suffix, "LONGEST", 150)
    text = "".join(chr(97 + (i * i) % 23) for i in range(1000))
    data = np.frombuffer(text.encode(), np.uint8)
    found = [(int(s) + k) for n, start, count, *_ in suffix.stretches(data, np.array([0]), np.array([1000]))
             for s, c in zip(start, count) for k in range(c)]
    assert sorted(found) == list(range(901))


def test_suffix_dedup_of_many_rows_without_id(spark):
    """Rows that share an id (or have none) keep their own ranges, however many they are."""
    passage, rng = brute_prose(1, 40), __import__("random").Random(4)
    rows = [(None, f"{i} x" + (" " + passage if i % 50 == 7 else "")) for i in range(3000)]
    rows += [(5, f"{i} {passage[:130]} {rng.random()}" if i % 3 else f"{i}") for i in range(60)]
    got = suffix_result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == sorted(brute.removed_bytes(rows), key=key)
    assert sum(r[2] > 0 for r in got) > 50


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix_result(no_docs) == []


# -------------------------------------------------------------------- 2 packing
def pieces_of(rows, capacity=4096):
    library, out = Tokenizer.from_file(WORD_BPE), []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), capacity):
            cut = ids[at:at + capacity]
            out.append((doc, at // capacity, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, rows, capacity):
    from gleaner.llm.packing import bound, pack_documents
    packed = pack_documents(docs, WORD_BPE, capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(
        pieces_of(rows, capacity), key=key)
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= capacity
    counts = {}
    for r in packed:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(at) <= bound(counts, capacity) + 1


def test_sequences_hold_the_ids(docs, rows):
    from gleaner.llm.packing import pack_documents, sequences
    packed = pack_documents(docs, WORD_BPE)
    got = sequences(docs, packed, WORD_BPE).collect()
    assert sum(len(r.ids) for r in got) == 4 * sum(p[3] for p in pieces_of(rows))


def test_bins_are_completed():
    from gleaner.llm.packing import best_fit, bound, complete_bins
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 100, 500), rng.integers(30, 70, 60), np.array([51, 50, 49, 27, 26, 23, 25, 49])):
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        patterns = complete_bins(counts, 100)
        used = {}
        for times, fill in patterns:
            assert sum(s * k for s, k in fill.items()) <= 100
            for s, k in fill.items():
                used[s] = used.get(s, 0) + times * k
        assert used == counts
        assert bound(counts, 100) <= sum(t for t, _ in patterns) <= sum(t for t, _ in best_fit(counts, 100))


def test_word_ids_without_the_library():
    """Words of common characters take their ids from the merges alone; others go to the library."""
    import random

    from gleaner.llm.packing import WordEncoder
    rng, library = random.Random(2), Tokenizer.from_file(WORD_BPE)
    texts = ["".join(rng.choice("abcdETH  'snrvelm\n07\t!?-\u2019\u20ac\u00e9\u00df\u00c5\u0131\u0149\u017f\u00b5\u00bd\u00a0\u00ab\u00d7")
                     for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", "x" * 5000, "It's they'll WE'VE ''s !'s 'S", "\u00c9cole \u00dcBER na\u00efve \u2014 \u20ac5"]
    rare = ["\u65e5\u672c", "<|endoftext|> a", "e\u0301", "\u0130x"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts + rare, add_special_tokens=False)]
    encoder, asked = WordEncoder(WORD_BPE), []

    class Library:
        def encode(self, text, **options):
            asked.append(text)
            return library.encode(text, **options)

        def encode_batch(self, some, **options):
            asked.extend(some)
            return library.encode_batch(some, **options)

    encoder.library = Library()
    assert encoder.encode(texts) == want[:len(texts)]
    assert encoder.encode(texts + rare) == want
    from gleaner.llm.packing import RARE
    assert asked == [t for t in texts if RARE.search(t)] * 2 + rare


def test_packing_of_nothing(no_docs):
    from gleaner.llm.packing import pack_documents
    assert pack_documents(no_docs, WORD_BPE).count() == 0


# ----------------------------------------------------------------- 3 LM scoring
@pytest.mark.parametrize("max_broadcast", [4_000_000, 0])
def test_ppm_scores(docs, rows, max_broadcast):
    import collections
    import math

    from gleaner.llm.ppm import score_documents
    held = lambda d: d is not None and d % 3 == 0
    got = score_documents(docs, F.col("doc_id") % 3 == 0, max_broadcast=max_broadcast).collect()
    model = brute.Ppm([t for d, t in rows if not held(d)])
    counts = collections.Counter(w for d, t in rows if not held(d) for w in [*brute.words(brute.lower(t)), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for d, t in rows:
        w = [*brute.words(brute.lower(t)), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        expected.append((d, held(d), len(w), sum(counts[x] > 0 for x in w), total, base, model.score(t)))
    got = sorted((tuple(r) for r in got), key=lambda r: (key(r[:1]), r[6]))
    expected.sort(key=lambda r: (key(r[:1]), r[6]))
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_ppm_joins_rare_strings_only(docs, rows, monkeypatch):
    """With more strings than are sent, the frequent ones are sent all the same: rows for the join are few."""
    import collections

    from gleaner.llm import ppm
    landed, tables = ppm.landed, {}

    def kept(df, name, *a, **b):
        tables[name] = landed(df, name, *a, **b)
        return tables[name]

    monkeypatch.setattr(ppm, "landed", kept)
    held = lambda d: d is not None and d % 3 == 0
    streams = [b"\n" * ppm.ORDER + b" ".join((t or "").encode().lower().split()) + b"\n" for _, t in rows]
    grams = [[s[i:i + ppm.ORDER + 1] for i in range(len(s) - ppm.ORDER)] for s in streams]
    seen = collections.Counter(g for (d, _), some in zip(rows, grams) if not held(d) for g in some)
    twice = sum(n > 1 for n in seen.values())
    assert twice < len(seen)
    got = ppm.score_documents(docs, F.col("doc_id") % 3 == 0, max_broadcast=twice).collect()
    joined = tables["scores"].where("kind = 2").count()
    assert joined == sum(len({g for g in some if seen[g] < 2}) for some in grams)
    model = brute.Ppm([t for d, t in rows if not held(d)])
    expected = sorted((key([d]), model.score(t)) for d, t in rows)
    for (a, x), (b, y) in zip(sorted((key([r.doc_id]), r.score) for r in got), expected, strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-9)


def test_ppm_probabilities_add_up(docs, rows):
    model = brute.Ppm([t for _, t in rows][:4])
    for context in (b"the o", b"\n\n\n\n\n", b"zzzzz"):
        assert sum(10 ** model.symbol(context, s) for s in range(256)) == pytest.approx(1, abs=1e-6)


def test_ppm_without_training_rows(docs, no_docs):
    from gleaner.llm.ppm import score_documents
    assert score_documents(no_docs, F.lit(False)).count() == 0
    r = score_documents(docs.where("doc_id = 7"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0)


# ------------------------------------------------------------- 4 paragraph dedup
def test_large_buckets_are_split(spark, monkeypatch):
    """Paragraphs that share just one line's tokens do not meet; linked ones still do."""
    import random

    import numpy as np

    from gleaner.llm import paragraphs
    monkeypatch.setattr(paragraphs, "BLOCK", 20)
    rng = random.Random(3)
    line = list(range(1, 9))
    sets = [sorted(line + rng.sample(range(100, 10 ** 9), 22)) for _ in range(300)]
    near = [sorted([*s[:-1], 10 ** 9 + i]) for i, s in enumerate(sets[:40])]  # 29 of 31 tokens
    sets += near
    blobs = [(pid, np.array(s, "<u8").tobytes()) for pid, s in enumerate(sets)]
    members = spark.createDataFrame([(7, pid, len(sets), 0) for pid in range(len(sets))], "bucket long, pid long, size long, leader long")
    table = spark.createDataFrame(blobs, "pid long, tokens binary")
    dealt, landed = {}, paragraphs.landed

    def kept(df, name, *a, **b):
        dealt[name] = landed(df, name, *a, **b)
        return dealt[name]

    monkeypatch.setattr(paragraphs, "landed", kept)
    links = {frozenset((r.a, r.b)) for r in paragraphs.bucket_links(members, table).collect()}
    assert links == {frozenset((i, 300 + i)) for i in range(40)}
    # before, each of 340 paragraphs was compared with all 17 parts
    assert dealt["finer"].agg(F.max("size")).first()[0] <= 20
    assert dealt["finer"].count() <= 40 * 2 * 7


@pytest.mark.parametrize("block", [400, 2])
def test_paragraphs(docs, rows, monkeypatch, block):
    from gleaner.llm import paragraphs
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    items = [(d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n"))
             if len(brute.words(line)) >= paragraphs.MIN_WORDS]
    root = brute.components([brute.shingles(x[2]) for x in items])
    last = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = []
    for r in set(root):
        members = sorted(((d, i) for (d, i, _), q in zip(items, root) if q == r), key=last)
        if len(members) > 1:
            expected += [(*m, *members[0], k > 0) for k, m in enumerate(members)]
    got = listed(paragraphs.repeated_paragraphs(docs), "doc_id", "paragraph", "class_doc_id", "class_paragraph", "removed")
    assert got == sorted(expected, key=key)


def test_paragraphs_removed(docs, no_docs):
    from gleaner.llm.paragraphs import repeated_paragraphs, without_paragraphs
    assert repeated_paragraphs(no_docs).count() == 0
    left = {r.doc_id: r.text for r in without_paragraphs(docs, repeated_paragraphs(docs)).where("doc_id IN (9, 10)").collect()}
    assert left[9].count("\n") == 2 and left[10].count("\n") == 0


def wrapped_rows():
    """Repeats in short lines, near copies of them, and passages set in short lines."""
    import itertools
    import random

    from .conftest import prose
    rng, rows = random.Random(4), []
    for i in range(40):  # lines of every length, each copied with one word changed at an end
        words = prose(100 + i, i + 1).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, prose(200 + i, 50) + "\n" + " ".join([*words[:-1], "other"]))]
    hard = lambda words, n: "\n".join(" ".join(x for x in part if x) for part in itertools.zip_longest(*[iter(words)] * n))
    for i in range(12):
        words = prose(300 + i, 60 + 5 * i).split()
        changed = list(words)
        changed[rng.randrange(len(words))] = "changed"
        rows += [(500 + i, prose(400 + i, 45) + "\n\n" + hard(words, 9) + "\n \n" + prose(500 + i, 12)),
                 (600 + i, hard(changed, 7)), (700 + i, " ".join(words)), (800 + i, "a\n" + prose(500 + i, 12) + "\n\na")]
    return rows + [(900, hard(prose(9, 38).split() + ["end"], 38)), (None, "a"), (901, None), (902, " \n\t\n")]


def plain_units(text):
    """``(first line, last line, text)``: lines with words, and runs of lines under 40."""
    lines = (text or "").split("\n")
    counts = [len(brute.words(x)) for x in lines]
    out = [(i, i, x) for i, x in enumerate(lines) if counts[i]]
    for i in range(len(lines)):
        if 0 < counts[i] < 40 and not (i and 0 < counts[i - 1] < 40):
            j = i
            while j + 1 < len(lines) and 0 < counts[j + 1] < 40:
                j += 1
            if j > i:
                out.append((i, j, "\n".join(lines[i:j + 1])))
    return out


@pytest.mark.parametrize("block", [400, 2])
def test_short_lines_and_joined_lines(spark, monkeypatch, block):
    from gleaner.llm import paragraphs
    monkeypatch.setattr(paragraphs, "BLOCK", block)
    rows = wrapped_rows()
    items = [(d, *u) for d, t in rows for u in plain_units(t)]
    root = brute.components([brute.shingles(x[3]) for x in items])
    expected = []
    for r in set(root):
        members = [x[:3] for x, q in zip(items, root) if q == r]
        members = [(d, i, j) for d, i, j in members if i == j or not any((d, k, k) in members for k in range(i, j + 1))]
        members.sort(key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))
        if len(members) > 1:
            expected += [(*m, *members[0][:2], k > 0) for k, m in enumerate(members)]
    assert any(i < j for _, i, j, *_ in expected) and sum(gone for *_, gone in expected) > 40
    found = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).cache()
    assert listed(found, "doc_id", "paragraph", "last", "class_doc_id", "class_paragraph", "removed") == sorted(expected, key=key)
    text = {d: t or "" for d, t in rows}
    for r in found.collect():
        assert text[r.doc_id][r.start:r.end].split("\n") == text[r.doc_id].split("\n")[r.paragraph:r.last + 1]


def test_joined_lines_go_together(spark):
    from gleaner.llm.paragraphs import repeated_paragraphs, without_paragraphs

    from .conftest import prose
    words = prose(1, 60).split()
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(["top " * 50, *(" ".join(words[i:i + 10]) for i in range(0, 60, 10)), "",
                                                                    "last line"]))], "doc_id long, text string")
    left = {r.doc_id: r.text for r in without_paragraphs(docs, repeated_paragraphs(docs)).collect()}
    assert left == {1: " ".join(words), 2: "top " * 50 + "\n\nlast line"}


def plain_passages(rows, size=50):
    """Per document the words of strings that stand twice, and of those that go."""
    first, twice = {}, set()
    texts = [(d, [m.span() for m in brute.WORD.finditer(t or "")], brute.lower(t)) for d, t in rows]
    for step in (0, 1):
        out = {}
        for doc, at, t in texts:
            there, gone = out.setdefault(doc, (set(), set()))
            for i in range(len(at) - size + 1):
                string, place = tuple(t[a:z] for a, z in at[i:i + size]), (doc, i)
                if step == 0:
                    if string in first:
                        twice.add(string)
                    first[string] = min(place, first.get(string, place))
                elif string in twice:
                    there.update(range(i, i + size))
                    if first[string] != place:
                        gone.update(range(i, i + size))
    return out


def test_embedded_passages(spark):
    from gleaner.llm.passages import repeated_passages

    from .conftest import prose
    rows = [(0, prose(1, 30)), (1, None), (2, "ab " * 200)]
    for i in range(30):  # passages of 46 to 75 words inside longer lines, some set in short lines
        passage = prose(100 + i, 46 + i).split()
        for k in range(3):
            text = ("\n" if (i + k) % 3 == 0 else " é ").join([" ".join(passage[j:j + 8]) for j in range(0, len(passage), 8)])
            if " é " in text:
                text = " ".join(passage).upper() if k == 1 else " ".join(passage)
            rows.append((10 + 3 * i + k, f"é日 {prose(1000 + 3 * i + k, 70 + i)} {text} {prose(2000 + 3 * i + k, 80)}"))
    rows.append((500, rows[20][1] + "\n" + rows[30][1] + " " + rows[30][1]))
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {d: (set(), set()) for d, _ in rows}
    spans = {d: [m.span() for m in brute.WORD.finditer(t or "")] for d, t in rows}
    text = {d: t or "" for d, t in rows}
    for r in found:
        words = {i for i, (a, z) in enumerate(spans[r.doc_id]) if r.start <= a and z <= r.end}
        assert len(words) >= 50 and (r.paragraph, r.last) == tuple(text[r.doc_id][:x].count("\n") for x in (r.start, r.end))
        got[r.doc_id][0].update(words)
        got[r.doc_id][1].update(words if r.removed else ())
    expected = plain_passages(rows)
    assert got == expected and sum(bool(gone) for _, gone in expected.values()) > 50
    assert repeated_passages(spark.createDataFrame(rows[:2], "doc_id long, text string")).count() == 0
    equal = repeated_passages(spark.createDataFrame([(1, prose(5, 70))] * 3, "doc_id long, text string"))
    assert sorted((r.start, r.end, r.removed) for r in equal.collect()) == [(0, len(prose(5, 70)), x) for x in (False, True, True)]


def test_query_has_paragraphs_and_passages(spark, monkeypatch):
    from gleaner.llm import queries

    from .conftest import prose
    docs = spark.createDataFrame([(i, prose(i, 90) + " " + prose(7, 60) + " " + prose(50 + i, 90) + "\nshort line") for i in (1, 2)],
                                 "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    found = queries.QUERIES["op4_paragraph_dedup"](spark, "").collect()
    assert sorted((r.doc_id, r.unit, r.paragraph, r.class_doc_id, r.removed) for r in found) == [
        (1, "line", 1, 1, False), (1, "passage", 0, 1, False), (2, "line", 1, 1, True), (2, "passage", 0, 1, True)]


def test_bands_reach_the_recall():
    from gleaner.llm.paragraphs import tuned_bands
    for percent in (50, 80, 95, 100):
        bands, rows = tuned_bands(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-4 or rows == 1


# -------------------------------------------------------------- 5 quality rules
def test_rules(docs, rows):
    from gleaner.llm.rules import MEASURES, apply_policy, ledger
    got = listed(apply_policy(ledger(docs)), "doc_id", *MEASURES, "kept")
    assert got == sorted(((d, *(m := brute.rule_measures(t))[:1], *m[1:], brute.keeps(t)) for d, t in rows), key=key)


def test_policies_and_ablations_read_bits(spark, docs, no_docs):
    from gleaner.llm.rules import BITS, POLICIES, ablations, apply_policy, keep_documents, ledger
    entries = ledger(docs)
    for name, mask in POLICIES.items():
        assert apply_policy(entries, name).where("kept").count() == entries.where(f"failed & {mask} = 0").count()
    rows = {r.rule: r for r in ablations(entries).collect()}
    assert rows["symbols"].fails == entries.where(f"failed & {BITS['symbols']} <> 0").count()
    assert rows["symbols"].kept_without >= apply_policy(entries).where("kept").count()
    assert keep_documents(docs).columns == docs.columns
    assert apply_policy(ledger(no_docs)).count() == 0


def test_rules_stay_in_the_jvm(docs):
    from gleaner.llm.rules import apply_policy, ledger
    plan = apply_policy(ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("\n")[0]


# ------------------------------------------------------------------------ 6 PII
def test_pii_patterns_are_those_of_the_contract():
    import random

    from gleaner.llm import pii
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("ab1203.@@+ -()%x5\u00e9") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute.pii(text), text


def test_pii_on_edge_rows(docs, rows, no_docs):
    from gleaner.llm.pii import KINDS, find_pii
    got = listed(find_pii(docs, None), F.col("row.doc_id"), F.expr(
        "array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"))
    assert got == sorted(((d, ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in brute.pii(t))) for d, t in rows), key=key)
    assert find_pii(no_docs, None).count() == 0


def test_tagger_gradients():
    from gleaner.llm.bilstm_crf import BiLstmCrf
    rng = np.random.default_rng(0)
    model = BiLstmCrf(4, 3, np.ones((3, 3), bool), hidden=3, seed=1)
    x, tags, mask = rng.integers(0, 4, (5, 2)), rng.integers(0, 3, (5, 2)), np.ones((5, 2))
    mask[3:, 1] = 0
    _, g = model.gradients(x, mask, tags)
    for name, p in model.p.items():
        at = tuple(min(1, n - 1) for n in p.shape)
        old, step = p[at], 1e-5
        p[at] = old + step
        up = model.gradients(x, mask, tags)[0]
        p[at] = old - step
        down = model.gradients(x, mask, tags)[0]
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][at], rel=1e-4, abs=1e-7)


def test_tagger_is_trained_by_a_task(spark, monkeypatch):
    """The driver's memory does not hold the training; the weights are those of the same fit."""
    from gleaner.llm import pii
    docs = pii.keyed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    wanted = pii.train_tagger(pii.training_windows(docs))
    here = lambda *a, **k: pytest.fail("trained on the driver")
    monkeypatch.setattr(pii.BiLstmCrf, "fit", here)
    got = pii.trained(docs)
    assert got.p.keys() == wanted.p.keys() and all(np.allclose(got.p[k], wanted.p[k]) for k in got.p)
    assert pii.detect_pii(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count() == docs.count()
    assert pii.trained(docs.where("false")) is None


def test_tagger_learns_and_adds(spark):
    """Held-out accuracy on labelled windows of a real table, and what it may add."""
    from gleaner.llm import pii
    labelled = pii.training_windows(pii.keyed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    assert len(labelled) <= 5 * pii.SAMPLE_WINDOWS
    held, train = labelled[::4], [x for i, x in enumerate(labelled) if i % 4]
    model = pii.train_tagger(train, epochs=30)
    right = found = there = 0
    for (text, spans), tags in zip(held, pii._decoded(model, [t for t, _ in held])):
        got = set(pii.reconciled(len(text), [(0, len(text))], tags[None]))
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right / found > 0.85 and right / there > 0.85
    # the pattern takes both numbers as one and drops them; the tagger can see the second
    text = "ande the of thand erly 61 4080166431094600 then ing of reon"
    assert pii.base_spans(text) == []
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for s in pii.find_pii(frame, model).first().added:
        assert (s.kind, text[s.start:s.end]) == ("card", "4080166431094600")


def test_masking_keeps_the_rest(spark):
    from gleaner.llm.pii import masked
    frame = spark.createDataFrame([("a bcd efg", [(2, 5, "ip"), (4, 6, "card"), (8, 9, "email")])],
                                  "text string, spans array<struct<start:long,end:long,kind:string>>")
    assert frame.select(masked(F.col("text"), F.col("spans"))).first()[0] == "a [ip]ef[email]"
    plain = spark.createDataFrame([("héllo x@y.z!", [(6, 11, "email")])], frame.schema)
    assert plain.select(masked(F.col("text"), F.col("spans"))).first()[0] == "héllo [email]!"


# ------------------------------------------------------------------------ 7 BPE
def test_bpe_round_trip(docs, rows, no_docs):
    from gleaner.llm.bpe import encode_documents
    library = Tokenizer.from_file(BYTE_BPE)
    got = listed(encode_documents(docs, BYTE_BPE), "doc_id", F.sha2("ids", 256), "decoded")
    expected = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected, key=key)
    assert encode_documents(no_docs, BYTE_BPE).count() == 0


def test_bpe_random_texts():
    import random

    from gleaner.llm.bpe import PrefixBpe
    library, own, rng = Tokenizer.from_file(BYTE_BPE), PrefixBpe(BYTE_BPE), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcdeth  'snrve\n0\u00e9\u65e5-") for _ in range(rng.randint(0, 60)))
        ids, decoded = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids
        assert decoded == text.encode()


# ------------------------------------------------------------- 10 Jaccard join
@pytest.mark.parametrize("block, frequent", [(400, 1 / 1000), (2, 1 / 3)])
def test_jaccard_join(docs, rows, monkeypatch, block, frequent):
    from gleaner.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    sets = [brute.shingles(t) for _, t in rows]
    root = brute.components(sets)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    got = listed(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root)), key=key)


def test_jaccard_join_frees_its_shuffles(docs, monkeypatch):
    """What a landed table was made of goes when its write ends, also the links, which are read twice."""
    from gleaner.llm import components, jaccard
    landed, freed = jaccard.landed, {}

    def kept(df, name, release=False):
        freed[name] = release
        return landed(df, name, release)

    monkeypatch.setattr(jaccard, "landed", kept)
    monkeypatch.setattr(components, "landed", kept)
    assert jaccard.near_duplicates(docs).count() == docs.count()
    assert all(freed.values()) and {"keys", "sets", "matrix", "tokens", "opened", "links", "edges"} <= set(freed)


def test_jaccard_join_of_many_common_tokens(spark, monkeypatch):
    """Sets that share many tokens with many blocks by chance: no pair is left out."""
    import random

    from gleaner.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = random.Random(11)
    common = [f"c{i} d{i} e{i} f{i} g{i}" for i in range(30)]
    texts = []
    for _ in range(40):
        base = [w for p in rng.sample(common, 12) for w in p.split()] + [f"w{rng.randint(0, 10 ** 6)}" for _ in range(rng.randint(30, 200))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for at in rng.sample(range(60, len(near)), rng.randint(1, 5)):
                near[at] = f"x{rng.randint(0, 10 ** 6)}"
            texts.append(near[:len(near) - rng.randint(0, 8)])
    rows = list(enumerate(" ".join(t) for t in texts))
    root = brute.components([brute.shingles(t) for _, t in rows])
    got = listed(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "doc_id", "component_id")
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(d, least.get(r, d))
    assert got == sorted(((d, least[r]) for (d, _), r in zip(rows, root)), key=key)
    assert len(set(least.values())) < len(rows)


def test_frequent_tokens_of_all_sets(spark, monkeypatch):
    """Sets whose number a sample of every k-th would never meet count as well."""
    import numpy as np

    from gleaner.llm import jaccard
    monkeypatch.setattr(jaccard, "FREQUENT_SETS", 10, raising=False)
    monkeypatch.setattr(jaccard, "FREQUENT", 1 / 10)
    # 1: in 100 of 200 sets, none of them a 20th; 2: in 21; 3: in 20, so not in more than a tenth
    tokens = [sorted({1 << 60 | rid, *([1] if rid % 2 else []), *([2] if rid < 21 else []), *([3] if rid < 20 else [])})
              for rid in range(200)]
    sets = spark.createDataFrame([(rid, np.array(t, "<u8").tobytes()) for rid, t in enumerate(tokens)],
                                 "rid long, tokens binary").repartition(7)
    assert jaccard.frequent_tokens(sets, 200).tolist() == [1, 2]
    assert len(jaccard.frequent_tokens(sets.limit(0), 1)) == 0


def test_one_of_each_group_stays(docs, rows, no_docs):
    from gleaner.llm.jaccard import keep_one
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    root = brute.components([brute.shingles(t) for _, t in rows])
    empty = sum(not brute.shingles(t) for _, t in rows)
    assert kept.count() == len({r for r, (_, t) in zip(root, rows) if brute.shingles(t)}) + empty
    assert kept.where("doc_id IN (2, 3)").count() == 0
    assert keep_one(no_docs).count() == 0


def test_components(spark):
    from gleaner.llm.components import connected
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 1), (500, 500)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == 100 and got[500] == 500
