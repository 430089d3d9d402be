"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds to them.

The patterns label a bounded sample of documents; from these spans the tagger
is trained (in numpy, in one task). Then every text is read in whole: its
patterns are found, and overlapping windows around every digit and ``@`` (no
kind lacks both) are tagged. Where windows overlap, a character takes the tag
of the window in which it lies deepest, so spans across a border join up. A
tagged span counts when its characters are valid for its kind and no pattern's
span touches it: the tagger finds what a pattern's greedy match swallowed, such
as a card number after another number.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import BiLstmCrf
from .common import keyed

# Fixed values of the query contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the head of a run of digits, so longer runs stay linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents whose spans train the tagger (the least by hash of doc_id), and
#: windows of each kind that are used.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 8000, 150
WINDOW, STRIDE, CONTEXT = 96, 64, 16
EPOCHS, HIDDEN = 10, 24

_SIGNS = "@._%+- ()\n"
INPUTS = len(_SIGNS) + 4
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_CLASS = np.full(128, len(_SIGNS) + 3)
for _c in range(128):
    _x = chr(_c)
    _CLASS[_c] = (_SIGNS.index(_x) if _x in _SIGNS else len(_SIGNS) if _x.isdigit() else
                  len(_SIGNS) + 1 if _x.islower() else len(_SIGNS) + 2 if _x.isupper() else len(_SIGNS) + 3)
ALLOWED = np.array([[b % 2 == 1 or b == 0 or (a in (b - 1, b)) for b in range(TAGS)] for a in range(TAGS)])


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    """Whether a match of a kind's pattern is personal data of this kind."""
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split(".") if len(x.lstrip("0")) <= 3) and all(
            len(x.lstrip("0")) <= 3 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern read from each ``@``: its left part is the run before it, back
    to the last match. Linear in the text."""
    low = 0
    at = text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > low and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            if start < at:
                yield start, m.end()
                low = m.end()
        at = text.find("@", max(low, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all valid matches, in order."""
    found = [(a, 0, z) for a, z in _emails(text)] if "@" in text else []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m[0])]
    return sorted(found)


TRIGGER = re.compile(r"[0-9@]")


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches with digits or ``@``, close ones joined, with context on both sides."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, z = max(0, m.start() - 2 * CONTEXT), min(len(text), m.end() + 2 * CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all regions."""
    out = []
    for a, z in regions(text):
        out += [(i, min(i + WINDOW, z)) for i in range(a, max(a + 1, z - (WINDOW - STRIDE)), STRIDE)]
    return out


def _inputs(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pieces), WINDOW), np.int64)
    mask = np.zeros((len(pieces), WINDOW))
    for i, s in enumerate(pieces):
        codes = np.frombuffer(s.encode("utf-32-le"), "<u4")
        x[i, :len(s)] = np.where(codes < 128, _CLASS[codes.clip(max=127)], INPUTS - 1)
        mask[i, :len(s)] = 1
    steps = max((len(s) for s in pieces), default=1)
    return x.T[:steps], mask.T[:steps]


def _targets(pieces: list[str], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    tags = np.zeros((len(pieces), WINDOW), np.int64)
    for i, found in enumerate(spans):
        for a, kind, z in found:
            tags[i, a:z] = 2 + 2 * kind
            tags[i, a] = 1 + 2 * kind
    return tags.T


def _varied(rng, text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled window with other digits, and sometimes a number before a span:
    the label does not depend on which digits, nor on what stands before."""
    out, moved, at = "", [], 0
    for a, kind, z in spans:
        out += text[at:a]
        if rng.random() < 0.5:
            out += "".join(rng.choice(list("0123456789"), rng.integers(1, 5))) + " "
        start = len(out)
        out += re.sub("[0-9]", lambda _: str(rng.integers(0, 10)), text[a:z])
        moved.append((start, kind, len(out)))
        at = z
    out += text[at:]
    return out[:WINDOW], [s for s in moved if s[2] <= WINDOW]


def training_windows(docs: DataFrame, n_documents: int = SAMPLE_DOCUMENTS) -> list[tuple[str, list]]:
    """Labelled windows of a bounded sample: the documents with the least hashes
    of ``doc_id``. At most SAMPLE_WINDOWS of each kind, and of none, come back."""
    hashed = docs.select(F.xxhash64("doc_id").alias("h"))
    limit = hashed.orderBy("h").limit(n_documents).agg(F.max("h")).first()[0]
    if limit is None:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for n, (a, z) in enumerate(windows(text)):
                    inside = [(s - a, k, e - a) for s, k, e in spans if a <= s and e <= z]
                    whole = not any(s < z and e > a and not (a <= s and e <= z) for s, _, e in spans)
                    apart = all(x[2] <= y[0] for x, y in zip(inside, inside[1:]))
                    if whole and apart:
                        rows.append((text[a:z], [x for s in inside for x in s]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["piece", "spans"])

    found = (docs.where(F.xxhash64("doc_id") <= limit).select("text").mapInArrow(run, "piece string, spans array<long>")
             .withColumn("kind", F.when(F.size("spans") > 0, F.element_at("spans", 2)).otherwise(-1)).distinct())
    rows = []
    for kind in range(-1, len(KINDS)):
        rows += (found.where(F.col("kind") == kind).orderBy(F.xxhash64("piece"), "piece", "spans")
                 .limit(SAMPLE_WINDOWS).collect())
    return [(r["piece"], [tuple(r["spans"][i:i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in rows]


def train_tagger(labelled: list[tuple[str, list]], epochs: int = EPOCHS) -> BiLstmCrf | None:
    """The tagger, or None where no window holds a span to learn from."""
    if not any(spans for _, spans in labelled):
        return None
    rng = np.random.default_rng(6)
    rows = [*labelled, *(_varied(rng, text, spans) for text, spans in labelled for _ in range(2 if spans else 0))]
    model = BiLstmCrf(INPUTS, TAGS, ALLOWED, HIDDEN)
    pieces = [r[0] for r in rows]
    x, mask = _inputs(pieces)
    model.fit(x, mask, _targets(pieces, [r[1] for r in rows])[:len(x)], epochs)
    return model


def trained(docs: DataFrame) -> BiLstmCrf | None:
    """``train_tagger`` on a sample of ``docs``, run by a task: the driver holds the
    sample's few windows and the weights, not what the training keeps."""
    labelled = training_windows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(len(batch) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_tagger(labelled))], pa.binary())], ["model"])

    return pickle.loads(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "model binary").collect()[0]["model"])


def reconciled(length: int, cuts: list[tuple[int, int]], tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of one text from the tags of its windows."""
    best, tag = np.full(length, -1), np.zeros(length, np.int8)
    for (a, z), t in zip(cuts, tags):
        depth = np.minimum(np.arange(z - a) + (WINDOW if a == 0 else 0), np.arange(z - a)[::-1] + (WINDOW if z == length else 0))
        take = depth > best[a:z]
        best[a:z][take], tag[a:z][take] = depth[take], t[:z - a][take]
    out, i = [], 0
    for i in np.flatnonzero(tag % 2 == 1).tolist():
        kind = (int(tag[i]) - 1) // 2
        end = i + 1
        while end < length and tag[end] == 2 + 2 * kind:
            end += 1
        out.append((i, kind, end))
    return out


#: What a tagged span must look like as a whole.
SHAPES = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
          CARD, PHONE)


def _plausible(text: str, a: int, kind: int, z: int) -> bool:
    """A tagged span is a whole match of its kind, and no part of a longer number or word."""
    part = str.isalnum if kind == 0 else str.isdigit
    cut = (a > 0 and part(text[a - 1])) or (z < len(text) and part(text[z]))
    return not cut and bool(SHAPES[kind].fullmatch(text, a, z)) and valid(KINDS[kind], text[a:z])


def find_pii(docs: DataFrame, model: BiLstmCrf | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row, spans, added``: the columns ``carry`` as a struct, and arrays of ``(start, end, kind)`` in code
    points, by start and kind. ``spans`` are the patterns' matches, ``added`` what
    the tagger adds. A null or empty text has none; equal rows have equal spans;
    an empty table gives an empty one; other columns are not read."""
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
            added: list[list] = [[] for _ in texts]
            if model is not None:
                for cuts in _groups(texts):
                    pieces = [texts[i][a:z] for i, a, z in cuts]
                    tags = _decoded(model, pieces)
                    at = 0
                    while at < len(cuts):
                        i, end = cuts[at][0], at
                        while end < len(cuts) and cuts[end][0] == i:
                            end += 1
                        own = [(a, z) for _, a, z in cuts[at:end]]
                        added[i] += [s for s in reconciled(len(texts[i]), own, tags[at:end])
                                     if _plausible(texts[i], *s)
                                     and not any(a < s[2] and s[0] < z for a, _, z in base[i])]
                        at = end
            pack = lambda rows: pa.array([[{"start": a, "end": z, "kind": KINDS[k]} for a, k, z in r] for r in rows],
                                         pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pack(base), pack(added)], ["row", "spans", "added"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    rows = keyed(docs, carry).select("text", "row")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, spans {kind}, added {kind}")


def _groups(texts: list[str], size: int = 4096) -> Iterator[list[tuple[int, int, int]]]:
    """Windows ``(text, from, to)`` of whole texts, a few thousand at once."""
    cuts: list[tuple[int, int, int]] = []
    for i, t in enumerate(texts):
        cuts += [(i, a, z) for a, z in windows(t)]
        if len(cuts) >= size:
            yield cuts
            cuts = []
    if cuts:
        yield cuts


def _decoded(model: BiLstmCrf, pieces: list[str]) -> np.ndarray:
    out = np.zeros((len(pieces), WINDOW), np.int8)
    for k in range(0, len(pieces), 512):
        tags = model.decode(*_inputs(pieces[k:k + 512])).T
        out[k:k + 512, :tags.shape[1]] = tags
    return out


def masked(text, spans):
    """Native expression: ``text`` with each span replaced by ``[kind]``; spans
    must be in order, and overlapping ones are masked together under the first."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = F.aggregate(spans, start, lambda acc, s: F.when(
        s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit("["), s["kind"], F.lit("]"))).alias("out"), s["end"].alias("at"))))
    return F.concat(end["out"], F.substr(text, (end["at"] + 1).cast("int"), F.length(text)))


def detect_pii(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on a sample of ``docs``, then tag all of them (see ``find_pii``)."""
    return find_pii(docs, trained(keyed(docs)), carry)
