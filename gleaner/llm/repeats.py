"""The two scans that near-duplicate paragraphs and repeated passages share.

The first scan sends what may meet: each paragraph's buckets and each text's anchors,
packed by batch, with the paragraphs' places. One task gets all of a bucket or anchor;
only those that two paragraphs or places have go on. The second scan reads the texts
that hold such paragraphs or anchors, once, and cuts sets and stretches from them.
Texts are worked on in blocks, each with its words numbered at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, landed
from .jaccard import NO_ID, PERCENT, _partition, least_overlap
from .shingles import _BASE, _INVERSE, SIZE, parts, scramble, text_bytes, word_numbers

MIN_WORDS = 1
#: Neighbouring lines under so many words are also joined to one paragraph.
SHORT = 40
#: Sets of up to so many shingles meet by their least tokens, larger ones in bands.
FEW = 35
MISS, MOST_BANDS = 1e-4, 20
#: Words of a passage, and of the string in it that is its anchor.
WORDS, ANCHOR = 50, 32


class Block(NamedTuple):
    """Neighbouring texts of a batch, each followed by a line break."""

    low: int  #: number of the first text in the batch
    data: np.ndarray
    starts: np.ndarray  #: first byte of each text
    ends: np.ndarray  #: the line break after it
    first: np.ndarray  #: first byte, end and number of each word
    end: np.ndarray
    number: np.ndarray
    points: np.ndarray  #: code points before each byte


def blocks(column) -> Iterator[Block]:
    data, starts, ends = text_bytes(column)
    for low, high in parts(starts, ends):
        block = np.concatenate([x for i in range(low, high) for x in (data[starts[i]:ends[i]], _BREAK)])
        at = np.cumsum(ends[low:high] - starts[low:high] + 1)
        yield Block(low, block, np.concatenate(([0], at[:-1])), at - 1, *word_numbers(block),
                    np.concatenate(([0], np.cumsum((block & 0xC0) != 0x80))))


_BREAK = np.array([10], np.uint8)


# ------------------------------------------------------------------- paragraphs
def tuned_bands(percent: int = PERCENT, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most selective bands that miss a pair at the threshold
    with at most ``miss`` probability."""
    best = (most, 1)
    for rows in range(1, 33):
        chance = (percent / 100) ** rows
        bands = int(np.ceil(np.log(miss) / np.log1p(-chance))) if chance < 1 else 1
        if bands <= most:
            best = (bands, rows)
    return best


def signatures(tokens: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit number per set and band. Sets lie side by side and must not be empty."""
    rng = np.random.default_rng(4)
    times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 64, bands * rows, np.uint64)
    out = np.zeros((bands, len(sizes)), np.uint64)
    first = np.cumsum(sizes) - sizes
    h = np.empty_like(tokens)
    for k in range(bands * rows):
        # the high half of a product is well mixed; it comes first in the order
        np.multiply(tokens, times[k], out=h)
        h += plus[k]
        least = np.minimum.reduceat(h, first)
        out[k // rows] = scramble(out[k // rows] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k))
    return out.T


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``sizes`` of them, side by side."""
    return np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)


def buckets_of(tokens: np.ndarray, sizes: np.ndarray, bands: int, per_band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the number of the set of each. A set that only an equal one can reach has none."""
    # a partner of a set of FEW may itself be larger: it goes by least tokens as well
    short = np.where(sizes <= 100 * FEW // percent, sizes - least_overlap(sizes, percent) + 1, 0)
    short[(sizes * 100 < (sizes + 1) * percent) & (least_overlap(sizes, percent) == sizes)] = 0
    start = np.cumsum(sizes) - sizes
    bucket, owner = tokens[_spans(start, short)], np.repeat(np.arange(len(sizes)), short)
    large = np.flatnonzero(sizes > FEW)
    if len(large):
        marks = signatures(tokens[_spans(start[large], sizes[large])], sizes[large], bands, per_band)
        marks = marks ^ scramble(np.arange(1, bands + 1, dtype=np.uint64))
        bucket, owner = np.concatenate((bucket, marks.reshape(-1))), np.concatenate((owner, np.repeat(large, bands)))
    return bucket, owner


#: A paragraph's numbers of the first and last line and of its run's first line, and its places in code points.
PLACE = ["paragraph", "last", "run", "start", "end"]


def units(b: Block, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the paragraphs of a block: text, ``PLACE``, first word and end."""
    line_end = np.flatnonzero(b.data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    doc = np.searchsorted(b.ends, line_end)
    line = np.arange(len(line_end)) - np.concatenate(([0], np.searchsorted(line_end, b.ends)[:-1] + 1))[doc]
    word, stop = np.searchsorted(b.first, line_start), np.searchsorted(b.first, line_end)
    n = stop - word
    short = (n > 0) & (n < SHORT)
    follows = np.zeros(len(n), bool)
    follows[1:] = short[1:] & short[:-1] & (doc[1:] == doc[:-1])
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(n))))
    # a run's last line is followed by none of it
    tail = np.flatnonzero(follows & ~np.append(follows[1:], False))
    one = np.flatnonzero(n >= max(min_words, 1))
    if min_words > 1:
        tail = tail[stop[tail] - word[head[tail]] >= min_words]
    a, z = np.concatenate((one, head[tail])), np.concatenate((one, tail))
    base = b.points[b.starts]
    place = np.stack([line[a], line[z], line[head[a]], b.points[line_start[a]] - base[doc[a]], b.points[line_end[z]] - base[doc[z]]], 1)
    return doc[a], place, word[a], stop[z]


def unit_sets(b: Block, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the shingle sets of words ``first`` to ``end``, sizes and set ids."""
    windows = b.number.copy()
    for k in range(1, SIZE):
        windows[:-k] = scramble(windows[:-k] * _BASE + b.number[k:])
    words = end - first
    many = np.maximum(words - SIZE + 1, 1)
    tokens = windows[_spans(first, many)]
    start = np.cumsum(many) - many
    for n in range(1, SIZE):
        at = np.flatnonzero(words == n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = scramble(h * _BASE + b.number[first[at] + k])
        tokens[start[at]] = h
    for a, z in zip(start.tolist(), (start + many).tolist()):
        if z - a > 1:
            tokens[a:z].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[start] = True
    sizes = np.add.reduceat(new, start, dtype=np.int64)
    tokens = tokens[new]
    return tokens, sizes, np.add.reduceat(scramble(tokens), np.cumsum(sizes) - sizes).view(np.int64)


# --------------------------------------------------------------------- passages
def digests(number: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number of each string of ``size`` words."""
    n = len(number)
    power, back = np.full(n, _BASE), np.full(n, _INVERSE)
    power[0] = back[0] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(number * np.multiply.accumulate(power))))
    return scramble((total[size:] - total[:-size]) * np.multiply.accumulate(back)[:n - size + 1] + np.uint64(size))


def _first_least(order: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of ``width`` numbers, the place of the least one (the first of equal ones)."""
    at, reach = np.arange(len(order)), 1
    while reach < width:
        step = min(reach, width - reach)
        near, far = at[:-step], at[step:]
        at = np.where(order[far] < order[near], far, near)
        reach += step
    return at


def strings(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each string of ``WORDS`` words that lies in one text: its text, first word and place
    of its anchor; and all digests of ``ANCHOR`` words."""
    none = np.zeros(0, np.int64)
    if len(b.number) < WORDS:
        return none, none, none, np.zeros(0, np.uint64)
    doc = np.searchsorted(b.ends, b.first)
    marks = digests(b.number, ANCHOR)
    place = _first_least(digests(b.number, SIZE)[:len(marks)], WORDS - ANCHOR + 1)
    pos = np.flatnonzero(doc[:len(place)] == doc[WORDS - 1:])
    return doc[pos], pos, place[pos], marks


STRETCH = ("did long, row_key long, pos int, stretch long, digests array<long>, line int, start int, "
           "lines array<int>, lasts array<int>, starts array<int>, ends array<int>")


def stretches(b: Block, batch: pa.RecordBatch, known: np.ndarray, seen: set[int]) -> pa.RecordBatch | None:
    """The columns of ``STRETCH``: neighbouring strings of one anchor that is ``known``.
    ``stretch`` numbers what it reads, from its first string to its last; the digests of
    its strings come with the first of equal ones of a batch. Arrays hold, for each string,
    its lines and places (code points) counted from those of the first."""
    doc, pos, place, marks = strings(b)
    some = np.isin(marks[place], known)
    doc, pos, place = doc[some], pos[some], place[some]
    if not len(pos):
        return None
    lines = np.concatenate(([0], np.cumsum(b.data == 10)))
    digest = digests(b.number, WORDS)[pos]
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])) | np.concatenate(([True], doc[1:] != doc[:-1])))
    tail = np.append(head[1:], len(pos)) - 1
    size = tail - head + 1
    name = scramble(digest[head] * _BASE + digest[tail] + size.astype(np.uint64)).view(np.int64)
    new = np.zeros(len(head), bool)
    for k, x in enumerate(name.tolist()):
        if x not in seen:
            seen.add(x)
            new[k] = True
    a, z, text = b.first[pos], b.end[pos + WORDS - 1], b.starts[doc[head]]
    line, start = lines[a[head]], b.points[a[head]]
    bounds = pa.array(np.append(head, len(pos)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array((x - np.repeat(base, size)).astype(np.int32)))
             for x, base in ((lines[a], line), (lines[z], line), (b.points[a], start), (b.points[z], start))]
    marked = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(size[new]))).astype(np.int32)),
        pa.array(digest[np.repeat(new, size)].view(np.int64))).take(pa.array(np.cumsum(new) - 1, mask=~new))
    row = pa.array(b.low + doc[head])
    word = np.searchsorted(b.first, b.starts)[doc[head]]  # places count words of their text
    return pa.RecordBatch.from_arrays(
        [batch.column("did").take(row), batch.column("row_key").take(row), pa.array((pos[head] - word).astype(np.int32)),
         pa.array(name), marked, pa.array((line - lines[text]).astype(np.int32)), pa.array((start - b.points[text]).astype(np.int32)),
         *lists], [x.split()[0] for x in STRETCH.split(", ")])


# ------------------------------------------------------------------- the scans
BUCKETS, MARKS, PLACES = 0, 1, 2
SENT = "part int, kind int, values binary, owners binary"
FOUND = ("kind int, did long, row_key long, pid long, paragraph long, last long, run long, start long, end long, "
         "bucket long, size long, leader long, members long")


def _named(schema: str, n: int, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` with some columns; the others are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in names],
        [name for name, _ in names])


def first_scan(rows: DataFrame, paragraphs: bool, passages: bool, min_words: int, percent: int) -> DataFrame:
    """Rows of ``FOUND``. ``PLACES``: all paragraphs; ``BUCKETS``: buckets with two paragraphs or
    more, with size, leader and a number for all members; ``MARKS``: the anchors (``bucket``) that
    stand twice, with each row that has one."""
    bands, per_band = tuned_bands(percent)
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def packed(kind: int, values: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        part = ((values >> np.uint64(40)) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        values, owners = values[order], owners[order]
        count = np.bincount(part, minlength=n_parts)
        ends = np.cumsum(count)
        at = np.flatnonzero(count)
        return _named(SENT, len(at), part=at, kind=np.full(len(at), kind), values=[values[e - n:e].tobytes() for e, n in zip(ends[at], count[at])],
                      owners=[owners[e - n:e].tobytes() for e, n in zip(ends[at], count[at])])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            did, key = batch.column("did").to_numpy(), batch.column("row_key").to_numpy()
            lists: dict[int, list] = {BUCKETS: [], MARKS: [], PLACES: []}
            for b in blocks(batch.column("text")):
                if paragraphs and len(b.number):
                    doc, place, first, end = units(b, min_words)
                    if len(doc):
                        tokens, sizes, ids = unit_sets(b, first, end)
                        lists[PLACES].append((np.stack([did[b.low + doc], key[b.low + doc], ids]), place.T.astype(np.int32)))
                        one = np.sort(np.unique(ids, return_index=True)[1])
                        bucket, owner = buckets_of(tokens[_spans((np.cumsum(sizes) - sizes)[one], sizes[one])], sizes[one], bands, per_band, percent)
                        lists[BUCKETS].append((bucket, ids[one][owner]))
                if passages:
                    doc, _, place, marks = strings(b)
                    if len(doc):
                        new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
                        lists[MARKS].append((marks[place[new]], key[b.low + doc[new]]))
            for kind in (BUCKETS, MARKS):
                if lists[kind]:
                    values, owners = (np.concatenate(x) for x in zip(*lists[kind]))
                    if len(values):
                        yield packed(kind, values, owners)
            if lists[PLACES]:
                wide, narrow = (np.concatenate(x, 1) for x in zip(*lists[PLACES]))
                part = int(scramble(wide[2, :1].view(np.uint64))[0] % np.uint64(n_parts))
                yield _named(SENT, 1, part=[part], kind=[PLACES], values=[wide.tobytes()], owners=[narrow.tobytes()])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {BUCKETS: [], MARKS: []}
        for batch in batches:
            for kind, values, owners in zip(batch.column("kind").to_pylist(), batch.column("values"), batch.column("owners")):
                values, owners = np.frombuffer(values.as_buffer(), np.int64), owners.as_buffer()
                if kind != PLACES:
                    met[kind].append((values, np.frombuffer(owners, np.int64)))
                    continue
                n = len(values) // 3
                wide, narrow = values.reshape(3, n), np.frombuffer(owners, np.int32).reshape(5, n)
                for low in range(0, n, 20_000):
                    few = slice(low, low + 20_000)
                    yield _named(FOUND, len(wide[0, few]), kind=np.full(len(wide[0, few]), PLACES), did=wide[0, few], row_key=wide[1, few],
                                 pid=wide[2, few], **{c: x[few].astype(np.int64) for c, x in zip(PLACE, narrow)})
        for kind, several in met.items():
            if not several:
                continue
            value, owner = (np.concatenate(x) for x in zip(*several))
            several.clear()
            order = np.argsort(value)
            same = value[order[1:]] == value[order[:-1]]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            value, owner = value[order], owner[order]
            order = np.lexsort((owner, value))
            value, owner = value[order], owner[order]
            one = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])))[:len(value)]
            value, owner = value[one], owner[one]
            if not len(value):
                continue
            if kind == MARKS:
                columns = {"bucket": value, "row_key": owner}
            else:
                first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
                size = np.diff(np.append(first, len(value)))
                members = np.add.reduceat(scramble(owner.view(np.uint64)), first).view(np.int64)
                columns = {"bucket": value, "pid": owner, "size": np.repeat(size, size), "leader": np.repeat(owner[first], size),
                           "members": np.repeat(members, size)}
                columns = {c: x[np.repeat(size > 1, size)] for c, x in columns.items()}
            n = len(columns["bucket"])
            for low in range(0, n, 20_000):
                few = {c: x[low:low + 20_000] for c, x in columns.items()}
                yield _named(FOUND, len(few["bucket"]), kind=np.full(len(few["bucket"]), kind), **few)

    return rows.mapInArrow(send, SENT).repartition("part").mapInArrow(meet, FOUND)


def second_scan(rows: DataFrame, asked: DataFrame, min_words: int) -> DataFrame:
    """The wanted sets (``pid, tokens``) and ``STRETCH`` columns, from the texts that hold them."""
    schema = f"{STRETCH}, pid long, tokens binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            pids, marks = batch.column("pids"), batch.column("marks")
            for b in blocks(batch.column("text")):
                here = slice(b.low, b.low + len(b.starts))
                wanted = np.asarray(pids[here].flatten())
                if len(wanted):
                    doc, _, first, end = units(b, min_words)
                    some = np.asarray(pids[here].value_lengths()) > 0
                    first, end = first[some[doc]], end[some[doc]]
                    tokens, sizes, ids = unit_sets(b, first, end)
                    at = np.unique(ids, return_index=True)[1]
                    at = at[np.isin(ids[at], wanted)]
                    start = np.cumsum(sizes) - sizes
                    yield _named(schema, len(at), pid=ids[at], tokens=[tokens[a:a + n].tobytes() for a, n in zip(start[at], sizes[at])])
                known = np.asarray(marks[here].flatten())
                if len(known):
                    found = stretches(b, batch, known.view(np.uint64), seen)
                    if found is not None:
                        yield _named(schema, len(found), **dict(zip(found.schema.names, found.columns)))

    return rows.join(asked, "row_key").select("did", "row_key", "text", "pids", "marks").mapInArrow(cut, schema)


class Repeats(NamedTuple):
    places: DataFrame  #: all paragraphs: ``did, row_key, pid`` and ``PLACE``
    members: DataFrame  #: ``bucket, pid, size, leader`` of buckets with several paragraphs
    sets: DataFrame  #: ``pid, tokens`` of those, once each
    stretches: DataFrame  #: ``STRETCH`` of strings whose anchor stands twice


def repeats(docs: DataFrame, paragraphs: bool = True, passages: bool = True, percent: int = PERCENT, min_words: int = MIN_WORDS) -> Repeats:
    """What may be repeated in the texts of ``docs``; see ``repeated_paragraphs`` and ``repeated_passages``."""
    rows = keyed(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "row_key", "text")
    found = landed(first_scan(rows, paragraphs, passages, min_words, percent), "found", release=True)
    places = found.where(F.col("kind") == PLACES).select("did", "row_key", "pid", *PLACE)
    shared = found.where(F.col("kind") == BUCKETS).select("bucket", "pid", "size", "leader", "members")
    # each set of members once
    one = shared.groupBy("size", "leader", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = landed(shared.drop("members").join(one, "bucket"), "buckets", release=True)
    # a set is read from one of its documents
    pids = (places.join(members.select("pid").distinct(), "pid").groupBy("pid").agg(F.min("row_key").alias("row_key"))
            .select("row_key", "pid", F.lit(None).cast("long").alias("mark")))
    marks = found.where(F.col("kind") == MARKS).select("row_key", F.lit(None).cast("long").alias("pid"), F.col("bucket").alias("mark"))
    asked = pids.union(marks).groupBy("row_key").agg(F.collect_set("pid").alias("pids"), F.collect_set("mark").alias("marks"))
    cut = landed(second_scan(rows, asked, min_words), "cut", release=True)
    sets = cut.where("pid IS NOT NULL").select("pid", "tokens").dropDuplicates(["pid"])
    return Repeats(places, members, sets, cut.where("pid IS NULL").drop("pid", "tokens"))
