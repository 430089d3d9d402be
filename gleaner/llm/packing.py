"""Packing documents into token sequences by bin completion.

Only the *histogram* of piece lengths matters for a packing, and it has at most
``CAPACITY`` entries whatever the number of documents. So Spark counts lengths,
one bounded search finds patterns ("so many sequences of these lengths"), and
Spark gives every piece its place by its number among pieces of its length.

The search fills one sequence around the largest remaining length at a time. It
enumerates undominated fillings of the rest (none takes another piece, larger
lengths first), prunes those whose waste cannot beat the best, and uses the best
filling as often as the counts allow. Best-fit decreasing gives the incumbent;
the search backtracks to other fillings while it is above the waste bound.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import CHAR_OF
from .common import keyed, landed

CAPACITY, END_ID = 4096, 1  # fixed by the query contract
#: Fillings looked at per sequence pattern, and searches with other choices.
NODES, DIVES = 4000, 4
#: Shares that the pieces of one length are numbered in.
SHARES = 256
CACHE_WORDS = 600_000
CACHED_LENGTH = 64
# The split pattern of the vocabulary, written out for common
# characters. A text with others, or with a special token, goes to the library whole.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼-¾", "\\t\\n\\v\\f\\r "
PATTERN = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
RARE = re.compile("[^\\t\\n\\v\\f\\r\\x20-\\x7e¡-įı-ſ‐-‧‰-⁞€]|<\\|")


class Words(dict):
    """Ids of words, filled in by the vocabulary's merges as words are asked for."""

    def __init__(self, library: Tokenizer):
        self.merges = library.model
        self.packed = [i.to_bytes(4, "little") for i in range(library.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        marks = word if word.isascii() else "".join([CHAR_OF[b] for b in word.encode()])
        ids = b"".join([self.packed[t.id] for t in self.merges.tokenize(marks)])
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids


class WordEncoder:
    """Token ids of texts, with a cache of words in front of the library. Words of
    common characters need only its merges: they are lowered, normal and split already."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Words(self.library)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        ids_of = self.words.__getitem__
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if RARE.search(t)
                else b"".join(map(ids_of, PATTERN.findall(t.lower()))) for t in texts]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, capacity: int = CAPACITY,
                 end_id: int = END_ID) -> DataFrame:
    """``doc_id, row_key, piece, start, length, ids_crc32`` (and ``ids``) of each
    document's ids followed by ``end_id``, cut every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                cols: list[list] = [[] for _ in range(7)]
                for doc, key, ids in zip(part.column("doc_id").to_pylist(), part.column("row_key").to_pylist(),
                                         encoder.encode(part.column("text").to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        for col, x in zip(cols, (doc, key, piece, at // 4, len(cut) // 4, zlib.crc32(cut),
                                                 cut if with_ids else None)):
                            col.append(x)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids"]
    out = keyed(docs).mapInArrow(
        run, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


class Lengths:
    """Counts per length, with the lengths still in stock in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def at_most(self, room: int) -> int:
        """Index of the largest length in stock that fits, or -1."""
        return bisect.bisect_right(self.sizes, room) - 1


def fillings(stock: Lengths, room: int, nodes: int = NODES) -> Iterator[tuple[int, dict[int, int]]]:
    """Undominated fillings of ``room``, each with less waste than the one before.

    Larger lengths are tried first and as often as they fit, so a filling that
    swaps a piece for smaller ones comes later and must waste less to count."""
    best, left = room + 1, nodes
    path: list[tuple[int, int]] = []
    sizes, counts = stock.sizes, stock.counts

    def search(i: int, room: int) -> Iterator[tuple[int, dict[int, int]]]:
        nonlocal best, left
        left -= 1
        i = min(i, bisect.bisect_right(sizes, room) - 1)
        if i < 0 or room < sizes[0]:
            if room < best:
                best = room
                yield room, dict(path)
            return
        while i >= 0 and left > 0 and best > 0:
            size = sizes[i]
            for k in range(min(counts[size], room // size), 0, -1):
                path.append((size, k))
                yield from search(i - 1, room - k * size)
                path.pop()
                if left <= 0 or best == 0:
                    return
            i -= 1
            # without this length the room must be filled by smaller ones: stop if all of them cannot
            if i >= 0 and room - sum(s * min(counts[s], room // s) for s in sizes[max(0, i - 7):i + 1]) >= best and i < 8:
                return

    yield from search(len(sizes) - 1, room)


def bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences."""
    total = -(-sum(s * n for s, n in counts.items()) // capacity)
    return max(total, sum(n for s, n in counts.items() if 2 * s > capacity))


Pattern = tuple[int, dict[int, int]]  # how many sequences, and the pieces of each by length


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on the histogram: the incumbent of the search."""
    rooms: dict[int, list[list]] = {}  # room -> [number of sequences, their pieces]
    order: list[int] = []
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                per = min(capacity // size, n)
                m, used = n // per, {size: per}
                room = capacity - per * size
                n -= m * per
            else:
                room = order[at]
                m, old = rooms[room][-1]
                per = min(room // size, n)
                use = min(m, n // per)
                rooms[room][-1][0] -= use
                if not rooms[room][-1][0]:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        del order[at]
                m, used, n = use, old | {size: per}, n - use * per
                room -= per * size
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([m, used])
    return [(m, used) for groups in rooms.values() for m, used in groups]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold all pieces of ``counts`` in as few sequences as found."""
    incumbent = best_fit(counts, capacity)
    fewest, least = sum(m for m, _ in incumbent), bound(counts, capacity)
    for dive in range(DIVES):
        if fewest <= least:
            break
        stock, patterns, used, waste = Lengths(counts), [], 0, 0
        allowed = (fewest - 1) * capacity - sum(s * n for s, n in counts.items())
        while stock.sizes:
            size = stock.sizes[-1]
            stock.take(size, 1)
            found = list(fillings(stock, capacity - size, NODES << dive))
            # later dives leave the best filling for the next best where it wastes no more than allowed
            rest, fill = found[-1]
            if dive and len(found) > 1 and len(patterns) % (dive + 1) == 0 and waste + found[-2][0] <= allowed:
                rest, fill = found[-2]
            fill = fill | {size: fill.get(size, 0) + 1}
            times = min((stock.counts.get(s, 0) + (s == size)) // k for s, k in fill.items())
            if rest and waste + times * rest > allowed:  # one at a time near the bound
                times = 1
            for s, k in fill.items():
                if n := times * k - (s == size):
                    stock.take(s, n)
            patterns.append((times, fill))
            used, waste = used + times, waste + times * rest
            if used + bound(stock.counts, capacity) >= fewest:
                break
        else:
            incumbent, fewest = patterns, used
    return incumbent


def _slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where pieces go: per length and range of numbers, the first sequence,
    pieces of this length in each sequence, and the first offset."""
    rows, cursor, base = [], {}, 0
    for times, fill in patterns:
        offset = 0
        for size, k in sorted(fill.items(), reverse=True):
            rows.append((size, cursor.get(size, 0), k, base, offset))
            cursor[size] = cursor.get(size, 0) + times * k
            offset += size * k
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "sequence", "offset"), table.T.copy()))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id, row_key, piece, length``) and two more columns:
    ``sequence_id`` and ``offset``. Every piece is placed; sequences are gapless."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    slots = spark.sparkContext.broadcast(_slots(complete_bins(counts, capacity)))
    # number the pieces of a length in shares, so that a common length is no single task
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(SHARES)))
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = sizes.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share"))
                                              - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "share").orderBy("doc_id", "row_key", "piece")
    numbered = (dealt.withColumn("number", F.row_number().over(order).cast("long"))
                .join(before, ["length", "share"]).withColumn("number", F.col("number") - 1 + F.col("before")))

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        key = s["length"] << 48 | s["first"]
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(key, length << 48 | number, "right") - 1
            nth = number - s["first"][at]
            arrays = {n: batch.column(n) for n in columns}
            arrays["sequence_id"] = pa.array(s["sequence"][at] + nth // s["per"][at])
            arrays["offset"] = pa.array(s["offset"][at] + nth % s["per"][at] * length)
            yield pa.RecordBatch.from_pydict(arrays)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return numbered.select(*columns, "number").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, row_key, piece, start, length, ids_crc32, sequence_id, offset`` of
    all documents. A null text is empty and takes one place for ``end_id``; equal
    rows are packed each; other columns are not read; an empty table packs nothing."""
    return pack(landed(token_pieces(docs, tokenizer_path, False, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (packed 32-bit ids).
    A group holds one sequence, so at most ``capacity`` ids."""
    ids = token_pieces(docs, tokenizer_path, True, capacity, end_id).dropDuplicates(["doc_id", "row_key", "piece"])
    key = F.xxhash64("doc_id", "row_key", "piece")
    found = packed.withColumn("key", key).join(ids.select(key.alias("key"), "ids"), "key")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["ids"])), "")).alias("ids"))
