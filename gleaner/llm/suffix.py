"""Exact substring dedup by bucket-pointer refinement over sampled suffixes.

Removes every byte that lies in a ``WIDTH``-byte string which also starts
earlier (smaller ``doc_id``, or the same document and an earlier start).

*Buckets.* Every offset gets the identifier of its ``Q``-gram bucket. A
``WIDTH``-byte string holds ``WIDTH - Q + 1`` buckets; the least of them (ties:
the leftmost) is its anchor. Equal strings have equal anchors at equal places,
so suffixes need comparing within an anchor's bucket only, and neighbouring
strings with one anchor travel as one *stretch*: 3 % of the offsets.

*Refinement.* The identifier of the ``2Q``-byte bucket of an offset combines
those of its ``Q``-gram bucket and of the one ``Q`` later; the same step on the
updated identifiers reaches depth ``WIDTH``. Identifiers are 64-bit digests, not
ranks, so that all tasks agree on them without a global sort. Each anchor's
bucket is then sorted on the refined identifiers. Buckets with one member are
final and leave. Stretches that agree to full depth form one bucket, whose least
member is its first occurrence; where an anchor's bucket holds different
stretches, the strings of one stretch of each kind are sorted in turn.

*Scale.* Texts cross one exchange, at the end; until then 32 bytes per stretch
move. An anchor that holds a large share of all stretches is dealt out by
document: each share keeps its first occurrences, which a second aggregate
merges, and its strings are compared by a map-side combined aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, landed

WIDTH = 100  # fixed by the query contract
Q = 32
STRINGS = WIDTH - Q + 1  # a string's anchor is one of so many buckets
#: Bytes handled at once; 24 bits of a key hold an offset in them.
CHUNK = 1 << 18
LONGEST = 1 << 22
#: Documents (one in so many) in which anchors are counted, only to tell which to deal out.
HOT_SAMPLE = 64
#: An anchor with more than this share of the sampled stretches is dealt out in SHARES.
HOT_SHARE, SHARES = 1 / 2000, 64
#: Different stretches of one anchor that one task may sort.
MOST_KINDS = 20_000
NO_ID = -(1 << 63)  # orders rows without doc_id before all others

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xD1342543DE82EF95))
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)  # an arbitrary number for each byte


def _scramble(x: np.ndarray) -> np.ndarray:
    """In place: spread every bit over the whole word."""
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets ``a`` refined by the identifiers ``b``."""
    x = a * _C
    x += b
    return _scramble(x)


def identifiers(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers at depth ``Q`` of all offsets that have so many bytes."""
    b, depth = _BYTE[data], 1
    while depth < Q:
        longer = b[:-depth] * (_C + np.uint64(2 * depth))
        longer += b[depth:]
        b, depth = longer, 2 * depth
    return _scramble(b)


def refined(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers at depth ``WIDTH`` of the offsets ``at``."""
    two = _joined(b[at], b[at + Q])
    return _joined(two, _joined(b[at + 2 * Q], b[at + WIDTH - Q]))


def _segments(starts: np.ndarray, ends: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Texts as ``(number, from, to)`` in lists of about CHUNK bytes. A text over
    LONGEST comes in parts that share ``WIDTH - 1`` bytes, so no string is lost."""
    group, size = [], 0
    for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())):
        while z - a >= WIDTH:
            cut = min(z, a + LONGEST)
            group.append((i, a, cut))
            size += cut - a
            a = z if cut == z else cut - WIDTH + 1
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of the texts ``data[starts[i]:ends[i]]``, in arrays: the text's
    number, first string's offset in the text, number of strings, bytes from
    there to the anchor, the anchor's identifier, and an identifier of the whole
    stretch with its place around the anchor."""
    for group in _segments(starts, ends):
        part = np.concatenate([data[a:z] for _, a, z in group])
        lows = np.cumsum([0, *(z - a for _, a, z in group[:-1])])
        sizes = np.array([z - a for _, a, z in group])
        b = identifiers(part)
        least = b & np.uint64(0xFFFFFFFFFF000000)
        least |= np.arange(len(b), dtype=np.uint64)
        span = 1
        while 2 * span <= STRINGS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < STRINGS:
            least = np.minimum(least[:span - STRINGS], least[STRINGS - span:])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        # a stretch begins where the anchor changes, or a text or its last string ends
        new = np.empty(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=new[1:-1])
        new[0] = new[-1] = True
        new[lows] = True
        new[lows + sizes - WIDTH + 1] = True
        first = np.flatnonzero(new)
        count, first = np.diff(first), first[:-1]
        text = np.searchsorted(lows, first, "right") - 1
        keep = first - lows[text] <= sizes[text] - WIDTH
        first, count, text = first[keep], count[keep], text[keep]
        place = at[first]
        shape = _joined(_joined(refined(b, first), refined(b, first + count - 1)),
                        ((place - first) * 128 + count).astype(np.uint64))
        number = np.array([i for i, _, _ in group])[text]
        base = np.array([a for _, a, _ in group])[text] - starts[number]
        yield number, first - lows[text] + base, count, place - first, b[place], shape


def _texts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without nulls, and where each text lies."""
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


# ``at`` of a stretch: 32 bits first offset, 7 strings, 7 bytes to the anchor
def _pack(start, count, lead):
    return start | count << 32 | lead << 39


def _unpack(at):
    return at & 0xFFFFFFFF, at >> 32 & 0x7F, at >> 39 & 0x7F


#: ``did`` orders documents; ``rid`` tells rows apart that share it.
STRETCH = "anchor long, shape long, did long, rid long, at long"


def find_stretches(rows: DataFrame, hot: frozenset = frozenset()) -> DataFrame:
    """Stretches of all texts, with the ``key`` that they are dealt by."""
    hot_ids = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            did, rid = batch.column("did").to_numpy(), batch.column("rid").to_numpy()
            for number, start, count, lead, anchor, shape in stretches(*_texts(batch.column("text"))):
                anchor = anchor.view(np.int64)
                key = anchor
                if len(hot_ids):
                    near = np.searchsorted(hot_ids, anchor).clip(max=len(hot_ids) - 1)
                    key = np.where(hot_ids[near] == anchor, anchor + 1 + rid[number] % SHARES, anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key, anchor, shape.view(np.int64), did[number], rid[number],
                                           _pack(start, count, lead))],
                    ["key", "anchor", "shape", "did", "rid", "at"])

    return rows.select("did", "rid", "text").mapInArrow(run, "key long, " + STRETCH)


def hot_anchors(rows: DataFrame) -> frozenset:
    """Anchors with a large share of all stretches, estimated on every 64th
    document. At most ``1 / HOT_SHARE`` of them exist. It decides who sorts what,
    never what is found."""
    some = find_stretches(rows.where(F.pmod("rid", F.lit(HOT_SAMPLE)) == 0)).groupBy("anchor").count()
    total = some.agg(F.sum("count")).first()[0] or 0
    least = max(200, int(total * HOT_SHARE))
    return frozenset(r[0] for r in some.where(F.col("count") > least).select("anchor").collect())


SINGLE, REPEATED, KIND, SHARE = 0, 1, 2, 3


def sort_buckets(found: DataFrame, hot: frozenset) -> DataFrame:
    """Sort each anchor's bucket on the refined identifiers. Leaves the stretches
    that are ``REPEATED`` as a whole, those that are the first of their ``KIND``
    where the anchor has more than one, and first ones of a ``SHARE`` of a hot anchor."""
    hot_ids = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        anchor, shape, did, rid, at = (table.column(c).to_numpy() for c in ("anchor", "shape", "did", "rid", "at"))
        # most anchors have one stretch: leave them out before the full sort
        order = np.argsort(anchor)
        a = anchor[order]
        same = a[1:] == a[:-1]
        several = np.zeros(len(a), bool)
        several[1:] |= same
        several[:-1] |= same
        at_hot = np.isin(anchor, hot_ids) if len(hot_ids) else np.zeros(len(anchor), bool)
        rows = order[several | at_hot[order]]
        if not len(rows):
            return
        anchor, shape, did, rid, at, at_hot = (x[rows] for x in (anchor, shape, did, rid, at, at_hot))
        start = at & 0xFFFFFFFF
        order = np.lexsort((start, did, shape, anchor))
        anchor, shape, did, rid, at, at_hot, start = (x[order] for x in (anchor, shape, did, rid, at, at_hot, start))
        bucket = np.append(True, anchor[1:] != anchor[:-1])
        kind = bucket | np.append(True, shape[1:] != shape[:-1])
        lead = np.flatnonzero(kind)[np.cumsum(kind) - 1]
        repeated = (did != did[lead]) | (start != start[lead])
        kinds = np.add.reduceat(kind, np.flatnonzero(bucket))[np.cumsum(bucket) - 1]
        code = np.where(repeated, REPEATED, np.where(at_hot, SHARE, np.where(kinds > 1, KIND, SINGLE)))
        keep = code != SINGLE
        for i in range(0, len(code), 200_000):
            k = np.flatnonzero(keep[i:i + 200_000]) + i
            if len(k):
                whole = code[k] == REPEATED
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[k].astype(np.int32)), pa.array(np.where(whole, 0, anchor[k])),
                     pa.array(np.where(code[k] == SHARE, shape[k], 0)), pa.array(did[k]), pa.array(rid[k]), pa.array(at[k])],
                    ["code", "anchor", "shape", "did", "rid", "at"])

    return found.repartition("key").mapInArrow(run, "code int, " + STRETCH)


def merge_shares(coded: DataFrame) -> DataFrame:
    """Give the first stretches of the shares of hot anchors their final codes."""
    shares = coded.where(F.col("code") == SHARE).withColumn("start", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)))
    firsts = shares.groupBy("anchor", "shape").agg(F.min(F.struct("did", "start")).alias("first"))
    kinds = firsts.groupBy("anchor").agg(F.count("*").alias("kinds"))
    merged = (shares.join(firsts, ["anchor", "shape"]).join(kinds, "anchor")
              .withColumn("code", F.when(F.struct("did", "start") > F.col("first"), REPEATED)
                          .when(F.col("kinds") > 1, KIND).otherwise(SINGLE)))
    cols = ["code", "anchor", "did", "rid", "at"]
    return coded.where(F.col("code") != SHARE).select(cols).union(merged.select(cols))


def cut_strings(rows: DataFrame, kinds: DataFrame, one_by_one: bool) -> DataFrame:
    """The bytes of each stretch of ``kinds``, or, ``one_by_one``, the identifiers
    of its strings."""
    wanted = kinds.groupBy("did", "rid").agg(F.collect_list(F.struct("anchor", "at")).alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, starts, _ = _texts(batch.column("text"))
            lists = batch.column("kinds")
            item = lists.flatten()
            doc = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            anchor, at = item.field("anchor").to_numpy(), item.field("at").to_numpy()
            did, rid = batch.column("did").to_numpy()[doc], batch.column("rid").to_numpy()[doc]
            start, count, _ = _unpack(at)
            low = starts[doc] + start
            if one_by_one:
                for i in range(0, len(at), 2000):
                    k = np.repeat(np.arange(i, min(i + 2000, len(at))), count[i:i + 2000])
                    step = np.arange(len(k)) - np.repeat(np.cumsum(count[i:i + 2000]) - count[i:i + 2000],
                                                         count[i:i + 2000])
                    ids = np.concatenate([refined(identifiers(data[low[j]:low[j] + count[j] + WIDTH - 1]),
                                                  np.arange(count[j])) for j in range(i, min(i + 2000, len(at)))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[k]), pa.array(ids.view(np.int64)), pa.array(did[k]),
                         pa.array(start[k] + step), pa.array(rid[k])],
                        ["anchor", "string", "did", "start", "rid"])
            else:
                cut = [data[a:a + n + WIDTH - 1].tobytes() for a, n in zip(low.tolist(), count.tolist())]
                for i in range(0, len(cut), 20_000):
                    s = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[s]), pa.array(did[s]), pa.array(rid[s]), pa.array(at[s]), pa.array(cut[s], pa.binary())],
                        ["anchor", "did", "rid", "at", "cut"])

    out = ("anchor long, string long, did long, start long, rid long" if one_by_one
           else "anchor long, did long, rid long, at long, cut binary")
    return rows.join(wanted, ["did", "rid"]).select("did", "rid", "text", "kinds").mapInArrow(run, out)


def sort_strings(cuts: DataFrame) -> DataFrame:
    """Sort the strings of an anchor's stretches; runs of strings that occur
    earlier are byte ranges to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        anchor, did, rid, at = (table.column(c).to_numpy() for c in ("anchor", "did", "rid", "at"))
        start, count, _ = _unpack(at)
        ids = np.empty(int(count.sum()), np.int64)
        done = 0
        for chunk in table.column("cut").chunks:  # identifiers of all strings, batch by batch
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].astype(np.int64)
            data = np.frombuffer(chunk.buffers()[2], np.uint8)
            for i in range(0, len(chunk), 2000):
                o = offsets[i:i + 2001]
                n = np.diff(o) - WIDTH + 1
                b = identifiers(data[o[0]:o[-1]])
                places = np.arange(n.sum()) + np.repeat(o[:-1] - o[0] - np.cumsum(n) + n, n)
                ids[done:done + len(places)] = refined(b, places).view(np.int64)
                done += len(places)
        row = np.repeat(np.arange(len(at)), count)
        step = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        whose, where = anchor[row], start[row] + step
        order = np.lexsort((ids, whose))
        same = (ids[order[1:]] == ids[order[:-1]]) & (whose[order[1:]] == whose[order[:-1]])
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]
        order = order[np.lexsort((where[order], did[row[order]], ids[order], whose[order]))]
        if not len(order):
            return
        d, w = did[row[order]], where[order]
        new = np.append(True, (ids[order[1:]] != ids[order[:-1]]) | (whose[order[1:]] != whose[order[:-1]]))
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.sort(order[(d != d[lead]) | (w != w[lead])])  # back in stretch order: neighbours form runs
        if not len(again):
            return
        run_start = np.append(True, (np.diff(again) != 1) | (row[again[1:]] != row[again[:-1]]))
        first = again[run_start]
        length = np.diff(np.append(np.flatnonzero(run_start), len(again)))
        r = row[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(did[r]), pa.array(rid[r]), pa.array(where[first]), pa.array(length + WIDTH - 1)],
            ["did", "rid", "start", "length"])

    return cuts.repartition("anchor").mapInArrow(run, "did long, rid long, start long, length long")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``did, rid, start, length`` of byte ranges made of strings that start
    earlier too. Ranges may overlap."""
    hot = hot_anchors(rows)
    coded = merge_shares(landed(sort_buckets(find_stretches(rows, hot), hot), "buckets"))
    whole = (coded.where(F.col("code") == REPEATED)
             .select("did", "rid", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"),
                     F.expr(f"(shiftright(at, 32) & 127) + {WIDTH - 1}").alias("length")))
    kinds = coded.where(F.col("code") == KIND).select("anchor", "did", "rid", "at")
    if not hot:
        return whole.union(sort_strings(cut_strings(rows, kinds, False)))
    many = kinds.groupBy("anchor").count().where(F.col("count") > MOST_KINDS).select("anchor")
    few = sort_strings(cut_strings(rows, kinds.join(many, "anchor", "left_anti"), False))
    strings = cut_strings(rows, kinds.join(many, "anchor", "left_semi"), True)
    firsts = strings.groupBy("anchor", "string").agg(F.min(F.struct("did", "start")).alias("first"),
                                                     F.count("*").alias("n")).where("n > 1")
    later = (strings.join(firsts, ["anchor", "string"]).where(F.struct("did", "start") > F.col("first"))
             .select("did", "rid", "start", F.lit(WIDTH).cast("long").alias("length")))
    return whole.union(few).union(later)


OUT = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def dedup_substrings(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row, n_bytes, spans, kept`` of each row of ``docs``: a struct of its columns
    ``carry``, the removed byte ranges (maximal, in order) and the bytes left.

    A null text is empty; a null ``doc_id`` counts as smaller than all others.
    Rows equal in ``doc_id`` and text are one document at one place: neither
    removes from the other. Texts under ``WIDTH`` bytes stay whole. Other columns
    are not read; an empty table gives an empty one.
    """
    rows = keyed(docs, carry).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"),
                                     F.col("row_key").alias("rid"), "text", "row")
    ranges = repeated_ranges(rows).groupBy("did", "rid").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            data, starts, ends = _texts(batch.column("text"))
            sizes, spans, kept = [], [], []
            for i, found in enumerate(batch.column("ranges")):
                text = data[starts[i]:ends[i]]
                cover = np.zeros(len(text) + 1, np.int32)
                if found.is_valid and len(found):
                    a = found.values.field("start").to_numpy()
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + found.values.field("length").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                sizes.append(len(text))
                spans.append([{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sizes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, {OUT}"
    return rows.join(ranges, ["did", "rid"], "left").select("row", "text", "ranges").mapInArrow(run, schema)
