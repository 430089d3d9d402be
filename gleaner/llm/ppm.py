"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts over the lower-cased token stream (words,
one space between them, an end mark), pretrained on the training documents. A
symbol that the longest context has seen costs its share there; otherwise the
model pays that context's escape and goes on with the next shorter one, without
the symbols that the longer context has just ruled out (symbol exclusion).
Escapes are estimated as by method D: each new symbol moved half a count.

A trie level is a table: counts of a context with its symbol. As all levels
follow from the longest one, Spark counts only strings of ORDER + 1 bytes, over
all documents, and gets each distinct string's log probability by joins; a
document's score is then the sum over its strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, landed
from .shingles import word_numbers

ORDER = 5
END = 10  # byte of the end mark, which also stands before a text
#: Scored strings are sent to all tasks up to this many (16 bytes each), the most
#: frequent ones first; documents meet the others by a join, with the same result.
MAX_BROADCAST = 4_000_000
#: Tokens with at least this share of all training tokens are sent to all tasks,
#: so at most so many; the rest are joined.
HEAVY_SHARE = 1 / (1 << 20)
PART = 1 << 20
FLUSH = 3_000_000
TOKEN, STRING = 0, 1


def _streams(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Token streams of some texts in one array, the offsets of their symbols, and
    the number of symbols of each text; ``order`` end marks stand before each."""
    pad = bytes([END]) * order
    low = 0
    while low < len(texts):
        parts, lengths, size = [], [], 0
        while low < len(texts) and size < PART:
            stream = b" ".join(texts[low].encode().lower().split()) + bytes([END])
            parts += [pad, stream]
            lengths.append(len(stream))
            size += len(stream)
            low += 1
        n = np.array(lengths)
        at = np.arange(n.sum()) + np.repeat((np.arange(len(n)) + 1) * order, n)
        yield np.frombuffer(b"".join(parts), np.uint8), at, lengths


def _strings(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Each symbol with its context, the symbol in the lowest byte."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    for k in range(1, order + 1):
        out[k:] |= wide[:-k] << np.uint64(8 * k)
    return out[at].view(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def gather(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``kind, key, n``: training counts of all tokens (by 64-bit number), and of
    all strings. Strings of held-out documents only are there with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {TOKEN: ([], []), STRING: ([], [])}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, (keys, counts) in held.items():
                key, n = _summed(keys, counts)
                for i in range(0, len(key), 500_000):
                    k = key[i:i + 500_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k),
                                                      pa.array(n[i:i + 500_000])], ["kind", "key", "n"])
                keys.clear()
                counts.clear()

        def add(kind: int, values: np.ndarray, counted: bool):
            key, n = np.unique(values, return_counts=True)
            held[kind][0].append(key)
            held[kind][1].append(n if counted else np.zeros(len(n), np.int64))
            return len(key)

        for batch in batches:
            out = np.array(batch.column("held_out").to_pylist(), bool)
            texts = batch.column("text").to_pylist()
            for train in (True, False):
                for data, at, _ in _streams([t for t, h in zip(texts, out) if h != train], order):
                    waiting += add(STRING, _strings(data, at, order), train)
                    if train:
                        waiting += add(TOKEN, word_numbers(data)[2].view(np.int64), True)
            if waiting > FLUSH:
                for kind, (keys, counts) in held.items():
                    key, n = _summed(keys, counts)
                    held[kind] = ([key], [n])
                waiting = sum(len(keys[0]) for keys, _ in held.values() if keys)
                if waiting > FLUSH // 2:
                    yield from flush()
                    waiting = 0
        yield from flush()

    found = rows.select("held_out", "text").mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score_strings(strings: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, n, lp``: log10 probability of the last byte of each string after the
    bytes before it. ``strings`` has ``key, n`` with n = 0 for unseen ones."""

    def tail(level: int):
        return F.col("key").bitwiseAND(F.lit((1 << 8 * (level + 1)) - 1))

    # levels are landed, longest first: each is read several times, and the driver
    # holds a plan of one level's size
    symbols = [None] * (order + 1)
    symbols[order] = strings.where("n > 0").select(F.col("key").alias("sym"), F.col("n").alias("c"))
    for j in range(order - 1, -1, -1):
        low = F.col("sym").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        symbols[j] = landed(symbols[j + 1].groupBy(low.alias("sym")).agg(F.sum("c").alias("c")), "level", release=True)
    contexts = []
    for j in range(order + 1):
        own = symbols[j]
        if j:  # what the symbols of this context have in the next shorter one
            low = symbols[j - 1].select(F.col("sym").alias("low"), F.col("c").alias("e"))
            own = own.withColumn("low", F.col("sym").bitwiseAND(F.lit((1 << 8 * j) - 1))).join(low, "low")
        else:
            own = own.withColumn("e", F.lit(0).cast("long"))
        contexts.append(landed(own.groupBy(F.shiftright("sym", 8).alias("ctx")).agg(
            F.sum("c").alias("all"), F.count("*").alias("kinds"), F.sum("e").alias("e")), "contexts", release=True))
    top = contexts[order].select("ctx", "all")
    seen = (strings.where("n > 0").withColumn("ctx", F.shiftright("key", 8)).join(top, "ctx")
            .select("key", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("all"))).alias("lp")))
    zero = F.lit(0).cast("long")
    rest = strings.where("n = 0").select("key", F.lit(0.0).alias("lp"), F.lit(False).alias("done"),
                                         zero.alias("out_n"), zero.alias("out_kinds"))
    for j in range(order, -1, -1):
        rest = (rest.withColumns({"sym": tail(j), "ctx": F.shiftright(tail(j), 8)})
                .join(contexts[j], "ctx", "left").join(symbols[j], "sym", "left"))
        n, kinds = F.coalesce("all", zero) - F.col("out_n"), F.coalesce("kinds", zero) - F.col("out_kinds")
        hit = ~F.col("done") & F.col("c").isNotNull()
        lp = F.when(hit, F.log10((2 * F.col("c") - 1) / (2 * n))).when(~F.col("done") & (n > 0), F.log10(kinds / (2 * n)))
        rest = rest.select("key", (F.col("lp") + F.coalesce(lp, F.lit(0.0))).alias("lp"), (F.col("done") | hit).alias("done"),
                           F.coalesce("e", zero).alias("out_n"), F.coalesce("kinds", zero).alias("out_kinds"))
    never = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.greatest(F.lit(1), 256 - F.col("out_kinds"))))
    return seen.union(rest.select("key", zero.alias("n"), F.col("lp") + never))


def _rank(n):
    """Grows with the count ``n``; at most a few hundred values, one each up to 8."""
    return F.when(n > 0, F.floor(8 * F.log2(n))).otherwise(-1).cast("int")


def least_sent(scored: DataFrame, most: int) -> int | None:
    """The least ``_rank`` of the strings that are sent, so that at most ``most`` are; None: all are."""
    counts = scored.groupBy(_rank(F.col("n")).alias("rank")).agg(F.count("*").alias("strings")).collect()
    if sum(r.strings for r in counts) <= most:
        return None
    least = max(r.rank for r in counts) + 1
    for r in sorted(counts, key=lambda r: -r.rank):
        most -= r.strings
        if most < 0:
            break
        least = r.rank
    return least


def score_documents(docs: DataFrame, held_out, order: int = ORDER, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of
    each row; the model learns from rows where the column ``held_out`` is not true.

    A null text is empty and has one token, the end. Equal rows count each and
    have equal scores. With no training rows every count is 0. An empty table
    gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    rows = keyed(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    stats = landed(gather(rows, order), "counts", release=True)
    tokens = stats.where(F.col("kind") == TOKEN).select(F.col("key").alias("token"), F.col("n").alias("c"))
    ends = rows.where(~F.col("held_out")).count()
    total, kinds = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    base_of = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    heavy = tokens.where(F.col("c") >= max(2, math.ceil(total * HEAVY_SHARE))).toArrow()
    scored = landed(score_strings(stats.where(F.col("kind") == STRING).select("key", "n"), order), "strings", release=True)
    least = least_sent(scored, max_broadcast)
    small = least is None
    table = (scored if small else scored.where(_rank(F.col("n")) >= least)).select("key", "lp").toArrow()
    sent = spark.sparkContext.broadcast((
        heavy["token"].to_numpy(), heavy["c"].to_numpy(), table["key"].to_numpy(), table["lp"].to_numpy()))
    del heavy, table
    pa.default_memory_pool().release_unused()
    end_base, end_known = base_of(ends), int(ends > 0)
    scale = total + 0.5 * (kinds + 1)
    names = ["kind", "row", "doc_id", "held_out", "key", "n", "known", "base", "lp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_key, heavy_c, key, lp = sent.value
        heavy_at, at_of = pd.Index(heavy_key), pd.Index(key)
        heavy_base = np.log10((heavy_c + 0.5) / scale)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, outs = batch.column("doc_id"), batch.column("held_out")
            first = 0
            for data, at, lengths in _streams(batch.column("text").to_pylist(), order):
                n_docs = len(lengths)
                number = row + np.arange(n_docs)
                doc = np.repeat(np.arange(n_docs), lengths)
                start, _, word = word_numbers(data)
                of = doc[np.searchsorted(at, start)] if len(start) else np.zeros(0, np.int64)
                n_tokens = np.bincount(of, minlength=n_docs) + 1
                place = heavy_at.get_indexer(word.view(np.int64))
                hit = place >= 0
                base = np.bincount(of[hit], heavy_base[place[hit]], n_docs) + end_base
                known = np.bincount(of[hit], minlength=n_docs) + end_known
                string = _strings(data, at, order)
                place = at_of.get_indexer(string)
                far = place < 0  # not sent
                score = (np.bincount(doc, lp[place], n_docs) if small else
                         np.bincount(doc[~far], lp[place[~far]], n_docs).astype(float))  # whole numbers if none was sent
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n_docs, np.int32)), pa.array(number), ids.slice(first, n_docs),
                     outs.slice(first, n_docs), pa.nulls(n_docs, pa.int64()), pa.array(n_tokens), pa.array(known),
                     pa.array(base), pa.array(score)], names)
                for kind, which, values in ((1, of[~hit], word[~hit].view(np.int64)), *([] if small else [(2, doc[far], string[far])])):
                    order_ = np.lexsort((values, which))
                    which, values = which[order_], values[order_]
                    new = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (values[1:] != values[:-1])))[:len(which)]
                    count = np.diff(np.append(new, len(which)))
                    m = len(count)
                    if m:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, kind, np.int32)), pa.array(number[which[new]]), pa.nulls(m, pa.int64()),
                             pa.nulls(m, pa.bool_()), pa.array(values[new]), pa.array(count), pa.nulls(m, pa.int64()),
                             pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)
                row += n_docs
                first += n_docs

    # row numbers hold within this landed table only
    parts = landed(rows.select("doc_id", "held_out", "text").mapInArrow(
        run, "kind int, row long, doc_id long, held_out boolean, key long, n long, known long, base double, lp double"),
        "scores", release=True)
    rare = parts.where("kind = 1").select("row", F.col("key").alias("token"), "n").join(tokens, "token", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(scale))).alias("more_base"),
                                   F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = parts.where("kind = 0").join(more, "row", "left")
    score = F.col("lp")
    if not small:
        others = scored.where(_rank(F.col("n")) < least).select("key", F.col("lp").alias("one"))
        joined = (parts.where("kind = 2").select("row", "key", "n").join(others, "key")
                  .groupBy("row").agg(F.sum(F.col("n") * F.col("one")).alias("more_score")))
        out = out.join(joined, "row", "left")
        score = F.col("lp") + F.coalesce("more_score", F.lit(0.0))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"),
                      (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), score.alias("score"))
