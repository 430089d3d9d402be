"""Near-duplicate paragraphs across documents: candidates, exact verification.

Paragraphs are all lines with words, and also runs of neighbouring lines under
``SHORT`` words joined to one (a line without words or a longer one ends a run), so
hard-wrapped text is compared as a whole too. Equal shingle sets count once. Sets of
up to ``FEW`` shingles share one of their least tokens with any partner: no pair of
them is missed. Larger ones meet in MinHash bands, tuned so that a pair at the
threshold is missed with at most ``MISS`` probability. Paragraphs that collide meet
in one bucket, where their exact Jaccard similarity is verified on whole sets;
verified links make components, and all but a component's first paragraph are to be
removed.

Buckets with equal members are one. A bucket over ``BLOCK`` short paragraphs, such as
those that hold one common line, is split by the tokens that few of its members have
(``finer``). A bucket that is still over ``BLOCK`` paragraphs is dealt
out, each part with the bucket's leader; what does not join the leader's
component is then compared with all parts, so no pair of a bucket is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, landed
from .components import connected
from .jaccard import BLOCK, NO_ID, PERCENT, _blocks, _clusters, _overlaps, _partition, _sets, least_overlap, linked
from .repeats import FEW, MIN_WORDS, PLACE, Repeats, repeats, tuned_bands  # noqa: F401 (bands: for callers of this module)

#: Blocks of up to so many sets are compared pair by pair.
PAIRWISE = 16


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def _few_clusters(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """What ``_clusters`` gives, for a block of few sets."""
    sizes, label = [len(s) for s in sets], [-1] * len(sets)
    for i in range(len(sets)):
        if label[i] >= 0:
            continue
        label[i], wave = i, [i]
        while wave:
            j = wave.pop()
            for k, n in enumerate(sizes):
                if (label[k] < 0 and 100 * min(n, sizes[j]) >= percent * max(n, sizes[j])
                        and linked(_shared(sets[j], sets[k]), sizes[j], n, percent)):
                    label[k] = i
                    wave.append(k)
    return np.array(label)


def finer(large: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``bucket, pid, size, leader`` of ``large`` buckets (``bucket, pid, size, leader``) after those of
    short sets are split. Linked sets share one of their first tokens in any order, so they
    share one in the order of their bucket, where tokens that over ``BLOCK`` members have
    come last: each such token makes a bucket of its own."""
    held = large.select("bucket", "pid").join(sets, "pid")
    short = held.groupBy("bucket").agg(F.max(F.length("tokens")).alias("most")).where(
        F.col("most") <= 8 * (100 * FEW // percent)).select("bucket")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sets = _sets(batch.column("tokens"))
            sizes = np.array([len(s) for s in sets])
            of = pa.array(np.repeat(np.arange(len(sets)), sizes))
            first = sizes - least_overlap(sizes, percent) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket").take(of), batch.column("pid").take(of), pa.array(np.repeat(first, sizes)),
                 pa.array(np.concatenate(sets).view(np.int64))], ["bucket", "pid", "first", "token"])

    tokens = held.join(short, "bucket").select("bucket", "pid", "tokens").mapInArrow(
        spread, "bucket long, pid long, first long, token long")
    common = tokens.groupBy("bucket", "token").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(
        "bucket", "token", F.lit(True).alias("common"))
    late = Window.partitionBy("bucket", "pid").orderBy(F.coalesce("common", F.lit(False)), "token")
    split = landed(tokens.join(common, ["bucket", "token"], "left").withColumn("place", F.row_number().over(late))
                   .where("place <= first").select(F.xxhash64("bucket", "token").alias("bucket"), "pid"), "split", release=True)
    sizes = split.groupBy("bucket").agg(F.count("*").alias("size"), F.min("pid").alias("leader")).where("size > 1")
    return landed(large.join(short, "bucket", "left_anti").select("bucket", "pid", "size", "leader")
                  .union(split.join(sizes, "bucket").select("bucket", "pid", "size", "leader")), "finer", release=True)


def bucket_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges ``a, b`` that connect all linked paragraphs of each bucket."""
    large = members.where(F.col("size") > BLOCK).select("bucket", "pid", "size", "leader")
    some = landed(sets.join(large.select("pid").distinct(), "pid").select("pid", "tokens"), "large", release=True)
    members = members.where(F.col("size") <= BLOCK).select("bucket", "pid", "size", "leader").union(finer(large, some, percent))
    parts = F.ceil(F.col("size") / BLOCK).cast("long")
    part = F.when(F.col("pid") == F.col("leader"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("pid", "bucket"), parts)))
    dealt = (members.withColumn("part", F.explode(part)).join(sets, "pid")
             .select(F.xxhash64("bucket", "part").alias("block"), "bucket", F.col("pid").alias("rid"),
                     (F.col("pid") == F.col("leader")).alias("leader"), "tokens"))

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        rid, leader, bucket = (table.column(c).to_numpy() for c in ("rid", "leader", "bucket"))
        sets = _sets(table.column("tokens"))
        edges: list[list[np.ndarray]] = []
        for at in _blocks(table, leader):
            label = (_few_clusters if len(at) <= PAIRWISE else _clusters)([sets[i] for i in at], percent)
            for some, far in ((np.flatnonzero(label > 0), True), (np.flatnonzero(label == 0)[1:], False)):
                edges.append([bucket[at[some]], rid[at[some]], rid[at[label[some]]], np.full(len(some), far)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*edges)], ["bucket", "a", "b", "far"])

    within = landed(dealt.repartition("block").mapInArrow(cluster, "bucket long, a long, b long, far boolean"), "within", release=True)
    # what the leader does not reach, in buckets of several parts, meets all parts
    far = within.where("far").select("bucket", F.col("a").alias("pid"), F.col("b").alias("label"))
    large = members.where(F.col("size") > BLOCK).join(far, ["bucket", "pid"], "left")
    label = F.coalesce("label", "leader").alias("label")
    asked = (large.where("label IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
             .select("bucket", "part", "pid", label, F.lit(False).alias("leader")))
    there = (large.withColumn("part", F.pmod(F.xxhash64("pid", "bucket"), parts))
             .select("bucket", "part", "pid", label, F.lit(True).alias("leader")))
    both = there.union(asked).join(some, "pid").select(
        F.xxhash64("bucket", "part").alias("block"), F.col("pid").alias("rid"), "label", "leader", "tokens")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _partition(batches)
        if table is None:
            return
        label, member = table.column("label").to_numpy(), table.column("leader").to_numpy()
        sets = _sets(table.column("tokens"))
        for at in _blocks(table, member):
            here, guests = at[member[at]], at[~member[at]]
            if not len(here) or not len(guests):
                continue
            count, sizes = _overlaps([sets[i] for i in here]), np.array([len(sets[i]) for i in here])
            # two clusters are tied once; what is tied already is not compared
            for name in np.unique(label[guests]):
                open_ = label[here] != name
                for i in guests[label[guests] == name]:
                    if not open_.any():
                        break
                    hit = np.unique(label[here[open_ & linked(count(sets[i]), len(sets[i]), sizes, percent)]])
                    if len(hit):
                        open_ &= ~np.isin(label[here], hit)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), name)), pa.array(hit)], ["a", "b"])

    return within.select("a", "b").union(both.repartition("block").mapInArrow(meet, "a long, b long")).where("a <> b")


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, found: Repeats | None = None) -> DataFrame:
    """``doc_id, row_key, paragraph, last, start, end, class_doc_id, class_paragraph,
    removed`` of each paragraph whose class has another member.

    ``paragraph`` and ``last`` are its first and last line, counted from 0; ``start``
    and ``end`` are code points. A class is named by its first paragraph (smallest
    ``doc_id``, then line), which stays; the others are ``removed``. Joined lines do
    not count in a class that one of them is in by itself: they would repeat only
    themselves. Null and empty texts have no paragraph; a null ``doc_id`` comes after
    all others; equal rows hold equal paragraphs, so the second goes; an empty table
    gives an empty one; other columns are not read. ``found``: what the scans found, if passages are asked for too.
    """
    places, members, sets, _ = found or repeats(docs, passages=False, percent=percent, min_words=min_words)
    # read twice: for the rounds and for the nodes
    roots = connected(landed(bucket_links(members, sets, percent), "links", release=True))
    # most paragraphs stand alone: they leave before places are sorted into classes
    again = places.groupBy("pid").agg(F.count("*").alias("n")).join(roots, F.col("pid") == F.col("node"), "left").where(
        "n > 1 OR node IS NOT NULL").select("pid", F.coalesce("root", "pid").alias("class"))
    # equal rows share doc_id and line: all but one of them go as well
    classed = places.join(again, "pid").groupBy("class", "did", "row_key", *PLACE).agg(F.count("*").alias("copies"))
    alone = Window.partitionBy("class", "did", "row_key", "run")
    classed = (classed.withColumn("line", F.max(F.col("paragraph") == F.col("last")).over(alone))
               .where("paragraph = last OR NOT line"))
    at = F.struct("did", "paragraph", "last")
    firsts = classed.groupBy("class").agg(F.min(at).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    out = classed.join(firsts, "class").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    null_id = F.lit(NO_ID)
    return out.select(F.nullif("did", null_id).alias("doc_id"), "row_key", "paragraph", "last", "start", "end",
                      F.nullif(F.col("first.did"), null_id).alias("class_doc_id"),
                      F.col("first.paragraph").alias("class_paragraph"),
                      ((at > F.col("first")) | (F.col("copy") > 1)).alias("removed"))


def without_paragraphs(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, text`` without the lines that ``repeated`` marks as removed."""
    gone = repeated.where("removed").withColumn("line", F.explode(F.sequence("paragraph", "last"))).groupBy("row_key").agg(
        F.collect_set("line").alias("gone"))
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i.cast("long")), x)), lambda x: x.isNotNull())
    return keyed(docs).join(gone, "row_key", "left").select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
