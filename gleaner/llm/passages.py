"""Passages of ``WORDS`` words or more that stand in other text, across documents.

Every string of ``WORDS`` words is looked at, wherever it starts. Its anchor is the
string of ``ANCHOR`` words in it whose first shingle has the least number, so equal
strings have equal anchors. Only places whose anchor occurs twice send the digest of
their whole strings, gathered to stretches of neighbours with one anchor. Equal
stretches are one kind, whose strings are compared once; equal digests are repeats.
Neighbouring repeats that stand side by side in an earlier place too are one passage. Words compare lower-cased, as in
shingles; line breaks are white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import landed
from .jaccard import NO_ID
from .repeats import Repeats, repeats


def first_places(stretches: DataFrame) -> DataFrame:
    """``stretch, i, j, class_did, class_key, class_pos, class_paragraph``: of each kind of
    stretch, the strings from ``i`` to ``j`` that stand twice or more, side by side in
    the row of their first place."""
    at = F.struct("did", "row_key", "pos", "line", "lines")
    kinds = landed(stretches.groupBy("stretch").agg(F.min(at).alias("at"), F.max("digests").alias("digests"), F.count("*").alias("n")),
                   "kinds", release=True)
    strings = kinds.select("stretch", "n", "at", F.posexplode("digests").alias("i", "digest"))
    place = F.struct(F.col("at.did").alias("did"), F.col("at.row_key").alias("row_key"), (F.col("at.pos") + F.col("i")).alias("pos"),
                     (F.col("at.line") + F.col("at.lines")[F.col("i")]).alias("line"))
    firsts = strings.groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    met = strings.select("stretch", "i", "digest").join(firsts, "digest").select(
        "stretch", "i", F.col("first.did").alias("class_did"), F.col("first.row_key").alias("class_key"),
        F.col("first.pos").alias("class_pos"), F.col("first.line").alias("class_paragraph"))
    group = ["stretch", "class_did", "class_key", "shift"]
    met = met.withColumn("shift", F.col("class_pos") - F.col("i"))
    run = F.col("i") - F.row_number().over(Window.partitionBy(*group).orderBy("i"))  # a stretch has 19 strings at most
    return met.withColumn("run", run).groupBy(*group, "run").agg(
        F.min("i").alias("i"), F.max("i").alias("j"), F.min("class_pos").alias("class_pos"),
        F.min("class_paragraph").alias("class_paragraph")).drop("shift", "run")


def repeated_passages(docs: DataFrame, found: Repeats | None = None) -> DataFrame:
    """The columns of ``repeated_paragraphs``, for each passage that occurs again.

    The first place of every string of ``WORDS`` words stays (smallest ``doc_id``; of
    rows that share it, the smaller row key; then the earlier place); the others are
    ``removed``, so of each word one place stays. A passage is as long as it runs side
    by side with one first place. Null ``doc_id`` and equal rows are taken as there;
    null, empty and shorter texts and empty tables have no passage.
    """
    stretches = (found or repeats(docs, paragraphs=False)).stretches
    i, j = F.col("i"), F.col("j")
    group = ["did", "row_key", "class_did", "class_key", "shift"]
    firsts = landed(first_places(stretches), "firsts", release=True)
    pieces = stretches.drop("digests").join(firsts, "stretch").select(
        "did", "row_key", "class_did", "class_key", (F.col("class_pos") - F.col("pos") - i).alias("shift"),
        (F.col("pos") + i).alias("low"), (F.col("pos") + j).alias("high"), "class_paragraph",
        (F.col("line") + F.col("lines")[i]).alias("paragraph"), (F.col("line") + F.col("lasts")[j]).alias("last"),
        (F.col("start") + F.col("starts")[i]).alias("start"), (F.col("start") + F.col("ends")[j]).alias("end"))
    # equal rows share all of this: all but one of them go as well
    pieces = pieces.repartition(*group).groupBy(*pieces.columns).agg(F.count("*").alias("copies"))
    by_place = Window.partitionBy(*group).orderBy("low")
    apart = F.coalesce((F.col("low") > F.lag("high").over(by_place) + 1).cast("int"), F.lit(0))
    pieces = pieces.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_place))
    out = pieces.groupBy(*group, "run").agg(
        F.min("paragraph").alias("paragraph"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("class_paragraph").alias("class_paragraph"), F.max("copies").alias("copies"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("did") == F.col("class_did")) & (F.col("row_key") == F.col("class_key")) & (F.col("shift") == 0)
    null_id = F.lit(NO_ID)
    return out.select(F.nullif("did", null_id).alias("doc_id"), "row_key",
                      *[F.col(c).cast("long").alias(c) for c in ("paragraph", "last", "start", "end")],
                      F.nullif("class_did", null_id).alias("class_doc_id"), F.col("class_paragraph").cast("long").alias("class_paragraph"),
                      (~kept | (F.col("copy") > 1)).alias("removed"))
