"""Divergence of the sources of each language in their use of terms.

``CountVectorizer`` gives every document an exact sparse vector over the terms that
enough documents of its language hold. The vectors of a (lang, source) group are
summed in sparse form, and pairs of groups are evaluated on the terms that one of
them has; a closed form covers the terms that neither has. All arithmetic is on
integers.

One fit serves all languages: a term is fitted under its language's name, so the
minimum of documents holds per language and no job runs per language. The
vocabulary (terms in at least ``min_docs`` documents of a language, not all words)
is on the driver and in each task, as with any ``CountVectorizer``.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import landed, lower_ascii

# Fixed values of the query contract: what separates terms, and the scale of shares.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
MIN_DOCS, TOP = 10, 10
#: Ends the language's name in a fitted term, and comes before a fitted term. No term holds
#: them, nor does a name: one of other letters than these is written in hexadecimal.
MARK, NEXT = "\x00", "\x01"
PLAIN = r"^[a-z]+\z"
MOST = 2**31 - 1
#: Counts under it give shares in 64 bits.
SMALL = 2**63 // SCALE - 2


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))``, exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(28,0)")
    all_of = total + 2 * kept
    return F.lit(1).cast("long") + F.when(
        count < SMALL, F.call_function("div", (count.cast("long") + 2) * F.lit(SCALE).cast("long"), all_of)).otherwise(
        F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(all_of)))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class TermCounts:
    """Tables of one fit:

    - ``groups``: ``g, lang, source, total, kept, none, lang_total`` of each occurring group,
      with its number, the count of all kept terms, their number, the share of a term with
      count 0, and the count of all kept terms of the language
    - ``terms``: ``i, g, lang, source, term, n, p, q, none`` of each kept term that a group has;
      ``i`` is the number of a term and its language, ``q`` the term's share in the whole language
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
        rows = docs.select(lang, source, text)
        # texts of ASCII alone are lowered as a whole; an empty word at an end leaves with the vocabulary
        lower = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(lower_ascii(F.col("text")))
        name = F.concat(F.when(F.col("lang").rlike(PLAIN), F.col("lang")).otherwise(F.hex("lang")), F.lit(MARK))
        tagged = F.concat(name, F.regexp_replace(lower, F.lit(BETWEEN), F.concat(F.lit(NEXT), name)))
        # read twice, by the fit and for the vectors: one string a document; a task has few groups, so their sums are few
        texts = landed(rows.hint("rebalance", "lang", "source").select("source", tagged.alias("text")), "tagged-terms")
        tagged = texts.select("source", F.split("text", NEXT).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=MOST).fit(tagged)
        vector = F.unwrap_udt("vector")
        # a term's number names its language too
        sums = (model.transform(tagged).select("source", vector.alias("v"))
                .select("source", F.inline(F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("x"))))
                .groupBy("source", "i").agg(F.sum(F.col("x").cast("long")).alias("n")))
        vocabulary = _vocabulary(docs, model)
        kept = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
        # rows meet by their number, and are summed over the sources where they meet
        whole = F.sum("n").over(Window.partitionBy("i")).alias("all")
        counts = landed(sums.join(vocabulary, "i").select("i", "lang", "source", "term", "n", whole), "term-counts")
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = (rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
                  .join(kept, "lang", "left").na.fill(0, ["total", "kept"]))
        none = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))
        in_lang = F.sum("total").over(Window.partitionBy("lang"))
        # the numbers are landed with their groups, so they stay
        self.groups = landed(groups.select(F.monotonically_increasing_id().alias("g"), "*", none.alias("none"),
                                           in_lang.alias("lang_total")), "groups")
        p, q = (share(F.col(n), F.col(total), F.col("kept")) for n, total in (("n", "total"), ("all", "lang_total")))
        self.terms = counts.join(self.groups, ["lang", "source"]).select(
            "i", "g", "lang", "source", "term", "n", p.alias("p"), q.alias("q"), "none")


def _vocabulary(docs: DataFrame, model) -> DataFrame:
    """``lang, i, term`` of the fitted terms, read from the saved model: the list
    does not pass through Python."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/gleaner-vocabulary-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = docs.sparkSession.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "tagged"))
    term = F.substring_index("tagged", MARK, -1)
    name = F.substring_index("tagged", MARK, 1)
    lang = F.when(name.rlike(PLAIN), name).otherwise(F.unhex(name).cast("string"))
    return saved.select(lang.alias("lang"), "i", term.alias("term")).where("term <> ''")


def pair_values(found: TermCounts) -> DataFrame:
    """``lang, a, b, value`` for each ordered pair of sources of a language."""
    terms, groups = found.terms, found.groups.drop("lang_total")
    side = lambda g, s: g.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in g.columns if c != "lang"])
    pairs = side(groups, "a").join(side(groups, "b"), "lang").where("a_source <> b_source")
    # the terms of one side, as if the other had none of them; equal shares are counted first
    kinds = terms.groupBy(F.col("g").alias("a_g"), "p").agg(F.count("*").alias("k"))
    apart = (kinds.join(pairs.select("a_g", "b_g", "b_none"), "a_g").groupBy("a_g", "b_g")
             .agg(F.sum(F.col("k") * distance(F.col("p"), F.col("b_none"))).alias("alone"), F.sum("k").alias("size")))
    back = apart.select(F.col("b_g").alias("a_g"), F.col("a_g").alias("b_g"), F.col("alone").alias("back"),
                        F.col("size").alias("back_size"))
    # terms of both sides: each unordered pair once, with what the two sums above say of them taken off
    one, two = (terms.select("i", *[F.col(c).alias(f"{s}_{c}") for c in ("g", "p", "none")]) for s in "ab")
    a, b, a0, b0 = (F.col(c) for c in ("a_p", "b_p", "a_none", "b_none"))
    both = (one.join(two, "i").where("a_g < b_g").groupBy("a_g", "b_g")
            .agg(F.sum(distance(a, b) - distance(a, b0) - distance(a0, b)).alias("change"), F.count("*").alias("shared")))
    both = landed(both, "shared-terms")
    both = both.unionByName(both.select(F.col("b_g").alias("a_g"), F.col("a_g").alias("b_g"), "change", "shared"))
    key = ["a_g", "b_g"]
    all_of = pairs.join(apart, key, "left").join(back, key, "left").join(both, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    neither = F.col("a_kept") - zero("size") - zero("back_size") + zero("shared")
    value = zero("alone") + zero("back") + zero("change") + neither * F.coalesce(distance(a0, b0), F.lit(0).cast("long"))
    return all_of.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), value.alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each
    other of its language (part ``pair``), and the ``top`` terms that it uses most
    beyond its language's use (part ``term``).

    A null text, lang or source is an empty string, and a group of its own. Repeated
    rows are documents of their own. A language without kept terms gives pairs of
    value 0 and no terms; a source alone in its language gives no pairs; an empty
    table gives no rows. Ties go to the item that is less in UTF-8. Other columns
    are not read.
    """
    found = TermCounts(docs, min_docs)
    pairs = pair_values(found).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"),
                                      F.col("b").alias("item"), "value")
    terms = (found.terms.where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     distance(F.col("p"), F.col("q")).alias("value")))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
