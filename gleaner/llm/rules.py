"""Quality rules: one ledger row per document, policies as bit masks.

Each rule is evaluated once. Its failure is one bit of ``failed``; what it
measured stays beside it. A policy is a mask of rules, so changing one, or
asking what each rule adds (an ablation), reads the ledger and no text.
Everything here is built-in column functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, words

SYMBOLS = "#*$%&|<>"  # fixed value of the query contract

#: Rules in bit order. The first two are the base verdict; a new rule goes last.
RULES = ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "word_length")
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | BITS["symbols"],
    "v2": BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["word_length"],
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(w: Column) -> Column:
    """Words covered by a 3-word window that the text holds twice or more.

    Windows are sorted by hash, so equal ones are neighbours: n log n for a text
    of any length. Texts without a repeated window skip the sort of positions."""
    hashes = F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"),
                                      F.slice(w, 3, F.size(w)).alias("c")),
                         lambda z: F.xxhash64(z["a"], z["b"], z["c"]))
    windows = F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = bind(placed, lambda p: F.zip_with(
            p, F.slice(p, 2, F.size(p)),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        at = F.array_distinct(F.flatten(twins))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failed`` (a bit per rule) of each row.

    A null text has no words and fails ``too_few_words``; an empty table gives an
    empty ledger; repeated rows give repeated rows; other columns are not read.
    """
    return _entries(docs, F.col("doc_id").cast("long")).withColumnRenamed("key", "doc_id")


def keep_documents(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps."""
    return apply_policy(_entries(docs, F.struct("*")), policy).where("kept").select("key.*")


def _entries(docs: DataFrame, key: Column) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    m = docs.select(key.alias("key"), text.alias("t"))
    # One generated struct keeps the arrays bound once; they never leave the row.
    measured = bind(words(F.col("t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    lined = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                           (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    m = m.select("key", measured.alias("w"), lined.alias("l"),
                 F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                 (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    m = m.select("key", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    fails = {
        "too_few_words": F.col("n_words") < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": (F.col("n_dup_lines") >= 2) & (2 * F.col("n_dup_lines") >= F.col("n_lines")),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    }
    bits = F.lit(0).cast("long")
    for name in RULES:
        bits = bits.bitwiseOR(F.when(fails[name], F.lit(BITS[name])).otherwise(0).cast("long"))
    return m.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` from the ledger's bits alone."""
    mask = POLICIES[policy] | BASE
    return rows.withColumns({"base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0,
                             "kept": F.col("failed").bitwiseAND(F.lit(mask)) == 0})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and
    that the policy keeps without it. One aggregate over the bits."""
    mask = POLICIES[policy]
    under = F.col("failed").bitwiseAND(F.lit(mask))
    names = [r for r in RULES if mask & BITS[r]]
    aggs = []
    for r in names:
        aggs += [F.count_if(under.bitwiseAND(F.lit(BITS[r])) != 0).alias(f"{r}_fails"),
                 F.count_if(under == BITS[r]).alias(f"{r}_alone"),
                 F.count_if(under.bitwiseAND(F.lit(mask & ~BITS[r])) == 0).alias(f"{r}_without")]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"{r}_fails").alias("fails"), F.col(f"{r}_alone").alias("alone"),
                 F.col(f"{r}_without").alias("kept_without")) for r in names])).alias("x")).select("x.*")
