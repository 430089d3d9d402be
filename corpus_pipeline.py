"""Corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before
it kept, and returns a DataFrame that is landed as Parquet for the next one. All
but the last return the columns of ``documents``. Nulls, empty texts, ties, repeated
rows and empty tables are handled as the operators in ``gleaner.llm`` state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    from gleaner.llm.rules import keep_documents
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on 5 words)."""
    from gleaner.llm.jaccard import keep_one
    return keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that an earlier place holds too. A
    character that a cut splits goes; so does a document that loses all its words.
    A null text becomes an empty one."""
    from gleaner.llm.suffix import dedup_substrings
    cut, kept = F.size("spans") > 0, F.col("kept").cast("string")
    left = F.when(cut, F.regexp_replace(F.make_valid_utf8(kept), "\ufffd", "")).otherwise(kept)
    # the text comes back from the bytes that are kept: it need not travel twice
    out = dedup_substrings(docs, tuple(c for c in docs.columns if c != "text")).withColumn("left", left)
    return _with_text(docs, out.where(~cut | F.col("left").rlike(r"[^\x20\x09-\x0D]")), F.col("left"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind in brackets."""
    from gleaner.llm.pii import detect_pii, masked
    found = detect_pii(docs, tuple(docs.columns)).withColumn("all", F.array_sort(F.concat("spans", "added")))
    text = F.when(F.size("all") > 0, masked(F.col("row.text"), F.col("all"))).otherwise(F.col("row.text"))
    return _with_text(docs, found, text)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4096 tokens."""
    import public_tokenizers

    from gleaner.llm.packing import pack_documents
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _with_text(docs: DataFrame, rows: DataFrame, text) -> DataFrame:
    """The carried columns in their order and types, with a new text and its length."""
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: SQL can neither tokenize nor tag; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is landed and read again."""
    from gleaner.llm.common import landed
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs
