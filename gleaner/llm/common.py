"""Helpers that the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values of the query contract: the white space between words.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, row_key, text)``: null texts are empty, and ``row_key`` tells
    rows apart that share a ``doc_id`` (or have none) but not a text. Rows equal
    in both get equal keys, so they share one result. Of the other columns only
    those in ``carry`` come along, as one struct ``row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), text.alias("text"), *row)


#: Spark's setting by which a query's shuffle files go as soon as it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def landed(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage ends there, and lost executors recompute nothing above.
    ``release``: the write's shuffle files are removed when it has ended."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    try:
        spark.conf.set(FREED, "true" if release else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text):
    """A-Z only, as the contracts ask; ``lower`` would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    """Native array of the words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def bind(value, body):
    """``body(x)`` with ``x`` bound to ``value`` once; without it Catalyst would
    evaluate ``value`` again for every element of an inner array function."""
    return F.element_at(F.transform(F.array(value), body), 1)
