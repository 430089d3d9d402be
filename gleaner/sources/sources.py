"""Source selection (SRC-1..6, SRT-1).

Predicates are plain comparisons (``active = true``, ``requires_js = false``)
so they reach the Parquet/JDBC scan as pushed filters; in a WHERE clause a
NULL flag drops the row, as the reference's SQL does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_table(df: DataFrame) -> DataFrame:
    """Materialise a side that many plans use (the planned sources) with a
    reliable checkpoint in the shared folder. Whether a join broadcasts it is
    left to Spark, which goes by its bytes. Cutting the lineage also keeps
    Catalyst from inlining the side's derivation into every pushed predicate."""
    from ..session import cut_lineage
    return cut_lineage(df)


def active_sources(sources: DataFrame, source_id: int | None = None) -> DataFrame:
    """SRC-1 / SRC-2: all active sources, or one by id. Only ``None`` means all;
    0 is an id like any other (Q15)."""
    cond = F.col("active") == F.lit(True)
    if source_id is not None:
        cond = cond & (F.col("id") == F.lit(source_id))
    return sources.where(cond)


def sources_of_type(sources: DataFrame, extractor_type: str, include_js: bool = False) -> DataFrame:
    """SRC-3 / SRC-6: active sources of one platform ordered by company."""
    cond = (F.col("active") == F.lit(True)) & (F.col("extractor_type") == F.lit(extractor_type))
    if not include_js:
        cond = cond & (F.col("requires_js") == F.lit(False))
    return sources.where(cond).orderBy("company")


def sources_like(sources: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """SRC-4: active non-JS sources whose company matches any ``%pattern%``
    (LIKE wildcards in the input act as wildcards), case-insensitive."""
    if not patterns:
        return sources.limit(0)
    match = reduce(lambda a, b: a | b, [F.col("company").ilike(f"%{p}%") for p in patterns])
    cond = (F.col("active") == F.lit(True)) & (F.col("requires_js") == F.lit(False)) & match
    return sources.where(cond).orderBy("company")


def sources_all(sources: DataFrame, by_type: bool = False) -> DataFrame:
    """SRC-5 / SRT-1: active non-JS sources ordered by company or (type, company)."""
    cond = (F.col("active") == F.lit(True)) & (F.col("requires_js") == F.lit(False))
    order = ["extractor_type", "company"] if by_type else ["company"]
    return sources.where(cond).orderBy(*order)
