"""Filters that a source's URL names (FLT-14, STR-26): a table of predicates, joined to
the postings of the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# The parameters that a platform reads from its source URL.
PARAMETERS = {"lever": ["location"], "workday": U.WORKDAY_FACETS}
#: The posting's field that a parameter restricts; other parameters restrict nothing here.
FIELD_OF = {"location": "location", "locations": "location", "timeType": "job_type",
            "departments": "departments", "jobFamilyGroup": "departments"}


def source_filters(sources: DataFrame) -> DataFrame:
    """``source_id, platform, field, wanted`` from ``id, platform, url``: one row per
    parameter that the platform knows, with its values (Lever reads the first alone)."""
    out = None
    for platform, names in PARAMETERS.items():
        found = sources.where(F.col("platform") == platform).select(
            F.col("id").alias("source_id"), "platform", F.explode(U.query_map(F.col("url"), names)).alias("field", "wanted"))
        out = found if out is None else out.unionByName(found)
    first = F.when(F.col("platform") == "lever", F.slice("wanted", 1, 1)).otherwise(F.col("wanted"))
    return out.withColumn("wanted", first)


def apply_source_filters(postings: DataFrame, filters: DataFrame) -> DataFrame:
    """Postings whose fields have one of the wanted values, for each parameter of their
    source. A source without parameters keeps all of its postings; a posting without a
    value fails a parameter that asks for one."""
    named = filters.withColumn("column", F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv])[F.col("field")])
    wanted = named.where(F.col("column").isNotNull()).groupBy("source_id").agg(
        F.collect_list(F.struct("column", "wanted")).alias("_wanted"))  # a few parameters a source
    out = postings.join(wanted, "source_id", "left")

    def fits(w):
        values = F.when(w["column"] == "location", F.array("location")).when(w["column"] == "job_type", F.array("job_type")) \
            .otherwise(F.col("departments"))
        return F.coalesce(F.arrays_overlap(F.filter(values, lambda v: v.isNotNull()), w["wanted"]), F.lit(False))

    return out.where(F.coalesce(F.forall("_wanted", fits), F.lit(True))).drop("_wanted")
