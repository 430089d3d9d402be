"""Updates of a keyed table as small files by version.

The base table stays as it was written. A batch writes only the rows that it
changes, whole, into ``v=N`` of an update folder; a batch that is repeated writes the
same folder again. Readers take the base rows without an update and the latest
update of each other key. ``compact`` gathers the latest updates up to a version in
one folder, which readers then begin with; older folders are left to a clean-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "update_version"


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Versions of the finished folders of one kind (``v`` or ``compact``)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [n for n in names if n.startswith(f"{kind}=")
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def write_update(rows: DataFrame, path: str, version: int) -> None:
    """The whole rows that a batch changes, as version ``version``."""
    rows.withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/v={version}")


def read_updates(spark: SparkSession, path: str, key: str, before: int | None = None) -> DataFrame | None:
    """The latest update of each key, with its version (only versions below ``before``).

    Which version is the latest comes from keys and versions alone; rows are joined
    to it, so no description sits in an aggregate's buffer."""
    start = [n for n in _folders(spark, path, "compact") if before is None or n < before][-1:]
    later = [n for n in _folders(spark, path, "v") if (before is None or n < before) and n > (start or [-1])[0]]
    paths = [f"{path}/compact={n}" for n in start] + [f"{path}/v={n}" for n in later]
    if not paths:
        return None
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*paths)
    if len(paths) == 1:  # one folder holds a key once
        return rows
    latest = rows.groupBy(key).agg(F.max(VERSION).alias(VERSION))
    return rows.join(latest, [key, VERSION], "left_semi")


def current_rows(base: DataFrame, updates: DataFrame | None, key: str) -> DataFrame:
    """Base rows that have no update, and the updates."""
    if updates is None:
        return base
    updates = updates.drop(VERSION)
    return base.join(updates.select(key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, key: str, up_to: int) -> None:
    """Gather the latest updates of all versions up to ``up_to`` in one folder."""
    rows = read_updates(spark, path, key, before=up_to + 1)
    if rows is not None:
        rows.write.mode("overwrite").parquet(f"{path}/compact={up_to}")
