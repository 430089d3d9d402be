"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs depend on for correct results (UTC clock) and for scale
# (AQE re-plans joins and partition counts at run time).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows can be large; keep Arrow batches small enough for the Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Partition sizing of sessions that this library starts itself. A session that
# the cluster hands over keeps its own sizes: they follow its executors' memory.
OWN_SESSION_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "gleaner") -> SparkSession:
    """Local/test session. On a cluster the session comes from the launcher."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (BASE_CONF | OWN_SESSION_CONF).items():
        builder = builder.config(k, v)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.warehouse.dir",
                             tempfile.mkdtemp(prefix="gleaner-wh-", dir=os.environ.get("TMPDIR", "/tmp")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime settings to a session created elsewhere."""
    for k, v in BASE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an existing session; keep what is set
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    tasks share this machine's disk, gets a folder of its own when that is unset;
    on a cluster a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext use the SQL conf only
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        if sc is None or not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="gleaner-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss). The frame is persisted first so the checkpoint write does not
    compute it a second time; the persisted copy is released afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist(blocking=False)


_SPLITS: dict[tuple, int] = {}


def balance_input(df: DataFrame, target: int | None = None, key: str | None = None) -> DataFrame:
    """Spread a scan that has fewer partitions than the session can run at
    once (e.g. one Parquet row group per file) so per-row work -- hashing
    whole texts, regex rules, Arrow UDFs over HTML -- is not stuck in one
    task. On a cluster input with thousands of splits this is a no-op; only
    the pruned columns cross the exchange."""
    spark = df.sparkSession
    try:
        par = target or spark.sparkContext.defaultParallelism
    except Exception:
        par = target or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    memo = (id(spark), key) if key else None
    n = _SPLITS.get(memo) if memo else None
    if n is None:
        n = df.rdd.getNumPartitions()  # plans the scan only; nothing runs
        if memo:
            _SPLITS[memo] = n
    if n >= par:
        return df
    return df.repartition(par)
