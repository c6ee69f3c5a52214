"""Session helpers.

The library never owns the cluster configuration: it only sets the few SQL
options its column names and null rules depend on, and reads the checkpoint
folder from ``spark.checkpoint.dir`` (set by the cluster).  A folder below
the warehouse is chosen only when that setting is absent, which happens in local tests.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Options the operators rely on.  Column names such as ``W_t`` and ``w_t`` must be
# distinct, and day arithmetic must not depend on the machine time zone.
_REQUIRED_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
}


def ensure_session_conf(spark: SparkSession) -> SparkSession:
    for k, v in _REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, app: str = "cohortflow", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with settings suited to panel workloads.

    AQE is on so shuffle partition counts adapt at run time and skewed joins get
    split; ``shuffle_partitions`` is the pre-AQE upper bound.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.caseSensitive": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"      # local mode: the driver JVM is the only executor
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_session_conf(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as is.  Only when
    it is unset (unit tests) a folder below ``spark.sql.warehouse.dir``, which driver and
    executors share by definition, takes its place.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "tables", name)


def written(df, name: str):
    """``df`` written once into the shared folder and read back: cuts the lineage in one job (a checkpoint takes two)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
