"""Incremental refresh: new events arrive as files; each micro-batch recomputes the
feature rows of the ids it touched, with the same batch code, and writes them as a
partition of its own, ``epoch``.  A batch that is run again replaces its partition;
an id's valid rows are those of its newest epoch (``latest``).

Per-id features depend on an entity's whole history (expanding statistics), so
the affected ids are recomputed from the full event table (a semi join on the
touched ids), not from the micro-batch alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.operators.features import forecasting_features
from cohortflow.operators.score import score
from cohortflow.plans.prepare import EVENTS_CFG
from cohortflow.sources.tables import diary_from_events


def refresh_batch(spark: SparkSession, events_path: str, out_path: str, horizons: int = 14):
    def run(batch: DataFrame, epoch_id: int) -> None:
        touched = batch.select(F.col("user_id").alias("id")).distinct()
        history = spark.read.parquet(events_path).join(touched.withColumnRenamed("id", "user_id"), "user_id", "left_semi")
        panel = score(diary_from_events(history), list(EVENTS_CFG.items))
        feats = forecasting_features(panel, EVENTS_CFG, horizons)
        feats.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/epoch={int(epoch_id)}")
    return run


def latest(spark: SparkSession, out_path: str) -> DataFrame:
    """The refreshed table as it stands: of every id the rows of the newest epoch that touched it."""
    rows = spark.read.parquet(out_path)
    newest = rows.groupBy("id").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["id", "epoch"], "left_semi")


def start(spark: SparkSession, events_path: str, out_path: str, checkpoint: str, horizons: int = 14):
    """Start the stream; ``checkpoint`` should live under ``spark.checkpoint.dir``."""
    schema = spark.read.parquet(events_path).schema
    stream = spark.readStream.schema(schema).parquet(events_path)
    return (stream.writeStream.foreachBatch(refresh_batch(spark, events_path, out_path, horizons))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
