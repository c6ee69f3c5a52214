"""Readers for the test tables and the panel adapters over them.

``diary_from_events`` turns the event stream into a daily diary: one row per
(user, calendar day).  The aggregation is a plain ``groupBy`` with partial
(map-side) aggregation, so a user holding a large share of all events is
combined inside every map task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.functions.scalar import row_count, row_max, row_sd_samp, row_sum

# --- fixed values: event types mapped to diary items --------------------------------
EVENT_ITEM_TYPES = ("click", "view", "error", "purchase")
TREATMENT_EVENT = "signup"
EVENTS_ORIGIN = "2024-01-01"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def diary_from_events(events: DataFrame, origin: str = EVENTS_ORIGIN) -> DataFrame:
    """Daily diary over ``group by user_id, date(ts)``.

    Columns: id, day, start_date, item_<type> (least(10, avg/10), NULL when the
    type is absent), overall_wellbeing, treatment, treatment_type and the four
    row summaries of the non-null items.
    """
    d = F.to_date(F.col("ts"))
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    is_tx = F.col("event_type") == F.lit(TREATMENT_EVENT)
    aggs = []
    for t in EVENT_ITEM_TYPES:
        a = F.avg(F.when(F.col("event_type") == F.lit(t), F.col("value")))
        aggs.append(F.when(a.isNotNull(), F.least(F.lit(10.0), a / F.lit(10.0))).alias(f"item_{t}"))
    aggs += [
        F.greatest(F.lit(0.0), F.lit(10.0) - F.avg("value") / F.lit(10.0)).alias("overall_wellbeing"),
        F.max(is_tx.cast("int")).alias("treatment"),
        (F.max(F.when(is_tx, k)) % F.lit(3)).alias("treatment_type"),
    ]
    daily = (events.select("user_id", "ts", "event_type", "value", "props")
             .groupBy(F.col("user_id").alias("id"), d.alias("start_date")).agg(*aggs))
    items = [f"item_{t}" for t in EVENT_ITEM_TYPES]
    origin_date = _dt.date.fromisoformat(origin)
    return daily.select(
        F.col("id").cast("bigint").alias("id"),
        (F.datediff(F.col("start_date"), F.lit(origin_date)) + F.lit(1)).cast("int").alias("day"),
        "start_date", *items, "overall_wellbeing",
        F.col("treatment").cast("int").alias("treatment"),
        F.col("treatment_type").cast("int").alias("treatment_type"),
        row_count(items).cast("double").alias("symptom_count"),
        row_sum(items).alias("total_symptom_score"),
        row_max(items).alias("max_symptom_score"),
        row_sd_samp(items).alias("symptom_variability"),
    )


def diary_from_orders(orders: DataFrame) -> DataFrame:
    """Second, sparser panel: customer x order date, wellbeing from the order price."""
    d = F.to_date(F.col("o_orderdate"))
    daily = (orders.select("o_custkey", "o_orderdate", "o_totalprice")
             .groupBy(F.col("o_custkey").alias("id"), d.alias("start_date"))
             .agg(F.avg("o_totalprice").alias("price")))
    return daily.select(
        F.col("id").cast("bigint").alias("id"),
        (F.datediff(F.col("start_date"), F.lit(_dt.date(1992, 1, 1))) + F.lit(1)).cast("int").alias("day"),
        "start_date",
        F.least(F.lit(10.0), F.col("price") / F.lit(50000.0)).alias("overall_wellbeing"),
        F.least(F.lit(10.0), F.col("price") / F.lit(60000.0)).alias("item_price"),
    )
