"""Entry A: raw diary -> canonical -> scored -> feature block (one shuffle on id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortflow.config import PanelConfig
from cohortflow.operators.features import effect_features, forecasting_features
from cohortflow.operators.score import score
from cohortflow.session import ensure_session_conf
from cohortflow.sources.tables import EVENT_ITEM_TYPES, diary_from_events, read_table

EVENT_ITEMS = [f"item_{t}" for t in EVENT_ITEM_TYPES]
EVENTS_CFG = PanelConfig(items=tuple(EVENT_ITEMS))


def events_panel(spark: SparkSession, sf_dir: str, cfg: PanelConfig = EVENTS_CFG) -> DataFrame:
    """Scored daily panel from the ``events`` table."""
    ensure_session_conf(spark)
    diary = diary_from_events(read_table(spark, sf_dir, "events"))
    return score(diary, list(cfg.items), cfg.alpha, cfg.beta, cfg.use_precomputed_s)


def events_features(spark: SparkSession, sf_dir: str, horizons: int = 14, cfg: PanelConfig = EVENTS_CFG) -> DataFrame:
    return forecasting_features(events_panel(spark, sf_dir, cfg), cfg, horizons)


def events_effect_features(spark: SparkSession, sf_dir: str, horizons: int = 14,
                           cfg: PanelConfig = EVENTS_CFG) -> DataFrame:
    return effect_features(events_panel(spark, sf_dir, cfg), cfg, horizons)
