"""Feature-list selection with leak rules (P14): driver-side over the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: label columns that must never be features --------------------------
LEAK_PREFIXES = ("Y_next_h", "dY_next_h", "U_next_h", "dU_next_h", "W_next_h", "dW_next_h", "S_next_h", "dS_next_h")
LEAK_EXACT = {"Ystar_next_day", "dY_next", "Ustar_next_day", "dU_next", "Wstar_next_day", "dW_next",
              "Sstar_next_day", "dS_next"}
# effect study: whole-record deviations use future rows
EFFECT_LEAK_EXACT = {"U_minus_person_mean", "person_mean"}
# effect study: columns that reveal the arm (reference keeps them; ``compat=True`` does too)
ARM_REVEALING = {"is_treated", "treated_today", "treatment", "treatment_type", "days_since_last_treat",
                 "episode_len", "episode_end", "episode_start", "days_since_treatment_start", "treated_last3_any"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, label: str | None, id_col: str = "id", day_col: str = "day",
                    extra_drop=(), leak_exact=LEAK_EXACT, leak_prefixes=LEAK_PREFIXES) -> list[str]:
    """All numeric columns minus keys, the label, exact leak names and leak prefixes."""
    drop = {id_col, day_col, label, *extra_drop}
    return [c for c in numeric_columns(df)
            if c not in drop and c not in leak_exact and not c.startswith(tuple(leak_prefixes)) and not c.startswith("_")]


def effect_feature_columns(events: DataFrame, id_col: str = "id", compat: bool = False) -> list[str]:
    """Effect features: numeric minus id/centre/arm/outcome, whole-record leaks and all
    label prefixes (Q12); arm-revealing columns are excluded unless ``compat`` (Q11)."""
    extra = {"centre_day", "A_star", "Y_star", "day", "w_event"}
    if not compat:
        extra |= ARM_REVEALING
    return feature_columns(events, None, id_col, "centre_day", extra,
                           leak_exact=LEAK_EXACT | EFFECT_LEAK_EXACT, leak_prefixes=LEAK_PREFIXES)
