"""Configuration dataclasses (they replace the reference's command-line flags)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelConfig:
    """Canonical column names and scoring parameters of a daily panel."""

    id_col: str = "id"
    day_col: str = "day"
    date_col: str | None = "start_date"
    treatment_col: str | None = "treatment"
    treatment_type_col: str | None = "treatment_type"
    wellbeing_col: str = "overall_wellbeing"
    items: tuple[str, ...] | None = None          # None: resolve from the symptom alias list
    use_precomputed_s: bool = False
    alpha: float = 1.0
    beta: float = 1.0
    include_current: bool = False                 # rolling windows include the current row (effect copy)
    label_prefix: str = "U"                       # "U" (forecasting copy) or "Y" (effect copy)
    horizons: int = 14
    inj_codes: tuple[int, ...] = (1, 2)

    @property
    def order_cols(self) -> list[str]:
        return [self.day_col] + ([self.date_col] if self.date_col else [])


@dataclass(frozen=True)
class EventConfig:
    """Event-study windows: L pre days, H post days, outcome column."""

    L: int = 3
    H: int = 3
    outcome_col: str = "U_t"
    inj_codes: tuple[int, ...] = (1, 2)
    max_controls_per_id: int | None = None
    baseline: str = "pre_last"       # "pre_last" (current), "course_mean" / "centre" (older definitions)
    require_codes: bool = True        # older treated definition ignores the type code
    block_retreatment: bool = True    # older treated definition allows coded treatment in the post window
