from cohortflow.sources.resolve import (  # noqa: F401
    ROLE_ALIASES, SYMPTOM_ITEMS, first_present, any_present, resolve_items, canonical_diary, read_diary_csv,
)
from cohortflow.sources.tables import read_table, diary_from_events, diary_from_orders  # noqa: F401
