"""Schema resolution of raw diaries (S1-S3) and lossy coercion.

The driver resolves roles once from ``df.columns`` and emits a single ``select``
of canonical columns, so the resolution costs nothing on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.functions.scalar import parse_dayfirst_date, to_num

# --- fixed values: spellings accepted for each role, first present wins -------------
ROLE_ALIASES: dict[str, list[str]] = {
    "id": ["ID", "id"],
    "day": ["Day", "day"],
    "start_date": ["StartDate", "start_date"],
    "treatment": ["Treatment", "treatment"],
    "treatment_type": ["TreatmentType", "treatment_type"],
    "overall_wellbeing": ["OverallWellbeing", "overall_wellbeing"],
    "mean_symptom_score_active": ["mean_symptom_score_active"],
    "total_symptom_score": ["total_symptom_score"],
    "symptom_count": ["symptom_count"],
    "max_symptom_score": ["max_symptom_score"],
    "symptom_variability": ["symptom_variability"],
    "cognitive_mean": ["cognitive_mean"],
    "neuro_mean": ["neuro_mean"],
    "painfatigue_mean": ["painfatigue_mean"],
}

# --- fixed values: the eleven symptom items, canonical spelling then display spelling ---
SYMPTOM_ITEMS: dict[str, list[str]] = {
    "tiredness": ["tiredness", "Tiredness"],
    "poor_concentration": ["poor_concentration", "Poor concentration"],
    "irritability": ["irritability", "Irritability"],
    "intestinal_problems": ["intestinal_problems", "Intestinal problems"],
    "memory_loss": ["memory_loss", "Memory loss"],
    "muscle_pain": ["muscle_pain", "Muscle pain"],
    "nerve_pain": ["nerve_pain", "Nerve pain"],
    "pins_and_needles": ["pins_and_needles", "Pins and needles"],
    "tinnitus": ["tinnitus", "Tinnitus"],
    "word_finding_difficulties": ["word_finding_difficulties", "Word-finding difficulties"],
    "dizziness": ["dizziness", "Dizziness"],
}

REQUIRED_ROLES = ("id", "day", "overall_wellbeing")
NUMERIC_ROLES = ("overall_wellbeing", "mean_symptom_score_active", "total_symptom_score", "symptom_count",
                 "max_symptom_score", "symptom_variability", "cognitive_mean", "neuro_mean", "painfatigue_mean")


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    """First spelling that is a column of ``df``."""
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def any_present(df: DataFrame, candidates: list[str]) -> list[str]:
    """All spellings that are columns of ``df`` (S3)."""
    cols = set(df.columns)
    return [c for c in candidates if c in cols]


def resolve_items(df: DataFrame, items: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Canonical item -> source column, one spelling per item (never counted twice)."""
    items = items or SYMPTOM_ITEMS
    out = {}
    for canon, spellings in items.items():
        src = first_present(df, spellings)
        if src is not None:
            out[canon] = src
    return out


def canonical_diary(df: DataFrame, overrides: dict[str, str] | None = None,
                    items: dict[str, list[str]] | None = None) -> DataFrame:
    """Resolve roles and items, coerce types, return one ``select`` of canonical columns.

    Missing id, day or wellbeing raises; other roles are optional and skipped.
    Day becomes INT (bad text -> NULL), the date is parsed day-first, numbers are
    cast with ``try_cast`` so bad text becomes NULL instead of failing the job.
    """
    overrides = overrides or {}
    roles = {r: overrides.get(r) or first_present(df, a) for r, a in ROLE_ALIASES.items()}
    missing = [r for r in REQUIRED_ROLES if roles[r] is None]
    if missing:
        raise ValueError(f"missing required column(s): {missing}")
    sel = [F.col(roles["id"]).alias("id"),
           to_num(roles["day"], "double").cast("int").alias("day")]
    src_date = roles["start_date"]
    if src_date is not None:
        dt = df.schema[src_date].dataType
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            sel.append(F.to_date(F.col(src_date)).alias("start_date"))
        else:
            sel.append(parse_dayfirst_date(src_date).alias("start_date"))
    if roles["treatment"] is not None:
        sel.append(to_num(roles["treatment"]).alias("treatment"))
    if roles["treatment_type"] is not None:
        sel.append(to_num(roles["treatment_type"]).cast("int").alias("treatment_type"))
    for r in NUMERIC_ROLES:
        if roles[r] is not None:
            sel.append(to_num(roles[r]).alias(r))
    for canon, src in resolve_items(df, items).items():
        sel.append(to_num(src).alias(canon))
    return df.select(*sel)


def read_diary_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with header; blanks become NULL.

    Pass an explicit schema in production; without one every column is read as
    text and typed by ``canonical_diary`` (no inference pass over the data).
    """
    r = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)
