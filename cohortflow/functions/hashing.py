"""Portable deterministic pseudo-random numbers.

Draws, splits and folds are derived from ``md5`` of a text key so that Spark and
any SQL engine compute the same values, independent of partitioning and task
retries (a re-run task redraws exactly the same numbers).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 60 bits of the md5 digest (15 hex digits) fit in a signed BIGINT.
HASH_HEX_DIGITS = 15
HASH_RANGE = float(16 ** HASH_HEX_DIGITS)


def hash_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_bigint(*parts) -> Column:
    """Non-negative 60-bit integer from md5 of the ':'-joined parts."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform number in [0, 1) from the same digest."""
    return hash_bigint(*parts).cast("double") / F.lit(HASH_RANGE)


def sql_hash_bigint(expr: str) -> str:
    """The same integer in DuckDB SQL (used by the oracle queries)."""
    return f"('0x' || substr(md5({expr}), 1, {HASH_HEX_DIGITS}))::BIGINT"
