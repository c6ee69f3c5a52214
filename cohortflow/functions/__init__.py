from cohortflow.functions.scalar import (  # noqa: F401
    to_num, parse_dayfirst_date, zero_as_null, row_mean, row_count, row_sum, row_max, row_sd_samp,
    clamp, safe_div, scrub_nonfinite, treatment_flag, day_of_week, dow_sin, dow_cos,
    logspace, normal_quantile,
)
from cohortflow.functions.hashing import hash_bigint, hash_uniform  # noqa: F401
