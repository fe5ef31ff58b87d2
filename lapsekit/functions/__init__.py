"""Column-level helpers (all built-in Spark expressions, codegen friendly)."""

from lapsekit.functions.columns import (  # noqa: F401
    ymd_to_date, date_to_ymd, ymd_lit, days_between, month_index, months_between_idx,
    safe_div, r6, clip_low, clip_high, clip, ordered_argmax,
)
