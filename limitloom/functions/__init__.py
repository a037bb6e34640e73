from limitloom.functions.calendar import (
    as_date,
    completed_months,
    mob,
    mob_rounded,
    month_diff,
    month_floor,
    month_key,
    month_start,
    within_days,
    within_months,
)
from limitloom.functions.conditional import cond_count, cond_sum, flag
from limitloom.functions.documents import at_path, document
from limitloom.functions.money import ceil_to, clamp, dollars, round_to, safe_ratio, zero_if_null
from limitloom.functions.rules import Rung, all_of, any_of, band, first_match, ladder
from limitloom.functions.scores import clean_score, floor_at_zero, score_bucket

__all__ = [
    "Rung",
    "all_of",
    "any_of",
    "as_date",
    "at_path",
    "band",
    "ceil_to",
    "clamp",
    "clean_score",
    "completed_months",
    "cond_count",
    "cond_sum",
    "document",
    "dollars",
    "first_match",
    "flag",
    "floor_at_zero",
    "ladder",
    "mob",
    "mob_rounded",
    "month_diff",
    "month_floor",
    "month_key",
    "month_start",
    "round_to",
    "safe_ratio",
    "score_bucket",
    "within_days",
    "within_months",
    "zero_if_null",
]
