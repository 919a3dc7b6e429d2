"""Scalar functions as column expressions: hashing for reproducible decisions, and text, date and number helpers."""

from .exprs import (
    age_on,
    as_date,
    as_int,
    clip,
    concat_nonempty,
    interval_contains,
    norm_text,
    stable_order,
    text_or_empty,
    title_case,
    years_before,
)
from .hashing import digest_text, hash_int, hash_unit, int_text, unit_text

__all__ = ["age_on", "as_date", "as_int", "clip", "concat_nonempty", "digest_text", "hash_int", "hash_unit", "int_text", "interval_contains", "norm_text", "stable_order", "text_or_empty", "title_case", "unit_text", "years_before"]
