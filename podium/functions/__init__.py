"""Column expressions: predicates, bands and rates."""

from podium.functions.bands import Bands
from podium.functions.predicates import in_scope, is_missing, is_present, violates_format
from podium.functions.rates import change_pct, percent_text, ratio_pct, share_pct

__all__ = [
    "Bands",
    "change_pct",
    "in_scope",
    "is_missing",
    "is_present",
    "percent_text",
    "ratio_pct",
    "share_pct",
    "violates_format",
]
