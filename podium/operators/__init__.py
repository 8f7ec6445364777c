"""DataFrame-to-DataFrame operators."""

from podium.operators.distinct import distinct_rows, distinct_sketches, merge_sketches, row_digest, sketch_estimates, standard_error
from podium.operators.exact import exact_means, exact_moments, exact_sums
from podium.operators.inference import infer_types, schema_of
from podium.operators.offsets import compare_offsets, compare_offsets_sql, enrich
from podium.operators.quality import (
    distinct_row_count,
    drop_columns_matching,
    format_report,
    impute_means,
    leak_summary,
    leaked_rows,
    missing_by_group,
    null_fractions,
    null_profile,
    sentinel_by_group,
    sentinel_profile,
    table_profile,
)
from podium.operators.ranking import leaders, modal_bands, modes_of_counts, rollup_pages, rollup_text, top_k
from podium.operators.sets import distinct_values, union_all
from podium.operators.shared import SharedCounts, shared_counts
from podium.operators.tally import tally
from podium.operators.trend import growth, growth_and_share

__all__ = [
    "SharedCounts",
    "compare_offsets",
    "compare_offsets_sql",
    "distinct_row_count",
    "distinct_rows",
    "distinct_sketches",
    "distinct_values",
    "drop_columns_matching",
    "enrich",
    "exact_means",
    "exact_moments",
    "exact_sums",
    "format_report",
    "growth",
    "growth_and_share",
    "impute_means",
    "infer_types",
    "leaders",
    "leak_summary",
    "leaked_rows",
    "merge_sketches",
    "missing_by_group",
    "modal_bands",
    "modes_of_counts",
    "null_fractions",
    "null_profile",
    "rollup_pages",
    "rollup_text",
    "row_digest",
    "schema_of",
    "sentinel_by_group",
    "sentinel_profile",
    "shared_counts",
    "sketch_estimates",
    "standard_error",
    "table_profile",
    "tally",
    "top_k",
    "union_all",
]
