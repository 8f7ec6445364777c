"""Readers, writers and small lookup tables."""

from podium.sources.dimensions import dimension, read_code_dimension
from podium.sources.layout import Layout, buckets_for, lay_out, open_layout, rows_per_bucket
from podium.sources.profiles import file_states, listed_files, merged_profile, refresh_profile
from podium.sources.publishing import publish, publish_partitions
from podium.sources.quarantine import Checked, read_csv_checked, reject_report
from podium.sources.readers import (
    infer_csv_schema,
    read_csv_inferred,
    read_csv_text,
    read_csv_typed,
    read_format,
)
from podium.sources.scratch import clear, scratch_path, shared_dir, stage
from podium.sources.sinks import convert_dialect, export_sorted, observed, write_csv, write_parquet

__all__ = [
    "Checked",
    "Layout",
    "buckets_for",
    "clear",
    "convert_dialect",
    "dimension",
    "export_sorted",
    "file_states",
    "infer_csv_schema",
    "lay_out",
    "listed_files",
    "merged_profile",
    "observed",
    "open_layout",
    "publish",
    "publish_partitions",
    "read_code_dimension",
    "read_csv_checked",
    "read_csv_inferred",
    "read_csv_text",
    "read_csv_typed",
    "read_format",
    "refresh_profile",
    "reject_report",
    "rows_per_bucket",
    "scratch_path",
    "shared_dir",
    "stage",
    "write_csv",
    "write_parquet",
]
