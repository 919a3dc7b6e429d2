"""Readers and writers (S-*, K-*), and the shared folder in which long jobs cut their lineage."""

from .checkpoints import cut_lineage
from .readers import check_columns, load_json, load_parameters, load_yaml, nickname_catalogue, read_csv_lenient, read_csv_strings, read_parquet, table_columns
from .writers import export_splink, export_zingg, guard_targets, write_csv, write_json, write_parquet, write_yaml

__all__ = [
    "check_columns", "cut_lineage", "export_splink", "export_zingg", "guard_targets", "load_json", "load_parameters", "load_yaml", "nickname_catalogue", "read_csv_lenient",
    "read_csv_strings", "read_parquet", "table_columns", "write_csv", "write_json", "write_parquet", "write_yaml",
]
