"""Prepared inputs, run folders and bundles (K-6, K-9, K-10, S-13, R-5, SC-22)."""

from __future__ import annotations

import os
import shutil
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .readers import check_columns, parsed, read_text
from .writers import guard_targets, json_text, path_exists, write_parquet, write_text

# The tables of a prepared cache and their columns; nicknames are optional.
CACHE = {
    "first_names": ("name", "sex", "weight"), "last_names": ("last_name", "ethnicity", "weight"), "streets": ("value", "position"), "cities": ("value", "position"), "states": ("value", "position"), "demographics": ("Ethnicity", "pct"),
}
OPTIONAL = {"nicknames": ("category", "formal", "nickname", "weight")}


def listing(spark: SparkSession, pattern: str) -> list[tuple[str, str, int]]:
    """(folder, name, time of change) of what matches a pattern, in any file system that Spark knows; names in order. A folder that isn't there has nothing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted((f.getPath().getParent().toString(), f.getPath().getName(), f.getModificationTime()) for f in found or [])


def build_cache(tables: Mapping[str, DataFrame], folder: str, overwrite: bool = False) -> dict[str, Any]:
    """K-6. Write prepared tables after a check of names, columns and targets; returns the manifest, which the folder also holds."""
    if missing := sorted(set(CACHE) - set(tables)):
        raise ValueError(f"missing tables: {', '.join(missing)}")
    known = CACHE | OPTIONAL
    checked = {n: check_columns(df, known[n], n) for n, df in tables.items()}
    first = next(iter(checked.values()))
    guard_targets(first, [f"{folder}/{n}.parquet" for n in checked], overwrite)
    for n, df in checked.items():
        write_parquet(df, f"{folder}/{n}.parquet", overwrite)
    manifest = {"tables": {n: list(df.columns) for n, df in checked.items()}}
    write_text(first.sparkSession, json_text(manifest), f"{folder}/manifest.json")
    return manifest


def load_cache(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S-13. The prepared tables of a folder; an error names those missing; nicknames may be."""
    have = {name.removesuffix(".parquet") for _, name, _ in listing(spark, f"{folder}/*.parquet")}
    if missing := sorted(set(CACHE) - have):
        raise FileNotFoundError(f"missing tables: {', '.join(missing)}")
    known = CACHE | OPTIONAL
    return {n: check_columns(spark.read.parquet(f"{folder}/{n}.parquet"), known[n], n) for n in known if n in have}


def datasets_of(folder: str) -> list[str]:
    """K-10. Observed datasets of a run: those its manifest names, else those whose files are there, else the old A and B."""
    spark = SparkSession.active()
    manifest = f"{folder}/manifest.json"
    if path_exists(spark, manifest) and (named := [t for t in parsed(read_text(spark, manifest), manifest).get("tables", []) if t.startswith("observed_")]):
        return sorted(named)
    found = [name.removesuffix(".csv") for _, name, _ in listing(spark, f"{folder}/observed_*.csv")]
    return found or [n for n in ("DatasetA", "DatasetB") if path_exists(spark, f"{folder}/{n}.csv")]


def recent_run_folders(root: str, n: int = 10, contains: str = "") -> list[str]:
    """O-5, R-5. Names of run folders with a manifest, the newest first."""
    runs = [(folder.rsplit("/", 1)[-1], changed) for folder, _, changed in listing(SparkSession.active(), f"{root}/*/manifest.json")]
    return [name for name, changed in sorted(runs, key=lambda r: (-r[1], r[0])) if contains in name][:n]


def bundle(folder: str, target: str) -> float:
    """K-9. A folder as a zip file; returns its size in MB."""
    made = shutil.make_archive(target.removesuffix(".zip"), "zip", folder)
    return round(os.path.getsize(made) / 1e6, 2)


def set_path(values: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """SC-22. values with a nested entry set by a dotted path; maps on the way are made where they are missing."""
    at = values
    *way, last = path.split(".")
    for k in way:
        at = at.setdefault(k, {})
        if not isinstance(at, dict):
            raise ValueError(f"{path}: {k} is not a mapping")
    at[last] = value
    return values
