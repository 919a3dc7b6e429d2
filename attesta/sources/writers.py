"""Sinks (K-*)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What exports call each column, the first present one wins, and the order of the linkage export.
ALIASES = {
    "unique_id": ("RecordKey", "A_RecordKey", "B_RecordKey"), "first_name": ("FirstName",), "middle_name": ("MiddleName",), "last_name": ("LastName",), "suffix": ("Suffix",), "full_name": ("FullName",),
    "dob": ("DOB",), "age": ("Age",), "ssn": ("SSN",), "phone": ("Phone",), "address_key": ("AddressKey",), "street_address": ("StreetAddress",), "city": ("City",), "state": ("State",), "zip_code": ("ZipCode",),
    "gender": ("Gender",), "ethnicity": ("Ethnicity",), "source_snapshot_date": ("SourceSnapshotDate",), "source_system": ("SourceSystem",),
}
FUZZY, EXACT, IGNORED = ("FirstName", "MiddleName", "LastName", "FullName"), ("DOB", "SSN", "Phone", "AddressKey", "Gender", "Ethnicity"), ("RecordKey", "SourceDataset")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def guard_targets(df: DataFrame, paths: Sequence[str], overwrite: bool) -> None:
    """K-4. An error before anything is written if a target exists and may not be replaced."""
    if not overwrite and (there := [p for p in paths if path_exists(df.sparkSession, p)]):
        raise FileExistsError(f"exists already: {', '.join(there)}")


def write_csv(df: DataFrame, path: str, overwrite: bool = False, single: bool = False) -> None:
    """K-1, K-3. Nulls as empty cells. single: one file, for small tables that other tools read."""
    (df.coalesce(1) if single else df).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, rows_per_file: int = 0) -> None:
    """K-2, K-3. Parts of at most so many rows, if a number is given."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small document in any file system that Spark knows, written by the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # as a plain file, without the checksum beside it that would refuse later edits
        Path(p.toUri().getPath()).write_text(text, encoding="utf-8")
        return
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def json_text(value: Mapping[str, Any]) -> str:
    return json.dumps(value, indent=2, sort_keys=True, default=str) + "\n"


def write_json(value: Mapping[str, Any], path: str) -> None:
    """K-5. A small document in a local folder."""
    Path(path).write_text(json_text(value), encoding="utf-8")


def upper_keys(value: Any, texts: bool = True) -> Any:
    """P-10. A document with all keys, and texts unless that is off, in upper case, as upper-cased tables have them. Keys that meet are an error."""
    if isinstance(value, Mapping):
        out = {str(k).upper(): upper_keys(v, texts) for k, v in value.items()}
        if len(out) != len(value):
            raise ValueError("keys differ in case only")
        return out
    if isinstance(value, (list, tuple)):
        return [upper_keys(v, texts) for v in value]
    return value.upper() if texts and isinstance(value, str) else value


def yaml_text(value: Mapping[str, Any]) -> str:
    """JSON is YAML; PyYAML, where it is installed, gives the usual style."""
    try:
        import yaml
    except ImportError:
        return json_text(value)
    return yaml.safe_dump(dict(value), sort_keys=False)


def write_yaml(value: Mapping[str, Any], path: str) -> None:
    """K-5."""
    Path(path).write_text(yaml_text(value), encoding="utf-8")


def renamed(df: DataFrame, dataset: str, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """P-6. Columns under the names of an export, in its order, then source_dataset and what is left."""
    used: dict[str, str] = {}
    for new, names in aliases.items():
        if found := next((n for n in names if n in df.columns), None):
            used[found] = new
    if "unique_id" in aliases and "unique_id" not in used.values():
        raise ValueError("no record key column")
    return df.select(*[F.col(o).alias(n) for o, n in used.items()], F.lit(dataset).alias("source_dataset"), *[c for c in df.columns if c not in used])


def splink_settings(n_datasets: int) -> dict[str, Any]:
    return {"link_type": "dedupe_only" if n_datasets == 1 else "link_only", "unique_id_column_name": "unique_id", "blocking_rules_to_generate_predictions": ["l.last_name = r.last_name", "l.dob = r.dob"]}


def export_splink(datasets: Mapping[str, DataFrame], folder: str, overwrite: bool = False) -> dict[str, Any]:
    """K-7. A Parquet folder for each dataset; returns the settings document."""
    paths = {name: f"{folder}/{name}.parquet" for name in datasets}
    for name, df in datasets.items():
        guard_targets(df, [paths[name]], overwrite)
    for name, df in datasets.items():
        write_parquet(renamed(df, name), paths[name], overwrite)
    return splink_settings(len(datasets))


def zingg_fields(df: DataFrame) -> list[dict[str, str]]:
    kind = lambda c: "FUZZY" if c in FUZZY else "EXACT" if c in EXACT else "DONT_USE"
    return [{"fieldName": c, "fields": c, "dataType": "string", "matchType": kind(c)} for c in df.columns]


def export_zingg(datasets: Mapping[str, DataFrame], folder: str, overwrite: bool = False) -> dict[str, Any]:
    """K-8. A CSV folder for each dataset; returns the field definitions."""
    out = {n: df.withColumn("SourceDataset", F.lit(n)) for n, df in datasets.items()}
    for name, df in out.items():
        guard_targets(df, [f"{folder}/{name}.csv"], overwrite)
    for name, df in out.items():
        write_csv(df, f"{folder}/{name}.csv", overwrite)
    return {"fieldDefinition": zingg_fields(next(iter(out.values())))}
