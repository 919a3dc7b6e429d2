"""Sources (S-*)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" in an all-text read.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The parameter tables and the columns each must have.
PARAMETERS = {
    "mobility_overall": ("metric_id", "value_pct", "source_id"),
    "mobility_by_age_cohort": ("age_cohort_id", "moved_past_year_pct", "source_id"),
    "marriage_divorce_rates": ("metric_id", "value", "source_id"),
    "fertility_by_age": ("age_group", "birth_rate_per_1000_women", "source_id"),
    "household_type_shares": ("household_type_id", "share_of_all_households_pct", "source_id"),
}


def read_csv_lenient(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """S-1. Text columns by place: a byte-order mark is skipped, cells are trimmed, blank rows dropped, short rows padded and long ones cut."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True, encoding="UTF-8")
    clean = raw.select(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", "")).alias(c) for c in columns])
    return clean.where(F.concat(*[F.col(c) for c in columns]) != "")


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """S-2. Every column as text, with the usual spellings of a missing value as null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S-4, S-5. One file or a folder of parts."""
    return spark.read.parquet(path)


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """S-6. Column names alone, from a footer or a header line."""
    return spark.read.csv(path, header=True).columns if path.rstrip("/").endswith(".csv") else spark.read.parquet(path).columns


def check_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    """B-4. df, if it has the columns; else an error that names those missing."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")
    return df


def parsed(text: str, name: str) -> dict[str, Any]:
    """A JSON or YAML document, by its name, that is a mapping. PyYAML is optional; without it the subset that JSON covers is read."""
    try:
        if name.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                value = json.loads(text)
            else:
                try:
                    value = yaml.safe_load(text)
                except yaml.YAMLError as e:
                    raise ValueError(f"{name}: not YAML") from e
        else:
            value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{name}: not JSON") from e
    if not isinstance(value, dict):
        raise ValueError(f"{name}: not a mapping")
    return value


def read_text(spark: SparkSession, path: str) -> str:
    """A small document from any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    row = spark.read.text(path, wholetext=True).first()
    return row.value if row else ""


def load_json(path: str) -> dict[str, Any]:
    """S-7. A JSON document that is an object, from a local folder."""
    return parsed(Path(path).read_text(encoding="utf-8"), path)


def load_yaml(path: str) -> dict[str, Any]:
    """S-8. A YAML document that is a mapping, from a local folder."""
    return parsed(Path(path).read_text(encoding="utf-8"), path if path.endswith((".yaml", ".yml")) else f"{path}.yaml")


def load_parameters(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S-11. All parameter tables of a folder, each with its columns checked."""
    return {name: check_columns(spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True), columns, name) for name, columns in PARAMETERS.items()}


def nickname_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S-9. (category, formal, nickname, weight) from {category: {formal: {nicknames: [], weights: []}}}: weights summed, only positive ones, no name its own nickname."""
    kind = "map<string,map<string,struct<nicknames:array<string>,weights:array<double>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = text.select(F.explode("m").alias("category", "names")).select("category", F.explode("names").alias("formal", "v"))
    rows = rows.select("category", "formal", F.explode(F.arrays_zip("v.nicknames", "v.weights")).alias("p")).select("category", "formal", F.col("p.nicknames").alias("nickname"), F.col("p.weights").alias("weight"))
    return rows.groupBy("category", "formal", "nickname").agg(F.sum("weight").alias("weight")).where((F.col("weight") > 0) & (F.lower("nickname") != F.lower("formal")))


def scenario_status_counts(entries: DataFrame) -> DataFrame:
    """S-12, A-30. (status, n) of catalogue entries with an id; a blank status is unknown."""
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown"))
    return entries.where(F.coalesce(F.trim("scenario_id"), F.lit("")) != "").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def parameters_of(values: Mapping[str, Any], section: str) -> dict[str, Any]:
    """A section of a configuration as a dict; an absent one is empty."""
    found = values.get(section) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{section}: not a mapping")
    return dict(found)
