"""Observed datasets from truth: snapshots, coverage, records, noise and answer keys (P-7, P-8, G-17..G-22, X-2, W-5)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import age_on, concat_nonempty, stable_order, title_case
from .allocation import duplication, expanded, range_numbered
from .intervals import asof_address
from .noise import DEFAULT_A, DEFAULT_B, NoiseRates, apply_noise


@dataclass(frozen=True)
class DatasetSpec:
    """One observed dataset: its id, its date, the share of people in it, extra records in percent, and its noise."""

    dataset: str
    snapshot: str
    duplicate_pct: float = 0.0
    noise: NoiseRates | None = None

    def rates(self, position: int) -> NoiseRates:
        return self.noise or (DEFAULT_A if position == 0 else DEFAULT_B)


def snapshot(people: DataFrame, residence: DataFrame, book: DataFrame, day: str) -> DataFrame:
    """P-8, F-5, J-5. People born by the day, with their address of that day and its parts; people without an address stay, with null parts."""
    d = F.lit(day).cast("date")
    eligible = people.where(F.col("DOB").isNull() | (F.col("DOB") <= d))
    rows = eligible.join(asof_address(residence, day), "PersonKey", "left").join(book, "AddressKey", "left")
    return rows.withColumns({"Age": F.coalesce(age_on(F.col("DOB"), d), F.col("Age")), "SourceSnapshotDate": d})


def forces_two(mode: str, position: int) -> bool:
    """Whether people in every dataset have two records at least in the one at this position: the first of many_to_one, the others of one_to_many, all of many_to_many."""
    return mode == "many_to_many" or mode == ("many_to_one" if position == 0 else "one_to_many")


def emit(snap: DataFrame, members: DataFrame, n_members: int, spec: DatasetSpec, position: int, seed: int, nicknames: DataFrame | None = None, n_forced: int = 0) -> DataFrame:
    """G-22. The dataset's rows: members of the snapshot, as many records each as duplication gives, keyed <dataset>-000000001.. in stable order, with noise and its flags.

    members may have a boolean `forced`, true for n_forced people who get two records at least. nicknames (FormalName, variants array) are what that noise draws from.
    """
    forced = F.col("forced") if "forced" in members.columns else None
    counted = duplication(members, "PersonKey", n_members, spec.duplicate_pct, seed, forced, n_forced)
    keys = expanded(counted, "records").select("PersonKey", "copy")
    placed = range_numbered(keys, [*stable_order(F.col("PersonKey")), F.col("copy")], "_n")
    record = F.concat(F.lit(f"{spec.dataset}-"), F.lpad((F.col("_n") + 1).cast("string"), 9, "0"))
    keyed = placed.select("PersonKey", record.alias("RecordKey"), F.lit(spec.dataset).alias("DatasetId")).join(snap, "PersonKey")
    if nicknames is not None:
        keyed = keyed.withColumn("_formal", title_case(F.trim("FirstName"))).join(nicknames.select(F.col("FormalName").alias("_formal"), "variants"), "_formal", "left").drop("_formal")
    noised = apply_noise(keyed, spec.rates(position), seed, nicknames=nicknames is not None).drop("variants")
    return noised.withColumns({"FullName": concat_nonempty(F.col("FirstName"), F.col("MiddleName"), F.col("LastName")), "SourceSystem": F.lit(spec.dataset)})


def entity_record_map(datasets: Sequence[DataFrame]) -> DataFrame:
    """X-2. (PersonKey, DatasetId, RecordKey) of all datasets."""
    out = datasets[0].select("PersonKey", "DatasetId", "RecordKey")
    for d in datasets[1:]:
        out = out.unionByName(d.select("PersonKey", "DatasetId", "RecordKey"))
    return out


def legacy_view(df: DataFrame, side: str) -> DataFrame:
    """P-7. RecordKey as A_RecordKey or B_RecordKey, first."""
    return df.select(F.col("RecordKey").alias(f"{side}_RecordKey"), *[c for c in df.columns if c != "RecordKey"])
