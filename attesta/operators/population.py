"""Population selection: one row per person, latent traits, filters with counts, exact samples (P-*, F-*, A-22)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_int, clip, hash_unit, norm_text, stable_order
from .allocation import numbered

# Bases by age bin, with what applies elsewhere, and the weight of the random part.
PARTNERSHIP = {"age_0_17": 0.08, "age_18_34": 0.72, "age_35_64": 0.56, "age_65_plus": 0.30}
FERTILITY = {"age_0_17": 0.10, "age_18_34": 0.76, "age_35_64": 0.25, "age_65_plus": 0.03}
PARTNERSHIP_ELSE, FERTILITY_ELSE, MOBILITY_ELSE = 0.45, 0.30, 0.10
WIDTHS = {"Mobility": 0.08, "Partnership": 0.30, "Fertility": 0.30}
BUCKETS = {"Mobility": (0.09, 0.18), "Partnership": (0.33, 0.66), "Fertility": (0.33, 0.66)}
#: Buckets of the hash by which a sample's rows are counted.
BUCKETS_OF_SAMPLE = 4096
MOBILITY_DEFAULTS = {"age_0_17": 0.10, "age_18_34": 0.20, "age_35_64": 0.09, "age_65_plus": 0.06}


def entity_view(records: DataFrame) -> DataFrame:
    """P-1. A row per person: first AgeBin, Gender and Ethnicity and last ResidenceType that are not null, by record index and key; number of records and profile."""
    order = "struct(_index, _key, RecordKey)"
    rows = records.withColumns({"_index": as_int(F.col("EntityRecordIndex")), "_key": as_int(F.col("RecordKey"))})
    pick = lambda how, c: F.expr(f"{how}({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    out = rows.groupBy("PersonKey").agg(*[pick("min_by", c) for c in ("AgeBin", "Gender", "Ethnicity")], pick("max_by", "ResidenceType"), F.count("*").alias("RecordsPerEntity"))
    return out.withColumn("RedundancyProfile", F.when(F.col("RecordsPerEntity") <= 1, "single_record").otherwise("multi_record"))


def person_baseline(records: DataFrame, selected: DataFrame) -> DataFrame:
    """P-2. Selected people with identity from their first record and address and residence from their last, and their scores.

    Selected keys without records come out with null identity; missing_keys() names them.
    """
    order = "struct(_index, _key, RecordKey)"
    rows = records.join(selected.select("PersonKey"), "PersonKey", "left_semi").withColumns({"_index": as_int(F.col("EntityRecordIndex")), "_key": as_int(F.col("RecordKey"))})
    have = set(records.columns)
    first = [c for c in ("FormalFirstName", "MiddleName", "LastName", "Suffix", "Gender", "Ethnicity", "DOB", "Age", "AgeBin", "SSN", "Phone") if c in have]
    last = [c for c in ("AddressKey", "ResidenceType", "ResidenceStartDate") if c in have]
    agg = [F.expr(f"min_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in first] + [F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in last]
    scores = [c for c in selected.columns if c.endswith("PropensityScore")]
    return selected.select("PersonKey", *scores).join(rows.groupBy("PersonKey").agg(*agg), "PersonKey", "left")


def missing_keys(selected: DataFrame, records: DataFrame, key: str = "PersonKey") -> DataFrame:
    """J-12. Keys that are asked for but have no record."""
    return selected.select(key).distinct().join(records.select(key), key, "left_anti")


def mobility_base(cohorts: DataFrame) -> DataFrame:
    """P-5. (AgeBin, Base) from cohort percentages: 18-34 is the mean of its two cohorts weighted by population; bins without data get the defaults."""
    bin_of = F.create_map(*[F.lit(x) for p in {"0_17": "age_0_17", "18_24": "age_18_34", "25_34": "age_18_34", "35_64": "age_35_64", "65_plus": "age_65_plus"}.items() for x in p])
    rows = cohorts.select(bin_of[F.regexp_replace(F.col("age_cohort_id"), "^age_", "")].alias("AgeBin"), (F.col("moved_past_year_pct") / 100).alias("p"), F.col("population").cast("double").alias("n")).where("AgeBin IS NOT NULL")
    known = rows.groupBy("AgeBin").agg((F.sum(F.col("p") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1.0))).alias("Known"))
    bins = F.explode(F.create_map(*[F.lit(x) for p in MOBILITY_DEFAULTS.items() for x in p])).alias("AgeBin", "Default")
    every = cohorts.sparkSession.range(1).select(bins)
    return every.join(known, "AgeBin", "left").select("AgeBin", F.coalesce("Known", "Default").alias("Base"))


def _by_bin(values: Mapping[str, float], otherwise: float) -> Column:
    table = F.create_map(*[F.lit(x) for p in values.items() for x in p])
    return F.coalesce(table[norm_text(F.col("AgeBin"))], F.lit(otherwise))


def bucketize(score: Column, low: float, high: float) -> Column:
    """P-4. low at or below the first cut, high at or above the second, else medium; the low test comes first."""
    return F.when(score <= low, "low").when(score >= high, "high").otherwise("medium")


def latent_traits(view: DataFrame, seed: int, mobility: Mapping[str, float] = MOBILITY_DEFAULTS, cuts: Mapping[str, tuple[float, float]] = BUCKETS) -> DataFrame:
    """P-3. Mobility, partnership and fertility scores, six digits, half to even, with buckets by the cuts. Age bins match in any case."""
    bases = {"Mobility": _by_bin(mobility, MOBILITY_ELSE), "Partnership": _by_bin(PARTNERSHIP, PARTNERSHIP_ELSE), "Fertility": _by_bin(FERTILITY, FERTILITY_ELSE)}
    scores = {f"{k}PropensityScore": F.bround(clip(b + (hash_unit(seed, k.lower(), "PersonKey") - 0.5) * WIDTHS[k]), 6) for k, b in bases.items()}
    buckets = {f"{k}PropensityBucket": bucketize(F.col(f"{k}PropensityScore"), *cuts[k]) for k in bases}
    return view.withColumns(scores).withColumns(buckets)


def category_filter(column: str, values: Sequence[str]) -> Column:
    """F-1. Equal to one of the values but for case and blanks around; no values mean no filter."""
    return norm_text(F.col(column)).isin([v.strip().lower() for v in values]) if values else F.lit(True)


@dataclass(frozen=True)
class Selection:
    """V-6. What a scenario selects: a sample of those that pass all filters, and the cuts of the score buckets. Empty filters let everybody pass."""

    mode: str = "pct"
    value: float = 100.0
    age_bins: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    ethnicities: tuple[str, ...] = ()
    residence_types: tuple[str, ...] = ()
    redundancy_profiles: tuple[str, ...] = ()
    mobility_buckets: tuple[str, ...] = ()
    mobility_cuts: tuple[float, float] = BUCKETS["Mobility"]
    trait_cuts: tuple[float, float] = BUCKETS["Partnership"]

    def __post_init__(self) -> None:
        if self.mode not in ("all", "count", "pct"):
            raise ValueError(f"unknown sample mode {self.mode!r}")
        if self.value < 0 or (self.mode == "count" and int(self.value) != self.value) or (self.mode == "pct" and self.value > 100):
            raise ValueError("a sample is a whole number of people or a percentage")
        for low, high in (self.mobility_cuts, self.trait_cuts):
            if not 0 <= low <= high <= 1:
                raise ValueError("cuts rise from 0 to 1")
        if bad := set(self.redundancy_profiles) - {"single_record", "multi_record"}:
            raise ValueError(f"unknown redundancy profiles: {', '.join(sorted(bad))}")
        if bad := {b.lower() for b in self.mobility_buckets} - {"low", "medium", "high"}:
            raise ValueError(f"unknown buckets: {', '.join(sorted(bad))}")

    @property
    def cuts(self) -> dict[str, tuple[float, float]]:
        return {"Mobility": self.mobility_cuts, "Partnership": self.trait_cuts, "Fertility": self.trait_cuts}

    def stages(self) -> list[tuple[str, Column]]:
        """The filters in their order."""
        columns = {
            "age_bins": ("AgeBin", self.age_bins), "genders": ("Gender", self.genders), "ethnicities": ("Ethnicity", self.ethnicities), "residence_types": ("ResidenceType", self.residence_types),
            "redundancy_profiles": ("RedundancyProfile", self.redundancy_profiles), "mobility_propensity_buckets": ("MobilityPropensityBucket", self.mobility_buckets),
        }
        return [(name, category_filter(c, v)) for name, (c, v) in columns.items()]


def select_people(records: DataFrame, selection: Selection, seed: int, mobility: Mapping[str, float] = MOBILITY_DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Selected people with their traits, and (stage, position, remaining) of the filters."""
    passed, counts = filter_cascade(latent_traits(entity_view(records), seed, mobility, selection.cuts), selection.stages())
    return exact_sample(passed, "PersonKey", selection.mode, selection.value, seed), counts


def filter_cascade(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """F-2. What passes all stages, and (stage, position, remaining) with counts after each, from one scan."""
    so_far, sums = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, p) in enumerate(stages, 1):
        so_far = so_far & F.coalesce(p, F.lit(False))
        sums.append(F.sum(so_far.cast("long")).alias(f"s{k}"))
    names = ["all", *(n for n, _ in stages)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(k).alias("position"), F.coalesce(F.col(f"s{k}"), F.lit(0).cast("long")).alias("remaining")) for k, n in enumerate(names)]))
    return df.where(so_far), df.agg(*sums).select(rows.alias("r")).select("r.*")


def sample_size(n: int, mode: str, value: float) -> int:
    """F-3. all, a count, or a percentage rounded half to even but at least one."""
    if mode == "all":
        return n
    if mode == "count":
        return min(n, int(value))
    if mode != "pct":
        raise ValueError(f"unknown sample mode {mode!r}")
    return min(n, max(1, round(value * n / 100))) if value > 0 and n else 0


def exact_sample(df: DataFrame, key: str, mode: str, value: float, seed: int, salt: str = "sample") -> DataFrame:
    """F-3, F-4. Exactly so many rows, those with the least hashes.

    Rows are counted by hash bucket; a filter keeps the buckets below the one where the count is reached, and only that one is ranked. So no row of the sample is shuffled but a
    few thousandths of all. Everybody is a sample without a count.
    """
    if mode == "all" or (mode == "pct" and value >= 100):
        return df
    u = hash_unit(seed, salt, key)
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * (BUCKETS_OF_SAMPLE - 1)).cast("long"))
    counts = sorted((r["_b"], r["n"]) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).collect())  # as many rows as there are buckets
    left, below = sample_size(sum(c for _, c in counts), mode, value), -1
    for b, c in counts:
        if c > left:
            break
        below, left = b, left - c
    whole = rows.where(F.col("_b") <= below)
    if left <= 0:
        return whole.drop("_u", "_b")
    edge = next(b for b, _ in counts if b > below)
    fine = F.floor((F.col("_u") * (BUCKETS_OF_SAMPLE - 1) - edge) * BUCKETS_OF_SAMPLE).cast("long")
    part = numbered(rows.where(F.col("_b") == edge), [F.col("_u"), F.col(key)], fine, "_rank").where(F.col("_rank") < left).drop("_rank")
    return whole.unionByName(part).drop("_u", "_b")


def selection_checksum(df: DataFrame, key: str = "PersonKey") -> DataFrame:
    """A-22. (selected, checksum): SHA-256 of the keys in stable order, joined by "|".

    The digest is of one ordered text, so the keys meet in one task; they are keys alone, of a selection that a run has made.
    """
    a, b = stable_order(F.col("k"))
    keys = df.select(F.col(key).cast("string").alias("k")).select(F.struct(a.alias("a"), b.alias("b"), "k").alias("o"))
    return keys.agg(F.count("*").alias("selected"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["k"]), "|"), 256).alias("checksum"))
