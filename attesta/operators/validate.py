"""Validators: event grammar, constraints, run ids and output contracts (V-1..V-5, V-8)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_int, text_or_empty
from ..functions.exprs import OPEN_END

# The vocabulary of events.
EVENT_TYPES, RESERVED = ("MOVE", "COHABIT", "BIRTH", "DIVORCE", "LEAVE_HOME"), ("DEATH", "NAME_CHANGE", "ADOPTION")
COHABIT_MODES, CUSTODY_MODES = ("move_to_A", "move_to_B", "new_address"), ("joint", "parent_a_primary", "parent_b_primary", "split")
EVENT_COLUMNS = (
    "EventKey", "EventType", "EventDate", "SubjectPersonKey", "SubjectHouseholdKey", "FromAddressKey", "ToAddressKey", "PersonKeyA", "PersonKeyB", "NewHouseholdKey", "CohabitMode", "ChildPersonKey",
    "Parent1PersonKey", "Parent2PersonKey", "CustodyMode",
)


@dataclass(frozen=True)
class Constraints:
    """V-6. Limits that truth must keep."""

    min_marriage_age: int = 18
    max_partner_age_gap: int | None = 25
    fertility_age_min: int = 15
    fertility_age_max: int = 49
    allow_underage_marriage: bool = False
    allow_child_lives_alone: bool = False
    partner_age_gap_distribution: Mapping[int, float] | None = None

    def __post_init__(self) -> None:
        if self.min_marriage_age < 0 or not 0 <= self.fertility_age_min <= self.fertility_age_max:
            raise ValueError("ages are out of range")

    @property
    def gap(self) -> int | None:
        """The largest key of the distribution, if there is one, else the limit."""
        return max(self.partner_age_gap_distribution) if self.partner_age_gap_distribution else self.max_partner_age_gap


def _errors(checks: Sequence[tuple[Column, str, str]], a: str, b: str) -> Column:
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(x).alias(a), F.lit(y).alias(b))) for c, x, y in checks])
    return F.filter(found, lambda e: e.isNotNull())


def grammar_errors(events: DataFrame) -> DataFrame:
    """V-1. (EventKey, field, error), one row for each fault. Blank counts as missing; types match in any case; unknown and reserved types get no further checks."""
    t = F.upper(text_or_empty(F.col("EventType")))
    blank = lambda c: text_or_empty(F.col(c)) == ""
    same = lambda a, b: (text_or_empty(F.col(a)) == text_or_empty(F.col(b))) & ~blank(a)
    of = lambda kind, c: (t == kind) & c
    checks = [
        (blank("EventKey"), "EventKey", "missing"), (F.col("EventDate").isNull(), "EventDate", "missing"), (t == "", "EventType", "missing"),
        (t.isin(*RESERVED), "EventType", "reserved"), ((t != "") & ~t.isin(*EVENT_TYPES, *RESERVED), "EventType", "unknown"),
        (of("MOVE", blank("SubjectPersonKey") & blank("SubjectHouseholdKey")), "SubjectPersonKey", "no subject"), (of("MOVE", blank("FromAddressKey")), "FromAddressKey", "missing"),
        (of("MOVE", blank("ToAddressKey")), "ToAddressKey", "missing"), (of("MOVE", same("FromAddressKey", "ToAddressKey")), "ToAddressKey", "same address"),
        (of("COHABIT", blank("PersonKeyA")), "PersonKeyA", "missing"), (of("COHABIT", blank("PersonKeyB")), "PersonKeyB", "missing"), (of("COHABIT", same("PersonKeyA", "PersonKeyB")), "PersonKeyB", "same person"),
        (of("COHABIT", blank("NewHouseholdKey")), "NewHouseholdKey", "missing"), (of("COHABIT", ~text_or_empty(F.col("CohabitMode")).isin(*COHABIT_MODES)), "CohabitMode", "invalid"),
        (of("BIRTH", blank("Parent1PersonKey")), "Parent1PersonKey", "missing"), (of("BIRTH", blank("ChildPersonKey")), "ChildPersonKey", "missing"),
        (of("BIRTH", same("Parent1PersonKey", "ChildPersonKey") | same("Parent2PersonKey", "ChildPersonKey")), "ChildPersonKey", "parent is child"), (of("BIRTH", same("Parent1PersonKey", "Parent2PersonKey")), "Parent2PersonKey", "same person"),
        (of("DIVORCE", blank("PersonKeyA")), "PersonKeyA", "missing"), (of("DIVORCE", blank("PersonKeyB")), "PersonKeyB", "missing"), (of("DIVORCE", same("PersonKeyA", "PersonKeyB")), "PersonKeyB", "same person"),
        (of("DIVORCE", ~text_or_empty(F.col("CustodyMode")).isin(*CUSTODY_MODES)), "CustodyMode", "invalid"), (of("LEAVE_HOME", blank("ChildPersonKey")), "ChildPersonKey", "missing"),
    ]
    return events.select("EventKey", F.explode(_errors(checks, "field", "error")).alias("e")).select("EventKey", "e.*")


def _ages(people: DataFrame) -> DataFrame:
    """(PersonKey, Age) of people with a readable age; of several rows of a person the greatest age counts."""
    return people.select("PersonKey", as_int(F.col("Age"), None).alias("Age")).where("Age IS NOT NULL").groupBy("PersonKey").agg(F.max("Age").alias("Age"))


def age_violations(events: DataFrame, people: DataFrame, limits: Constraints, with_gap: bool = True) -> DataFrame:
    """V-2, V-3, J-7. (EventKey, rule, PersonKey): ages at events against the limits; people without a known age are not judged."""
    ages = _ages(people)
    rows, t = events, F.upper(text_or_empty(F.col("EventType")))
    for c, name in (("PersonKeyA", "a"), ("PersonKeyB", "b"), ("Parent1PersonKey", "p"), ("ChildPersonKey", "c")):
        rows = rows.join(ages.select(F.col("PersonKey").alias(c), F.col("Age").alias(f"age_{name}")), c, "left")
    young = lambda c: (t == "COHABIT") & (F.col(c) < limits.min_marriage_age)
    gap = (t == "COHABIT") & (F.abs(F.col("age_a") - F.col("age_b")) > limits.gap) if with_gap and limits.gap is not None else F.lit(False)
    fertile = (t == "BIRTH") & ~F.col("age_p").between(limits.fertility_age_min, limits.fertility_age_max)
    alone = (t == "LEAVE_HOME") & (F.col("age_c") < 18)
    never = F.lit(False)
    rules = [
        (never if limits.allow_underage_marriage else young("age_a"), "min_marriage_age", "PersonKeyA"), (never if limits.allow_underage_marriage else young("age_b"), "min_marriage_age", "PersonKeyB"),
        (gap, "max_partner_age_gap", "PersonKeyA"), (fertile, "fertility_age_range", "Parent1PersonKey"), (never if limits.allow_child_lives_alone else alone, "allow_child_lives_alone", "ChildPersonKey"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.col(k).alias("PersonKey"))) for c, r, k in rules]), lambda e: e.isNotNull())
    return rows.select("EventKey", F.explode(found).alias("e")).select("EventKey", "e.*")


def residence_violations(residence: DataFrame) -> DataFrame:
    """V-2. (PersonKey, rule, n): starts that are missing, ends before starts, and intervals that overlap the one before."""
    from .intervals import interval_violations

    each = interval_violations(residence, "PersonKey", "ResidenceStartDate", "ResidenceEndDate", "AddressKey")
    names = {"start_missing": "residence_date_parse", "end_before_start": "residence_interval_order", "overlaps": "non_overlapping_residence_intervals"}
    return each.select("PersonKey", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("n")) for c, r in names.items()])).alias("e")).select("PersonKey", "e.*").where("n > 0")


RUN_ID = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_[a-z][a-z0-9_]*_seed[0-9]+$"


def run_id(date: str, scenario: str, seed: int) -> str:
    """V-5. YYYY-MM-DD_<scenario>_seed<n>."""
    made = f"{date}_{scenario}_seed{seed}"
    if seed < 0 or not re.match(RUN_ID, made):
        raise ValueError(f"not a run id: {made}")
    return made


def parsed_run_ids(df: DataFrame, column: str) -> DataFrame:
    """V-5. df with run_date, scenario, seed and valid."""
    rx = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})_([a-z][a-z0-9_]*)_seed([0-9]+)$"
    part = lambda i: F.nullif(F.regexp_extract(column, rx, i), F.lit(""))
    return df.withColumns({"run_date": part(1), "scenario": part(2), "seed": part(3).try_cast("long"), "valid": F.coalesce(F.col(column).rlike(rx) & part(1).try_cast("date").isNotNull(), F.lit(False))})


def contract_errors(spark: SparkSession, folder: str, tables: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """V-4. (file, error) for files that are missing or lack columns; only footers and header lines are read."""
    out = []
    for name, columns in tables.items():
        try:
            path = f"{folder}/{name}"
            have = spark.read.csv(path, header=True).columns if name.endswith(".csv") else spark.read.parquet(path).columns
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            out.append((name, "missing"))
            continue
        out += [(name, f"column {c} is missing") for c in columns if c not in have]
    return out


def quality_ok(constraint_violations: int, age_violations_: int, overlaps: int, size_violations: int) -> bool:
    """V-8."""
    return not (constraint_violations or age_violations_ or overlaps or size_violations)


__all__ = [
    "COHABIT_MODES", "CUSTODY_MODES", "EVENT_COLUMNS", "EVENT_TYPES", "OPEN_END", "RESERVED", "Constraints", "age_violations", "contract_errors", "grammar_errors", "parsed_run_ids", "quality_ok", "residence_violations",
    "run_id",
]
