import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import er, intervals, reports, validate

D = dt.date


def keys(spark, rows):
    return spark.createDataFrame(rows, "PersonKey string, RecordKey string")


def walk(spark, mode):
    a, b = keys(spark, [("1", "a1"), ("1", "a2"), ("2", "a3"), ("4", "a4")]), keys(spark, [("1", "b1"), ("2", "b2"), ("2", "b3"), ("3", "b4")])
    return {tuple(r) for r in er.crosswalk(a, b, mode).collect()}


def test_crosswalk_modes(spark):
    one = {("3", None, "b4"), ("4", "a4", None)}
    assert walk(spark, "one_to_one") == one | {("1", "a1", "b1"), ("1", "a2", None), ("2", "a3", "b2"), ("2", None, "b3")}
    assert walk(spark, "one_to_many") == one | {("1", "a1", "b1"), ("1", "a2", None), ("2", "a3", "b2"), ("2", "a3", "b3")}
    assert walk(spark, "many_to_one") == one | {("1", "a1", "b1"), ("1", "a2", "b1"), ("2", "a3", "b2"), ("2", None, "b3")}
    assert walk(spark, "many_to_many") == one | {("1", "a1", "b1"), ("1", "a2", "b1"), ("2", "a3", "b2"), ("2", "a3", "b3")}
    with pytest.raises(ValueError):
        walk(spark, "some")


def test_interval_violations(spark):
    rows = [("1", "A", D(2026, 1, 1), D(2026, 1, 31)), ("1", "B", D(2026, 1, 31), None), ("2", "C", D(2026, 2, 1), D(2026, 1, 1)), ("3", "D", None, None), ("3", "E", D(2026, 1, 1), None), ("4", "F", D(2026, 1, 1), None)]
    got = {r[0]: tuple(r)[1:] for r in intervals.interval_violations(spark.createDataFrame(rows, "p string, k string, s date, e date"), "p", "s", "e", "k").collect()}
    assert got == {"1": (0, 0, 1), "2": (0, 1, 0), "3": (1, 0, 0)}


def test_sweep(spark):
    rows = [("H1", "1", D(2026, 1, 1), D(2026, 1, 31)), ("H2", "1", D(2026, 2, 1), None), ("H2", "2", D(2026, 2, 1), None), (None, "3", D(2026, 1, 1), None)]
    got = {r.HouseholdKey: (r.points, r.peak) for r in intervals.sweep(spark.createDataFrame(rows, "HouseholdKey string, PersonKey string, MembershipStartDate date, MembershipEndDate date")).collect()}
    assert got == {"H1": (1, 1), "H2": (1, 2)}


def test_asof_falls_back_only_if_nobody_is_active(spark):
    rows = [("1", "A", D(2026, 1, 1), D(2026, 1, 31)), ("1", "B", D(2026, 2, 1), None), ("2", "C", D(2026, 1, 1), D(2026, 1, 10))]
    df = spark.createDataFrame(rows, "PersonKey string, AddressKey string, ResidenceStartDate date, ResidenceEndDate date")
    asof = lambda *a: {tuple(r) for r in intervals.asof_address(*a).collect()}
    assert asof(df, "2026-02-15") == {("1", "B")}
    assert asof(df, "2026-02-15", True) == {("1", "B"), ("2", "C")}
    assert asof(df.where("PersonKey = '2'"), "2026-02-15") == {("2", "C")}


def test_event_rules(spark):
    none = dict.fromkeys(validate.EVENT_COLUMNS)
    events = [
        none | {"EventKey": "E1", "EventType": "cohabit", "EventDate": D(2026, 1, 1), "PersonKeyA": "1", "PersonKeyB": "2", "NewHouseholdKey": "H", "CohabitMode": "move_to_A"},
        none | {"EventKey": "E2", "EventType": "BIRTH", "EventDate": D(2026, 1, 1), "Parent1PersonKey": "3", "ChildPersonKey": "3"}, none | {"EventKey": "E3", "EventType": "DEATH", "EventDate": D(2026, 1, 1)},
        none | {"EventKey": "E4", "EventType": "MOVE", "EventDate": None, "SubjectPersonKey": " ", "FromAddressKey": "A", "ToAddressKey": "A"},
    ]
    df = spark.createDataFrame([tuple(e[c] for c in validate.EVENT_COLUMNS) for e in events], ", ".join(f"{c} {'date' if c == 'EventDate' else 'string'}" for c in validate.EVENT_COLUMNS))
    got = {tuple(r) for r in validate.grammar_errors(df).collect()}
    assert got == {("E2", "ChildPersonKey", "parent is child"), ("E3", "EventType", "reserved"), ("E4", "EventDate", "missing"), ("E4", "SubjectPersonKey", "no subject"), ("E4", "ToAddressKey", "same address")}
    people = spark.createDataFrame([("1", "16"), ("2", "30"), ("3", "52.9")], "PersonKey string, Age string")
    rules = lambda c: {tuple(r) for r in validate.age_violations(df, people, c).collect()}
    assert rules(validate.Constraints()) == {("E1", "min_marriage_age", "1"), ("E2", "fertility_age_range", "3")}
    assert ("E1", "max_partner_age_gap", "1") in rules(validate.Constraints(partner_age_gap_distribution={5: 0.5, 10: 0.5}, allow_underage_marriage=True))
    assert validate.grammar_errors(df.limit(0)).count() == 0


def test_confusion_of_nothing(spark):
    empty = spark.createDataFrame([], "A_RecordKey string, B_RecordKey string")
    assert tuple(er.confusion(empty, empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_duplicates_overlap_and_cardinality(spark):
    m = spark.createDataFrame([("1", "a", "A-1"), ("2", "a", "A-2"), ("1", "b", "B-1"), ("2", "b", "B-2"), ("2", "b", "B-3")], "PersonKey string, DatasetId string, RecordKey string")
    rates = {r.DatasetId: (r.duplicate_rows, r.duplicate_rate) for r in er.duplicate_rates(m).collect()}
    assert rates == {"a": (0, 0.0), "b": (1, 0.333333)}
    assert tuple(er.nway_overlap(m).first()) == (2, 2, 2, 100.0)
    got = {r.cardinality: r.people for r in er.match_cardinality(m.where("DatasetId = 'a'"), m.where("DatasetId = 'b'")).collect()}
    assert got == {"one_to_one": 1, "one_to_many": 1}
    assert {r.ambiguous_rows for r in er.ambiguity(m).collect()} == {0}


def test_run_ids(spark):
    assert validate.run_id("2026-01-01", "single_movers", 7) == "2026-01-01_single_movers_seed7"
    with pytest.raises(ValueError):
        validate.run_id("2026-1-1", "x", 7)
    df = spark.createDataFrame([("2026-02-30_a_seed1",), ("2026-02-03_a_b_seed12",), (None,)], "run_id string")
    assert [r.valid for r in validate.parsed_run_ids(df, "run_id").collect()] == [False, True, False]


def test_missingness_and_shares(spark):
    df = spark.createDataFrame([("x", None), (" ", 1), (None, 2)], "a string, n int")
    assert {r.field: (r.missing, round(r.pct, 2)) for r in reports.missingness(df).collect()} == {"a": (2, 66.67), "n": (1, 33.33)}
    assert {r.value: r.n for r in reports.shares(df, "a").collect()} == {"x": 1, "unknown": 2}
    assert reports.missingness(df.limit(0)).agg(F.sum("missing")).first()[0] == 0
