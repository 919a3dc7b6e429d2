"""Forms of operators that keep work near its result: against brute force, and on hot keys."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.functions import hash_unit
from attesta.operators import allocation, er, intervals, reports, truth

MEMBERS = "HouseholdKey string, PersonKey string, MembershipStartDate date, MembershipEndDate date"
MOVES = "EventKey string, SubjectHouseholdKey string, EventDate date"
DAY0 = date(2000, 1, 1)


def members(n, seed, hot=0.5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = DAY0 + timedelta(rng.randint(0, 4000))
        end = rng.choice([None, start, start - timedelta(1), start + timedelta(rng.randint(0, 3000))])
        out.append((rng.choice([None, "h"]) if rng.random() < 0.03 else "hot" if rng.random() < hot else f"h{rng.randint(0, 9)}", None if i % 41 == 0 else f"p{rng.randint(0, n)}", None if i % 37 == 0 else start, end))
    return out


def test_moves_meet_members_on_the_day_and_nobody_else(spark):
    rows = [*members(300, 1), ("hot", "first", date(1, 1, 1), date(9999, 12, 31)), ("hot", "last", date(9999, 12, 31), None)]
    rng = random.Random(2)
    moves = [(f"e{i}", rng.choice(["hot", "h1", "h2", None, "nobody"]), None if i % 17 == 0 else DAY0 + timedelta(rng.randint(-10, 7500))) for i in range(120)]
    moves += [("old", "hot", date(1, 1, 1)), ("late", "hot", date(9999, 12, 31))]
    m, e = spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(moves, MOVES)
    expected = Counter((k, p) for k, h, d in moves for g, p, a, b in rows if None not in (h, d, p, a) and g == h and a <= d and (b is None or d <= b))
    assert Counter((r.EventKey, r.PersonKey) for r in intervals.members_on(e, m).collect()) == expected  # each membership once
    assert Counter((r.EventKey, r.PersonKey) for r in intervals.household_move_members(e, m).collect()) == Counter(set(expected))


def test_covering_blocks_hold_their_interval_and_are_few(spark):
    rng = random.Random(3)
    spans = [(i, a := DAY0 + timedelta(rng.randint(-3000, 3000)), a + timedelta(rng.choice([0, 1, 3, 4, 7, 30, 900, 20000]))) for i in range(60)]
    df = spark.createDataFrame(spans, "i int, a date, b date").select("i", "a", "b", *[c.alias(k) for k, c in intervals.covering_blocks(F.col("a"), F.col("b")).items()])
    df = df.groupBy("i", "a", "b").agg(F.array_sort(F.collect_list(F.struct("level", "block"))).alias("blocks")).withColumn("first", intervals.blocks_of_day(F.col("a")))
    rows = df.collect()
    assert len(rows) == len(spans)
    for r in rows:
        low, high, size = r.a.toordinal() - 1, r.b.toordinal() - 1, 4 ** r.blocks[0].level
        assert len({x.level for x in r.blocks}) == 1 and len(r.blocks) <= 2 and high - low < size and (size == 1 or high - low >= size // 4)
        assert [x.block for x in r.blocks] == list(range(low // size, high // size + 1)) and {(x.level, x.block) for x in r.first} == {(k, low // 4**k) for k in range(12)}


def test_overlaps_by_day_are_those_row_by_row(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        start = None if i % 29 == 0 else DAY0 + timedelta(rng.randint(0, 25))
        rows.append(("hot" if rng.random() < 0.5 else f"p{rng.randint(0, 30)}", start, None if start is None or rng.random() < 0.1 else start + timedelta(rng.randint(-2, 9)), f"a{i:04d}"))
    got = {r.who: (r.start_missing, r.end_before_start, r.overlaps) for r in intervals.interval_violations(spark.createDataFrame(rows, "who string, s date, e date, tie string"), "who", "s", "e", "tie").collect()}
    for who in {r[0] for r in rows}:
        own = sorted(((s, t, e) for w, s, e, t in rows if w == who and s), key=lambda x: x[:2])
        laps = sum(b[0] <= (a[2] or date(9999, 12, 31)) for a, b in zip(own, own[1:], strict=False))
        expected = (sum(w == who and s is None for w, s, *_ in rows), sum(e is not None and e < s for s, _, e in own), laps)
        assert got.get(who, (0, 0, 0)) == expected


def test_sweep_of_a_household_with_half_of_all_rows(spark):
    rows = members(600, 5)
    got = {r.HouseholdKey: (r.points, r.violations, r.peak) for r in intervals.sweep(spark.createDataFrame(rows, MEMBERS), 1, 4).collect()}
    expected = {}
    for h in {r[0] for r in rows if r[0]}:
        change = Counter()
        for g, p, a, b in rows:
            if g == h and p and a:
                change[a] += 1
                if b:
                    change[b + timedelta(1)] -= 1
        size, sizes = 0, []
        for d in sorted(change):
            size += change[d]
            sizes.append(size)
        sizes = [s for s in sizes if s > 0]
        if sizes:
            expected[h] = (len(sizes), sum(not 1 <= s <= 4 for s in sizes), max(sizes))
    assert got == expected


def test_confusion_without_pairs_is_that_of_pairs(spark):
    rng = random.Random(6)
    schema = "RecordKey string, PersonKey string, LastName string, DOB date"
    side = lambda s, n: [(f"{s}{i}", f"p{rng.randint(0, 40)}", rng.choice(["Smith", " ", "Jones", "Jonas", None, "smith"]), rng.choice([DAY0, DAY0 + timedelta(1), None])) for i in range(n)]
    a, b = side("a", 120), side("b", 90)
    fa, fb = spark.createDataFrame([*a, a[5], ("ax", None, "Smith", DAY0)], schema), spark.createDataFrame([*b, ("bx", None, "Smith", DAY0)], schema)
    walk = er.crosswalk(fa.where("PersonKey IS NOT NULL").distinct(), fb.where("PersonKey IS NOT NULL"), "many_to_many")
    for block, pairs in ((er.name_dob_block(), er.block_name_dob), (er.dob_prefix_block(), er.block_dob_prefix)):
        out = er.block_confusion(fa, fb, block)
        assert tuple(out.first()) == tuple(er.confusion(pairs(fa, fb), walk).first())
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], schema)
    assert tuple(er.block_confusion(empty, fb, er.name_dob_block()).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("few", [1024, 2])
def test_cuts_against_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(allocation, "CUT_ROWS", few)
    monkeypatch.setattr(allocation, "CUT_BITS", 3)
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("l"))
    u = hash_unit(5, "cut", "k")
    order = [r.k for r in df.orderBy("l", u, "k").collect()]
    for n in (0, 1, 99, 100, 101, 250, 300):
        cut = allocation.first_rows(df, F.col("l"), u, "k", n)
        assert sorted(r.k for r in df.where(cut.holds(F.col("l"), u, F.col("k"))).collect()) == sorted(order[:n])
    assert allocation.first_rows(df, F.col("l"), u, "k", 301) is None


def test_coverage_of_datasets_against_a_plain_fill(spark):
    n, sizes = 150, (120, 75, 45, 60)
    people = spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("extra"))
    got = {r.k: [r[f"in_{j}"] for j in range(4)] for r in allocation.nway_coverage(people, "k", n, 20, [80, 50, 30, 40], 9).collect()}
    salts = ["overlap", *(f"fill:{j}" for j in range(4))]
    units = {r.k: list(r)[1:] for r in people.select("k", *[hash_unit(9, s, "k").alias(f"u{j}") for j, s in enumerate(salts)]).collect()}
    common = set(sorted(units, key=lambda k: (units[k][0], k))[:30])
    times, expected = {k: -1 if k in common else 0 for k in units}, {k: [] for k in units}
    for j, size in enumerate(sizes):
        chosen = set(sorted(units, key=lambda k: (times[k], units[k][j + 1], k))[:size])
        for k in units:
            expected[k].append(k in chosen)
            times[k] += (k in chosen) if times[k] >= 0 else 0
    assert got == expected


def test_limits_of_the_heavy_tail_are_those_of_each_rank():
    for n, s, alpha in ((50, 12.5, 1.3), (1000, 4321.0, 1.3), (1000, 1e7, 0.7), (3, 0.5, 2.0)):
        for j in range(1, 10):
            assert allocation._ranks_reaching(s, j, alpha, n) == sum(float(r + 1) ** -alpha * s >= j for r in range(n))


@pytest.mark.parametrize("records", [100, 101, 180, 555, 998, 1000])
def test_heavy_tail_reaches_any_number(spark, records):
    people = spark.range(100).select(F.col("id").cast("string").alias("k"))
    got = [r.records for r in allocation.heavy_tail_counts(people, "k", 100, records, 3).collect()]
    assert sum(got) == records and len(got) == 100 and min(got) >= 1 and max(got) <= 10


def test_record_map_of_crosswalks(spark):
    walk = spark.createDataFrame([("p1", "a1", "b1"), ("p1", "a1", "b2"), ("p2", "a2", None), ("p3", None, "b3"), ("p4", "a1", None), (None, "a9", "b9")], "PersonKey string, A_RecordKey string, B_RecordKey string")
    other = spark.createDataFrame([("p1", "b1", "c1"), ("p5", None, "c2")], "PersonKey string, A_RecordKey string, B_RecordKey string")
    rows = er.record_map_of({("a", "b"): walk, ("b", "c"): other})
    assert {tuple(r) for r in rows.collect()} == {("a", "a1", "p1"), ("a", "a2", "p2"), ("a", "a1", "p4"), ("b", "b1", "p1"), ("b", "b2", "p1"), ("b", "b3", "p3"), ("c", "c1", "p1"), ("c", "c2", "p5")}
    assert {r.DatasetId: r.ambiguous_rows for r in er.ambiguity(rows).collect()} == {"a": 1, "b": 0, "c": 0}
    one = {(r.a, r.b): r.in_both for r in er.pairwise_overlap(rows).collect()}
    assert one == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1}


def test_moves_of_people_and_households_are_added(spark):
    events = spark.createDataFrame([("e1", "MOVE", "p1", None, DAY0), ("e2", "move ", None, "h", DAY0), ("e3", "BIRTH", "p1", None, DAY0)], "EventKey string, EventType string, SubjectPersonKey string, SubjectHouseholdKey string, EventDate date")
    inside = spark.createDataFrame([("h", "p1", DAY0, None), ("h", "p1", DAY0 - timedelta(5), None), ("h", "p2", DAY0 + timedelta(1), None)], MEMBERS)
    people = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "PersonKey string")
    assert {r.PersonKey: r.moves for r in reports.moves_per_person(events, inside, people).collect()} == {"p1": 2, "p2": 0}


def test_couples_apart_are_found(spark):
    state = spark.createDataFrame([("a", "b", "h", "x"), ("b", "a", "h", "x"), ("c", "d", "h1", "y"), ("d", "c", "h1", "z"), ("e", None, "h2", "y")], "PersonKey string, Partner string, HouseholdKey string, AddressKey string")
    assert tuple(truth.couple_colocation(state).first()) == (2, 1)


def test_rank_buckets_follow_the_rows(spark, monkeypatch):
    for n in (0, 10**6, 10**10, 10**12):
        assert n / allocation.rank_buckets(n) <= allocation.BUCKET_ROWS and allocation.rank_buckets(10 * n) <= max(allocation.BUCKETS, 20 * 10 * n / allocation.BUCKET_ROWS)
    monkeypatch.setattr(allocation, "BUCKET_ROWS", 1)
    monkeypatch.setattr(allocation, "BUCKETS", 2)
    people = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = [r.k for r in allocation.hash_rank(people, "k", 3, "s").orderBy("number").collect()]
    assert got == [r.k for r in people.orderBy(hash_unit(3, "s", "k"), "k").collect()]


def test_caches_and_runs_by_address(spark, tmp_path):
    from attesta.sources import cache
    from attesta.sources.readers import load_json
    from attesta.sources.writers import write_text

    tables = {n: spark.createDataFrame([tuple("1" for _ in cols)], ", ".join(f"{c} string" for c in cols)) for n, cols in cache.CACHE.items()}
    root = f"file://{tmp_path}"
    assert cache.recent_run_folders(root) == [] and cache.listing(spark, f"{root}/nowhere/*") == []
    manifest = cache.build_cache(tables, f"{root}/one")
    assert load_json(f"{tmp_path}/one/manifest.json") == {"tables": manifest["tables"]} and set(cache.load_cache(spark, f"{root}/one")) == set(cache.CACHE)
    write_text(spark, '{"tables": ["truth", "observed_b", "observed_a"]}', f"{root}/manifest.json")
    assert cache.datasets_of(root) == ["observed_a", "observed_b"] and cache.recent_run_folders(root, contains="on") == ["one"]
    (tmp_path / "old").mkdir()
    for name in ("DatasetA.csv", "DatasetB.csv"):
        write_text(spark, "RecordKey\n", f"{root}/old/{name}")
    assert cache.datasets_of(f"{root}/old") == ["DatasetA", "DatasetB"]
    write_text(spark, "RecordKey\n", f"{root}/old/observed_x.csv")
    assert cache.datasets_of(f"{root}/old") == ["observed_x"]


def test_coverage_counters(spark):
    rows = [("a", "p1"), ("a", "p1"), ("a", "p2"), ("b", "p1"), ("b", "p9"), ("c", "p1"), ("c", "p2"), ("c", None)]
    members = spark.createDataFrame(rows, "DatasetId string, PersonKey string")
    got = {r.DatasetId: tuple(r)[1:] for r in er.coverage_counters(members, spark.createDataFrame([("p1",), ("p2",), ("p2",)], "PersonKey string")).collect()}
    assert got == {"a": (2, 2, 0, 0, 1), "b": (2, 1, 1, 1, 1), "c": (2, 2, 0, 0, 1)}
    assert er.coverage_counters(members.limit(0), members.select("PersonKey")).collect() == []


def test_insights_name_the_worst_and_the_dominant(spark):
    missing = spark.createDataFrame([("a", "Phone", 20.0), ("a", "DOB", 3.0), ("b", "Phone", 40.4), ("b", "Email", 40.4)], "DatasetId string, field string, pct double")
    assert {r.DatasetId: r.insight.split(":")[0] for r in reports.missing_insights(missing).collect()} == {"a": "few values are missing", "b": "Email is missing in 40 % of rows"}
    noise = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.5, 5.0), ("c", 2.5, 5.1)], "DatasetId string, name_noise double, sound_noise double")
    assert {(r.a, r.b): r.insight.split()[0] for r in reports.noise_insights(noise).collect()} == {("a", "b"): "the", ("a", "c"): "sounds", ("b", "c"): "sounds"}
    top = er.dominant(spark.createDataFrame([("MOVE",)] * 2 + [("BIRTH",)], "t string"), "t")
    assert reports.event_insight(top, "t").first().insight == "MOVE is 67 % of 3 events"
    ages = spark.createDataFrame([(9, 30, 20.5)], "people long, mode_age int, std_age double")
    assert reports.age_insight(ages).first().insight == "most people are 30: a wide spread, names collide across cohorts"


def test_cohorts_and_shares_of_totals(spark):
    lines = spark.createDataFrame([(1, 999), (2, 10), (3, 30), (18, 5), (19, 15), (4, 8), (33, 4), (16, 0), (32, 0)], "line int, value long")
    got = {r.age_cohort_id: tuple(r)[1:] for r in reports.cohort_mobility(lines).collect()}
    assert got == {"age_0_17": (40, 20, 20, 50.0), "age_18_24": (8, 8, 0, 100.0), "age_65_plus": (0, 0, 0, None)}
    kinds = spark.createDataFrame([("all", 30), ("a", 10), ("b", 20), ("c", 0)], "k string, n long")
    assert {r.k: (r.n, r.pct) for r in reports.shares_of_total(kinds, "k", "n", "all").collect()} == {"a": (10, 33.333333), "b": (20, 66.666667), "c": (0, 0.0)}
    assert [r.pct for r in reports.shares_of_total(kinds.where("k = 'a'"), "k", "n", "all").collect()] == [None]
