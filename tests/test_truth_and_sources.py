import datetime as dt
from dataclasses import replace
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from attesta.config import PRESETS, SCENARIOS, list_presets, patched, preset, scenario
from attesta.functions import hash_unit
from attesta.operators import intervals, truth, validate
from attesta.operators.noise import NoiseRates
from attesta.plans.scenario import PEOPLE_COLUMNS, run_scenario, validate_run, write_run
from attesta.sources import guard_targets, load_json, load_yaml, nickname_catalogue, read_csv_lenient, read_csv_strings, table_columns
from attesta.sources.writers import renamed, zingg_fields
from attesta.streaming import event_windows, noised_stream, read_stream


def people(spark, n=24):
    k = F.col("id")
    return spark.range(n).select(
        k.cast("string").alias("PersonKey"), F.lit("Robert").alias("FirstName"), F.lit("Lee").alias("MiddleName"), F.lit("Smith").alias("LastName"), F.lit(None).cast("string").alias("Suffix"), F.when(k % 2 == 0, "female").otherwise("male").alias("Gender"),
        F.lit("White").alias("Ethnicity"), F.lit("1995-01-01").cast("date").alias("DOB"), (F.lit(20) + k % 10).cast("int").alias("Age"), F.lit("900-00-1000").alias("SSN"), F.lit("555").alias("Phone"), F.concat(F.lit("A"), k.cast("string")).alias("AddressKey"), F.lit("HOUSE").alias("ResidenceType"),
        *[F.lit(0.9).alias(f"{s}PropensityScore") for s in ("Mobility", "Partnership", "Fertility")],
    )


def test_step_dates_and_rates():
    cfg = truth.SimulationConfig(start=dt.date(2024, 1, 31))
    assert [cfg.day(i) for i in (1, 2, 13)] == [dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2025, 2, 28)]
    assert truth.step_rate(0) == 0 and truth.step_rate(100) == 1 and abs(1 - (1 - truth.step_rate(12)) ** 12 - 0.12) < 1e-12
    with pytest.raises(ValueError):
        truth.SimulationConfig(move=101)


def test_zero_rates_do_nothing(spark):
    made = truth.simulate(people(spark), truth.SimulationConfig(periods=2))
    assert made["events"].count() == 0 and made["residence_history"].where("ResidenceEndDate IS NOT NULL").count() == 0


def test_simulated_truth_keeps_its_rules(spark):
    cfg = truth.SimulationConfig(periods=2, move=100, cohabit=100, birth=100, divorce=50, leave_home=50)
    made = truth.simulate(people(spark), cfg)
    kinds = {r.EventType for r in made["events"].select("EventType").distinct().collect()}
    assert {"COHABIT", "MOVE"} <= kinds
    assert validate.grammar_errors(made["events"]).count() == 0
    assert truth.couple_colocation(made["state"]).first()["apart"] == 0
    assert intervals.interval_violations(made["residence_history"], "PersonKey", "ResidenceStartDate", "ResidenceEndDate", "AddressKey").count() == 0
    keys = [r.EventKey for r in made["events"].orderBy("EventKey").collect()]
    assert keys == [f"EVT_{i + 1:07d}" for i in range(len(keys))]
    open_ = made["memberships"].where("MembershipEndDate IS NULL").groupBy("PersonKey").count()
    assert open_.where("count <> 1").count() == 0 and open_.count() == made["state"].count()


def test_a_scenario_from_end_to_end(spark, tmp_path):
    records = people(spark).select(F.concat(F.lit("1"), "PersonKey").alias("RecordKey"), "PersonKey", F.lit("1").alias("EntityRecordIndex"), F.lit("AGE_18_34").alias("AgeBin"), "Gender", "Ethnicity", "ResidenceType")
    base = people(spark).select(*PEOPLE_COLUMNS, "AddressKey", "ResidenceType")
    run = run_scenario(records, base, replace(scenario("single_movers"), periods=1))
    manifest = write_run(run, str(tmp_path / "run"))
    assert set(manifest["checks"].values()) == {0}
    assert list(run.observed) == ["dataset_a", "dataset_b"] and (tmp_path / "run" / "manifest.json").exists()
    assert load_json(str(tmp_path / "run" / "manifest.json"))["scenario"]["name"] == "single_movers"
    with pytest.raises(FileExistsError):
        write_run(run, str(tmp_path / "run"))
    assert manifest["status"] == "ok" and validate_run(spark, str(tmp_path / "run"), manifest["datasets"]) == []
    import shutil

    shutil.rmtree(tmp_path / "run" / "truth_households.parquet")
    assert validate_run(spark, str(tmp_path / "run"), manifest["datasets"]) == [("truth_households.parquet", "missing")]
    assert run.quality().where("metric = 'apart'").first().value == 0
    assert {"PersonKey", "A_RecordKey", "B_RecordKey"} == set(table_columns(spark, str(tmp_path / "run" / "truth_crosswalk.csv")))
    assert validate.contract_errors(spark, str(tmp_path / "run"), {"truth_events.parquet": ["EventKey"], "gone.csv": [], "entity_record_map.csv": ["PersonKey", "Other"]}) == [("gone.csv", "missing"), ("entity_record_map.csv", "column Other is missing")]


def test_a_scenario_selects_groups_and_names(spark, tmp_path):
    """Filters, samples, roommates, nicknames and addresses that no book has all take effect, and documents that contradict a run are found."""
    from attesta.config import document_of, scenario_of
    from attesta.plans.scenario import document_conflicts
    from attesta.sources import write_json

    records = people(spark, 60).select(F.concat(F.lit("1"), "PersonKey").alias("RecordKey"), "PersonKey", F.lit("1").alias("EntityRecordIndex"), F.lit("AGE_18_34").alias("AgeBin"), "Gender", "Ethnicity", "ResidenceType")
    base = people(spark, 60).select(*PEOPLE_COLUMNS, "AddressKey", "ResidenceType")
    document = document_of(scenario("roommates_split")) | {"selection": {"sample": {"mode": "count", "value": 20}, "filters": {"genders": ["FEMALE"]}}, "simulation": {"periods": 1}}
    made = scenario_of(document)
    every = replace(made, noise=(NoiseRates(nickname=100), NoiseRates(nickname=100)), appear=(100, 50))
    names = spark.createDataFrame([("Robert", ["Bob"])], "FormalName string, variants array<string>")
    run = run_scenario(records, base, every, nicknames=names)
    assert run.population.count() == 20 and run.population.where("Gender <> 'female'").count() == 0
    assert run.selection_log()["counts"]["after_genders"] == 30 and run.selection_log()["counts"]["selected_entities"] == 20
    homes = run.truth["memberships"].where("HouseholdKey LIKE 'HH_ROOM_BASE_%'").groupBy("HouseholdKey").agg(F.countDistinct("PersonKey").alias("n")).collect()
    assert homes and all(3 <= r.n <= 5 for r in homes)
    a = run.observed["dataset_a"]
    assert a.where("FirstName <> 'Bob' AND FirstName NOT LIKE 'Child%'").count() == 0 and a.where("City IS NULL OR StreetName IS NULL").count() == 0
    write_run(run, str(tmp_path / "run"))
    assert validate_run(spark, str(tmp_path / "run"), list(run.observed)) == []
    log = load_json(str(tmp_path / "run" / "scenario_selection_log.json"))
    write_json(log | {"selection_seed": 1}, str(tmp_path / "run" / "scenario_selection_log.json"))
    assert [f for f, _ in validate_run(spark, str(tmp_path / "run"), list(run.observed))] == ["scenario_selection_log.json"]
    assert document_conflicts({"manifest.json": {"run_id": "x"}}, 0) == [("manifest.json", "run_id is not a run id")]


def test_explanations_and_upper_keys():
    from attesta.config import explained
    from attesta.sources.writers import upper_keys

    text = explained(scenario("roommates_split"))
    assert "leave home 45 %" in text and "42 % of people from 18 to 30" in text and "dataset_b holds 88 %" in text
    assert "One dataset, registry" in explained(scenario("high_duplication_dedup"))
    assert upper_keys({"a": {"b": ["x", 1]}, "c": None}) == {"A": {"B": ["X", 1]}, "C": None} and upper_keys({"a": "x"}, texts=False) == {"A": "x"}
    with pytest.raises(ValueError):
        upper_keys({"a": 1, "A": 2})


def test_documents_are_checked():
    from attesta.config import constraints_of, document_errors, document_of, emission_of, rates_of, scenario_of, selection_of

    for s in SCENARIOS.values():
        assert document_errors(document_of(s, "a", "b")) == [] and scenario_of(document_of(s)).datasets() == s.datasets()
    bad = [
        (selection_of, {"sample": {"mode": "some"}}), (selection_of, {"sample": {"value": 101}}), (selection_of, {"filters": {"genders": "f"}}), (selection_of, {"thresholds": {"trait_low_max": 0.9}}), (selection_of, {"filters": {"redundancy_profiles": ["x"]}}),
        (emission_of, {"crossfile_match_mode": "x"}), (emission_of, {"datasets": []}), (emission_of, {"datasets": [{"dataset_id": "a", "snapshot": "noon"}]}), (emission_of, {"noise": {"A": {"name_typo_pct": 101}}}),
        (constraints_of, {"partner_age_gap_distribution": {}}), (constraints_of, {"min_marriage_age": 130}), (rates_of, {"move_rate_pct": "x"}), (scenario_of, {"seed": 1}), (scenario_of, {"scenario_id": "a", "seed": -1}),
    ]
    for f, value in bad:
        with pytest.raises(ValueError):
            f(value)
    assert rates_of({"use_priors_for_unspecified_rates": True, "split_rate_pct": 5})["leave_home"] == 5 and rates_of({"use_priors_for_unspecified_rates": True})["birth"] == 4.0


def test_births_and_partners(spark):
    """One of two women who live together bears at a time, both are locked, f is female, and a blank address becomes a new one."""
    cfg = truth.SimulationConfig(periods=1, birth=100, cohabit=100)
    women = people(spark, 2).withColumns({"Gender": F.lit("F"), "AddressKey": F.lit(" ")})
    made = truth.simulate(women, truth.SimulationConfig(periods=1, cohabit=100))
    assert made["state"].where("trim(AddressKey) = ''").count() == 0
    born = truth.stepped(made["state"], cfg, 2).where("event.EventType = 'BIRTH'").collect()
    assert len(born) == 1 and {born[0].event.Parent1PersonKey, born[0].event.Parent2PersonKey} == {"0", "1"}
    child = truth.children(truth.simulate(people(spark, 4).withColumn("Gender", F.lit("f")), truth.SimulationConfig(periods=1, birth=100))["events"], made["state"])
    assert child.columns[0] == "PersonKey"


def test_scenarios_and_presets():
    assert len(SCENARIOS) == 11 and len(PRESETS) == 8 == len(list_presets())
    assert patched(scenario("single_movers"), preset("hard_noise")).mode == "many_to_many"
    for bad in ({"mode": "x"}, {"overlap": 101}, {"nothing": 1}, {"mode": "single_dataset"}):
        with pytest.raises(ValueError):
            patched(scenario("single_movers"), bad)
    with pytest.raises(KeyError):
        preset("x")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿a,b\n x ,1\n,\ny\nz,2,3\n", encoding="utf-8")
    assert [tuple(r) for r in read_csv_lenient(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()] == [("x", "1"), ("y", ""), ("z", "2")]
    (tmp_path / "b.csv").write_text("a,b\nNA,1\nNone,x\n", encoding="utf-8")
    assert [tuple(r) for r in read_csv_strings(spark, str(tmp_path / "b.csv")).collect()] == [(None, "1"), (None, "x")]
    (tmp_path / "n.json").write_text('{"male": {"Robert": {"nicknames": ["Bob", "Robert", "Bob"], "weights": [2, 9, 3]}}}', encoding="utf-8")
    assert [tuple(r) for r in nickname_catalogue(spark, str(tmp_path / "n.json")).collect()] == [("male", "Robert", "Bob", 5.0)]
    (tmp_path / "l.json").write_text("[1]", encoding="utf-8")
    for f in (load_json, load_yaml):
        with pytest.raises(ValueError):
            f(str(tmp_path / "l.json"))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("A-1", "Ann", "x")], "A_RecordKey string, FirstName string, Extra string")
    assert renamed(df, "a").columns == ["unique_id", "first_name", "source_dataset", "Extra"]
    with pytest.raises(ValueError):
        renamed(df.drop("A_RecordKey"), "a")
    assert {f["fieldName"]: f["matchType"] for f in zingg_fields(df)} == {"A_RecordKey": "DONT_USE", "FirstName": "FUZZY", "Extra": "DONT_USE"}
    guard_targets(df, [str(tmp_path / "new")], False)
    with pytest.raises(FileExistsError):
        guard_targets(df, [str(tmp_path)], False)


def test_streams_give_what_batches_give(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("RecordKey"), F.lit("Robert").alias("FirstName"), F.lit("Smith").alias("LastName"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), F.lit("x").alias("event_type"))
    df.write.parquet(str(tmp_path / "in"))
    stream = noised_stream(read_stream(spark, str(tmp_path / "in"), df.schema), NoiseRates(typo=50), 1)
    q = stream.writeStream.format("memory").queryName("noised").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("noised").collect())) == sorted(map(tuple, noised_stream(df, NoiseRates(typo=50), 1).collect()))
    q = event_windows(read_stream(spark, str(tmp_path / "in"), df.schema), width="30 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("windows").collect()) == [20, 30]


def test_prepared_cache_and_run_folders(spark, tmp_path):
    from attesta.sources.cache import CACHE, bundle, build_cache, datasets_of, load_cache, recent_run_folders, set_path

    tables = {n: spark.createDataFrame([tuple("1" for _ in c)], ", ".join(f"{x} string" for x in c)) for n, c in CACHE.items()}
    folder = str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        load_cache(spark, folder)
    build_cache(tables, folder)
    assert set(load_cache(spark, folder)) == set(CACHE) and bundle(folder, str(tmp_path / "b.zip")) > 0
    with pytest.raises(FileExistsError):
        build_cache(tables, folder)
    with pytest.raises(ValueError):
        build_cache({}, folder)
    assert recent_run_folders(str(tmp_path)) == ["cache"] and datasets_of(folder) == []
    assert set_path({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}


def test_registered_simulations_run_all_periods(spark, monkeypatch):
    from attesta.plans import simulation

    ran = []
    monkeypatch.setattr(simulation, "run_scenario", lambda records, people, made, *rest: ran.append(made))
    for name in ("single_movers", "three_source_partial_overlap"):
        simulation._scenario(MagicMock(), name)
    assert ran == [scenario("single_movers"), scenario("three_source_partial_overlap")] and {r.periods for r in ran} == {12} and simulation.CONFIG.periods == 12


def test_a_step_deals_people_to_households_once(spark):
    """Leaving home and moving share one shuffle by household, couples join without a sort of all people, and what is told equals a step written out for few people."""
    cfg = truth.SimulationConfig(periods=1, move=60, cohabit=60, birth=60, divorce=50, leave_home=60)
    state = truth.initial_state(people(spark))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = truth.stepped(state, cfg, 1, 24)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(HouseholdKey") == 1 and "SortMergeJoin" not in plan


def test_the_last_of_a_household_stays_and_may_move(spark):
    """Of three who all want to leave two do; the third, then alone, moves. With one who is too old to want, all three leave, and that one moves."""
    cfg = truth.SimulationConfig(periods=1, move=100, leave_home=100)
    home = truth.initial_state(people(spark, 3)).withColumns({"HouseholdKey": F.lit("H"), "AddressKey": F.lit("A")})
    for rows, stays in ((home, 1), (home.unionByName(home.where("PersonKey = '0'").withColumns({"PersonKey": F.lit("9"), "Age": F.lit(60)})), 1)):
        out = truth.stepped(rows, cfg, 1).collect()
        kinds = sorted(r.event.EventType for r in out if r.event)
        assert kinds == ["LEAVE_HOME"] * (len(out) - 1) + ["MOVE"] and sum(r.HouseholdKey == "H" for r in out) == stays
        assert all(r.touched and r.event.FromAddressKey == "A" and r.event.ToAddressKey == r.AddressKey for r in out)


def test_pairs_are_neighbours_by_hash_whatever_the_buckets(spark, monkeypatch):
    """Pairs are rows 2k and 2k + 1 in the order of hashes, also where buckets have odd numbers of rows; a step moves people by hash bucket and household alone, and joins none by person."""
    keys = [f"p{k}" for k in range(301)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "PersonKey string, x int")
    order = [r.PersonKey for r in df.orderBy(hash_unit(5, "pair", F.col("PersonKey")), "PersonKey").collect()]
    want = {(a, b) for a, b in zip(order[::2], order[1::2], strict=False)}
    for buckets in (4096, 64, 7, 2):
        monkeypatch.setattr(truth, "rank_buckets", lambda n: buckets)  # noqa: B023
        rows = truth._paired(truth._Rows(("PersonKey", "x"), "SELECT * FROM {df}"), 5, "pair", ("PersonKey",), 301)
        got = [(r.PersonKey, r._even, r._mate and r._mate.PersonKey) for r in spark.sql(rows.text, df=df).collect()]
        assert {(k, m) for k, even, m in got if even and m} == want and {(m, k) for k, even, m in got if not even} == want and [k for k, _, m in got if not m] == [order[-1]]
    cfg = truth.SimulationConfig(periods=1, move=60, cohabit=60, birth=60, divorce=50, leave_home=60)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = truth.stepped(truth.initial_state(people(spark)), cfg, 1, 24)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "hashpartitioning(PersonKey" not in plan and plan.count("hashpartitioning(_group") == 1


def test_first_digits_of_a_hash_rule_out_what_its_number_does(spark):
    """Odds give what the number of the hash gives, also where scores are outside 0 to 1, missing, or no numbers."""
    cfg = truth.SimulationConfig()
    rows = spark.range(4000).selectExpr("CAST(id AS STRING) AS PersonKey", "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN -2D WHEN 2 THEN 9D WHEN 3 THEN CAST('NaN' AS DOUBLE) ELSE id / 4000D END AS x")
    for rate in (0.0, 1e-9, 0.03, 0.5, 1.0):
        asked = rows.selectExpr("PersonKey", f"{truth._below(cfg, 's', rate, '(0.5D + x)')} AS hit", f"coalesce({truth.unit_text(cfg.seed, 's', 'PersonKey')} < least(greatest({rate!r}D * (0.5D + x), 0D), 1D), false) AS want")
        assert asked.where("hit <> want OR hit IS NULL").count() == 0 and (rate < 0.03 or asked.where("hit").count())


def test_a_step_reads_the_order_of_free_people(spark):
    """Both counts and rows of pairs read the hash that the step before has written, and pairs are the same."""
    cfg = truth.SimulationConfig(periods=1, cohabit=90, birth=60)
    state = truth.initial_state(people(spark, 60))
    given = truth._stepped(state.withColumn("_turn", F.expr(truth._turned(cfg, 1))).localCheckpoint(), cfg, 1, 60, f"DATE '{cfg.day(1)}'")
    assert "pair:1" not in given._jdf.queryExecution().optimizedPlan().toString()
    plain = truth.stepped(state, cfg, 1, 60)
    assert sorted(given.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str) and plain.where("event.EventType = 'COHABIT'").count() > 0
    want = {r.PersonKey: r.u for r in plain.where("Partner IS NULL AND Age >= 18").select("PersonKey", hash_unit(cfg.seed, "pair:2", F.col("PersonKey")).alias("u")).collect()}
    assert {r.PersonKey: r._turn for r in given.where("_turn IS NOT NULL").collect()} == want


def test_people_of_dated_records_are_those_of_numbered_ones(spark, tmp_path):
    """The day orders a person's records as their number does, ties by key; nothing is numbered, and orders aren't sorted for the join."""
    from attesta.operators import population
    from attesta.plans.adapters import Tables

    k = F.col("id")
    spark.range(400).select(
        ((k * 37) % 400).alias("o_orderkey"), (k % 23).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (k % 3 + 1).cast("int")).alias("o_orderstatus"), F.timestamp_seconds((k * 7919 % 30) * 86400 * 29).alias("o_orderdate"),
        F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), (k * 31 % 5 + 1).cast("int")).alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).select(k.alias("c_custkey"), (k % 5).cast("int").alias("c_nationkey"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    t = Tables(spark, str(tmp_path))
    old, new = (population.entity_view(t[name]) for name in ("records", "dated_records"))
    assert sorted(old.collect()) == sorted(new.collect()) and old.count() == 20
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" in plan


def test_everybody_is_a_sample_without_a_count(spark):
    from attesta.operators import population

    df = spark.range(50).withColumnRenamed("id", "k")
    assert population.exact_sample(df, "k", "pct", 100.0, 1) is df and population.exact_sample(df, "k", "pct", 50.0, 1).count() == 25
