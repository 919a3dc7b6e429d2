"""A scenario from records to observed datasets, answer keys and measures, as lazy DataFrames that are written where a run materialises them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Scenario, contract, document_errors, document_of
from ..functions import concat_nonempty
from ..operators import allocation, emission, er, generation, intervals, population, reports, truth, validate
from ..sources.checkpoints import cut_lineage
from ..sources.readers import parsed, read_text
from ..sources.writers import guard_targets, json_text, write_csv, write_parquet, write_text, yaml_text

PEOPLE_COLUMNS = ("PersonKey", "FirstName", "MiddleName", "LastName", "Suffix", "Gender", "Ethnicity", "DOB", "Age", "SSN", "Phone")


@dataclass
class Run:
    """What a scenario makes."""

    scenario: Scenario
    population: DataFrame
    stages: DataFrame
    truth: dict[str, DataFrame]
    observed: dict[str, DataFrame]
    record_map: DataFrame
    crosswalks: dict[tuple[str, str], DataFrame]
    book: DataFrame
    coverage: dict[str, dict[str, int]]

    def quality(self) -> DataFrame:
        """R-1. (section, dataset, metric, value) of truth, events and linkage. dataset is what a row is about: a dataset, two of them as a__b, a rule or a type."""
        t = self.truth
        low, high = self.scenario.household_size
        rules = validate.age_violations(t["events"], t["people"], self.scenario.limits, with_gap=False).groupBy(F.col("rule").alias("DatasetId")).agg(F.count("*").alias("violations"))
        bad = lambda df, side: intervals.interval_violations(df, "PersonKey", f"{side}StartDate", f"{side}EndDate", {"Residence": "AddressKey", "Membership": "HouseholdKey"}[side]).agg(
            F.lit(side.lower()).alias("DatasetId"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("start_missing", "end_before_start", "overlaps")]
        )
        swept = intervals.sweep(t["memberships"], low, high)
        parts = {
            "event_ages": rules, "time_overlaps": bad(t["residence_history"], "Residence").unionByName(bad(t["memberships"], "Membership")), "households": intervals.peak_summary(swept).crossJoin(swept.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("size_violations"))),
            "events": reports.event_counts(t["events"]), "couples": truth.couple_colocation(t["state"]), "moves": reports.moves_summary(reports.moves_per_person(t["events"], t["memberships"], t["people"])),
            "household_types": reports.shares(t["households"], "HouseholdType").withColumnRenamed("value", "DatasetId"),
            "coverage": t["people"].sparkSession.createDataFrame([(d, n, v) for d, c in self.coverage.items() for n, v in c.items()], "DatasetId string, name string, value long").groupBy("DatasetId").pivot("name", ["candidates", "entities", "late"]).agg(F.first("value")),
        }
        if self.observed:
            every = None
            for d in self.observed.values():
                rows = d.select("DatasetId", "RecordKey", "FirstName", "MiddleName", "LastName", "Phone", "AddressKey", "SourceSnapshotDate")
                every = rows if every is None else every.unionByName(rows)
            days = {spec.snapshot for spec in self.scenario.datasets()}
            places = None
            for day in sorted(days):
                at = intervals.asof_address(t["residence_history"], day).withColumn("SourceSnapshotDate", F.lit(day).cast("date"))
                places = at if places is None else places.unionByName(at)
            parts |= {"duplicates": er.duplicate_rates(self.record_map), "ambiguity": er.ambiguity(self.record_map), "drift": er.attribute_drift(every, self.record_map, t["people"], places)}
        if len(self.observed) > 1:
            pair = F.concat_ws("__", "a", "b").alias("DatasetId")
            two = lambda df: df.select(pair, *[c for c in df.columns if c not in ("a", "b")])
            parts |= {"overlap": er.nway_overlap(self.record_map), "pairwise_overlap": two(er.pairwise_overlap(self.record_map)), "cardinality": two(er.pairwise_cardinality(self.record_map))}
        return reports.quality_metrics(parts)

    def checks(self) -> dict[str, int]:
        """V-8. Numbers of faults; a sound run has none."""
        t = self.truth
        bad = intervals.interval_violations(t["residence_history"], "PersonKey", "ResidenceStartDate", "ResidenceEndDate", "AddressKey")
        low, high = self.scenario.household_size
        return {
            "grammar": validate.grammar_errors(t["events"]).count(), "ages": validate.age_violations(t["events"], t["people"], self.scenario.limits).count(), "overlaps": bad.count(),
            "sizes": intervals.sweep(t["memberships"], low, high).agg(F.coalesce(F.sum("violations"), F.lit(0))).first()[0], "apart": truth.couple_colocation(t["state"]).first()["apart"],
        }

    def selection_log(self) -> dict[str, Any]:
        """Numbers of people after each filter, how many are selected, and the checksum of their keys."""
        one = population.selection_checksum(self.population).first()
        counts = {"entity_total" if r.stage == "all" else f"after_{r.stage}": r.remaining for r in self.stages.collect()}  # a row for each filter
        return {"scenario_id": self.scenario.name, "selection_seed": self.scenario.seed, "counts": counts | {"selected_entities": one.selected}, "selected_personkey_sha256": one.checksum}


def _members(scenario: Scenario, pools: list[DataFrame], n: list[int]) -> list[DataFrame]:
    """(PersonKey, forced) of each dataset, from the people that may be in it; forced are those in all datasets."""
    key, seed = "PersonKey", scenario.seed
    if len(pools) == 1:
        return [population.exact_sample(pools[0], key, "count", round(scenario.appear[0] * n[0] / 100), seed, "coverage").select(key, F.lit(False).alias("forced"))]
    if len(pools) == 2:
        cover = cut_lineage(allocation.coverage(pools[0], key, n[0], scenario.overlap, *scenario.appear, seed))
        late = pools[1].join(pools[0], key, "left_anti")
        some = population.exact_sample(cut_lineage(late), key, "count", round(scenario.appear[1] * (n[1] - n[0]) / 100), seed, "late")
        both = F.col("in_a") & F.col("in_b")
        return [cover.where("in_a").select(key, both.alias("forced")), cover.where("in_b").select(key, both.alias("forced")).unionByName(some.select(key, F.lit(False).alias("forced")))]
    shared = pools[0]  # everybody of the first date can be in every later dataset
    want = [round(p * m / 100) for p, m in zip(scenario.appear, n, strict=True)]
    late = [0 if not k else min(w, n[k] - n[0]) for k, w in enumerate(want)]  # those that others don't have come first
    cover = allocation.nway_coverage(shared, key, n[0], scenario.overlap, scenario.appear, seed, [w - m for w, m in zip(want, late, strict=True)])
    common = F.expr(" AND ".join(f"in_{k}" for k in range(len(pools))))
    out = []
    for k, pool in enumerate(pools):
        mine = cover.where(f"in_{k}").select(key, common.alias("forced"))
        if late[k]:
            new = population.exact_sample(cut_lineage(pool.join(shared, key, "left_anti")), key, "count", late[k], seed, f"late:{k}")
            mine = mine.unionByName(new.select(key, F.lit(False).alias("forced")))
        out.append(mine)
    return out


def run_scenario(records: DataFrame, people: DataFrame, scenario: Scenario, book: DataFrame | None = None, nicknames: DataFrame | None = None) -> Run:
    """records: one row per person and record; people: identity of each person (PEOPLE_COLUMNS, AddressKey, ResidenceType); nicknames: (FormalName, variants).

    Selection, simulation, coverage and emission in order. Nothing is collected but counts that size a plan.
    """
    selected, stages = population.select_people(records, scenario.selection, scenario.seed)
    selected = cut_lineage(selected)
    scores = [c for c in selected.columns if c.endswith("PropensityScore")]
    base = cut_lineage(people.join(selected.select("PersonKey", *scores), "PersonKey"))
    start = truth.initial_state(base)
    if scenario.roommate_share:
        start = truth.roommates(cut_lineage(start), scenario.seed, scenario.roommate_share, *scenario.roommate_size, *scenario.roommate_age)
    made = truth.simulate(base, scenario.simulation(), start)
    made = {k: cut_lineage(df) if k in ("events", "residence_history", "memberships") else df for k, df in made.items()}
    made["people"] = cut_lineage(base.select(*PEOPLE_COLUMNS).unionByName(truth.children(made["events"], made["state"])))
    book = book if book is not None else base.sparkSession.createDataFrame([], "AddressKey string, StreetName string, ZipCode string")
    book = cut_lineage(generation.completed_book(made["residence_history"], book, scenario.seed))
    specs = scenario.datasets()
    snaps = {d: cut_lineage(emission.snapshot(made["people"], made["residence_history"], book, d)) for d in sorted({s.snapshot for s in specs})}
    sizes = {d: snap.count() for d, snap in snaps.items()}
    pools, n = [snaps[s.snapshot].select("PersonKey") for s in specs], [sizes[s.snapshot] for s in specs]
    observed, coverage = {}, {}
    for k, (spec, members) in enumerate(zip(specs, _members(scenario, pools, n), strict=True)):
        two = emission.forces_two(scenario.mode, k)
        members = cut_lineage(members.withColumn("forced", F.col("forced") & F.lit(two)))
        count = members.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("forced").cast("long")), F.lit(0)).alias("forced")).first()
        coverage[spec.dataset] = {"candidates": n[k], "entities": count.n, "late": n[k] - n[0]}
        observed[spec.dataset] = cut_lineage(emission.emit(snaps[spec.snapshot], members, count.n, spec, k, scenario.seed + k, nicknames, count.forced))
    record_map = emission.entity_record_map(list(observed.values()))
    walks = er.all_crosswalks(record_map, list(observed), scenario.mode) if len(observed) > 1 else {}
    for r in er.coverage_counters(record_map, pools[0]).collect():  # a row for each dataset
        coverage[r.DatasetId] |= {"base_entities": r.base_entities, "late_entities": r.late_entities, "only_entities": r.only_entities, "shared_entities": r.shared_entities}
    return Run(scenario, selected, stages, made, observed, record_map, walks, book, coverage)


def age_bin(age: Column) -> Column:
    return F.when(age <= 17, "age_0_17").when(age <= 34, "age_18_34").when(age <= 64, "age_35_64").when(age.isNotNull(), "age_65_plus")


def _shaped(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Exactly these columns, null where df has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def published(run: Run) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables to be written as Parquet and those to be written as CSV, by name, with the columns of the contract."""
    t = run.truth
    full = concat_nonempty(*[F.col(c) for c in ("FirstName", "MiddleName", "LastName", "Suffix")])
    tables = {
        "scenario_population": run.population.withColumns({"ScenarioId": F.lit(run.scenario.name), "SelectionSeed": F.lit(run.scenario.seed)}), "truth_events": t["events"],
        "truth_people": t["people"].withColumns({"FormalFullName": full, "AgeBin": age_bin(F.col("Age"))}).withColumnRenamed("FirstName", "FormalFirstName"), "truth_households": t["households"],
        "truth_household_memberships": t["memberships"], "truth_residence_history": t["residence_history"],
    }
    csvs = {f"observed_{k}": _shaped(v, contract.OBSERVED) for k, v in run.observed.items()} | {"entity_record_map": run.record_map}
    csvs |= {("truth_crosswalk" if len(run.observed) == 2 else f"crosswalk_{a}__{b}"): w for (a, b), w in run.crosswalks.items()}
    return {n: _shaped(df, contract.TABLES[n]) for n, df in tables.items()}, csvs


def write_run(run: Run, folder: str, overwrite: bool = False, data_path: str = "records", manifest_path: str = "records.manifest.json") -> dict[str, Any]:
    """Tables, answer keys and the run's documents in a folder of any file system, after a check that nothing there would be replaced; returns the manifest.

    data_path and manifest_path say where the records came from, as the scenario and the manifest tell.
    """
    spark = run.record_map.sparkSession
    tables, csvs = published(run)
    guard_targets(run.record_map, [f"{folder}/{n}.parquet" for n in tables] + [f"{folder}/{n}.csv" for n in csvs], overwrite)
    for n, df in tables.items():
        write_parquet(df, f"{folder}/{n}.parquet", overwrite)
    for n, df in csvs.items():
        write_csv(df, f"{folder}/{n}.csv", overwrite)
    checks = run.checks()
    rid = validate.run_id(str(run.scenario.simulation().start), run.scenario.name, run.scenario.seed)
    pairs = [{"dataset_ids": [a, b], "path": f"{folder}/{'truth_crosswalk' if len(run.observed) == 2 else f'crosswalk_{a}__{b}'}.csv"} for a, b in run.crosswalks]
    manifest = {
        "run_id": rid, "scenario_id": run.scenario.name, "seed": run.scenario.seed, "scenario": asdict(run.scenario), "datasets": list(run.observed), "tables": sorted([*tables, *csvs]), "checks": checks,
        "status": "ok" if validate.quality_ok(checks["grammar"], checks["ages"], checks["overlaps"], checks["sizes"]) else "failed", "phase1_input_csv": data_path, "phase1_input_manifest": manifest_path,
        "coverage": run.coverage, "observed_outputs": {"pairwise_crosswalks": pairs},
    }
    report: dict[str, Any] = {}
    for r in run.quality().collect():  # a row for each measure
        report.setdefault(r.section, {}).setdefault(r.dataset or "all", {})[r.metric] = r.value
    documents = {"scenario.yaml": yaml_text(document_of(run.scenario, data_path, manifest_path)), "scenario_selection_log.json": json_text({"run_id": rid} | run.selection_log()), "quality_report.json": json_text(report), "manifest.json": json_text(manifest)}
    for name, text in documents.items():
        write_text(spark, text, f"{folder}/{name}")
    return manifest


def _documents(spark: SparkSession, folder: str) -> tuple[dict[str, Any], list[tuple[str, str]]]:
    """The run's documents by name, and what is wrong with each of them alone."""
    out, found = {}, []
    for name in ("scenario.yaml", "scenario_selection_log.json", "quality_report.json", "manifest.json"):
        try:
            out[name] = parsed(read_text(spark, f"{folder}/{name}"), name)
        except FileNotFoundError:
            found.append((name, "missing"))
        except ValueError as e:
            found.append((name, str(e)))
    need = {"manifest.json": ("run_id", "scenario_id", "seed", "phase1_input_csv", "phase1_input_manifest"), "scenario_selection_log.json": ("run_id", "scenario_id", "selection_seed", "counts", "selected_personkey_sha256")}
    for name, keys in need.items():
        found += [(name, f"{k} is missing") for k in keys if name in out and out[name].get(k) in (None, "")]
    found += [("scenario.yaml", e) for e in document_errors(out["scenario.yaml"])] if "scenario.yaml" in out else []
    return out, found


def document_conflicts(documents: dict[str, Any], selected: int) -> list[tuple[str, str]]:
    """What the documents of a run say against each other, its id, or the number of people selected."""
    scenario, manifest, log = (documents.get(n, {}) for n in ("scenario.yaml", "manifest.json", "scenario_selection_log.json"))
    rid = str(manifest.get("run_id"))
    parts = re.fullmatch(r"\d{4}-\d{2}-\d{2}_([A-Za-z0-9][A-Za-z0-9_-]*)_seed(\d+)", rid)
    if not parts:
        return [("manifest.json", "run_id is not a run id")]
    name, seed = parts[1], int(parts[2])
    phase1 = scenario.get("phase1") or {}
    checks = [
        ("scenario.yaml", "scenario_id", scenario.get("scenario_id"), name), ("scenario.yaml", "seed", scenario.get("seed"), seed), ("manifest.json", "scenario_id", manifest.get("scenario_id"), name),
        ("manifest.json", "seed", manifest.get("seed"), seed), ("scenario_selection_log.json", "run_id", log.get("run_id"), rid), ("scenario_selection_log.json", "scenario_id", log.get("scenario_id"), name),
        ("scenario_selection_log.json", "selection_seed", log.get("selection_seed"), seed), ("scenario_selection_log.json", "selected_entities", (log.get("counts") or {}).get("selected_entities"), selected),
        ("manifest.json", "phase1_input_csv", manifest.get("phase1_input_csv"), phase1.get("data_path")), ("manifest.json", "phase1_input_manifest", manifest.get("phase1_input_manifest"), phase1.get("manifest_path")),
    ]
    return [(file, f"{key} is {have!r}, not {want!r}") for file, key, have, want in checks if have != want]


def validate_run(spark: SparkSession, folder: str, datasets: list[str], limits: validate.Constraints | None = None) -> list[tuple[str, str]]:
    """V-4. (file, error): files, columns and documents that the contract asks for, then what they say against each other, and faults of events, ages and residences."""
    found = validate.contract_errors(spark, folder, contract.files(datasets))
    documents, wrong = _documents(spark, folder)
    found += wrong
    if found:
        return found
    found += document_conflicts(documents, spark.read.parquet(f"{folder}/scenario_population.parquet").count())
    events, people = spark.read.parquet(f"{folder}/truth_events.parquet"), spark.read.parquet(f"{folder}/truth_people.parquet")
    parts = {
        "truth_events.parquet": validate.grammar_errors(events).select(F.concat_ws(": ", "field", "error").alias("what")).unionByName(validate.age_violations(events, people, limits or validate.Constraints()).select(F.col("rule").alias("what"))),
        "truth_residence_history.parquet": validate.residence_violations(spark.read.parquet(f"{folder}/truth_residence_history.parquet")).select(F.col("rule").alias("what")),
    }
    for name, df in parts.items():
        found += [(name, f"{r.n} x {r.what}") for r in df.groupBy("what").agg(F.count("*").alias("n")).orderBy("what").collect()]  # a row for each kind of fault
    return found
