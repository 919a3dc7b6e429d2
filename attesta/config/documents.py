"""Scenarios as documents: what scenario.yaml says, checked on the way in (V-6, P-14, R-11)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import fields, replace
from typing import Any

from ..operators.er import MODES
from ..operators.noise import DEFAULT_A, DEFAULT_B, NoiseRates
from ..operators.population import Selection
from ..operators.validate import Constraints
from .scenarios import Scenario

# What documents call each rate of noise and each rate of the simulation.
NOISE_KEYS = {
    "typo": "name_typo_pct", "middle_missing": "middle_name_missing_pct", "dob_shift": "dob_shift_pct", "ssn_mask": "ssn_mask_pct", "phone_missing": "phone_mask_pct", "address_missing": "address_missing_pct",
    "ocr": "ocr_error_pct", "phonetic": "phonetic_error_pct", "nickname": "nickname_pct", "date_swap": "date_swap_pct", "zip_error": "zip_digit_error_pct", "suffix_missing": "suffix_missing_pct",
}
RATE_KEYS = {"move": "move_rate_pct", "cohabit": "cohabit_rate_pct", "birth": "birth_rate_pct", "divorce": "divorce_rate_pct", "leave_home": "leave_home_rate_pct"}
FILTER_KEYS = ("age_bins", "genders", "ethnicities", "residence_types", "redundancy_profiles", "mobility_propensity_buckets")
MOMENTS = {"start": "simulation_start", "end": "simulation_end"}
# What a birth rate is without priors, and the age groups whose rates it is the mean of; the share that moves in a year without priors.
BIRTH_ELSE, BIRTH_GROUPS, MOVE_ELSE = 4.0, ("20-24", "25-29", "30-34", "35-39"), 11.5


def _section(values: Mapping[str, Any], name: str) -> dict[str, Any]:
    found = values.get(name)
    if found is None:
        return {}
    if not isinstance(found, Mapping):
        raise ValueError(f"{name} must be a mapping")
    return dict(found)


def _number(value: Any, name: str, low: float = 0.0, high: float = 100.0) -> float:
    try:
        n = float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number") from None
    if not low <= n <= high:
        raise ValueError(f"{name} must be from {low:g} to {high:g}")
    return n


def selection_of(raw: Mapping[str, Any] | None) -> Selection:
    """The section `selection`; what it doesn't say is as in an empty one: all people."""
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("selection must be a mapping")
    sample, filters, cuts = _section(raw, "sample"), _section(raw, "filters"), _section(raw, "thresholds")
    lists = {}
    for key in FILTER_KEYS:
        values = filters.get(key)
        if values is not None and not isinstance(values, list):
            raise ValueError(f"selection.filters.{key} must be a list")
        lists["mobility_buckets" if key.startswith("mobility") else key] = tuple(str(v).strip() for v in values or [] if str(v).strip())
    cut = lambda key, default: _number(cuts.get(key, default), f"selection.thresholds.{key}", 0, 1)
    return Selection(
        mode=str(sample.get("mode", "pct")).strip().lower(), value=_number(sample.get("value", 100), "selection.sample.value", 0, float("inf")), **lists,
        mobility_cuts=(cut("mobility_low_max", 0.09), cut("mobility_high_min", 0.18)), trait_cuts=(cut("trait_low_max", 0.33), cut("trait_high_min", 0.66)),
    )


def noise_of(raw: Mapping[str, Any] | None, default: NoiseRates) -> NoiseRates:
    """Rates of one dataset; what is not said is the default's."""
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("noise must be a mapping")
    return replace(default, **{field: _number(raw[key], f"noise.{key}") for field, key in NOISE_KEYS.items() if key in raw})


def emission_of(raw: Mapping[str, Any] | None) -> dict[str, Any]:
    """The section `emission` as parameters of a Scenario: either a list `datasets`, or the two sides A and B."""
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("emission must be a mapping")
    mode = str(raw.get("crossfile_match_mode") or "").strip().lower()
    if mode and mode not in MODES:
        raise ValueError(f"emission.crossfile_match_mode must be one of {', '.join(MODES)}")
    overlap = _number(raw.get("overlap_entity_pct", 70), "emission.overlap_entity_pct")
    if "datasets" in raw:
        rows = raw["datasets"]
        if not isinstance(rows, list) or not rows or not all(isinstance(d, Mapping) for d in rows):
            raise ValueError("emission.datasets must be a list of mappings that is not empty")
        moments = {v: k for k, v in MOMENTS.items()} | {k: k for k in MOMENTS}
        when = [str(d.get("snapshot", "end")).strip().lower() for d in rows]
        if bad := set(when) - set(moments):
            raise ValueError(f"unknown snapshots: {', '.join(sorted(bad))}")
        return {
            "mode": mode or ("single_dataset" if len(rows) == 1 else "one_to_one"), "overlap": overlap, "names": tuple(str(d.get("dataset_id", d.get("id", ""))).strip() for d in rows), "snapshots": tuple(moments[w] for w in when),
            "appear": tuple(_number(d.get("appearance_pct", 100), "appearance_pct") for d in rows), "duplicates": tuple(_number(d.get("duplication_pct", 0), "duplication_pct") for d in rows),
            "noise": tuple(noise_of(d.get("noise"), DEFAULT_B if k else DEFAULT_A) for k, d in enumerate(rows)),
        }
    noise = _section(raw, "noise")
    sides = "A" if mode == "single_dataset" else "AB"
    return {
        "mode": mode or "one_to_one", "overlap": overlap, "appear": tuple(_number(raw.get(f"appearance_{s}_pct", 100 if sides == "A" else 85), f"appearance_{s}_pct") for s in sides),
        "duplicates": tuple(_number(raw.get(f"duplication_in_{s}_pct", 5), f"duplication_in_{s}_pct") for s in sides), "noise": tuple(noise_of(noise.get(s), DEFAULT_A if s == "A" else DEFAULT_B) for s in sides),
        **({"snapshots": ("end",)} if sides == "A" else {}),
    }


def constraints_of(raw: Mapping[str, Any] | None) -> Constraints:
    """The section `constraints`."""
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("constraints must be a mapping")
    ages, gap, spread = _section(raw, "fertility_age_range"), raw.get("max_partner_age_gap", 25), raw.get("partner_age_gap_distribution")
    if spread is not None:
        if not isinstance(spread, Mapping) or not spread:
            raise ValueError("constraints.partner_age_gap_distribution must be a mapping that is not empty")
        spread = {int(k): _number(v, "constraints.partner_age_gap_distribution", 0, float("inf")) for k, v in spread.items()}
        if min(spread) < 0 or sum(spread.values()) <= 0:
            raise ValueError("constraints.partner_age_gap_distribution needs gaps that are not negative and a positive sum")
    age = lambda value, name: int(_number(value, f"constraints.{name}", 0, 120))
    return Constraints(
        min_marriage_age=age(raw.get("min_marriage_age", 18), "min_marriage_age"), max_partner_age_gap=None if gap is None else age(gap, "max_partner_age_gap"),
        fertility_age_min=age(ages.get("min", 15), "fertility_age_range.min"), fertility_age_max=age(ages.get("max", 49), "fertility_age_range.max"),
        allow_underage_marriage=bool(raw.get("allow_underage_marriage", False)), allow_child_lives_alone=bool(raw.get("allow_child_lives_alone", False)), partner_age_gap_distribution=spread,
    )


def rates_of(raw: Mapping[str, Any] | None, priors: Mapping[str, Any] | None = None) -> dict[str, float]:
    """T-0. Annual rates from the section `parameters`: what it says, else priors if it asks for them, else nothing happens. split_rate_pct is another name of leave_home_rate_pct."""
    raw = {} if raw is None else raw
    if not isinstance(raw, Mapping):
        raise ValueError("parameters must be a mapping")
    out = dict.fromkeys(RATE_KEYS, 0.0)
    if raw.get("use_priors_for_unspecified_rates"):
        p = priors or {}
        births = [v / 10 for g in BIRTH_GROUPS if (v := _section(_section(p, "fertility"), "birth_rate_per_1000_by_age_group").get(g)) is not None]
        couples = _section(p, "marriage_divorce")
        out |= {
            "move": _section(p, "mobility").get("overall_moved_past_year_pct") or MOVE_ELSE, "cohabit": (couples.get("marriage_rate_per_1000") or 0) / 10, "divorce": (couples.get("divorce_rate_per_1000") or 0) / 10,
            "birth": sum(births) / len(births) if births else BIRTH_ELSE,
        }
    given = {"leave_home_rate_pct": raw["split_rate_pct"]} if "split_rate_pct" in raw else {}
    given |= {k: raw[k] for k in RATE_KEYS.values() if k in raw}
    return {k: _number(given.get(key, out[k]), f"parameters.{key}") for k, key in RATE_KEYS.items()}


def scenario_of(values: Mapping[str, Any], priors: Mapping[str, Any] | None = None) -> Scenario:
    """A Scenario from a whole document. Every section is checked; what is wrong is a ValueError that names it."""
    for key in ("scenario_id", "seed"):
        if values.get(key) in (None, ""):
            raise ValueError(f"{key} is missing")
    if not isinstance(values["seed"], int) or values["seed"] < 0:
        raise ValueError("seed must be a whole number that is not negative")
    simulation, quality, parameters = _section(values, "simulation"), _section(_section(values, "quality"), "household_size_range"), _section(values, "parameters")
    start = simulation.get("start_date", dt.date(2026, 1, 1))
    return Scenario(
        name=str(values["scenario_id"]), seed=values["seed"], rates={k: v for k, v in rates_of(parameters, priors).items() if v}, selection=selection_of(values.get("selection")), limits=constraints_of(values.get("constraints")),
        step=str(simulation.get("granularity", "monthly")), periods=int(_number(simulation.get("periods", 12), "simulation.periods", 1, float("inf"))), start=start if isinstance(start, dt.date) else dt.date.fromisoformat(str(start)),
        household_size=(int(quality.get("min", 1)), int(quality.get("max", 8))), roommate_share=_number(parameters.get("roommate_group_share_pct", 0), "parameters.roommate_group_share_pct"),
        roommate_size=(int(parameters.get("roommate_household_size_min", 3)), int(parameters.get("roommate_household_size_max", 5))), roommate_age=(int(parameters.get("roommate_age_min", 18)), int(parameters.get("roommate_age_max", 30))),
        **emission_of(values.get("emission")),
    )


def _lists(values: Sequence[str]) -> list[str]:
    return list(values)


def document_of(scenario: Scenario, data_path: str = "", manifest_path: str = "") -> dict[str, Any]:
    """P-14. The whole document of a Scenario; scenario_of() reads it back."""
    s, c = scenario.selection, scenario.limits
    rates = {RATE_KEYS[k]: v for k, v in scenario.rates.items()}
    rooms = {"roommate_group_share_pct": scenario.roommate_share, "roommate_household_size_min": scenario.roommate_size[0], "roommate_household_size_max": scenario.roommate_size[1], "roommate_age_min": scenario.roommate_age[0], "roommate_age_max": scenario.roommate_age[1]}
    noise = lambda n: {key: getattr(n, f) for f, key in NOISE_KEYS.items()}
    specs = scenario.datasets()
    moments = scenario.snapshots or ("start", *["end"] * (len(specs) - 1))
    datasets = [
        {"dataset_id": d.dataset, "filename": f"observed_{d.dataset}.csv", "snapshot": MOMENTS[moments[k]], "appearance_pct": scenario.appear[k], "duplication_pct": scenario.duplicates[k], "noise": noise(d.rates(k))} for k, d in enumerate(specs)
    ]
    return {
        "scenario_id": scenario.name, "seed": scenario.seed, "phase1": {"data_path": data_path, "manifest_path": manifest_path}, "parameters": rates | (rooms if scenario.roommate_share else {}),
        "simulation": {"granularity": scenario.step, "start_date": str(scenario.start), "periods": scenario.periods}, "emission": {"crossfile_match_mode": scenario.mode, "overlap_entity_pct": scenario.overlap, "datasets": datasets},
        "quality": {"household_size_range": {"min": scenario.household_size[0], "max": scenario.household_size[1]}},
        "selection": {
            "sample": {"mode": s.mode, "value": s.value}, "filters": {k: _lists(getattr(s, "mobility_buckets" if k.startswith("mobility") else k)) for k in FILTER_KEYS},
            "thresholds": {"mobility_low_max": s.mobility_cuts[0], "mobility_high_min": s.mobility_cuts[1], "trait_low_max": s.trait_cuts[0], "trait_high_min": s.trait_cuts[1]},
        },
        "constraints": {
            "min_marriage_age": c.min_marriage_age, "max_partner_age_gap": c.max_partner_age_gap, "fertility_age_range": {"min": c.fertility_age_min, "max": c.fertility_age_max}, "allow_underage_marriage": c.allow_underage_marriage,
            "allow_child_lives_alone": c.allow_child_lives_alone, "partner_age_gap_distribution": dict(c.partner_age_gap_distribution) if c.partner_age_gap_distribution else None,
        },
    }


def document_errors(values: Any) -> list[str]:
    """What is wrong with a document, as validate_run() reports it."""
    if not isinstance(values, Mapping):
        return ["a scenario is a mapping"]
    found = [f"{k} is missing" for k in ("phase1", "selection") if not isinstance(values.get(k), Mapping)]
    found += [f"phase1.{k} is missing" for k in ("data_path", "manifest_path") if isinstance(values.get("phase1"), Mapping) and not str(values["phase1"].get(k) or "").strip()]
    try:
        scenario_of(values)
    except (ValueError, TypeError) as e:
        found.append(str(e))
    return found


assert set(NOISE_KEYS) == {f.name for f in fields(NoiseRates)} - {"extra"}
