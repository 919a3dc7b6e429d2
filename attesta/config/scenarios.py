"""The scenarios that ship, and presets that patch one."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace
from typing import Any

from ..operators.emission import DatasetSpec
from ..operators.er import MODES
from ..operators.noise import DEFAULT_A, DEFAULT_B, NoiseRates
from ..operators.population import Selection
from ..operators.truth import SimulationConfig
from ..operators.validate import Constraints


@dataclass(frozen=True)
class Scenario:
    """All parameters of a run."""

    name: str
    mode: str
    overlap: float
    appear: tuple[float, ...]
    duplicates: tuple[float, ...]
    rates: dict[str, float] = field(default_factory=dict)
    noise: tuple[NoiseRates, ...] = (DEFAULT_A, DEFAULT_B)
    roommate_share: float = 0.0
    household_size: tuple[int, int] = (1, 8)
    seed: int = 20260303
    periods: int = 12
    limits: Constraints = Constraints()
    selection: Selection = Selection()
    #: Sizes and ages of baseline groups of roommates.
    roommate_size: tuple[int, int] = (3, 5)
    roommate_age: tuple[int, int] = (18, 30)
    #: Ids and dates ("start" or "end" of the simulation) of the datasets; by default the first is of the start, the others of the end.
    names: tuple[str, ...] = ()
    snapshots: tuple[str, ...] = ()
    start: dt.date = dt.date(2026, 1, 1)
    step: str = "monthly"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown match mode {self.mode!r}")
        if (self.mode == "single_dataset") != (len(self.appear) == 1):
            raise ValueError("single_dataset has one dataset, every other mode has several")
        if not 0 <= self.overlap <= 100 or any(not 0 <= x <= 100 for x in self.appear) or any(x < 0 for x in self.duplicates):
            raise ValueError("percentages are out of range")
        if len(self.duplicates) != len(self.appear):
            raise ValueError("as many duplicate rates as datasets are needed")
        if any(x and len(x) != len(self.appear) for x in (self.names, self.snapshots)) or len(set(self.names)) != len(self.names) or set(self.snapshots) - {"start", "end"}:
            raise ValueError("datasets have one name and one date each, names once")
        if any(not re.fullmatch(r"[A-Za-z0-9_-]+", n) for n in self.names):
            raise ValueError("names of datasets are letters, digits, underscores and dashes")
        if not 2 <= self.roommate_size[0] <= self.roommate_size[1] or not 1 <= self.household_size[0] <= self.household_size[1]:
            raise ValueError("sizes are out of range")

    def simulation(self) -> SimulationConfig:
        return SimulationConfig(start=self.start, periods=self.periods, step=self.step, seed=self.seed, limits=self.limits, **self.rates)

    def datasets(self) -> list[DatasetSpec]:
        n = len(self.appear)
        names = self.names or (("registry",) if n == 1 else tuple(f"dataset_{chr(97 + i)}" for i in range(n)))
        when = self.snapshots or ("start", *["end"] * (n - 1))
        days = {"start": str(self.simulation().day(0)), "end": str(self.simulation().day(self.periods))}
        return [DatasetSpec(names[i], days[when[i]], self.duplicates[i], self.noise[min(i, len(self.noise) - 1)]) for i in range(n)]


def _b(**more: float) -> tuple[NoiseRates, NoiseRates]:
    return DEFAULT_A, replace(DEFAULT_B, **more)


# The scenarios' parameters.
SCENARIOS = {s.name: s for s in (
    Scenario("single_movers", "one_to_one", 70, (85, 90), (4, 6), {"move": 12}, _b(zip_error=2), seed=20260310),
    Scenario("couple_merge", "one_to_many", 65, (80, 90), (3, 12), {"cohabit": 4}, _b(nickname=5), household_size=(1, 10), seed=20260311),
    Scenario("family_birth", "many_to_one", 72, (88, 86), (10, 4), {"birth": 3.2}, _b(suffix_missing=8), seed=20260312),
    Scenario("divorce_custody", "many_to_many", 60, (82, 88), (14, 14), {"cohabit": 8, "divorce": 18}, _b(phonetic=2.5, date_swap=2), seed=20260313),
    Scenario("roommates_split", "one_to_many", 58, (80, 88), (12, 24), {"move": 24, "cohabit": 1.2, "leave_home": 45}, _b(ocr=3), roommate_share=42, seed=20260314),
    Scenario("clean_baseline_linkage", "one_to_one", 92, (96, 97), (1, 2), {"move": 8}, seed=20260410),
    Scenario("high_noise_identity_drift", "one_to_one", 78, (90, 92), (0, 1), {"move": 10}, (
        NoiseRates(typo=1, dob_shift=0.2, ssn_mask=0.5, phone_missing=0.2, address_missing=0.2, middle_missing=10, phonetic=0.5, zip_error=0.2, nickname=1, suffix_missing=0.5),
        NoiseRates(typo=9, dob_shift=3, ssn_mask=6, phone_missing=4, address_missing=3, middle_missing=35, phonetic=8, ocr=8, date_swap=6, zip_error=7, nickname=12, suffix_missing=10),
    ), seed=20260411),
    Scenario("low_overlap_sparse_coverage", "one_to_one", 22, (58, 52), (1, 2), {"move": 9}, seed=20260413),
    Scenario("asymmetric_source_coverage", "one_to_one", 38, (96, 44), (2, 3), {"move": 9}, seed=20260414),
    Scenario("high_duplication_dedup", "single_dataset", 100, (100,), (68,), {"move": 6}, (
        NoiseRates(typo=3, dob_shift=1, ssn_mask=3, phone_missing=2, address_missing=1.5, middle_missing=25, phonetic=2, ocr=2, date_swap=1, zip_error=1.5, nickname=4, suffix_missing=2),
    ), snapshots=("end",), seed=20260412),
    Scenario("three_source_partial_overlap", "one_to_one", 42, (96, 74, 52), (1, 5, 3), {"move": 9}, (
        replace(DEFAULT_A, middle_missing=8), replace(DEFAULT_B, middle_missing=18, typo=1.5), replace(DEFAULT_B, middle_missing=16, typo=1, phone_missing=1),
    ), names=("registry", "claims", "benefits"), seed=20260415),
)}


def scenario(name: str) -> Scenario:
    if name not in SCENARIOS:
        raise KeyError(f"unknown scenario {name!r}; there are {', '.join(SCENARIOS)}")
    return SCENARIOS[name]


def _noise(typo: float, phonetic: float, ocr: float, nickname: float) -> tuple[NoiseRates, NoiseRates]:
    return DEFAULT_A, replace(DEFAULT_B, typo=typo, phonetic=phonetic, ocr=ocr, nickname=nickname)


# What each preset changes.
PRESETS: dict[str, dict[str, Any]] = {
    "baseline_easy": {"overlap": 85, "mode": "one_to_one", "duplicates": (1, 2), "noise": _noise(1, 0, 0, 0)},
    "realistic_medium": {"overlap": 65, "mode": "one_to_many", "duplicates": (3, 8), "noise": _noise(2.5, 1.5, 0.5, 5)},
    "hard_noise": {"overlap": 50, "mode": "many_to_many", "duplicates": (8, 15), "noise": _noise(5, 4, 2, 10)},
    "extreme_stress": {"overlap": 30, "mode": "many_to_many", "duplicates": (15, 25), "noise": _noise(8, 7, 4, 15)},
    "high_mobility": {"rates": {"move": 25}, "periods": 24, "overlap": 60, "mode": "one_to_many"},
    "census_realistic": {"rates": {"move": 11.8, "cohabit": 6.1, "divorce": 2.4, "birth": 11}, "overlap": 70, "mode": "one_to_many"},
    "single_dataset_clean": {"mode": "single_dataset", "appear": (100,), "duplicates": (2,)},
    "single_dataset_dedup": {"mode": "single_dataset", "appear": (100,), "duplicates": (14,)},
}


def preset(name: str) -> dict[str, Any]:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def list_presets() -> list[str]:
    return list(PRESETS)


def patched(base: Scenario, patch: dict[str, Any]) -> Scenario:
    """R-11. A copy with some parameters changed, checked like any other. Unknown names are an error."""
    if unknown := set(patch) - set(base.__dataclass_fields__):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    if len(patch.get("appear", base.appear)) != len(base.appear):  # other datasets than those that were named
        patch = {"names": (), "snapshots": ()} | patch
    return replace(base, **patch)


def explained(s: Scenario) -> str:
    """R-13. What a scenario does, in sentences: events, datasets, overlap, and the noise of names and of other fields."""
    events = ", ".join(f"{name.replace('_', ' ')} {rate:g} %" for name, rate in s.rates.items() if rate) or "no events"
    out = [f"{s.name}: {s.periods} {s.step} periods from {s.start} with {events} a year."]
    specs = s.datasets()
    if len(specs) == 1:
        out.append(f"One dataset, {specs[0].dataset}, holds {s.appear[0]:g} % of people with {s.duplicates[0]:g} % extra records.")
    else:
        out.append(f"{len(specs)} datasets share {s.overlap:g} % of people, matched {s.mode.replace('_', ' ')}.")
        out += [f"{d.dataset} holds {s.appear[k]:g} % of people on {d.snapshot}, with {s.duplicates[k]:g} % extra records." for k, d in enumerate(specs)]
    for k, d in enumerate(specs):
        n = d.rates(k)
        names = n.typo + n.phonetic + n.ocr + n.nickname
        rest = n.middle_missing + n.dob_shift + n.ssn_mask + n.phone_missing + n.address_missing + n.date_swap + n.zip_error + n.suffix_missing
        out.append(f"Noise of {d.dataset}: names {names:g} %, other fields {rest:g} %.")
    if s.roommate_share:
        out.append(f"{s.roommate_share:g} % of people from {s.roommate_age[0]} to {s.roommate_age[1]} begin with {s.roommate_size[0]} to {s.roommate_size[1]} roommates.")
    return " ".join(out)
