"""Scenarios, their documents and difficulty presets."""

from .documents import constraints_of, document_errors, document_of, emission_of, noise_of, rates_of, scenario_of, selection_of
from .scenarios import PRESETS, SCENARIOS, Scenario, explained, list_presets, patched, preset, scenario

__all__ = [
    "PRESETS", "SCENARIOS", "Scenario", "constraints_of", "document_errors", "document_of", "emission_of", "explained", "list_presets", "noise_of", "patched", "preset", "rates_of", "scenario", "scenario_of", "selection_of",
]
