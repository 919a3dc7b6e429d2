"""The columns of what a run publishes (V-4, V-7)."""

from __future__ import annotations

# Table names and their columns, in order.
TABLES = {
    "scenario_population": (
        "PersonKey", "ScenarioId", "SelectionSeed", "AgeBin", "Gender", "Ethnicity", "ResidenceType", "RecordsPerEntity", "RedundancyProfile", "MobilityPropensityScore", "MobilityPropensityBucket",
        "PartnershipPropensityScore", "PartnershipPropensityBucket", "FertilityPropensityScore", "FertilityPropensityBucket",
    ),
    "truth_people": ("PersonKey", "FormalFirstName", "MiddleName", "LastName", "Suffix", "FormalFullName", "Gender", "Ethnicity", "DOB", "Age", "AgeBin", "SSN", "Phone"),
    "truth_households": ("HouseholdKey", "HouseholdType", "HouseholdStartDate", "HouseholdEndDate"),
    "truth_household_memberships": ("PersonKey", "HouseholdKey", "HouseholdRole", "MembershipStartDate", "MembershipEndDate"),
    "truth_residence_history": ("PersonKey", "AddressKey", "ResidenceStartDate", "ResidenceEndDate"),
    "truth_events": (
        "EventKey", "EventType", "EventDate", "SubjectPersonKey", "SubjectHouseholdKey", "FromAddressKey", "ToAddressKey", "PersonKeyA", "PersonKeyB", "NewHouseholdKey", "CohabitMode", "ChildPersonKey",
        "Parent1PersonKey", "Parent2PersonKey", "CustodyMode",
    ),
}
OBSERVED = (
    "RecordKey", "DatasetId", "FirstName", "MiddleName", "LastName", "Suffix", "FullName", "Gender", "Ethnicity", "DOB", "Age", "SSN", "Phone", "AddressKey", "HouseNumber", "StreetName", "UnitType", "UnitNumber",
    "StreetAddress", "City", "State", "ZipCode", "SourceSnapshotDate", "SourceSystem",
)
RECORD_MAP = ("PersonKey", "DatasetId", "RecordKey")
CROSSWALK = ("PersonKey", "A_RecordKey", "B_RecordKey")


def files(datasets: list[str]) -> dict[str, tuple[str, ...]]:
    """File names and columns of a run with these datasets."""
    out = {f"{n}.parquet": c for n, c in TABLES.items()} | {f"observed_{d}.csv": OBSERVED for d in datasets} | {"entity_record_map.csv": RECORD_MAP}
    pairs = [(a, b) for i, a in enumerate(datasets) for b in datasets[i + 1 :]]
    return out | {("truth_crosswalk.csv" if len(datasets) == 2 else f"crosswalk_{a}__{b}.csv"): CROSSWALK for a, b in pairs}
