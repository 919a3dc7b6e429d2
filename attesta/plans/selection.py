"""Queries of population selection, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import population as pop
from .adapters import Tables, unit_sql, with_views

SEED = 7
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


_ORDER = "CAST(EntityRecordIndex AS BIGINT), CAST(RecordKey AS BIGINT)"
VIEW_SQL = f"""
SELECT PersonKey, first(AgeBin ORDER BY {_ORDER}) FILTER (WHERE AgeBin IS NOT NULL) AS AgeBin, first(Gender ORDER BY {_ORDER}) FILTER (WHERE Gender IS NOT NULL) AS Gender,
       first(Ethnicity ORDER BY {_ORDER}) FILTER (WHERE Ethnicity IS NOT NULL) AS Ethnicity, last(ResidenceType ORDER BY {_ORDER}) FILTER (WHERE ResidenceType IS NOT NULL) AS ResidenceType,
       count(*) AS RecordsPerEntity, CASE WHEN count(*) <= 1 THEN 'single_record' ELSE 'multi_record' END AS RedundancyProfile
FROM {{records}} GROUP BY PersonKey
"""


def _case(values: dict[str, float], otherwise: float) -> str:
    return "CASE lower(trim(AgeBin)) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {otherwise}::DOUBLE END"


def traits_sql(seed: int) -> str:
    """P-3 in SQL."""
    bases = {"Mobility": _case(pop.MOBILITY_DEFAULTS, pop.MOBILITY_ELSE), "Partnership": _case(pop.PARTNERSHIP, pop.PARTNERSHIP_ELSE), "Fertility": _case(pop.FERTILITY, pop.FERTILITY_ELSE)}
    score = lambda k, base: f"round_even(least(greatest({base} + ({unit_sql(seed, k.lower(), 'PersonKey')} - 0.5) * {pop.WIDTHS[k]}, 0.0), 1.0), 6) AS {k}PropensityScore"
    bucket = lambda k: f"CASE WHEN {k}PropensityScore <= {pop.BUCKETS[k][0]} THEN 'low' WHEN {k}PropensityScore >= {pop.BUCKETS[k][1]} THEN 'high' ELSE 'medium' END AS {k}PropensityBucket"
    return f"SELECT *, {', '.join(map(bucket, bases))} FROM (SELECT *, {', '.join(score(k, b) for k, b in bases.items())} FROM ({VIEW_SQL}) v) s"


TRAITS_SQL = traits_sql(SEED)


def _stages() -> list:
    c = pop.category_filter
    return [
        ("age_bins", c("AgeBin", ["AGE_18_34", "age_35_64"])), ("genders", c("Gender", ["female", " Male "])), ("ethnicities", c("Ethnicity", ["machinery", "BUILDING", "household"])), ("residence_types", c("ResidenceType", [])),
        ("redundancy_profiles", c("RedundancyProfile", ["multi_record"])), ("mobility_buckets", c("MobilityPropensityBucket", ["medium", "high"])),
    ]


_P = [
    "lower(trim(AgeBin)) IN ('age_18_34', 'age_35_64')", "lower(trim(Gender)) IN ('female', 'male')", "lower(trim(Ethnicity)) IN ('machinery', 'building', 'household')", "true",
    "RedundancyProfile = 'multi_record'", "MobilityPropensityBucket IN ('medium', 'high')",
]
_NAMES = ("age_bins", "genders", "ethnicities", "residence_types", "redundancy_profiles", "mobility_buckets")


def _traits(t: Tables):  # noqa: ANN202
    return pop.latent_traits(pop.entity_view(t["records"]), SEED)


@query(VIEW_SQL)
def entity_view(t: Tables):  # noqa: ANN201
    return pop.entity_view(t["records"])


@query(TRAITS_SQL)
def latent_traits(t: Tables):  # noqa: ANN201
    return _traits(t)


@query(f"SELECT MobilityPropensityBucket AS bucket, count(*) AS n, round_even(avg(MobilityPropensityScore), 6) AS mean_score FROM ({TRAITS_SQL}) x GROUP BY ALL")
def bucketize(t: Tables):  # noqa: ANN201
    return _traits(t).groupBy(F.col("MobilityPropensityBucket").alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.avg("MobilityPropensityScore"), 6).alias("mean_score"))


@query("SELECT 'all' AS stage, 0 AS position, count(*) AS remaining FROM (" + TRAITS_SQL + ") x" + "".join(f" UNION ALL SELECT '{n}', {k + 1}, count(*) FROM ({TRAITS_SQL}) x WHERE {' AND '.join(_P[:k + 1])}" for k, n in enumerate(_NAMES)))
def filter_cascade_counts(t: Tables):  # noqa: ANN201
    return pop.filter_cascade(_traits(t), _stages())[1]


_SAMPLE = f"SELECT * FROM ({TRAITS_SQL}) x ORDER BY {unit_sql(SEED, 'sample', 'PersonKey')}, PersonKey LIMIT (SELECT CAST(greatest(1, round_even(12.5 * count(DISTINCT PersonKey) / 100, 0)) AS BIGINT) FROM {{records}})"


@query(f"SELECT PersonKey, AgeBin, MobilityPropensityScore FROM ({_SAMPLE}) s")
def exact_sample(t: Tables):  # noqa: ANN201
    return pop.exact_sample(_traits(t), "PersonKey", "pct", 12.5, SEED).select("PersonKey", "AgeBin", "MobilityPropensityScore")


@query(f"SELECT count(*) AS selected, sha256(string_agg(PersonKey, '|' ORDER BY CAST(PersonKey AS BIGINT))) AS checksum FROM ({_SAMPLE}) s")
def selection_checksum(t: Tables):  # noqa: ANN201
    return pop.selection_checksum(pop.exact_sample(_traits(t), "PersonKey", "pct", 12.5, SEED))


_RORDER = "CAST(r.EntityRecordIndex AS BIGINT), CAST(r.RecordKey AS BIGINT)"


@query(f"""
SELECT s.PersonKey, s.MobilityPropensityScore, s.PartnershipPropensityScore, s.FertilityPropensityScore, first(r.Gender ORDER BY {_RORDER}) FILTER (WHERE r.Gender IS NOT NULL) AS Gender,
       first(r.Ethnicity ORDER BY {_RORDER}) AS Ethnicity, first(r.AgeBin ORDER BY {_RORDER}) FILTER (WHERE r.AgeBin IS NOT NULL) AS AgeBin, last(r.AddressKey ORDER BY {_RORDER}) AS AddressKey, last(r.ResidenceType ORDER BY {_RORDER}) AS ResidenceType
FROM ({_SAMPLE}) s JOIN {{records}} r ON s.PersonKey = r.PersonKey GROUP BY s.PersonKey, s.MobilityPropensityScore, s.PartnershipPropensityScore, s.FertilityPropensityScore
""")
def person_baseline(t: Tables):  # noqa: ANN201
    return pop.person_baseline(t["records"], pop.exact_sample(_traits(t), "PersonKey", "pct", 12.5, SEED))


@query("SELECT DISTINCT p.PersonKey FROM {people} p WHERE NOT EXISTS (SELECT 1 FROM {records} r WHERE r.PersonKey = p.PersonKey)")
def missing_keys(t: Tables):  # noqa: ANN201
    return pop.missing_keys(t["people"], t["records"])


@query("""
WITH k AS (SELECT CASE WHEN age_cohort_id IN ('age_18_24', 'age_25_34') THEN 'age_18_34' ELSE age_cohort_id END AS AgeBin, sum(moved_past_year_pct / 100 * population::DOUBLE) / greatest(sum(population::DOUBLE), 1.0) AS b FROM {cohorts} GROUP BY 1),
d(AgeBin, v) AS (VALUES ('age_0_17', 0.10), ('age_18_34', 0.20), ('age_35_64', 0.09), ('age_65_plus', 0.06))
SELECT d.AgeBin, round_even(coalesce(k.b, d.v::DOUBLE), 6) AS Base FROM d LEFT JOIN k USING (AgeBin)
""")
def mobility_base(t: Tables):  # noqa: ANN201
    return pop.mobility_base(t["cohorts"]).select("AgeBin", F.bround("Base", 6).alias("Base"))
