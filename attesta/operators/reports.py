"""Run measures as tidy tables (A-3..A-6, A-11..A-14, A-26..A-28, R-1..R-9, P-12, P-13, O-5, O-6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_or_empty
from .intervals import household_move_members


def shares(df: DataFrame, column: str) -> DataFrame:
    """A-3, A-13. (value, n, pct): rows by value, blank as unknown, and percent of all rows."""
    counts = df.groupBy(F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.bround(F.col("n") * 100 / F.greatest(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(1)), 6))


def tolerance_check(expected: DataFrame, achieved: DataFrame, tolerance: float) -> DataFrame:
    """A-4. (category, expected, achieved, delta, within) over all categories of either table (category, pct); what is missing is zero."""
    both = expected.select("category", F.col("pct").alias("e")).join(achieved.select("category", F.col("pct").alias("a")), "category", "full")
    e, a = F.coalesce("e", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return both.select("category", F.bround(e, 6).alias("expected"), F.bround(a, 6).alias("achieved"), F.bround(a - e, 6).alias("delta"), (F.abs(a - e) <= tolerance).alias("within"))


def missingness(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None, blanks: bool = True) -> DataFrame:
    """A-5, A-6. (field, missing, pct), by a column if given: nulls, and blank texts unless that is off. One pass over all columns, then long form."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    names = [c for c in (columns or df.columns) if c != by]
    gone = lambda c: text_or_empty(F.col(c)) == "" if blanks and c in text else F.col(c).isNull()
    one = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("_rows"), *[F.coalesce(F.sum(gone(c).cast("long")), F.lit(0)).alias(c) for c in names])
    rows = one.select(*([by] if by else []), "_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in names])).alias("r"))
    return rows.select(*([by] if by else []), "r.field", "r.missing", F.coalesce(F.bround(F.col("r.missing") * 100 / F.nullif(F.col("_rows"), F.lit(0)), 6), F.lit(0.0)).alias("pct"))


def event_counts(events: DataFrame) -> DataFrame:
    """A-12. (couples_formed, divorces, births, moves, leave_homes, events)."""
    t = F.upper(F.trim("EventType"))
    n = lambda kind: F.coalesce(F.sum((t == kind).cast("long")), F.lit(0))
    return events.agg(n("COHABIT").alias("couples_formed"), n("DIVORCE").alias("divorces"), n("BIRTH").alias("births"), n("MOVE").alias("moves"), n("LEAVE_HOME").alias("leave_homes"), F.count("*").alias("events"))


def moves_per_person(events: DataFrame, memberships: DataFrame, people: DataFrame) -> DataFrame:
    """A-14. (PersonKey, moves) for all people: moves of their own, and of a household while they are in it."""
    moves = events.where(F.upper(F.trim("EventType")) == "MOVE")
    own = moves.where("SubjectPersonKey IS NOT NULL").select(F.col("SubjectPersonKey").alias("PersonKey"))
    home = household_move_members(moves.where("SubjectPersonKey IS NULL AND SubjectHouseholdKey IS NOT NULL"), memberships)
    each = own.groupBy("PersonKey").agg(F.count("*").alias("moves")).unionByName(home.groupBy("PersonKey").agg(F.count("*").alias("moves")))
    counts = each.groupBy("PersonKey").agg(F.sum("moves").alias("moves"))
    return people.select("PersonKey").distinct().join(counts, "PersonKey", "left").select("PersonKey", F.coalesce("moves", F.lit(0)).alias("moves"))


def moves_summary(moves: DataFrame) -> DataFrame:
    """(people, moved, total, mean_moves, most)."""
    return moves.agg(F.count("*").alias("people"), F.coalesce(F.sum((F.col("moves") > 0).cast("long")), F.lit(0)).alias("moved"), F.coalesce(F.sum("moves"), F.lit(0)).alias("total"), F.bround(F.avg("moves"), 6).alias("mean_moves"), F.max("moves").alias("most"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n)."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def ages(people: DataFrame, end: str) -> DataFrame:
    """People with Age in whole years of 365.25 days at the end, rounded half to even, from 0 to 110 (SC-21)."""
    age = F.bround(F.datediff(F.lit(end).cast("date"), F.col("DOB")) / 365.25, 0).cast("int")
    return people.withColumn("Age", age).where(F.col("Age").between(0, 110))


def age_summary(people: DataFrame, end: str) -> DataFrame:
    """A-26. (people, mode_age, std_age): the smallest mode and the sample deviation."""
    counts = ages(people, end).groupBy("Age").agg(F.count("*").alias("n"))
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("Age")), F.sum(F.col("n") * F.col("Age") * F.col("Age"))
    var = (q - s * s / n) / F.nullif(n - 1, F.lit(0))
    return counts.agg(n.alias("people"), F.min_by("Age", F.struct(-F.col("n"), "Age")).alias("mode_age"), F.bround(F.sqrt(var), 6).alias("std_age"))


def age_histogram(people: DataFrame, end: str) -> DataFrame:
    """A-27. (bin, n): five-year bins by their lower bound; the last holds 110 as well."""
    return ages(people, end).groupBy(F.least(F.floor(F.col("Age") / 5) * 5, F.lit(105)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def event_median_age(events: DataFrame, people: DataFrame, end: str, least: int = 3) -> DataFrame:
    """A-28, J-14. (EventType, n, median_age) of subjects with a known age, for types with enough of them."""
    rows = events.where("SubjectPersonKey IS NOT NULL").join(ages(people, end).select(F.col("PersonKey").alias("SubjectPersonKey"), "Age"), "SubjectPersonKey")
    return rows.groupBy("EventType").agg(F.count("*").alias("n"), F.median("Age").alias("median_age")).where(F.col("n") >= least)


# Ratings by score.
RATINGS = ("VERY EASY", "EASY", "MEDIUM", "HARD", "VERY HARD")


def difficulty(scenarios: DataFrame) -> DataFrame:
    """R-3. (scenario, score, rating) from (scenario, mode, overlap_pct, name_noise, dup_a, dup_b)."""
    overlap = F.when(F.col("mode") == "single_dataset", 0).when(F.col("overlap_pct") < 40, 3).when(F.col("overlap_pct") < 60, 2).when(F.col("overlap_pct") < 75, 1).otherwise(0)
    noise = F.when(F.col("name_noise") > 10, 2).when(F.col("name_noise") > 5, 1).otherwise(0)
    dup = F.when((F.col("dup_a") > 10) | (F.col("dup_b") > 10), 1).otherwise(0)
    score = overlap + noise + dup + F.when(F.col("mode") == "many_to_many", 1).otherwise(0)
    return scenarios.select("scenario", score.alias("score"), F.element_at(F.array(*map(F.lit, RATINGS)), F.least(score, F.lit(4)) + 1).alias("rating"))


def blocking_recommendation(scenarios: DataFrame) -> DataFrame:
    """R-8. (scenario, recommendation)."""
    advice = F.when(F.col("name_noise") > 8, "fuzzy blocking on names").when(F.col("overlap_pct") < 50, "restrictive blocking").when(F.col("dup_b") > 15, "deduplicate first").otherwise("last name and year of birth")
    return scenarios.select("scenario", advice.alias("recommendation"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """R-4. (metric, a, b, delta) of two tables (metric, value); a metric of one run alone has nulls."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return both.select("metric", "a", "b", F.bround(F.col("b") - F.col("a"), 6).alias("delta"))


def insights(overlap: DataFrame) -> DataFrame:
    """R-9. (a, b, insight) for each pair of datasets by its share of overlap."""
    text = F.when(F.col("pct_of_union") < 40, "low overlap: most people are in one dataset only").when(F.col("pct_of_union") < 60, "moderate overlap").when(F.col("pct_of_union") < 75, "good overlap").otherwise("high overlap")
    return overlap.select("a", "b", text.alias("insight"))


def _whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int").cast("string")


def missing_insights(missing: DataFrame, limit: float = 20) -> DataFrame:
    """R-9. (DatasetId, insight) from (DatasetId, field, pct): the field that is missing most, the first by name among equals, if that is more than the limit."""
    worst = missing.groupBy("DatasetId").agg(F.min(F.struct((-F.col("pct")).alias("m"), "field")).alias("first"))
    name, pct = F.col("first.field"), -F.col("first.m")
    return worst.select("DatasetId", F.when(pct > limit, F.concat(name, F.lit(" is missing in "), _whole(pct), F.lit(" % of rows: no blocking key"))).otherwise("few values are missing: most fields can block").alias("insight"))


def noise_insights(noise: DataFrame) -> DataFrame:
    """R-9. (a, b, insight) for each pair of datasets from (DatasetId, name_noise, sound_noise) in percent: sounds and nicknames of the second first, then which side is noisier."""
    side = lambda s: noise.select(F.col("DatasetId").alias(s), F.col("name_noise").alias(f"n_{s}"), F.col("sound_noise").alias(f"s_{s}"))
    text = F.when(F.col("s_b") > 5, "sounds and nicknames in the second break blocks of names").when(F.col("n_b") > F.col("n_a") * 2, "the second is much noisier: its fields count for less").otherwise("both are about as noisy")
    return side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b")).select("a", "b", text.alias("insight"))  # a row for each dataset


def age_insight(summary: DataFrame) -> DataFrame:
    """R-9. One row (insight) from age_summary()."""
    spread = F.when(F.col("std_age") > 20, "a wide spread, names collide across cohorts").otherwise("a narrow spread, ages set few people apart")
    return summary.select(F.concat(F.lit("most people are "), F.col("mode_age").cast("string"), F.lit(": "), spread).alias("insight"))


def event_insight(top: DataFrame, kind: str) -> DataFrame:
    """R-9. One row (insight) from dominant()."""
    share = F.when(F.col("total") > 0, F.concat(F.col(kind), F.lit(" is "), _whole(F.col("n") * 100 / F.col("total")), F.lit(" % of "), F.col("total").cast("string"), F.lit(" events"))).otherwise("no events")
    return top.select(share.alias("insight"))


def dataset_insights(rates: DataFrame) -> DataFrame:
    """R-9. (DatasetId, insight) from duplicate_rates(): what is left to deduplicate."""
    text = F.concat(F.col("row_count").cast("string"), F.lit(" rows of "), F.col("entities").cast("string"), F.lit(" people, "), F.col("duplicate_rows").cast("string"), F.lit(" to deduplicate"))
    return rates.select("DatasetId", text.alias("insight"))


def score_card(scenarios: DataFrame) -> DataFrame:
    """R-9. (scenario, insight): rating, score and advice of each."""
    both = difficulty(scenarios).join(blocking_recommendation(scenarios), "scenario")
    return both.select("scenario", F.concat("rating", F.lit(" ("), F.col("score").cast("string"), F.lit(" of 7): "), "recommendation").alias("insight"))


def weakest_pair(overlap: DataFrame) -> DataFrame:
    """O-6."""
    return overlap.agg(F.min_by(F.struct("a", "b", "pct_of_union"), F.struct("pct_of_union", "a", "b")).alias("p")).select("p.*")


def preview(df: DataFrame, order: Sequence[Column], n: int = 20) -> DataFrame:
    """O-3. The first rows of an order, kept by a top-n of every partition, never by a full sort."""
    return df.orderBy(*order).limit(n)


def recent(runs: DataFrame, by: str, n: int, where: Column | None = None) -> DataFrame:
    """O-5. The newest rows first, so many of them."""
    return (runs.where(where) if where is not None else runs).orderBy(F.desc(by)).limit(n)


# Classes of last names, and what source labels count as.
ETHNICITIES = ("American Indian & Alaskan Native", "Asian & Pacific Islander", "Black", "Hispanic", "Two or More Races", "White")
ETHNICITY_OF = {
    "White (Non-Hispanic)": "White", "Hispanic / Latino": "Hispanic", "Black / African American": "Black", "Asian": "Asian & Pacific Islander", "Multiracial / Other": "Two or More Races",
}


def ethnicity_shares(rows: DataFrame) -> DataFrame:
    """P-12. (Ethnicity, pct) for all classes from (label, value) such as "57.8%": the first number of the text, summed by class, zero where there is none."""
    label = F.create_map(*[F.lit(x) for p in ETHNICITY_OF.items() for x in p])[F.col("label")]
    known = rows.select(label.alias("Ethnicity"), F.regexp_extract("value", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias("pct")).groupBy("Ethnicity").agg(F.sum("pct").alias("pct"))
    classes = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ETHNICITIES))).alias("Ethnicity"))
    return classes.join(known, "Ethnicity", "left").select("Ethnicity", F.bround(F.coalesce("pct", F.lit(0.0)), 6).alias("pct"))


def age_range(label: Column) -> Column:
    """SC-5. "18-34" or "65+" as a struct of low and high; open ranges end at 95."""
    low = F.regexp_extract(label, r"([0-9]+)", 1).try_cast("int")
    high = F.regexp_extract(label, r"[0-9]+\s*-\s*([0-9]+)", 1).try_cast("int")
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.coalesce(high, F.lit(95)).alias("high")))


def moved_shares(rows: DataFrame, group: str, total: str, same: str) -> DataFrame:
    """P-13. (group, moved, moved_pct): total less those in the same house, summed by group."""
    sums = rows.groupBy(group).agg(F.sum(F.col(total) - F.col(same)).alias("moved"), F.sum(total).alias("_t"))
    return sums.select(group, "moved", F.bround(F.col("moved") / F.nullif(F.col("_t"), F.lit(0)) * 100, 6).alias("moved_pct"))


# Which lines of the mobility table by age make a cohort; the line of those who stayed in their house is so many lines below.
COHORT_LINES = {"age_0_17": (2, 3), "age_18_24": (4, 5), "age_25_34": (6, 7), "age_35_64": (8, 9, 10, 11, 12, 13), "age_65_plus": (14, 15, 16)}
STAYED = 16


def cohort_mobility(lines: DataFrame) -> DataFrame:
    """P-13. (age_cohort_id, population, moved_population, same_house_population, moved_past_year_pct) of all cohorts from (line, value): sums of a cohort's lines, less those who stayed.

    Lines that belong to no cohort are left out; a cohort without people has a null share. population.mobility_base() reads the result.
    """
    cohort = F.create_map(*[x for c, own in COHORT_LINES.items() for k in own for x in (F.lit(k), F.lit(c))])
    below = F.col("line") > max(k for own in COHORT_LINES.values() for k in own)
    named = lines.select(cohort[F.when(below, F.col("line") - STAYED).otherwise(F.col("line"))].alias("age_cohort_id"), below.alias("_stayed"), F.col("value").cast("long").alias("value")).where("age_cohort_id IS NOT NULL")
    n = lambda stayed: F.coalesce(F.sum(F.when(F.col("_stayed") == stayed, F.col("value"))), F.lit(0))
    sums = named.groupBy("age_cohort_id").agg(n(False).alias("population"), n(True).alias("same_house_population"))
    moved = F.col("population") - F.col("same_house_population")
    share = F.bround(moved * 100.0 / F.nullif(F.col("population"), F.lit(0)), 6)
    return sums.select("age_cohort_id", "population", moved.alias("moved_population"), "same_house_population", share.alias("moved_past_year_pct"))


def shares_of_total(rows: DataFrame, kind: str, count: str, total: str) -> DataFrame:
    """P-13. (kind, count, pct) of each kind but the total, as percentages of the total's count: household types of all households, kinds of moves of all people. Without a total the shares are null."""
    whole = rows.agg(F.sum(F.when(F.col(kind) == total, F.col(count))).alias("_total"))  # one row
    pct = F.bround(F.col(count) * 100.0 / F.nullif(F.col("_total"), F.lit(0)), 6)
    return rows.where(F.col(kind) != total).crossJoin(F.broadcast(whole)).select(kind, count, pct.alias("pct"))


def quality_metrics(parts: Mapping[str, DataFrame]) -> DataFrame:
    """R-1. (section, dataset, metric, value): each table's numeric columns as rows, with DatasetId, where there is one, as the dataset."""
    numeric = ("bigint", "int", "double", "boolean")
    out = None
    for section, df in parts.items():
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() in numeric]
        dataset = F.col("DatasetId") if "DatasetId" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(section).alias("section"), dataset.alias("dataset"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")).select("section", "dataset", "r.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("nothing to report")
    return out
