from pyspark.sql import functions as F

from attesta.functions import hash_unit, title_case
from attesta.operators import population as pop

RECORDS = [("1", "1", "1", None, "female", "White", "HOUSE"), ("2", "1", "2", "AGE_18_34", "female", "White", "APARTMENT"), ("3", "2", "1", "age_35_64", "male", "Black", "HOUSE"), ("4", "3", "x", "age_65_plus", "female", "Hispanic", "APARTMENT")]
SCHEMA = "RecordKey string, PersonKey string, EntityRecordIndex string, AgeBin string, Gender string, Ethnicity string, ResidenceType string"


def view(spark):
    return pop.entity_view(spark.createDataFrame(RECORDS, SCHEMA))


def test_entity_view_takes_first_and_last_that_are_not_null(spark):
    got = {r.PersonKey: r for r in view(spark).collect()}
    assert (got["1"].AgeBin, got["1"].ResidenceType, got["1"].RedundancyProfile) == ("AGE_18_34", "APARTMENT", "multi_record")
    assert got["2"].RedundancyProfile == "single_record"


def test_filters(spark):
    traits = pop.latent_traits(view(spark), 7)
    c = pop.category_filter
    kept, counts = pop.filter_cascade(traits, [("age", c("AgeBin", ["age_18_34"])), ("gender", c("Gender", [" FEMALE"])), ("residence", c("ResidenceType", ["apartment"]))])
    assert [r.PersonKey for r in kept.collect()] == ["1"]
    assert [r.remaining for r in counts.orderBy("position").collect()] == [3, 1, 1, 1]


def test_sample_sizes():
    assert [pop.sample_size(10, *x) for x in (("all", 0), ("count", 3), ("count", 99), ("pct", 25), ("pct", 1), ("pct", 0))] == [10, 3, 10, 2, 1, 0]


def test_sample_does_not_depend_on_partitions_but_on_the_seed(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("PersonKey"))
    pick = lambda d, seed: sorted(r.PersonKey for r in pop.exact_sample(d, "PersonKey", "count", 50, seed).collect())
    assert pick(df.repartition(1), 1) == pick(df.repartition(17), 1) != pick(df, 2)
    assert len(pick(df, 3)) == 50


def test_checksum_of_nothing_and_stable_order(spark):
    import hashlib

    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "PersonKey string")
    assert pop.selection_checksum(df).first().checksum == hashlib.sha256(b"9|10|a|b").hexdigest()
    assert pop.selection_checksum(df.limit(0)).first().selected == 0


def test_mobility_base(spark):
    rows = spark.createDataFrame([("age_0_17", 10.0, 1000), ("age_18_24", 20.0, 800), ("age_25_34", 18.0, 900), ("age_35_64", 9.0, 1500)], "age_cohort_id string, moved_past_year_pct double, population long")
    got = {r.AgeBin: round(r.Base, 6) for r in pop.mobility_base(rows).collect()}
    assert got == {"age_0_17": 0.1, "age_18_34": 0.189412, "age_35_64": 0.09, "age_65_plus": 0.06}


def test_title_case_and_units(spark):
    row = spark.sql("select \"o'neil mc-donald\" as a, '' as b, cast(null as string) as c").select(*[title_case(F.col(c)).alias(c) for c in "abc"], hash_unit(1, "s", F.lit("k")).alias("u")).first()
    assert (row.a, row.b, row.c) == ("O'Neil Mc-Donald", "", None) and 0 <= row.u <= 1
