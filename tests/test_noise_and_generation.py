import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import allocation, emission, generation, noise
from attesta.operators.emission import DatasetSpec

D = dt.date


def one(spark, value, kind, f):
    return spark.createDataFrame([(value, "k")], f"v {kind}, k string").select(f(F.col("v"), F.col("k"))).first()[0]


def test_noise_rules(spark):
    assert one(spark, "123-45-6789", "string", lambda c, k: noise.mask_ssn(c)) == "***-**-6789"
    assert one(spark, "123", "string", lambda c, k: noise.mask_ssn(c)) is None
    assert one(spark, D(2000, 3, 4), "date", lambda c, k: noise.swap_month_day(c)) == D(2000, 4, 3)
    assert one(spark, D(2000, 3, 14), "date", lambda c, k: noise.swap_month_day(c)) == D(2000, 3, 14)
    assert one(spark, "Barn", "string", lambda c, k: noise.ocr(c, 1, "s", k)) == "Bam"
    assert one(spark, "xxx", "string", lambda c, k: noise.ocr(c, 1, "s", k)) == "xxx"
    assert one(spark, "Phua", "string", lambda c, k: noise.phonetic(c, 1, "s", k)) in {"Fua"}
    assert one(spark, "Vw", "string", lambda c, k: noise.phonetic(c, 1, "s", k)) == "Vw"
    got = one(spark, "90210", "string", lambda c, k: noise.zip_digit(c, 1, "s", k))
    assert sum(a != b for a, b in zip(got, "90210", strict=True)) == 1
    assert len(one(spark, "Smith", "string", lambda c, k: noise.typo(c, 1, "s", k))) == 5
    for f in (noise.typo, noise.ocr, noise.phonetic, noise.zip_digit):
        assert one(spark, None, "string", lambda c, k, f=f: f(c, 1, "s", k)) is None
        assert one(spark, "", "string", lambda c, k, f=f: f(c, 1, "s", k)) == ""


def test_noise_rates(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("RecordKey"), F.lit("Robert").alias("FirstName"), F.lit("Smith").alias("LastName"), F.lit("Lee").alias("MiddleName"))
    still = noise.apply_noise(df, noise.NoiseRates(), 1)
    assert still.where("FirstName <> 'Robert' OR LastName <> 'Smith'").count() == 0
    full = {r.operator: r.hits for r in noise.noise_counts(noise.apply_noise(df, noise.NoiseRates(typo=100, middle_missing=50), 1)).collect()}
    assert full["typo"] == 200 and 60 < full["middle_missing"] < 140 and full["ocr"] == 0
    with pytest.raises(ValueError):
        noise.NoiseRates(typo=101)


def test_quotas_and_draws(spark):
    shares = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "category string, share double")
    assert sorted(r.quota for r in allocation.quotas(shares, 10, 1).collect()) == [3, 3, 4]
    people = spark.range(100).select(F.col("id").cast("string").alias("k"))
    got = allocation.assigned(people, "k", shares, 100, 1).groupBy("category").count().collect()
    assert sorted(r["count"] for r in got) == [33, 33, 34]
    slots = allocation.alias_table([("x", 3.0), ("y", 1.0), ("z", 0.0)])
    odds = {v: sum((p if own == v else 0) + ((1 - p) if other == v else 0) for _, p, own, other in slots) / len(slots) for v in ("x", "y")}
    assert odds == {"x": 0.75, "y": 0.25}
    assert allocation.normalised({"a": 50, "b": 50, "c": None}) == {"a": 50, "b": 50}
    with pytest.raises(ValueError):
        allocation.normalised({"a": -1})


@pytest.mark.parametrize("make", [allocation.balanced_counts, allocation.heavy_tail_counts])
def test_records_per_person(spark, make):
    people = spark.range(60).select(F.col("id").cast("string").alias("k"))
    r = make(people, "k", 60, 100, 1, 1, 4).agg(F.sum("records"), F.min("records"), F.max("records")).first()
    assert r[0] == 100 and r[1] >= 1 and r[2] <= 4


def test_coverage_is_exact(spark):
    assert allocation.coverage_targets(100, 70, 85, 90) == (75, 85, 90)
    people = spark.range(100).select(F.col("id").cast("string").alias("k"))
    r = allocation.coverage(people, "k", 100, 60, 70, 80, 1).agg(*[F.sum(F.expr(c).cast("int")) for c in ("in_a", "in_b", "in_a AND in_b")]).first()
    assert tuple(r) == (70, 80, 60)
    r = allocation.nway_coverage(people, "k", 100, 20, (80, 50, 30), 1).agg(*[F.sum(F.expr(c).cast("int")) for c in ("in_0", "in_1", "in_2", "in_0 AND in_1 AND in_2")]).first()
    assert tuple(r)[:3] == (80, 50, 30) and r[3] >= 20


def test_duplication_counts(spark):
    people = spark.range(1000).select(F.col("id").cast("string").alias("PersonKey"))
    assert allocation.duplication(people, "PersonKey", 1000, 10, 1).agg(F.sum("records")).first()[0] == 1100


def test_emission_keys_are_dense(spark):
    snap = spark.range(1000).select(F.col("id").cast("string").alias("PersonKey"), F.lit("Robert").alias("FirstName"), F.lit(None).cast("string").alias("MiddleName"), F.lit("Smith").alias("LastName"), F.lit("2000-01-01").cast("date").alias("DOB"), F.lit("9").alias("Phone"))
    out = emission.emit(snap, snap.select("PersonKey"), 1000, DatasetSpec("d", "2026-01-01", 10), 0, 1)
    r = out.agg(F.count("*"), F.countDistinct("RecordKey"), F.min("RecordKey"), F.max("RecordKey")).first()
    assert tuple(r) == (1100, 1100, "d-000000001", "d-000001100")
    assert emission.entity_record_map([out]).count() == 1100
    same = lambda df: sorted(map(tuple, emission.emit(df, df.select("PersonKey"), 1000, DatasetSpec("d", "2026-01-01", 10), 0, 1).select("RecordKey", "PersonKey", "LastName").collect()))
    assert same(snap.repartition(1)) == same(snap.repartition(9))


def test_addresses_are_unique(spark):
    parts = generation.address_parts(F.col("id"), 20260303, 5, 7, 11, 13)
    assert spark.range(5 * 7 * 11 * 13).select(*[c.alias(n) for n, c in parts.items()]).distinct().count() == 5 * 7 * 11 * 13


def test_ages_of_births(spark):
    from attesta.functions import age_on

    rows = spark.range(500).select(F.col("id"), (F.col("id") % 90).cast("int").alias("a"))
    born = rows.withColumn("b", generation.born("id", 3, F.col("a"), F.col("a") + 5, "2024-02-29")).withColumn("age", age_on(F.col("b"), F.lit("2024-02-29").cast("date")))
    assert born.where("age < a OR age > a + 5").count() == 0
    assert spark.sql("select date '2000-02-29' as b, date '2001-02-28' as d").select(age_on(F.col("b"), F.col("d"))).first()[0] == 0


def test_collisions_share_a_leader(spark):
    people = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    got = generation.forced_collisions(people, "k", ["g"], 150, 1)
    sizes = {r["count"] for r in got.where("leader IS NOT NULL").groupBy("leader").count().collect()}
    assert sizes <= {3, 4, 5, 6, 7} and len(sizes) > 2 and got.count() == 300  # sizes are drawn, as no group need have the mean one
    assert abs(got.where("leader IS NOT NULL").count() - 150) <= 3 * 2
