"""Entity-resolution measures: answer keys, overlaps, cardinalities, duplicates, drift, blocking matchers and their scores (J-9..J-11, X-*, A-15..A-21, R-12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text_or_empty

MODES = ("single_dataset", "one_to_one", "one_to_many", "many_to_one", "many_to_many")


def _ordinal(df: DataFrame, key: str, record: str, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(record)
    return df.select(F.col(key).alias("PersonKey"), F.col(record).alias(name), F.row_number().over(w).alias("n"))


def crosswalk(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """X-1. (PersonKey, A_RecordKey, B_RecordKey) from two tables (PersonKey, RecordKey), by match mode.

    one_to_one pairs records by place and leaves the rest one-sided; one_to_many pairs the first A with every B, further A one-sided; many_to_one is its mirror;
    any other mode pairs all. People in one table only are one-sided.
    """
    if mode not in MODES:
        raise ValueError(f"unknown match mode {mode!r}")
    left, right = _ordinal(a, "PersonKey", "RecordKey", "A_RecordKey"), _ordinal(b, "PersonKey", "RecordKey", "B_RecordKey")
    out = ["PersonKey", "A_RecordKey", "B_RecordKey"]
    if mode == "one_to_one":
        return left.join(right, ["PersonKey", "n"], "full").select(out)
    if mode == "one_to_many":
        first = left.where("n = 1").drop("n").join(right.drop("n"), "PersonKey", "full")
        return first.select(out).unionByName(left.where("n > 1").select("PersonKey", "A_RecordKey", F.lit(None).cast("string").alias("B_RecordKey")))
    if mode == "many_to_one":
        first = left.drop("n").join(right.where("n = 1").drop("n"), "PersonKey", "full")
        return first.select(out).unionByName(right.where("n > 1").select("PersonKey", F.lit(None).cast("string").alias("A_RecordKey"), "B_RecordKey"))
    return left.drop("n").join(right.drop("n"), "PersonKey", "full").select(out)


def all_crosswalks(record_map: DataFrame, datasets: list[str], mode: str) -> dict[tuple[str, str], DataFrame]:
    """X-3. A crosswalk for each pair of datasets of a map (PersonKey, DatasetId, RecordKey)."""
    of = lambda d: record_map.where(F.col("DatasetId") == d)
    return {(x, y): crosswalk(of(x), of(y), mode) for x, y in combinations(datasets, 2)}


def linked_pairs(walk: DataFrame) -> DataFrame:
    """F-8. Pairs with both keys, blank ones left out."""
    return walk.where((text_or_empty(F.col("A_RecordKey")) != "") & (text_or_empty(F.col("B_RecordKey")) != ""))


def record_counts(record_map: DataFrame) -> DataFrame:
    """(DatasetId, PersonKey, n): distinct records of a person in a dataset."""
    return record_map.groupBy("DatasetId", "PersonKey").agg(F.countDistinct("RecordKey").alias("n"))


def duplicate_rates(record_map: DataFrame) -> DataFrame:
    """A-16. For each dataset: rows, entities, rows beyond an entity's first and their share, share of entities with several records."""
    each = record_map.groupBy("DatasetId", "PersonKey").agg(F.count("*").alias("n"))
    out = each.groupBy("DatasetId").agg(F.sum("n").alias("row_count"), F.count("*").alias("entities"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.sum((F.col("n") > 1).cast("long")).alias("multi"))
    return out.select("DatasetId", "row_count", "entities", "duplicate_rows", F.bround(F.col("duplicate_rows") / F.col("row_count"), 6).alias("duplicate_rate"), F.bround(F.col("multi") * 100 / F.col("entities"), 6).alias("multi_entity_pct"))


def _pct(n: Column, of: Column) -> Column:
    return F.coalesce(F.bround(n * 100 / F.nullif(of, F.lit(0)), 6), F.lit(0.0))


def pairwise_overlap(record_map: DataFrame) -> DataFrame:
    """A-17, R-7. For each pair of datasets: people in both, in one only, in either, and shares. One group-by of people, then of pairs of their datasets.

    A person adds a row for each pair of datasets that hold it; datasets are few, people are many.
    """
    people = record_map.groupBy("PersonKey").agg(F.array_sort(F.collect_set("DatasetId")).alias("ds"))
    sizes = people.select(F.explode("ds").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    pairs = people.where(F.size("ds") > 1).select(F.explode(F.expr("flatten(transform(ds, (x, i) -> transform(filter(ds, (y, j) -> j > i), y -> struct(x as a, y as b))))")).alias("p"))
    both = pairs.select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = sizes.select(F.col("d").alias("a"), F.col("n").alias("na")), sizes.select(F.col("d").alias("b"), F.col("n").alias("nb"))
    every = F.broadcast(a).join(F.broadcast(b), F.col("a") < F.col("b"))  # one row for each pair of datasets
    n = F.coalesce("n", F.lit(0))
    out = every.join(both, ["a", "b"], "left").select("a", "b", n.alias("in_both"), (F.col("na") - n).alias("only_a"), (F.col("nb") - n).alias("only_b"), (F.col("na") + F.col("nb") - n).alias("in_either"), "na", "nb")
    return out.select("a", "b", "in_both", "only_a", "only_b", "in_either", _pct(F.col("in_both"), F.col("in_either")).alias("pct_of_union"), _pct(F.col("in_both"), F.col("na")).alias("pct_of_a"), _pct(F.col("in_both"), F.col("nb")).alias("pct_of_b"))


def nway_overlap(record_map: DataFrame) -> DataFrame:
    """A-18, U-2, U-3. (datasets, in_all, in_any, pct): people that every dataset holds, by counting each person's datasets."""
    people = record_map.groupBy("PersonKey").agg(F.countDistinct("DatasetId").alias("k"))
    total = record_map.agg(F.countDistinct("DatasetId").alias("datasets"))
    counts = people.groupBy("k").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    out = counts.groupBy("datasets").agg(F.coalesce(F.sum(F.when(F.col("k") == F.col("datasets"), F.col("n"))), F.lit(0)).alias("in_all"), F.sum("n").alias("in_any"))
    return out.select("datasets", "in_all", "in_any", _pct(F.col("in_all"), F.col("in_any")).alias("pct"))


def coverage_counters(members: DataFrame, base: DataFrame) -> DataFrame:
    """A-24. (DatasetId, entities, base_entities, late_entities, only_entities, shared_entities) from members (DatasetId, PersonKey) and the people that every dataset could have from the start.

    Late are people who are not among those; only are those of no other dataset; shared are those of all. Datasets are few, so a person's are an array.
    """
    known = base.select("PersonKey").distinct().withColumn("_base", F.lit(1))
    of = members.where("PersonKey IS NOT NULL").groupBy("PersonKey").agg(F.collect_set("DatasetId").alias("_in")).join(known, "PersonKey", "left")
    total = members.where("PersonKey IS NOT NULL").agg(F.count_distinct("DatasetId").alias("_all"))
    rows = of.crossJoin(F.broadcast(total)).select(F.explode("_in").alias("DatasetId"), F.size("_in").alias("_n"), "_all", "_base")  # one row of total
    return rows.groupBy("DatasetId").agg(
        F.count("*").alias("entities"), F.count("_base").alias("base_entities"), (F.count("*") - F.count("_base")).alias("late_entities"),
        F.count_if(F.col("_n") == 1).alias("only_entities"), F.count_if(F.col("_n") == F.col("_all")).alias("shared_entities"),
    )


def match_cardinality(a: DataFrame, b: DataFrame) -> DataFrame:
    """A-19. (cardinality, people) over people in both tables."""
    n = lambda df, name: df.groupBy("PersonKey").agg(F.countDistinct("RecordKey").alias(name))
    side = lambda c: F.when(F.col(c) <= 1, "one").otherwise("many")
    return n(a, "na").join(n(b, "nb"), "PersonKey").groupBy(F.concat(side("na"), F.lit("_to_"), side("nb")).alias("cardinality")).agg(F.count("*").alias("people"))


def pairwise_cardinality(record_map: DataFrame) -> DataFrame:
    """A-19 for all pairs of datasets. (a, b, one_to_one, one_to_many, many_to_one, many_to_many, evaluated): people in both by how many records they have on either side."""
    each = record_counts(record_map).groupBy("PersonKey").agg(F.array_sort(F.collect_list(F.struct("DatasetId", "n"))).alias("ds"))
    pair = "flatten(transform(ds, (x, i) -> transform(filter(ds, (y, j) -> j > i), y -> struct(x.DatasetId as a, y.DatasetId as b, x.n as na, y.n as nb))))"
    rows = each.where(F.size("ds") > 1).select(F.explode(F.expr(pair)).alias("p")).select("p.*")
    kinds = {"one_to_one": "na <= 1 AND nb <= 1", "one_to_many": "na <= 1 AND nb > 1", "many_to_one": "na > 1 AND nb <= 1", "many_to_many": "na > 1 AND nb > 1"}
    return rows.groupBy("a", "b").agg(*[F.sum(F.expr(c).cast("long")).alias(n) for n, c in kinds.items()], F.count("*").alias("evaluated"))


def ambiguity(record_map: DataFrame) -> DataFrame:
    """A-15. For each dataset: rows, ambiguous rows (their record belongs to another person first), people, mean and most records per person.

    First is by stable order of the person. The first person of each record comes from an aggregate that joins back, so a record that very many rows share is
    combined before the shuffle.
    """
    first = record_map.groupBy("DatasetId", "RecordKey").agg(F.min("PersonKey").alias("first"))
    rows = record_map.join(first, ["DatasetId", "RecordKey"]).groupBy("DatasetId").agg(F.count("*").alias("row_count"), F.sum((F.col("PersonKey") != F.col("first")).cast("long")).alias("ambiguous_rows"))
    each = record_counts(record_map).groupBy("DatasetId").agg(F.count("*").alias("people"), F.bround(F.avg("n"), 6).alias("mean_records"), F.max("n").alias("most_records"))
    return rows.join(each, "DatasetId")


def attribute_drift(observed: DataFrame, record_map: DataFrame, people: DataFrame, addresses: DataFrame) -> DataFrame:
    """A-20, J-6. For each dataset: mapped and unmapped rows, and shares of mapped rows whose name, phone or address differs from the truth.

    Names compare without case; any of first, middle and last may differ. addresses has (PersonKey, SourceSnapshotDate, AddressKey): the address of the row's own date.
    """
    truth = people.select("PersonKey", *[F.col(c).alias(f"t_{c}") for c in ("FirstName", "MiddleName", "LastName", "Phone")])
    rows = observed.join(record_map.select("DatasetId", "RecordKey", "PersonKey"), ["DatasetId", "RecordKey"], "left").join(truth.withColumn("_there", F.lit(True)), "PersonKey", "left")
    rows = rows.join(addresses.select("PersonKey", "SourceSnapshotDate", F.col("AddressKey").alias("t_AddressKey")), ["PersonKey", "SourceSnapshotDate"], "left")
    low = lambda c: F.lower(text_or_empty(F.col(c)))
    name = (low("FirstName") != low("t_FirstName")) | (low("MiddleName") != low("t_MiddleName")) | (low("LastName") != low("t_LastName"))
    mapped = F.coalesce(F.col("_there"), F.lit(False))
    share = lambda p, alias: F.coalesce(F.bround(F.avg(F.when(mapped, p.cast("double"))), 6), F.lit(0.0)).alias(alias)
    return rows.groupBy("DatasetId").agg(
        F.sum(mapped.cast("long")).alias("mapped"), F.sum((~mapped).cast("long")).alias("unmapped"), share(name, "name_drift"),
        share(text_or_empty(F.col("Phone")) != text_or_empty(F.col("t_Phone")), "phone_drift"), share(text_or_empty(F.col("AddressKey")) != text_or_empty(F.col("t_AddressKey")), "address_drift"),
    )


def block_name_dob(a: DataFrame, b: DataFrame) -> DataFrame:
    """J-10. (A_RecordKey, B_RecordKey) with equal last name and date of birth. Null or blank never matches."""
    side = lambda df, k: df.where((text_or_empty(F.col("LastName")) != "") & F.col("DOB").isNotNull()).select(F.col("RecordKey").alias(k), "LastName", "DOB")
    return side(a, "A_RecordKey").join(side(b, "B_RecordKey"), ["LastName", "DOB"]).select("A_RecordKey", "B_RecordKey").distinct()


def block_dob_prefix(a: DataFrame, b: DataFrame, letters: int = 3) -> DataFrame:
    """J-11. (A_RecordKey, B_RecordKey) with equal date of birth and equal first letters of the last name, without case. Null or blank never matches."""
    key = F.upper(F.substring(F.trim("LastName"), 1, letters))
    side = lambda df, k: df.where((text_or_empty(F.col("LastName")) != "") & F.col("DOB").isNotNull()).select(F.col("RecordKey").alias(k), key.alias("_p"), "DOB")
    return side(a, "A_RecordKey").join(side(b, "B_RecordKey"), ["_p", "DOB"]).select("A_RecordKey", "B_RecordKey").distinct()


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """A-21, U-6. (tp, fp, fn, precision_, recall_, f1) of distinct pairs; zero where a denominator is."""
    cols = ["A_RecordKey", "B_RecordKey"]
    p = predicted.select(cols).distinct().withColumn("p", F.lit(1))
    t = linked_pairs(truth).select(cols).distinct().withColumn("t", F.lit(1))
    n = lambda c, alias: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(alias)
    return _rates(p.join(t, cols, "full").agg(n(F.col("p").isNotNull() & F.col("t").isNotNull(), "tp"), n(F.col("t").isNull(), "fp"), n(F.col("p").isNull(), "fn")))


def _rates(sums: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision_, recall_, f1) of one row (tp, fp, fn)."""
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("tp", "fp", "fn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return sums.select(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.bround(ratio(tp, tp + fp), 6).alias("precision_"), F.bround(ratio(tp, tp + fn), 6).alias("recall_"), F.bround(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1")
    )


def name_dob_block() -> list[Column]:
    """The block of J-10: last name and date of birth."""
    return [F.when(text_or_empty(F.col("LastName")) != "", F.col("LastName")), F.col("DOB")]


def dob_prefix_block(letters: int = 3) -> list[Column]:
    """The block of J-11: the first letters of the last name, without case, and date of birth."""
    return [F.when(text_or_empty(F.col("LastName")) != "", F.upper(F.substring(F.trim("LastName"), 1, letters))), F.col("DOB")]


def block_confusion(a: DataFrame, b: DataFrame, block: Sequence[Column], person: str = "PersonKey") -> DataFrame:
    """A-21, U-6 of a blocking rule: (tp, fp, fn, precision_, recall_, f1) of the pairs of records that share a block, against those that share a person, without making a pair.

    A block finds as many pairs as the product of its records on both sides, and of these those of one person are true: one row for each block and person is all that is shuffled. Records whose block has
    a null part are in none; those without a person are linked with nothing. A record key stands for one record; rows that repeat one with equal block and person count once.
    """
    names = [f"_b{k}" for k in range(len(block))]
    side = lambda df, n: df.select(*[c.alias(x) for c, x in zip(block, names, strict=True)], F.col(person).alias("_p"), F.col("RecordKey").alias("_r")).distinct().withColumn("_s", F.lit(n))
    both = side(a, 0).unionByName(side(b, 1))
    n = lambda s: F.count_if(F.col("_s") == s)
    cells = both.groupBy(*names, "_p").agg(n(0).alias("a"), n(1).alias("b"))
    blocked = " AND ".join(f"{x} IS NOT NULL" for x in names)
    hit = F.when(F.col("_p").isNotNull(), F.col("a") * F.col("b")).otherwise(0)
    found = cells.where(blocked).groupBy(*names).agg((F.sum("a") * F.sum("b")).alias("found"), F.sum(hit).alias("tp")).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("found", "tp")])
    people = cells.where("_p IS NOT NULL").groupBy("_p").agg((F.sum("a") * F.sum("b")).alias("linked")).agg(F.coalesce(F.sum("linked"), F.lit(0).cast("long")).alias("linked"))
    sums = found.crossJoin(F.broadcast(people))  # one row each
    return _rates(sums.select("tp", (F.col("found") - F.col("tp")).alias("fp"), (F.col("linked") - F.col("tp")).alias("fn")))


def record_map_of(walks: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """R-1 from crosswalks alone: (DatasetId, RecordKey, PersonKey), each once, of all rows of crosswalks by their pair of datasets. Rows of one side only bring that side's record; records or people that are
    null bring none. A record that crosswalks give to several people stays with each, which ambiguity() counts. Overlap, cardinality, duplicates and drift follow from the map."""
    sides = [
        walk.select(F.lit(name).alias("DatasetId"), F.col(column).alias("RecordKey"), "PersonKey") for pair, walk in walks.items() for name, column in zip(pair, ("A_RecordKey", "B_RecordKey"), strict=True)
    ]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out.where("RecordKey IS NOT NULL AND PersonKey IS NOT NULL").distinct()


def error_reasons(predicted: DataFrame, truth: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """R-12. (A_RecordKey, B_RecordKey, error, reasons): false positives and negatives with what differs between the two records."""
    cols = ["A_RecordKey", "B_RecordKey"]
    p, t = predicted.select(cols).distinct(), linked_pairs(truth).select(cols).distinct()
    wrong = p.exceptAll(t).withColumn("error", F.lit("false_positive")).unionByName(t.exceptAll(p).withColumn("error", F.lit("false_negative")))
    side = lambda df, k: df.select(F.col("RecordKey").alias(f"{k}_RecordKey"), *[F.col(c).alias(f"{k}_{c}") for c in ("LastName", "DOB", "AddressKey", "MiddleName")])
    rows = wrong.join(side(a, "A"), "A_RecordKey", "left").join(side(b, "B"), "B_RecordKey", "left")
    differs = lambda c, name: F.when(~F.col(f"A_{c}").eqNullSafe(F.col(f"B_{c}")), name)
    missing = (text_or_empty(F.col("A_MiddleName")) == "") != (text_or_empty(F.col("B_MiddleName")) == "")
    reasons = F.concat_ws(", ", differs("LastName", "last name differs"), differs("DOB", "date of birth differs"), differs("AddressKey", "address differs"), F.when(missing, "middle name missing"))
    return rows.select(*cols, "error", reasons.alias("reasons"))


def dominant(df: DataFrame, kind: str) -> DataFrame:
    """A-29. (kind, n, total): the most frequent value, the first by name among equals, and the number of rows."""
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(F.col(kind), F.struct(-F.col("n"), kind)).alias(kind), F.max("n").alias("n"), F.sum("n").alias("total"))


def symmetric(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """J-15. Each pair both ways round, once."""
    return pairs.select(a, b).unionAll(pairs.select(F.col(b), F.col(a))).distinct()


def hash_pairs(df: DataFrame, key: str, seed: int, salt: str) -> DataFrame:
    """J-16. (first, second): neighbours in the order of hashes, two by two; an odd one out stays alone and is left out."""
    from .allocation import hash_rank

    ranked = hash_rank(df.select(key), key, seed, salt, "rn")
    side = lambda odd, name: ranked.where(F.col("rn") % 2 == odd).select(F.floor(F.col("rn") / 2).alias("pair"), F.col(key).alias(name))
    return side(0, "first").join(side(1, "second"), "pair").select("first", "second")
