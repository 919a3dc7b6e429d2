"""Baseline records: unique addresses by arithmetic, identifiers, name collisions, dates (G-4..G-9, G-13..G-16, A-7..A-10)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import concat_nonempty, hash_int, hash_unit, text_or_empty, title_case, years_before
from .allocation import group_sizes, range_numbered

# Constants of the linear congruences.
OFFSET_MUL, OFFSET_ADD = 6364136223846793005, 1442695040888963407
STRIDE_MUL, STRIDE_ADD = 11400714819323198485, 7046029254386353131
KNUTH, WORD = 2654435761, 4294967296


def address_constants(seed: int, space: int) -> tuple[int, int]:
    """(stride, offset) of a permutation of 0..space-1: the stride shares no factor with the space, so no two indexes meet."""
    offset = (abs(seed) * OFFSET_MUL + OFFSET_ADD) % space
    stride = (abs(seed) * STRIDE_MUL + STRIDE_ADD) % space or 1
    stride += stride % 2 == 0
    while math.gcd(stride, space) != 1:
        stride += 2
    return stride, offset


def address_parts(index: Column, seed: int, states: int, cities: int, streets: int, houses: int, least_house: int = 100) -> dict[str, Column]:
    """G-4. Positions of state, city and street and the house number of an index. Wide products are decimals, which don't overflow."""
    space = states * cities * streets * houses
    stride, offset = address_constants(seed, space)
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    mixed = ((index.cast("decimal(18,0)") * F.lit(str(stride)).cast("decimal(19,0)") + F.lit(str(offset)).cast("decimal(19,0)")) % wide(space)).cast("long")
    div = lambda c, n: F.floor(c / F.lit(n)).cast("long")
    city, street, house = div(mixed, states), div(mixed, states * cities), div(mixed, states * cities * streets)
    return {"state": mixed % states, "city": city % cities, "street": street % streets, "house": house + least_house}


def ssn(key: Column, seed: int) -> Column:
    """G-8. Three groups that avoid zeros and 666."""
    a = (key * 37 + seed) % 899 + 1
    a = F.when(a == 666, 665).otherwise(a)
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.concat_ws("-", pad(a, 3), pad((key * 73 + seed) % 99 + 1, 2), pad((key * 193 + seed) % 9999 + 1, 4))


def phone(key: Column, seed: int) -> Column:
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.concat_ws("-", pad((key * 31 + seed) % 800 + 200, 3), pad((key * 17 + seed) % 800 + 200, 3), pad((key * 43 + seed) % 10000, 4))


def postal_code(index: Column) -> Column:
    return F.lpad(((index * 7919) % 89999 + 10000).cast("string"), 5, "0")


def housing(row: Column, n_houses: int, units: int = 60) -> dict[str, Column]:
    """G-5. The first n_houses rows are houses; others are units of buildings, with the index of what stands at the address."""
    seq = row - n_houses
    house = row < n_houses
    building = F.floor(seq / F.lit(units)).cast("long")
    return {"ResidenceType": F.when(house, "HOUSE").otherwise("APARTMENT"), "building": F.when(~house, building), "unit": F.when(~house, seq % units), "base_index": F.when(house, row).otherwise(building + n_houses)}


def unit_label(unit: Column, numeric: float = 0.55, floor_letter: float = 0.30) -> Column:
    """G-6. 101, 102, ..., or a floor and a letter, or a wing and two digits, by a multiplicative hash of the unit. Labels repeat beyond 2,600 units a building."""
    token = ((unit * KNUTH) % WORD) / float(WORD)
    letter = lambda c: F.char(F.lit(65) + c)
    by_floor = F.concat((F.floor(unit / F.lit(26)) + 1).cast("string"), letter(unit % 26))
    wing = F.concat(letter(F.floor(unit / F.lit(100)) % 26), F.lpad((unit % 100 + 1).cast("string"), 2, "0"))
    return F.when(token < numeric, (unit + 101).cast("string")).when(token < numeric + floor_letter, by_floor).otherwise(wing)


def unit_type(building: Column, unit: Column, apt: float = 0.7, second: float = 0.2) -> Column:
    token = ((building * 1301 + unit * 7919) % 10000) / 10000.0
    return F.when(token < apt, "APT").when(token < apt + second, "UNIT").otherwise("STE")


def po_box(profile: Column, seed: int, box: Mapping[int, float], route: Mapping[int, float], keep: float = 0.17, least: int = 1, most: int = 799) -> dict[str, Column]:
    """G-7. Numbers with as many digits as tokens pick, and a shift of the postal code, from three congruences. A code may wrap to 100000, as it stands in the rule."""
    p = profile.cast("decimal(20,0)")
    token = lambda mul, s, add: ((p * mul + F.lit(str(s * seed + add)).cast("decimal(38,0)")) % WORD).cast("long")
    a, b, z = token(1103515245, 12345, 11), token(214013, 2531011, 17), token(1664525, 1013904223, 29)

    def digits(t: Column, odds: Mapping[int, float]) -> Column:
        total, u, acc, out = sum(odds.values()), t / float(WORD), 0.0, F.lit(max(odds))
        cuts = []
        for d, w in odds.items():
            acc += w / total
            cuts.append((d, acc))
        for d, cut in reversed(cuts[:-1]):
            out = F.when(u < cut, d).otherwise(out)
        return out

    def number(t: Column, odds: Mapping[int, float]) -> Column:
        low = F.pow(F.lit(10.0), digits(t, odds) - 1).cast("long")
        return F.when(low == 1, t % 9 + 1).otherwise(low + t % (low * 9))

    shift = F.when(z / float(WORD) < keep, 0).otherwise(z % (most - least + 1) + least)
    return {"box_number": number(a, box), "route_number": number(b, route), "zip_shift": shift.cast("long")}


def shifted_zip(code: Column, shift: Column) -> Column:
    return F.lpad(((code.cast("long") + shift - 1) % 100000 + 1).cast("string"), 5, "0")


def born(key: Column | str, seed: int, age_min: Column, age_max: Column, reference: str) -> Column:
    """G-14. A date of birth that gives an age from age_min to age_max on the reference date, uniform over days."""
    ref = F.lit(reference).cast("date")
    first, last = F.date_add(years_before(ref, age_max + 1), 1), years_before(ref, age_min)
    days = F.datediff(last, first) + 1
    return F.date_add(first, F.floor(hash_unit(seed, "dob", key) * days).cast("int"))


def residence_interval(key: Column | str, seed: int, first_year: int, reference: str, open_share: float = 0.84, least_days: int = 90) -> dict[str, Column]:
    """G-15. A start since the first year; an open end with some odds, else one at least so many days on and up to the reference date, or open if there is none."""
    ref, low = F.lit(reference).cast("date"), F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    start = F.date_add(low, F.floor(hash_unit(seed, "residence:start", key) * (F.datediff(ref, low) + 1)).cast("int"))
    room = F.datediff(ref, start) - least_days
    end = F.date_add(start, (F.lit(least_days) + F.floor(hash_unit(seed, "residence:end", key) * (room + 1))).cast("int"))
    return {"ResidenceStartDate": start, "ResidenceEndDate": F.when((hash_unit(seed, "residence:open", key) >= open_share) & (room >= 0), end)}


def optional(value: Column, key: Column | str, seed: int, salt: str, pct: float) -> Column:
    """G-3, F-7. The value in so many percent of rows, else null."""
    return F.when(hash_unit(seed, f"fill:{salt}", key) < pct / 100, value)


def forced_collisions(people: DataFrame, key: str, bucket: Sequence[str], target: int, seed: int, low: int = 3, high: int = 7) -> DataFrame:
    """G-9. people with `leader`: within each bucket the first by hash form groups of low..high that share their leader's name; others have null.

    target people are spread over the buckets in proportion; a group's size is drawn by hash of its number. Names come by joining on the leader's key.
    """
    share = people.count()
    if not share or target < low:
        return people.withColumn("leader", F.lit(None).cast(people.schema[key].dataType))
    by = list(bucket)
    rows = people.withColumn("_u", hash_unit(seed, "collision", key))
    # a bucket's members are ranked inside finer hash cells, so that a bucket of any size stays distributed
    cells = rows.withColumn("_cell", F.floor(F.col("_u") * 4096).cast("long"))
    counts = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy("_u", key)) - 1
    same = [cells[c].eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)]
    offsets = counts.withColumn("_before", before).select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)], F.col("_cell").alias("_k"), "_before")
    on = (cells["_cell"] == F.col("_k")) if not same else reduce(lambda x, y: x & y, same, cells["_cell"] == F.col("_k"))
    ranked = cells.withColumn("_own", own).join(offsets, on).withColumn("_rank", F.col("_before") + F.col("_own"))
    # null buckets have keys of their own, so that groups join back by equality
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]
    named = F.concat_ws("|", *text) if by else F.lit("")
    targets = people.groupBy(named.alias("_bucket")).agg(F.floor(F.count("*") * target / F.lit(share)).cast("long").alias("target"))
    groups = group_sizes(targets, ["_bucket"], seed, "collision", low, high).select("_bucket", "first", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("_rank"))
    placed = ranked.withColumn("_bucket", named).join(groups, ["_bucket", "_rank"], "left")
    leaders = placed.where(F.col("_rank") == F.col("first")).select("_bucket", "first", F.col(key).alias("leader"))
    return placed.join(leaders, ["_bucket", "first"], "left").select(*people.columns, "leader")


def collision_metrics(df: DataFrame, name: str) -> DataFrame:
    """A-7. (members, member_pct, groups, smallest, largest) of values that more than one row has."""
    groups = df.groupBy(name).agg(F.count("*").alias("n"))
    sums = groups.agg(F.sum("n").alias("total"), *[f.alias(a) for f, a in ((F.sum(F.when(F.col("n") > 1, F.col("n"))), "m"), (F.sum((F.col("n") > 1).cast("long")), "groups"), (F.min(F.when(F.col("n") > 1, F.col("n"))), "lo"), (F.max(F.when(F.col("n") > 1, F.col("n"))), "hi"))])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return sums.select(zero("m").alias("members"), F.coalesce(F.bround(zero("m") * 100 / F.col("total"), 6), F.lit(0.0)).alias("member_pct"), zero("groups").alias("groups"), zero("lo").alias("smallest"), zero("hi").alias("largest"))


def duplicate_keys(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """A-8. (key_set, duplicate_rows): rows less distinct keys, for every set of columns."""
    out = None
    for name, cols in key_sets.items():
        one = df.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")).select(F.lit(name).alias("key_set"), "duplicate_rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no key sets")
    return out


def name_consistency(df: DataFrame, key: str = "PersonKey", name: str = "FirstName") -> DataFrame:
    """A-10. (people, consistent): whether every person has one first name at most."""
    each = df.groupBy(key).agg(F.countDistinct(name).alias("n"))
    return each.agg(F.count("*").alias("people"), F.coalesce(F.max("n") <= 1, F.lit(True)).alias("consistent"))


def address_book(records: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """G-17. For each AddressKey the first value of every column that is not blank, in a stated order."""
    key = F.struct(*order)
    return records.where("AddressKey IS NOT NULL").groupBy("AddressKey").agg(*[F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(text_or_empty(F.col(c)) != "", key)).alias(c) for c in columns])


def synthesised_address(key: Column, seed: int, streets: Sequence[str], places: Sequence[tuple[str, str, str]], unit_types: Sequence[str], low: int = 100, span: int = 9800) -> dict[str, Column]:
    """G-16. An address for a key that no book has: each part by its own hash; one in five has a unit."""
    of = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (hash_int(seed, salt, len(values), key) + 1).cast("int"))
    spot = of(range(len(places)), "location")
    part = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in places]), spot + 1)
    has = hash_int(seed, "unit-flag", 5, key) == 0
    house, street = (hash_int(seed, "base", span, key) + low).cast("string"), of(streets, "street")
    kind, number = F.when(has, of(unit_types, "unit-type")), F.when(has, (hash_int(seed, "unit-num", 999, key) + 1).cast("string"))
    return {"HouseNumber": house, "StreetName": street, "UnitType": kind, "UnitNumber": number, "StreetAddress": concat_nonempty(house, street, kind, number), "City": part(0), "State": part(1), "ZipCode": part(2)}


# What addresses are made of where a book says nothing.
STREETS = ("Main St", "Oak Ave", "Maple Dr", "Cedar Ln", "Pine Rd")
PLACES = (("Little Rock", "AR", "72201"), ("North Little Rock", "AR", "72114"), ("Conway", "AR", "72032"), ("Benton", "AR", "72015"))
UNIT_TYPES = ("Apt", "Unit", "Ste")


def _pool(book: DataFrame, columns: Sequence[str], defaults: Sequence[Sequence[str]]) -> tuple[DataFrame | None, int]:
    """Distinct values of the book's columns with dense numbers, or the defaults if there are any; and how many there are."""
    names = ", ".join(f"`{c}` string" for c in columns)
    if set(columns) <= set(book.columns):
        known = book.where(" AND ".join(f"coalesce(trim(`{c}`), '') <> ''" for c in columns)).select(*[F.trim(c).alias(c) for c in columns]).distinct()
        pool = range_numbered(known, [F.col(c) for c in columns], "_at")
        if n := pool.count():
            return pool, n
    if not defaults:
        return None, 0
    rows = [(*v, k) for k, v in enumerate(defaults)]
    return book.sparkSession.createDataFrame(rows, f"{names}, _at long"), len(rows)


def completed_book(keys: DataFrame, book: DataFrame, seed: int) -> DataFrame:
    """G-16. The book with an address for every key of keys (AddressKey) that it lacks; all parts are columns, and StreetAddress is made where it is missing.

    Each part is drawn by its own hash from the book's own values, or from fixed ones where it has none, by joining on a dense number, so pools of any size stay distributed;
    one address in five has a unit.
    """
    parts = ("HouseNumber", "StreetName", "UnitType", "UnitNumber", "City", "State", "ZipCode")
    key = F.col("AddressKey")
    new = keys.where(text_or_empty(key) != "").select("AddressKey").distinct().join(book.select("AddressKey"), "AddressKey", "left_anti")
    draws = (("base", ("HouseNumber",), ()), ("street", ("StreetName",), [(v,) for v in STREETS]), ("location", ("City", "State", "ZipCode"), PLACES), ("unit-type", ("UnitType",), [(v,) for v in UNIT_TYPES]))
    for salt, columns, defaults in draws:
        pool, n = _pool(book, columns, defaults)
        if pool is None:
            new = new.withColumn(columns[0], (hash_int(seed, salt, 9800, key) + 100).cast("string"))
        else:
            new = new.withColumn("_at", hash_int(seed, salt, n, key)).join(pool, "_at").drop("_at")
    has = hash_int(seed, "unit-flag", 5, key) == 0
    new = new.withColumns({"UnitNumber": F.when(has, (hash_int(seed, "unit-num", 999, key) + 1).cast("string")), "UnitType": F.when(has, F.col("UnitType"))})
    text = lambda df, c: (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
    both = book.select("AddressKey", *[text(book, c) for c in parts], text(book, "StreetAddress")).unionByName(new.select("AddressKey", *parts, F.lit(None).cast("string").alias("StreetAddress")))
    return both.withColumn("StreetAddress", F.coalesce("StreetAddress", F.nullif(concat_nonempty(*[F.col(c) for c in ("HouseNumber", "StreetName", "UnitType", "UnitNumber")]), F.lit(""))))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """U-1. Values, trimmed and in upper case, in the order of their first place; blanks left out."""
    v = F.upper(F.trim(value))
    return df.where(text_or_empty(F.col(value)) != "").groupBy(v.alias("value")).agg(F.min(position).alias("position"))


def name_weights(sources: Sequence[DataFrame]) -> DataFrame:
    """A-1, U-5, F-10. (name, sex, weight) summed over sources (name, sex, weight); blank names and weights that are not positive left out."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return rows.where((text_or_empty(F.col("name")) != "") & (F.col("weight") > 0)).groupBy(title_case(F.trim("name")).alias("name"), "sex").agg(F.sum("weight").alias("weight"))


def nickname_display(records: DataFrame, catalogue: DataFrame, key: str, seed: int, pct: float) -> DataFrame:
    """G-13. records with DisplayName and FirstNameType: in so many percent a nickname from the category of the gender, else unisex, else other.

    catalogue has (category, FormalName, variants array). Nicknames join by formal name and the best category that has the name.
    """
    rank = F.when(F.col("category") == F.lower("Gender"), 0).when(F.col("category") == "unisex", 1).otherwise(2)
    pairs = records.select("FormalFirstName", "Gender").distinct().join(catalogue.withColumnRenamed("FormalName", "FormalFirstName"), "FormalFirstName")
    best = pairs.groupBy("FormalFirstName", "Gender").agg(F.min_by("variants", F.struct(rank.alias("rank"), "category")).alias("_variants"))
    cond = records["FormalFirstName"].eqNullSafe(best["FormalFirstName"]) & records["Gender"].eqNullSafe(best["Gender"])
    rows = records.join(best, cond, "left").select(records["*"], "_variants")
    at = (hash_int(seed, "nickname:pick", F.greatest(F.size("_variants"), F.lit(1)), key) + 1).cast("int")
    chosen = F.when(hash_unit(seed, "nickname:gate", key) < pct / 100, F.try_element_at("_variants", at))
    return rows.withColumns({"DisplayName": F.coalesce(chosen, F.col("FormalFirstName")), "FirstNameType": F.when(chosen.isNotNull(), "NICKNAME").otherwise("FORMAL")}).drop("_variants")


def upper_text(df: DataFrame) -> DataFrame:
    """P-9. All text columns in upper case; nulls stay."""
    return df.select(*[F.upper(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def last_name_weights(rows: DataFrame) -> DataFrame:
    """A-2. (last_name, ethnicity, weight) summed by name in upper case; blank names and weights that are not positive left out."""
    good = rows.where((text_or_empty(F.col("name")) != "") & (F.col("weight") > 0))
    return good.groupBy(F.upper(F.trim("name")).alias("last_name"), "ethnicity").agg(F.sum("weight").alias("weight"))


def quality_report(records: DataFrame, key_sets: Mapping[str, Sequence[str]], columns: Sequence[str], shares_of: Sequence[str], name: str, key: str = "PersonKey") -> DataFrame:
    """R-2. (section, dataset, metric, value) of baseline records: collisions of a name, rows that repeat a set of keys, consistency of names, missing cells, shares, and records per entity.

    dataset is what a row is about: a set of keys, a column, column=value, or a number of records.
    """
    from .allocation import records_summary
    from .reports import missingness, quality_metrics, shares

    about = lambda df, c, *keep: df.select(F.col(c).cast("string").alias("DatasetId"), *keep)
    parts = {
        "collisions": collision_metrics(records, name), "duplicates": about(duplicate_keys(records, key_sets), "key_set", "duplicate_rows"), "names": name_consistency(records, key, name),
        "missing": about(missingness(records, columns), "field", "missing", "pct"), "records": about(records_summary(records.groupBy(key).agg(F.count("*").alias("records"))), "records", "entities"),
    }
    for c in shares_of:
        parts[f"shares_{c}"] = about(shares(records, c).withColumn("value", F.concat(F.lit(f"{c}="), "value")), "value", "n", "pct")
    return quality_metrics(parts)
