"""Noise operators for observed records (N-1..N-12). Each is a column expression; draws are hashes of seed, salt and record, so they may run on streams as well."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_int, hash_unit, title_case

# Pairs of letters that read alike, letters that read alike, and spellings that sound alike, in the order they are listed.
OCR_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"))
OCR_SINGLE = (("O", "0"), ("0", "O"), ("l", "1"), ("l", "I"), ("1", "l"), ("1", "I"), ("I", "l"), ("I", "1"), ("B", "8"), ("8", "B"), ("S", "5"), ("5", "S"), ("G", "6"), ("6", "G"), ("Z", "2"), ("2", "Z"), ("m", "rn"))
PHONETIC = (
    ("ph", "f"), ("f", "ph"), ("ck", "k"), ("k", "ck"), ("ie", "y"), ("y", "ie"), ("th", "d"), ("d", "th"), ("v", "w"), ("w", "v"), ("sm", "zm"),
    ("sch", "sh"), ("sh", "sch"), ("ey", "ay"), ("ay", "ey"), ("yn", "in"), ("in", "yn"), ("ow", "o"), ("o", "ow"), ("er", "ar"), ("ar", "er"),
)


def typo(c: Column, seed: int, salt: str, key: Column) -> Column:
    """N-1. One letter replaced by a random A-Z, which may be the same."""
    at = hash_int(seed, f"{salt}:at", F.greatest(F.length(c), F.lit(1)), key)
    letter = F.char(F.lit(65) + hash_int(seed, f"{salt}:letter", 26, key))
    return F.when(F.length(c) > 0, F.overlay(c, letter, (at + 1).cast("int"), F.lit(1))).otherwise(c)


def shift_days(c: Column, seed: int, salt: str, key: Column, most: int = 3) -> Column:
    """N-3. A date moved by -most..most days; null stays null."""
    return F.date_add(c, (hash_int(seed, salt, 2 * most + 1, key) - most).cast("int"))


def mask_ssn(c: Column) -> Column:
    """N-4. All but the last four; shorter ones become null."""
    return F.when(F.length(c) >= 4, F.concat(F.lit("***-**-"), F.right(c, F.lit(4))))


def _replace_at(c: Column, place: Column, old: Column, new: Column) -> Column:
    return F.overlay(c, new, place.cast("int"), F.length(old).cast("int"))


def _picked(options: Column, seed: int, salt: str, key: Column) -> Column:
    """A random element; null of an empty array."""
    return F.try_element_at(options, (hash_int(seed, salt, F.greatest(F.size(options), F.lit(1)), key) + 1).cast("int"))


def _table(pairs) -> Column:  # noqa: ANN001
    return F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in pairs])


def ocr(c: Column, seed: int, salt: str, key: Column) -> Column:
    """N-7. A pair of letters that reads as one, if there is any, at its first place; else one letter that reads as another. Case counts."""
    pair = _picked(F.filter(_table(OCR_PAIRS), lambda p: F.contains(c, p["old"])), seed, f"{salt}:pair", key)
    chars = F.filter(F.transform(F.split(c, "", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda s: s["x"] != "")
    singles = F.flatten(F.transform(chars, lambda s: F.transform(F.filter(_table(OCR_SINGLE), lambda p: p["old"] == s["x"]), lambda p: F.struct(s["at"].alias("at"), p["old"].alias("old"), p["new"].alias("new")))))
    single = _picked(singles, seed, f"{salt}:single", key)
    return F.when(pair.isNotNull(), _replace_at(c, F.instr(c, pair["old"]), pair["old"], pair["new"])).when(single.isNotNull(), _replace_at(c, single["at"], single["old"], single["new"])).otherwise(c)


def phonetic(c: Column, seed: int, salt: str, key: Column) -> Column:
    """N-8. A spelling that sounds alike, at its first place in any case, for names of three letters or more; an initial capital stays."""
    low = F.lower(c)
    rule = _picked(F.filter(_table(PHONETIC), lambda p: F.contains(low, p["old"])), seed, salt, key)
    new = _replace_at(c, F.instr(low, rule["old"]), rule["old"], rule["new"])
    first = F.substring(c, 1, 1)
    kept = F.when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
    return F.when((F.length(c) >= 3) & rule.isNotNull(), kept).otherwise(c)


def swap_month_day(c: Column) -> Column:
    """N-10. Month and day change places where that gives another date."""
    return F.when((F.day(c) <= 12) & (F.day(c) != F.month(c)), F.make_date(F.year(c), F.day(c), F.month(c))).otherwise(c)


def zip_digit(c: Column, seed: int, salt: str, key: Column) -> Column:
    """N-11. One digit up or down by one, round the corner."""
    digits = F.filter(F.transform(F.split(c, "", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda s: s["x"].rlike("^[0-9]$"))
    one = _picked(digits, seed, f"{salt}:at", key)
    step = F.when(hash_unit(seed, f"{salt}:step", key) < 0.5, 1).otherwise(9)
    new = ((one["x"].cast("int") + step) % 10).cast("string")
    return F.when(one.isNotNull(), F.overlay(c, new, one["at"].cast("int"), F.lit(1))).otherwise(c)


def nickname(c: Column, variants: Column, seed: int, salt: str, key: Column) -> Column:
    """N-9. One of a name's variants (an array, null or empty where there are none)."""
    return F.coalesce(_picked(variants, seed, salt, key), c)


def top_nicknames(catalogue: DataFrame, least: float = 5000, most: int = 2) -> DataFrame:
    """O-4. (FormalName, variants): the heaviest nicknames over a weight from (position, formal, nickname, weight); the last category of a name counts."""
    rows = catalogue.where((F.col("weight") > least) & (F.lower("nickname") != F.lower("formal")))
    by = rows.groupBy(title_case(F.col("formal")).alias("FormalName"), "position").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "nickname"))), 1, most).alias("best"))
    return by.groupBy("FormalName").agg(F.max_by("best", "position").alias("best")).select("FormalName", F.transform("best", lambda b: title_case(b["nickname"])).alias("variants"))


@dataclass(frozen=True)
class NoiseRates:
    """Percentages of records that each operator hits."""

    typo: float = 0.0
    middle_missing: float = 0.0
    dob_shift: float = 0.0
    ssn_mask: float = 0.0
    phone_missing: float = 0.0
    address_missing: float = 0.0
    ocr: float = 0.0
    phonetic: float = 0.0
    nickname: float = 0.0
    date_swap: float = 0.0
    zip_error: float = 0.0
    suffix_missing: float = 0.0
    extra: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k in OPERATIONS:
            if not 0 <= getattr(self, k) <= 100:
                raise ValueError(f"{k} must be from 0 to 100")


# The order in which operators apply; later ones see what earlier ones did.
OPERATIONS = ("typo", "middle_missing", "dob_shift", "ssn_mask", "phone_missing", "address_missing", "ocr", "phonetic", "nickname", "date_swap", "zip_error", "suffix_missing")
# What datasets get that say nothing else; the first is the A side, all others the B side.
DEFAULT_A = NoiseRates(typo=1, middle_missing=20, dob_shift=0.4, ssn_mask=1.5, phone_missing=0.8, address_missing=0.8)
DEFAULT_B = NoiseRates(typo=2.5, middle_missing=30, dob_shift=1.2, ssn_mask=6, phone_missing=3, address_missing=2.2)
ADDRESS_COLUMNS = ("AddressKey", "HouseNumber", "StreetName", "UnitType", "UnitNumber", "StreetAddress", "City", "State", "ZipCode")


def apply_noise(df: DataFrame, rates: NoiseRates, seed: int, key: str = "RecordKey", nicknames: bool = False) -> DataFrame:
    """G-22. df with the operators applied in order, and noise_<operator> columns true where one hit, whether or not the value changed.

    Needs the columns that an operator touches; operators whose columns are absent are skipped. nicknames: df has an array column `variants` of the first name.
    """
    k, have = F.col(key), set(df.columns)
    out = df
    for op in OPERATIONS:
        rate = getattr(rates, op) / 100
        hit = hash_unit(seed, f"gate:{op}", k) < rate if rate < 1 else F.lit(True)
        flag = F.col(f"noise_{op}")
        out = out.withColumn(f"noise_{op}", hit if rate > 0 else F.lit(False))
        if not rate:
            continue
        change: dict[str, Column] = {}
        if op in ("typo", "ocr", "phonetic"):
            share = 0.6 if op == "phonetic" else 0.5
            first = hash_unit(seed, f"field:{op}", k) < share
            make = {"typo": typo, "ocr": ocr, "phonetic": phonetic}[op]
            change = {c: F.when(flag & (first if c == "FirstName" else ~first), make(F.col(c), seed, op, k)).otherwise(F.col(c)) for c in ("FirstName", "LastName") if c in have}
        elif op in ("middle_missing", "phone_missing", "suffix_missing"):
            c = {"middle_missing": "MiddleName", "phone_missing": "Phone", "suffix_missing": "Suffix"}[op]
            change = {c: F.when(~flag, F.col(c))} if c in have else {}
        elif op == "address_missing":
            change = {c: F.when(~flag, F.col(c)) for c in ADDRESS_COLUMNS if c in have}
        elif op == "dob_shift" and "DOB" in have:
            change = {"DOB": F.when(flag, shift_days(F.col("DOB"), seed, op, k)).otherwise(F.col("DOB"))}
        elif op == "date_swap" and "DOB" in have:
            change = {"DOB": F.when(flag, swap_month_day(F.col("DOB"))).otherwise(F.col("DOB"))}
        elif op == "ssn_mask" and "SSN" in have:
            change = {"SSN": F.when(flag, mask_ssn(F.col("SSN"))).otherwise(F.col("SSN"))}
        elif op == "zip_error" and "ZipCode" in have:
            change = {"ZipCode": F.when(flag, zip_digit(F.col("ZipCode"), seed, op, k)).otherwise(F.col("ZipCode"))}
        elif op == "nickname" and nicknames and "FirstName" in have:
            change = {"FirstName": F.when(flag, nickname(F.col("FirstName"), F.col("variants"), seed, op, k)).otherwise(F.col("FirstName"))}
        out = out.withColumns(change)
    return out


def noise_counts(noised: DataFrame, by: str | None = None) -> DataFrame:
    """A-23, R-6. (operator, hits), for each value of `by` if given: the flags summed in one pass and turned into rows."""
    sums = [F.sum(F.col(f"noise_{op}").cast("long")).alias(op) for op in OPERATIONS]
    one = noised.groupBy(*([by] if by else [])).agg(*sums)
    return one.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(op).alias("operator"), F.coalesce(op, F.lit(0).cast("long")).alias("hits")) for op in OPERATIONS])).alias("r")).select(*([by] if by else []), "r.*")
