"""Queries of noise, generation, allocation and reports, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import age_on, as_int, concat_nonempty, hash_int, title_case
from ..operators import allocation, emission, er, generation, noise, reports
from ..sources.readers import scenario_status_counts
from ..sources.writers import renamed
from .adapters import Tables, int_sql, unit_sql, with_views
from .linkage import RAW

QUERIES, ORACLE_SQL = {}, {}
SEED, END = 11, "2026-01-01"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


# ---------------------------------------------------------------- noise


def _table(pairs) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"struct_pack(old := '{a}', new := '{b}')" for a, b in pairs) + "]"


def _pick(options: str, salt: str) -> str:
    return f"list_extract({options}, {int_sql(SEED, salt, f'greatest(len({options}), 1)', 'PersonKey')} + 1)"


def _put(s: str, at: str, old: str, new: str) -> str:
    return f"substr({s}, 1, CAST({at} AS BIGINT) - 1) || {new} || substr({s}, CAST({at} AS BIGINT) + length({old}))"


def _noise(name: str, value, sql: str, frm: str = "{people}") -> None:  # noqa: ANN001
    def f(t: Tables):  # noqa: ANN202
        return t["people"].select("PersonKey", value(F.col("PersonKey")).alias("value"))

    f.__name__ = f"noise_{name}"
    query(f"SELECT PersonKey, {sql} AS value FROM {frm}")(f)


_noise("typo", lambda k: noise.typo(F.col("LastName"), SEED, "typo", k), _put("LastName", f"({int_sql(SEED, 'typo:at', 'length(LastName)', 'PersonKey')} + 1)", "'x'", f"chr(CAST(65 + {int_sql(SEED, 'typo:letter', 26, 'PersonKey')} AS INT))"))
_noise("dob_shift", lambda k: noise.shift_days(F.col("DOB"), SEED, "dob", k), f"DOB + CAST({int_sql(SEED, 'dob', 7, 'PersonKey')} - 3 AS INT)")
_noise("ssn_mask", lambda k: noise.mask_ssn(F.col("SSN")), "'***-**-' || right(SSN, 4)")
_noise("date_swap", lambda k: noise.swap_month_day(F.col("DOB")), "CASE WHEN day(DOB) <= 12 AND day(DOB) <> month(DOB) THEN make_date(year(DOB), day(DOB), month(DOB)) ELSE DOB END")
_OPT = f"list_filter({_table(noise.OCR_PAIRS)}, lambda p: contains(LastName, p.old))"
_SINGLE = f"flatten(list_transform(range(1, length(LastName) + 1), lambda i: list_transform(list_filter({_table(noise.OCR_SINGLE)}, lambda p: p.old = substr(LastName, i, 1)), lambda p: struct_pack(spot := i, old := p.old, new := p.new))))"
_noise(
    "ocr", lambda k: noise.ocr(F.col("LastName"), SEED, "ocr", k),
    f"CASE WHEN pick IS NOT NULL THEN {_put('LastName', 'instr(LastName, pick.old)', 'pick.old', 'pick.new')} WHEN single IS NOT NULL THEN {_put('LastName', 'single.spot', 'single.old', 'single.new')} ELSE LastName END",
    f"(SELECT *, {_pick(_OPT, 'ocr:pair')} AS pick, {_pick(_SINGLE, 'ocr:single')} AS single FROM {{people}}) o",
)
_SOUND = f"list_filter({_table(noise.PHONETIC)}, lambda p: contains(lower(LastName), p.old))"
_noise(
    "phonetic", lambda k: noise.phonetic(F.col("LastName"), SEED, "phonetic", k), "CASE WHEN pick IS NULL OR length(LastName) < 3 THEN LastName ELSE upper(substr(new, 1, 1)) || substr(new, 2) END",
    f"(SELECT *, {_put('LastName', 'instr(lower(LastName), pick.old)', 'pick.old', 'pick.new')} AS new FROM (SELECT *, {_pick(_SOUND, 'phonetic')} AS pick FROM {{people}}) q) o",
)
_DIGITS = "list_filter(range(1, length(ZipCode) + 1), lambda i: regexp_full_match(substr(ZipCode, i, 1), '[0-9]'))"
_noise("zip_error", lambda k: noise.zip_digit(F.col("ZipCode"), SEED, "zip", k), _put("ZipCode", "spot", "'0'", f"CAST((CAST(substr(ZipCode, spot, 1) AS INT) + CASE WHEN {unit_sql(SEED, 'zip:step', 'PersonKey')} < 0.5 THEN 1 ELSE 9 END) % 10 AS VARCHAR)"), f"(SELECT *, {_pick(_DIGITS, 'zip:at')} AS spot FROM {{people}}) o")
_NICK = {"Robert": ["Bob", "Rob"], "Patricia": ["Pat"], "Jennifer": ["Jen", "Jenny"], "Michael": ["Mike"]}
_noise(
    "nickname", lambda k: noise.nickname(F.col("FirstName"), F.create_map(*[x for n, v in _NICK.items() for x in (F.lit(n), F.array(*map(F.lit, v)))])[F.col("FirstName")], SEED, "nick", k), f"coalesce({_pick('variants', 'nick')}, FirstName)",
    "(SELECT *, CASE FirstName " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in _NICK.items()) + " END AS variants FROM {people}) o",
)
_RATES = noise.NoiseRates(typo=9, middle_missing=35, dob_shift=3, ssn_mask=6, phone_missing=4, address_missing=3, ocr=8, phonetic=8, nickname=12, date_swap=6, zip_error=7, suffix_missing=10)
_gate = lambda op: f"{unit_sql(SEED, f'gate:{op}', 'PersonKey')} < {getattr(_RATES, op) / 100}"


@query(" UNION ALL ".join(f"SELECT '{op}' AS operator, CAST(sum(CASE WHEN {_gate(op)} THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM {{people}}" for op in noise.OPERATIONS))
def noise_profile(t: Tables):  # noqa: ANN201
    return noise.noise_counts(noise.apply_noise(t["people"], _RATES, SEED, "PersonKey"))


def _blanked(op: str, column: str) -> None:
    def f(t: Tables):  # noqa: ANN202
        only = noise.NoiseRates(**{op: getattr(_RATES, op)})
        return noise.apply_noise(t["people"], only, SEED, "PersonKey").select("PersonKey", F.col(column).alias("value"), F.col(f"noise_{op}").alias("hit"))

    f.__name__ = f"noise_{op}"
    query(f"SELECT PersonKey, CASE WHEN NOT ({_gate(op)}) THEN {column} END AS value, {_gate(op)} AS hit FROM {{people}}")(f)


for _op, _column in (("middle_missing", "MiddleName"), ("phone_missing", "Phone"), ("address_missing", "AddressKey"), ("suffix_missing", "Suffix")):
    _blanked(_op, _column)


# ---------------------------------------------------------------- allocation

_SHARES = [("apt", 41.7), ("house", 33.3), ("other", 0.4), ("ste", 24.6)]
_N = "(SELECT count(*) FROM {customer})"
_QUOTAS = f"""
WITH s(category, share) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _SHARES)}), x AS (SELECT category, share / sum(share) OVER () * {_N} AS x FROM s),
q AS (SELECT category, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, {unit_sql(SEED, 'quota', 'category')}) <= {_N} - sum(CAST(floor(x) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS quota FROM x)
"""


def _shares(t: Tables):  # noqa: ANN202
    return t.spark.createDataFrame(_SHARES, "category string, share double")


@query(_QUOTAS + " SELECT * FROM q")
def exact_quota(t: Tables):  # noqa: ANN201
    return allocation.quotas(_shares(t), t["customer"].count(), SEED)


_rank = lambda salt, key="PersonKey", extra="": f"row_number() OVER (ORDER BY {extra}{unit_sql(SEED, salt, key)}, {key}) - 1"


@query(_QUOTAS + f", c AS (SELECT category, sum(quota) OVER (ORDER BY category) AS hi, quota FROM q), r AS (SELECT PersonKey, {_rank('category')} AS n FROM {{people}}) SELECT r.PersonKey, c.category FROM r JOIN c ON r.n < c.hi AND r.n >= c.hi - c.quota")
def quota_assignment(t: Tables):  # noqa: ANN201
    return allocation.assigned(t["people"].select("PersonKey"), "PersonKey", _shares(t), t["customer"].count(), SEED)


@query(f"SELECT PersonKey, {_rank('order')} AS number FROM {{people}}")
def hash_rank(t: Tables):  # noqa: ANN201
    return allocation.hash_rank(t["people"].select("PersonKey"), "PersonKey", SEED, "order")


_WEIGHTS = [("Anna", 50.0), ("Bea", 30.0), ("Cleo", 15.0), ("Dora", 5.0), ("Never", 0.0)]


@query(f"WITH s(slot, odds, own, other) AS (VALUES {', '.join(repr(x) for x in allocation.alias_table(_WEIGHTS))}) SELECT PersonKey, CASE WHEN {unit_sql(SEED, 'name:side', 'PersonKey')} < odds::DOUBLE THEN own ELSE other END AS name FROM {{people}} JOIN s ON s.slot = {int_sql(SEED, 'name:slot', 4, 'PersonKey')}")
def weighted_draw(t: Tables):  # noqa: ANN201
    slots, n = allocation.slots_frame(t.spark, _WEIGHTS)
    return allocation.weighted_draw(t["people"].select("PersonKey"), "PersonKey", slots, n, SEED, "name", "name")


@query(f"SELECT PersonKey, 1 + 1 + CASE WHEN {_rank('records')} < CAST(floor({_N} * 0.4) AS BIGINT) THEN 1 ELSE 0 END AS records FROM {{people}}")
def balanced_records(t: Tables):  # noqa: ANN201
    n = t["customer"].count()
    return allocation.balanced_counts(t["people"].select("PersonKey"), "PersonKey", n, 2 * n + int(n * 0.4), SEED)


def _heavy_tail(alpha: float = 1.3, most: int = 10) -> str:
    """G-11 in SQL: five passes of eight candidates for the scale, then the records that are still missing, in rounds by another hash."""
    out = f"""
WITH n AS (SELECT count(*) AS n, 2 * count(*) AS target FROM {{people}}), r AS MATERIALIZED (SELECT PersonKey, pow(rk + 1.0::DOUBLE, -{alpha}e0) AS w FROM (SELECT PersonKey, {_rank('records')} AS rk FROM {{people}}) x),
b0 AS (SELECT 0e0 AS lo, {most}e0 * pow(n::DOUBLE, {alpha}e0) AS hi FROM n)"""
    for i in range(5):
        out += f""",
t{i} AS MATERIALIZED (SELECT s, sum(least({most}, 1 + floor(w * s))) AS total FROM r, (SELECT lo + (hi - lo) * k / 9 AS s FROM b{i}, range(1, 9) x(k)) y GROUP BY s),
b{i + 1} AS MATERIALIZED (SELECT coalesce((SELECT max(s) FROM t{i}, n WHERE total <= target), lo) AS lo, coalesce((SELECT min(s) FROM t{i}, n WHERE total > target), hi) AS hi FROM b{i})"""
    out += f", c0 AS MATERIALIZED (SELECT PersonKey, CAST(least({most}, 1 + floor(w * lo)) AS BIGINT) AS records FROM r, b5)"
    for i in range(4):
        out += f""",
m{i} AS MATERIALIZED (SELECT PersonKey FROM (SELECT PersonKey, {_rank('room')} AS q FROM c{i} WHERE records < {most}) x WHERE q < (SELECT target FROM n) - (SELECT sum(records) FROM c{i})),
c{i + 1} AS MATERIALIZED (SELECT c.PersonKey, records + CASE WHEN m.PersonKey IS NULL THEN 0 ELSE 1 END AS records FROM c{i} c LEFT JOIN m{i} m ON m.PersonKey = c.PersonKey)"""
    return out + " SELECT PersonKey, records FROM c4"


@query(_heavy_tail())
def heavy_tail_records(t: Tables):  # noqa: ANN201
    n = t["customer"].count()
    return allocation.heavy_tail_counts(t["people"].select("PersonKey"), "PersonKey", n, 2 * n, SEED)


@query(f"WITH c AS (SELECT 1 + 1 + CASE WHEN {_rank('records')} < CAST(floor({_N} * 0.4) AS BIGINT) THEN 1 ELSE 0 END AS records FROM {{people}}) SELECT records, count(*) AS entities FROM c GROUP BY records")
def records_histogram(t: Tables):  # noqa: ANN201
    return allocation.records_summary(balanced_records(t))


@query(f"WITH c AS (SELECT PersonKey, 2 + CASE WHEN {_rank('records')} < CAST(floor({_N} * 0.4) AS BIGINT) THEN 1 ELSE 0 END AS records FROM {{people}}) SELECT PersonKey, CAST(unnest(range(1, records + 1)) AS INT) AS \"copy\" FROM c")
def record_expansion(t: Tables):  # noqa: ANN201
    return allocation.expanded(balanced_records(t), "records").select("PersonKey", "copy")


_COVER = f"""
WITH k AS (SELECT count(*) AS n, round_even(0.85 * count(*), 0) AS a, round_even(0.9 * count(*), 0) AS b FROM {{people}}), s AS (SELECT n, a, b, greatest(greatest(0, a + b - n), least(round_even(0.7 * n, 0), a, b)) AS o FROM k),
r AS (SELECT PersonKey, {_rank('coverage')} AS p FROM {{people}})
"""


@query(_COVER + "SELECT PersonKey, p < a AS in_a, p < o OR (p >= a AND p < a + b - o) AS in_b FROM r CROSS JOIN s")
def coverage_pairwise(t: Tables):  # noqa: ANN201
    return allocation.coverage(t["people"].select("PersonKey"), "PersonKey", t["customer"].count(), 70, 85, 90, SEED)


_APPEAR = (80, 50, 30)


def _nway() -> str:
    out = f"WITH n AS (SELECT count(*) AS n FROM {{people}}), z AS (SELECT round_even(0.8 * n, 0) AS s0, round_even(0.5 * n, 0) AS s1, round_even(0.3 * n, 0) AS s2, least(round_even(0.2 * n, 0), round_even(0.3 * n, 0)) AS o FROM n), r AS (SELECT PersonKey, {_rank('overlap')} < o AS common, 0 AS times FROM {{people}} CROSS JOIN z)"
    for k in range(3):
        src = "r" if k == 0 else f"t{k - 1}"
        keep = "".join(f", in_{j}" for j in range(k))
        place = f"row_number() OVER (ORDER BY CASE WHEN common THEN -1 ELSE times END, {unit_sql(SEED, f'fill:{k}', 'PersonKey')}, PersonKey) - 1"
        out += f", p{k} AS (SELECT PersonKey, common, times{keep}, {place} < s{k} AS in_{k} FROM {src} CROSS JOIN z), t{k} AS (SELECT PersonKey, common, times + CAST(in_{k} AS INT) AS times{keep}, in_{k} FROM p{k})"
    return out + " SELECT PersonKey, in_0, in_1, in_2 FROM t2"


@query(_nway())
def coverage_nway(t: Tables):  # noqa: ANN201
    return allocation.nway_coverage(t["people"].select("PersonKey"), "PersonKey", t["customer"].count(), 20, _APPEAR, SEED)


@query(f"WITH d AS (SELECT {int_sql(SEED, 'extra', _N, 'i')} AS n, count(*) AS e FROM range((SELECT CAST(round_even(count(*) * 12 / 100, 0) AS BIGINT) FROM {{people}})) x(i) GROUP BY 1), r AS (SELECT PersonKey, {_rank('extras')} AS n FROM {{people}}) SELECT PersonKey, 1 + coalesce(e, 0) AS records FROM r LEFT JOIN d USING (n)")
def duplication_allocation(t: Tables):  # noqa: ANN201
    return allocation.duplication(t["people"].select("PersonKey"), "PersonKey", t["customer"].count(), 12, SEED)


# ---------------------------------------------------------------- generation

_S, _C, _T, _H = 50, 400, 900, 9000
_SPACE = _S * _C * _T * _H
_STRIDE, _OFFSET = generation.address_constants(SEED, _SPACE)


@query(f"WITH m AS (SELECT o_orderkey, (o_orderkey::HUGEINT * {_STRIDE} + {_OFFSET}) % {_SPACE} AS m FROM {{orders}}) SELECT o_orderkey, CAST(m % {_S} AS BIGINT) AS state, CAST(m // {_S} % {_C} AS BIGINT) AS city, CAST(m // {_S * _C} % {_T} AS BIGINT) AS street, CAST(m // {_S * _C * _T} + 100 AS BIGINT) AS house FROM m")
def address_decode(t: Tables):  # noqa: ANN201
    parts = generation.address_parts(F.col("o_orderkey"), SEED, _S, _C, _T, _H)
    return t["orders"].select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


def _pad(e: str, n: int) -> str:
    return f"lpad(CAST({e} AS VARCHAR), {n}, '0')"


@query(f"SELECT c_custkey, concat_ws('-', CASE WHEN (c_custkey * 37 + {SEED}) % 899 + 1 = 666 THEN '665' ELSE {_pad(f'(c_custkey * 37 + {SEED}) % 899 + 1', 3)} END, {_pad(f'(c_custkey * 73 + {SEED}) % 99 + 1', 2)}, {_pad(f'(c_custkey * 193 + {SEED}) % 9999 + 1', 4)}) AS ssn, concat_ws('-', {_pad(f'(c_custkey * 31 + {SEED}) % 800 + 200', 3)}, {_pad(f'(c_custkey * 17 + {SEED}) % 800 + 200', 3)}, {_pad(f'(c_custkey * 43 + {SEED}) % 10000', 4)}) AS phone, {_pad('c_custkey * 7919 % 89999 + 10000', 5)} AS zip FROM {{customer}}")
def identifiers(t: Tables):  # noqa: ANN201
    k = F.col("c_custkey")
    return t["customer"].select(k, generation.ssn(k, SEED).alias("ssn"), generation.phone(k, SEED).alias("phone"), generation.postal_code(k).alias("zip"))


_HOUSES = 500


@query(f"""
WITH b AS (SELECT c_custkey, c_custkey < {_HOUSES} AS house, (c_custkey - {_HOUSES}) // 60 AS b, (c_custkey - {_HOUSES}) % 60 AS u FROM {{customer}}), k AS (SELECT *, (u * 2654435761 % 4294967296) / 4294967296.0::DOUBLE AS tok, ((b * 1301 + u * 7919) % 10000) / 10000.0::DOUBLE AS typ FROM b)
SELECT c_custkey, CASE WHEN house THEN 'HOUSE' ELSE 'APARTMENT' END AS ResidenceType, CASE WHEN house THEN c_custkey ELSE {_HOUSES} + b END AS base_index,
  CASE WHEN NOT house THEN CASE WHEN tok < 0.55 THEN CAST(101 + u AS VARCHAR) WHEN tok < 0.55::DOUBLE + 0.3::DOUBLE THEN CAST(1 + u // 26 AS VARCHAR) || chr(CAST(65 + u % 26 AS INT)) ELSE chr(CAST(65 + (u // 100) % 26 AS INT)) || lpad(CAST(u % 100 + 1 AS VARCHAR), 2, '0') END END AS label,
  CASE WHEN NOT house THEN CASE WHEN typ < 0.7 THEN 'APT' WHEN typ < 0.7::DOUBLE + 0.2::DOUBLE THEN 'UNIT' ELSE 'STE' END END AS kind FROM k
""")
def housing_units(t: Tables):  # noqa: ANN201
    h = generation.housing(F.col("c_custkey"), _HOUSES)
    rows = t["customer"].select("c_custkey", *[c.alias(n) for n, c in h.items()])
    return rows.select("c_custkey", "ResidenceType", "base_index", F.when(F.col("unit").isNotNull(), generation.unit_label(F.col("unit"))).alias("label"), F.when(F.col("unit").isNotNull(), generation.unit_type(F.col("building"), F.col("unit"))).alias("kind"))


@query(f"""
WITH k AS (SELECT c_custkey, CAST((c_custkey::HUGEINT * 1103515245 + {SEED * 12345 + 11}) % 4294967296 AS BIGINT) AS a, CAST((c_custkey::HUGEINT * 214013 + {SEED * 2531011 + 17}) % 4294967296 AS BIGINT) AS b, CAST((c_custkey::HUGEINT * 1664525 + {SEED * 1013904223 + 29}) % 4294967296 AS BIGINT) AS z FROM {{customer}})
SELECT c_custkey, CASE WHEN a / 4294967296.0::DOUBLE < 0.10::DOUBLE THEN 100 + a % 900 WHEN a / 4294967296.0::DOUBLE < 0.10::DOUBLE + 0.42::DOUBLE THEN 1000 + a % 9000 ELSE 10000 + a % 90000 END AS box_number,
  CASE WHEN b / 4294967296.0::DOUBLE < 0.5 THEN 100 + b % 900 ELSE 1000 + b % 9000 END AS route_number, CASE WHEN z / 4294967296.0::DOUBLE < 0.17 THEN 0 ELSE z % 799 + 1 END AS zip_shift,
  lpad(CAST((c_custkey * 7919 % 89999 + 10000 + CASE WHEN z / 4294967296.0::DOUBLE < 0.17 THEN 0 ELSE z % 799 + 1 END - 1) % 100000 + 1 AS VARCHAR), 5, '0') AS mailing_zip FROM k
""")
def po_box_profile(t: Tables):  # noqa: ANN201
    k = F.col("c_custkey")
    rows = t["customer"].select(k, *[c.alias(n) for n, c in generation.po_box(k, SEED, {3: 10, 4: 42, 5: 48}, {3: 50, 4: 50}).items()])
    return rows.withColumn("mailing_zip", generation.shifted_zip(generation.postal_code(k), F.col("zip_shift")))


@query(f"""
WITH a AS (SELECT PersonKey, Age, CAST(DATE '{END}' - INTERVAL 1 YEAR * (Age + 10) AS DATE) AS first_, CAST(DATE '{END}' - INTERVAL 1 YEAR * Age AS DATE) AS last_ FROM {{people}}), b AS (SELECT PersonKey, CAST(first_ + 1 AS DATE) AS lo, last_ AS hi FROM a)
SELECT PersonKey, lo + CAST(floor({unit_sql(SEED, 'dob', 'PersonKey')} * (datediff('day', lo, hi) + 1)) AS INT) AS DOB FROM b
""")
def birth_dates(t: Tables):  # noqa: ANN201
    return t["people"].select("PersonKey", generation.born("PersonKey", SEED, F.col("Age"), F.col("Age") + 9, END).alias("DOB"))


@query(f"""
WITH s AS (SELECT PersonKey, DATE '1995-01-01' + CAST(floor({unit_sql(SEED, 'residence:start', 'PersonKey')} * (datediff('day', DATE '1995-01-01', DATE '{END}') + 1)) AS INT) AS s FROM {{people}}), r AS (SELECT *, datediff('day', s, DATE '{END}') - 90 AS room FROM s)
SELECT PersonKey, s AS ResidenceStartDate, CASE WHEN {unit_sql(SEED, 'residence:open', 'PersonKey')} >= 0.84 AND room >= 0 THEN s + CAST(90 + floor({unit_sql(SEED, 'residence:end', 'PersonKey')} * (room + 1)) AS INT) END AS ResidenceEndDate FROM r
""")
def residence_draw(t: Tables):  # noqa: ANN201
    return t["people"].select("PersonKey", *[c.alias(n) for n, c in generation.residence_interval("PersonKey", SEED, 1995, END).items()])


@query(f"SELECT PersonKey, CASE WHEN {unit_sql(SEED, 'fill:phone', 'PersonKey')} < 98 / 100::DOUBLE THEN Phone END AS Phone FROM {{people}}")
def optional_fields(t: Tables):  # noqa: ANN201
    return t["people"].select("PersonKey", generation.optional(F.col("Phone"), "PersonKey", SEED, "phone", 98).alias("Phone"))


@query(f"""
WITH u AS (SELECT PersonKey, coalesce('=' || Ethnicity, '') AS bucket, row_number() OVER (PARTITION BY Ethnicity ORDER BY {unit_sql(SEED, 'collision', 'PersonKey')}, PersonKey) - 1 AS r, count(*) OVER (PARTITION BY Ethnicity) AS n, count(*) OVER () AS total FROM {{people}}),
t AS (SELECT DISTINCT bucket, CAST(floor(n * 600 / total) AS BIGINT) AS target FROM u), d AS (SELECT bucket, target, unnest(range(0, target // 3 + 1)) AS g FROM t WHERE target >= 3),
z AS (SELECT *, 3 + CAST(CAST('0x' || substr(sha256(concat_ws('|', '{SEED}', 'collision:size', bucket, CAST(g AS VARCHAR))), 1, 16) AS UBIGINT) % 5 AS BIGINT) AS size FROM d),
p AS (SELECT *, sum(size) OVER (PARTITION BY bucket ORDER BY g) - size AS first FROM z),
f AS (SELECT bucket, first, CASE WHEN target - first - size = 1 AND size < 7 THEN size + 1 WHEN target < first + size THEN target - first ELSE size END AS size FROM p WHERE first < target),
m AS (SELECT u.PersonKey, u.bucket, u.r, f.first FROM u JOIN f ON u.bucket = f.bucket AND u.r >= f.first AND u.r < f.first + f.size WHERE f.size >= 3)
SELECT u.PersonKey, l.PersonKey AS leader FROM u LEFT JOIN m ON m.PersonKey = u.PersonKey LEFT JOIN m l ON l.bucket = m.bucket AND l.r = m.first
""")
def forced_collisions(t: Tables):  # noqa: ANN201
    return generation.forced_collisions(t["people"].select("PersonKey", "Ethnicity"), "PersonKey", ["Ethnicity"], 600, SEED).select("PersonKey", "leader")


@query("WITH g AS (SELECT FirstName || LastName AS k, count(*) AS n FROM {people} GROUP BY 1) SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS members, round_even(sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100 / sum(n), 6) AS member_pct, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups, min(n) FILTER (WHERE n > 1) AS smallest, max(n) FILTER (WHERE n > 1) AS largest FROM g")
def collision_metrics(t: Tables):  # noqa: ANN201
    return generation.collision_metrics(t["people"].withColumn("name", F.concat("FirstName", "LastName")), "name")


@query("SELECT 'record' AS key_set, count(*) - count(DISTINCT RecordKey) AS duplicate_rows FROM {records} UNION ALL SELECT 'person', count(*) - count(DISTINCT PersonKey) FROM {records} UNION ALL SELECT 'place', count(*) - count(DISTINCT (StreetName, HouseNumber)) FROM {records}")
def uniqueness_suite(t: Tables):  # noqa: ANN201
    return generation.duplicate_keys(t["records"], {"record": ["RecordKey"], "person": ["PersonKey"], "place": ["StreetName", "HouseNumber"]})


@query("WITH g AS (SELECT PersonKey, count(DISTINCT AgeBin) AS n FROM {records} GROUP BY 1) SELECT count(*) AS people, max(n) <= 1 AS consistent FROM g")
def name_consistency(t: Tables):  # noqa: ANN201
    return generation.name_consistency(t["records"], "PersonKey", "AgeBin")


_QUALITY_KEYS = {"record": ["RecordKey"], "person": ["PersonKey"], "place": ["StreetName", "HouseNumber"]}
_metric = lambda section, about, metric, value, frm: f"SELECT '{section}' AS section, {about} AS dataset, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value FROM {frm}"
_NAMED = "(SELECT StreetName AS k, count(*) AS n FROM {records} GROUP BY 1) g"
_NAMES = "(SELECT PersonKey, count(DISTINCT StreetName) AS n FROM {records} GROUP BY 1) g"
_BLANK = "sum(CASE WHEN coalesce(trim({0}), '') = '' THEN 1 ELSE 0 END)"


@query(" UNION ALL ".join([
    *(_metric("collisions", "CAST(NULL AS VARCHAR)", m, v, _NAMED) for m, v in {
        "members": "coalesce(sum(n) FILTER (WHERE n > 1), 0)", "member_pct": "round_even(coalesce(sum(n) FILTER (WHERE n > 1), 0) * 100 / sum(n), 6)", "groups": "count(*) FILTER (WHERE n > 1)",
        "smallest": "coalesce(min(n) FILTER (WHERE n > 1), 0)", "largest": "coalesce(max(n) FILTER (WHERE n > 1), 0)",
    }.items()),
    *(_metric("duplicates", f"'{n}'", "duplicate_rows", f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c)} FROM {{records}}) d)", "{records}") for n, c in _QUALITY_KEYS.items()),
    _metric("names", "CAST(NULL AS VARCHAR)", "people", "count(*)", _NAMES), _metric("names", "CAST(NULL AS VARCHAR)", "consistent", "max(n) <= 1", _NAMES),
    *(_metric("missing", f"'{c}'", m, v, "{records}") for c in ("AgeBin", "Gender") for m, v in (("missing", _BLANK.format(c)), ("pct", f"round_even({_BLANK.format(c)} * 100 / count(*), 6)"))),
    _metric("records", "CAST(n AS VARCHAR)", "entities", "count(*)", "(SELECT PersonKey, count(*) AS n FROM {records} GROUP BY 1) g GROUP BY n"),
    *(_metric("shares_Gender", "'Gender=' || coalesce(nullif(trim(Gender), ''), 'unknown')", m, v, "{records} GROUP BY coalesce(nullif(trim(Gender), ''), 'unknown')") for m, v in (("n", "count(*)"), ("pct", "round_even(count(*) * 100 / sum(count(*)) OVER (), 6)"))),
]))
def baseline_quality(t: Tables):  # noqa: ANN201
    return generation.quality_report(t["records"], _QUALITY_KEYS, ("AgeBin", "Gender"), ("Gender",), "StreetName")


@query("SELECT PersonKey, LastName FROM {people} ORDER BY LastName, CAST(PersonKey AS BIGINT) LIMIT 20")
def preview_keys(t: Tables):  # noqa: ANN201
    return reports.preview(t["people"].select("PersonKey", "LastName"), [F.col("LastName"), F.col("PersonKey").cast("long")])


_BOOK = "SELECT 'ADDR_' || CAST(CAST(RecordKey AS BIGINT) % 700 AS STRING) AS AddressKey, StreetName, HouseNumber, RecordKey FROM {records}"


@query(f"SELECT AddressKey, first(trim(StreetName) ORDER BY CAST(RecordKey AS BIGINT)) FILTER (WHERE trim(StreetName) <> '') AS StreetName, first(HouseNumber ORDER BY CAST(RecordKey AS BIGINT)) AS HouseNumber FROM ({_BOOK}) b GROUP BY AddressKey")
def address_book(t: Tables):  # noqa: ANN201
    rows = t["records"].withColumns({"AddressKey": F.concat(F.lit("ADDR_"), (F.col("RecordKey").cast("long") % 700).cast("string")), "_order": F.col("RecordKey").cast("long")})
    return generation.address_book(rows, ["StreetName", "HouseNumber"], ["_order"])


_STREETS, _PLACES, _UNITS = ["Oak St", "Elm St", "Lake Dr", "Hill Rd", "Mill Ln"], [("Ashton", "OH", "44001"), ("Bristow", "VA", "20136"), ("Calder", "TX", "75001"), ("Dunmore", "PA", "18512")], ["Apt", "Unit", "Ste"]
_lst = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_at = lambda v, salt: f"list_extract({_lst(v)}, {int_sql(SEED, salt, len(v), 'AddressKey')} + 1)"
_spot = f"{int_sql(SEED, 'location', 4, 'AddressKey')} + 1"


@query(f"""
WITH a AS (SELECT AddressKey, CAST({int_sql(SEED, 'base', 9800, 'AddressKey')} + 100 AS VARCHAR) AS HouseNumber, {_at(_STREETS, 'street')} AS StreetName, CASE WHEN {int_sql(SEED, 'unit-flag', 5, 'AddressKey')} = 0 THEN {_at(_UNITS, 'unit-type')} END AS UnitType,
  CASE WHEN {int_sql(SEED, 'unit-flag', 5, 'AddressKey')} = 0 THEN CAST({int_sql(SEED, 'unit-num', 999, 'AddressKey')} + 1 AS VARCHAR) END AS UnitNumber, list_extract({_lst([p[0] for p in _PLACES])}, {_spot}) AS City, list_extract({_lst([p[1] for p in _PLACES])}, {_spot}) AS State, list_extract({_lst([p[2] for p in _PLACES])}, {_spot}) AS ZipCode FROM {{people}})
SELECT *, concat_ws(' ', HouseNumber, StreetName, UnitType, UnitNumber) AS StreetAddress FROM a
""")
def address_synthesis(t: Tables):  # noqa: ANN201
    parts = generation.synthesised_address(F.col("AddressKey"), SEED, _STREETS, _PLACES, _UNITS)
    return t["people"].select("AddressKey", *[c.alias(n) for n, c in parts.items()])


@query("SELECT upper(trim(w)) AS value, min(p_partkey) AS position FROM (SELECT p_partkey, split_part(p_name, ' ', 2) AS w FROM {part}) x WHERE trim(w) <> '' GROUP BY 1")
def ordered_distinct(t: Tables):  # noqa: ANN201
    return generation.ordered_distinct(t["part"].withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(2))), "w", "p_partkey")


@query("SELECT upper(substr(n, 1, 1)) || lower(substr(n, 2)) AS name, s AS sex, sum(w) AS weight FROM (SELECT split_part(p_name, ' ', 1) AS n, p_type AS s, p_size - 3.0::DOUBLE AS w FROM {part} UNION ALL SELECT upper(split_part(p_name, ' ', 1)), p_type, 1.0::DOUBLE FROM {part}) x WHERE w > 0 AND trim(n) <> '' GROUP BY ALL")
def name_weights(t: Tables):  # noqa: ANN201
    n = F.split_part("p_name", F.lit(" "), F.lit(1))
    return generation.name_weights([t["part"].select(n.alias("name"), F.col("p_type").alias("sex"), (F.col("p_size") - 3.0).alias("weight")), t["part"].select(F.upper(n).alias("name"), F.col("p_type").alias("sex"), F.lit(1.0).alias("weight"))])


@query("WITH c AS (SELECT p_partkey, p_name || '''' || lower(p_brand) AS s FROM {part}) SELECT p_partkey, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND regexp_full_match(substr(s, i - 1, 1), '[A-Za-z]') THEN lower(substr(s, i, 1)) ELSE upper(substr(s, i, 1)) END), '') AS title FROM c")
def title_case_names(t: Tables):  # noqa: ANN201
    return t["part"].select("p_partkey", title_case(F.concat("p_name", F.lit("'"), F.lower("p_brand"))).alias("title"))


@query("SELECT PersonKey, concat_ws(' ', FirstName, MiddleName, LastName, Suffix) AS full_name, greatest(0, year(DATE '2024-02-29') - year(DOB) - CASE WHEN strftime(DATE '2024-02-29', '%m%d') < strftime(DOB, '%m%d') THEN 1 ELSE 0 END) AS age FROM {people}")
def full_names_and_ages(t: Tables):  # noqa: ANN201
    return t["people"].select("PersonKey", concat_nonempty(*[F.col(c) for c in ("FirstName", "MiddleName", "LastName", "Suffix")]).alias("full_name"), age_on(F.col("DOB"), F.lit("2024-02-29").cast("date")).cast("long").alias("age"))


@query("SELECT RecordKey, upper(PersonKey) AS PersonKey, upper(AgeBin) AS AgeBin, upper(Gender) AS Gender FROM {records}")
def upper_text(t: Tables):  # noqa: ANN201
    return generation.upper_text(t["records"].select("RecordKey", "PersonKey", "AgeBin", "Gender"))


_CAT = [("female", "Mary", ["Molly", "Polly"]), ("unisex", "Robert", ["Rob"]), ("male", "Robert", ["Bob", "Bert"]), ("other", "Linda", ["Lin"]), ("male", "Linda", ["Lyn"])]
_CATSQL = ", ".join(f"('{c}', '{n}', {v})" for c, n, v in _CAT)


@query(f"""
WITH c(category, FormalName, variants) AS (VALUES {_CATSQL}), b AS (SELECT p.PersonKey, p.FirstName, (SELECT first(variants ORDER BY CASE WHEN category = lower(p.Gender) THEN 0 WHEN category = 'unisex' THEN 1 ELSE 2 END, category) FROM c WHERE FormalName = p.FirstName) AS v FROM {{people}} p),
d AS (SELECT *, CASE WHEN {unit_sql(SEED, 'nickname:gate', 'PersonKey')} < 0.35 THEN list_extract(v, {int_sql(SEED, 'nickname:pick', 'greatest(len(v), 1)', 'PersonKey')} + 1) END AS x FROM b)
SELECT PersonKey, coalesce(x, FirstName) AS DisplayName, CASE WHEN x IS NULL THEN 'FORMAL' ELSE 'NICKNAME' END AS FirstNameType FROM d
""")
def nickname_display(t: Tables):  # noqa: ANN201
    catalogue = t.spark.createDataFrame(_CAT, "category string, FormalName string, variants array<string>")
    return generation.nickname_display(t["people"].withColumnRenamed("FirstName", "FormalFirstName"), catalogue, "PersonKey", SEED, 35).select("PersonKey", "DisplayName", "FirstNameType")


@query("""
WITH c AS (SELECT p_type AS category, split_part(p_name, ' ', 1) AS formal, split_part(p_name, ' ', 2) AS nickname, CAST(sum(p_retailprice) AS DOUBLE) AS weight, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END AS position FROM {part} GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY formal, position ORDER BY weight DESC, nickname) AS rn FROM c WHERE weight > 5000 AND lower(nickname) <> lower(formal)), l AS (SELECT formal, max(position) AS position FROM f GROUP BY 1)
SELECT upper(substr(f.formal, 1, 1)) || substr(f.formal, 2) AS FormalName, string_agg(upper(substr(nickname, 1, 1)) || substr(nickname, 2), ',' ORDER BY rn) AS variants FROM f JOIN l USING (formal, position) WHERE rn <= 2 GROUP BY 1
""")
def top_nicknames(t: Tables):  # noqa: ANN201
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    place = F.when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_type") == "STANDARD", 2).when(F.col("p_type") == "PROMO", 3).when(F.col("p_type") == "SMALL", 4).otherwise(5)
    rows = t["part"].groupBy("p_type", word(1).alias("formal"), word(2).alias("nickname")).agg(F.sum("p_retailprice").alias("weight")).withColumn("position", place)
    return noise.top_nicknames(rows).select("FormalName", F.array_join("variants", ",").alias("variants"))


# ---------------------------------------------------------------- reports


@query("SELECT coalesce(nullif(trim(Gender), ''), 'unknown') AS value, count(*) AS n, round_even(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM {people} GROUP BY 1")
def category_shares(t: Tables):  # noqa: ANN201
    return reports.shares(t["people"], "Gender")


@query("""
WITH e(category, pct) AS (VALUES ('female', 50.5::DOUBLE), ('male', 49.5::DOUBLE), ('other', 0.0::DOUBLE)), a AS (SELECT coalesce(Gender, 'unknown') AS category, round_even(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM {people} GROUP BY 1)
SELECT category, round_even(coalesce(e.pct, 0), 6) AS expected, round_even(coalesce(a.pct, 0), 6) AS achieved, round_even(coalesce(a.pct, 0) - coalesce(e.pct, 0), 6) AS delta, abs(coalesce(a.pct, 0) - coalesce(e.pct, 0)) <= 1.5 AS within FROM e FULL JOIN a USING (category)
""")
def tolerance_check(t: Tables):  # noqa: ANN201
    expected = t.spark.createDataFrame([("female", 50.5), ("male", 49.5), ("other", 0.0)], "category string, pct double")
    return reports.tolerance_check(expected, reports.shares(t["people"], "Gender").select(F.col("value").alias("category"), "pct"), 1.5)


_FIELDS = ("AgeBin", "Gender", "StreetName", "HouseNumber")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(sum(CASE WHEN coalesce(trim({c}), '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing, round_even(sum(CASE WHEN coalesce(trim({c}), '') = '' THEN 1 ELSE 0 END) * 100 / count(*), 6) AS pct FROM {{records}}" for c in _FIELDS))
def missingness_long(t: Tables):  # noqa: ANN201
    return reports.missingness(t["records"], _FIELDS)


_OBS = "(SELECT * FROM {observed_a} UNION ALL SELECT * FROM {observed_b}) o"


@query(" UNION ALL ".join(f"SELECT DatasetId, '{c}' AS field, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round_even(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100 / count(*), 6) AS pct FROM {_OBS} GROUP BY DatasetId" for c in ("MiddleName", "Phone", "AddressKey")))
def missingness_by_dataset(t: Tables):  # noqa: ANN201
    return reports.missingness(t["observed_a"].unionByName(t["observed_b"]), ("MiddleName", "Phone", "AddressKey"), "DatasetId", blanks=False)


# Pairs of datasets of the record map as runs: their overlap, their duplicates, and as noise the share of rows whose record belongs to several people.
_PAIRS = f"""
WITH o AS ({RAW["pairwise_overlap"]}), d AS ({RAW["duplicate_rates"]}), m AS ({RAW["ambiguity"]}),
s AS (SELECT o.a || '/' || o.b AS scenario, CASE WHEN x.multi_entity_pct > 60 AND y.multi_entity_pct > 60 THEN 'many_to_many' ELSE 'one_to_many' END AS mode, o.pct_of_union AS overlap_pct,
        n.ambiguous_rows * 20.0::DOUBLE / n.row_count AS name_noise, x.duplicate_rate * 20 AS dup_a, y.duplicate_rate * 20 AS dup_b
      FROM o JOIN d x ON x.DatasetId = o.a JOIN d y ON y.DatasetId = o.b JOIN m n ON n.DatasetId = o.a)
"""


def _runs(t: Tables):  # noqa: ANN202
    side = lambda s: er.duplicate_rates(t["record_map"]).select(F.col("DatasetId").alias(s), (F.col("duplicate_rate") * 20).alias(f"dup_{s}"), F.col("multi_entity_pct").alias(f"multi_{s}"))
    noise = er.ambiguity(t["record_map"]).select(F.col("DatasetId").alias("a"), (F.col("ambiguous_rows") * 20.0 / F.col("row_count")).alias("name_noise"))
    mode = F.when((F.col("multi_a") > 60) & (F.col("multi_b") > 60), "many_to_many").otherwise("one_to_many")
    rows = er.pairwise_overlap(t["record_map"]).join(side("a"), "a").join(side("b"), "b").join(noise, "a")
    return rows.select(F.concat_ws("/", "a", "b").alias("scenario"), mode.alias("mode"), F.col("pct_of_union").alias("overlap_pct"), "name_noise", "dup_a", "dup_b")


@query(_PAIRS + """, p AS (SELECT scenario, CAST(CASE WHEN mode = 'single_dataset' THEN 0 WHEN overlap_pct < 40 THEN 3 WHEN overlap_pct < 60 THEN 2 WHEN overlap_pct < 75 THEN 1 ELSE 0 END
  + CASE WHEN name_noise > 10 THEN 2 WHEN name_noise > 5 THEN 1 ELSE 0 END + CASE WHEN dup_a > 10 OR dup_b > 10 THEN 1 ELSE 0 END + CASE WHEN mode = 'many_to_many' THEN 1 ELSE 0 END AS INT) AS score FROM s)
SELECT scenario, score, list_extract(['VERY EASY', 'EASY', 'MEDIUM', 'HARD', 'VERY HARD'], least(score, 4) + 1) AS rating FROM p""")
def difficulty_score(t: Tables):  # noqa: ANN201
    return reports.difficulty(_runs(t))


@query(_PAIRS + """SELECT scenario, CASE WHEN name_noise > 8 THEN 'fuzzy blocking on names' WHEN overlap_pct < 50 THEN 'restrictive blocking' WHEN dup_b > 15 THEN 'deduplicate first'
  ELSE 'last name and year of birth' END AS recommendation FROM s""")
def blocking_recommendation(t: Tables):  # noqa: ANN201
    return reports.blocking_recommendation(_runs(t))


@query(f"SELECT d.scenario, d.rating || ' (' || d.score || ' of 7): ' || b.recommendation AS insight FROM ({ORACLE_SQL['difficulty_score']}) d JOIN ({ORACLE_SQL['blocking_recommendation']}) b USING (scenario)")
def insights_score_card(t: Tables):  # noqa: ANN201
    return reports.score_card(_runs(t))


@query(f"""
SELECT DatasetId, CASE WHEN pct > 20 THEN field || ' is missing in ' || CAST(round_even(pct, 0) AS INT) || ' % of rows: no blocking key' ELSE 'few values are missing: most fields can block' END AS insight
FROM (SELECT *, row_number() OVER (PARTITION BY DatasetId ORDER BY pct DESC, field) AS n FROM ({ORACLE_SQL['missingness_by_dataset']}) m) x WHERE n = 1
""")
def insights_missing(t: Tables):  # noqa: ANN201
    return reports.missing_insights(reports.missingness(t["observed_a"].unionByName(t["observed_b"]), ("MiddleName", "Phone", "AddressKey"), "DatasetId", blanks=False))


_NOISY = "SELECT event_type AS DatasetId, avg(CASE WHEN event_id % 7 = 0 THEN 100 ELSE 0 END)::DOUBLE AS name_noise, avg(CASE WHEN user_id % 21 = 0 THEN 100 ELSE 0 END)::DOUBLE AS sound_noise FROM {events} GROUP BY 1"


@query(f"""
WITH n AS ({_NOISY}) SELECT x.DatasetId AS a, y.DatasetId AS b, CASE WHEN y.sound_noise > 5 THEN 'sounds and nicknames in the second break blocks of names'
  WHEN y.name_noise > x.name_noise * 2 THEN 'the second is much noisier: its fields count for less' ELSE 'both are about as noisy' END AS insight FROM n x JOIN n y ON x.DatasetId < y.DatasetId
""")
def insights_noise(t: Tables):  # noqa: ANN201
    share = lambda c: F.avg(F.when(F.expr(c), 100).otherwise(0))
    return reports.noise_insights(t["events"].groupBy(F.col("event_type").alias("DatasetId")).agg(share("event_id % 7 = 0").alias("name_noise"), share("user_id % 21 = 0").alias("sound_noise")))


@query("WITH a AS (SELECT event_type AS metric, round_even(avg(value), 6) AS value FROM {events} WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round_even(avg(value), 6) AS value FROM {events} WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT metric, a.value AS a, b.value AS b, round_even(b.value - a.value, 6) AS delta FROM a FULL JOIN b USING (metric)")
def run_compare(t: Tables):  # noqa: ANN201
    e = t["events"]
    of = lambda df: df.groupBy(F.col("event_type").alias("metric")).agg(F.bround(F.avg("value"), 6).alias("value"))
    return reports.compare_runs(of(e.where("event_id % 2 = 0")), of(e.where("event_id % 2 = 1 AND event_type <> 'view'")))


@query("SELECT event_id, ts FROM {events} WHERE event_type = 'click' ORDER BY ts DESC LIMIT 20")
def recent_runs(t: Tables):  # noqa: ANN201
    return reports.recent(t["events"], "ts", 20, F.col("event_type") == "click").select("event_id", "ts")


@query("""
WITH n AS (SELECT CASE label WHEN 'White (Non-Hispanic)' THEN 'White' WHEN 'Hispanic / Latino' THEN 'Hispanic' WHEN 'Black / African American' THEN 'Black' WHEN 'Asian' THEN 'Asian & Pacific Islander'
  WHEN 'Multiracial / Other' THEN 'Two or More Races' END AS Ethnicity, CAST(trim(replace(replace(value, 'about', ''), '%', '')) AS DOUBLE) AS x FROM {demographics}), s AS (SELECT Ethnicity, sum(x) AS x FROM n GROUP BY 1),
v(Ethnicity) AS (VALUES ('American Indian & Alaskan Native'), ('Asian & Pacific Islander'), ('Black'), ('Hispanic'), ('Two or More Races'), ('White'))
SELECT v.Ethnicity, round_even(coalesce(x, 0), 6) AS pct FROM v LEFT JOIN s ON s.Ethnicity = v.Ethnicity
""")
def demographics_reshape(t: Tables):  # noqa: ANN201
    return reports.ethnicity_shares(t["demographics"])


@query("""
WITH c(line, id) AS (SELECT line, CASE WHEN line <= 3 THEN 'age_0_17' WHEN line <= 5 THEN 'age_18_24' WHEN line <= 7 THEN 'age_25_34' WHEN line <= 13 THEN 'age_35_64' ELSE 'age_65_plus' END FROM range(2, 17) r(line)),
s AS (SELECT id, CAST(sum(CASE WHEN m.line = c.line THEN value ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN m.line = c.line + 16 THEN value ELSE 0 END) AS BIGINT) AS h FROM c JOIN {mobility_lines} m ON m.line IN (c.line, c.line + 16)
  WHERE NOT (m.line = c.line AND m.line > 16) GROUP BY id)
SELECT id AS age_cohort_id, p AS population, p - h AS moved_population, h AS same_house_population, round_even((p - h) * 100.0::DOUBLE / nullif(p, 0), 6) AS moved_past_year_pct FROM s
""")
def cohort_mobility(t: Tables):  # noqa: ANN201
    return reports.cohort_mobility(t["mobility_lines"])


@query("SELECT household_type_id, household_count, round_even(household_count * 100.0::DOUBLE / (SELECT max(household_count) FROM {household_types} WHERE household_type_id = 'all'), 6) AS pct FROM {household_types} WHERE household_type_id <> 'all'")
def household_shares(t: Tables):  # noqa: ANN201
    return reports.shares_of_total(t["household_types"], "household_type_id", "household_count", "all")


@query("SELECT r_name, CAST(sum(t - s) AS BIGINT) AS moved, round_even(sum(t - s) / sum(t) * 100, 6) AS moved_pct FROM (SELECT r_name, n_nationkey * 10 + 100 AS t, n_nationkey * 7 + 50 AS s FROM {nation} JOIN {region} ON n_regionkey = r_regionkey) x GROUP BY r_name")
def moved_shares(t: Tables):  # noqa: ANN201
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", (F.col("n_nationkey") * 10 + 100).alias("t"), (F.col("n_nationkey") * 7 + 50).alias("s"))
    return reports.moved_shares(rows, "r_name", "t", "s").select("r_name", F.col("moved").cast("long").alias("moved"), "moved_pct")


@query("SELECT coalesce(nullif(trim(CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE r_name END), ''), 'unknown') AS status, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 GROUP BY 1")
def scenario_status(t: Tables):  # noqa: ANN201
    rows = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return scenario_status_counts(rows.select(F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("scenario_id"), F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("r_name")).alias("status")))


@query("""
SELECT p.PersonKey, r.AddressKey, CASE WHEN strftime(DATE '1999-06-01', '%m%d') < strftime(p.DOB, '%m%d') THEN year(DATE '1999-06-01') - year(p.DOB) - 1 ELSE year(DATE '1999-06-01') - year(p.DOB) END AS Age, DATE '1999-06-01' AS SourceSnapshotDate, r.AddressKey IS NOT NULL AND b.StreetName IS NOT NULL AS has_street
FROM {people} p LEFT JOIN (SELECT PersonKey, last(AddressKey ORDER BY ResidenceStartDate, AddressKey) AS AddressKey FROM {residence} WHERE ResidenceStartDate <= DATE '1999-06-01' AND (ResidenceEndDate IS NULL OR ResidenceEndDate >= DATE '1999-06-01') GROUP BY 1) r USING (PersonKey)
LEFT JOIN (SELECT AddressKey, nullif(trim(StreetName), '') AS StreetName FROM {records}) b ON b.AddressKey = r.AddressKey WHERE p.DOB <= DATE '1999-06-01'
""")
def snapshot(t: Tables):  # noqa: ANN201
    book = t["records"].select("AddressKey", F.nullif(F.trim("StreetName"), F.lit("")).alias("StreetName"))
    rows = emission.snapshot(t["people"].drop("AddressKey"), t["residence"], book, "1999-06-01")
    return rows.select("PersonKey", "AddressKey", F.col("Age").cast("long").alias("Age"), "SourceSnapshotDate", F.col("StreetName").isNotNull().alias("has_street"))


@query("SELECT o_orderkey, coalesce(TRY_CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT), 0) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey AS STRING) || '.7' END AS s FROM {orders}) q")
def lenient_integers(t: Tables):  # noqa: ANN201
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".7")))
    return t["orders"].select("o_orderkey", as_int(s).alias("n"))


@query(f"SELECT {int_sql(SEED, 'spread', 64, 'o_orderkey')} AS bucket, count(*) AS n FROM {{orders}} GROUP BY 1")
def hash_buckets(t: Tables):  # noqa: ANN201
    return t["orders"].groupBy(hash_int(SEED, "spread", 64, "o_orderkey").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT upper(trim(p_name)) AS last_name, p_type AS ethnicity, sum(p_size - 3.0::DOUBLE) AS weight FROM {part} WHERE p_size > 3 GROUP BY ALL")
def last_name_weights(t: Tables):  # noqa: ANN201
    return generation.last_name_weights(t["part"].select(F.col("p_name").alias("name"), F.col("p_type").alias("ethnicity"), (F.col("p_size") - 3.0).alias("weight")))


@query(f"WITH r AS (SELECT PersonKey, {_rank('pairs')} AS n FROM {{people}}) SELECT a.PersonKey AS first, b.PersonKey AS second FROM r a JOIN r b ON a.n % 2 = 0 AND b.n = a.n + 1")
def random_pairs(t: Tables):  # noqa: ANN201
    return er.hash_pairs(t["people"], "PersonKey", SEED, "pairs")


@query("SELECT DISTINCT a, b FROM (SELECT PersonKeyA AS a, PersonKeyB AS b FROM {truth_events} WHERE EventType = 'COHABIT' UNION ALL SELECT PersonKeyB, PersonKeyA FROM {truth_events} WHERE EventType = 'COHABIT') x")
def symmetric_pairs(t: Tables):  # noqa: ANN201
    return er.symmetric(t["truth_events"].where("EventType = 'COHABIT'").select(F.col("PersonKeyA").alias("a"), F.col("PersonKeyB").alias("b")), "a", "b")


@query("SELECT RecordKey AS unique_id, FirstName AS first_name, MiddleName AS middle_name, LastName AS last_name, DOB AS dob, Phone AS phone, AddressKey AS address_key, SourceSnapshotDate AS source_snapshot_date, 'dataset_a' AS source_dataset, DatasetId, PersonKey FROM {observed_a}")
def linkage_export(t: Tables):  # noqa: ANN201
    return renamed(t["observed_a"], "dataset_a")


@query("SELECT RecordKey, A_RecordKey FROM (SELECT RecordKey, RecordKey AS A_RecordKey FROM {observed_a}) x")
def legacy_view(t: Tables):  # noqa: ANN201
    return emission.legacy_view(t["observed_a"], "A").select("A_RecordKey", F.col("A_RecordKey").alias("RecordKey"))


@query("SELECT PersonKey, DatasetId, RecordKey FROM {observed_a} UNION ALL SELECT PersonKey, DatasetId, RecordKey FROM {observed_b}")
def entity_record_map(t: Tables):  # noqa: ANN201
    return emission.entity_record_map([t["observed_a"], t["observed_b"]])


@query("SELECT id, label, low, high FROM {age_labels}")
def age_ranges(t: Tables):  # noqa: ANN201
    return t["age_labels"].select("id", "label", reports.age_range(F.col("label")).alias("r")).select("id", "label", "r.low", "r.high")
