"""Queries of intervals, validators and entity-resolution measures, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import er, intervals, reports, validate
from .adapters import Tables, with_views

QUERIES, ORACLE_SQL, RAW = {}, {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__], RAW[f.__name__] = with_views(sql), sql
        return f

    return add


DAY, END = "1999-06-01", "2026-01-01"


@query(f"""
SELECT PersonKey, last(AddressKey ORDER BY ResidenceStartDate, AddressKey) AS AddressKey FROM {{residence}}
WHERE ResidenceStartDate <= DATE '{DAY}' AND (ResidenceEndDate IS NULL OR ResidenceEndDate >= DATE '{DAY}') GROUP BY PersonKey
""")
def asof_snapshot(t: Tables):  # noqa: ANN201
    return intervals.asof_address(t["residence"], DAY)


@query("""
SELECT PersonKey, last(AddressKey ORDER BY ResidenceStartDate, AddressKey) AS AddressKey FROM (SELECT * FROM {residence_raw} WHERE ResidenceStartDate IS NOT NULL AND ResidenceStartDate <= DATE '2030-01-01')
WHERE ResidenceEndDate IS NULL OR ResidenceEndDate >= DATE '2030-01-01' GROUP BY PersonKey
""")
def asof_snapshot_open(t: Tables):  # noqa: ANN201
    return intervals.asof_address(t["residence_raw"], "2030-01-01")


_MOVES = "SELECT EventKey, SubjectHouseholdKey, EventDate FROM {truth_events} WHERE upper(EventType) = 'MOVE' AND SubjectPersonKey IS NULL AND SubjectHouseholdKey IS NOT NULL"
_MEMBERS = f"""
SELECT DISTINCT e.EventKey, m.PersonKey FROM ({_MOVES}) e JOIN {{memberships}} m ON m.HouseholdKey = e.SubjectHouseholdKey
WHERE m.PersonKey IS NOT NULL AND m.MembershipStartDate <= e.EventDate AND (m.MembershipEndDate IS NULL OR m.MembershipEndDate >= e.EventDate)
"""


def _household_moves(t: Tables):  # noqa: ANN202
    return t["truth_events"].where("upper(EventType) = 'MOVE' AND SubjectPersonKey IS NULL AND SubjectHouseholdKey IS NOT NULL")


@query(_MEMBERS)
def household_move_members(t: Tables):  # noqa: ANN201
    return intervals.household_move_members(_household_moves(t), t["memberships"])


_VIOLATIONS = """
SELECT PersonKey, CAST(sum(s) AS BIGINT) AS start_missing, CAST(sum(o) AS BIGINT) AS end_before_start, CAST(sum(v) AS BIGINT) AS overlaps FROM (
  SELECT PersonKey, CASE WHEN ResidenceStartDate IS NULL THEN 1 ELSE 0 END AS s, CASE WHEN ResidenceEndDate < ResidenceStartDate THEN 1 ELSE 0 END AS o,
         CASE WHEN ResidenceStartDate <= lag(coalesce(ResidenceEndDate, DATE '9999-12-31')) OVER (PARTITION BY PersonKey ORDER BY ResidenceStartDate NULLS LAST, AddressKey) THEN 1 ELSE 0 END AS v
  FROM {residence_raw}) x GROUP BY PersonKey HAVING sum(s + o + v) > 0
"""


@query(_VIOLATIONS)
def interval_violations(t: Tables):  # noqa: ANN201
    return intervals.interval_violations(t["residence_raw"], "PersonKey", "ResidenceStartDate", "ResidenceEndDate", "AddressKey")


@query(f"""
SELECT PersonKey, rule, n FROM (SELECT PersonKey, 'residence_date_parse' AS rule, start_missing AS n FROM ({_VIOLATIONS}) a UNION ALL SELECT PersonKey, 'residence_interval_order', end_before_start FROM ({_VIOLATIONS}) b
UNION ALL SELECT PersonKey, 'non_overlapping_residence_intervals', c.overlaps FROM ({_VIOLATIONS}) c) u WHERE n > 0
""")
def residence_violations(t: Tables):  # noqa: ANN201
    return validate.residence_violations(t["residence_raw"])


_SWEEP = """
SELECT HouseholdKey, count(*) AS points, CAST(sum(CASE WHEN size BETWEEN 1 AND 8 THEN 0 ELSE 1 END) AS BIGINT) AS violations, CAST(max(size) AS BIGINT) AS peak FROM (
  SELECT HouseholdKey, day, sum(d) OVER (PARTITION BY HouseholdKey ORDER BY day ROWS UNBOUNDED PRECEDING) AS size FROM (
    SELECT HouseholdKey, day, sum(d) AS d FROM (
      SELECT HouseholdKey, MembershipStartDate AS day, 1 AS d FROM {memberships} WHERE PersonKey IS NOT NULL
      UNION ALL SELECT HouseholdKey, MembershipEndDate + 1, -1 FROM {memberships} WHERE PersonKey IS NOT NULL AND MembershipEndDate IS NOT NULL) u GROUP BY HouseholdKey, day) g) w
WHERE size > 0 GROUP BY HouseholdKey
"""


@query(_SWEEP)
def household_sweep(t: Tables):  # noqa: ANN201
    return intervals.sweep(t["memberships"])


@query(f"SELECT count(*) AS households, min(peak) AS min_peak, round_even(avg(peak), 6) AS mean_peak, max(peak) AS max_peak FROM ({_SWEEP}) s")
def peak_summary(t: Tables):  # noqa: ANN201
    return intervals.peak_summary(intervals.sweep(t["memberships"]))


@query("""
SELECT PersonKey, AddressKey, start, lead(start) OVER (PARTITION BY PersonKey ORDER BY start) - 1 AS "end" FROM (
  SELECT PersonKey, start, AddressKey, lag(AddressKey) OVER (PARTITION BY PersonKey ORDER BY start) AS before FROM (
    SELECT PersonKey, ResidenceStartDate AS start, max(AddressKey) AS AddressKey FROM {residence} GROUP BY ALL) l) x WHERE before IS NULL OR before <> AddressKey
""")
def closed_history(t: Tables):  # noqa: ANN201
    return intervals.closed_history(t["residence"].withColumnRenamed("ResidenceStartDate", "since").select("PersonKey", "AddressKey", "since"), "PersonKey", "AddressKey", "since")


_blank = lambda c: f"coalesce(trim({c}), '') = ''"
_same = lambda a, b: f"({a} = {b} AND NOT {_blank(a)})"
GRAMMAR = [
    (_blank("EventKey"), "EventKey", "missing"), ("EventDate IS NULL", "EventDate", "missing"), ("t = ''", "EventType", "missing"), ("t IN ('DEATH', 'NAME_CHANGE', 'ADOPTION')", "EventType", "reserved"),
    ("t <> '' AND t NOT IN ('MOVE', 'COHABIT', 'BIRTH', 'DIVORCE', 'LEAVE_HOME', 'DEATH', 'NAME_CHANGE', 'ADOPTION')", "EventType", "unknown"),
    (f"t = 'MOVE' AND {_blank('SubjectPersonKey')} AND {_blank('SubjectHouseholdKey')}", "SubjectPersonKey", "no subject"), (f"t = 'MOVE' AND {_blank('FromAddressKey')}", "FromAddressKey", "missing"),
    (f"t = 'MOVE' AND {_blank('ToAddressKey')}", "ToAddressKey", "missing"), (f"t = 'MOVE' AND {_same('FromAddressKey', 'ToAddressKey')}", "ToAddressKey", "same address"),
    (f"t = 'COHABIT' AND {_blank('PersonKeyA')}", "PersonKeyA", "missing"), (f"t = 'COHABIT' AND {_blank('PersonKeyB')}", "PersonKeyB", "missing"), (f"t = 'COHABIT' AND {_same('PersonKeyA', 'PersonKeyB')}", "PersonKeyB", "same person"),
    (f"t = 'COHABIT' AND {_blank('NewHouseholdKey')}", "NewHouseholdKey", "missing"), ("t = 'COHABIT' AND coalesce(CohabitMode, '') NOT IN ('move_to_A', 'move_to_B', 'new_address')", "CohabitMode", "invalid"),
    (f"t = 'BIRTH' AND {_blank('Parent1PersonKey')}", "Parent1PersonKey", "missing"), (f"t = 'BIRTH' AND {_blank('ChildPersonKey')}", "ChildPersonKey", "missing"),
    (f"t = 'BIRTH' AND (coalesce({_same('Parent1PersonKey', 'ChildPersonKey')}, false) OR coalesce({_same('Parent2PersonKey', 'ChildPersonKey')}, false))", "ChildPersonKey", "parent is child"), (f"t = 'BIRTH' AND {_same('Parent1PersonKey', 'Parent2PersonKey')}", "Parent2PersonKey", "same person"),
    (f"t = 'DIVORCE' AND {_blank('PersonKeyA')}", "PersonKeyA", "missing"), (f"t = 'DIVORCE' AND {_blank('PersonKeyB')}", "PersonKeyB", "missing"), (f"t = 'DIVORCE' AND {_same('PersonKeyA', 'PersonKeyB')}", "PersonKeyB", "same person"),
    ("t = 'DIVORCE' AND coalesce(CustodyMode, '') NOT IN ('joint', 'parent_a_primary', 'parent_b_primary', 'split')", "CustodyMode", "invalid"), (f"t = 'LEAVE_HOME' AND {_blank('ChildPersonKey')}", "ChildPersonKey", "missing"),
]


@query("WITH e AS (SELECT *, upper(trim(coalesce(EventType, ''))) AS t FROM {truth_events}) " + " UNION ALL ".join(f"SELECT EventKey, '{f}' AS field, '{m}' AS error FROM e WHERE {c}" for c, f, m in GRAMMAR))
def event_grammar_errors(t: Tables):  # noqa: ANN201
    return validate.grammar_errors(t["truth_events"])


def _ages_sql(gap: bool) -> str:
    rows = ["SELECT EventKey, 'min_marriage_age' AS rule, PersonKeyA AS PersonKey FROM j WHERE t = 'COHABIT' AND a < 18", "SELECT EventKey, 'min_marriage_age', PersonKeyB FROM j WHERE t = 'COHABIT' AND b < 18",
            "SELECT EventKey, 'fertility_age_range', Parent1PersonKey FROM j WHERE t = 'BIRTH' AND NOT p BETWEEN 15 AND 49", "SELECT EventKey, 'allow_child_lives_alone', ChildPersonKey FROM j WHERE t = 'LEAVE_HOME' AND c < 18"]
    if gap:
        rows.append("SELECT EventKey, 'max_partner_age_gap', PersonKeyA FROM j WHERE t = 'COHABIT' AND abs(a - b) > 25")
    joins = " ".join(f"LEFT JOIN {{people}} {n} ON {n}.PersonKey = e.{k}" for n, k in (("pa", "PersonKeyA"), ("pb", "PersonKeyB"), ("pp", "Parent1PersonKey"), ("pc", "ChildPersonKey")))
    return f"WITH j AS (SELECT e.*, upper(e.EventType) AS t, pa.Age AS a, pb.Age AS b, pp.Age AS p, pc.Age AS c FROM {{truth_events}} e {joins}) " + " UNION ALL ".join(rows)


@query(_ages_sql(True))
def constraint_violations(t: Tables):  # noqa: ANN201
    return validate.age_violations(t["truth_events"], t["people"], validate.Constraints())


@query(f"SELECT rule, count(*) AS n FROM ({_ages_sql(False)}) v GROUP BY rule")
def age_violation_counts(t: Tables):  # noqa: ANN201
    return validate.age_violations(t["truth_events"], t["people"], validate.Constraints(), with_gap=False).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
SELECT CAST(sum(CASE WHEN upper(EventType) = 'COHABIT' THEN 1 ELSE 0 END) AS BIGINT) AS couples_formed, CAST(sum(CASE WHEN upper(EventType) = 'DIVORCE' THEN 1 ELSE 0 END) AS BIGINT) AS divorces,
       CAST(sum(CASE WHEN upper(EventType) = 'BIRTH' THEN 1 ELSE 0 END) AS BIGINT) AS births, CAST(sum(CASE WHEN upper(EventType) = 'MOVE' THEN 1 ELSE 0 END) AS BIGINT) AS moves,
       CAST(sum(CASE WHEN upper(EventType) = 'LEAVE_HOME' THEN 1 ELSE 0 END) AS BIGINT) AS leave_homes, count(*) AS events FROM {truth_events}
""")
def event_counts(t: Tables):  # noqa: ANN201
    return reports.event_counts(t["truth_events"])


_MOVED = f"""
SELECT p.PersonKey, coalesce(n, 0) AS moves FROM (SELECT DISTINCT PersonKey FROM {{people}}) p LEFT JOIN (
  SELECT PersonKey, count(*) AS n FROM (SELECT SubjectPersonKey AS PersonKey FROM {{truth_events}} WHERE upper(EventType) = 'MOVE' AND SubjectPersonKey IS NOT NULL UNION ALL SELECT PersonKey FROM ({_MEMBERS}) mm) u GROUP BY PersonKey) c ON c.PersonKey = p.PersonKey
"""


def _moves(t: Tables):  # noqa: ANN202
    return reports.moves_per_person(t["truth_events"], t["memberships"], t["people"])


@query(f"SELECT moves AS value, count(*) AS n FROM ({_MOVED}) m GROUP BY moves")
def moves_histogram(t: Tables):  # noqa: ANN201
    return reports.histogram(_moves(t), "moves")


@query(f"SELECT count(*) AS people, CAST(sum(CASE WHEN moves > 0 THEN 1 ELSE 0 END) AS BIGINT) AS moved, CAST(sum(moves) AS BIGINT) AS total, round_even(avg(moves), 6) AS mean_moves, max(moves) AS most FROM ({_MOVED}) m")
def moves_summary(t: Tables):  # noqa: ANN201
    return reports.moves_summary(_moves(t))


_COUNTS = "SELECT DatasetId, PersonKey, count(*) AS n, count(DISTINCT RecordKey) AS k FROM {record_map} GROUP BY ALL"


@query(f"SELECT DatasetId, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS entities, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round_even(sum(n - 1) / sum(n), 6) AS duplicate_rate, round_even(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) * 100 / count(*), 6) AS multi_entity_pct FROM ({_COUNTS}) c GROUP BY DatasetId")
def duplicate_rates(t: Tables):  # noqa: ANN201
    return er.duplicate_rates(t["record_map"])


@query("""
WITH p AS (SELECT DISTINCT DatasetId, PersonKey FROM {record_map}), s AS (SELECT DatasetId, count(*) AS n FROM p GROUP BY 1),
b AS (SELECT x.DatasetId AS a, y.DatasetId AS b, count(*) AS n FROM p x JOIN p y ON x.PersonKey = y.PersonKey AND x.DatasetId < y.DatasetId GROUP BY ALL)
SELECT x.DatasetId AS a, y.DatasetId AS b, coalesce(b.n, 0) AS in_both, x.n - coalesce(b.n, 0) AS only_a, y.n - coalesce(b.n, 0) AS only_b, x.n + y.n - coalesce(b.n, 0) AS in_either,
       round_even(coalesce(b.n, 0) * 100 / (x.n + y.n - coalesce(b.n, 0)), 6) AS pct_of_union, round_even(coalesce(b.n, 0) * 100 / x.n, 6) AS pct_of_a, round_even(coalesce(b.n, 0) * 100 / y.n, 6) AS pct_of_b
FROM s x JOIN s y ON x.DatasetId < y.DatasetId LEFT JOIN b ON b.a = x.DatasetId AND b.b = y.DatasetId
""")
def pairwise_overlap(t: Tables):  # noqa: ANN201
    return er.pairwise_overlap(t["record_map"])


@query("""
WITH p AS (SELECT PersonKey, count(DISTINCT DatasetId) AS k FROM {record_map} GROUP BY 1), d AS (SELECT count(DISTINCT DatasetId) AS datasets FROM {record_map})
SELECT datasets, CAST(sum(CASE WHEN k = datasets THEN 1 ELSE 0 END) AS BIGINT) AS in_all, count(*) AS in_any, round_even(sum(CASE WHEN k = datasets THEN 1 ELSE 0 END) * 100 / count(*), 6) AS pct FROM p CROSS JOIN d GROUP BY datasets
""")
def nway_overlap(t: Tables):  # noqa: ANN201
    return er.nway_overlap(t["record_map"])


@query("""
SELECT CASE WHEN pct_of_union < 40 THEN 'low overlap: most people are in one dataset only' WHEN pct_of_union < 60 THEN 'moderate overlap' WHEN pct_of_union < 75 THEN 'good overlap' ELSE 'high overlap' END AS insight, a, b FROM (
""" + ORACLE_SQL["pairwise_overlap"] + ") o")
def overlap_insights(t: Tables):  # noqa: ANN201
    return reports.insights(er.pairwise_overlap(t["record_map"]))


@query(f"SELECT a, b, pct_of_union FROM ({ORACLE_SQL['pairwise_overlap']}) o ORDER BY pct_of_union, a, b LIMIT 1")
def weakest_pair(t: Tables):  # noqa: ANN201
    return reports.weakest_pair(er.pairwise_overlap(t["record_map"]))


@query("""
WITH a AS (SELECT PersonKey, count(DISTINCT RecordKey) AS n FROM {observed_a} GROUP BY 1), b AS (SELECT PersonKey, count(DISTINCT RecordKey) AS n FROM {observed_b} GROUP BY 1)
SELECT CASE WHEN a.n <= 1 THEN 'one' ELSE 'many' END || '_to_' || CASE WHEN b.n <= 1 THEN 'one' ELSE 'many' END AS cardinality, count(*) AS people FROM a JOIN b USING (PersonKey) GROUP BY 1
""")
def match_cardinality(t: Tables):  # noqa: ANN201
    return er.match_cardinality(t["observed_a"], t["observed_b"])


@query(f"""
WITH f AS (SELECT *, min(PersonKey) OVER (PARTITION BY DatasetId, RecordKey) AS first FROM {{record_map}}),
r AS (SELECT DatasetId, count(*) AS row_count, CAST(sum(CASE WHEN PersonKey <> first THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous_rows FROM f GROUP BY 1),
e AS (SELECT DatasetId, count(*) AS people, round_even(avg(k), 6) AS mean_records, max(k) AS most_records FROM ({_COUNTS}) c GROUP BY 1)
SELECT * FROM r JOIN e USING (DatasetId)
""")
def ambiguity(t: Tables):  # noqa: ANN201
    return er.ambiguity(t["record_map"])


def _crosswalk_sql(mode: str) -> str:
    head = "WITH a AS (SELECT PersonKey, RecordKey AS A_RecordKey, row_number() OVER (PARTITION BY PersonKey ORDER BY RecordKey) AS n FROM {observed_a}), b AS (SELECT PersonKey, RecordKey AS B_RecordKey, row_number() OVER (PARTITION BY PersonKey ORDER BY RecordKey) AS n FROM {observed_b}) "
    on = {"one_to_one": "a.n = b.n", "one_to_many": "a.n = 1", "many_to_one": "b.n = 1"}.get(mode, "true")
    return head + f"SELECT coalesce(a.PersonKey, b.PersonKey) AS PersonKey, A_RecordKey, B_RecordKey FROM a FULL JOIN b ON a.PersonKey = b.PersonKey AND {on}"


def _crosswalk(mode: str):  # noqa: ANN202
    def f(t: Tables):  # noqa: ANN202
        a, b = t["observed_a"].select("PersonKey", "RecordKey"), t["observed_b"].select("PersonKey", "RecordKey")
        return er.crosswalk(a, b, mode)

    f.__name__ = f"crosswalk_{mode}"
    return f


for _mode in ("one_to_one", "one_to_many", "many_to_one", "many_to_many"):
    query(_crosswalk_sql(_mode))(_crosswalk(_mode))

_TRUTH = _crosswalk_sql("many_to_many")
_LINKED = "SELECT a.RecordKey AS A_RecordKey, b.RecordKey AS B_RecordKey FROM {observed_a} a JOIN {observed_b} b USING (PersonKey)"
_BLOCK1 = "SELECT DISTINCT a.RecordKey AS A_RecordKey, b.RecordKey AS B_RecordKey FROM {observed_a} a JOIN {observed_b} b ON a.LastName = b.LastName AND a.DOB = b.DOB"
_BLOCK2 = "SELECT DISTINCT a.RecordKey AS A_RecordKey, b.RecordKey AS B_RecordKey FROM {observed_a} a JOIN {observed_b} b ON upper(substr(trim(a.LastName), 1, 3)) = upper(substr(trim(b.LastName), 1, 3)) AND a.DOB = b.DOB"


def _walk(t: Tables):  # noqa: ANN202
    return er.crosswalk(t["observed_a"], t["observed_b"], "many_to_many")


@query(_LINKED)
def linked_pairs(t: Tables):  # noqa: ANN201
    return er.linked_pairs(_walk(t)).select("A_RecordKey", "B_RecordKey")


@query(_BLOCK1)
def block_lastname_dob(t: Tables):  # noqa: ANN201
    return er.block_name_dob(t["observed_a"], t["observed_b"])


@query(_BLOCK2)
def block_dob_prefix3(t: Tables):  # noqa: ANN201
    return er.block_dob_prefix(t["observed_a"], t["observed_b"])


def _confusion_sql(block: str) -> str:
    return f"""
WITH p AS ({block}), t AS ({_LINKED}), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM t)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM t)) AS fp, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM p)) AS fn)
SELECT tp, fp, fn, round_even(tp / (tp + fp), 6) AS precision_, round_even(tp / (tp + fn), 6) AS recall_, round_even(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c
"""


@query(_confusion_sql(_BLOCK1))
def er_confusion(t: Tables):  # noqa: ANN201
    return er.block_confusion(t["observed_a"], t["observed_b"], er.name_dob_block())


@query(_confusion_sql(_BLOCK2))
def er_confusion_prefix(t: Tables):  # noqa: ANN201
    return er.block_confusion(t["observed_a"], t["observed_b"], er.dob_prefix_block())


@query(_confusion_sql(_BLOCK1))
def er_confusion_pairs(t: Tables):  # noqa: ANN201
    return er.confusion(er.block_name_dob(t["observed_a"], t["observed_b"]), _walk(t))


# A crosswalk in which some records are given to a second person.
_WALKED = f"SELECT PersonKey, A_RecordKey, B_RecordKey FROM ({_TRUTH}) w UNION ALL SELECT CAST(CAST(PersonKey AS INT) + 1 AS VARCHAR), A_RecordKey, NULL FROM ({_TRUTH}) w WHERE CAST(PersonKey AS INT) % 50 = 0"
_MAP = f"SELECT DISTINCT * FROM (SELECT 'dataset_a' AS DatasetId, A_RecordKey AS RecordKey, PersonKey FROM ({_WALKED}) x UNION ALL SELECT 'dataset_b', B_RecordKey, PersonKey FROM ({_WALKED}) y) m WHERE RecordKey IS NOT NULL"


def _walked(t: Tables):  # noqa: ANN202
    walk = _walk(t)
    again = walk.where("CAST(PersonKey AS INT) % 50 = 0").select((F.col("PersonKey").cast("int") + 1).cast("string").alias("PersonKey"), "A_RecordKey", F.lit(None).cast("string").alias("B_RecordKey"))
    return er.record_map_of({("dataset_a", "dataset_b"): walk.unionByName(again)})


@query(_MAP)
def crosswalk_record_map(t: Tables):  # noqa: ANN201
    return _walked(t)


def _of_map(name: str, measure):  # noqa: ANN001, ANN202
    """A query of record maps, over the map of crosswalks: the SQL is the same but for the map."""

    def f(t: Tables):  # noqa: ANN202
        return measure(_walked(t))

    f.__name__ = f"crosswalk_{name}"
    query(RAW[name].replace("{record_map}", f"({_MAP}) walked"))(f)


for _name, _f in (("pairwise_overlap", er.pairwise_overlap), ("duplicate_rates", er.duplicate_rates), ("ambiguity", er.ambiguity)):
    _of_map(_name, _f)


@query(f"""
WITH m AS ({_MAP}), a AS (SELECT PersonKey, count(*) AS n FROM m WHERE DatasetId = 'dataset_a' GROUP BY 1), b AS (SELECT PersonKey, count(*) AS n FROM m WHERE DatasetId = 'dataset_b' GROUP BY 1)
SELECT CASE WHEN a.n <= 1 THEN 'one' ELSE 'many' END || '_to_' || CASE WHEN b.n <= 1 THEN 'one' ELSE 'many' END AS cardinality, count(*) AS people FROM a JOIN b USING (PersonKey) GROUP BY 1
""")
def crosswalk_cardinality(t: Tables):  # noqa: ANN201
    m = _walked(t)
    return er.match_cardinality(m.where("DatasetId = 'dataset_a'"), m.where("DatasetId = 'dataset_b'"))


_DIFF = "a.{0} IS DISTINCT FROM b.{0}"


@query(f"""
WITH p AS ({_BLOCK1}), t AS ({_LINKED}), w AS (SELECT *, 'false_positive' AS error FROM (SELECT * FROM p EXCEPT SELECT * FROM t) x UNION ALL SELECT *, 'false_negative' FROM (SELECT * FROM t EXCEPT SELECT * FROM p) y)
SELECT w.A_RecordKey, w.B_RecordKey, w.error, concat_ws(', ', CASE WHEN a.LastName IS DISTINCT FROM b.LastName THEN 'last name differs' END, CASE WHEN a.DOB IS DISTINCT FROM b.DOB THEN 'date of birth differs' END,
  CASE WHEN a.AddressKey IS DISTINCT FROM b.AddressKey THEN 'address differs' END, CASE WHEN (coalesce(a.MiddleName, '') = '') <> (coalesce(b.MiddleName, '') = '') THEN 'middle name missing' END) AS reasons
FROM w LEFT JOIN {{observed_a}} a ON a.RecordKey = w.A_RecordKey LEFT JOIN {{observed_b}} b ON b.RecordKey = w.B_RecordKey
""")
def error_reasons(t: Tables):  # noqa: ANN201
    return er.error_reasons(er.block_name_dob(t["observed_a"], t["observed_b"]), _walk(t), t["observed_a"], t["observed_b"])


@query("""
WITH o AS (SELECT * FROM {observed_a} UNION ALL SELECT * FROM {observed_b}),
j AS (SELECT o.*, p.PersonKey IS NOT NULL AS m, lower(coalesce(o.FirstName, '')) <> lower(coalesce(p.FirstName, '')) OR lower(coalesce(o.MiddleName, '')) <> lower(coalesce(p.MiddleName, '')) OR lower(coalesce(o.LastName, '')) <> lower(coalesce(p.LastName, '')) AS nd,
  coalesce(o.Phone, '') <> coalesce(p.Phone, '') AS pd, coalesce(o.AddressKey, '') <> coalesce(p.AddressKey, '') AS ad
  FROM o LEFT JOIN {people} p ON p.PersonKey = o.PersonKey AND CAST(p.PersonKey AS INT) % 29 <> 0)
SELECT DatasetId, CAST(sum(CASE WHEN m THEN 1 ELSE 0 END) AS BIGINT) AS mapped, CAST(sum(CASE WHEN m THEN 0 ELSE 1 END) AS BIGINT) AS unmapped, round_even(avg(CASE WHEN m THEN CAST(nd AS INT) END), 6) AS name_drift,
       round_even(avg(CASE WHEN m THEN CAST(pd AS INT) END), 6) AS phone_drift, round_even(avg(CASE WHEN m THEN CAST(ad AS INT) END), 6) AS address_drift FROM j GROUP BY DatasetId
""")
def attribute_drift(t: Tables):  # noqa: ANN201
    observed = t["observed_a"].unionByName(t["observed_b"])
    people = t["people"].where("CAST(PersonKey AS INT) % 29 <> 0")
    addresses = people.select("PersonKey", F.lit("2026-01-01").cast("date").alias("SourceSnapshotDate"), "AddressKey")
    return er.attribute_drift(observed.drop("PersonKey"), observed.select("DatasetId", "RecordKey", "PersonKey"), people, addresses)


@query("SELECT first(DatasetId ORDER BY n DESC, DatasetId) AS DatasetId, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM (SELECT DatasetId, count(*) AS n FROM {record_map} GROUP BY 1) c")
def event_dominance(t: Tables):  # noqa: ANN201
    return er.dominant(t["record_map"], "DatasetId")


_AGES = f"SELECT PersonKey, CAST(round_even(datediff('day', DOB, DATE '{END}') / 365.25, 0) AS INT) AS Age FROM {{people}}"


@query(f"SELECT CAST(least(Age - Age % 5, 105) AS INT) AS bin, count(*) AS n FROM ({_AGES}) a WHERE Age BETWEEN 0 AND 110 GROUP BY 1")
def age_histogram(t: Tables):  # noqa: ANN201
    return reports.age_histogram(t["people"], END)


@query(f"SELECT count(*) AS people, mode(Age ORDER BY Age) AS mode_age, round_even(stddev_samp(Age), 6) AS std_age FROM ({_AGES}) a WHERE Age BETWEEN 0 AND 110".replace("mode(Age ORDER BY Age)", f"(SELECT Age FROM ({_AGES}) q GROUP BY Age ORDER BY count(*) DESC, Age LIMIT 1)"))
def age_summary(t: Tables):  # noqa: ANN201
    return reports.age_summary(t["people"], END)


@query(f"SELECT EventType, count(*) AS n, median(Age) AS median_age FROM {{truth_events}} e JOIN ({_AGES}) a ON a.PersonKey = e.SubjectPersonKey WHERE Age BETWEEN 0 AND 110 GROUP BY EventType HAVING count(*) >= 3")
def event_median_age(t: Tables):  # noqa: ANN201
    return reports.event_median_age(t["truth_events"], t["people"], END)


@query()
def run_ids(t: Tables):  # noqa: ANN201
    rows = t["events"].select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_"), F.col("event_type"), F.when(F.col("event_id") % 7 == 0, "_sed").otherwise("_seed"), F.col("user_id").cast("string")).alias("run_id"))
    return validate.parsed_run_ids(rows, "run_id").groupBy("scenario", "valid").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"))


ORACLE_SQL["run_ids"] = """
SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS scenario, event_id % 7 <> 0 AS valid, count(*) AS n, count(DISTINCT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END) AS seeds FROM events GROUP BY ALL
"""


@query(f"SELECT 'most people are ' || mode_age || ': ' || CASE WHEN std_age > 20 THEN 'a wide spread, names collide across cohorts' ELSE 'a narrow spread, ages set few people apart' END AS insight FROM ({ORACLE_SQL['age_summary']}) a")
def insights_ages(t: Tables):  # noqa: ANN201
    return reports.age_insight(reports.age_summary(t["people"], END))


@query("""
SELECT EventType || ' is ' || CAST(round_even(n * 100 / total, 0) AS INT) || ' % of ' || total || ' events' AS insight
FROM (SELECT first(EventType ORDER BY n DESC, EventType) AS EventType, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM (SELECT EventType, count(*) AS n FROM {truth_events} GROUP BY 1) c) d
""")
def insights_events(t: Tables):  # noqa: ANN201
    return reports.event_insight(er.dominant(t["truth_events"], "EventType"), "EventType")


@query(f"SELECT DatasetId, row_count || ' rows of ' || entities || ' people, ' || duplicate_rows || ' to deduplicate' AS insight FROM ({ORACLE_SQL['duplicate_rates']}) d")
def insights_datasets(t: Tables):  # noqa: ANN201
    return reports.dataset_insights(er.duplicate_rates(t["record_map"]))


@query("""
WITH p AS (SELECT DISTINCT DatasetId, PersonKey FROM {record_map}), k AS (SELECT PersonKey, count(*) AS n FROM p GROUP BY 1), z AS (SELECT count(DISTINCT DatasetId) AS datasets FROM p),
b AS (SELECT DISTINCT PersonKey FROM {people} WHERE CAST(PersonKey AS INT) % 7 <> 0)
SELECT DatasetId, count(*) AS entities, count(b.PersonKey) AS base_entities, count(*) - count(b.PersonKey) AS late_entities, count(*) FILTER (WHERE n = 1) AS only_entities, count(*) FILTER (WHERE n = datasets) AS shared_entities
FROM p JOIN k USING (PersonKey) CROSS JOIN z LEFT JOIN b ON b.PersonKey = p.PersonKey GROUP BY DatasetId
""")
def coverage_counters(t: Tables):  # noqa: ANN201
    return er.coverage_counters(t["record_map"], t["people"].where("CAST(PersonKey AS INT) % 7 <> 0"))
