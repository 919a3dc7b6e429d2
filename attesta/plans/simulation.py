"""Queries of the truth simulation and of whole scenarios. The SQL that checks the simulation is made step by step, as the simulation itself runs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from ..config import patched, scenario
from ..operators import emission, intervals, population, truth, validate
from ..operators.noise import NoiseRates
from .adapters import Tables, int_sql, unit_sql, with_views
from .linkage import GRAMMAR
from .scenario import PEOPLE_COLUMNS, run_scenario
from .selection import traits_sql

QUERIES, ORACLE_SQL = {}, {}
CONFIG = truth.SimulationConfig(move=40, cohabit=60, birth=40, divorce=50, leave_home=40)


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return add


def _people(t: Tables):  # noqa: ANN202
    traits = population.latent_traits(population.entity_view(t["dated_records"]), 7)
    scores = [c for c in traits.columns if c.endswith("PropensityScore")]
    return t["people"].join(traits.select("PersonKey", *scores), "PersonKey")


# ---------------------------------------------------------------- the simulation in SQL

_TRAITS = ("Gender", "Age", "Partnership", "Mobility", "Fertility")
_KINDS = {"Gender": "VARCHAR", "Age": "INT", "Partnership": "DOUBLE", "Mobility": "DOUBLE", "Fertility": "DOUBLE"}
_TOLD = ("SubjectPersonKey", "SubjectHouseholdKey", "FromAddressKey", "ToAddressKey", "PersonKeyA", "PersonKeyB", "NewHouseholdKey", "CohabitMode", "ChildPersonKey", "Parent1PersonKey", "Parent2PersonKey", "CustodyMode")


def _double(x: float) -> str:
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def _below(u: str, p: str) -> str:
    return f"{u} < least(greatest({p}, 0e0), 1e0)"


def _told(order: int, day: str, kind: str, where: str, source: str, **values: str) -> str:
    return f"SELECT {order} AS ord, '{kind}' AS EventType, DATE '{day}' AS EventDate, " + ", ".join(f"{values.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in _TOLD) + f" FROM {source} WHERE {where}"


def _changed(source: str, hit: str, values: dict[str, str], drop: str) -> str:
    new = {c: f"CASE WHEN {hit} THEN {v} ELSE {c} END" for c, v in values.items()} | {"locked": f"locked OR {hit}", "touched": f"touched OR {hit}"}
    return f"SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(f'{v} AS {c}' for c, v in new.items())}) FROM {source}"


def _pick(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({at} AS INT) + 1]"


def steps_sql(cfg: truth.SimulationConfig, start: str) -> str:
    """CTEs p0, s0, s1, ... of the states after each step, `told` of all events and `log` of all changes, from the SELECT of the first state."""
    out, told, seed = [f"s0 AS MATERIALIZED (SELECT *, {', '.join(f'CAST(NULL AS {_KINDS[t]}) AS p{t}' for t in _TRAITS)}, false AS locked, true AS touched FROM ({start}) x)"], [], cfg.seed
    gone = {"Partner": "NULL"} | {f"p{t}": "NULL" for t in _TRAITS}
    for i in range(1, cfg.periods + 1):
        day, at = str(cfg.day(i)), f"{i:04d}"
        u = lambda salt, key="PersonKey": unit_sql(seed, salt, key)  # noqa: B023, E731
        draw = lambda salt, n, key: int_sql(seed, salt, n, key)  # noqa: B023, E731
        add = lambda name, sql: out.append(f"{name} AS MATERIALIZED ({sql})")

        def tell(phase: int, *args: str, **values: str) -> None:
            out.append(f"e{i}_{phase} AS MATERIALIZED ({_told(i * 10 + phase, day, *args, **values)})")  # noqa: B023
            told.append(f"e{i}_{phase}")  # noqa: B023

        add(f"a{i}", f"SELECT * REPLACE (false AS locked, false AS touched) FROM s{i - 1}")
        # divorce
        p = f"{_double(cfg.rate(cfg.divorce))} * (1.7e0 - (Partnership + pPartnership) / 2)"
        add(f"b{i}", f"SELECT *, coalesce(Partner IS NOT NULL AND {_below(u(f'divorce:{i}', 'least(PersonKey, Partner)'), p)}, false) AS hit, least(PersonKey, Partner) AS ka, greatest(PersonKey, Partner) AS kb FROM a{i}")
        second = lambda v, c: f"CASE WHEN PersonKey > Partner THEN {v} ELSE {c} END"
        tell(0, "DIVORCE", "hit AND PersonKey < Partner", f"b{i}", PersonKeyA="ka", PersonKeyB="kb", NewHouseholdKey=f"'HH_SIM_{at}D_' || kb", FromAddressKey="AddressKey", ToAddressKey=f"'ADDR_SIM_{at}D_' || kb",
             CustodyMode=_pick(validate.CUSTODY_MODES, draw(f"custody:{i}", 4, "ka")))
        moved = {"HouseholdKey": f"'HH_SIM_{at}D_' || kb", "AddressKey": f"'ADDR_SIM_{at}D_' || kb", "HouseholdType": "'post_divorce'", "Role": "'HEAD'"}
        add(f"c{i}", _changed(f"b{i}", "hit", {c: second(v, c) for c, v in moved.items()} | gone, "hit, ka, kb"))
        # cohabit
        add(f"r{i}", f"SELECT *, row_number() OVER (ORDER BY {u(f'pair:{i}')}, PersonKey) - 1 AS rn FROM c{i} WHERE NOT locked AND Partner IS NULL AND coalesce(Age, 0) >= {cfg.limits.min_marriage_age}")
        p = f"{_double(cfg.rate(cfg.cohabit))} * (0.5e0 + (a.Partnership + b.Partnership) / 2)"
        add(f"q{i}", f"SELECT a.PersonKey AS ka, b.PersonKey AS kb, a.AddressKey AS aa, b.AddressKey AS ab, {', '.join(f'a.{t} AS a{t}, b.{t} AS b{t}' for t in _TRAITS)}, {_pick(validate.COHABIT_MODES, draw(f'cohabit:mode:{i}', 3, 'a.PersonKey'))} AS mode"
            f" FROM r{i} a JOIN r{i} b ON a.rn % 2 = 0 AND b.rn = a.rn + 1 WHERE coalesce(abs(a.Age - b.Age) <= {cfg.limits.gap}, true) AND {_below(u(f'cohabit:{i}', 'a.PersonKey'), p)}")  # fmt: skip
        target = f"coalesce(CASE mode WHEN 'move_to_A' THEN nullif(trim(aa), '') WHEN 'move_to_B' THEN nullif(trim(ab), '') END, 'ADDR_SIM_{at}C_' || ka)"
        tell(1, "COHABIT", "true", f"q{i}", PersonKeyA="ka", PersonKeyB="kb", NewHouseholdKey=f"'HH_SIM_{at}C_' || ka", CohabitMode="mode", ToAddressKey=target)
        side = lambda own, other, role: f"SELECT k{own} AS own, k{other} AS other, 'HH_SIM_{at}C_' || ka AS home, {target} AS target, '{role}' AS hrole, {', '.join(f'{other}{t} AS o{t}' for t in _TRAITS)} FROM q{i}"  # noqa: B023, E731
        add(f"j{i}", f"SELECT c{i}.*, j.* FROM c{i} LEFT JOIN ({side('a', 'b', 'HEAD')} UNION ALL {side('b', 'a', 'SPOUSE')}) j ON j.own = PersonKey")
        add(f"d{i}", _changed(f"j{i}", "(own IS NOT NULL)", {"HouseholdKey": "home", "AddressKey": "target", "HouseholdType": "'couple'", "Role": "hrole", "Partner": "other"} | {f"p{t}": f"o{t}" for t in _TRAITS}, "own, other, home, target, hrole, " + ", ".join(f"o{t}" for t in _TRAITS)))
        # birth
        able = lambda key, x: f"coalesce(NOT locked AND {key} IS NOT NULL AND lower(trim(coalesce({x}Gender, ''))) IN ('female', 'f', '') AND {x}Age BETWEEN {cfg.limits.fertility_age_min} AND {cfg.limits.fertility_age_max} AND {_below(u(f'birth:{i}', key), f'{_double(cfg.rate(cfg.birth))} * (0.4e0 + {x}Fertility)')}, false)"  # noqa: B023, E731
        add(f"f{i}", f"SELECT *, own0 AND NOT coalesce(other0 AND Partner < PersonKey, false) AS bears FROM (SELECT *, {able('PersonKey', '')} AS own0, {able('Partner', 'p')} AS other0 FROM d{i}) x")
        tell(2, "BIRTH", "bears", f"f{i}", Parent1PersonKey="PersonKey", Parent2PersonKey="Partner", ChildPersonKey=f"'P_CHILD_{at}_' || PersonKey", SubjectHouseholdKey="HouseholdKey")
        child = {"PersonKey": f"'P_CHILD_{at}_' || PersonKey", "Role": "'CHILD'", "Gender": f"CASE WHEN {u(f'child:{i}')} < 0.5e0 THEN 'female' ELSE 'male' END", "Age": "0", "Mobility": "0.25e0", "Partnership": "0.05e0", "Fertility": "0.05e0", "locked": "true", "touched": "true"} | gone
        add(f"g{i}", _changed(f"f{i}", "(bears OR other0)", {}, "own0, other0, bears") + f" UNION ALL SELECT * EXCLUDE (own0, other0, bears) REPLACE ({', '.join(f'{v} AS {c}' for c, v in child.items())}) FROM f{i} WHERE bears")
        # leave home
        wants = f"coalesce(NOT locked AND Partner IS NULL AND Age BETWEEN 18 AND 30 AND {u(f'leave:{i}')} < {_double(cfg.rate(cfg.leave_home))}, false)"
        turn = f"row_number() OVER (PARTITION BY HouseholdKey ORDER BY wants DESC, {u(f'leave:turn:{i}')}, PersonKey)"
        add(f"h{i}", f"SELECT *, wants AND count(*) OVER (PARTITION BY HouseholdKey) > {turn} AS hit FROM (SELECT *, {wants} AS wants FROM g{i}) x")
        left = {"HouseholdKey": f"'HH_SIM_{at}L_' || PersonKey", "AddressKey": f"'ADDR_SIM_{at}L_' || PersonKey"}
        tell(3, "LEAVE_HOME", "hit", f"h{i}", ChildPersonKey="PersonKey", SubjectPersonKey="PersonKey", FromAddressKey="AddressKey", ToAddressKey=left["AddressKey"], NewHouseholdKey=left["HouseholdKey"])
        add(f"k{i}", _changed(f"h{i}", "hit", left | {"HouseholdType": "'solo'", "Role": "'HEAD'"}, "wants, hit"))
        # move
        rate = _double(cfg.rate(cfg.move))
        couple = f"coalesce(NOT locked AND PersonKey < Partner AND {_below(u(f'move:couple:{i}'), f'{rate} * (0.5e0 + (Mobility + pMobility) / 2)')}, false)"
        single = f"coalesce(NOT locked AND Partner IS NULL AND {_below(u(f'move:single:{i}'), f'{rate} * (0.5e0 + Mobility)')}, false)"
        add(f"l{i}", f"SELECT *, bool_or(couple) OVER (PARTITION BY HouseholdKey) AS together, single AND count(*) OVER (PARTITION BY HouseholdKey) = 1 AS alone FROM (SELECT *, {couple} AS couple, {single} AS single FROM k{i}) x")
        to = f"'ADDR_SIM_{at}M_' || CASE WHEN together THEN HouseholdKey ELSE PersonKey END"
        tell(4, "MOVE", "couple OR (alone AND NOT together)", f"l{i}", SubjectHouseholdKey="CASE WHEN couple THEN HouseholdKey END", SubjectPersonKey="CASE WHEN NOT couple THEN PersonKey END", FromAddressKey="AddressKey", ToAddressKey=to)
        add(f"s{i}", _changed(f"l{i}", "(together OR alone)", {"AddressKey": to}, "couple, single, together, alone"))
    logged = " UNION ALL ".join(f"SELECT PersonKey, HouseholdKey, AddressKey, HouseholdType, Role, {i} AS step, DATE '{cfg.day(i)}' AS since FROM s{i} WHERE touched" for i in range(cfg.periods + 1))
    subject = "coalesce(SubjectPersonKey, SubjectHouseholdKey, PersonKeyA, Parent1PersonKey, ChildPersonKey)"
    every = " UNION ALL ".join(f"SELECT * FROM {x}" for x in told)
    out += [f"log AS MATERIALIZED ({logged})", f"told AS MATERIALIZED (SELECT 'EVT_' || lpad(CAST(row_number() OVER (ORDER BY ord, {subject}) AS VARCHAR), 7, '0') AS EventKey, * EXCLUDE (ord) FROM ({every}) x)"]
    return ",\n".join(out)


def history_sql(value: str, names: str, keep: str = "true") -> str:
    """Intervals of what held, from the log: changes to another value, each until the day before the next one."""
    fresh = f"SELECT PersonKey, {value} AS v, since FROM log WHERE {keep} QUALIFY {value} IS DISTINCT FROM lag({value}) OVER (PARTITION BY PersonKey ORDER BY since) OR lag(since) OVER (PARTITION BY PersonKey ORDER BY since) IS NULL"
    return f"SELECT PersonKey, {names}, since AS {{start}}, lead(since) OVER (PARTITION BY PersonKey ORDER BY since) - 1 AS {{end}} FROM ({fresh}) x"


def _start(seed: int) -> str:
    """T-7 in SQL."""
    return f"""
SELECT p.PersonKey, 'HH_BASE_' || p.PersonKey AS HouseholdKey, p.AddressKey, CASE WHEN coalesce(trim(p.ResidenceType), '') = '' THEN 'solo' ELSE 'solo_' || lower(trim(p.ResidenceType)) END AS HouseholdType, 'HEAD' AS Role,
       CAST(NULL AS VARCHAR) AS Partner, p.Gender, p.Age, p.LastName, p.Ethnicity, MobilityPropensityScore AS Mobility, PartnershipPropensityScore AS Partnership, FertilityPropensityScore AS Fertility
FROM {{people}} p JOIN ({traits_sql(seed)}) t ON t.PersonKey = p.PersonKey
"""


_START = _start(7)
_SIM = "WITH " + steps_sql(CONFIG, _START)
_RESIDENCE = history_sql("AddressKey", "v AS AddressKey", "AddressKey IS NOT NULL").format(start="ResidenceStartDate", end="ResidenceEndDate")
_MEMBERS = history_sql("{'h': HouseholdKey, 'r': Role}".replace("{", "{{").replace("}", "}}"), "v.h AS HouseholdKey, v.r AS HouseholdRole").format(start="MembershipStartDate", end="MembershipEndDate")


@query(f"{_SIM}\nSELECT * FROM told")
def sim_events(t: Tables):  # noqa: ANN201
    return truth.simulate(_people(t), CONFIG)["events"]


@query(f"{_SIM}\n{_RESIDENCE}")
def sim_intervals(t: Tables):  # noqa: ANN201
    return truth.simulate(_people(t), CONFIG)["residence_history"]


@query(f"""{_SIM}, m AS MATERIALIZED ({_MEMBERS}),
d AS (SELECT HouseholdKey, MembershipStartDate AS day, 1 AS n FROM m UNION ALL SELECT HouseholdKey, MembershipEndDate + 1, -1 FROM m WHERE MembershipEndDate IS NOT NULL),
c AS (SELECT HouseholdKey, sum(sum(n)) OVER (PARTITION BY HouseholdKey ORDER BY day) AS size FROM d GROUP BY HouseholdKey, day)
SELECT HouseholdKey, count(*) AS points, CAST(sum(CASE WHEN size BETWEEN 1 AND 8 THEN 0 ELSE 1 END) AS BIGINT) AS violations, CAST(max(size) AS BIGINT) AS peak FROM c WHERE size > 0 GROUP BY HouseholdKey""")
def sim_household_sizes(t: Tables):  # noqa: ANN201
    return intervals.sweep(truth.simulate(_people(t), CONFIG)["memberships"])


@query(f"""{_SIM}, m AS MATERIALIZED ({_MEMBERS})
SELECT HouseholdKey, min(MembershipStartDate) AS HouseholdStartDate, CASE WHEN count(*) = count(MembershipEndDate) THEN max(MembershipEndDate) END AS HouseholdEndDate,
       (SELECT first(l.HouseholdType ORDER BY l.step, l.HouseholdType) FROM log l WHERE l.HouseholdKey = m.HouseholdKey) AS HouseholdType
FROM m GROUP BY HouseholdKey""")
def sim_households(t: Tables):  # noqa: ANN201
    return truth.simulate(_people(t), CONFIG)["households"]


@query(f"{_SIM}\nSELECT PersonKey, HouseholdKey, AddressKey, HouseholdType, Role, Partner, Gender, Age, LastName, Ethnicity FROM s{CONFIG.periods}")
def sim_state(t: Tables):  # noqa: ANN201
    return truth.simulate(_people(t), CONFIG)["state"].select("PersonKey", "HouseholdKey", "AddressKey", "HouseholdType", "Role", "Partner", "Gender", "Age", "LastName", "Ethnicity")


_BROKEN = f"SELECT PersonKey, Partner, HouseholdKey, CASE WHEN CAST(regexp_extract(PersonKey, '[0-9]+', 0) AS BIGINT) % 3 = 0 THEN 'ADDR_ELSEWHERE' ELSE AddressKey END AS AddressKey FROM s{CONFIG.periods}"
_HALVED = f"SELECT PersonKey, AddressKey, ResidenceStartDate, CASE WHEN CAST(regexp_extract(PersonKey, '[0-9]+', 0) AS BIGINT) % 4 = 0 THEN ResidenceEndDate + 40 ELSE ResidenceEndDate END AS ResidenceEndDate FROM ({_RESIDENCE}) h"


def _faults_sql(history: str, state: str) -> str:
    """Numbers of couples, of those apart, of people whose intervals overlap, and of events that no grammar allows, from the steps."""
    named = " OR ".join(f"({c})" for c, _, _ in GRAMMAR)
    return f"""{_SIM}, h AS MATERIALIZED ({history}), st AS MATERIALIZED ({state}),
v AS (SELECT PersonKey FROM (SELECT PersonKey, ResidenceEndDate < ResidenceStartDate AS turned, ResidenceStartDate <= lag(coalesce(ResidenceEndDate, DATE '9999-12-31')) OVER (PARTITION BY PersonKey ORDER BY ResidenceStartDate, AddressKey) AS lap FROM h) x
  GROUP BY PersonKey HAVING count(*) FILTER (WHERE turned OR lap) > 0),
c AS (SELECT count(*) AS couples, count(*) FILTER (WHERE a.HouseholdKey <> b.HouseholdKey OR a.AddressKey <> b.AddressKey) AS apart FROM st a JOIN st b ON b.PersonKey = a.Partner WHERE a.PersonKey < a.Partner),
g AS (SELECT count(*) AS grammar FROM (SELECT *, upper(trim(coalesce(EventType, ''))) AS t FROM told) e WHERE {named})
SELECT CAST(grammar AS INT) AS grammar, CAST((SELECT count(*) FROM v) AS INT) AS overlaps, CAST(couples AS INT) AS couples, CAST(apart AS INT) AS apart FROM g, c"""


def _faults(made, history, state):  # noqa: ANN001, ANN202
    bad = intervals.interval_violations(history, "PersonKey", "ResidenceStartDate", "ResidenceEndDate", "AddressKey")
    a = validate.grammar_errors(made["events"]).agg(F.count("*").cast("int").alias("grammar"))
    b = bad.agg(F.count("*").cast("int").alias("overlaps"))
    return a.crossJoin(b).crossJoin(truth.couple_colocation(state).select(F.col("couples").cast("int").alias("couples"), F.col("apart").cast("int").alias("apart")))


@query(_faults_sql(_RESIDENCE, f"SELECT * FROM s{CONFIG.periods}"))
def sim_faults(t: Tables):  # noqa: ANN201
    """Numbers of faults of a simulated truth, beside the number of its couples. All but that are zero if the simulation is right."""
    made = truth.simulate(_people(t), CONFIG)
    return _faults(made, made["residence_history"], made["state"])


@query(_faults_sql(_HALVED, _BROKEN))
def sim_faults_found(t: Tables):  # noqa: ANN201
    """The same over a truth with faults put in: intervals of a quarter of all people last 40 days longer, and a third live elsewhere."""
    made = truth.simulate(_people(t), CONFIG)
    number = F.regexp_extract("PersonKey", "[0-9]+", 0).cast("long")
    history = made["residence_history"].withColumn("ResidenceEndDate", F.when(number % 4 == 0, F.date_add("ResidenceEndDate", 40)).otherwise(F.col("ResidenceEndDate")))
    state = made["state"].withColumn("AddressKey", F.when(number % 3 == 0, "ADDR_ELSEWHERE").otherwise(F.col("AddressKey")))
    return _faults(made, history, state)


def _rooms(low: int, high: int, share: float, seed: int) -> str:
    """T-8 in SQL: sizes drawn by hash, placed by their running sum."""
    return f"""
WITH able AS (SELECT PersonKey, AddressKey, row_number() OVER (ORDER BY {unit_sql(seed, 'roommates', 'PersonKey')}, PersonKey) - 1 AS rn FROM ({_START}) x WHERE Age BETWEEN 18 AND 30),
t AS (SELECT least(greatest(CAST(round_even({_double(share)} * count(*) / 100, 0) AS BIGINT), {low}), count(*)) AS target FROM able),
drawn AS (SELECT g, CASE WHEN g = 0 THEN {max(low, 3)} ELSE {low} + {int_sql(seed, 'roommates:size', high - low + 1, 'g')} END AS size FROM t, LATERAL (SELECT unnest(range(0, target // {low} + 1)) AS g) r),
placed AS (SELECT g, size, sum(size) OVER (ORDER BY g) - size AS first, target FROM drawn, t),
fitted AS (SELECT g, first, CASE WHEN target - first - size = 1 AND size < {high} THEN size + 1 WHEN target < first + size THEN target - first ELSE size END AS size FROM placed WHERE first < target),
member AS (SELECT able.*, g, first FROM able JOIN fitted ON rn >= first AND rn < first + size WHERE size >= {low})
SELECT PersonKey, 'HH_ROOM_BASE_' || lpad(CAST(g + 1 AS VARCHAR), 6, '0') AS HouseholdKey, first(AddressKey) OVER (PARTITION BY g ORDER BY rn) AS AddressKey, CASE WHEN rn = first THEN 'HEAD' ELSE 'ROOMMATE' END AS Role
FROM member
"""


@query(_rooms(3, 5, 42, 7))
def roommate_groups(t: Tables):  # noqa: ANN201
    return truth.roommates(truth.initial_state(_people(t)), 7, 42).where("HouseholdType = 'roommates'").select("PersonKey", "HouseholdKey", "AddressKey", "Role")


NICKNAMES = [("James", ["Jim", "Jimmy"]), ("Robert", ["Bob"]), ("Mary", ["Polly", "Molly"]), ("Patricia", ["Pat", "Trish"]), ("Michael", ["Mike"])]


def _scenario(t: Tables, name: str, patch: dict[str, Any] | None = None):  # noqa: ANN202
    people = t["people"].select(*PEOPLE_COLUMNS, "AddressKey", "ResidenceType")
    book = t["people"].select("AddressKey", F.concat(F.lit("Street "), "AddressKey").alias("StreetName"), "ZipCode")
    return run_scenario(t["dated_records"], people, patched(scenario(name), patch or {}), book, t.spark.createDataFrame(NICKNAMES, "FormalName string, variants array<string>"))


def _record_map_sql(name: str, patch: dict[str, Any] | None = None) -> str:
    """(PersonKey, DatasetId, RecordKey) of a scenario that selects everybody: simulation, snapshots, coverage, duplication and record keys."""
    s = patched(scenario(name), patch or {})
    specs, seed = s.datasets(), s.seed
    rank = lambda salt, extra="", own=seed: f"row_number() OVER (ORDER BY {extra}{unit_sql(own, salt, 'PersonKey')}, PersonKey) - 1"
    part = lambda pct, n: f"CAST(round_even({_double(pct)} * {n} / 100, 0) AS BIGINT)"
    born = "SELECT ChildPersonKey AS PersonKey FROM told WHERE EventType = 'BIRTH'"
    out = [steps_sql(s.simulation(), _start(seed)), "old AS MATERIALIZED (SELECT PersonKey FROM s0)", f"late AS MATERIALIZED ({born})", "n AS MATERIALIZED (SELECT (SELECT count(*) FROM old) AS n0, (SELECT count(*) FROM late) AS nl)"]
    fresh: dict[int, str] = {}
    if len(specs) == 1:
        every = "(SELECT PersonKey FROM old UNION ALL SELECT PersonKey FROM late)"
        out.append(f"cover AS MATERIALIZED (SELECT PersonKey, r < {part(s.appear[0], '(n0 + nl)')} AS in_0 FROM (SELECT PersonKey, {rank('coverage')} AS r FROM {every} y) x, n)")
    elif len(specs) == 2:
        a, b = (part(p, "n0") for p in s.appear)
        out.append(f"z AS (SELECT *, greatest(greatest(0, a + b - n0), least({part(s.overlap, 'n0')}, a, b)) AS o FROM (SELECT *, {a} AS a, {b} AS b FROM n) x)")
        out.append(f"cover AS MATERIALIZED (SELECT PersonKey, r < a AS in_0, r < o OR (r >= a AND r < a + b - o) AS in_1 FROM (SELECT PersonKey, {rank('coverage')} AS r FROM old) x, z)")
        fresh = {1: f"SELECT PersonKey FROM (SELECT PersonKey, {rank('late')} AS r FROM late) x, n WHERE r < {part(s.appear[1], 'nl')}"}
    else:
        size = lambda k: part(s.appear[k], "(n0 + nl)" if k else "n0")
        own = lambda k: f"least({size(k)}, nl)" if k else "0"
        out.append("z AS MATERIALIZED (SELECT *, least(" + ", ".join([part(s.overlap, "n0"), *(f"{size(k)} - {own(k)}" for k in range(len(specs)))]) + ") AS o FROM n)")
        out.append(f"cover0 AS MATERIALIZED (SELECT PersonKey, CASE WHEN r < o THEN -1 ELSE 0 END AS times FROM (SELECT PersonKey, {rank('overlap')} AS r FROM old) x, z)")
        for k in range(len(specs)):
            keep = "".join(f", in_{j}" for j in range(k))
            out.append(f"fill{k} AS MATERIALIZED (SELECT PersonKey, times{keep}, r < {size(k)} - {own(k)} AS in_{k} FROM (SELECT *, {rank(f'fill:{k}', 'times, ')} AS r FROM cover{k}) x, z)")
            out.append(f"cover{k + 1} AS MATERIALIZED (SELECT PersonKey, CASE WHEN times < 0 THEN times ELSE times + CAST(in_{k} AS INT) END AS times{keep}, in_{k} FROM fill{k})")
        out.append(f"cover AS MATERIALIZED (SELECT * EXCLUDE (times) FROM cover{len(specs)})")
        fresh = {k: f"SELECT PersonKey FROM (SELECT PersonKey, {rank(f'late:{k}')} AS r FROM late) x, n WHERE r < {own(k)}" for k in range(1, len(specs))}
    every, parts = " AND ".join(f"in_{k}" for k in range(len(specs))), []
    for k, spec in enumerate(specs):
        two = s.mode == "many_to_many" or s.mode == ("one_to_many" if k else "many_to_one")
        more = f" UNION ALL SELECT PersonKey, false FROM ({fresh[k]}) y" if k in fresh else ""
        out.append(f"m{k} AS MATERIALIZED (SELECT PersonKey, {every if two else 'false'} AS forced FROM cover WHERE in_{k}{more})")
        count, extras = f"(SELECT count(*) FROM m{k})", f"greatest(0, {part(s.duplicates[k], f'(SELECT count(*) FROM m{k})')} - (SELECT count(*) FROM m{k} WHERE forced))"
        out.append(f"x{k} AS MATERIALIZED (SELECT {int_sql(seed + k, 'extra', count, 'i')} AS r, count(*) AS extra FROM range({extras}) y(i) GROUP BY 1)")
        out.append(f"w{k} AS MATERIALIZED (SELECT PersonKey, unnest(range(1, 2 + CAST(forced AS INT) + CAST(coalesce(extra, 0) AS INT))) AS c FROM (SELECT *, {rank('extras', own=seed + k)} AS r FROM m{k}) y LEFT JOIN x{k} USING (r))")
        order = "CASE WHEN regexp_full_match(PersonKey, '[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(PersonKey, '[0-9]+') THEN lpad(PersonKey, 20, '0') ELSE PersonKey END, c"
        parts.append(f"SELECT PersonKey, '{spec.dataset}' AS DatasetId, '{spec.dataset}-' || lpad(CAST(row_number() OVER (ORDER BY {order}) AS VARCHAR), 9, '0') AS RecordKey FROM w{k}")
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(parts)


@query(_record_map_sql("couple_merge"))
def scenario_record_map(t: Tables):  # noqa: ANN201
    return _scenario(t, "couple_merge").record_map


@query(_record_map_sql("three_source_partial_overlap"))
def scenario_three_sources(t: Tables):  # noqa: ANN201
    return _scenario(t, "three_source_partial_overlap").record_map


_SINGLE = {"appear": (60,), "duplicates": (25,), "periods": 3, "rates": {"birth": 60, "move": 12}}


@query(_record_map_sql("high_duplication_dedup", _SINGLE))
def scenario_single_dataset(t: Tables):  # noqa: ANN201
    """G-19: a dataset of part of the people, those born in the simulation among them."""
    return _scenario(t, "high_duplication_dedup", _SINGLE).record_map


_RATES = NoiseRates(middle_missing=30, ssn_mask=20, phone_missing=10, address_missing=15, nickname=40, date_swap=35, suffix_missing=50)
_gate = lambda op: f"{unit_sql(7, f'gate:{op}', 'RecordKey')} < {_double(getattr(_RATES, op) / 100)}"
_RENAMED = "CASE FirstName " + " ".join(f"WHEN '{n}' THEN {_pick(tuple(v), int_sql(7, 'nickname', len(v), 'RecordKey'))}" for n, v in NICKNAMES) + " ELSE FirstName END"


@query(f"""
WITH n AS (SELECT count(*) AS n, CAST(round_even(12e0 * count(*) / 100, 0) AS BIGINT) AS e FROM {{people}}),
x AS (SELECT {int_sql(7, 'extra', '(SELECT n FROM n)', 'i')} AS r, count(*) AS extra FROM range((SELECT e FROM n)) y(i) GROUP BY 1),
w AS (SELECT PersonKey, unnest(range(1, 2 + CAST(coalesce(extra, 0) AS INT))) AS c FROM (SELECT PersonKey, row_number() OVER (ORDER BY {unit_sql(7, 'extras', 'PersonKey')}, PersonKey) - 1 AS r FROM {{people}}) y LEFT JOIN x USING (r)),
k AS (SELECT PersonKey, 'feed-' || lpad(CAST(row_number() OVER (ORDER BY CAST(PersonKey AS BIGINT), c) AS VARCHAR), 9, '0') AS RecordKey FROM w),
o AS (SELECT RecordKey, PersonKey, CASE WHEN {_gate('nickname')} THEN {_RENAMED} ELSE FirstName END AS FirstName, CASE WHEN NOT {_gate('middle_missing')} THEN MiddleName END AS MiddleName, LastName,
  CASE WHEN NOT {_gate('suffix_missing')} THEN Suffix END AS Suffix, CASE WHEN {_gate('date_swap')} AND day(DOB) <= 12 AND day(DOB) <> month(DOB) THEN make_date(year(DOB), day(DOB), month(DOB)) ELSE DOB END AS DOB,
  CASE WHEN {_gate('ssn_mask')} THEN '***-**-' || right(SSN, 4) ELSE SSN END AS SSN, CASE WHEN NOT {_gate('phone_missing')} THEN Phone END AS Phone, CASE WHEN NOT {_gate('address_missing')} THEN AddressKey END AS AddressKey,
  {_gate('nickname')} AS noise_nickname, 'feed' AS SourceSystem FROM k JOIN {{people}} USING (PersonKey))
SELECT *, concat_ws(' ', FirstName, MiddleName, LastName) AS FullName FROM o
""")
def emitted_rows(t: Tables):  # noqa: ANN201
    """G-22, W-5: records of a snapshot, their keys, duplicates, noise in its order, and flags."""
    names = t.spark.createDataFrame(NICKNAMES, "FormalName string, variants array<string>")
    made = emission.emit(t["people"], t["people"].select("PersonKey"), t["people"].count(), emission.DatasetSpec("feed", "2026-01-01", 12, _RATES), 0, 7, names)
    return made.select("RecordKey", "PersonKey", "FirstName", "MiddleName", "LastName", "Suffix", "DOB", "SSN", "Phone", "AddressKey", "noise_nickname", "SourceSystem", "FullName")


@query()
def scenario_quality(t: Tables):  # noqa: ANN201
    return _scenario(t, "single_movers").quality()


@query()
def scenario_observed(t: Tables):  # noqa: ANN201
    return _scenario(t, "three_source_partial_overlap").observed["claims"]
