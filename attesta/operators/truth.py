"""Truth simulation (T-0..T-10): an event-sourced stepper over a state of people, in a fixed order of phases, with interval histories made at the end."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digest_text, int_text, text_or_empty, unit_text
from ..sources.checkpoints import Workspace
from .allocation import group_sizes, hash_rank, range_numbered, rank_buckets
from .intervals import closed_history
from .validate import COHABIT_MODES, CUSTODY_MODES, EVENT_COLUMNS, Constraints


@dataclass(frozen=True)
class SimulationConfig:
    """Annual rates in percent and the calendar of a run."""

    start: dt.date = dt.date(2026, 1, 1)
    periods: int = 12
    step: str = "monthly"
    move: float = 0.0
    cohabit: float = 0.0
    birth: float = 0.0
    divorce: float = 0.0
    leave_home: float = 0.0
    seed: int = 20260303
    limits: Constraints = field(default_factory=Constraints)

    def __post_init__(self) -> None:
        if self.step not in ("monthly", "daily") or self.periods < 0:
            raise ValueError("a step is monthly or daily, and periods are not negative")
        if any(not 0 <= r <= 100 for r in (self.move, self.cohabit, self.birth, self.divorce, self.leave_home)):
            raise ValueError("rates are from 0 to 100")

    def day(self, i: int) -> dt.date:
        """The date of step i, always counted from the start, so that short months don't shift later ones."""
        if self.step == "daily":
            return self.start + dt.timedelta(days=i)
        m = self.start.month - 1 + i
        year, month = self.start.year + m // 12, m % 12 + 1
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(year, month, min(self.start.day, last))

    def rate(self, annual: float) -> float:
        return step_rate(annual, self.step)


def step_rate(annual_pct: float, step: str = "monthly") -> float:
    """T-0. The odds of one step that make the annual percentage over a year."""
    p = min(1.0, max(0.0, annual_pct / 100))
    return p if p in (0.0, 1.0) else 1 - (1 - p) ** (1 / (12 if step == "monthly" else 365))


#: What a row knows of its partner, so that whatever a couple does is decided in either row without a join.
TRAITS = ("Gender", "Age", "Partnership", "Mobility", "Fertility")
OWN = ("PersonKey", "HouseholdKey", "AddressKey", "HouseholdType", "Role", "Partner", "Gender", "Age", "LastName", "Ethnicity", "Mobility", "Partnership", "Fertility")
_KINDS = {"Gender": "string", "Age": "int", "Partnership": "double", "Mobility": "double", "Fertility": "double"}
_EVENT = "struct<" + ",".join(f"{c}:{'date' if c == 'EventDate' else 'string'}" for c in EVENT_COLUMNS if c != "EventKey") + ",phase:int>"


def initial_state(people: DataFrame) -> DataFrame:
    """T-7. A household of its own for each person of (PersonKey, Gender, Age, LastName, Ethnicity, AddressKey, ResidenceType, *PropensityScore)."""
    kind = F.lower(text_or_empty(F.col("ResidenceType")))
    return people.select(
        "PersonKey", F.concat(F.lit("HH_BASE_"), "PersonKey").alias("HouseholdKey"), "AddressKey", F.when(kind == "", "solo").otherwise(F.concat(F.lit("solo_"), kind)).alias("HouseholdType"), F.lit("HEAD").alias("Role"),
        F.lit(None).cast("string").alias("Partner"), "Gender", F.col("Age").cast("int").alias("Age"), "LastName", "Ethnicity",
        *[F.coalesce(F.col(f"{s}PropensityScore").cast("double"), F.lit(d)).alias(s) for s, d in (("Mobility", 0.1), ("Partnership", 0.45), ("Fertility", 0.3))],
        *[F.lit(None).cast(_KINDS[t]).alias(f"p{t}") for t in TRAITS],
    )


def begun(state: DataFrame) -> DataFrame:
    """The state at the start of a step: nobody is locked or changed, nothing has happened."""
    return state.selectExpr(*state.columns, "false AS locked", "false AS touched", f"CAST(NULL AS {_EVENT}) AS event")


# A step is one SQL text, which is parsed and resolved once; phases add to it. What is told is the phase with the three values that later phases may change; the events themselves are made at the end of the
# step, so that no phase's code carries their columns.


@dataclass(frozen=True)
class _Rows:
    """A SELECT and the columns it has."""

    columns: tuple[str, ...]
    text: str

    def where(self, condition: str) -> _Rows:
        return _Rows(self.columns, f"SELECT * FROM ({self.text}) WHERE {condition}")


#: The phase that a row tells of, and of that the former partner and address and the new address.
_SAYS = {"phase": "int", "_other": "string", "_from": "string", "_to": "string"}
_GONE = {"Partner": "CAST(NULL AS STRING)"} | {f"p{t}": f"CAST(NULL AS {_KINDS[t]})" for t in TRAITS}


def _double(x: float) -> str:
    return f"{float(x)!r}D"


def _with(rows: _Rows, values: dict[str, str], *drop: str, hint: str = "") -> _Rows:
    """rows with columns replaced or added, from text."""
    new = {c: c for c in rows.columns if c not in drop} | values
    return _Rows(tuple(new), f"SELECT {hint}{', '.join(v if v == c else f'{v} AS {c}' for c, v in new.items())} FROM ({rows.text})")


def _where(hit: str, values: dict[str, str]) -> dict[str, str]:
    """New values where hit, which locks."""
    return {c: f"CASE WHEN {hit} THEN {v} ELSE {c} END" for c, v in values.items()} | {"locked": f"locked OR {hit}", "touched": f"touched OR {hit}"}


def _key(prefix: str, i: int, phase: str, key: str) -> str:
    return f"concat('{prefix}_SIM_{i:04d}{phase}_', {key})"


def _below(cfg: SimulationConfig, salt: str, rate: float, part: str, key: str = "PersonKey", most: float = 1.5) -> str:
    """Whether a hash is below the odds rate * part. Where part is at most `most`, as it is for scores from 0 to 1, the first digits of the digest rule out nearly all rows; only the others need a number."""
    odds = f"{_double(rate)} * {part}"
    under = f"{unit_text(cfg.seed, salt, key)} < least(greatest({odds}, 0D), 1D)"
    top = math.ceil(rate * most * (1 + 1e-9) * 65536)
    return under if top >= 65536 else f"CASE WHEN {part} > {_double(most)} OR {digest_text(cfg.seed, salt, key)} < '{top:04x}' THEN {under} ELSE false END"


def _chosen(values: tuple[str, ...], cfg: SimulationConfig, salt: str, key: str) -> str:
    return f"element_at(array({', '.join(map(repr, values))}), {int_text(cfg.seed, salt, len(values), key)} + 1)"


def _divorce(rows: _Rows, cfg: SimulationConfig, i: int) -> _Rows:
    """T-1. Couples part; the second by key leaves for a new household and address."""
    hit = _below(cfg, f"divorce:{i}", cfg.rate(cfg.divorce), "(1.7D - (Partnership + pPartnership) / 2)", "least(PersonKey, Partner)", 1.7)
    asked = _with(rows, {"_hit": f"coalesce(NOT locked AND Partner IS NOT NULL AND {hit}, false)", "_first": "coalesce(PersonKey < Partner, false)"})
    moved = {"HouseholdKey": _key("HH", i, "D", "PersonKey"), "AddressKey": _key("ADDR", i, "D", "PersonKey"), "HouseholdType": "'post_divorce'", "Role": "'HEAD'"}
    second = {c: f"CASE WHEN _hit AND NOT _first THEN {v} ELSE {c} END" for c, v in moved.items()}
    told = {"phase": "0", "_other": "Partner", "_from": "AddressKey"}
    return _with(asked, _where("_hit", _GONE) | second | {c: f"CASE WHEN _hit AND _first THEN {v} ELSE {c} END" for c, v in told.items()}, "_hit", "_first")


def _free(cfg: SimulationConfig) -> str:
    """Who may become a partner in a step."""
    return f"Partner IS NULL AND coalesce(Age, 0) >= {0 if cfg.limits.allow_underage_marriage else cfg.limits.min_marriage_age}"


def _paired(free: _Rows, seed: int, salt: str, columns: tuple[str, ...], n: int) -> _Rows:
    """free with `_mate`, these columns of the other one of its pair, and `_even`, true for the first of the two: rows 0 and 1 in the order of their hashes, 2 and 3, and so on; the last of an odd number has no mate.

    Hashes are counted by bucket, and buckets are put together so that each group of them begins with an even row. Then no pair lies across groups, and a row finds its mate beside it: rows move once, and nothing is joined
    but the few buckets. About every other bucket begins a group. Hashes are those in `_turn`, if free has that column: both counts and rows read them.
    """
    hashed = _with(free, {"_u": "_turn" if "_turn" in free.columns else unit_text(seed, salt, "PersonKey")}, "_turn")
    hashed = _with(hashed, {"_bucket": f"CAST(floor(_u * {rank_buckets(n) - 1}) AS BIGINT)"})
    counts = f"SELECT _bucket, count(*) AS _n FROM ({hashed.text}) GROUP BY _bucket"
    before = f"SELECT _bucket, coalesce(sum(_n) OVER (ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before FROM ({counts})"
    groups = f"SELECT _bucket, max(CASE WHEN _before % 2 = 0 THEN _bucket END) OVER (ORDER BY _bucket) AS _group FROM ({before})"
    rows = _Rows((*hashed.columns, "_group"), f"SELECT /*+ BROADCAST(g) */ h.*, g._group FROM ({hashed.text}) h JOIN ({groups}) g ON h._bucket = g._bucket")
    order, one = "OVER (PARTITION BY _group ORDER BY _u, PersonKey)", f"struct({', '.join(columns)})"
    met = _with(rows, {"_even": f"row_number() {order} % 2 = 1", "_before": f"lag({one}) {order}", "_after": f"lead({one}) {order}"}, "_bucket")
    return _with(met, {"_mate": "CASE WHEN _even THEN _after ELSE _before END"}, "_u", "_group", "_before", "_after")


def _cohabit(rows: _Rows, cfg: SimulationConfig, i: int, n: int) -> _Rows:
    """T-2, J-16, J-17. Free people of age (rows) are paired in the order of their hashes; some pairs become couples with a new household. A pair that doesn't is not paired again in the step."""
    met = _paired(rows, cfg.seed, f"pair:{i}", ("PersonKey", "AddressKey", *TRAITS), n)
    met = _with(met, {"_a": "CASE WHEN _even THEN PersonKey ELSE _mate.PersonKey END"})
    hit = _below(cfg, f"cohabit:{i}", cfg.rate(cfg.cohabit), "(0.5D + (Partnership + _mate.Partnership) / 2)", "_a")
    near = f"coalesce(abs(Age - _mate.Age) <= {cfg.limits.gap}, true)" if cfg.limits.gap is not None else "true"
    asked = _with(met, {"_hit": f"coalesce(_mate IS NOT NULL AND {near} AND {hit}, false)"})
    asked = _with(asked, {"_mode": f"CASE WHEN _hit THEN {_chosen(COHABIT_MODES, cfg, f'cohabit:mode:{i}', '_a')} END"})
    side = lambda of_a: f"nullif(trim(CASE WHEN _even = {of_a} THEN AddressKey ELSE _mate.AddressKey END), '')"
    asked = _with(asked, {"_new": f"coalesce(CASE _mode WHEN 'move_to_A' THEN {side('true')} WHEN 'move_to_B' THEN {side('false')} END, {_key('ADDR', i, 'C', '_a')})"}, "_mode")
    values = {"HouseholdKey": _key("HH", i, "C", "_a"), "AddressKey": "_new", "HouseholdType": "'couple'", "Role": "CASE WHEN _even THEN 'HEAD' ELSE 'SPOUSE' END", "Partner": "_mate.PersonKey"} | {f"p{t}": f"_mate.{t}" for t in TRAITS}
    told = {c: f"CASE WHEN _hit AND _even THEN {v} ELSE {c} END" for c, v in {"phase": "1", "_to": "_new"}.items()}
    return _with(asked, _where("_hit", values) | told, "_hit", "_a", "_even", "_mate", "_new")


def _birth(rows: _Rows, cfg: SimulationConfig, i: int) -> _Rows:
    """T-3. Women of the right age, or of unknown gender, bear children; of a couple only one does in a step, the first by key. Both parents are locked."""

    def bears(key: str, trait: str) -> str:
        able = f"lower(trim(coalesce({trait}Gender, ''))) IN ('female', 'f', '') AND {trait}Age BETWEEN {cfg.limits.fertility_age_min} AND {cfg.limits.fertility_age_max}"
        return f"coalesce(NOT locked AND {key} IS NOT NULL AND {able} AND {_below(cfg, f'birth:{i}', cfg.rate(cfg.birth), f'(0.4D + {trait}Fertility)', key)}, false)"

    asked = _with(rows, {"_own": bears("PersonKey", ""), "_mate": bears("Partner", "p")})
    asked = _with(asked, {"_bears": "_own AND NOT (_mate AND Partner < PersonKey)", "_parent": "_own OR _mate"}, "_own", "_mate")
    every = _with(asked, {"_child": "explode(CASE WHEN _bears THEN array(false, true) ELSE array(false) END)"})
    child = {
        "PersonKey": f"concat('P_CHILD_{i:04d}_', PersonKey)", "Role": "'CHILD'", "Gender": f"CASE WHEN {unit_text(cfg.seed, f'child:{i}', 'PersonKey')} < 0.5D THEN 'female' ELSE 'male' END", "Age": "0",
        "Mobility": "0.25D", "Partnership": "0.05D", "Fertility": "0.05D",
    } | _GONE | {c: f"CAST(NULL AS {t})" for c, t in _SAYS.items()}
    new = {c: f"CASE WHEN _child THEN {v} ELSE {c} END" for c, v in child.items()}
    return _with(every, new | {"phase": "CASE WHEN _child THEN NULL WHEN _bears THEN 2 ELSE phase END", "locked": "locked OR _parent", "touched": "touched OR _parent"}, "_bears", "_parent", "_child")


def _homes(rows: _Rows, cfg: SimulationConfig, i: int) -> _Rows:
    """T-4, T-5. Single people of 18 to 30 leave a household that has others for one of their own; the last one stays. Then households of couples move as a whole, and people who live alone by themselves.

    Who leaves is alone then, and of those who stay a household's numbers tell what is left: of n people of whom w want to leave, the smaller of w and n - 1 do. So households meet once.
    """
    leave, move = cfg.rate(cfg.leave_home), cfg.rate(cfg.move)
    free = "NOT locked AND Partner IS NULL"
    asked = _with(rows, {
        "_wants": f"coalesce({free} AND Age BETWEEN 18 AND 30 AND {_below(cfg, f'leave:{i}', leave, '1D', most=1.0)}, false)" if leave else "false",
        "_couple": f"coalesce(NOT locked AND PersonKey < Partner AND {_below(cfg, f'move:couple:{i}', move, '(0.5D + (Mobility + pMobility) / 2)')}, false)" if move else "false",
        "_single": f"coalesce({free} AND {_below(cfg, f'move:single:{i}', move, '(0.5D + Mobility)')}, false)" if move else "false",
    })
    asked = _with(asked, {"_turn": f"CASE WHEN _wants THEN struct({unit_text(cfg.seed, f'leave:turn:{i}', 'PersonKey')} AS u, PersonKey) END", "_hash": "xxhash64(HouseholdKey)"})
    home = "OVER (PARTITION BY _hash, HouseholdKey)"  # keys begin alike, so that a sort by them compares whole texts; numbers first spare it that
    dealt = _with(asked, {}, hint="/*+ REPARTITION(HouseholdKey) */ ")
    met = _with(dealt, {"_n": f"count(*) {home}", "_w": f"count_if(_wants) {home}", "_all": f"max(_couple) {home}", "_last": f"max(_turn) {home}"}, "_hash")
    met = _with(met, {"_left": "_wants AND NOT (_w = _n AND _turn = _last)"}, "_turn", "_last")
    met = _with(met, {"_all": "_all AND NOT _left", "_alone": "_single AND NOT _all AND NOT _left AND _n - least(_w, _n - 1) = 1"}, "_single", "_wants", "_n", "_w")
    to = _key("ADDR", i, "M", "CASE WHEN _all THEN HouseholdKey ELSE PersonKey END")
    values = {c: f"CASE WHEN _left THEN {v} ELSE {c} END" for c, v in {"HouseholdKey": _key("HH", i, "L", "PersonKey"), "HouseholdType": "'solo'", "Role": "'HEAD'"}.items()}
    values |= {"AddressKey": f"CASE WHEN _left THEN {_key('ADDR', i, 'L', 'PersonKey')} WHEN _all OR _alone THEN {to} ELSE AddressKey END"}
    told = {"phase": "CASE WHEN _left THEN 3 WHEN _couple OR _alone THEN 4 ELSE phase END", "_from": "CASE WHEN _left OR _couple OR _alone THEN AddressKey ELSE _from END"}
    return _with(met, values | told | {"locked": "locked OR _left OR _all OR _alone", "touched": "touched OR _left OR _all OR _alone"}, "_left", "_all", "_alone", "_couple")


def _told(rows: _Rows, cfg: SimulationConfig, i: int, day: str) -> _Rows:
    """rows with the event that each tells of, from its phase. day: the text of its date."""
    of = lambda **v: "CASE phase " + " ".join(f"WHEN {k[1:]} THEN {x}" for k, x in v.items()) + " END"
    parts = {
        "EventType": of(p0="'DIVORCE'", p1="'COHABIT'", p2="'BIRTH'", p3="'LEAVE_HOME'", p4="'MOVE'"), "EventDate": day, "SubjectPersonKey": of(p3="PersonKey", p4="CASE WHEN Partner IS NULL THEN PersonKey END"),
        "SubjectHouseholdKey": of(p2="HouseholdKey", p4="CASE WHEN Partner IS NOT NULL THEN HouseholdKey END"), "FromAddressKey": "_from", "ToAddressKey": of(p0=_key("ADDR", i, "D", "_other"), p1="_to", p3="AddressKey", p4="AddressKey"),
        "PersonKeyA": of(p0="PersonKey", p1="PersonKey"), "PersonKeyB": of(p0="_other", p1="Partner"), "NewHouseholdKey": of(p0=_key("HH", i, "D", "_other"), p1=_key("HH", i, "C", "PersonKey"), p3="HouseholdKey"),
        "CohabitMode": of(p1=_chosen(COHABIT_MODES, cfg, f"cohabit:mode:{i}", "PersonKey")), "CustodyMode": of(p0=_chosen(CUSTODY_MODES, cfg, f"custody:{i}", "PersonKey")),
        "ChildPersonKey": of(p2=f"concat('P_CHILD_{i:04d}_', PersonKey)", p3="PersonKey"), "Parent1PersonKey": of(p2="PersonKey"), "Parent2PersonKey": of(p2="Partner"),
    }
    values = ", ".join(f"{parts.get(c, 'CAST(NULL AS STRING)')} AS {c}" for c in EVENT_COLUMNS if c != "EventKey")
    return _with(rows, {"event": f"CASE WHEN phase IS NOT NULL THEN struct({values}, phase) END"}, *_SAYS)


PHASES = ("divorce", "cohabit", "birth", "leave_home", "move")


def stepped(state: DataFrame, cfg: SimulationConfig, i: int, n: int | None = None) -> DataFrame:
    """The state after step i, with `touched` for those who changed and `event` for what they tell of it.

    Phases run in order: divorce, cohabit, birth, leave home, move; one whose rate is zero has no plan. Who has changed is locked for later phases, so a row tells of one event at
    most. Couples decide in their own rows; only pairing strangers and counting households shuffle, and nothing is joined but counts of hash buckets.
    """
    return _stepped(state, cfg, i, state.count() if n is None else n, f"DATE '{cfg.day(i)}'")


def _turned(cfg: SimulationConfig, i: int) -> str:
    """What orders free people in step i, for the table of the step before it."""
    return f"CASE WHEN {_free(cfg)} THEN {unit_text(cfg.seed, f'pair:{i}', 'PersonKey')} END"


def _stepped(state: DataFrame, cfg: SimulationConfig, i: int, n: int, day: str) -> DataFrame:
    """stepped(); a state with `_turn`, the order of free people, gives one with that of the next step."""
    own = {c: c for c in state.columns if c not in ("locked", "touched", "event")}
    rows = _with(_Rows(tuple(state.columns), "SELECT * FROM {state}"), own | {"locked": "false", "touched": "false"} | {c: f"CAST(NULL AS {t})" for c, t in _SAYS.items()}, *state.columns)
    if cfg.rate(cfg.cohabit):  # couples part, free people pair, and nobody does both in a step
        free = _free(cfg)
        single, others = _cohabit(rows.where(free), cfg, i, n), rows.where(f"NOT ({free})")
        if cfg.rate(cfg.divorce):
            others = _divorce(others, cfg, i)
        kept = tuple(c for c in rows.columns if c != "_turn")
        names = ", ".join(kept)
        rows = _Rows(kept, f"SELECT {names} FROM ({single.text}) UNION ALL SELECT {names} FROM ({others.text})")
    elif cfg.rate(cfg.divorce):
        rows = _divorce(rows, cfg, i)
    if cfg.rate(cfg.birth):
        rows = _birth(rows, cfg, i)
    if cfg.rate(cfg.leave_home) or cfg.rate(cfg.move):
        rows = _homes(rows, cfg, i)
    turn = {"_turn": _turned(cfg, i + 1)} if "_turn" in state.columns else {}
    return state.sparkSession.sql(_with(_told(rows, cfg, i, day), turn, "locked").text, state=state)


def simulate(people: DataFrame, cfg: SimulationConfig, start: DataFrame | None = None) -> dict[str, DataFrame]:
    """Events, residence_history, memberships, households and the last state. start: the state to begin with, by default a household for each person.

    Every step is one table in the shared folder, written once and read by the next one; events and intervals come from all of them. So plans stay small, however many steps
    there are, and lost executors lose nothing.
    """
    spark = people.sparkSession
    ws = Workspace(spark, "truth")
    first = start if start is not None else initial_state(people)
    turn = {"_turn": F.expr(_turned(cfg, 1))} if cfg.rate(cfg.cohabit) else {}
    state = ws.save(begun(first).drop("locked").withColumn("touched", F.lit(True)).withColumns(turn), "step=0").drop("touched", "event")
    for i in range(1, cfg.periods + 1):
        if any(cfg.rate(getattr(cfg, name)) for name in PHASES):
            n = state.count()  # a count of a written table reads its footers alone
            state = ws.save(_stepped(state, cfg, i, n, "CAST(NULL AS DATE)"), f"step={i}").drop("touched", "event")  # without its date a step has the code of the one before it, which is compiled then
    steps = spark.read.schema(T.StructType([*begun(first).drop("locked").schema.fields, T.StructField("step", T.IntegerType())])).parquet(ws.path)
    state = state.drop("_turn")
    days = F.element_at(F.array(*[F.lit(cfg.day(i)) for i in range(cfg.periods + 1)]), F.col("step") + 1)
    log = steps.where("touched").select("PersonKey", days.alias("since"), "HouseholdKey", "AddressKey", "HouseholdType", "Role", "step")
    residence = closed_history(log.where("AddressKey IS NOT NULL").select("PersonKey", "AddressKey", "since"), "PersonKey", "AddressKey", "since")
    member = closed_history(log.select("PersonKey", F.struct("HouseholdKey", "Role").alias("h"), "since"), "PersonKey", "h", "since")
    memberships = member.select("PersonKey", "h.HouseholdKey", F.col("h.Role").alias("HouseholdRole"), F.col("start").alias("MembershipStartDate"), F.col("end").alias("MembershipEndDate"))
    kinds = log.groupBy("HouseholdKey").agg(F.min_by("HouseholdType", F.struct("step", "HouseholdType")).alias("HouseholdType"))
    spans = memberships.groupBy("HouseholdKey").agg(F.min("MembershipStartDate").alias("HouseholdStartDate"), F.when(F.count("*") == F.count("MembershipEndDate"), F.max("MembershipEndDate")).alias("HouseholdEndDate"))
    told = steps.where("event IS NOT NULL").select(*[(days if c == "EventDate" else F.col(f"event.{c}")).alias(c) for c in EVENT_COLUMNS if c != "EventKey"], (F.col("step") * 10 + F.col("event.phase")).alias("_order"))
    return {
        "events": numbered_events(told), "state": state, "memberships": memberships, "households": spans.join(kinds, "HouseholdKey", "left"),
        "residence_history": residence.select("PersonKey", "AddressKey", F.col("start").alias("ResidenceStartDate"), F.col("end").alias("ResidenceEndDate")),
    }


def numbered_events(told: DataFrame) -> DataFrame:
    """T-9. Events with keys EVT_0000001.. in the order of step, phase and subject."""
    subject = F.coalesce("SubjectPersonKey", "SubjectHouseholdKey", "PersonKeyA", "Parent1PersonKey", "ChildPersonKey")
    out = range_numbered(told.withColumn("_subject", subject), [F.col("_order"), F.col("_subject")], "_n")
    return out.withColumn("EventKey", F.concat(F.lit("EVT_"), F.lpad((F.col("_n") + 1).cast("string"), 7, "0"))).select(*EVENT_COLUMNS)


def children(events: DataFrame, state: DataFrame) -> DataFrame:
    """People born in the simulation: dense numbers in the order of events name them and make their SSN; last name and ethnicity are the parent's."""
    births = events.where("EventType = 'BIRTH'").select(F.col("ChildPersonKey").alias("PersonKey"), F.col("EventDate").alias("DOB"), "EventKey")
    n = F.col("_n") + 1
    pad = lambda c, width: F.lpad(c.cast("string"), width, "0")
    text = F.lit(None).cast("string")
    named = range_numbered(births, [F.col("EventKey")], "_n").select("PersonKey", "DOB", F.concat(F.lit("Child"), pad(n, 6)).alias("FirstName"), F.concat(F.lit("900-00-"), pad(n % 9000 + 1000, 4)).alias("SSN"))
    return named.join(state.select("PersonKey", "LastName", "Gender", "Ethnicity"), "PersonKey").select(
        "PersonKey", "FirstName", text.alias("MiddleName"), "LastName", text.alias("Suffix"), "Gender", "Ethnicity", "DOB", F.lit(0).alias("Age"), "SSN", text.alias("Phone")
    )


def couple_colocation(state: DataFrame) -> DataFrame:
    """T-10. (couples, apart): couples who don't share household and address."""
    other = state.select(F.col("PersonKey").alias("Partner"), F.col("HouseholdKey").alias("h"), F.col("AddressKey").alias("a"))
    both = state.where("Partner IS NOT NULL AND PersonKey < Partner").join(other, "Partner")
    return both.agg(F.count("*").alias("couples"), F.coalesce(F.sum(((F.col("HouseholdKey") != F.col("h")) | (F.col("AddressKey") != F.col("a"))).cast("long")), F.lit(0)).alias("apart"))


def roommates(state: DataFrame, seed: int, share: float, low: int = 3, high: int = 5, age_min: int = 18, age_max: int = 30) -> DataFrame:
    """T-8. The state with so many percent of those of the right age in shared households of low to high people, in the order of their hashes.

    The first address among the members that is not blank is shared, or a new one; the first member is the head; what is left over joins no group.
    """
    if not 2 <= low <= high:
        raise ValueError("groups have two people at least")
    able = state.where(F.col("Age").between(age_min, age_max))
    n = able.count()
    target = min(max(round(share * n / 100), low), n)
    if share <= 0 or target < low:
        return state
    groups = group_sizes(state.sparkSession.range(1).select(F.lit(target).cast("long").alias("target")), [], seed, "roommates", low, high, max(low, 3))
    places = groups.select("g", "first", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("_rn"))
    ranked = hash_rank(able.select("PersonKey", "AddressKey"), "PersonKey", seed, "roommates", "_rn").join(places, "_rn")
    shared = ranked.groupBy("g").agg(F.min_by("AddressKey", F.when(text_or_empty(F.col("AddressKey")) != "", F.col("_rn"))).alias("_to"))
    number = F.lpad((F.col("g") + 1).cast("string"), 6, "0")
    member = ranked.join(shared, "g").select(
        "PersonKey", F.concat(F.lit("HH_ROOM_BASE_"), number).alias("_home"), F.coalesce("_to", F.concat(F.lit("ADDR_ROOM_BASE_"), number)).alias("_to"), F.when(F.col("_rn") == F.col("first"), "HEAD").otherwise("ROOMMATE").alias("_role")
    )
    new = {"HouseholdKey": F.col("_home"), "AddressKey": F.col("_to"), "HouseholdType": F.lit("roommates"), "Role": F.col("_role")}
    rows = state.join(member, "PersonKey", "left")
    return rows.select(*[F.when(F.col("_home").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state.columns])
