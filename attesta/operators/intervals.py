"""Closed date intervals: as-of picks, interval joins, overlap checks and sweep lines (J-4, J-8, W-1, W-2, T-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval_contains
from ..functions.exprs import OPEN_END


def asof_address(residence: DataFrame, day, per_person_fallback: bool = False) -> DataFrame:
    """J-4. (PersonKey, AddressKey): the address whose interval holds the day, the latest start winning, then the greater key.

    Only if no person at all has one, the latest start up to the day counts; with per_person_fallback that holds for each person alone. Rows without an address are none.
    """
    d = F.lit(day).cast("date")
    order = F.struct("ResidenceStartDate", "AddressKey")
    active = interval_contains(F.col("ResidenceStartDate"), F.col("ResidenceEndDate"), d)
    begun = F.col("ResidenceStartDate").isNotNull() & (F.col("ResidenceStartDate") <= d)
    if per_person_fallback:
        picks = residence.where(begun).groupBy("PersonKey").agg(F.max(F.when(active, order)).alias("a"), F.max(order).alias("b"))
        return picks.select("PersonKey", F.coalesce("a", "b")["AddressKey"].alias("AddressKey"))
    known = F.col("AddressKey").isNotNull()
    some = not residence.where(active & known).select("PersonKey").isEmpty()  # ends at the first row found, so that the pass itself reads active rows alone
    return residence.where((active if some else begun) & known).groupBy("PersonKey").agg(F.max(order).alias("a")).select("PersonKey", F.col("a.AddressKey").alias("AddressKey"))


#: Blocks of days have 4**level days; the largest holds all days of the calendar, which count from the year 1.
_LEVELS, _EPOCH = 12, 719162


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date")) + _EPOCH


def covering_blocks(start: Column, end: Column) -> dict[str, Column]:
    """Columns level and block, a row each, of the blocks that a closed interval of days touches: those of the smallest level whose blocks are as long as the interval, so that they are one or two."""
    low, high = _day(start), _day(end)
    level = F.lit(_LEVELS - 1)
    for k in range(_LEVELS - 2, -1, -1):
        level = F.when(high - low < 4**k, F.lit(k)).otherwise(level)
    at = lambda d: F.call_function("shiftright", d, level * 2)
    return {"level": level, "block": F.explode(F.sequence(at(low), at(high)))}


def blocks_of_day(day: Column) -> Column:
    """The block of each level that holds a day."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.call_function("shiftright", _day(day), F.lit(2 * k)).alias("block")) for k in range(_LEVELS)])


def members_on(moves: DataFrame, memberships: DataFrame) -> DataFrame:
    """(EventKey, PersonKey) for each membership that holds the day of a move of its household, once for each such membership.

    A range join as an equal join: a membership is dealt to the one or two blocks of about its own length that it touches, a move to the block of each level that holds its day. The two share one block
    at most, so pairs are made once, and what a block holds beside true pairs is a small multiple of them; blocks spread a large household over many keys. Open ends count to the last move.
    """
    asked = moves.where("SubjectHouseholdKey IS NOT NULL AND EventDate IS NOT NULL").select("EventKey", F.col("SubjectHouseholdKey").alias("HouseholdKey"), "EventDate")
    last = asked.agg(F.max("EventDate").alias("_last"))
    m = memberships.where("HouseholdKey IS NOT NULL AND PersonKey IS NOT NULL").crossJoin(F.broadcast(last)).withColumn("_to", F.least(F.coalesce("MembershipEndDate", "_last"), "_last"))  # one row
    blocks = {k: c.alias(k) for k, c in covering_blocks(F.col("MembershipStartDate"), F.col("_to")).items()}
    spans = m.where("MembershipStartDate <= _to").select("HouseholdKey", "PersonKey", "MembershipStartDate", "_to", *blocks.values())
    days = asked.select("EventKey", "HouseholdKey", "EventDate", F.explode(blocks_of_day(F.col("EventDate"))).alias("at"))
    both = spans.join(days.select("*", "at.*").drop("at"), ["HouseholdKey", "level", "block"])
    return both.where("MembershipStartDate <= EventDate AND EventDate <= _to").select("EventKey", "PersonKey")


def household_move_members(moves: DataFrame, memberships: DataFrame) -> DataFrame:
    """J-8. (EventKey, PersonKey): members of the moving household on the day of the move."""
    return members_on(moves, memberships).distinct()


def interval_violations(df: DataFrame, entity: str, start: str, end: str, tie: str) -> DataFrame:
    """W-1. (entity, start_missing, end_before_start, overlaps) for each entity with any: an interval overlaps if it starts no later than the one before it ends.

    Rows without a start are counted and then left out, also as predecessors. Open ends last for ever. The tie column makes the order total.

    Rows are summed by day first, before the shuffle: of the intervals that start on one day, each but the first follows one that started the same day, so what counts are those that last until that day,
    without the last of them; the first follows the last one of the day before. The window then has a row for each day on which the entity has a start, however many intervals it has.
    """
    close = F.coalesce(F.col(end), F.lit(OPEN_END).cast("date"))
    days = df.groupBy(entity, start).agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce(F.col(end) < F.col(start), F.lit(False))).alias("_turned"), F.count_if(F.coalesce(close >= F.col(start), F.lit(False))).alias("_lasting"),
        F.max_by(close, F.struct(F.col(tie), close)).alias("_last"),
    )
    w = Window.partitionBy(entity).orderBy(F.col(start).asc_nulls_last())
    same = F.col("_lasting") - (F.col("_last") >= F.col(start)).cast("long")
    before = F.coalesce((F.lag("_last").over(w) >= F.col(start)).cast("long"), F.lit(0))
    rows = days.withColumn("_overlaps", F.when(F.col(start).isNotNull(), same + before).otherwise(0))
    out = rows.groupBy(entity).agg(
        F.sum(F.when(F.col(start).isNull(), F.col("_n")).otherwise(0)).alias("start_missing"), F.sum("_turned").alias("end_before_start"), F.sum("_overlaps").alias("overlaps")
    )
    return out.where("start_missing + end_before_start + overlaps > 0")


def sweep(memberships: DataFrame, low: int = 1, high: int = 8) -> DataFrame:
    """W-2. (HouseholdKey, points, violations, peak): sizes of each household where they change.

    One up at a start, one down the day after an end; changes of one day are summed first; points with nobody are left out. A violation is a size outside low..high.

    Changes are summed by household and day before the shuffle, so the window over a household has a row for each day of the calendar at most, however many members come and go.
    """
    rows = memberships.where("HouseholdKey IS NOT NULL AND PersonKey IS NOT NULL AND MembershipStartDate IS NOT NULL")
    up = rows.select("HouseholdKey", F.col("MembershipStartDate").alias("day"), F.lit(1).alias("d"))
    down = rows.where("MembershipEndDate IS NOT NULL").select("HouseholdKey", F.date_add("MembershipEndDate", 1).alias("day"), F.lit(-1).alias("d"))
    changes = up.unionAll(down).groupBy("HouseholdKey", "day").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("HouseholdKey").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    points = changes.withColumn("size", F.sum("d").over(w)).where("size > 0")
    return points.groupBy("HouseholdKey").agg(
        F.count("*").alias("points"), F.sum((~F.col("size").between(low, high)).cast("long")).alias("violations"), F.max("size").cast("long").alias("peak")
    )


def peak_summary(swept: DataFrame) -> DataFrame:
    """A-25. (households, min_peak, mean_peak, max_peak)."""
    return swept.agg(F.count("*").alias("households"), F.min("peak").alias("min_peak"), F.bround(F.avg("peak"), 6).alias("mean_peak"), F.max("peak").alias("max_peak"))


def closed_history(changes: DataFrame, entity: str, value: str, since: str) -> DataFrame:
    """T-6. (entity, value, start, end): intervals from a log of changes; each ends the day before the next change to another value; the last is open.

    A change to the value that already holds starts nothing. Several changes of one day keep the last by `seq` if that column is there, else the greatest value.
    """
    order = F.col("seq") if "seq" in changes.columns else F.col(value)
    last = changes.groupBy(entity, since).agg(F.max_by(F.col(value), order).alias(value))
    w = Window.partitionBy(entity).orderBy(since)
    fresh = last.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before")))
    return fresh.select(entity, value, F.col(since).alias("start"), F.date_sub(F.lead(since).over(w), 1).alias("end"))
