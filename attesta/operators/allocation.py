"""Exact quotas, weighted draws, dense numbers and coverage (G-0, G-1, G-2, G-10, G-11, G-18..G-21, W-5, W-8)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hash_int, hash_unit
from ..sources.checkpoints import cut_lineage

#: Buckets of the order in which rows are numbered; each bucket is sorted by itself.
BUCKETS = 4096
#: Rows of a bucket, about: more buckets are made for more rows.
BUCKET_ROWS = 1 << 20


def normalised(values: Mapping[str, float | None], rescale: bool = True) -> dict[str, float]:
    """G-0. Percentages that sum to 100: nulls dropped, negatives and empty sums refused; rescaled unless that is off."""
    known = {k: float(v) for k, v in values.items() if v is not None}
    if any(v < 0 for v in known.values()):
        raise ValueError("a share is negative")
    total = sum(known.values())
    if total <= 0:
        raise ValueError("shares sum to nothing")
    if abs(total - 100) < 1e-9:
        return known
    if not rescale:
        raise ValueError(f"shares sum to {total}, not 100")
    return {k: v * 100 / total for k, v in known.items()}


def quotas(shares: DataFrame, n: int, seed: int) -> DataFrame:
    """G-1. (category, quota) from (category, share): floors of share * n over the sum, the largest remainders one more, ties by hash. Categories are few."""
    every = Window.partitionBy(F.lit(1))
    exact = shares.select("category", (F.col("share") / F.sum("share").over(every) * n).alias("x"))
    rest = F.lit(n) - F.sum(F.floor("x")).over(every)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("x") - F.floor("x")), hash_unit(seed, "quota", "category")))
    return exact.select("category", (F.floor("x") + (rank <= rest).cast("long")).alias("quota"))


def numbered(df: DataFrame, order: Sequence[Column], bucket: Column, name: str = "number") -> DataFrame:
    """df with numbers 0.. in an order, without sorting all rows in one task.

    bucket must rise with the order, as a prefix of it does. Rows are counted by bucket, the few counts become offsets, and each bucket is numbered by itself.
    """
    rows = df.withColumn("_bucket", bucket)
    offsets = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_place", place).join(F.broadcast(offsets.select("_bucket", "_before")), "_bucket").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_bucket", "_before", "_place")


def range_numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """df with numbers 0.. in any order, for keys whose spread is not known.

    Rows are dealt by ranges of the order, which Spark samples, and written, so that a row's range can't change between counting and numbering; ranges are then buckets of
    about equal size, whatever the keys look like.
    """
    places = {f"_o{k}": c for k, c in enumerate(order)}
    ranged = df.withColumns(places).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *places)
    dealt = cut_lineage(ranged.withColumn("_range", F.spark_partition_id().cast("long")))
    return numbered(dealt, [F.col(c) for c in places], F.col("_range"), name).drop("_range", *places)


def rank_buckets(n: int) -> int:
    """Buckets of a hash order of n rows: so many that none of them has much more than BUCKET_ROWS, however many rows there are. Their counts are what is broadcast."""
    return max(BUCKETS, 1 << max(0, math.ceil(n / BUCKET_ROWS) - 1).bit_length())


def hash_rank(df: DataFrame, key: str, seed: int, salt: str, name: str = "number", n: int | None = None) -> DataFrame:
    """df with each row's rank in the order of its hash, from 0. n: the number of rows, which is counted if it is not given; buckets follow it."""
    u = hash_unit(seed, salt, key)
    buckets = rank_buckets(df.count() if n is None else n)
    return numbered(df.withColumn("_u", u), [F.col("_u"), F.col(key)], F.floor(F.col("_u") * (buckets - 1)).cast("long"), name).drop("_u")


def assigned(df: DataFrame, key: str, shares: DataFrame, n: int, seed: int, salt: str = "category", name: str = "category") -> DataFrame:
    """W-6. df with a category for each row so that every category gets exactly its quota of the n rows: ranks by hash against cumulated quotas."""
    w = Window.partitionBy(F.lit(1)).orderBy("category")
    cuts = quotas(shares, n, seed).withColumn("hi", F.sum("quota").over(w)).withColumn("lo", F.col("hi") - F.col("quota"))
    table = cuts.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "category"))).alias("_cuts"))
    ranked = hash_rank(df, key, seed, salt, "_rank", n).crossJoin(F.broadcast(table))  # one row, an array of the categories
    hit = F.filter("_cuts", lambda c: (c["lo"] <= F.col("_rank")) & (F.col("_rank") < c["hi"]))
    return ranked.withColumn(name, F.try_element_at(hit, F.lit(1))["category"]).drop("_rank", "_cuts")


def alias_table(weights: Sequence[tuple[str, float]]) -> list[tuple[int, float, str, str]]:
    """Slots (slot, odds, own, other) for weighted draws in constant time (Walker's method): draw a slot, then own with these odds, else other."""
    some = [(v, w) for v, w in weights if w > 0]
    if not some:
        raise ValueError("no value has a positive weight")
    n, total = len(some), sum(w for _, w in some)
    odds = [w * n / total for _, w in some]
    other = list(range(n))
    low, high = [i for i in range(n) if odds[i] < 1], [i for i in range(n) if odds[i] >= 1]
    while low and high:
        i, j = low.pop(), high.pop()
        other[i] = j
        odds[j] -= 1 - odds[i]
        (low if odds[j] < 1 else high).append(j)
    return [(i, min(1.0, odds[i]) if other[i] != i else 1.0, some[i][0], some[other[i]][0]) for i in range(n)]


def weighted_draw(df: DataFrame, key: str, slots: DataFrame, n_slots: int, seed: int, salt: str, name: str) -> DataFrame:
    """G-2. df with a value drawn by weight for each row: an equal join on a slot, then one comparison. slots is an alias table as a DataFrame."""
    rows = df.withColumns({"slot": hash_int(seed, f"{salt}:slot", n_slots, key), "_u": hash_unit(seed, f"{salt}:side", key)})
    return rows.join(slots, "slot", "left").withColumn(name, F.when(F.col("_u") < F.col("odds"), F.col("own")).otherwise(F.col("other"))).drop("slot", "_u", "odds", "own", "other")


def slots_frame(spark: SparkSession, weights: Sequence[tuple[str, float]]) -> tuple[DataFrame, int]:
    rows = alias_table(weights)
    return spark.createDataFrame(rows, "slot long, odds double, own string, other string"), len(rows)


def balanced_counts(people: DataFrame, key: str, n_people: int, n_records: int, seed: int, least: int = 1, most: int = 10) -> DataFrame:
    """G-10. people with `records`: the least each, the rest dealt in rounds by hash rank, so counts differ by one at most."""
    if not least * n_people <= n_records <= most * n_people:
        raise ValueError("the number of records can't be reached")
    extra = n_records - least * n_people
    each, rest = divmod(extra, n_people) if n_people else (0, 0)
    return hash_rank(people, key, seed, "records", "_rank", n_people).withColumn("records", (F.lit(least + each) + (F.col("_rank") < rest).cast("long")).cast("long")).drop("_rank")


def heavy_tail_counts(people: DataFrame, key: str, n_people: int, n_records: int, seed: int, least: int = 1, most: int = 10, alpha: float = 1.3) -> DataFrame:
    """G-11. people with `records` that fall with the hash rank to the power -alpha, from least to most, and sum exactly to n_records.

    Counts follow the rank alone: a scale s gives at least j records more than the least to ranks below (s / j) ** (1 / alpha). So the sum for any scale is arithmetic, the scale is found by bisection
    without a look at the rows, and a row's count is how many of these few limits its rank is below. The last few records are dealt by another hash.
    """
    if not least * n_people <= n_records <= most * n_people:
        raise ValueError("the number of records can't be reached")

    def limits(s: float) -> list[int]:
        """For j = 1.., how many ranks get at least j more."""
        return [_ranks_reaching(s, j, alpha, n_people) for j in range(1, most - least + 1)]

    low, high = 0.0, float(most) * float(max(1, n_people)) ** alpha
    for _ in range(5):  # eight candidates a pass
        steps = [low + (high - low) * k / 9 for k in range(1, 9)]
        under = [k for k in range(8) if least * n_people + sum(limits(steps[k])) <= n_records]
        low, high = (steps[under[-1]] if under else low), (steps[under[-1] + 1] if under and under[-1] < 7 else high if under else steps[0])
    cuts = limits(low)
    more = sum((F.when(F.col("_rank") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    base = hash_rank(people, key, seed, "records", "_rank", n_people).withColumn("records", (F.lit(least) + more).cast("long")).drop("_rank")
    short, full = n_records - least * n_people - sum(cuts), (cuts[-1] if cuts else n_people)
    while short > 0:  # one more for those with room, in the order of another hash
        base = cut_lineage(base)
        room = base.where(F.col("records") < most)
        cut = first_rows(room, F.lit(0), hash_unit(seed, "room", key), key, short)
        given = F.col("records") < most
        if cut is not None:
            given = given & cut.holds(F.lit(0), hash_unit(seed, "room", key), F.col(key))
        base = base.withColumn("records", F.col("records") + given.cast("long"))
        if short <= n_people - full:
            break
        base = cut_lineage(base)
        short = n_records - base.agg(F.sum("records")).first()[0]
        full = base.where(F.col("records") >= most).count()
    return base


def _ranks_reaching(s: float, j: int, alpha: float, n: int) -> int:
    """How many of the ranks 0..n - 1 have (rank + 1) ** -alpha * s >= j. The inverse of the power is a first guess; the last step is the comparison itself."""
    reaches = lambda r: float(r) ** -alpha * s >= j
    r = min(n, max(0, int((s / j) ** (1 / alpha))))
    while r > 0 and not reaches(r):
        r -= 1
    while r < n and reaches(r + 1):
        r += 1
    return r


def expanded(df: DataFrame, count: str, name: str = "copy") -> DataFrame:
    """G-12. Each row as often as its count says, with a number from 1."""
    return df.where(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))


def records_summary(counts: DataFrame) -> DataFrame:
    """A-11. (records, entities): how many entities have how many records."""
    return counts.groupBy("records").agg(F.count("*").alias("entities"))


def coverage_targets(n: int, overlap_pct: float, a_pct: float, b_pct: float) -> tuple[int, int, int]:
    """(overlap, a, b): percentages of n rounded half to even; the overlap no more than either side and no less than the sides force."""
    a, b = round(a_pct * n / 100), round(b_pct * n / 100)
    return max(max(0, a + b - n), min(round(overlap_pct * n / 100), a, b)), a, b


def coverage(people: DataFrame, key: str, n: int, overlap_pct: float, a_pct: float, b_pct: float, seed: int) -> DataFrame:
    """G-18. people with booleans in_a and in_b: hash ranks up to the overlap are in both, the next in A alone, the next in B alone. One pass."""
    both, a, b = coverage_targets(n, overlap_pct, a_pct, b_pct)
    r = F.col("_rank")
    return hash_rank(people, key, seed, "coverage", "_rank", n).withColumns({"in_a": r < a, "in_b": (r < both) | ((r >= a) & (r < a + b - both))}).drop("_rank")


@dataclass(frozen=True)
class Cut:
    """The first rows of an order (level, hash, key): all of the levels below, and of one level those up to a hash and, among equal hashes, up to a key (null: none of those)."""

    level: int
    hash: float
    key: object

    def holds(self, level: Column, u: Column, key: Column) -> Column:
        edge = (u < F.lit(self.hash)) | ((u == F.lit(self.hash)) & F.coalesce(key <= F.lit(self.key), F.lit(False)))
        return (level < self.level) | ((level == self.level) & edge)


#: Bits of the hash by which rows are counted at once; rows among which the cut is looked up by themselves.
CUT_BITS, CUT_ROWS = 16, 1024


def first_rows(df: DataFrame, level: Column, u: Column, key: str, n: int) -> Cut | None:
    """The cut before which stand exactly n rows of df (None: there are no more than n).

    Rows are counted by level and the first bits of the hash; the bucket where n is reached is counted by further bits, until it has so few rows that these are looked at. That is one scan for each
    factor of 65,536 in the number of rows, without a shuffle but of counts; where n ends with a bucket, its border is the cut.
    """
    if n <= 0:
        return Cut(-(1 << 31), 0.0, None)
    rows = df.select(level.cast("int").alias("l"), u.alias("u"), F.col(key).alias("k"))
    at, depth, left = None, 1, n
    while True:
        bucket = F.floor(F.col("u") * float(1 << CUT_BITS * depth)).cast("long")
        inside = rows if at is None else rows.where((F.col("l") == at[0]) & (F.floor(F.col("u") * float(1 << CUT_BITS * (depth - 1))).cast("long") == at[1]))
        counts = sorted(((r.l, r.b), r.n) for r in inside.groupBy("l", bucket.alias("b")).agg(F.count("*").alias("n")).collect())  # levels times 65,536 at most
        for at, size in counts:  # noqa: B007
            if size >= left:
                break
            left -= size
        else:
            return None
        if size == left:
            return Cut(at[0], (at[1] + 1) / float(1 << CUT_BITS * depth), None)
        if size <= CUT_ROWS or CUT_BITS * (depth + 1) > 52:
            break
        depth += 1
    edge = rows.where((F.col("l") == at[0]) & (bucket == at[1])).select("u", "k").orderBy("u", "k").limit(left).collect()[-1]
    return Cut(at[0], edge.u, edge.k)


def nway_coverage(people: DataFrame, key: str, n: int, overlap_pct: float, appear_pct: Sequence[float], seed: int, sizes: Sequence[int] | None = None) -> DataFrame:
    """G-20, W-8. people with in_0, in_1, ...: a common overlap, then each dataset fills up with those assigned least often so far, by hash among equals.

    sizes: how many people each dataset takes, by default its percentage of n. Each dataset is a cut in the order (times assigned, hash): counts find it, and the columns are comparisons with the cuts, so people
    are neither numbered nor written nor shuffled, however many datasets there are.
    """
    sizes = [round(p * n / 100) for p in appear_pct] if sizes is None else list(sizes)
    both = min([round(overlap_pct * n / 100), *sizes])
    hashes = {"_u": hash_unit(seed, "overlap", key)} | {f"_u{k}": hash_unit(seed, f"fill:{k}", key) for k in range(len(sizes))}

    rows, kind = people.withColumns(hashes), people.schema[key].dataType
    first = first_rows(rows, F.lit(0), F.col("_u"), key, both)
    common = F.lit(True) if first is None else first.holds(F.lit(0), F.col("_u"), F.col(key))
    cuts: list[Cut] = []

    def filled() -> Column:
        """(times, flags) after the cuts so far: a fold over datasets, which keeps the expression as small as their number."""
        begun = F.struct(F.when(common, -1).otherwise(0).alias("times"), F.array().cast("array<boolean>").alias("flags"))

        def take(now: Column, x: Column) -> Column:
            t = now["times"]
            chosen = (t < x["level"]) | ((t == x["level"]) & ((x["u"] < x["hash"]) | ((x["u"] == x["hash"]) & F.coalesce(F.col(key) <= x["key"], F.lit(False)))))
            return F.struct(F.when(t < 0, t).otherwise(t + chosen.cast("int")).alias("times"), F.concat(now["flags"], F.array(chosen)).alias("flags"))

        steps = [F.struct(F.lit(c.level).alias("level"), F.lit(c.hash).alias("hash"), F.lit(c.key).cast(kind).alias("key"), F.col(f"_u{k}").alias("u")) for k, c in enumerate(cuts)]
        return F.aggregate(F.array(*steps), begun, take) if steps else begun

    for k, size in enumerate(sizes):
        so_far = rows.select(key, f"_u{k}", filled()["times"].alias("_times"))
        cuts.append(first_rows(so_far, F.col("_times"), F.col(f"_u{k}"), key, size) or Cut((1 << 31) - 1, 0.0, None))
    out = rows.withColumn("_filled", filled())
    return out.select(*people.columns, *[F.coalesce(F.col("_filled.flags")[k], F.lit(False)).alias(f"in_{k}") for k in range(len(sizes))])


def group_sizes(targets: DataFrame, keys: Sequence[str], seed: int, salt: str, low: int, high: int, first: int = 0) -> DataFrame:
    """(keys, g, first, size): groups of `target` places in a row, for each row of targets (keys, target long). Sizes are drawn by hash from low to high; the first has `first`, if that is given.

    What is left at the end is a group if it has `low` places; a single place left over joins the last group if that has room. Sizes become places by sums over blocks of groups,
    so any number of groups of one key stays distributed.
    """
    width = 4096
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / low / width)))
    numbers = F.explode(F.sequence(F.col("b") * width, F.least((F.col("b") + 1) * width - 1, F.floor(F.col("target") / low).cast("long"))))
    draw = (F.lit(low) + hash_int(seed, f"{salt}:size", high - low + 1, *keys, "g")).cast("long")
    spread = targets.where(F.col("target") >= low).withColumn("b", block)
    drawn = spread.repartition(*keys, "b").withColumn("g", numbers).withColumn("size", F.when(F.col("g") == 0, F.lit(first).cast("long")).otherwise(draw) if first else draw)
    by = [*keys, "b"]
    before = F.sum("n").over(Window.partitionBy(*keys or [F.lit(1)]).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sums = drawn.groupBy(*by).agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    placed = drawn.withColumn("_end", F.sum("size").over(Window.partitionBy(*by).orderBy("g"))).join(sums, by).withColumn("first", F.col("before") + F.col("_end") - F.col("size"))
    left = F.col("target") - F.col("first") - F.col("size")
    fitted = F.when((left == 1) & (F.col("size") < high), F.col("size") + 1).when(left < 0, F.col("target") - F.col("first")).otherwise(F.col("size"))
    return placed.where(F.col("first") < F.col("target")).select(*keys, "g", "first", fitted.alias("size")).where(F.col("size") >= low)


def duplication(people: DataFrame, key: str, n: int, duplicate_pct: float, seed: int, forced: Column | None = None, n_forced: int = 0) -> DataFrame:
    """G-21. people with `records`: one each, two where forced, and extras dealt with replacement until duplicate_pct of n are extra.

    Each extra draws the hash rank of a person; draws are counted and joined back, so extras cost rows only for themselves.
    """
    extras = max(0, round(duplicate_pct * n / 100) - n_forced)
    base = people.withColumn("records", F.lit(1) + (F.when(forced, 1).otherwise(0) if forced is not None else F.lit(0))).select(*people.columns, "records")
    if not extras or not n:
        return base.withColumn("records", F.col("records").cast("long"))
    spark = people.sparkSession
    draws = spark.range(extras).select(hash_int(seed, "extra", n, "id").alias("_rank")).groupBy("_rank").agg(F.count("*").alias("_extra"))
    return hash_rank(base, key, seed, "extras", "_rank", n).join(draws, "_rank", "left").withColumn("records", (F.col("records") + F.coalesce("_extra", F.lit(0))).cast("long")).drop("_rank", "_extra")
