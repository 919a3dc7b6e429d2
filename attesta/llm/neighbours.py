"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, mix, small_batches
from .embeddings import matrix, usable

#: Tables, the slots' width on vectors of length one, and the numbers of hashes a table may have.
TABLES, WIDTH, HASHES = 8, 2.5, (4, 6, 8, 10, 12, 14, 16, 20, 24)
#: The recall to expect of a query, below which it is asked again of all rows; the share of queries that this may happen to, where probes can help it; so many
#: sampled queries, with their true nearest of all rows, and sampled rows, for the sizes of buckets, choose hashes and probes.
RECALL, AGAIN, SAMPLE_QUERIES, SAMPLE_ROWS = 0.9, 0.25, 96, 8192
#: Probes of one table at most.
PROBES = 1024
#: Rows are searched in ranges of norms, each at most an octave wide; bins of an octave that ranges are made of; the share of the rows up to which a range is compared without an index.
BINS, SMALL = 16, 1 / 64
#: Numbers in the vectors of one task's rows, and queries of one task.
CELLS, QUERIES = 1 << 22, 2048
#: Candidates that are looked at together.
CHUNK = 1 << 17
SEED = 20240301


@lru_cache(maxsize=16)
def sequence(hashes: int, probes: int) -> np.ndarray:
    """The perturbations of a bucket in the order of estimated success, as rows of 0 and 1 over the ranks of its 2 * hashes nearest borders.

    The nearest border has rank 0. A perturbation crosses the borders of its ranks, at most one of the two borders of each hash; its score is the sum of the
    expected squared distances of those ranks. The heap makes sets of ranks by rising score: the last rank moves on, or the next one joins.
    """
    m, j = hashes, np.arange(1, 2 * hashes + 1, dtype=float)
    far = 2 * m + 1 - j
    expected = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - far / (m + 1) + far * (far + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(expected[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*ranks, last + 1)))
    table = np.zeros((len(out), 2 * m), np.float32)
    for k, ranks in enumerate(out):
        table[k, list(ranks)] = 1
    return table


@dataclass(frozen=True)
class Index:
    """p-stable hash functions for inner products in one dimension: vectors get one more coordinate that brings them all to the norm `top`, so that the nearest by distance has the largest product.

    A bucket's key is a hash of its slots; the first `prefix` of them make its shard, so that perturbed buckets are mostly in the same shard.
    """

    dim: int
    top: float
    hashes: int
    probes: int = 1
    prefix: int = 0

    def places(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        """Hash values before rounding down. A query is brought to the same norm without the extra coordinate."""
        rng = np.random.default_rng([SEED, self.dim, self.hashes, table])
        a, b = rng.normal(size=(self.dim + 1, self.hashes)), rng.uniform(0, 1, size=self.hashes)
        x = x / (self.top or 1.0)
        square = np.einsum("nd,nd->n", x, x)
        if query:
            x, rest = x / np.sqrt(square)[:, None], np.zeros(len(x))
        else:
            rest = np.sqrt(np.maximum(0, 1 - square))
        return (x @ a[:-1] + rest[:, None] * a[-1]) / WIDTH + b

    def keys(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) of buckets, whose slots are along the last axis."""
        h = np.zeros(slots.shape[:-1], np.uint64)
        shard = h
        for j in range(slots.shape[-1]):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + slots[..., j].astype(np.int64).view(np.uint64) + np.uint64(1))
            if j + 1 == self.prefix:
                shard = h
        return shard.view(np.int64), h.view(np.int64)

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        return self.keys(np.floor(self.places(x, table, False)))

    def borders(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of queries, and (query, rank, hash) with the step that crosses the border of that rank."""
        at = self.places(x, table, True)
        own = np.floor(at)
        gap = np.concatenate([at - own, 1 - (at - own)], axis=1)
        order = np.argsort(gap, axis=1, kind="stable")
        steps = np.zeros((len(x), 2 * self.hashes, self.hashes), np.float32)
        n, r = np.indices(order.shape)
        steps[n, r, order % self.hashes] = np.where(order < self.hashes, -1, 1)
        return own, steps

    def distance(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from each query the rows of this score are, by the vectors that are hashed."""
        return np.sqrt(np.clip(2 - 2 * score / (np.linalg.norm(x, axis=1) * (self.top or 1.0)), 1e-12, 4))

    def odds(self, x: np.ndarray, far: np.ndarray, table: int) -> np.ndarray:
        """The chance of each probe of each query to visit the bucket of a row so far away: on random directions their places differ by a normal number."""
        at = self.places(x, table, True)
        gap = at - np.floor(at)
        edges = (np.arange(-1, 3) - gap[:, :, None]) * WIDTH / far[:, None, None]
        chance = np.maximum(np.diff(_normal(edges), axis=2), 1e-300)
        order = np.argsort(np.concatenate([gap, 1 - gap], axis=1), axis=1, kind="stable")
        side = np.log(np.concatenate([chance[:, :, 0], chance[:, :, 2]], axis=1)) - np.tile(np.log(chance[:, :, 1]), 2)
        return np.exp(np.log(chance[:, :, 1]).sum(axis=1)[:, None] + np.take_along_axis(side, order, axis=1) @ sequence(self.hashes, self.probes).T)

    def expected(self, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The mean chance that some table shows rows of these scores (queries by scores), after each probe; an array of queries by probes."""
        shown = 0.0
        for score in scores.T:
            missed, far = 1.0, self.distance(x, score)
            for table in range(TABLES):
                missed = missed * (1 - np.minimum(1, np.cumsum(self.odds(x, far, table), axis=1)))
            shown = shown + (1 - missed) / scores.shape[1]
        return shown

    def probed(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, key) of the buckets that each query visits, in order; arrays of queries by probes."""
        own, steps = self.borders(x, table)
        return self.keys(own[:, None, :] + sequence(self.hashes, self.probes) @ steps)


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.array([math.erf(v) for v in (z / math.sqrt(2)).ravel()]).reshape(z.shape)


def marks(k: int) -> list[int]:
    """The ranks whose scores stand for all k: each for those above it, so that the recall to expect is not less than they tell."""
    return sorted({math.ceil(k * j / 4) for j in range(1, 5)})


def fitted(dim: int, top: float, n: int, queries: np.ndarray, near: list[np.ndarray], sample: np.ndarray, least: np.ndarray | None = None) -> Index:
    """The index with the least work: probes, candidates as the sampled rows tell the sizes of buckets, and all rows for each query that is asked again.

    near[i] are the true nearest vectors of query i, least[i] the score that matters to it at least, if that is known. Of hashes and probes that leave at most AGAIN of the
    sampled queries below RECALL the cheapest are taken; where none do, those that leave the fewest. What is left is asked again, so results don't hang on the sample.
    """
    some = [i for i, x in enumerate(near) if len(x)]
    queries = queries[some]
    ranked = [np.sort(near[i] @ q)[::-1] for i, q in zip(some, queries, strict=True)]
    scores = np.array([[r[math.ceil(len(r) * j / 4) - 1] for j in range(1, 5)] for r in ranked])
    if least is not None and some:
        scores = np.fmax(scores, least[some][:, None])
    best, rank = Index(dim, top, HASHES[0], 1), (True, math.inf)
    for hashes in HASHES if some else ():
        index = Index(dim, top, hashes, PROBES)
        again = (index.expected(queries, scores) < RECALL).mean(axis=0)
        sizes = np.zeros((len(queries), len(again)))
        for table in range(TABLES):
            held, count = np.unique(index.buckets(sample, table)[1], return_counts=True)
            keys = index.probed(queries, table)[1]
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            sizes += np.where(held[at] == keys, count[at], 0)
        work = TABLES * np.arange(1, len(again) + 1) + sizes.cumsum(axis=1).mean(axis=0) * n / len(sample) + again * n
        over = again > AGAIN
        at = int(np.lexsort((work, np.where(over, again, 0), over))[0])
        if (mine := (bool(over[at]), float(again[at] if over[at] else work[at]))) < rank:
            best, rank = Index(dim, top, hashes, at + 1), mine
    limit, prefix = rows_of_task(dim), 0
    while n > limit and prefix < best.hashes:
        prefix += 1
        _, count = np.unique(Index(dim, top, best.hashes, best.probes, prefix).buckets(sample, 0)[0], return_counts=True)
        if n * ((count / len(sample)) ** 2).sum() <= limit:
            break
    return Index(dim, top, best.hashes, best.probes, prefix)


def rows_of_task(dim: int) -> int:
    return max(256, CELLS // max(1, dim))


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of different ids, ties to the smaller id."""
    size = 2 * k
    while True:
        if len(scores) > size:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - size)[len(scores) - size])
        else:
            some = np.arange(len(scores))
        some = some[np.lexsort((ids[some], -scores[some]))]
        _, at = np.unique(ids[some], return_index=True)
        if len(at) >= k or len(some) == len(scores):
            return some[np.sort(at)][:k]
        size *= 4


_FOUND = "query_id long, id long, score double"


def _table(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    ids = [np.full(len(i), q, np.int64) for q, i, _ in parts]
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.table({"query_id": join(ids, np.int64), "id": join([i for _, i, _ in parts], np.int64), "score": join([s for _, _, s in parts], float)})


def _merged(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query among the rows in the buckets that it probes; every candidate is scored exactly."""
    if not left.num_rows or not right.num_rows:
        return _table([])
    keys = left.column("key").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, ids, x = keys[order], left.column("id").to_numpy()[order], matrix(left.column("vec"))[order]
    asking, q = right.column("id").to_numpy(), matrix(right.column("vec"))
    lists = right.column("keys").combine_chunks()
    sizes, probes = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    low = np.searchsorted(keys, probes, "left")
    count = np.searchsorted(keys, probes, "right") - low
    ends = np.cumsum(sizes)
    total = np.add.reduceat(np.append(count, 0), ends - sizes) * (sizes > 0)
    parts, at = [], 0
    while at < len(q):
        to = at + 1
        while to < len(q) and total[at:to + 1].sum() <= CHUNK:
            to += 1
        a, b = ends[at] - sizes[at], ends[to - 1]
        own = count[a:b]
        rows = np.repeat(low[a:b] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        edge = 0
        for i in range(at, to):
            mine = rows[edge:edge + total[i]]
            edge += total[i]
            mine = mine[ids[mine] != asking[i]]
            if len(mine):
                scores = (x[mine] * q[i]).sum(axis=1)  # summed row by row, so that equal vectors have equal scores in every task
                best = _nearest(ids[mine], scores, k)
                parts.append((asking[i], ids[mine][best], scores[best]))
        at = to
    return _table(parts)


def _compared(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query among all rows of a block."""
    if not left.num_rows or not right.num_rows:
        return _table([])
    ids, x = left.column("id").to_numpy(), matrix(left.column("vec"))
    asking, q = right.column("id").to_numpy(), matrix(right.column("vec"))
    parts = []
    for i in range(len(q)):
        other = ids != asking[i]
        rough = x @ q[i]  # may round otherwise than the sum that counts, so a little below its k-th largest is looked at too
        limit = np.partition(rough[other], -2 * k)[-2 * k] if other.sum() > 2 * k else -np.inf
        slack = 1e-9 * (1 + np.abs(rough).max())
        mine = np.flatnonzero(other & (rough >= limit - slack))
        scores = (x[mine] * q[i]).sum(axis=1)
        best = _nearest(ids[mine], scores, k)
        if len(best) < k and len(mine) < other.sum():  # ids that repeat fill the places: look at all
            mine = np.flatnonzero(other)
            scores = (x[mine] * q[i]).sum(axis=1)
            best = _nearest(ids[mine], scores, k)
        if len(best):
            parts.append((asking[i], ids[mine][best], scores[best]))
    return _table(parts)


class _Searcher:
    """Search among the rows of one dimension and range of norms. asked has the score that each query's k-th so far has, or null, in `kth`."""

    def __init__(self, rows: DataFrame, asked: DataFrame, dim: int, n: int, top: float, k: int, ws: Workspace, name: str) -> None:
        self.rows, self.asked, self.dim, self.n, self.top, self.k, self.ws, self.name = rows, asked, dim, n, top, k, ws, name

    def sampled(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """A bounded sample of queries with their true nearest vectors of all rows, one of rows, and the scores that matter to the queries at least."""
        drawn = lambda df, m: df.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(m).toArrow()  # noqa: E731  # m rows at most
        some = drawn(self.asked.select("id", "vec", "kth"), SAMPLE_QUERIES)
        own, queries, k = some.column("id").to_numpy(), matrix(some.column("vec")) if some.num_rows else np.zeros((0, self.dim)), self.k

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [(np.zeros(0), np.zeros((0, queries.shape[1]))) for _ in own]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column("id").to_numpy(), matrix(batch.column("vec"))
                scores = queries @ x.T
                for i, mine in enumerate(own):
                    s = np.where(ids == mine, -np.inf, scores[i])
                    best = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                    s, v = np.concatenate([kept[i][0], s[best]]), np.concatenate([kept[i][1], x[best]])
                    top = np.argsort(-s, kind="stable")[:k]
                    kept[i] = (s[top], v[top])
            for i, (s, v) in enumerate(kept):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int32()), pa.array(s), pa.array(v.tolist(), pa.list_(pa.float64()))], ["q", "score", "vec"])

        found = self.rows.select("id", "vec").mapInArrow(scan, "q int, score double, vec array<double>").where("score > double('-infinity')")
        top = found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rn") <= k).toArrow()  # k rows of each sampled query
        q, vec = top.column("q").to_numpy(), top.column("vec")
        v = matrix(vec) if top.num_rows else np.zeros((0, self.dim))
        share = min(1.0, 2 * SAMPLE_ROWS / self.n)
        part = self.rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("vec").limit(SAMPLE_ROWS).toArrow()
        least = np.array([np.nan if x is None else x for x in some.column("kth").to_pylist()], float)
        return queries, [v[q == i] for i in range(len(own))], matrix(part.column("vec")) if part.num_rows else np.zeros((1, self.dim)), least

    def best(self, found: DataFrame) -> DataFrame:
        """The k nearest of what all tables or blocks found, each row once."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # the group limit keeps k of each query before the shuffle
        once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query_id", "rank", "id", "score")

    def probed(self, index: Index) -> DataFrame:
        """Rows join queries on table and bucket, in tasks of one shard of a table."""
        k, tables = self.k, range(TABLES)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("vec"))
                    for t in tables:
                        shard, key = index.buckets(x, t)
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(shard), pa.array(key), batch.column("id"), batch.column("vec")], ["t", "shard", "key", "id", "vec"])

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    x = matrix(part.column("vec"))
                    for t in tables:
                        shard, key = index.probed(x, t)
                        row = np.repeat(np.arange(len(x)), shard.shape[1])
                        shard, key = shard.ravel(), key.ravel()
                        order = np.lexsort((np.arange(len(row)), shard, row))
                        row, shard, key = row[order], shard[order], key[order]
                        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(key))
                        of = pa.array(row[first])
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(first), pa.int32()), pa.array(shard[first]), lists, part.column("id").take(of), part.column("vec").take(of)], ["t", "shard", "keys", "id", "vec"])

        left = self.rows.select("id", "vec").mapInArrow(placed, "t int, shard long, key long, id long, vec array<double>")
        right = self.ws.save(self.asked.select("id", "vec").mapInArrow(asked, "t int, shard long, keys array<long>, id long, vec array<double>"), f"probes{self.name}")
        held = left.groupBy("t", "shard").agg(F.count("*").alias("n"))
        wanted = right.groupBy("t", "shard").agg(F.count("*").alias("m"))
        parts = lambda c, size: F.ceil(F.col(c) / size).cast("long")
        sizes = self.ws.save(held.join(wanted, ["t", "shard"]).select("t", "shard", parts("n", rows_of_task(self.dim)).alias("a"), parts("m", QUERIES).alias("b")), f"shards{self.name}")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each part of a shard's rows meets each part of its queries, so neither side of a task grows."""
            out = df.join(sizes, ["t", "shard"]).withColumn(f"_{own}", F.pmod(F.xxhash64("id"), F.col(own)))
            return out.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("a", "b")

        keys = ["t", "shard", "_a", "_b"]
        pairs = dealt(left, "a", "b").groupBy(*keys).cogroup(dealt(right, "b", "a").groupBy(*keys))
        return self.best(pairs.applyInArrow(lambda x, y: _merged(x, y, k), _FOUND))

    def compared(self, asked: DataFrame, n_asked: int) -> DataFrame:
        """All rows in blocks against these queries in blocks."""
        a, b, k = math.ceil(self.n / rows_of_task(self.dim)), math.ceil(n_asked / QUERIES), self.k

        def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            out = df.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_own)).alias(own))
            return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

        pairs = dealt(self.rows, "_a", a, "_b", b).groupBy("_a", "_b").cogroup(dealt(asked, "_b", b, "_a", a).groupBy("_a", "_b"))
        return self.best(pairs.applyInArrow(lambda x, y: _compared(x, y, k), _FOUND))

    def unsure(self, index: Index, found: DataFrame) -> DataFrame:
        """Queries that the tables may have shown too little: with fewer than k results, or with an expected recall below RECALL.

        The true result of a rank is at least as near as the found one, so the chance to have met it is at least that of a row as far away as the found one.
        """
        at = [f"s{r}" for r in marks(self.k)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 128):
                    part = batch.slice(start, 128)
                    scores = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in at])  # null is not a number
                    with np.errstate(all="ignore"):  # norms that overflow or vanish have no chance that is a number
                        sure = index.expected(matrix(part.column("vec")), scores)[:, -1] >= RECALL
                    yield part.select(["id", "vec"]).filter(pa.array(~sure))

        scores = found.groupBy(F.col("query_id").alias("id")).agg(*[F.max(F.when(F.col("rank") == r, F.col("score"))).alias(f"s{r}") for r in marks(self.k)])
        return self.asked.select("id", "vec").join(scores, "id", "left").mapInArrow(run, "id long, vec array<double>")

    def search(self, found: DataFrame | None, small: bool) -> DataFrame:
        """What is found so far, joined by what these rows hold. A small range is compared as it is."""
        joined = lambda new: self.best(new if found is None else new.unionByName(found.select(*new.columns)))
        if small:
            return joined(self.compared(self.asked, self.asked.count()).select("query_id", "id", "score"))
        index = fitted(self.dim, self.top, self.n, *self.sampled())
        probed = self.ws.save(joined(self.probed(index).select("query_id", "id", "score")), f"probed{self.name}")
        short = self.ws.save(self.unsure(index, probed), f"short{self.name}")
        if not (n_short := short.count()):
            return probed
        again = self.compared(short, n_short)
        return self.best(probed.unionByName(again).select("query_id", "id", "score"))


def with_kth(asked: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """Queries with the score of their k-th result in `kth`; null if they have fewer."""
    if found is None:
        return asked.withColumn("kth", F.lit(None).cast("double"))
    return asked.drop("kth").join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth")), "id", "left")


def ranges_of(bins: list[tuple[int, int, float]]) -> list[tuple[int, int, int, float]]:
    """(first bin, last bin, rows, largest norm) of ranges from the largest norm down, none wider than an octave; bins are (bin, rows, largest norm)."""
    out: list[tuple[int, int, int, float]] = []
    for b, n, top in sorted(bins, reverse=True):
        if out and out[-1][1] - b < BINS:
            _, last, rows, high = out[-1]
            out[-1] = (b, last, rows + n, max(high, top))
        else:
            out.append((b, b, n, top))
    return out


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k nearest rows of table by inner product in double precision, but for the query's own id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id. Vectors of each length are searched by themselves, as
    others have no inner product with them. Ties go to the smaller id. Rows that repeat an id are one result, the nearest of them; queries that repeat an id are one query with
    what either finds. Fewer candidates than k give fewer rows; empty tables none. Other columns are not read.

    Rows are searched in ranges of norms, the longest first; a query is done when even the longest vector of the next range can't reach its k-th result. In a range every row is indexed in
    every table. Queries and rows meet by an equi-join on table and bucket: a task has one shard of a table, in parts of a bounded size if many rows or queries share it. A query visits
    perturbed buckets in the order of estimated success; what the tables find is merged, scored exactly, and k of each query stay. The recall to expect of each query
    follows from its own place between the borders and from how near its results are; queries below RECALL are asked again, of all rows of the range in blocks. So recall holds for each kind of
    query, strays beside clusters too, not in the mean alone. Ranges with less than a 64th of the rows are compared in blocks.
    """
    spark = table.sparkSession
    ws = Workspace(spark, "neighbours")

    def clean(df: DataFrame) -> DataFrame:
        vec = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))

    out = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    with small_batches(spark):
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        rows, asked = ws.save(clean(table).withColumn("norm", norm), "rows"), ws.save(clean(queries).withColumn("norm", norm), "queries")
        level = F.when(F.col("norm") == float("inf"), 1 << 20).when(F.col("norm") == 0, -(1 << 20)).otherwise(F.floor(F.log2("norm") * BINS)).cast("int")
        rows = rows.withColumn("bin", level)
        levels = rows.groupBy("dim", "bin").agg(F.count("*").alias("n"), F.max("norm").alias("top")).join(asked.select("dim").distinct(), "dim").orderBy("dim", "bin").collect()  # bins of doubles, for each length
        bins: dict[int, list[tuple[int, int, float]]] = {}
        for r in levels:
            bins.setdefault(r.dim, []).append((r.bin, r.n, r.top))
        parts = []
        for dim, own in bins.items():
            found, mine, total = None, asked.where(F.col("dim") == dim), sum(n for _, n, _ in own)
            for j, (low, high, n, top) in enumerate(ranges_of(own)):
                open_ = with_kth(mine, found, k)
                open_ = ws.save(open_.where(F.col("kth").isNull() | F.isnan("kth") | ~(F.col("kth") > F.col("norm") * top * (1 + 1e-9))), f"open{dim}_{j}")
                if open_.isEmpty():
                    break
                here = rows.where((F.col("dim") == dim) & F.col("bin").between(low, high))
                found = ws.save(_Searcher(here, open_, dim, n, top, k, ws, f"{dim}_{j}").search(found, n < SMALL * total or abs(high) == 1 << 20), f"found{dim}_{j}")
            parts.append(found)
        for found in parts:
            out = found if len(parts) == 1 else out.unionByName(found)
    return out.select("query_id", "rank", "id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20 among all others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.where("vec_id % 20 = 0")).withColumnRenamed("id", "vec_id")
