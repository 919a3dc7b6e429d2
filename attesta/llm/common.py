"""Shared pieces of the training-data operators: workspaces, Arrow batch sizes, word hashing and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import Workspace, shared_root

#: Rows and bytes of one Arrow batch handed to Python; texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound what one Arrow batch holds, so that long texts can't fill a Python worker, in jobs that run inside; the session's own settings come back after."""
    new = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the size of the cluster's job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name like this one that none of the taken ones is, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a column's texts. Numbers of shards follow it, so that what one task holds doesn't grow with the input."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")).cast("long")), F.lit(0))).first()[0]


# ---------------------------------------------------------------- words as 64-bit hashes, a batch at a time


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in the ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words that white space ends: all but 0x20 and 0x09-0x0D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of letters, digits and everything beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes hashed at once. The powers for them take twice 8 times as much memory.
_CHUNK = 2 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finaliser of the SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        _powers[:] = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def hash_words(texts: list[str | None], member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z lower-cased), in order, and each text's number of words. Null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    counts, hashes = np.zeros(len(raw), np.int64), []
    at = 0
    while at < len(raw):
        size, end = 0, at
        while end < len(raw) and (end == at or size + len(raw[end]) + 1 <= _CHUNK):
            size += len(raw[end]) + 1
            end += 1
        h, starts = _hash_buffer(b"\n".join(raw[at:end]) + b"\n", member)
        edges = np.cumsum([0] + [len(x) + 1 for x in raw[at:end]])
        counts[at:end] = np.diff(np.searchsorted(starts, edges))
        hashes.append(h)
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _hash_buffer(data: bytes, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the words in a buffer that ends with a separator, and where they start."""
    a = np.frombuffer(data, np.uint8)
    inside = member[a].astype(np.int8)
    step = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches with the texts of their column "text", in parts of a bounded number of rows and bytes, whatever the session makes a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + BATCH_ROWS, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
            part = batch.slice(at, to - at)
            yield part, part.column("text").to_pylist()
            at = to


# ---------------------------------------------------------------- components


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component): for every node of edges (u, v: long, not null) the smallest node it reaches.

    Alternates the large-star and small-star steps, each a min-aggregation and a join, until the edges are stars. Every
    round is written to the shared folder; nothing is collected but two numbers. A node that nearly all edges share is a hot join key,
    which the adaptive skew join splits; its minimum is combined before the shuffle.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("hi > lo").groupBy("hi", "lo").agg(F.lit(1).alias("_")).select("hi", "lo")

    now = ws.save(distinct(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))), "edges0")
    before, k = None, 0
    while True:
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(now.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = distinct(both.where("b > a").join(lowest, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")))
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(first.select("hi", F.col("m").alias("lo")))
        k += 1
        new = ws.save(distinct(small), f"edges{k}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        ws.drop(f"edges{k - 1}")
        now = new
        if state == before:
            break
        before = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


__all__ = [
    "BATCH_BYTES", "BATCH_ROWS", "NOT_SPACE", "WORD", "Workspace", "byte_class", "connected_components", "fresh", "hash_words", "local_components", "mix", "partitions", "shared_root", "small_batches", "text_batches", "text_bytes",
]
