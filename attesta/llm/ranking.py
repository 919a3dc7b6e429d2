"""Ranked lexical search: compressed postings sorted by document, in shards that are merged a document at a time."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappush, heapreplace, merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, small_batches, text_batches

#: Terms with repeats that a shard of the index holds at most, but for a longer document.
SHARD_TERMS = 1 << 22
#: Pairs of a query and a term that are searched together; each block of queries reads its own terms' postings.
BLOCK_PAIRS = 1 << 16
#: Documents of a shard whose bounds are known together.
WINDOW = 512
#: Results of a query.
TOP = 50

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "shard string, term string, df long, total long, data binary, more binary"


def terms_of(text: str | None) -> list[bytes]:
    """A text's terms, with repeats. Null has none."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


# ---------------------------------------------------------------- postings


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in groups of seven bits, the last one of each without the high bit: the bytes, and where each number ends."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 10):
        sizes += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out, starts = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8), ends - sizes
    for k in range(int(sizes.max(initial=0))):
        some = sizes > k
        out[starts[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((sizes[some] > k + 1).astype(np.uint8) << 7)
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of packed bytes."""
    last = np.flatnonzero(data < 128)
    starts = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - starts).max(initial=-1)) + 1):
        some = last - starts >= k
        out[some] |= (data[starts[some] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.astype(np.int64)


class _Numbers(dict):
    """Numbers of terms, in the order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _shard(name: str, ids: list[int | None], texts: list[array], terms: list[bytes]) -> pa.RecordBatch:
    """A shard's rows: one with its documents' ids (nulls last) and lengths, and one for each term with gaps between documents and occurrences in turn."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([np.frombuffer(t, np.uintc) for t in texts]).astype(np.int64)
    pairs, tf = np.unique(flat << 32 | np.repeat(place, sizes), return_counts=True)
    term, doc = pairs >> 32, pairs & 0xFFFFFFFF
    first = np.flatnonzero(np.diff(term, prepend=-1))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    data, ends = packed(np.column_stack([gaps, tf]).ravel())
    df = np.diff(np.append(first, len(term)))
    cuts = np.append(0, ends[np.append(first[1:], len(term)) * 2 - 1]).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
    known = np.array([ids[k] for k in order if ids[k] is not None], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * (len(terms) + 1), pa.string()),
            pa.array([None, *terms], pa.binary()).cast(pa.string()),
            pa.array(np.append(len(ids), df)),
            pa.array(np.append(int(sizes.sum()), np.add.reduceat(tf, first) if len(tf) else [])),
            pa.concat_arrays([pa.array([known.tobytes()], pa.binary()), rows]),
            pa.array([sizes[order].tobytes()] + [None] * len(terms), pa.binary()),
        ],
        ["shard", "term", "df", "total", "data", "more"],
    )


def _indexed(limit: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, total = TaskContext.get().partitionId(), 0, 0
        numbers, ids, texts = _Numbers(), [], []
        for batch, own in text_batches(batches):
            for id_, text in zip(batch.column("id").to_pylist(), own, strict=True):
                found = array("I", map(numbers.__getitem__, terms_of(text)))
                if not found:
                    continue
                ids.append(id_)
                texts.append(found)
                total += len(found)
                if total >= limit:
                    yield _shard(f"{task}.{k}", ids, texts, list(numbers))
                    k, total, numbers, ids, texts = k + 1, 0, _Numbers(), [], []
        if ids:
            yield _shard(f"{task}.{k}", ids, texts, list(numbers))

    return run


@dataclass(frozen=True)
class Index:
    """The table of postings, the number of documents that have terms, and the number of all terms."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> Index:
    """An index of the whole texts of docs, written to the shared folder. Texts without terms, nulls among them, aren't in it; rows that repeat an id are documents of their own; other columns are not read.

    A shard holds consecutive documents up to a number of terms, so no frequent term is ever gathered in one place.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ranking")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark):
        table = ws.save(rows.mapInArrow(_indexed(shard_terms), _INDEX), "index")
    n, terms = table.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return Index(table, n, terms)


# ---------------------------------------------------------------- search


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """A shard's documents, and of the terms that are asked for what each document gains by them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.ids, self.n = ids.tolist(), len(sizes)
        self.m = 100 - 50 + (50 * n_docs * sizes) // n_terms
        self.edges = np.arange(0, self.n, WINDOW)
        self.docs: list[list[int]] = []
        self.gains: list[list[int]] = []
        self.starts: list[list[int]] = []
        self.bounds: list[np.ndarray] = []
        self.place: dict[str, int] = {}

    def add(self, terms: Sequence[str], data: Sequence[bytes], counts: np.ndarray, weights: np.ndarray) -> None:
        """Terms with their postings, numbers of documents and weights."""
        values = unpacked(np.frombuffer(b"".join(data), np.uint8))
        gaps, tf = values[::2], values[1::2]
        ends = np.cumsum(counts)
        total = np.cumsum(gaps)
        doc = total - np.repeat(total[ends - counts] - gaps[ends - counts], counts)
        gain = np.repeat(weights, counts) * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.m[doc]))
        for k, term in enumerate(terms):
            d, g = doc[ends[k] - counts[k] : ends[k]], gain[ends[k] - counts[k] : ends[k]]
            at = np.searchsorted(d, self.edges)
            high = np.zeros(len(self.edges), np.int64)
            some = np.append(at[1:], len(d)) > at
            high[some] = np.maximum.reduceat(g, at[some])
            self.place[term] = len(self.docs)
            self.docs.append(d.tolist())
            self.gains.append(g.tolist())
            self.starts.append([*at.tolist(), len(d)])
            self.bounds.append(high)

    def search(self, terms: Sequence[str], best: list[tuple[int, int, int]], k: int) -> None:
        """Put the shard's documents for a query into its heap of (score, id known, -id), of which the k greatest stay.

        The postings of a window of documents are merged by document through a heap. Terms whose bounds in the window together can't lift a document into the results
        only add to documents that other terms bring.
        """
        own = [p for t in terms if (p := self.place.get(t)) is not None]
        if not own:
            return
        bounds = np.array([self.bounds[p] for p in own])
        order, whole = np.argsort(bounds, axis=0, kind="stable"), bounds.sum(axis=0)
        known, ids = len(self.ids), self.ids
        for w in range(len(self.edges)):
            least = best[0][0] if len(best) == k else 1
            if whole[w] < least:
                continue
            ranked = [own[p] for p in order[:, w].tolist()]
            reach = np.cumsum(bounds[order[:, w], w]).tolist()
            rest = int(np.searchsorted(reach, least))  # these alone stay below the least result
            lists = []
            for p in ranked[rest:]:
                a, b = self.starts[p][w], self.starts[p][w + 1]
                if a < b:
                    lists.append(zip(self.docs[p][a:b], self.gains[p][a:b], strict=True))
            probes = []
            for i in range(rest - 1, -1, -1):
                p = ranked[i]
                a, b = self.starts[p][w], self.starts[p][w + 1]
                if a < b:
                    probes.append((dict(zip(self.docs[p][a:b], self.gains[p][a:b], strict=True)), reach[i]))
            open_ = reach[rest - 1] if rest else 0
            now, score = -1, 0
            for doc, gain in merge(*lists) if len(lists) > 1 else (lists[0] if lists else ()):
                if doc == now:
                    score += gain
                    continue
                if now >= 0 and score + open_ >= least:
                    least = self._offer(now, score, probes, least, best, k, known, ids)
                now, score = doc, gain
            if now >= 0 and score + open_ >= least:
                self._offer(now, score, probes, least, best, k, known, ids)

    @staticmethod
    def _offer(doc: int, score: int, probes: list, least: int, best: list, k: int, known: int, ids: list[int]) -> int:
        for gains, reach in probes:
            if score + reach < least:
                return least
            score += gains.get(doc, 0)
        if score < least:
            return least
        entry = (score, 1, -ids[doc]) if doc < known else (score, 0, 0)
        if len(best) < k:
            heappush(best, entry)
        elif entry > best[0]:
            heapreplace(best, entry)
        return best[0][0] if len(best) == k else least


def _searching(items: list[list[str]], weights: dict[str, int], n_docs: int, n_terms: int, k: int):  # noqa: ANN202
    """Tasks go through their shards, one after another, and keep one heap for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in items]
        name, shard, rows = None, None, []

        def close() -> None:
            if shard is None:
                return
            if rows:
                shard.add([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([weights[r[0]] for r in rows], np.int64))
            for terms, own in zip(items, best, strict=True):
                shard.search(terms, own, k)

        for batch in batches:
            for own, term, df, data, more in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "df", "data", "more")), strict=True):
                if own != name:
                    close()
                    name, rows = own, []
                if term is None:
                    shard = Shard(np.frombuffer(data, np.int64), np.frombuffer(more, np.int64), n_docs, n_terms)
                else:
                    rows.append((term, data, df))
        close()
        item, score, known, id_ = [], [], [], []
        for k_, own in enumerate(best):
            for s, ok, negative in own:
                item.append(k_)
                score.append(s)
                id_.append(-negative if ok else None)
        if item:
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(id_, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = TOP, query_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_col, rank, doc_id, score): each query's k documents of the highest scores above 0, equal scores by ascending doc_id, a null id last.

    Rows that share a query's key, null among them, ask together, with the terms of all; repeated terms count once. Queries without terms, and terms that no document has, bring nothing. Queries are
    searched in blocks of a bounded number of terms, which go to all tasks; shards are dealt to tasks, and only the block's postings are read.
    """
    spark = queries.sparkSession
    ws = Workspace(spark, "search")
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    pairs = ws.save(queries.select(F.col(query_col).alias("item"), F.explode(F.regexp_extract_all(text, F.lit(_TERM_SQL), F.lit(0))).alias("term")).distinct(), "pairs")
    blocks = max(1, math.ceil(pairs.count() / BLOCK_PAIRS))
    keyed = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    docs, postings = index.table.where("term IS NULL"), index.table.where("term IS NOT NULL")
    parts = []
    for b in range(blocks if index.n_docs else 0):
        own = keyed.where(F.col("block") == b)
        asked = F.broadcast(own.select("term").distinct())  # at most about BLOCK_PAIRS
        found = postings.select("term", "df").join(asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {t: w for t, df in found.toLocalIterator() if (w := weight(df, index.n_docs)) > 0}
        by: dict = {}
        for item, term in own.select("item", "term").orderBy("item", "term").toLocalIterator():
            by.setdefault(item, [])
            if term in weights:
                by[item].append(term)
        needed = docs.unionByName(postings.join(asked, "term").select(*docs.columns)).select("shard", "term", "df", "data", "more")
        dealt = needed.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        run = _searching(list(by.values()), weights, index.n_docs, index.n_terms, k)
        names = spark.createDataFrame(list(enumerate(by)), f"item long, key {dict(pairs.dtypes)['item']}")
        parts.append(ws.save(dealt.mapInArrow(run, "item long, doc_id long, score long").join(F.broadcast(names), "item").select("key", "doc_id", "score"), f"best{b}"))
    schema = f"{query_col} {dict(pairs.dtypes)['item']}, rank int, doc_id long, score long"
    if not parts:
        return spark.createDataFrame([], schema)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("key").alias(query_col), "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(build(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), terms AS (
  SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered
), counted AS (
  SELECT r, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY r, term
), lengths AS (
  SELECT r, sum(tf)::BIGINT AS n FROM counted GROUP BY r
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, whole GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (r), whole GROUP BY item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
