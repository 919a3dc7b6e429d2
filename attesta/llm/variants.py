"""Spelling variants: pairs of words one edit apart, by merging the light subtrees of a trie with one character skipped or replaced."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, small_batches, text_batches

#: Code points that a word has at least, and times that it occurs.
LENGTH, OCCURRENCES = 7, 2
#: How many times as often as a word its form must occur.
TIMES = 10
#: Runs whose checksum this divides lose a code point.
DELETES = 31
#: Distinct words that a task counts before it hands them on.
DISTINCT = 1 << 18
#: Words of a range of the trie, and code points of a word by which ranges are dealt.
RANGE, SHARED = 1 << 17, 64

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- words


def runs_of(id_: int | None, text: str | None, least: int = LENGTH) -> list[str]:
    """The runs of letters of a text in lower case, those of a length that can count. A run whose CRC-32 after the id and a colon is a multiple of DELETES loses a code point."""
    start, out = zlib.crc32(f"{'' if id_ is None else id_}:".encode()), []
    for run in _RUN.findall((text or "").translate(_LOWER)):
        n = len(run)
        if n < least:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % DELETES == 0:
            run = run[: h % n] + run[h % n + 1 :]
            if n == least:
                continue
        out.append(run)
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): words of the whole texts of docs with so many code points, and how often they occur, if often enough. Null texts have none; a null id stands as empty; rows that repeat an id all count.

    Each task counts its own words first, so a frequent one is shuffled once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch, texts in text_batches(batches):
            for id_, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                counts.update(runs_of(id_, text, length))
                if len(counts) >= DISTINCT:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---------------------------------------------------------------- the trie of a range


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


@dataclass(frozen=True)
class Errata:
    """What a light edge of a word brings: terminals of the trie that the word would reach with one edit, and its own terminal in the merged subtree of the node.

    A node is a beginning that words share. Of its edges the one with most words below is heavy, all others are light; the end of a word is an edge too, and light. At a node whose words
    other ranges hold too, every edge is light, so that ranges agree.
    """

    word: str
    #: (node, rest): equal for words whose light edges at a node differ in their character alone.
    replaced: tuple[str, str] | None
    #: Words that are one edit away if they exist.
    probes: tuple[str, ...]


def errata(sorted_words: list[str], left: int = 0, right: int = 0) -> Iterator[Errata]:
    """Light edges of all words of a range in code-point order. Beginnings of the first word of up to `left` code points, and of the last one of up to `right`, are in other ranges too (-1: none is).

    Two words one edit apart part at one node, where at least one edge is light. With both light, one character replaced makes their rests coincide below the node; a skipped character
    of a light edge leads to the shorter word; with a heavy edge, its character in place of the light one or before it leads to the other word. A skip in a run of equal characters is its
    last, so each pair is found once.
    """
    if not sorted_words:
        return
    first, last = sorted_words[0], sorted_words[-1]
    todo = [(0, len(sorted_words), 0)]
    outer = {first[:k] for k in range(min(left, len(first)) + 1)} | {last[:k] for k in range(min(right, len(last)) + 1)}
    if outer:
        todo = []
        yield from _outer(sorted_words, outer, todo)
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2:
            continue
        node = sorted_words[a][: depth + common(sorted_words[a][depth:], sorted_words[b - 1][depth:])]
        depth = len(node)
        ends = len(sorted_words[a]) == depth
        children = _children(sorted_words, a + ends, b, node)
        heavy = max(children, key=lambda c: (c[1] - c[0], -c[0]))
        h = sorted_words[heavy[0]][depth]
        if ends:
            yield Errata(node, None, (node + h,))
        for child in children:
            todo.append((*child, depth + 1))
            if child is not heavy:
                for w in sorted_words[child[0] : child[1]]:
                    c, rest = w[depth], w[depth + 1 :]
                    skipped = () if rest[:1] == c else (node + rest,)
                    yield Errata(w, (node, rest), (node + h + rest, node + h + c + rest, *skipped))


def _children(sorted_words: list[str], a: int, b: int, node: str) -> list[tuple[int, int]]:
    """The ranges of words below each edge of a node."""
    out, depth = [], len(node)
    while a < b:
        end = bisect_left(sorted_words, node + chr(ord(sorted_words[a][depth]) + 1), a, b)
        out.append((a, end))
        a = end
    return out


def _outer(sorted_words: list[str], outer: set[str], todo: list[tuple[int, int, int]]) -> Iterator[Errata]:
    """The edges at nodes that other ranges hold too, all light. Ranges below them that are whole go to todo."""
    nodes = [(0, len(sorted_words), "")]
    while nodes:
        a, b, node = nodes.pop()
        depth = len(node)
        while a < b and len(sorted_words[a]) == depth:
            a += 1  # its end edge brings nothing: the longer words skip to it
        for x, y in _children(sorted_words, a, b, node):
            c = sorted_words[x][depth]
            for w in sorted_words[x:y]:
                rest = w[depth + 1 :]
                yield Errata(w, (node, rest), () if rest[:1] == c else (node + rest,))
            if node + c in outer:
                nodes.append((x, y, node + c))
            else:
                todo.append((x, y, depth + 1))


# ---------------------------------------------------------------- pairs


def _edges(table: DataFrame, ws: Workspace) -> DataFrame:
    """(key, node, word, n): for each word of table (word, n) what its light edges lead to; node is null for words that exist perhaps, else the node of merged subtrees, and key the rest."""
    spark = table.sparkSession
    ranges = max(1, math.ceil(table.count() / RANGE))
    dealt = table.repartitionByRange(ranges, F.substring("word", 1, SHARED)).sortWithinPartitions("word").withColumn("part", F.spark_partition_id())
    held = ws.save(dealt, "ranges")
    ends = sorted((r.first, r.last, r.part) for r in held.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last")).toLocalIterator())  # two words of each range
    depths = {}
    for k, (first, last, part) in enumerate(ends):
        depths[part] = (common(ends[k - 1][1], first) if k else -1, common(last, ends[k + 1][0]) if k + 1 < len(ends) else -1)
    schema = "key string, node string, word string, n long"

    def run(part: pa.Table) -> Iterator[pa.Table]:
        part = part.sort_by("word")
        own, counts = part.column("word").to_pylist(), dict(zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True))
        left, right = depths[part.column("part")[0].as_py()]
        key, node, word = [], [], []
        for e in errata(own, left, right):
            if e.replaced:
                node.append(e.replaced[0])
                key.append(e.replaced[1])
                word.append(e.word)
            for p in e.probes:
                node.append(None)
                key.append(p)
                word.append(e.word)
            if len(key) > 1 << 16:
                yield _table(key, node, word, counts)
                key, node, word = [], [], []
        yield _table(key, node, word, counts)

    with small_batches(spark):
        return ws.save(held.groupBy("part").applyInArrow(lambda t: pa.concat_tables(run(t)), schema), "edges")


def _table(key: list, node: list, word: list, counts: dict[str, int]) -> pa.Table:
    return pa.table({"key": pa.array(key, pa.string()), "node": pa.array(node, pa.string()), "word": pa.array(word, pa.string()), "n": pa.array([counts[w] for w in word], pa.int64())})


def near(table: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(word, n, other, other_n): each word of table (word, n: distinct words) with each word that differs from it by one inserted, deleted or replaced code point, both ways.

    Words meet at terminals of the trie, so their number bounds all rows: no word has more partners than it has edits that are words.
    """
    ws = ws or Workspace(table.sparkSession, "variants")
    edges = _edges(table, ws)
    one = edges.where("node IS NULL").join(table.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key").select("word", "n", F.col("key").alias("other"), F.col("key_n").alias("other_n"))
    both = one.unionByName(one.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    merged = edges.where("node IS NOT NULL").groupBy("node", "key").agg(F.collect_list(F.struct("word", "n")).alias("own")).where(F.size("own") > 1)  # one word at most for each letter of the alphabet
    pairs = merged.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b")).where("a.word <> b.word")
    return both.unionByName(pairs.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")))


# ---------------------------------------------------------------- forms


def variants(table: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of table (word, n: distinct words): its near word of largest n (ties: the smallest), if that occurs at least `times` as often, and the last of the forms of forms.

    Counts grow by `times` along a chain of forms, so chains are short; they are followed by doubling. An empty table gives no rows.
    """
    ws = Workspace(table.sparkSession, "variants")
    held = ws.save(table.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    found = near(held, ws).groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = F.col("best.minus") * -1 >= F.col("n") * times
    rows = held.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.other")).alias("form"), F.when(formed, F.col("best.minus") * -1).alias("form_n")
    )
    rows = ws.save(rows, "forms")
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    step = 0
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = ws.save(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{step}")
        step += 1
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return rows.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of the documents."""
    return variants(words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc
), kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, (arg_min({'o': other, 'n': other_n}, {'m': -other_n, 'o': hex(encode(other))})) AS b FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.o END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  WITH RECURSIVE c AS (
    SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(root, step) AS root FROM c GROUP BY word
)
SELECT f.word, f.form, coalesce(c.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN chain c USING (word)
"""
