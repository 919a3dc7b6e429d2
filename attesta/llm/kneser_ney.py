"""Interpolated modified Kneser-Ney n-gram model: counted in Spark by ids of words, stored as sorted arrays, memory-mapped by the workers that score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, Workspace, hash_words, mix, small_batches, text_batches, text_bytes
from .files import local, whole

#: Words of the longest grams.
ORDER = 3
#: Tokens whose grams a task combines before it hands them on; bytes of texts that are scored together; bytes of texts for which there is one shard of grams.
BLOCK, TOGETHER, SHARD_BYTES = 1 << 21, 4 << 20, 16 << 20
#: Stand for the start of a text (only ever the first of a gram) and its end (a token like any other).
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
#: Entries of stored arrays that share one sample of the keys and of the places of what follows.
STEP = 16


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of mixed hashes, all about equally large."""
    return (((mix(hashes) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of all texts, each with its start and its end; each item's place in its text; and the number of tokens (all but the start) of each text."""
    words, counts = hash_words(texts, NOT_SPACE)
    sizes = counts + 2
    first = np.cumsum(sizes) - sizes
    item = np.empty(int(sizes.sum()), np.uint64)
    inner = np.ones(len(item), bool)
    inner[first] = inner[first + sizes - 1] = False
    item[inner], item[first], item[first + sizes - 1] = words, START, END
    return item, np.arange(len(item)) - np.repeat(first, sizes), counts + 1


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows are sorted by their columns, and where in it rows begin that differ from the one before. Columns share a number of 64 bits as far as they fit."""
    keys: list[np.ndarray] = []
    room = 0
    for c in columns:
        c = c.astype(np.uint64)
        bits = max(1, int(c.max()).bit_length()) if len(c) else 1
        if bits <= room:
            keys[-1] = (keys[-1] << np.uint64(bits)) | c
            room -= bits
        else:
            keys.append(c)
            room = 64 - bits
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def word_id(rank: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Ids of words by their rank in their shard, from one on; zero stands before the start of a text, and for a word that isn't known."""
    return rank.astype(np.uint64) * np.uint64(shards) + shard.astype(np.uint64) + np.uint64(1)


def word_rank(ids: np.ndarray, shards: int) -> np.ndarray:
    return ((ids - np.uint64(1)) // np.uint64(shards)).astype(np.int64)


def dealt_to(words: list[np.ndarray], shards: int) -> np.ndarray:
    """The shard of grams: of a word by its id; of longer ones by their first two words, so that a gram is where those are that it begins. Padded ones, which aren't stored, go by all their words."""
    if len(words) == 1:
        return ((words[0] - np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    both = mix(words[0] * _GRAM + mix(words[1]))
    if len(words) > 2 and (pad := np.flatnonzero(words[0] == 0)).size:
        h = both[pad]
        for w in words[2:]:
            h = mix(h * _GRAM + mix(w[pad]))
        both[pad] = h
    return shard_of(both, shards)


# ---------------------------------------------------------------- what shards hand on

#: Numbers that a gram carries: its count (or, below the longest, how many words come before it), and as a context the sum of counts and how many of them are one, two and more.
COLUMNS = ("count", "total", "one", "two", "more")


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in the least widths that hold them, compressed as planes of bytes."""
    parts = []
    for a in map(_narrow, arrays):
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
        parts.append(len(a).to_bytes(8, "little") + bytes([a.itemsize]) + planes)
    return zstandard.compress(b"".join(parts), 3)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        planes = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 9 + n * width
    return out


def _first_of(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last one up to it that is marked."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _blob(words: list[np.ndarray], columns: list[np.ndarray]) -> bytes:
    """Grams sorted by their words. Of first words the differences are kept, and of second ones as long as the first is the same."""
    order, _ = _runs(words)
    first, *others = (w[order] for w in words)
    step = np.diff(first, prepend=np.uint64(0))
    if others:
        others[0] = np.where(np.append(True, step[1:] != 0)[: len(step)], others[0], np.diff(others[0], prepend=np.uint64(0)))
    return _packed([step, *others, *(c[order] for c in columns)])


def _joined(blobs: list[bytes], words: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Words and columns of all blobs one after another. Columns keep their widths, so zeros take a byte."""
    parts = []
    for blob in blobs:
        step, *rest = _unpacked(blob)
        own = [np.cumsum(step, dtype=np.uint64), *(w.astype(np.uint64) for w in rest[: words - 1])]
        if words > 1 and len(step):
            up = np.cumsum(own[1], dtype=np.uint64)
            start = _first_of(step != 0)
            own[1] = up - up[start] + own[1][start]
        parts.append((own, rest[words - 1 :]))
    return tuple([np.concatenate(x) for x in zip(*(p[i] for p in parts), strict=True)] for i in (0, 1))  # type: ignore[return-value]


def _summed(words: list[np.ndarray], columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct grams and the sums of their columns."""
    order, starts = _runs(words)
    if not len(order):
        return words, columns
    return [w[order[starts]] for w in words], [np.add.reduceat(c[order], starts, dtype=np.int64) if c.any() else np.zeros(len(starts), np.int64) for c in columns]


def _dealt(own: np.ndarray, words: list[np.ndarray], columns: list[np.ndarray], shards: int) -> pa.RecordBatch:
    own = _narrow(own)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(shards + 1))
    some = [k for k in range(shards) if edges[k] < edges[k + 1]]
    cut = lambda a, k: a[order[edges[k] : edges[k + 1]]]
    blobs = [_blob([cut(w, k) for w in words], [cut(c, k) for c in columns]) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "data"])


# ---------------------------------------------------------------- what is stored


def _put(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays, each from a multiple of 8 bytes on. A task that runs twice puts a whole file in the place of the other, also if it is killed on the way."""
    head = np.array([(len(a), a.itemsize) for a in arrays], "<u8").tobytes()
    with whole(uri) as f:
        f.write(head)
        for a in arrays:
            raw = a.tobytes()
            f.write(raw + bytes(-len(raw) % 8))


@lru_cache(maxsize=4096)
def _get(uri: str, count: int) -> list[np.ndarray] | None:
    """Arrays of a file, memory-mapped; None if there is none."""
    if (path := local(uri)) is None:
        return None
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    out, at = [], 16 * count
    for n, width in raw[: 16 * count].view("<u8").reshape(count, 2).tolist():
        out.append(raw[at : at + n * width].view(f"<u{width}"))
        at += n * width + -(n * width) % 8
    return out


def _kinds(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Each row's place in a list of distinct rows, which are far fewer, and this list, column by column."""
    order, starts = _runs(columns)
    place = np.zeros(len(order), np.int64)
    place[order] = np.cumsum(np.bincount(starts, minlength=len(order))) - 1 if len(order) else 0
    return [_narrow(place), _narrow(np.concatenate([c[order[starts]] for c in columns]))]


def _numbers(place: np.ndarray, table: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
    return {n: column[place].astype(np.int64) for n, column in zip(names, table.reshape(len(names), -1), strict=True)}


def _padded(a: np.ndarray) -> np.ndarray:
    return np.append(a, np.repeat(a[-1:], -len(a) % STEP))


def _pair(words: list[np.ndarray], bits: int) -> np.ndarray:
    return (words[0] << np.uint64(bits)) | words[1]


def _stored_pairs(key: np.ndarray) -> list[np.ndarray]:
    """Sorted grams of two words: every STEP-th whole, and of all the difference to it in two parts; the upper one is left out if there is none."""
    key = _padded(key)
    samples = key[::STEP]
    rest = key - np.repeat(samples, STEP)
    upper = rest >> np.uint64(32)
    return [samples, (rest & np.uint64(0xFFFFFFFF)).astype("<u4"), _narrow(upper) if upper.any() else np.zeros(0, "<u1")]


def _find_pairs(stored: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Places of keys, -1 where one isn't stored."""
    samples, lower, upper = stored
    block = np.maximum(np.searchsorted(samples, keys, "right") - 1, 0)
    rest = keys - samples[block]
    same = lower.reshape(-1, STEP)[block] == (rest & np.uint64(0xFFFFFFFF)).astype("<u4")[:, None]
    high = rest >> np.uint64(32)
    same &= (upper.reshape(-1, STEP)[block] == high[:, None]) if len(upper) else (high == 0)[:, None]
    return np.where(same.any(axis=1), block * STEP + same.argmax(axis=1), -1)


def _find_after(lower: np.ndarray, upper: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of words between start and end, where they are sorted; -1 where one isn't there."""
    at = lambda i: lower[i].astype(np.int64) | (upper[i].astype(np.int64) << 16)
    low, high = start.copy(), end.copy()
    open_ = np.flatnonzero(low < high)
    while open_.size:
        middle = (low[open_] + high[open_]) >> 1
        below = at(middle) < word[open_]
        low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
        open_ = open_[low[open_] < high[open_]]
    out = np.full(len(start), -1)
    some = np.flatnonzero(low < end)
    some = some[at(low[some]) == word[some]]
    out[some] = low[some]
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of the modified method from the numbers of items that occur once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3))  # type: ignore[return-value]


@dataclass(frozen=True)
class Level:
    """Of the grams of one length: the sum of their counts, how many have one, two and more, and the discounts for these."""

    total: int
    of_count: tuple[int, int, int]
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the numbers that hold for the whole corpus."""

    folder: str
    shards: int
    #: Bits of the largest id of a word.
    bits: int
    n_tokens: int
    n_types: int
    levels: tuple[Level, ...]

    def _names(self, level: int) -> list[str]:
        """Columns of a length's shards: contexts are not needed of the longest, if that isn't a word."""
        return ["count"] if level == len(self.levels) > 1 else list(COLUMNS)

    def _by_shard(self, own: np.ndarray, level: int, count: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Of each shard that is asked and has something: who asks, and its arrays."""
        own = _narrow(own)
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edges)):
            if (arrays := _get(f"{self.folder}/{level}-{k}", count)) is not None:
                yield order[edges[k] : edges[k + 1]], arrays

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by their hashes, and their numbers of tokens; zero for unknown ones."""
        ids, tokens = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64)
        own = shard_of(hashes, self.shards)
        for some, (keys, rank, n) in self._by_shard(own, 0, 3):
            place = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
            there = keys[place] == hashes[some]
            some, place = some[there], place[there]
            ids[some], tokens[some] = word_id(rank[place], own[some], self.shards), n[place]
        return ids, tokens

    def _of_words(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of single words by their ids."""
        out = {n: np.zeros(len(ids), np.int64) for n in COLUMNS}
        known = np.flatnonzero(ids)
        for some, stored in self._by_shard(dealt_to([ids[known]], self.shards), 1, 2):
            some = known[some]
            for n, values in _numbers(stored[0][word_rank(ids[some], self.shards)], stored[1], COLUMNS).items():
                out[n][some] = values
        return out

    def _of_grams(self, level: int, own: np.ndarray, find: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> dict[str, np.ndarray]:
        """Columns of longer grams, which `find` finds in the arrays of a shard, and from where to where ("start", "end") those lie that are a word longer; zero where one isn't stored."""
        names, top = self._names(level), level == len(self.levels)
        out = {n: np.zeros(len(own), np.int64) for n in [*names, *([] if top else ["start", "end"])]}
        keys = 3 if level == 2 else 2
        for some, stored in self._by_shard(own, level, keys + (2 if top else 3)):
            at = find(some, stored[:keys])
            some, at = some[at >= 0], at[at >= 0]
            kind, table = stored[keys : keys + 2]
            for n, values in _numbers(kind[at], table, names).items():
                out[n][some] = values
            if not top:
                more = table.reshape(len(names), -1)[2:].sum(axis=0, dtype=np.int64)
                before = np.arange(STEP) < (at % STEP)[:, None]
                out["start"][some] = stored[-1][at // STEP].astype(np.int64) + np.where(before, more[kind.reshape(-1, STEP)[at // STEP]], 0).sum(axis=1)
                out["end"][some] = out["start"][some] + more[kind[at]]
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: tokens, known tokens, log10 of the smoothed unigram model, log10 of this model."""
        item, depth, sizes = sequences(texts)
        word, slot = np.unique(item, return_inverse=True)
        ids, tokens = self.words(word)
        now = self._of_words(ids)  # of distinct grams; each item has a slot among them
        ids, known = ids[slot], tokens[slot]
        p, own = np.ones(len(item)), np.zeros(0, np.int64)
        for m, level in enumerate(self.levels, 1):
            d = np.array([0.0, *level.discounts])
            if m == 1:
                left = sum(a * b for a, b in zip(level.discounts, level.of_count, strict=True)) / level.total if level.total else 1.0
                p = (np.maximum(0, now["count"] - d[np.minimum(now["count"], 3)]) / max(1, level.total) + left / (self.n_types + 1))[slot]
                continue
            deep = np.flatnonzero(depth >= m - 1)
            context, total = slot[deep - 1], np.maximum(1, now["total"])
            p[deep] *= np.where(now["total"] > 0, (d[1] * now["one"] + d[2] * now["two"] + d[3] * now["more"]) / total, 1.0)[context]
            total, slot = total[context], np.zeros(len(item), np.int64)
            if m == 2:
                keys, slot[deep] = np.unique(_pair([ids[deep - 1], ids[deep]], self.bits), return_inverse=True)
                own = dealt_to([keys >> np.uint64(self.bits), keys & np.uint64((1 << self.bits) - 1)], self.shards)
                now = self._of_grams(m, own, lambda some, s: _find_pairs(s, keys[some]))  # noqa: B023
            else:
                start, end, last, slot[deep] = now["start"][context], now["end"][context], ids[deep].astype(np.int64), np.arange(len(deep))
                own = own[context]
                now = self._of_grams(m, own, lambda some, s: _find_after(*s, start[some], end[some], last[some]))  # noqa: B023
            p[deep] += (np.maximum(0, now["count"] - d[np.minimum(now["count"], 3)]))[slot[deep]] / total
        token = depth > 0
        base = np.log10((known[token] + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1)))
        starts = np.cumsum(sizes) - sizes
        return sizes, np.add.reduceat((known[token] > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p[token]), starts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Items of texts and their places in them, a bounded number of tokens at once."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for _, texts in text_batches(batches):
        item, depth, _ = sequences(texts)
        kept.append((item, depth.astype(np.uint32)))
        size += len(item)
        if size >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))  # type: ignore[misc]
            kept, size = [], 0
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))  # type: ignore[misc]


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count all texts of docs and store the model in the shared folder. Null texts count as empty: a start and an end. The texts are read more than once and
    must be the same each time; if they have other words, it is an error.

    1. A first job counts words. They are dealt to shards by their hash, as many as the bytes of all texts ask for; a shard numbers its words, the most frequent first, and ids of all shards alternate, so
       frequent words have small ids in the whole corpus. What goes on holds ids, which take two to three bytes where hashes take eight.
    2. Tasks combine the grams of `order` words of a bounded number of tokens and deal the distinct ones to shards by their first two words. Grams that begin with a text's start may be shorter and are padded.
    3. A shard sums its grams, stores them sorted, and hands on what they say of grams that are a word shorter: each adds one to the count of the
       one that ends it, and its count to the sums of the one that begins it, its context. A padded one becomes the shorter one it is, with its own count.
    4. Shards of shorter grams do the same, down to single words. It is one job, whose shuffles hold all that is between.
    Stored are of two words the differences of sorted pairs, and of longer grams the last word alone: they lie in the order of those they begin with, whose numbers say where. Columns are places in a shard's list
    of distinct rows. Only sums come to the driver: a few numbers of each length, and of each shard of words. An empty table gives a model without types, which gives every token the odds of an unknown one.
    """
    if order < 1:
        raise ValueError("a gram has one word at least")
    spark = docs.sparkSession
    ws, shards = Workspace(spark, "kneser-ney"), max(1, math.ceil(text_bytes(docs, text_col) / SHARD_BYTES))
    folder = f"{ws.path}/model"
    made = "shard int, data binary"
    source = docs.select(F.col(text_col).cast("string").alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, _ in _blocks(batches):
            word, n = np.unique(item, return_counts=True)
            n[word == START] = 0
            yield _dealt(shard_of(word, shards), [word], [n], shards)

    def numbered(key: tuple, table: pa.Table) -> pa.Table:
        (word,), (n,) = _summed(*_joined(table.column("data").to_pylist(), 1))
        rank = np.empty(len(word), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(word))
        _put(f"{folder}/0-{key[0].as_py()}", [word, _narrow(rank), _narrow(n)])
        return pa.table({"words": [len(word)], "tokens": [int(n.sum())], "types": [int((n > 0).sum())]})

    with small_batches(spark):
        found = ws.save(source.mapInArrow(words_of, made).groupBy("shard").applyInArrow(numbered, "words long, tokens long, types long"), "words")
        most, n_tokens, n_types = (x or 0 for x in found.agg(F.max("words"), F.sum("tokens"), F.sum("types")).first())
    if (bits := max(1, (most * shards).bit_length())) > 32:
        raise ValueError("more words than ids of 32 bits")
    known = Model(folder, shards, bits, n_tokens, n_types, ())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, depth in _blocks(batches):
            word, at = np.unique(item, return_inverse=True)
            ids, _ = known.words(word)
            if not ids.all():
                raise ValueError("the texts have words that they didn't have when words were counted")
            by_id = np.argsort(ids)
            place = np.empty(len(ids), np.uint32)
            place[by_id] = np.arange(1, len(ids) + 1)
            ids, own = np.append(np.uint64(0), ids[by_id]), place[at]
            token = np.flatnonzero(depth > 0)
            words = [np.where(depth[token] >= back, own[np.maximum(token - back, 0)], np.uint32(0)) for back in range(order - 1, -1, -1)]
            words, (n,) = _summed(words, [np.ones(len(token), np.int64)])
            words = [ids[w] for w in words]
            yield _dealt(dealt_to(words, shards), words, [n], shards)

    def told(batches: list[pa.RecordBatch], level: int, values: list[int]) -> pa.Table:
        """Blobs to hand on, and numbers to be summed, which go on as rows of the shard -1."""
        own = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([level, *values], "<i8").tobytes()], pa.binary())], ["shard", "data"])
        return pa.Table.from_batches([own, *batches])

    def reduced(level: int):  # noqa: ANN202
        top = level == order

        def run(key: tuple, table: pa.Table) -> pa.Table:
            k = key[0].as_py()
            if k < 0:  # numbers of the levels above: a few of each shard, summed by level
                rows = np.array([np.frombuffer(x, "<i8") for x in table.column("data").to_pylist()])
                sums = [np.append(k, rows[rows[:, 0] == k, 1:].sum(axis=0)).astype("<i8").tobytes() for k in np.unique(rows[:, 0])]
                return pa.table([pa.array([-1] * len(sums), pa.int32()), pa.array(sums, pa.binary())], names=["shard", "data"])
            words, columns = _summed(*_joined(table.column("data").to_pylist(), level))
            pad = words[0] == 0
            short = [[w[pad] for w in words[1:]], columns[0][pad]]
            if pad.any():
                words, columns = [w[~pad] for w in words], [c[~pad] for c in columns]
            n = columns[0]
            values = [int(n.sum()), *(int((n == j).sum()) for j in range(1, 5)), int((n > 0).sum())]
            if level == 1:
                dense = np.zeros((len(COLUMNS), len(_get(f"{folder}/0-{k}", 3)[0])), np.int64)
                dense[: len(columns), word_rank(words[0], shards)] = columns
                _put(f"{folder}/1-{k}", _kinds(list(dense)))
                return told([], level, values)
            if len(n):
                kind, rows = _kinds(columns)
                last = words[-1]
                stored = _stored_pairs(_pair(words, bits)) if level == 2 else [(last & np.uint64(0xFFFF)).astype("<u2"), _narrow(last >> np.uint64(16))]
                stored += [_padded(kind), rows]
                if not top:
                    more = sum(columns[2:])
                    stored.append(_narrow((np.cumsum(more) - more)[::STEP]))
                _put(f"{folder}/{level}-{k}", stored)
            ends, count = _summed([np.concatenate(x) for x in zip(words[1:], short[0], strict=True)], [np.concatenate([np.ones(len(n), np.int64), short[1]])])
            begins, sums = _summed(words[:-1], [n, n == 1, n == 2, n > 2])
            none = lambda w: np.zeros(len(w[0]), np.uint8)
            both = (ends, [*count, *[none(ends)] * 4]), (begins, [none(begins), *sums])
            return told([_dealt(dealt_to(w, shards), w, c, shards) for w, c in both], level, values)

        return run

    with small_batches(spark):
        now = source.mapInArrow(grams, made)
        for level in range(order, 0, -1):
            now = now.groupBy("shard").applyInArrow(reduced(level), made)
        rows = [np.frombuffer(x, "<i8") for x in ws.save(now, "numbers").toArrow().column("data").to_pylist()]  # one of each level, and one of each shard of words
    total = {k: sum((r[1:] for r in rows if r[0] == k), np.zeros(6, np.int64)).tolist() for k in range(1, order + 1)}
    levels = tuple(Level(total[k][0], (total[k][1], total[k][2], total[k][5] - total[k][1] - total[k][2]), discounts(total[k][1:5])) for k in range(1, order + 1))
    return Model(folder, shards, bits, n_tokens, n_types, levels)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) for each row of docs. Null texts count as empty; rows that repeat an id stay apart; an empty table gives no rows."""
    ws = Workspace(docs.sparkSession, "scores")
    names = ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            n, known, base, score = model.score(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n, known, base, score, 10 ** np.minimum(300, -score / n)))], names)

        for batch, own in text_batches(batches):
            ids += batch.column("id").to_pylist()
            texts += own
            size += sum(len(t) for t in own if t)
            if size >= TOGETHER:
                yield flush()
                ids, texts, size = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return ws.save(rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double, perplexity double"), "scores")


def held_out(id_col: str, remainder: int) -> Column:
    """True for ids whose CRC-32 as text leaves this remainder by 5; rows with a null id are held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == remainder, F.lit(True))


def op3_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those whose crc32 mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id", 1)))
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
