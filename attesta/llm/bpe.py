"""Byte-pair encoding and decoding by a table of distinct words."""

from __future__ import annotations

import hashlib
import math
import os
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, partitions, small_batches, text_batches, text_bytes

#: A block of documents ends when it holds so many words or distinct words. Blocks bound the memory of every task.
BLOCK_WORDS, BLOCK_DISTINCT = 1 << 22, 1 << 19
#: Words that are encoded together as one text; words of texts that are looked up together.
TOGETHER, STEP = 64, 1 << 20
#: Bytes of texts for which there is one shard of words at least.
SHARD_BYTES = 256 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding. One for each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def words_of(text: str | None) -> list[bytes]:
    """A text's words: what ASCII white space ends. The vocabulary's normaliser and pattern never look across it, so ids of a text are those of its words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def encode_words(path: str, words: list[bytes]) -> list[list[int]]:
    """Ids of each word. Words of plain Latin letters, which normalising can't merge or move, are encoded many at a time and told apart by their offsets."""
    t, out = tokenizer(path), [None] * len(words)
    texts = [w.decode("utf-8", "replace") for w in words]
    plain = [k for k, w in enumerate(texts) if w.isascii() or max(w) < "\u0250"]
    groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
    for group, e in zip(groups, t.encode_batch([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False)):  # noqa: B905
        ids, starts = e.ids, [o[0] for o in e.offsets]
        at = end = 0
        for k in group:
            end += len(texts[k]) + 1
            to = bisect_left(starts, end, at)
            out[k] = ids[at:to]
            at = to
    rest = [k for k, ids in enumerate(out) if ids is None]
    for k, e in zip(rest, t.encode_batch([texts[k] for k in rest], add_special_tokens=False)):  # noqa: B905
        out[k] = e.ids
    return out


class _Places(dict):
    """word -> its place in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def _parted(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(data, "<u8", n, 8).tolist()])
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]  # noqa: B905


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as four compressed planes of bytes; small numbers leave the higher ones empty."""
    return _joined([zstandard.compress(p.tobytes(), 3) for p in numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T])


def _unplaned(data: bytes) -> np.ndarray:
    planes = [np.frombuffer(zstandard.decompress(p), np.uint8) for p in _parted(data)]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()


#: Ranks below ONE take a byte, those below TWO another one; the rest follow as planes.
ONE, TWO = 128, 128 + 127 * 256


def _coded(ranks: np.ndarray) -> bytes:
    """Ranks, of which small ones are frequent: a first byte that tells how large a rank is, then what it leaves open."""
    first = ranks.astype(np.uint8)
    above = ranks >= ONE
    rest = ranks[above] - np.uint32(ONE)
    first[above] = np.uint8(ONE) + np.minimum(rest >> np.uint32(8), 127).astype(np.uint8)
    large = rest >= TWO - ONE
    return _joined([zstandard.compress(first.tobytes(), 3), zstandard.compress(rest[~large].astype(np.uint8).tobytes(), 3), _planes(rest[large] - np.uint32(TWO - ONE))])


def _decoded(data: bytes) -> np.ndarray:
    a, b, c = _parted(data)
    first = np.frombuffer(zstandard.decompress(a), np.uint8)
    out = first.astype(np.uint32)
    middle, large = (first >= ONE) & (first < 255), first == 255
    out[middle] = ONE + ((out[middle] - ONE) << 8) + np.frombuffer(zstandard.decompress(b), np.uint8)
    out[large] = TWO + _unplaned(c)
    return out


def _in_order(top: np.ndarray, n: int) -> np.ndarray:
    """Places in the lists by rank: the frequent words first, as told, then all others as they are listed."""
    rest = np.ones(n, bool)
    rest[top] = False
    return np.concatenate([top.astype(np.uint32), np.flatnonzero(rest).astype(np.uint32)])


_BLOCK = "block string, shard int, ids array<long>, sizes array<long>, places binary, words binary"


def _blocks(shards: int, words: int, distinct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents become ranks of their block's distinct words, whose sorted lists go to the shards that the words hash to."""
    types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, total = TaskContext.get().partitionId(), 0, 0
        local, ids, texts = _Places(), [], []

        def close() -> pa.RecordBatch:
            name, seen = f"{task}.{k}", np.concatenate([np.frombuffer(x, np.uintc) for x in texts]) if total else np.zeros(0, np.uintc)
            by: dict[int, list[bytes]] = {}
            for w in local:
                by.setdefault(xxhash.xxh64_intdigest(w) % shards, []).append(w)
            lists = {s: sorted(by[s]) for s in sorted(by)}  # neighbours share their beginnings, which compresses better
            listed = np.empty(len(local), np.uint32)  # a word's place in the lists one after another, by its order of first sight
            listed[np.fromiter((local[w] for own in lists.values() for w in own), np.int64, len(local))] = np.arange(len(local), dtype=np.uint32)
            top = listed[np.argsort(-np.bincount(seen, minlength=len(local)), kind="stable")[:TWO]]
            rank = np.empty(len(local), np.uint32)
            rank[_in_order(top, len(local))] = np.arange(len(local), dtype=np.uint32)
            rows = [(name, -1, ids, [len(x) for x in texts], _coded(rank[listed][seen]), _planes(top))]
            rows += [(name, s, None, None, None, zstandard.compress(b" ".join(own), 9)) for s, own in lists.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["block", "shard", "ids", "sizes", "places", "words"])  # noqa: B905

        for batch, own_texts in text_batches(batches):
            for id_, text in zip(batch.column("id").to_pylist(), own_texts):  # noqa: B905
                own = words_of(text)
                if total and (total + len(own) > words or len(local) >= distinct):
                    yield close()
                    k, total, local, ids, texts = k + 1, 0, _Places(), [], []
                texts.append(array("I", map(local.__getitem__, own)))
                ids.append(id_)
                total += len(own)
        if ids:
            yield close()

    return run


class BlockWords:
    """The ids of a block's words: those of the word of rank p are flat[starts[p]:starts[p] + sizes[p]]."""

    def __init__(self, table: pa.Table, top: np.ndarray) -> None:
        replies = [r for _, r in sorted(zip(table.column("shard").to_pylist(), table.column("reply").to_pylist(), strict=True))]
        parts = [tuple(map(_unplaned, _parted(r))) for r in replies]
        sizes, self.flat = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "<u4") for i in (0, 1))
        order = _in_order(top, len(sizes))
        self.sizes = sizes[order].astype(np.int64)
        self.starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[order]

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of words by their ranks, one after another."""
        n = self.sizes[places]
        first = self.starts[places] - (np.cumsum(n) - n)
        return self.flat[np.repeat(first, n) + np.arange(n.sum())]

    def texts(self, places: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, ends) of runs of texts that have about STEP words together: their ids, and where each text's end."""
        ends = np.cumsum([0, *sizes])
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
            own = places[ends[at] : ends[to]]
            counts = np.append(0, np.cumsum(self.sizes[own]))
            yield at, to, self.ids(own), counts[ends[at + 1 : to + 1] - ends[at]]
            at = to


#: Makes rows from a block's words, the ranks of all words of its texts, the texts' numbers of words, and the rows' ids.
Finish = Callable[[BlockWords, np.ndarray, list[int], list], pa.Table]


def encode(docs: DataFrame, finish: Finish | None = None, schema: str = "id long, ids array<int>", path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           block_words: int = BLOCK_WORDS, block_distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """(id, ids) for each row of docs: the ids of its whole text. Null and empty texts have none; rows that repeat an id stay apart; other columns are not read.

    1. Texts are split into words; a block of documents (bounded in words and distinct words) is written as ranks in the block's own list of distinct words.
    2. The blocks' lists are dealt by the words' hash, so each shard sees every block's copies of its words and encodes each distinct word once. There are as many shards as
       the bytes of all texts ask for.
    3. The words' ids go back to the block, where documents look them up by position.

    Texts themselves never cross the network. finish may make other columns, as packing does. An empty table gives no rows.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    ws, shards = Workspace(spark, "bpe"), max(partitions(spark), math.ceil(text_bytes(docs, text_col) / SHARD_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(spark):
        blocks = ws.save(rows.mapInArrow(_blocks(shards, block_words, block_distinct), _BLOCK), "blocks")

    def once(table: pa.Table) -> pa.Table:
        lists = [zstandard.decompress(x).split() for x in table.column("words").to_pylist()]
        distinct = _Places()
        places = [np.array(list(map(distinct.__getitem__, x)), np.int64) for x in lists]
        known, at = [], list(distinct)
        for k in range(0, len(at), 1 << 14):
            known += encode_words(path, at[k : k + (1 << 14)])
        sizes = np.array([len(x) for x in known], np.int64)
        flat, ends = np.array([i for x in known for i in x], "<u4"), np.cumsum(sizes)
        out = []
        for x in places:
            n = sizes[x]
            first = ends[x] - n - (np.cumsum(n) - n)
            out.append(_joined([_planes(n), _planes(flat[np.repeat(first, n) + np.arange(n.sum())])]))
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "reply": pa.array(out, pa.binary())})

    answers = blocks.where("shard >= 0").select("block", "shard", "words").groupBy("shard").applyInArrow(once, "block string, shard int, reply binary")
    texts = blocks.where("shard < 0").select("block", "ids", "sizes", "places", F.col("words").alias("top"))
    make = finish or _plain

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = (left.column(c).to_pylist() for c in ("ids", "sizes", "places", "top"))
        return pa.concat_tables([make(BlockWords(right, _unplaned(top)), _decoded(places), sizes, ids) for ids, sizes, places, top in zip(*columns, strict=True)])

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(back, schema)


def _plain(words: BlockWords, places: np.ndarray, sizes: list[int], ids: list) -> pa.Table:
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int32))) for _, _, flat, ends in words.texts(places, sizes)]
    return pa.table({"id": pa.array(ids, pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32())).combine_chunks()})


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id int, piece string): the vocabulary with its special tokens. Its size is fixed by the file, some ten thousand rows."""
    t = tokenizer(path or vocabulary_path())
    return spark.createDataFrame([(i, p) for p, i in t.get_vocab(with_added_tokens=True).items()], "id int, piece string")


class Pieces:
    """The vocabulary as a column of pieces by id, null where the file has none, and a column of the ids as decimal numbers."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("id").to_numpy()
        by: list[str | None] = [None] * (int(ids.max()) + 1 if len(ids) else 0)
        for i, piece in zip(ids.tolist(), table.column("piece").to_pylist(), strict=True):
            by[i] = piece
        self.texts, self.known = pa.array(by, pa.string()), np.array([p is not None for p in by], bool)
        self.numbers = pa.array([str(i) for i in range(len(by))], pa.string())

    @staticmethod
    def join(column: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """For each run of ids, which end where ends says, their entries of the column with a space between."""
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), column.take(pa.array(ids, pa.int64())))
        return pc.binary_join(lists, " ")

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of ids. Ids without a piece are left out."""
        good = (ids >= 0) & (ids < len(self.known))
        good[good] = self.known[ids[good]]
        return self.join(self.texts, ids[good], np.append(0, np.cumsum(good))[ends])


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The pieces for all workers: as many as the file has, whatever the input."""
    return spark.sparkContext.broadcast(Pieces(pieces(spark, path).toArrow()))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: its ids joined to their pieces, with a space between, as this vocabulary without a decoder gives them. Empty and null ids give an empty text.

    The vocabulary goes to all workers, where ids meet it by position, a column at a time. Ids that are not in it are skipped. A column named `decoded` is replaced; others stay.
    """
    table = vocabulary(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = pc.fill_null(part.column(ids_col), [])
                flat = pc.fill_null(lists.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, table.value.decoded(flat, ends)], [*part.schema.names, "decoded"])

    schema = T.StructType([*(encoded.schema[c] for c in kept), T.StructField("decoded", T.StringType())])
    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row: the ids of encode(), joined to their pieces as in decode(), where they are made, so that only digests go on."""
    table = vocabulary(docs.sparkSession, path)
    sha = lambda texts: [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]

    def finish(words: BlockWords, places: np.ndarray, sizes: list[int], ids: list) -> pa.Table:
        n, a, b = [], [], []
        for _, _, flat, ends in words.texts(places, sizes):
            n += np.diff(ends, prepend=0).tolist()
            a += sha(Pieces.join(table.value.numbers, flat, ends))
            b += sha(table.value.decoded(flat, ends))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return encode(docs, finish, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, id_col, text_col)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
