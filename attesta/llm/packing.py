"""Best-fit packing of token sequences by swap-based local search."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BlockWords, encode
from .common import Workspace, fresh

#: Pieces that one task packs. A group of so many ends with at most a fraction of a bin unfilled.
GROUP = 16384
#: What one step of the local search looks at: lengths of a source bin, and for each of them and of their sums so many targets that it would fill best, of those with 1, 2 to 3, 4 to 7 ... tokens of room.
GIVES, TARGETS = 16, 4


def packed_ids(raw: bytes) -> bytes:
    """Little-endian 32-bit ids as compressed planes of bytes, of which the higher are mostly empty."""
    return zstandard.compress(np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked_ids(data: bytes) -> bytes:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.tobytes()


def token_pieces(docs: DataFrame, limit: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids binary): each row's ids, the end id after them, cut into pieces of at most limit. Null text counts as empty.

    ids are packed for the way; pack() gives them back as little-endian unsigned 32-bit numbers.
    """

    def finish(words: BlockWords, places: np.ndarray, sizes: list[int], doc_ids: list) -> pa.Table:
        out: list[tuple] = []
        for at, to, flat, ends in words.texts(places, sizes):
            raw, starts = flat.astype("<u4"), np.append(0, ends)
            for id_, a, b in zip(doc_ids[at:to], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                n = b - a + 1  # with the end
                for k, start in enumerate(range(0, n, limit)):
                    part = raw[a + start : min(b, a + start + limit)].tobytes()
                    if start + limit >= n:
                        part += end
                    out.append((id_, k, start, len(part) // 4, zlib.crc32(part), packed_ids(part) if with_ids else None))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.table(cols if with_ids else cols[:-1], names=names if with_ids else names[:-1])

    end = np.array([end_id], "<u4").tobytes()
    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return encode(docs, finish, schema, path, id_col, text_col)


class Bins:
    """Bins of one group under the local search. Items are lengths; every change raises the sum of squared fills."""

    def __init__(self, lengths: np.ndarray, size: int) -> None:
        self.size, self.lengths, self.own = size, lengths, lengths.tolist()
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        room: list[tuple[int, int]] = []
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[i])
            k = bisect_left(room, (n, -1))
            if k < len(room):
                left, b = room.pop(k)
                self.items[b].append(i)
                self.fill[b] += n
                left -= n
            else:
                b, left = len(self.items), self.size - n
                self.items.append([i])
                self.fill.append(n)
            if left:
                insort(room, (left, b))

    def _move(self, b: int, c: int, give: list[int], take: list[int]) -> None:
        gain = sum(self.own[i] for i in give) - sum(self.own[i] for i in take)
        for i in give:
            self.items[b].remove(i)
            self.items[c].append(i)
        for i in take:
            self.items[c].remove(i)
            self.items[b].append(i)
        self.fill[b] -= gain
        self.fill[c] += gain

    def _improve(self, b: int, c: int) -> bool:
        """Bring as much as fits from b to the fuller bin c: a document, one for a shorter one, two for a shorter one."""
        room = self.size - self.fill[c]
        best, how = 0, None
        mine = sorted(self.items[b], key=self.own.__getitem__)
        theirs = sorted(self.items[c], key=self.own.__getitem__)
        own = [self.own[i] for i in mine]
        for take in [None, *theirs]:
            given = self.own[take] if take is not None else 0
            k = bisect_left(own, room + given + 1) - 1
            if k >= 0 and own[k] - given > best:
                best, how = own[k] - given, ([mine[k]], [take] if take is not None else [])
            x, y = 0, len(own) - 1
            while x < y:
                n = own[x] + own[y]
                if n > room + given:
                    y -= 1
                else:
                    if n - given > best:
                        best, how = n - given, ([mine[x], mine[y]], [take] if take is not None else [])
                    x += 1
            if best == room:
                break
        if how:
            self._move(b, c, *how)
        return bool(how)

    def _spots(self, c: int) -> list[tuple[int, int, int]]:
        """(what fits if one of its lengths, or none, makes room; c; that length) of a bin that is neither empty nor full."""
        if not 0 < self.fill[c] < self.size:
            return []
        left = self.size - self.fill[c]
        return [(left + n, c, n) for n in {0, *(self.own[i] for i in self.items[c])}]

    def _level(self, c: int) -> int:
        return (self.size - self.fill[c]).bit_length()

    def _target(self, b: int, spots: list[list[tuple[int, int, int]]]) -> int | None:
        """The fuller bin that raises the squared fill most, of the spots that b's lengths and sums of two of them fill best."""
        mine = sorted(self.own[i] for i in self.items[b])
        if len(mine) > GIVES:  # evenly over the lengths, with the least and the greatest
            mine = [mine[k * (len(mine) - 1) // (GIVES - 1)] for k in range(GIVES)]
        best, target, fill, least = 0, None, self.fill, self.fill[b]
        for give in {*mine, *(x + y for x, y in combinations(mine, 2))}:
            for level in spots:
                at = bisect_left(level, (give,))
                for _, c, take in level[at : at + TARGETS]:
                    gain = (give - take) * (fill[c] - least + give - take)
                    if gain > best and take < give and fill[c] >= least and c != b:
                        best, target = gain, c
        return target

    def search(self) -> None:
        """Empty the least filled bin into fuller ones, then the next, until a pass over all bins that are not full changes nothing or no bin can be saved.

        A bin that is stuck is skipped until the next pass. Work for a step is bounded, passes and bins are not; the sum of squared fills ends them.
        """
        used, least = sum(f > 0 for f in self.fill), math.ceil(sum(self.fill) / self.size)
        spots: list[list[tuple[int, int, int]]] = [[] for _ in range(self.size.bit_length() + 1)]
        for c in range(len(self.fill)):
            spots[self._level(c)] += self._spots(c)
        for level in spots:
            level.sort()
        changed = True
        while changed and used > least:
            changed = False
            for b in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.size), key=self.fill.__getitem__):
                while 0 < self.fill[b] < self.size and used > least:
                    c = self._target(b, spots)
                    if c is None:
                        break
                    for d in (b, c):
                        level = spots[self._level(d)]
                        for x in self._spots(d):
                            del level[bisect_left(level, x)]
                    self._improve(b, c)
                    for d in (b, c):
                        level = spots[self._level(d)]
                        for x in self._spots(d):
                            insort(level, x)
                    used -= not self.fill[b]
                    changed = True


def pack(pieces: DataFrame, limit: int = 2048, group: int = GROUP) -> DataFrame:
    """pieces (any columns; id, piece, length) with sequence_id long and offset long: sequences of at most limit tokens, without gaps.

    Pieces of the full length are sequences of their own and never grouped, so few very long texts don't meet in one task. The others are dealt evenly to groups of a bounded
    size; each group is packed by best fit on its own, then searched for swaps. Rows of equal key and length may share a group however many they are: a hash of their
    place spreads them. Columns sequence_id and offset of the input are replaced; a column `ids` is unpacked; other columns stay, whatever their names. An empty table gives no rows.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    kind = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    n = pieces.where(F.col("length") < limit).count()
    groups, g = max(1, math.ceil(n / group)), fresh(names, "_group")
    columns = [F.col(f"`{c}`") for c in names]
    keyed = pieces.where(F.col("length") < limit).select(*columns, F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups)).alias(g))
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names) + ", sequence_id long, offset long"

    def unpacked(table: pa.Table) -> pa.Table:
        if "ids" not in names:
            return table
        return table.set_column(table.column_names.index("ids"), "ids", pa.array([None if x is None else unpacked_ids(x) for x in table.column("ids").to_pylist()], pa.binary()))

    def run(table: pa.Table) -> pa.Table:
        first = table.column(g)[0].as_py() << 32
        lengths = table.column("length").to_numpy().astype(np.int64)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        bins = Bins(lengths, limit)
        bins.search()
        for k, items in enumerate(x for x in bins.items if x):
            seq[items] = first + k
            off[items] = np.cumsum(lengths[items]) - lengths[items]
        return unpacked(table.drop_columns([g])).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from unpacked(pa.Table.from_batches([batch])).to_batches()

    full = pieces.where(F.col("length") >= limit).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = full.mapInArrow(whole, schema) if "ids" in names else full
    return keyed.groupBy(g).applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, limit: int = 2048, with_ids: bool = True, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows with their sequence and place. with_ids: the ids themselves; else only ids_crc32, the checksum of their little-endian 32-bit form.

    Null and empty texts are one piece of the end id alone; texts of any length are cut, none shortened. Rows that repeat an id are packed each on its own.
    """
    ws = Workspace(docs.sparkSession, "packing")
    return pack(ws.save(token_pieces(docs, limit, 0, path, id_col, text_col, with_ids), "pieces"), limit)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
