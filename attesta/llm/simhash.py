"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Workspace, connected_components, fresh, local_components, partitions, small_batches, text_batches

BITS = 64
#: Fingerprints that one trie node aims to hold when the join starts.
NODE = 256
#: Node pairs with more fingerprints than this are opened further before one task gets them.
OPEN = 1 << 16
#: Rows that one partition of the traversal holds on average at most.
ROWS = 1 << 18
#: Leaf buckets: a node pair whose sides hold at most so many fingerprints is compared directly.
LEAF = 8
#: Node pairs that one step of the local traversal expands, a bound on its memory.
FRONTIER = 1 << 18


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text: words by white space, A-Z lower-cased, XXH64 of each run of width words; a bit is set if it is in over half."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return int(_majorities([_shingles(words, width, seed)])[0])


def _shingles(words: list[bytes], width: int, seed: int) -> list[int]:
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return [xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, starts[width:])]  # noqa: B905


def _majorities(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints as unsigned numbers. A text without words gets zero."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes])
    at = 0
    while at < len(hashes):
        end, total = at, 0
        while end < len(hashes) and (end == at or total + sizes[end] <= 1 << 17):
            total += sizes[end]
            end += 1
        if own := [i for i in range(at, end) if sizes[i]]:
            flat = np.fromiter((x for i in own for x in hashes[i]), np.uint64, total)
            starts = np.cumsum([0, *sizes[own][:-1]])
            bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            most = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[own][:, None]
            out[own] = np.packbits(most, axis=1).view(">u8").ravel()
        at = end
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint for every row. Null text counts as empty; fingerprint zero. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            h = [_shingles((t or "").encode("utf-8", "surrogatepass").lower().split(), width, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_majorities(h).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# ---------------------------------------------------------------- the trie join


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(min(bits, budget) + 1) for c in combinations(range(bits), n)]


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def _opened(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """Rows (pa, pb, side, fp, node) of node pairs at depth, dealt to the pairs of their children step bits further down.

    A fingerprint goes on with each child of the other node that it can still be linked with: those whose bits differ from its own in no more than
    what is left of the budget. So a pair beyond the budget is never made.
    """
    used = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")))
    masks = F.lit(None).cast("array<long>")
    for n in range(budget + 1):
        masks = F.when(used == n, F.array(*[F.lit(m).cast("long") for m in _masks(step, budget - n)])).otherwise(masks)
    own = _prefix(depth + step).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    out = rows.select("*", own.alias("_x"), F.explode(masks).alias("_m")).withColumn("_y", F.col("_x").bitwiseXOR(F.col("_m")))
    same = F.col("pa") == F.col("pb")
    turned = (same & (F.col("_x") > F.col("_y"))) | (~same & (F.col("side") == 1))
    a, b = F.when(turned, F.col("_y")).otherwise(F.col("_x")), F.when(turned, F.col("_x")).otherwise(F.col("_y"))
    down = lambda p, x: F.shiftleft(p, step).bitwiseOR(x)
    return out.select(down("pa", a).alias("pa"), down("pb", b).alias("pb"), turned.cast("int").alias("side"), "fp", "node")


def _expand(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of ranges with n_a and n_b members: each combination as (pair, place in a, place in b)."""
    size = n_a * n_b
    pair = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return pair, k // n_b[pair], k % n_b[pair]


def traverse(fp: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among fingerprints by traversing pairs of trie nodes together from depth on.

    fp is unsigned, sorted inside each node. pairs has rows (a from, a to, b from, b to, bits that differ so far); a node with itself has the same range twice.
    """
    found_a, found_b = [], []
    stack = [(depth, pairs)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        t, front = stack.pop()
        if len(front) > FRONTIER:
            stack += [(t, front[k : k + FRONTIER]) for k in range(0, len(front), FRONTIER)]
            continue
        n_a, n_b = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        leaf = (np.maximum(n_a, n_b) <= LEAF) | (t == BITS)
        if leaf.any():
            own, na, nb = front[leaf], n_a[leaf], n_b[leaf]
            at = 0
            edges = np.cumsum(na * nb)
            while at < len(own):
                end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + (1 << 20), "right")))
                p, x, y = _expand(na[at:end], nb[at:end])
                i, j = own[at:end][p, 0] + x, own[at:end][p, 2] + y
                keep = (np.bitwise_count(fp[i] ^ fp[j]) <= budget) & ((own[at:end][p, 0] != own[at:end][p, 2]) | (i < j))
                found_a.append(i[keep])
                found_b.append(j[keep])
                at = end
            front = front[~leaf]
        if not len(front):
            continue
        if t not in ones:
            ones[t] = np.concatenate([[0], np.cumsum((fp >> np.uint64(BITS - 1 - t)) & np.uint64(1), dtype=np.int64)])
        a0, a1, b0, b1, used = front.T
        am, bm = a1 - (ones[t][a1] - ones[t][a0]), b1 - (ones[t][b1] - ones[t][b0])
        same = a0 == b0
        children = [(a0, am, b0, bm, used), (am, a1, bm, b1, used), (a0, am, bm, b1, used + 1), tuple(x[~same] for x in (am, a1, b0, bm, used + 1))]
        new = np.concatenate([np.stack(c, axis=1) for c in children])
        new = new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budget)]
        if len(new):
            stack.append((t + 1, new))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def _traversed(rows: DataFrame, parts: int, depth: int, budget: int) -> DataFrame:
    """(u, v): for each of so many partitions a spanning forest of the links between fingerprints of its node pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        a, b, side, fp, node = (table.column(k).to_numpy() for k in ("pa", "pb", "side", "fp", "node"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, side, b, a))
        a, b, side, fp, node = a[order], b[order], side[order], fp[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        last = np.append(first[1:], len(a))
        n_side = np.add.reduceat(side, first)
        middle = last - n_side
        used = np.bitwise_count((a[first] ^ b[first]).view(np.uint64)).astype(np.int64)
        same = a[first] == b[first]
        pairs = np.stack([first, np.where(same, last, middle), np.where(same, first, middle), last, used], axis=1)
        pairs = pairs[same | ((middle > first) & (middle < last))]
        i, j = traverse(fp, pairs, depth, budget)
        ids, at = np.unique(node, return_inverse=True)
        root = local_components(len(ids), at[i], at[j])
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["u", "v"])

    return rows.repartition(parts, "pa", "pb").mapInArrow(run, "u long, v long")


def hamming_links(classes: DataFrame, budget: int = 2, node: int = NODE, most: int = OPEN) -> DataFrame:
    """(u, v): edges that connect all node ids of classes (fp: distinct long, node: long) whose fingerprints differ in at most budget bits.

    The trie is opened to a depth that follows the number of fingerprints; pairs of its nodes within the budget become tasks, in each of which the pairs are
    traversed together bit by bit. Pairs that hold more than `most` fingerprints are opened a further 8 bits, again and again, so that a dense region never
    becomes one task. Edges are a spanning forest per task: every linked pair ends up connected; not every link is returned.
    """
    n = classes.count()
    # every fingerprint meets those of all nodes within the budget; partitions follow that number, so that none grows with the input
    spread = lambda depth: max(partitions(classes.sparkSession), math.ceil(n * len(_masks(depth, budget)) / ROWS))
    depth = min(24, max(0, math.ceil(math.log2(max(1, n) / node))))
    rows = classes.select(F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.lit(0).alias("side"), "fp", "node")
    rows = _opened(rows, 0, depth, budget) if depth else rows
    out = None
    while True:
        big = classes.groupBy(_prefix(depth).alias("p")).count().where(F.col("count") * 2 > most).select("p") if depth < BITS else None
        if big is None or big.isEmpty():
            found = _traversed(rows, spread(depth), depth, budget)
            return found if out is None else out.unionByName(found)
        mark = lambda df, side: df.join(big.select(F.col("p").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
        marked = mark(mark(rows, "pa"), "pb").withColumn("_big", F.coalesce("_pa", "_pb", F.lit(False)))
        done = _traversed(marked.where(~F.col("_big")).select(rows.columns), spread(depth), depth, budget)
        out = done if out is None else out.unionByName(done)
        step = min(8, BITS - depth)
        rows = _opened(marked.where("_big").select(rows.columns), depth, step, budget)
        depth += step


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row of docs: near-duplicates share the smallest id they reach by links.

    Equal fingerprints become one class before anything is joined, so a group of copies costs one row however large it is. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with a null id have a null component and link nothing. Rows that repeat an id keep their own fingerprints.
    Words split at white space; texts are read whole. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "simhash")
    with small_batches(spark):
        prints = ws.save(fingerprints(docs, id_col, text_col, width), "prints")
    classes = ws.save(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "classes")
    groups = connected_components(hamming_links(classes, budget), ws)
    named = classes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their group of near-duplicates. Rows with a null id stay, and an id whose rows differ stays if one of them does. All columns stay as they are."""
    found = simhash_components(docs, id_col, text_col)
    gone = found.groupBy("id").agg(F.min(F.col("id") != F.col("component_id")).alias("gone")).where("gone").select(F.col("id").alias(fresh(docs.columns, "gone")))
    return docs.join(gone, docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti").select(docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents, on shingles of three words and two differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
