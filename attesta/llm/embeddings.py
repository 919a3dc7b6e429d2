"""Embedding near-dedup by collision counting on one-dimensional projections, and the vector rules that nearest neighbours share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, local_components

#: Projections, the window's half-width in standard deviations of a pair at the threshold, and the odds that such a pair is missed. A wide window lets far pairs collide more
#: often, but near ones nearly always, so that fewer projections tell them apart; these take the least time together with verifying the pairs that pass.
PROJECTIONS, WINDOW, MISS = 20, 2.5, 1e-6
#: Vectors of one side of a tile.
TILE = 2048
SEED = 20240229


def usable(c: Column) -> Column:
    """True for a vector (array<double>) that is not null or empty, has only finite components and is not zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0.0), F.lit(False))


def calibrated_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The most collisions that a pair just at the threshold has with odds of at least 1 - miss.

    On a Gaussian direction such a pair is a normal distance apart, so it collides with odds p = P(|N(0,1)| <= window), independently for each projection.
    """
    p, below = math.erf(window / math.sqrt(2)), 0.0
    for n in range(projections + 1):
        below += math.comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if below > miss:
            return n
    return projections


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def collisions(a: np.ndarray, b: np.ndarray, width: float, least: int, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that fall in each other's window in at least `least` projections.

    Each projection of b is sorted; a query's window is then a range of ranks, and a member collides if its rank lies in it.
    """
    count = np.zeros((len(a), len(b)), np.uint8)
    for pa_, pb_ in zip((a @ directions).T, (b @ directions).T):  # noqa: B905
        order = np.argsort(pb_, kind="stable")
        rank = np.empty(len(b), np.uint16)
        rank[order] = np.arange(len(b), dtype=np.uint16)
        low = np.searchsorted(pb_[order], pa_ - width, "left").astype(np.uint16)
        size = np.searchsorted(pb_[order], pa_ + width, "right").astype(np.uint16) - low
        count += (rank[None, :] - low[:, None]) < size[:, None]  # unsigned: ranks below the window wrap around
    return np.nonzero(count >= least)


def cosine_links(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(id, id2, linked): links among distinct vectors (id long, label, vec array<double>, copies long; label and vec not null).

    Rows with id2 null give linked, the number of rows that one tile pair adds to an id's links; rows with id2 give edges that connect what is linked.
    Only vectors of equal label and dimension are compared. A label's vectors are dealt to tiles of a bounded size, each pair of tiles is one task, so a label that
    holds a third of all vectors spreads over all executors. In a tile pair collisions are counted per pair and pairs with the calibrated count are verified.
    """
    spark = vectors.sparkSession
    width_of = math.sqrt(2 - 2 * threshold)
    least = calibrated_count()
    keyed = vectors.withColumn("dim", F.size("vec"))
    tiles = keyed.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = keyed.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = dealt.select("label", "dim", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), (F.col("tile") > F.col("other")).alias("second"), "id", "copies", "vec")

    def run(table: pa.Table) -> pa.Table:
        second = table.column("second").to_numpy()
        ids, copies, raw = table.column("id").to_numpy(), table.column("copies").to_numpy(), matrix(table.column("vec"))
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range of doubles
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        one = table.column("t1")[0] == table.column("t2")[0]
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
        b = a if one else b
        directions = np.random.default_rng([SEED, unit.shape[1]]).normal(size=(unit.shape[1], PROJECTIONS))
        links = []
        for at in range(0, len(a), tile):
            for to in range(0, len(b), tile):
                i, j = collisions(unit[a[at : at + tile]], unit[b[to : to + tile]], WINDOW * width_of, least, directions)
                i, j = a[at : at + tile][i], b[to : to + tile][j]
                i, j = (i[i < j], j[i < j]) if one else (i, j)
                for k in range(0, len(i), 1 << 18):  # verified exactly
                    x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                    near = np.einsum("nd,nd->n", unit[x], unit[y]) >= threshold
                    links.append((x[near], y[near]))
        i, j = (np.concatenate([x[k] for x in links] or [np.zeros(0, np.int64)]) for k in (0, 1))
        linked = np.zeros(len(ids), np.int64)
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        root = local_components(len(ids), i, j)
        own, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(linked)
        return pa.table({
            "id": np.concatenate([ids[some], ids[own]]),
            "id2": pa.array(np.concatenate([ids[some], ids[root[own]]]), mask=np.arange(len(some) + len(own)) < len(some)),
            "linked": np.concatenate([linked[some], np.zeros(len(own), np.int64)]),
        })

    return rows.groupBy("label", "dim", "t1", "t2").applyInArrow(run, "id long, id2 long, linked long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links by cosine in double precision among rows of equal, non-null label.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do rows with a null label or id. Equal vectors of a label
    become one class before pairs are compared: they link with each other, and a class of any size costs one row. Rows that repeat an id count as vectors of their own.
    Vectors of different length don't link. An empty table gives no rows. More columns are not read.
    """
    ws = Workspace(table.sparkSession, "embeddings")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = rows.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    grouped = rows.where("ok").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = ws.save(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")  # keys of their own, as an id may have several vectors
    found = ws.save(cosine_links(classes.select(F.col("class").alias("id"), "label", "vec", "copies"), threshold), "links")
    links = found.where("id2 IS NULL").groupBy(F.col("id").alias("class")).agg(F.sum("linked").alias("linked"))
    groups = ws.save(connected_components(found.where("id2 IS NOT NULL").select(F.col("id").alias("u"), F.col("id2").alias("v")), ws).withColumnRenamed("node", "class"), "groups")
    smallest = groups.join(classes.select("class", "first"), "class").groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(links, "class", "left").join(groups, "class", "left").join(smallest, "component", "left")
    named = named.select("label", "vec", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(named, ["label", "vec"], "left").select(
        "id", F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors with equal labels at a cosine of 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(u, w) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
), c AS (
    SELECT u, min(w) AS component_id FROM reach GROUP BY u
), n AS (
    SELECT u, count(*) AS n_links FROM links GROUP BY u
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id JOIN c ON c.u = v.vec_id
"""
