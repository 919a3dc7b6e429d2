"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Workspace, byte_class, small_batches, text_batches
from .kneser_ney import held_out

#: Labelled rows, the trusted positives, that the model is fitted on at most. Unlabelled rows all count; so many of them give a first fit, and the curvature that steps are scaled by.
SAMPLE = 10_000
#: Score from which a text counts as good.
KEEP = 0.3
#: The ridge; the steps that a first fit takes on the bounded sample, and their length; the fall of the risk that a step on all rows has to promise.
SEED, RIDGE, FIRST, RATE, FLAT = 7, 1e-3, 300, 0.05, 1e-9
#: Bytes whose features are made at once.
_CHUNK = 1 << 20

#: Classes of bytes; what is left is "other".
_CLASSES = [
    byte_class((0x61, 0x7A)), byte_class((0x41, 0x5A)), byte_class((0x30, 0x39)), byte_class((0x20, 0x20)), byte_class((0x0A, 0x0A)), byte_class((0x09, 0x09), (0x0B, 0x0D)),
    byte_class((0x2E, 0x2E)), byte_class((0x2C, 0x2C)), byte_class((0x21, 0x21), (0x3F, 0x3F)), byte_class((0x23, 0x26), (0x2A, 0x2B)), byte_class((0x7C, 0x7C)), byte_class((0x27, 0x29), (0x22, 0x22)),
    byte_class((0x3C, 0x3E), (0x7B, 0x7B), (0x7D, 0x7D), (0x5B, 0x5D)), byte_class((0xC0, 0xFF)), byte_class((0x80, 0xBF)),
]
N_CLASSES = len(_CLASSES) + 1
_TABLE = np.full(256, N_CLASSES - 1, np.uint8)
for _k, _c in enumerate(_CLASSES):
    _TABLE[_c] = _k
N_FEATURES = 128 + N_CLASSES + N_CLASSES**2 + 5


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each whole text: shares of ASCII bytes, of byte classes and of their successions, length, words, repeated lines and words. Null is empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), N_FEATURES), np.float32)
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= _CHUNK):
            size += len(raw[end])
            end += 1
        n = end - at
        sizes = np.array([len(x) for x in raw[at:end]])
        a = np.frombuffer(b"".join(raw[at:end]), np.uint8)
        doc = np.repeat(np.arange(n), sizes)
        c = _TABLE[a].astype(np.int64)
        of_byte = np.bincount(doc * 256 + a, minlength=n * 256).reshape(n, 256)[:, :128]
        of_class = np.bincount(doc * N_CLASSES + c, minlength=n * N_CLASSES).reshape(n, -1)
        same = doc[1:] == doc[:-1]
        pairs = (doc[1:] * N_CLASSES + c[:-1])[same] * N_CLASSES + c[1:][same]
        of_pair = np.bincount(pairs, minlength=n * N_CLASSES**2).reshape(n, -1)
        total = np.maximum(1, sizes)[:, None]
        out[at:end, :-5] = np.sqrt(np.concatenate([of_byte, of_class, of_pair], axis=1) / total)
        at = end
    for k, x in enumerate(raw):
        lines, words = [y for y in x.split(b"\n") if y.strip()], x.split()
        out[k, -5:] = (
            np.log1p(len(x)) / 10, np.log1p(len(words)) / 10, min(4, len(x) / (10 * max(1, len(words)))),
            1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, len(words)),
        )
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(_standard(features(texts), self.mean, self.scale) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


class Unlabelled:
    """Unlabelled rows: sums over all of them, wherever they are, and a bounded sample. half is true for those that tell the samples apart, false for those that the prior comes from."""

    def __init__(self, x: np.ndarray, half: np.ndarray) -> None:
        self.x, self.half, self.sample = x, half, self

    def total(self, size: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of f(rows, half), an array of so many numbers, over all rows."""
        return f(self.x.astype(float), self.half) if len(self.x) else np.zeros(size)


class Table(Unlabelled):
    """The same of a written table (x binary of 16-bit floats, half boolean): every sum is a pass over it, and only the sum comes to the driver."""

    def __init__(self, table: DataFrame, sample: Unlabelled) -> None:
        self.table, self.sample = table, sample

    def total(self, size: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    out += f(_rows(part.column("x")), part.column("half").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], ["k", "v"])

        found = self.table.select("x", "half").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # so many numbers
        out = np.zeros(size)
        out[found.column("k").to_numpy()] = found.column("v").to_numpy()
        return np.array([float(f"{v:.10e}") for v in out])  # sums of any order are the same to ten digits


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(float)


def _logistic(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logistic loss of outputs as bad, and its slope."""
    return np.logaddexp(0, z), _sigmoid(z)


def _bounded(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sigmoid loss of outputs as bad, and its slope."""
    s = _sigmoid(z)
    return s, s * (1 - s)


@dataclass(frozen=True)
class Risk:
    """A risk of standardised positives and unlabelled rows, for outputs z; its slope; and steps to where it is least.

    Without a prior it tells the two samples apart: the logistic loss, mean softplus(-z) of positives plus mean softplus(z) of unlabelled rows. With a prior it is the non-negative
    risk with the sigmoid loss: prior * mean s(-z) of positives + max(0, rest), where rest is mean s(z) of unlabelled rows - prior * mean s(z) of positives. Unlabelled rows are
    summed where they are, those of a half alone if that is given. A ridge is added.
    """

    unlabelled: Unlabelled
    mean: np.ndarray
    scale: np.ndarray
    positive: np.ndarray
    prior: float | None = None
    half: bool | None = None

    def _far(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        half, mean, scale, losses = self.half, self.mean, self.scale, _logistic if self.prior is None else _bounded

        def f(x: np.ndarray, halves: np.ndarray) -> np.ndarray:
            x = _standard(x if half is None else x[halves == half], mean, scale)
            loss, slope = losses(x @ w[:-1] + w[-1])
            return np.concatenate([[len(x), loss.sum()], x.T @ slope, [slope.sum()]])

        n, loss, *slope = self.unlabelled.total(len(w) + 2, f)
        return loss / max(1, n), np.array(slope) / max(1, n)

    def parts(self, w: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """What is always counted, and its slope; what counts where it is above zero (nothing, without a prior), and its slope."""
        far, slope = self._far(w)
        x, n = np.append(self.positive.T, np.ones((1, len(self.positive))), axis=0), max(1, len(self.positive))
        z = w @ x
        ridge = RIDGE / 2 * w[:-1] @ w[:-1], np.append(RIDGE * w[:-1], 0)
        losses = _logistic if self.prior is None else _bounded
        good, down = losses(-z)
        if self.prior is None:
            return far + good.sum() / n + ridge[0], slope - x @ down / n + ridge[1], 0.0, np.zeros_like(w)
        bad, up = losses(z)
        return self.prior * good.sum() / n + ridge[0], ridge[1] - self.prior * (x @ down) / n, far - self.prior * bad.sum() / n, slope - self.prior * (x @ up) / n

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad, rest, slope = self.parts(w)
        return value + max(0.0, rest), grad + slope * (rest >= 0)

    def _curvature(self, w: np.ndarray) -> np.ndarray:
        """How steps are scaled, from the sample and the positives: where they end doesn't depend on it."""
        out = np.diag(np.append(np.full(len(w) - 1, RIDGE), 1e-6))
        for x in (_standard(self.unlabelled.sample.x.astype(float), self.mean, self.scale), self.positive):
            if len(x):
                x = np.column_stack([x, np.ones(len(x))])
                s = _sigmoid(x @ w)
                out += (x * (s * (1 - s) + 1e-4)[:, None]).T @ x / len(x)
        return out

    def first(self) -> np.ndarray:
        """A fit on the sample alone, by Adam from zero."""
        risk = replace(self, unlabelled=self.unlabelled.sample)
        w = np.zeros(self.positive.shape[1] + 1)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, FIRST + 1):
            g = risk.at(w)[1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    def least(self, flat: float = FLAT) -> np.ndarray:
        """From the first fit on, steps by the risk of all rows until none promises to lower it by more than `flat`, on the bend as elsewhere.

        A step is shortened until the risk falls by a part of what its model promises, and the curvature learns from the slopes met on the way (a damped secant update, so it stays
        positive). The risk isn't below zero and each step lowers it, so they end by themselves; the other end is a step so short that the sums' ten digits don't show it.
        """
        w = self.first()
        curve, found = self._curvature(w), self.parts(w)
        while True:
            step, share, fall = modelled(curve, found)
            if fall <= flat:
                return w
            value, length = found[0] + max(0.0, found[2]), 1.0
            while (new := self.parts(w + length * step))[0] + max(0.0, new[2]) > value - 0.1 * length * fall:
                length /= 4
                if length * fall < 1e-11:
                    return w
            moved, turned = length * step, new[1] - found[1] + share * (new[3] - found[3])
            bent = curve @ moved
            if (met := moved @ turned) < 0.2 * (own := moved @ bent):
                turned = bent + 0.8 * own / (own - met) * (turned - bent)
            curve = curve - np.outer(bent, bent) / own + np.outer(turned, turned) / (moved @ turned)
            w, found = w + moved, new


def modelled(curve: np.ndarray, found: tuple[float, np.ndarray, float, np.ndarray]) -> tuple[np.ndarray, float, float]:
    """The step to where the risk's model is least, the share of the rest's slope in it, and how far the model falls. The model has slopes and a curvature, and keeps the bend.

    It is least on one side of the bend, or on it: there the slope of the rest counts by the share that brings the rest to zero.
    """
    _, grad, rest, slope = found
    down, side = np.linalg.solve(curve, np.column_stack([grad, slope])).T
    along = slope @ side
    share = float(np.clip((rest - slope @ down) / along, 0, 1)) if along > 0 else 0.0
    step = -(down + share * side)
    return step, share, max(0.0, rest) - (grad @ step + step @ curve @ step / 2 + max(0.0, rest + slope @ step))


#: Shares of the positives below the cuts where the prior's ratios are taken.
CUTS = np.linspace(0.02, 0.9, 45)


def cuts_of(positive: np.ndarray) -> np.ndarray:
    order = np.sort(positive)
    return order[(CUTS * (len(order) - 1)).astype(int)] if len(order) else np.zeros(0)


def estimated_prior(positive: np.ndarray, n_u: int, above: np.ndarray) -> float:
    """The share of positives among n_u unlabelled rows, from scores of a model that tells the two samples apart; above has how many of these rows reach each of the cuts.

    Where only positives score, the unlabelled reach a score as often as the positives do times the prior. So the prior is at most the least ratio of the two
    tails; each tail needs enough rows to be trusted, and an allowance for chance is added before the minimum is taken.
    """
    n_p = len(positive)
    if not n_p or not n_u:
        return 0.5
    share_p, share_u = (n_p - np.searchsorted(np.sort(positive), cuts_of(positive))) / n_p, above / n_u
    slack = np.sqrt(np.log(40) / (2 * n_u)) + np.sqrt(np.log(40) / (2 * n_p))
    return float(np.clip(min(1.0, ((share_u + slack) / share_p - slack).min()), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: Unlabelled, flat: float = FLAT) -> QualityModel:
    """Minimise the non-negative risk: prior * risk of positives as good + max(0, risk of unlabelled as bad - prior * risk of positives as bad).

    The prior comes from the scores of a model that tells the two samples apart, on rows that it has not seen. Without positives or unlabelled rows nothing can be learned:
    every text then scores a half. The risk isn't convex: the fit is the least point that steps from the first fit lead to, and a smaller `flat` than the default moves scores by less than 0.01.
    """
    dim = N_FEATURES
    sums = unlabelled.total(2 * dim + 1, lambda x, _: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])) if len(positive) else np.zeros(1)
    if not len(positive) or not sums[0]:
        return QualityModel(np.zeros(dim), 0.0, np.zeros(dim), np.ones(dim), 0.5)
    mean = sums[1 : dim + 1] / sums[0]
    scale = np.sqrt(np.maximum(0, sums[dim + 1 :] / sums[0] - mean**2)) + 1e-3
    p = _standard(positive.astype(float), mean, scale)
    half = np.random.default_rng(SEED).random(len(p)) < 0.5
    apart = Risk(unlabelled, mean, scale, p[half], None, True).least(flat)

    def counted(x: np.ndarray, halves: np.ndarray) -> np.ndarray:
        z = _standard(x[~halves], mean, scale) @ apart[:-1] + apart[-1]
        return np.append((z[:, None] >= cuts).sum(axis=0), len(z)).astype(float)

    scores = p[~half] @ apart[:-1] + apart[-1]
    cuts = cuts_of(scores)
    *above, n_u = unlabelled.total(len(cuts) + 1, counted)
    prior = estimated_prior(scores, int(n_u), np.array(above))
    w = Risk(unlabelled, mean, scale, p, prior).least(flat)
    return QualityModel(w[:-1], float(w[-1]), mean, scale, prior)


def train(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit a model on at most `sample` trusted positives and all unlabelled texts among the rows where the condition `learn` on the id holds.

    Ids with labels that contradict each other are neither; labels of zero are never used, nor are rows with a null id. The positives are drawn by a hash of the id, so they don't
    depend on order. Texts become rows of features where they are read; only those are shuffled, to meet the labels, and written for the passes of the fit.
    Null and empty texts are texts like any other. Empty tables give the model that scores a half.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "quality")
    key = F.col(id_col).cast("long").alias("id")
    known = labels.select(key, F.col(label_col).alias("y")).where("y IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("y").alias("low"), F.max("y").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in features(texts).astype(np.float16)], pa.binary())], ["id", "x"])

    rows = docs.where(learn).select(key, F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    kind = F.when(F.col("high").isNull(), 0).when((F.col("low") == 1) & (F.col("high") == 1), 1)
    half = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(2)) == 0
    with small_batches(spark):
        made = rows.mapInArrow(run, "id long, x binary").join(known, "id", "left").select("id", "x", kind.alias("kind"), half.alias("half")).where("kind IS NOT NULL")
        table = ws.save(made, "features")
        drawn = lambda k: table.where(F.col("kind") == k).orderBy(F.xxhash64("id", F.lit(SEED)), "id", "x").limit(sample).select("x", "half").toArrow()  # noqa: E731  # at most `sample` rows
        positive, some = drawn(1), drawn(0)
        first = Unlabelled(_rows(some.column("x")), some.column("half").to_numpy())
        return fit(_rows(positive.column("x")), Table(table.where("kind = 0"), first))


def scored(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, by its whole text alone. Null and empty texts are scored like any other; rows that repeat an id stay apart; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(texts).astype(float))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """The rows of docs that score at least the threshold, with all columns as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        import pandas as pd

        texts = [t if isinstance(t, str) else None for t in text]
        return pd.Series(np.concatenate([model.score(texts[k : k + BATCH_ROWS]) for k in range(0, len(texts), BATCH_ROWS)] or [np.zeros(0)]))

    return docs.where(score(F.col(text_col)) >= threshold)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, ~held_out("doc_id", 0))
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
