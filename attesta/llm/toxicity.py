"""Toxicity by compression distance: windows of a text under a dictionary of toxic and one of ordinary text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_batches
from .kneser_ney import held_out

#: Labelled rows of each label, and bytes of their texts, that the model is fitted on at most. Every text is scored.
SAMPLE, SAMPLE_BYTES = 2_500, 16 << 20
#: Score from which a text counts as toxic.
TOXIC = 0.5
#: Words of a window, and bytes that one of its words has at most (longer words fill several places).
WORDS, WORD_BYTES = 6, 64
#: Bytes of ordinary text that both dictionaries begin with, and of toxic text at most.
BASE, PART = 64 << 10, 2 << 10
#: Bytes of the pieces whose documents are counted.
PIECE = 5
#: Pieces that prove less than this share of what the surest proves aren't learned.
WEAK = 0.05
#: Window gains, in bytes, whose numbers of windows a document's score is made of.
GAINS = (2, 3, 4, 5, 6, 8)
#: Windows that a text is thought to have beside its own, so that one window of a short text proves little.
FEW, MANY = 8, 64
SEED, RIDGE = 13, 1e-5
#: How zstandard looks for matches.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 5, "window_log": 18, "chain_log": 15, "hash_log": 15, "search_log": 2}
#: What ends each window and each dictionary. It begins no match within a text, gives every window something to save, and keeps the last bytes, in which zstandard looks for no match, free of words.
_TAIL = b" \n#~end~# \n \n#~end~# \n"
_WINDOW = re.compile(rb"(?:[^ ]{1,%d} ?){1,%d}" % (WORD_BYTES, WORDS))


def normalised(text: str | None) -> bytes:
    """A text's bytes with A-Z lower-cased and one space for white space. Null is empty."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def windows(data: bytes) -> list[bytes]:
    """The windows of a normalised text: its words, WORDS at a time."""
    return [b" " + w.rstrip(b" ") + _TAIL for w in _WINDOW.findall(data)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Frames without headers, so that lengths differ by what the dictionary saves."""
    options = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0,
        **SEARCH,
    )
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=options)


# ---------------------------------------------------------------- dictionaries


def _pieces(data: bytes) -> np.ndarray:
    """Every run of PIECE bytes as a number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - PIECE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(PIECE):
        out = (out << np.uint64(8)) | a[k : k + n]
    return out


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values in the sorted table, those it lacks left out."""
    if not len(table):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at[table[at] == values]


def _evidence(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of toxic texts, sorted, and how surely each stands in more toxic than ordinary documents: twice the log-likelihood ratio, zero where chance among so many pieces reaches it."""
    own = [np.unique(_pieces(t)) for t in toxic]
    table, a = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
    b = np.zeros(len(table), np.int64)
    for t in ordinary:
        b[_places(table, np.unique(_pieces(t)))] += 1
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    share = (a + b) / (n + m)
    log = lambda x, y: x * np.log(np.maximum(x, 1e-300) / y)
    score = 2 * (log(a, n * share) + log(b, m * share))
    inner = np.zeros(len(table), bool)  # a piece of two words tells no more than those of one
    for k in range(1, PIECE - 1):
        inner |= (table >> np.uint64(8 * k)) & np.uint64(255) == 32
    good = (a * m > 2 * b * n) & ~inner & (score > 2 * np.log(max(2, len(table))))
    return table, np.where(good & (score > WEAK * score[good].max(initial=0.0)), score, 0.0)


def dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes], size: int = PART) -> tuple[bytes, bytes]:
    """(ordinary, toxic): the same ordinary windows, then as many bytes of other ordinary windows in the one as of toxic stretches in the other, so that lengths differ by those alone.

    A toxic stretch is a run of pieces that mark toxic documents; stretches come by what they prove for each byte, and only for pieces that those before them lack. Ordinary
    windows hold no such piece.
    """
    table, score = _evidence(toxic, ordinary)
    found: dict[bytes, np.ndarray] = {}
    for t in toxic:
        at = np.searchsorted(table, _pieces(t))
        hot = np.flatnonzero(score[at]) if len(at) else at
        for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else ():
            found[t[run[0] : run[-1] + PIECE]] = np.unique(at[run])
    worth = {t: score[own].sum() for t, own in found.items()}
    out, used, seen = [], 0, np.zeros(len(table), bool)
    for text in sorted(found, key=lambda t: (-worth[t] / (len(t) + 4), t)):
        own = found[text]
        if score[own[~seen[own]]].sum() * 2 >= worth[text] and used + len(text) + 1 <= size:
            seen[own] = True
            out.append(text)
            used += len(text) + 1
    part = b"".join(x + b"\n" for x in reversed(out))
    base, rest = [], []
    room, spare = BASE, len(part)
    for w in (w[: -len(_TAIL)] for t in ordinary for w in windows(t)):
        if score[_places(table, _pieces(w))].any():
            continue
        if room > 0:
            base.append(w)
            room -= len(w)
        elif spare > 0:
            rest.append(w[:spare])
            spare -= len(rest[-1])
        else:
            break
    head = b"".join(base)
    return head + b"\n" * spare + b"".join(rest) + _TAIL, head + part + _TAIL


# ---------------------------------------------------------------- scores


class Distance:
    """Compressed lengths under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def gains(self, data: bytes) -> np.ndarray:
        """For each window of a normalised text the bytes that the toxic dictionary saves against the ordinary one."""
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(w)) - len(b(w)) for w in windows(data)], np.int64)


def counted(gains: np.ndarray) -> np.ndarray:
    """A row of shares of windows: those that gain so much, against few and against many windows that don't, and those that lose so much. Shares keep to the same range however long a text is."""
    n = len(gains)
    up = np.array([(gains >= g).sum() for g in GAINS])
    down = np.array([(gains <= -g).sum() for g in GAINS])
    return np.sqrt(np.concatenate([up / (n + FEW), up / (n + MANY), down / (n + MANY), [n / (n + MANY)]]))


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries, and the calibration of window counts to a score."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        d = self.__dict__.get("_distance") or Distance(self.ordinary, self.toxic)
        object.__setattr__(self, "_distance", d)
        return np.array([1 / (1 + np.exp(-float(np.clip(counted(d.gains(normalised(t))) @ self.weights + self.bias, -50, 50)))) for t in texts])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_distance"}


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression of weighted rows, by Newton's steps to a slope of 1e-9."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    loss = lambda v: weight @ (np.logaddexp(0, z @ v) - y * (z @ v)) + (penalty * v * v).sum() / 2
    while True:
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (weight * (p - y)) + penalty * w
        if np.abs(slope).max() < 1e-9:
            break
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        size, before = 1.0, loss(w)
        while loss(w - size * step) > before and size > 1e-10:
            size /= 2
        if size <= 1e-10:
            break
        w = w - size * step
    return w[:-1], float(w[-1])


def threshold(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where, among values of weighted rows, calling those from it on toxic has the best F1; half way to the next value, and 0 if nothing is toxic."""
    order = np.argsort(-value, kind="stable")
    v, hit, called = value[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    last = np.flatnonzero(np.append(v[1:] < v[:-1], True))
    f1 = 2 * hit[last] / (called[last] + hit[-1])
    at = last[int(np.argmax(f1))]
    return float((v[at] + v[min(at + 1, len(v) - 1)]) / 2) if hit[-1] > 0 else 0.0


def fit(toxic: Sequence[bytes], ordinary: Sequence[bytes], share: float | None = None) -> ToxicityModel:
    """A model of normalised texts, of which so many are toxic in truth (None: as here). Windows are calibrated on each half of the texts under the dictionaries of the other half; the model's own
    dictionaries are made of both. A score of a half is where calling texts toxic has the best F1."""
    n, m = len(toxic), len(ordinary)
    share = n / max(1, n + m) if share is None else share
    if not n or not m:
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return ToxicityModel(_TAIL, _TAIL, np.zeros(len(GAINS) * 3 + 1), float(np.log(share / (1 - share))))
    rows: dict[tuple[int, int], np.ndarray] = {}
    for half in (0, 1):
        d = Distance(*dictionaries(toxic[1 - half :: 2], ordinary[1 - half :: 2]))
        for kind, texts in ((1, toxic), (0, ordinary)):
            rows |= {(kind, k): counted(d.gains(t)) for k, t in enumerate(texts) if k % 2 == half}
    x = np.array([rows[1, k] for k in range(n)] + [rows[0, k] for k in range(m)])
    y, weight = np.repeat([1.0, 0.0], [n, m]), np.repeat([share / n, (1 - share) / m], [n, m])
    weights, bias = calibrated(x, y, weight)
    return ToxicityModel(*dictionaries(toxic, ordinary), weights, bias - threshold(x @ weights + bias, y, weight))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model of the rows of docs for which learn holds and whose id has one label, 0 or 1.

    At most SAMPLE rows of each label, first by a hash of their id, and of these at most SAMPLE_BYTES of text, come to the driver. Null texts are empty; ids that are
    null or have both labels teach nothing. Scores follow the share of label 1 among all rows that
    count; without rows of both labels every score is that share.
    """
    key = F.col(id_col).cast("long").alias("id")
    known = labels.select(key, F.col(label_col).alias("y")).where("y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").select("id", "y")
    rows = docs.where(learn)
    taught = rows.select(key).groupBy("id").agg(F.count("*").alias("n")).join(known, "id")
    counts = {y: n for y, n in taught.groupBy("y").agg(F.sum("n")).toLocalIterator()}  # at most two rows
    order = F.xxhash64("id", F.lit(SEED))

    def drawn(label: int) -> list[bytes]:
        out, size = [], 0
        own = F.broadcast(taught.where(F.col("y") == label).orderBy(order, "id").limit(SAMPLE).select("id"))  # ids alone are joined and sorted, so that only the sample's texts move
        texts = rows.select(key, F.col(text_col).cast("string").alias("text")).join(own, "id").orderBy(order, "id", "text").limit(SAMPLE)
        for (text,) in texts.select("text").toLocalIterator():
            out.append(normalised(text))
            size += len(out[-1])
            if size > SAMPLE_BYTES:
                break
        return out

    return fit(drawn(1), drawn(0), counts.get(1, 0) / max(1, sum(counts.values())))


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, by its whole text alone. Null and empty texts are scored as texts without windows; rows that repeat an id stay apart; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(texts), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        return rows.mapInArrow(run, "id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 mod 5 is not 0."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, train(docs, labels, ~held_out("doc_id", 0))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
