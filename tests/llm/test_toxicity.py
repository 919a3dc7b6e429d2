import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from attesta.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, y int"
WORDS = ["river", "Mountain", "quiet", "evening", "letters", "harbour", "we", "the", "of", "lantern", "winter", "garden", "and", "kettle"]
INSULTS = ["blockhead", "scoundrel", "nincompoop", "wretch", "grumbolt"]


def docs(n=400, seed=2):
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        own = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.randint(40, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(max(3, len(own) // 25)):
                own.insert(rng.randrange(len(own)), rng.choice(INSULTS).title())
        out.append((i, " ".join(own) + ".", "x", 0))
        if rng.random() < 0.8:
            labels.append((i, int(bad)))
    return out, labels


def test_held_out_toxic_texts_are_caught_and_clean_ones_left(spark):
    rows, labels = docs()
    frame = spark.createDataFrame([*rows, (None, None, "x", 0), (9999, "", "x", 0), (5, rows[30][1], "twice", 0)], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1), (1, None), (7, 1), (7, 0)], "doc_id long, toxic int")
    model = T.train(frame, marks, F.col("doc_id") % 5 != 0)
    got = T.scored(frame, model).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got if r.id is not None and r.id < 400 and r.id != 5}
    held = [i for i in by if i % 5 == 0]
    assert np.mean([by[i] >= T.TOXIC for i in held if i % 6 == 0]) > 0.9 and not any(by[i] >= T.TOXIC for i in held if i % 6)
    assert sorted(r.score >= T.TOXIC for r in got if r.id == 5) == [False, True]  # rows that repeat an id are scored apart
    assert all(r.score < T.TOXIC for r in got if r.id in (None, 9999))
    again = T.train(frame.repartition(7), marks, F.col("doc_id") % 5 != 0)
    assert again.toxic == model.toxic and np.allclose(again.weights, model.weights)


def test_scores_are_those_of_window_lengths_by_plain_compression():
    rows, _ = docs(60, 5)
    toxic, ordinary = [T.normalised(t) for i, t, *_ in rows if i % 6 == 0], [T.normalised(t) for i, t, *_ in rows if i % 6]
    model = T.fit(toxic, ordinary)
    assert len(model.toxic) == len(model.ordinary) and all(w.encode() in model.toxic and w.encode() not in model.ordinary for w in INSULTS)
    text = rows[0][1]
    words = text.lower().split()
    gains = []
    for k in range(0, len(words), T.WORDS):
        data = (" " + " ".join(words[k : k + T.WORDS])).encode() + T._TAIL
        sizes = []
        for d in (model.ordinary, model.toxic):
            frame = T.compressor(d).compress(data)
            back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            assert back.decompress(frame, max_output_size=4096) == data
            sizes.append(len(frame))
        gains.append(sizes[0] - sizes[1])
    assert T.Distance(model.ordinary, model.toxic).gains(T.normalised(text)).tolist() == gains
    expected = 1 / (1 + np.exp(-(T.counted(np.array(gains)) @ model.weights + model.bias)))
    assert np.isclose(model.score([text])[0], expected)


def test_whole_texts_count_and_long_ones_pass(spark):
    rows, _ = docs(120, 7)
    model = T.fit([T.normalised(t) for i, t, *_ in rows if i % 6 == 0], [T.normalised(t) for i, t, *_ in rows if i % 6])
    clean = " ".join(t for i, t, *_ in rows if i % 6) + " "
    late = clean * 3 + " ".join(INSULTS * 400)
    once = T.normalised("é" * 300_000)
    assert len(T.windows(once)) == -(-600_000 // (T.WORDS * T.WORD_BYTES)) and b"".join(w[1 : -len(T._TAIL)] for w in T.windows(once)) == once
    frame = spark.createDataFrame([(1, late), (2, clean * 3), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.id: r.score for r in T.scored(frame, model).collect()}
    assert got[1] >= T.TOXIC > max(got[2], got[3])


def test_dictionary_pieces_against_counts():
    toxic, ordinary = [b"a blockhead here", b"the blockhead there", b"blockhead"] * 8, [b"a kettle here", b"the kettle there", b"kettle"] * 8
    table, score = T._evidence(toxic, ordinary)
    names = {int(v).to_bytes(T.PIECE, "big"): s for v, s in zip(table, score, strict=True)}
    assert names[b"block"] > 0 and names[b"khead"] > 0 and names.get(b" here", 0) == 0
    n = 24
    expected = 2 * (n * np.log(n / (n * n / (2 * n))))
    assert np.isclose(names[b"block"], expected)


def test_no_labels_no_rows(spark):
    empty, marks = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = T.train(empty, marks, F.lit(True))
    assert T.scored(empty, model).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert T.scored(some, model).first().score < T.TOXIC
    only = T.train(some, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True))
    assert T.scored(some, only).first().score > 0.99


def test_threshold_is_the_best_by_brute_force():
    rng = np.random.default_rng(3)
    v, y, w = rng.normal(size=40).round(1), (rng.random(40) < 0.4).astype(float), rng.random(40)
    cut = T.threshold(v, y, w)
    f1 = lambda c: 2 * (w * y)[v >= c].sum() / (w[v >= c].sum() + (w * y).sum())
    assert np.isclose(f1(cut), max(f1(c) for c in np.concatenate([v - 1e-6, v + 1e-6])))
