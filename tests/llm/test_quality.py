import random

import numpy as np
from pyspark.sql import functions as F

from attesta.llm.quality import FLAT, N_FEATURES, RIDGE, Risk, Table, Unlabelled, _standard, cuts_of, estimated_prior, features, fit, keep_good, modelled, scored, train

SCHEMA = "doc_id long, text string, score string, y int"


def docs(n=600):
    rng = random.Random(2)
    words = ["river", "Mountain", "quiet", "evening", "letters", "we", "the", "of", "harbour"]
    out, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        text = " ".join(own) + "." if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in own)
        out.append((i, text, "x", 0))
        if rng.random() < 0.4:
            labels.append((i, int(good), 0))
    return out, labels


def test_held_out_accuracy(spark):
    rows, labels = docs()
    frame = spark.createDataFrame([*rows, (None, None, "x", 0), (9999, "", "x", 0)], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = train(frame, marks, F.col("doc_id") % 5 != 0)
    truth = {i: "!!" not in t and "$$$" not in t and "###" not in t for i, t, *_ in rows}
    got = {r.id: r.score for r in scored(frame, model).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in truth if i % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in held]) > 0.97
    assert 0.65 < model.prior < 0.95
    again = train(frame.repartition(7), marks, F.col("doc_id") % 5 != 0)
    assert np.allclose(again.weights, model.weights, atol=1e-6)
    kept = keep_good(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_labels_of_zero_change_nothing(spark):
    rows, labels = docs(200)
    frame = spark.createDataFrame(rows, SCHEMA)
    make = lambda y: spark.createDataFrame(y, "doc_id long, quality int")
    positive = [(i, 1) for i, q, _ in labels if q == 1]
    a = train(frame, make(positive), F.lit(True))
    assert a.weights.any()
    b = train(frame, make([*positive, *[(10_000 + k, 0) for k in range(50)]]), F.lit(True))
    assert np.array_equal(a.weights, b.weights)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "x", "", 0)], SCHEMA)
    model = train(frame, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert [r.score for r in scored(frame, model).collect()] == [0.5]
    assert scored(frame.limit(0), model).count() == 0 and fit(np.zeros((0, N_FEATURES)), Unlabelled(np.zeros((0, N_FEATURES)), np.zeros(0, bool))).prior == 0.5


def test_features_read_whole_texts():
    a, b = features(["a" * 3_000_000, "a" * 2_999_999 + "|"])
    assert a.shape == (N_FEATURES,) and not np.array_equal(a, b)
    assert np.isfinite(features([None, "", "\x00", "é" * 10])).all()


def test_prior():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 1600)
    u, q = np.concatenate([p[:2400], n]), rng.normal(2, 1, 4000)
    assert abs(estimated_prior(q, len(u), (u[:, None] >= cuts_of(q)).sum(axis=0)) - 0.6) < 0.08
    assert estimated_prior(np.zeros(0), 5, np.zeros(0)) == 0.5


def test_risk_by_hand():
    """Two unlabelled rows and one positive of one feature each, written out: the non-negative risk on both sides of its bend, and the one that tells samples apart."""
    pad = lambda v: np.concatenate([[v], np.zeros(2)])
    x, p, w = np.array([pad(1.0), pad(-2.0)]), np.array([pad(0.5)]), np.array([0.7, 0.0, 0.0, 0.1])
    s, sp = lambda z: 1 / (1 + np.exp(-z)), lambda z: np.log1p(np.exp(z))
    rows, ridge = Unlabelled(x, np.array([True, False])), RIDGE / 2 * 0.49
    for prior in (0.6, 0.95):  # outputs are 0.8 and -1.3, and 0.45 of the positive
        risk = Risk(rows, np.zeros(3), np.ones(3), p, prior)
        rest = (s(0.8) + s(-1.3)) / 2 - prior * s(0.45)
        assert (rest > 0) == (prior == 0.6) and abs(risk.at(w)[0] - (prior * s(-0.45) + max(0, rest) + ridge)) < 1e-12
    apart = Risk(rows, np.zeros(3), np.ones(3), p, None, True)
    assert abs(apart.at(w)[0] - (sp(0.8) + sp(-0.45) + ridge)) < 1e-12
    for risk in (Risk(rows, np.zeros(3), np.ones(3), p, 0.6), Risk(rows, np.zeros(3), np.ones(3), p, 0.95), apart):
        for k in range(4):
            step = np.eye(4)[k] * 1e-6
            assert abs((risk.at(w + step)[0] - risk.at(w - step)[0]) / 2e-6 - risk.at(w)[1][k]) < 1e-6


def test_the_fit_has_the_least_non_negative_risk(spark):
    """No weights near by have a smaller non-negative risk, nor has plain descent from many starts; a written table gives the same model as rows in memory."""
    rows, labels = docs(400)
    good = {i for i, q, _ in labels if q}
    x = features([t for _, t, *_ in rows]).astype(np.float16)
    known = {i for i, *_ in labels}
    p, u = x[sorted(good)], x[[i for i, *_ in rows if i not in known]]
    half = np.arange(len(u)) % 2 == 0
    model = fit(p, Unlabelled(u, half))
    s = lambda z: 1 / (1 + np.exp(-z))
    zp, zu = (_standard(y.astype(float), model.mean, model.scale) for y in (p, u))

    def risk(w, b):
        a, c = zp @ w + b, zu @ w + b
        return model.prior * s(-a).mean() + max(0.0, s(c).mean() - model.prior * s(a).mean()) + RIDGE / 2 * w @ w

    least, rng = risk(model.weights, model.bias), np.random.default_rng(1)
    for size in (1e-3, 1e-2, 0.1, 1):
        for _ in range(30):
            assert risk(model.weights + rng.normal(size=N_FEATURES) * size, model.bias + rng.normal() * size) >= least - 2e-3
    for _ in range(5):
        w, b = rng.normal(size=N_FEATURES) * 0.1, 0.0
        for _ in range(500):
            a, c = zp @ w + b, zu @ w + b
            on = s(c).mean() - model.prior * s(a).mean() >= 0
            da, dc = s(a) * (1 - s(a)) / len(a) * model.prior, s(c) * (1 - s(c)) / len(c) * on
            w, b = w - 0.5 * (zu.T @ dc - zp.T @ da * (1 + on) + RIDGE * w), b - 0.5 * (dc.sum() - da.sum() * (1 + on))
        assert risk(w, b) >= least - 2e-3
    table = spark.createDataFrame([(r.tobytes(), bool(h)) for r, h in zip(u, half, strict=True)], "x binary, half boolean")
    far = fit(p, Table(table, Unlabelled(u, half)))
    assert np.allclose(far.weights, model.weights, atol=1e-3) and abs(far.prior - model.prior) < 1e-6


def test_scores_stay_where_the_fit_goes_on():
    """The fit ends where it has converged: a criterion a hundred times as strict gives the same scores, also where the least risk lies on the bend."""
    rows, labels = docs(500)
    x = features([t for _, t, *_ in rows]).astype(np.float16)
    known, good = {i for i, *_ in labels}, sorted(i for i, q, _ in labels if q)
    p, u = x[good], x[[i for i, *_ in rows if i not in known]]
    rest = Unlabelled(u, np.arange(len(u)) % 2 == 0)
    a, b = fit(p, rest), fit(p, rest, FLAT / 100)
    score = lambda m: 1 / (1 + np.exp(-(_standard(x.astype(float), m.mean, m.scale) @ m.weights + m.bias)))
    assert np.abs(score(a) - score(b)).max() < 0.01
    risk = Risk(rest, a.mean, a.scale, _standard(p.astype(float), a.mean, a.scale), a.prior)
    assert risk.at(np.append(b.weights, b.bias))[0] > risk.at(np.append(a.weights, a.bias))[0] - 1e-6
    grad, slope = np.array([0.3, 0.0]), np.array([-1.0, 0.5])
    for left, on in ((1.0, 1.0), (-1.0, 0.0), (0.05, None)):  # above the bend, below it and on it
        step, share, fall = modelled(np.eye(2), (1.0, grad, left, slope))
        model = lambda d: grad @ d + d @ d / 2 + max(0.0, left + slope @ d)  # noqa: B023, E731
        assert fall > 0 and (on is None and 0 < share < 1 and abs(left + slope @ step) < 1e-12 or share == on)
        assert all(model(step + d) >= model(step) - 1e-12 for d in np.random.default_rng(3).normal(size=(200, 2)) * 0.1)


def test_repeated_rows_and_held_out_accuracy_of_the_query(spark):
    """Rows that repeat an id are scored alike; the query keeps good texts that it never learned from and rejects poor ones."""
    import os

    from attesta.llm.quality import op7_quality_classifier

    rows, labels = docs(200)
    frame = spark.createDataFrame([*rows, *rows[:20]], SCHEMA)
    scores = {}
    for r in scored(frame, train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))).collect():
        scores.setdefault(r.id, []).append(r.score)
    assert all(len(set(v)) == 1 for v in scores.values()) and sum(map(len, scores.values())) == 220
    if not os.path.isdir("/root/testdata/sf0.1"):
        return
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality IS NOT NULL")
    counts = {(r.quality, r.predicted): r["count"] for r in op7_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out").join(marks, "doc_id").groupBy("quality", "predicted").count().collect()}
    assert counts.get((1, 1), 0) / sum(n for (q, _), n in counts.items() if q == 1) > 0.99
    assert counts.get((0, 0), 0) / sum(n for (q, _), n in counts.items() if q == 0) > 0.85
