import math
from collections import Counter

import numpy as np
import pytest

from attesta.llm.common import NOT_SPACE, WORD, hash_words
from attesta.llm.kneser_ney import discounts, scored, train

SCHEMA = "doc_id long, text string, score string, n_tokens string"
TEXTS = ["the cat sat on the mat", "the dog sat on the log", "The cat saw the dog", "a cat and a dog", "the the the", "", None, "on the mat the cat sat", "a dog\tsaw a log", "x\x0by\x85z"]


def words(t):
    return (t or "").encode().lower().split()


def plain(texts, order):
    """The model written out: interpolated, with three discounts, down to a uniform word. Grams below the longest count the words before them, but for those that begin a text."""
    grams, count = [None, *(Counter() for _ in range(order))], Counter()
    for t in texts:
        seq = [1, *words(t), 0]
        count.update(seq[1:])
        for i in range(1, len(seq)):
            m = min(order, i + 1)
            grams[m][tuple(seq[i - m + 1 : i + 1])] += 1
    for m in range(order, 1, -1):
        for g in [g for g, n in grams[m].items() if n]:
            if len(g) == m:
                grams[m - 1][g[1:]] += 1
    of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    d = [None, *((0, *discounts(of(grams[m]))) for m in range(1, order + 1))]
    total = sum(grams[1].values())
    left = sum(d[1][min(v, 3)] for v in grams[1].values()) / total

    def p(ctx, w):
        if not ctx:
            c = grams[1][(w,)]
            return max(0, c - d[1][min(c, 3)]) / total + left / (len(count) + 1)
        m = len(ctx) + 1
        own = [v for g, v in grams[m].items() if g[:-1] == ctx]
        if not own:
            return p(ctx[1:], w)
        c = grams[m][(*ctx, w)]
        return max(0, c - d[m][min(c, 3)]) / sum(own) + sum(d[m][min(x, 3)] for x in own) / sum(own) * p(ctx[1:], w)

    return p, count


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_the_formula(spark, order):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)], SCHEMA)
    model = train(df.where("doc_id < 7"), order=order)
    p, count = plain(TEXTS[:7], order)
    n, v = sum(count.values()), len(count)
    assert (model.n_tokens, model.n_types) == (n, v)
    for ctx in ((1,), (b"the",), (b"never",), (1, b"the"), (b"on", b"the"), ()):
        if len(ctx) < order:
            assert sum(p(ctx, w) for w in count) + p(ctx, b"unknown") == pytest.approx(1)
    for r in scored(df, model).collect():
        seq = [1, *words(TEXTS[r.id]), 0]
        assert (r.n_tokens, r.n_known) == (len(seq) - 1, sum(count[x] > 0 for x in seq[1:]))
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in seq[1:]))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq))))
        assert r.perplexity == pytest.approx(10 ** (-r.score / (len(seq) - 1)))


def test_many_shards_and_blocks_change_nothing(spark, monkeypatch):
    """Shards, blocks and batches of any size give the same scores; rows that repeat an id stay apart."""
    from attesta.llm import kneser_ney

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 40))) for _ in range(120)]
    df = spark.createDataFrame([(i % 100, t, "a", "b") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    few = sorted((r.id, round(r.score, 9)) for r in scored(df, train(df)).collect())
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 200)
    model = train(df)
    assert model.shards > 10 and sorted((r.id, round(r.score, 9)) for r in scored(df, model).collect()) == few and len(few) == 120


def test_held_out_rows(spark):
    """Rows whose id is null are held out, and ids by their checksum as text."""
    import zlib

    from attesta.llm.kneser_ney import held_out

    df = spark.createDataFrame([(None, "x", "", ""), *((i, "x", "", "") for i in range(50))], SCHEMA).withColumn("h", held_out("doc_id", 1))
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in df.collect())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", "", ""), (None, None, "", "")], SCHEMA)
    model = train(df.limit(0))
    assert (model.n_tokens, model.n_types) == (0, 0)
    assert [r.n_known for r in scored(df, model).collect()] == [0, 0]
    assert scored(df.limit(0), model).count() == 0


def test_hashes_follow_words():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aAbB é\t\n\x0b.-1"), rng.integers(0, 60))) for _ in range(200)] + ["", None, "x" * 100000]
    h, n = hash_words(texts, NOT_SPACE)
    flat = [w for t in texts for w in words(t)]
    assert n.tolist() == [len(words(t)) for t in texts]
    by = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert hash_words(texts, WORD)[1].tolist() == [len(pattern.findall((t or "").translate(lower))) for t in texts]


def test_a_second_attempt_that_dies_leaves_the_finished_shard(tmp_path):
    import numpy as np
    import pytest

    from attesta.llm import files, kneser_ney

    uri = f"file://{tmp_path}/model/1-0"
    arrays = [np.arange(200, dtype="<u8"), np.arange(200, dtype="<u2")]
    kneser_ney._put(uri, arrays)
    before = (tmp_path / "model" / "1-0").read_bytes()

    def killed():
        with files.whole(uri) as f:
            f.write(b"cut short!")
            assert (tmp_path / "model" / "1-0").read_bytes() == before  # nothing is cut while it writes
            raise InterruptedError

    with pytest.raises(InterruptedError):
        killed()
    assert (tmp_path / "model" / "1-0").read_bytes() == before
    kneser_ney._put(uri, arrays)  # a second attempt that ends
    assert (tmp_path / "model" / "1-0").read_bytes() == before
    assert [a.tolist() for a in kneser_ney._get(uri, 2)] == [a.tolist() for a in arrays]


def test_the_query_fits_all_three_words(spark, monkeypatch, tmp_path):
    """The query's model has every length that the operator has by default: its scores are those of three words, which two don't give."""
    from attesta.llm import kneser_ney

    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS * 3)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    learn = [TEXTS[r.doc_id % len(TEXTS)] for r in docs.where(~kneser_ney.held_out("doc_id", 1)).collect()]
    p, _ = plain(learn, 3)
    for r in kneser_ney.op3_language_model_scores(spark, str(tmp_path)).collect():
        seq = [1, *words(TEXTS[r.doc_id % len(TEXTS)]), 0]
        assert r.score == pytest.approx(sum(math.log10(p(tuple(seq[max(0, i - 2) : i]), seq[i])) for i in range(1, len(seq))))


def test_a_block_of_grams_comes_back():
    """Words and columns of packed grams, whatever their order."""
    from attesta.llm import kneser_ney

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 40, np.uint64)
    words, columns = [rng.choice(pool, 300) for _ in range(3)], [rng.integers(1, 1 << 20, 300), rng.integers(0, 3, 300)]
    back, numbers = kneser_ney._joined([kneser_ney._blob(words, columns), kneser_ney._blob([w[:1] for w in words], [c[:1] for c in columns])], 3)
    rows = lambda w, c: sorted(zip(*(x.tolist() for x in (*w, *c)), strict=True))
    assert rows(back, numbers) == sorted(rows(words, columns) + rows([w[:1] for w in words], [c[:1] for c in columns]))


def test_the_model_and_what_is_shuffled_stay_small(spark, monkeypatch):
    """A gram of three words takes less than 5 bytes of the stored model, one of two less than 9, and a block that is dealt to many shards doesn't repeat the hashes of its words in each."""
    import os

    from attesta.llm import kneser_ney

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 500), 30000)) for _ in range(200)]
    grams = {m: {tuple(s[i : i + m]) for s in (["", *t.split(), "."] for t in texts) for i in range(len(s) - m + 1)} for m in (1, 2, 3)}
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 60000)
    model = train(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA).coalesce(1))
    assert model.shards > 5
    size = {m: sum(os.path.getsize(e) for e in os.scandir(model.folder.removeprefix("file://")) if e.name.startswith(f"{m}-")) for m in (1, 2, 3)}
    assert size[3] < 5 * len(grams[3]) and size[2] < 9 * len(grams[2]) and size[1] < 20 * len(grams[1]) + 5000
    ids = np.unique(rng.integers(1, 30000, (50000, 3)), axis=0).astype(np.uint64).T
    batch = kneser_ney._dealt(kneser_ney.dealt_to(list(ids), 64), list(ids), [np.ones(ids.shape[1], np.int64)], 64)
    assert sum(len(x) for x in batch.column("data").to_pylist()) < 6.5 * ids.shape[1]


@pytest.mark.parametrize("order", [2, 4])
def test_many_shards_of_other_orders(spark, monkeypatch, order):
    from attesta.llm import kneser_ney

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefghij"), rng.integers(0, 60))), "", "") for i in range(80)], SCHEMA).repartition(3)
    one = sorted((r.id, round(r.score, 9)) for r in scored(df, train(df.where("doc_id < 60"), order=order)).collect())
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 300)
    model = train(df.where("doc_id < 60"), order=order)
    assert model.shards > 5 and sorted((r.id, round(r.score, 9)) for r in scored(df, model).collect()) == one


@pytest.mark.parametrize("top", [1 << 8, 1 << 20, 1 << 31])
def test_stored_grams_are_found_whatever_their_ids(top):
    """Keys of pairs and last words, also those whose differences or ids need more than the lower part; what isn't stored isn't found."""
    from attesta.llm import kneser_ney as k

    rng = np.random.default_rng(6)
    words = [rng.integers(1, top, 1000, np.uint64) for _ in range(2)]
    keys = np.unique(k._pair(words, 32))
    stored, absent = keys[::2], np.append(keys[1::2], [np.uint64(0), np.uint64(1 << 63)])
    arrays = k._stored_pairs(stored)
    assert k._find_pairs(arrays, stored).tolist() == list(range(len(stored))) and (k._find_pairs(arrays, absent) == -1).all()
    ids = np.unique(words[0])
    lower, upper = (ids & np.uint64(0xFFFF)).astype("<u2"), k._narrow(ids >> np.uint64(16))
    n = np.full(len(ids), 5)
    wanted, place = ids.astype(np.int64), np.arange(len(ids))
    assert k._find_after(lower, upper, place * 0, place * 0 + len(ids), wanted).tolist() == place.tolist()
    assert (k._find_after(lower, upper, np.minimum(place + 1, len(ids)), np.minimum(place + n, len(ids)), wanted) == -1).all()


def test_rows_are_sorted_by_columns_of_any_width():
    from attesta.llm import kneser_ney as k

    rng = np.random.default_rng(7)
    for tops in ((4, 4), (1 << 40, 3, 1 << 40), (1 << 63, 2, 1 << 63, 5)):
        columns = [rng.choice(rng.integers(0, t, 3, np.uint64), 200) for t in tops]
        order, starts = k._runs(columns)
        rows = list(zip(*(c.tolist() for c in columns), strict=True))
        assert [rows[i] for i in order] == sorted(rows) and [rows[order[i]] for i in starts] == sorted(set(rows))


def test_texts_that_change_between_reads_are_an_error(spark):
    """Words are counted in one read and grams in another; words that only the second has would be left out without a word."""
    import uuid

    from pyspark.sql import functions as F

    other = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()
    with pytest.raises(Exception, match="words that they didn't have"):
        train(spark.range(5).select(other().alias("text")))
