import math
import random
import re

import numpy as np
import pytest

from attesta.llm import ranking as R

DOCS, QUERIES = "doc_id long, text string, score string, rank int", "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, queries, k):
    """Every document of every query by the definition, all at once."""
    own = [(i, lowered(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    asked = {}
    for i, t in queries:
        asked.setdefault(i, set()).update(lowered(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, t in own:
            m, s = 50 + 50 * len(t) * n_docs // n_terms, 0
            for x in terms:
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(x in set(y) for _, y in own) + 1)))
                    s += w * (1000000000 * tf // (1000 * tf + 20 * m))
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "x1", "river", "日本", "naïve", "a", "stone", "THE", "ét"] + [f"w{k}" for k in range(60)]
    weights = [40, 20, 30, 5, 3, 5, 2, 2, 20, 3, 5, 2] + [1] * 60
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(3, docs[3][1]), (500, docs[9][1]), (501, docs[9][1]), (502, None), (503, ""), (504, "..."), (None, docs[5][1]), (None, docs[9][1]), (-7, docs[5][1])]
    queries = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for k in range(12)]
    queries += [(12, docs[9][1]), (13, None), (14, "unheard"), (15, "The the"), (None, "stone river"), (2, "w7 w8")]
    return docs, queries


@pytest.mark.parametrize(("shard", "block", "window", "k"), [(60, 7, 4, 5), (1 << 20, 1 << 16, 512, 50)])
def test_against_brute_force(spark, monkeypatch, shard, block, window, k):
    monkeypatch.setattr(R, "BLOCK_PAIRS", block)
    monkeypatch.setattr(R, "WINDOW", window)
    docs, queries = corpus()
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in queries], QUERIES)
    index = R.build(frame, shard_terms=shard)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in R.search(index, asked, k).collect()), key=repr)
    assert got == brute(docs, queries, k)


def test_packed_numbers_come_back():
    v = np.array([0, 1, 127, 128, 16383, 16384, 1 << 40, (1 << 62) + 5, 3], np.int64)
    data, ends = R.packed(v)
    assert R.unpacked(data).tolist() == v.tolist() and ends[-1] == len(data) and data[:4].tolist() == [0, 1, 127, 128]
    assert R.unpacked(R.packed(np.zeros(0, np.int64))[0]).tolist() == []


def test_shards_hold_every_posting_sorted(spark):
    docs, _ = corpus(40)
    index = R.build(spark.createDataFrame([(i, t, "s", 0) for i, t in docs], DOCS), shard_terms=50)
    rows = index.table.collect()
    names = {r.shard for r in rows}
    assert len(names) > 5
    seen = []
    for name in names:
        own = [r for r in rows if r.shard == name]
        head = next(r for r in own if r.term is None)
        ids, sizes = np.frombuffer(head.data, np.int64), np.frombuffer(head.more, np.int64)
        assert np.all(np.diff(ids) >= 0) and sizes.sum() == head.total < 50 + 40
        for r in own:
            if r.term is not None:
                v = R.unpacked(np.frombuffer(bytes(r.data), np.uint8))
                doc = np.cumsum(v[::2])
                assert len(doc) == r.df and v[1::2].sum() == r.total and np.all(np.diff(doc) > 0)
                seen += [(int(ids[d]) if d < len(ids) else None, r.term, int(c)) for d, c in zip(doc, v[1::2], strict=True)]
    plain = [(i, x, lowered(t).count(x)) for i, t in docs for x in set(lowered(t))]
    assert sorted(seen, key=repr) == sorted(plain, key=repr)


def test_long_text_and_hot_term(spark):
    long = " ".join(f"t{k}" for k in range(300_000)) + " needle"
    docs = [(1, long), (2, "needle"), (3, "needle " * 50), *((k, "common") for k in range(10, 400))]
    queries = [(1, "needle common"), (2, "t299999")]
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in docs], DOCS)
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in R.search(R.build(frame, shard_terms=1000), spark.createDataFrame([(i, t, "x") for i, t in queries], QUERIES)).collect()]
    assert sorted(got, key=repr) == brute(docs, queries, 50)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "s", 0)], DOCS)
    assert R.search(R.build(none), spark.createDataFrame([(1, "a", "x")], QUERIES)).collect() == []
    out = R.search(R.build(some), spark.createDataFrame([], QUERIES))
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]
