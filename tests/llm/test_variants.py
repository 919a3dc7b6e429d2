import random
import re
import zlib

import pytest

from attesta.llm import variants as V
from attesta.llm.common import Workspace

DOCS = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts):
    out = []
    for w, n in counts.items():
        near = sorted((-m, o) for o, m in counts.items() if one_edit(w, o))
        form = near[0] if near and -near[0][0] >= 10 * n else None
        out.append((w, form and form[1], n, len(near), form and -form[0]))
    forms = {w: f for w, f, *_ in out}

    def root(w):
        return root(forms[w]) if forms[w] else w

    return sorted((w, f or "", root(w), n, k, m or 0) for w, f, n, k, m in out)


def rows(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def dense(seed, n=250, letters="ab"):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, 8))): rng.choice([2, 3, 30, 40, 500, 6000]) for _ in range(n)}


@pytest.mark.parametrize(("seed", "letters", "size"), [(1, "ab", 1 << 17), (2, "abc", 23), (3, "aé", 11), (4, "abcdefgh", 40)])
def test_forms_against_brute_force(spark, monkeypatch, seed, letters, size):
    monkeypatch.setattr(V, "RANGE", size)
    counts = dense(seed, letters=letters)
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(V.variants(table)) == brute(counts)


@pytest.mark.parametrize("size", [1 << 17, 17])
def test_each_pair_is_found_once(spark, monkeypatch, size):
    monkeypatch.setattr(V, "RANGE", size)
    counts = dense(5, letters="abé")
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [(r.word, r.other) for r in V.near(table, Workspace(spark, "test")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in counts for b in counts if one_edit(a, b)}


def test_light_edges_are_few():
    rng = random.Random(9)
    own = sorted({"".join(rng.choices("aeiourst", k=rng.randint(7, 14))) for _ in range(4000)})
    light = {}
    for e in V.errata(own, -1, -1):
        if e.replaced:
            light[e.word] = light.get(e.word, 0) + 1
    assert max(light.values()) <= 12  # each light edge at least halves the words below


def test_words_against_plain_counting(spark):
    rng = random.Random(4)
    vocabulary = ["Kettles", "kettles", "ÀÉîøüßÿ", "evening", "eveningx", "short", "lanterns", "LANTERNS", "naïveté", "a×b÷c×d"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=60)) + "1tail_end, Ωmega-nothing") for i in range(120)]
    texts += [(3, texts[3][1]), (None, "lanterns lanterns"), (500, None), (501, "")]
    counts = {}
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], DOCS).repartition(5)
    got = {r.word: r.n for r in V.words(frame).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 2} and "ÀÉîøüßÿ" in got


def test_long_words_and_chains(spark):
    long = "x" * 60_000
    counts = {long: 2, long + "x": 20, long[:-1] + "y": 3, "kettles": 5000, "kettlez": 50, "kettlzz": 5, "xkettlzz": 2}
    got = {r.word: (r.form, r.root) for r in V.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got[long] == (long + "x", long + "x") and got[long[:-1] + "y"] == (None, long[:-1] + "y")
    assert got["kettlzz"] == ("kettlez", "kettles") and got["xkettlzz"] == (None, "xkettlzz") and got["kettles"] == (None, "kettles")


def test_empty_table(spark):
    assert V.variants(V.words(spark.createDataFrame([], DOCS))).collect() == []
