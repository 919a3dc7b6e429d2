import random

import numpy as np
from xxhash import xxh64_intdigest

from attesta.llm.common import Workspace, connected_components, local_components
from attesta.llm.simhash import fingerprint, fingerprints, hamming_links, keep_first, simhash_components, traverse

SCHEMA = "doc_id long, text string, fp string, id string, component_id int"


def plain(text):
    w = (text or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta\x85x", "eta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    out = base + base[:10] + [b + " end" for b in base[:12]] + [b.replace("eps", "EPS", 1) for b in base[:12]]
    return [*out, "", None, "   ", "one", "one two", "one\ttwo", "a" * 5000, "x " * 20000]


def test_components_equal_brute_force(spark):
    data = [(i, t, "a", "b", 1) for i, t in enumerate(texts())] + [(None, "one", "a", "b", 1)]
    got = {r.id: r for r in simhash_components(spark.createDataFrame(data, SCHEMA)).collect()}
    fp = {i: plain(t) for i, t, *_ in data if i is not None}
    assert all(got[i].fp % (1 << 64) == f == fingerprint(data[i][1]) for i, f in fp.items())
    want = components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: got[i].component_id for i in fp} == want and got[None].component_id is None
    assert len(set(want.values())) < len(fp) - 15


def test_trie_finds_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]))
    i, j = traverse(fp, np.array([[0, len(fp), 0, len(fp), 0]]), 0, 2)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if (int(fp[a]) ^ int(fp[b])).bit_count() <= 2}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and len(want) > 400


def test_dense_nodes_are_opened_further(spark):
    """Many fingerprints within a few bits: node pairs beyond the bound are opened again and again, and no link is lost."""
    rng = np.random.default_rng(8)
    center = int(rng.integers(0, 1 << 62))
    fp = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (500, 3))} | {int(x) for x in rng.integers(0, 1 << 63, 300)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    classes = spark.createDataFrame([(x, k) for k, x in enumerate(signed)], "fp long, node long")
    want = components(range(len(fp)), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    for node, most in ((256, 1 << 16), (4, 40)):
        edges = [(r.u, r.v) for r in hamming_links(classes, 2, node, most).collect()]
        assert components(range(len(fp)), edges) == want


def test_keep_first(spark):
    long = " ".join(f"w{i}" for i in range(400))
    data = [(3, long, "a", "b", 1), (1, long, "a", "b", 1), (2, long + " x", "a", "b", 1), (9, "another text altogether", "a", "b", 1), (None, long, "a", "b", 1)]
    kept = keep_first(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "id", "component_id"]
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 9, None} <= ids and 3 not in ids


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash_components(df).count() == 0 and fingerprints(df).count() == 0 and keep_first(df).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df, Workspace(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 500 for k in range(500, 560)}}
    assert local_components(4, np.array([0, 2]), np.array([3, 3])).tolist() == [0, 1, 0, 0]
