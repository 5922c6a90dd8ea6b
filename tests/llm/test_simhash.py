import random
import re

import numpy as np
import xxhash
from spanloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, root string"


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(ids, prints, radius):
    least = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, prints):
            for j, b in zip(ids, prints):
                if (a ^ b).bit_count() <= radius and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = [None, "", " \t\n", "One", "one two  three", "É é ß", "a b c d e f " * 4000]
    for _ in range(40):
        words = [vocabulary[i] for i in rng.integers(0, 300, 400)]
        texts += [" ".join(words), "\t".join(words).upper(), " ".join(words[:390])]
    rows = [(i, t, None, None, None, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile_rows=16).collect()}
    prints = [brute(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == prints
    want = classes(list(range(len(texts))), prints, 4)
    assert {i: got[i].component_id for i in got} == want


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(7, "same text here", None, None, None, None, None)] * 3 + [(None, "same text here", "en", None, None, None, None), (None, "other", None, None, None, None, None)]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_groups_of_one_fingerprint(spark):
    rows = [(i % 700, "the same words in many rows", None, None, None, None, None) for i in range(2500)] + [(5000 + i, f"other words {i} " * 9, None, None, None, None, None) for i in range(50)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), tile_rows=8).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert {r.component_id for r in got if r.doc_id < 5000} == {0}


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7000, 7000), (-5, 9000)]
    edges += [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(300)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    for few in (simhash.FEW_EDGES, 0):  # at once, and by rounds
        found = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(16), few=few).collect()}
        assert found == {x: y for x, y in root.items() if x != 7000 and any(x in e and e[0] != e[1] for e in edges)}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_forests_are_minimal_whenever_they_are_pruned(monkeypatch):
    r = np.random.default_rng(5)
    near = np.full(300, 0x123456789ABCDEF0, np.uint64)
    for _ in range(5):
        near ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
    x = np.concatenate((near, r.integers(0, 2**63, 60).astype(np.uint64)))
    holds = lambda u, v: (u % 7 != 3) | (v % 5 != 1)
    d = np.bitwise_count(x[:, None] ^ x[None, :]).astype(int)
    links = sorted((d[a, b], a, b) for a in range(len(x)) for b in range(a) if d[a, b] <= 18 and (holds(np.array([a]), np.array([b]))[0] or holds(np.array([b]), np.array([a]))[0]))
    for most in (50, 2_000, 10**9):
        monkeypatch.setattr(simhash.Forest.__init__, "__defaults__", (most,))
        u, v = simhash._forest(x, x, True, 18, lambda a, b: holds(a, b) | holds(b, a))
        root, weight = list(range(len(x))), 0

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for w, a, b in links:
            if top(a) != top(b):
                root[top(a)] = top(b)
                weight += w
        assert int(d[u, v].sum()) == weight and len(u) == sum(top(i) != i for i in range(len(x)))
