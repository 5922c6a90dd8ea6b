"""The multi-index of fingerprints against all pairs, and decontamination's recall against brute force over given documents."""

import os
import re

import numpy as np
import pytest
from spanloom.llm import decontam

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("radius", "blocks"), [(24, 4), (7, 4), (3, 8), (2, 4), (0, 4), (5, 5)])
def test_index_finds_all_pairs_within_the_radius(radius, blocks):
    r = np.random.default_rng(radius)
    items = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    items[10:20] = items[0]  # ties: equal fingerprints
    probe = np.concatenate([items[:50], r.integers(0, 1 << 63, 50, dtype=np.uint64)])
    for k in range(len(probe)):
        for b in r.permutation(64)[: r.integers(0, radius + 3)]:
            probe[k] ^= np.uint64(1) << np.uint64(b)
    kind = np.arange(300) % 3
    w, i = decontam.MultiIndex(items, kind, radius, blocks).near(probe, 1, step=7)
    want = ((np.bitwise_count(probe[:, None] ^ items[None, :]) <= radius) & (kind == 1)).nonzero()
    assert (w.tolist(), i.tolist()) == (want[0].tolist(), want[1].tolist())
    none = decontam.MultiIndex(items[:0], kind[:0], radius, blocks).near(probe, 1)
    assert len(none[0]) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_recall_over_given_documents(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in decontam.find(docs, items).collect()}
    shingles = lambda w: np.array([hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))]) if w else np.empty(0, np.int64)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    listed, want = [(x.item_id, words(x.text)) for x in items.collect()], set()
    by_shingle: dict[int, set[int]] = {}
    for k, (_, w) in enumerate(listed):
        for s in shingles(w).tolist():
            by_shingle.setdefault(s, set()).add(k)
    for x in docs.collect():
        w = words(x.text)
        own = shingles(w)
        for k in {k for s in own.tolist() for k in by_shingle.get(s, ())}:  # others share nothing
            name, item = listed[k]
            b = shingles(item)
            n = max(1, min(len(own), len(item) - min(5, len(item)) + 1))
            if any(decontam.weighted_similarity(own[s : s + n], b) >= 0.8 for s in range(len(own) - n + 1)):
                want.add((x.doc_id, name))
    assert want and got == want
