"""Ranked search against plain scoring, and what the bounds of pairs spare."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score long, item_id string, row int, m int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            v = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if v > 0:
                scored.append((-v, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def some_docs(n):
    r = random.Random(12)
    words = [f"W{int(r.paretovariate(0.7)) % 400}é" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(n)]
    docs += [(n + 7, docs[3][1])] * 9 + [(n, docs[5][1]), (None, docs[3][1]), (None, None), (n + 1, ""), (n + 2, "!? ;"), (n + 3, "w1é-W2é_" * 30_000)]
    items = [(f"q{i}", " ".join(r.choice(words) for _ in range(12))) for i in range(25)]
    return docs, items + [("q0", items[0][1]), ("q0", "w3é"), ("none", None), ("blank", " .. "), ("new", "nowhere"), (None, "w7é w8é")]


@pytest.mark.parametrize(("shard", "passes"), [(500_000, 20_000), (900, 9)])
def test_against_plain_scores(spark, shard, passes):
    docs, items = some_docs(700)
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], SCHEMA).repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, doc_id int")
    got = search.search(d, q, k=10, shard_postings=shard, max_queries=passes).collect()
    assert sorted((tuple(x) for x in got), key=repr) == plain(docs, items, 10)


def test_no_rows(spark):
    none_d, none_q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none_d, q).count() == search.search(d, none_q).count() == 0
    assert [tuple(x) for x in search.search(d, q).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_pairs_tighten_bounds_and_change_nothing():
    r = np.random.default_rng(3)
    n, terms_of = 20_000, 40
    held = [(t, np.flatnonzero(r.random(n) < p)) for t, p in enumerate(r.uniform(0.002, 0.2, terms_of))]
    held = [(t, np.setdiff1d(d, held[t - 1][1]) if t % 2 else d) for t, d in held]  # words of one meaning: a document has the one or the other
    doc, term = np.concatenate([d for _, d in held]), np.concatenate([np.full(len(d), t) for t, d in held])
    impact = r.integers(1, 1000, len(doc)) * r.integers(1, 50, terms_of)[term]
    queries = search.Queries(list(range(30)), np.arange(terms_of, dtype=np.uint64), [np.sort(np.concatenate([2 * x, 2 * x + 1])) for x in (r.choice(terms_of // 2, 3, replace=False) for _ in range(30))])
    shard = search.build(doc, term, impact, np.arange(n)[::-1].copy(), search.pairs_of(queries, np.arange(terms_of)))
    with_pairs, without = search.Searcher(shard), search.Searcher(shard)
    for own in queries.of:
        scores = np.bincount(doc[np.isin(term, own)], impact[np.isin(term, own)], n).astype(np.int64)
        best = np.lexsort((np.arange(n)[::-1], -scores))[:20]
        for s in (with_pairs, without):
            d, v = s.find(own, 20, use_pairs=s is with_pairs)
            assert d.tolist() == best.tolist() and v.tolist() == scores[best].tolist()
        d, v = search.Searcher(shard).find(own, 20, beat=int(scores[best[9]]))
        assert v[:10].tolist() == scores[best[:10]].tolist() and v.min() >= scores[best[9]]
    every = sum(int(np.isin(term, own).sum()) for own in queries.of)
    assert with_pairs.scored < 0.97 * without.scored and without.scored < every
