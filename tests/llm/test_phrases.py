"""Phrase collocations against a plain count, and the guarantee of the merged summaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import phrases


def plain(rows, threshold, longest, top):
    """Collocations of (text, lang) by counting everything in Python."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= threshold and len(p) > 2}
    out = {}
    for p, a in found.items():
        lang, w = p[0], p[1:]
        inside = any(q[0] == lang and len(q) > len(p) and b >= a and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1)) for q, b in found.items())
        if not inside:
            score, cut = min((1000 * a * n[lang] // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[p[: cut + 1]], f[(lang, *p[cut + 1 :])], n[lang]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, rows in out.items() for i, x in enumerate(sorted(rows)[:top]))


def texts():
    r = random.Random(13)
    words, rows = [f"{c}é" for c in "abcdefgh"], []
    for i in range(120):
        w = [r.choice(words[:3] if r.random() < 0.5 else words) for _ in range(r.randint(0, 40))]
        rows.append((" ".join(x.title() + r.choice(["", "", "", ".", ",\n", "\t "]) for x in w), r.choice(["en", "fr", None, "und"])))
    rows += [("one two three four five six", "en")] * 9 + [(None, "en"), ("", None), (" \t\n", "fr"), ("aé " * 5000, "de")]  # copies, no words, a long text
    return rows


@pytest.mark.parametrize("most_bits", [phrases.MOST_BITS, 64])
def test_against_plain_counts(spark, most_bits):
    rows = texts()
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(7)
    got = phrases.collocations(df, threshold=8, longest=5, top=40, most_bits=most_bits).collect()
    want = plain(rows, 8, 5, 40)
    assert sorted(tuple(x) for x in got) == want and {x[0] for x in want} == {"de", "en", "fr", "und"}


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_summaries_lose_no_frequent_key():
    r = np.random.default_rng(5)
    blocks, threshold = [], 50
    for _ in range(30):  # a key with a third of the mass, some near the threshold, many rare ones
        k = np.concatenate([np.full(400, 7), r.integers(10, 40, 60), r.integers(100, 10**6, 700)]).astype(np.uint64)
        blocks.append(np.unique(k, return_counts=True))
    true = Counter()
    for k, n in blocks:
        true.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    mass = sum(true.values())
    capacity = mass // threshold + 1
    for step in (1, 2_000, 10**9):  # also one merge for each block
        keys, n, low = phrases.summarise(iter(blocks), capacity, step)
        assert len(keys) <= capacity and low < threshold
        assert {k for k, c in true.items() if c >= threshold} <= set(keys[n + low >= threshold].tolist())
        assert all(c <= true[k] <= c + low for k, c in zip(keys.tolist(), n.tolist(), strict=True))
    k = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64))
    back = phrases.unpack(phrases.pack(k, np.arange(1000)))
    assert (back[0] == k).all() and (back[1] == np.arange(1000)).all()


def test_bit_set_has_all_its_keys(spark):
    keys = [7, -1, -(2**63), 2**63 - 1, *range(5000, 6000)]
    for most in (64, 1 << 20):
        has = phrases.bit_set(spark.createDataFrame([(k,) for k in keys], "key long"), most).has(np.array(keys, np.int64).view(np.uint64))
        assert has.all()
    assert not phrases.bit_set(spark.createDataFrame([], "key long")).has(np.array([1, 2], np.uint64)).any()
