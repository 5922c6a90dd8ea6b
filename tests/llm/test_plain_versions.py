"""Rank distances of language ID and the noisy-or of toxicity against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
from spanloom.llm import langid, toxicity
from spanloom.llm.common import split_words

WORDS = "der die das und nicht auch the and not also with straße café niño año water wasser agua eau".split()


def ranked(text, top):
    n = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        n.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k].strip())
    code = lambda g: tuple(map(ord, g)) + (0,) * (3 - len(g))
    return [g for g in sorted(n, key=lambda g: (-n[g], code(g)))][:top]


def test_out_of_place_distances():
    r = random.Random(5)
    say = lambda words: " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
    number = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0)))
    for top in (10, 300):
        own = {x: ranked(say(w) * 3, top) for x, w in (("de", WORDS[:5]), ("en", WORDS[6:11]), ("xx", WORDS))}
        own["dd"] = own["de"]  # a tie: the first name wins
        texts = [say(WORDS) for _ in range(60)] + ["", None, "12 ?", "a", "Ab, aB! ab"]
        lang, value = langid._scorer({x: {number(g): k for k, g in enumerate(p)} for x, p in own.items()}, top)(texts)
        for t, x, v in zip(texts, lang, value):
            grams = ranked(t or "", top)
            far = {name: sum(min(abs(p.index(g) - k), top) if g in p else top for k, g in enumerate(grams)) for name, p in own.items()}
            best = min(sorted(far), key=far.get) if grams else "und"
            assert x == best and abs(v - (1 - far[best] / (len(grams) * top) if grams else 0)) < 1e-12


def test_noisy_or_of_sentences():
    r = random.Random(8)
    words = [f"w{chr(97 + k)}x" for k in range(20)]
    hashes = split_words(words).hash
    order = np.argsort(hashes)
    weights = np.array([r.uniform(-2, 3) for _ in words])
    model = toxicity.Model(hashes[order], weights[order], -2.5)
    by_word = dict(zip(words, weights))
    texts = ["".join(r.choice([*words, "other", "Words"]) + r.choice([" ", " ", ", ", ". ", "!\n", "?! "]) for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "", "...", "!a."]
    score, offending, worst = toxicity.score_texts(model, texts, 0.3)
    for t, s, n, w in zip(texts, score, offending, worst):
        parts = [re.findall("[a-z]+", p) for p in re.split("[.!?\n]", (t or "").lower())]
        each = [1 / (1 + math.exp(2.5 - sum(by_word.get(x, 0.0) for x in p))) for p in parts if p]
        assert abs(s - (1 - math.prod(1 - p for p in each))) < 1e-9
        assert n == sum(p >= 0.3 for p in each) and (w is None) == (n == 0)
        assert w is None or re.findall("[a-z]+", w) == [p for p in parts if p][each.index(max(each))]
    long = toxicity.score_texts(model, [("other words. " * 200_000) + "wax wbx"], 0.3)
    assert 0 <= long[0][0] <= 1


def test_fit_is_near_the_least_loss():
    r = np.random.default_rng(2)
    docs, size = 120, 6
    sentence_doc = np.sort(r.integers(0, docs, 400))
    word_sentence, word = np.sort(r.integers(0, 400, 900)), r.integers(0, size, 900)
    labels = (np.bincount(sentence_doc[word_sentence[word == 0]], minlength=docs) > 1).astype(int)
    importance, empty = r.uniform(0.5, 2, docs), r.integers(0, 3, docs)

    def loss(theta):
        z = theta[-1] + np.bincount(word_sentence, theta[word], minlength=400)
        total = np.bincount(sentence_doc, np.logaddexp(0, z), minlength=docs) + empty * np.logaddexp(0, theta[-1])
        each = np.where(labels > 0, -np.log(-np.expm1(-np.maximum(total, 1e-9))), total)
        return float((importance / importance.sum() * each).sum())

    weights, bias = toxicity.fit(labels, importance, empty, sentence_doc, word_sentence, word, size)
    theta = np.concatenate((weights, [bias]))
    least = min(loss(theta + r.normal(0, s, size + 1)) for s in (0.01, 0.1, 0.5) for _ in range(200))
    assert loss(theta) < loss(np.concatenate((np.zeros(size), [-6.0]))) / 2 and loss(theta) < least + 0.01


def test_measures_of_rules_and_their_order(spark):
    from spanloom.llm import quality

    texts = ["- a b\n* c\n \u2022 d\nplain", "one...\ntwo\u2026 \n\nend", "p q\n\np q\n\n\n\nr", "ab cd ab cd ab x", "", None, "word " * 3000]
    b, rows = quality.Batch(texts), quality.np.arange(len(texts))
    assert [x.tolist() for x in b.lines(rows)] == [[4, 3, 3, 1, 0, 0, 1], [0, 0, 1, 0, 0, 0, 0], [3, 0, 0, 0, 0, 0, 0], [0, 2, 0, 0, 0, 0, 0]]
    assert [x.tolist() for x in b.paragraphs(rows)] == [[1, 2, 3, 1, 0, 0, 1], [0, 0, 1, 0, 0, 0, 0]]
    assert b.top_pair(rows).tolist() == [0, 0, 4, 8, 0, 0, 2999 * 8]
    slow = lambda t: quality.time.sleep(t)
    first = quality.Rule("first", lambda b, r: (slow(0.01), b.n_words[r] > 1)[1])
    same = quality.Rule("same", lambda b, r: (slow(0.1), b.n_words[r] > 1)[1])  # rejects nothing that `first` has left
    rest = quality.Rule("rest", lambda b, r: (slow(0.2), b.n_words[r] == 1)[1])
    docs = spark.createDataFrame([(k, "a b" if k % 3 else "a") for k in range(300)], "doc_id long, text string")
    assert [r.name for r in quality.order_rules(docs, rules=(same, rest, first), sample_rows=300)] == ["first", "rest", "same"]
