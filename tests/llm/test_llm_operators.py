"""Each operator on small tables with nulls, blanks, ties, repeated rows, no rows and extra columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import decontam, html, langid, mixing, quality, sharding, substrings, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, shard int, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, DE = "the cat and the dog were there with that other thing ", "der hund und die katze waren nicht auf dem großen schönen baum "


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 0.5, "w", 3, "h") for r in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (None, "null id words", "en", None), (5, "same words here", "en", "b"), (5, "same words here", "en", "b")]


def test_language(spark):
    rows = [(i, (EN if i % 2 else DE) * 20, "en" if i % 2 else "de", "s") for i in range(40)] + ODD + [(90, "123 ?!", "en", "s"), (91, EN * 40_000, "en", "s")]
    d = docs(spark, rows)
    profiles = langid.learn_profiles(d)
    got = {r.doc_id: r for r in langid.identify(d, profiles).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in [*range(6, 40), 91])
    assert [(got[i].lang_pred, got[i].score) for i in (2, 3, 90)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.identify(d, langid.learn_profiles(d.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.identify(d.limit(0), profiles).collect() == []


def test_profile_ranks_are_counts():
    group, gram, n = langid.ngram_counts(["Ab ab!", ""], np.arange(2))
    name = lambda g: "".join(chr(int(g) >> s & (1 << 21) - 1) for s in (42, 21, 0) if int(g) >> s & (1 << 21) - 1)
    assert {name(g): int(c) for g, c in zip(gram, n)} == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2}
    assert set(group) == {0}


def test_urls_by_trie_join_and_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    r = random.Random(1)
    made = [f"{r.choice(['http', 'https'])}://{r.choice(['', 'a.', 'A.b.'])}{r.choice(['example', 'xexample', 'other'])}.{r.choice(['org', 'com', 'net'])}{r.choice(['', '/', '/es/', '/es', '/en/1', '/en/17/x', '/en/2', '/fr/9', '/de/'])}{r.choice(['', '?q=/es/', '#x'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([None, "", "no scheme", "://", *made])], "page_id long, url string, verdict_before string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    want = {i: brute(u) for i, u in enumerate([None, "", "no scheme", "://", *made])}
    for most in (100, 0):
        assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judge(pages, rules, max_rules=most).collect()} == want


def test_extraction_from_unseen_layouts(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    text = lambda: [say(6), *[say(r.randint(20, 60)) for _ in range(r.randint(2, 6))]]
    seed = [f"<html><body><nav><ul><li><a href='/x'>{word()}</a></li></ul></nav><article>{''.join(f'<p>{t}</p>' for t in text())}</article><footer>{say(5)}</footer></body></html>" for _ in range(40)]
    trees = html.learn(spark.createDataFrame([(s,) for s in seed] + [(None,)], "html string"), trees=10, layouts=2)
    exact = 0
    for _ in range(40):
        marked = html.layout(text(), [say(4), say(8), word()], r)
        page = html.Page(marked, {})
        want = page.text(html.labels([page]).astype(bool))
        exact += html.extract_texts(trees, [re.sub(r' x-main="\d"', "", marked)])[0] == want
    assert exact >= 30
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", seed[0], "t"), (3, "u", seed[0], "t"), (4, "u", "<p>a <b>b<script>x</p>", "t")], "page_id long, url string, html string, text string")
    got = html.extract(pages, trees).collect()
    assert len(got) == 5 and all(x.n_chars == len(x.text) for x in got) and got[0].text == ""


def test_no_label_contradicts_its_ancestors():
    r = np.random.default_rng(0)
    parent = np.array([-1] + [int(r.integers(0, k)) for k in range(1, 60)])
    depth = np.zeros(60, int)
    for k in range(1, 60):
        depth[k] = depth[parent[k]] + 1
    inside = html.decode(r.random(60), parent, depth, np.ones(60), 0.0)
    left = np.zeros(60, bool)
    for k in range(1, 60):
        left[k] = left[parent[k]] or (inside[parent[k]] and not inside[k])
        assert not (left[k] and inside[k])


def test_mixing_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 90) for _ in range(r.randint(1, 400))), "en", f"s{i % 5 if i % 3 else 0}") for i in range(400)] + ODD
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for x in got:
        assert x.copies in (0, 1, 2) and x.taken == x.copies * x.size
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: weight[s] * level for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) for s in names)
    assert all(abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]) for s in names)
    assert mixing.mix(docs(spark, []).limit(0)).collect() == []


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            count[k] = count.get(k, 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeated_passages(spark, most):
    r = random.Random(11)
    some = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    shared = [some(n) for n in (35, 36, 34, 60, 120)]
    texts = []
    for k in range(60):
        w = some(r.randint(0, 90))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        texts.append(r.choice([" ", "\n", " \t "]).join(w))
    texts += ["a b c d e " * 60, "z " * 80, texts[3], texts[3], None, "", " ".join(some(34)), "é " * 200]
    rows = [(None if k == 7 else k, t, None, None) for k, t in enumerate(texts)]
    got = substrings.remove_repeats(docs(spark, rows), max_group=most, with_text=True).collect()
    want = [(None if k == 7 else k, *x) for k, x in enumerate(brute_repeats(texts, 35))]
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got], key=str) == sorted(want, key=str)
    assert all(sum(b - a for a, b in x.spans) == x.n_removed and len(x.kept.split()) == x.n_words - x.n_removed for x in got)
    assert substrings.remove_repeats(docs(spark, []).limit(0)).collect() == []


def test_order_of_rules_changes_no_verdict(spark):
    rows = [(i, t, None, None) for i, t in enumerate([EN * 30, "### $$$ " * 200, "A line here\n" * 90, "SHOUT LOUDLY NOW " * 60, " ".join(f"word{i}" for i in range(300)), None, "", "x"])] + ODD
    d = docs(spark, rows)
    seen = []
    for rules in (quality.RULES, quality.RULES[::-1], quality.order_rules(d)):
        b = quality.Batch([r[1] for r in rows])
        seen.append(quality.cascade(b, rules).tolist())
    assert seen[0] == seen[1] == seen[2]
    got = {r.doc_id: r for r in quality.judge(d).collect()}
    assert got[4].kept and not got[1].kept and got[6].n_words == 0 and got[6].base_failed
    lines = "a b c\nd e f\na b c\n\n \na b c"
    b = quality.Batch([lines])
    assert (b.n_words[0], b.word_chars[0], b.lines(np.array([0]))[1][0], b.n_repeat_words(np.array([0]))[0]) == (12, 12, 2, 9)
    assert quality.judge(d.limit(0)).collect() == []


def test_toxic_sentences_are_found(spark):
    r = random.Random(5)
    say = lambda: " ".join(f"v{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}" for _ in range(8))
    rows, labels = [], []
    for i in range(400):
        s = [say() for _ in range(r.randint(2, 8))]
        if i % 4 == 0:
            s[r.randrange(len(s))] += r.choice([" nastyword", " Vileword!", " meanword"])
        rows.append((i, ". ".join(s), None, None))
        labels.append((i, i % 4 == 0, "x"))
    lab = spark.createDataFrame([(i, int(t), s) for i, t, s in labels if i < 300] + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.learn(docs(spark, rows), lab)
    got = {x.doc_id: x for x in toxicity.score(docs(spark, rows + ODD), model).collect()}
    right = sum(got[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    assert right >= 95 and got[2].score == 0.0
    hits = [got[i] for i in range(300, 400, 4) if got[i].predicted]
    assert all(re.search("nastyword|vileword|meanword", x.worst_sentence) and x.n_offending == 1 for x in hits)
    assert {x.score for x in toxicity.score(docs(spark, rows), toxicity.learn(docs(spark, rows), lab.limit(0))).collect()} == {0.0}


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    some = lambda n: [f"w{r.randint(0, 300)}" for _ in range(n)]
    items = [some(n) for n in (14, 20, 30, 30, 58, 5, 3)]
    texts = [" ".join(some(200)) for _ in range(30)]
    for k, it in enumerate(items * 3):
        w = some(80)
        x = [a.upper() for a in it]
        if k % 3 == 1 and len(x) >= 30:
            x[2] = "changed"
        w[40:40] = x
        texts.append(" \n".join(w))
    texts += [None, "", " ".join(items[1])]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (91, " ")], "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        w = [x.lower() for x in WORD.findall(t or "")]
        for k, it in enumerate(items):
            n = min(5, len(it))
            grams = lambda v, n=n: [tuple(v[i : i + n]) for i in range(len(v) - n + 1)]
            for s in range(max(1, len(w) - len(it) + 1)):
                a, b = grams(w[s : s + len(it)]), grams(it)
                low = sum(min(a.count(g), b.count(g)) for g in set(a))
                if a and low / (len(a) + len(b) - low) >= 0.8:
                    want.add((d, k))
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for most in (100, 3):
        assert {(x.doc_id, x.item_id) for x in decontam.find(d, bench, max_items=most).collect()} == want
    clean = {x.doc_id for x in decontam.drop_contaminated(d, bench, max_items=3).collect()}
    assert clean == set(range(len(texts))) - {x for x, _ in want}
    assert decontam.find(d, bench.limit(0)).collect() == [] and decontam.find(d.limit(0), bench).collect() == []


def test_shards_have_exact_sizes(spark):
    rows = [(i, f"text {i % 50}", None, None) for i in range(997)] + ODD
    a = sharding.assign(docs(spark, rows), 8, rows_per_part=40).collect()
    assert sorted(map(str, a)) == sorted(map(str, sharding.assign(docs(spark, rows).repartition(5), 8, rows_per_part=40).collect()))
    slots = {}
    for x in a:
        slots.setdefault(x.shard, []).append(x.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    x = next(x for x in a if x.doc_id == 10)
    assert (x.size, x.text_crc32) == (len("text 10") + 1, zlib.crc32(b"text 10"))
    assert sharding.assign(docs(spark, []).limit(0)).collect() == []


def test_hypergeometric_draws_follow_the_law(spark):
    df = spark.range(20_000).select(sharding.hypergeometric(F.lit(50), F.lit(20), F.lit(10), sharding._uniform(F.lit(1), "id")).alias("k"))
    n = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    mean = sum(k * c for k, c in n.items()) / 20_000
    var = sum((k - mean) ** 2 * c for k, c in n.items()) / 20_000
    assert abs(mean - 4.0) < 0.05 and abs(var - 10 * 0.4 * 0.6 * 40 / 49) < 0.08
