"""The whole job in cases that smaller ones left out: families, truncated items, repeats, copies."""

import random

from spanloom.llm import decontam, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)


def least_of_classes(texts):
    root, sets = list(range(len(texts))), []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return sorted(set(root))


def test_template_family_keeps_its_true_links(spark):
    r = random.Random(6)
    some = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    template, texts = some(174), []
    for _ in range(60):  # a text and a partner at about 0.82; texts of two pairs share some 0.7
        own = some(35)
        texts += [" ".join(template + own), " ".join(template + own[:-20] + some(20))]
    want = least_of_classes(texts)
    assert len(want) == 60
    for most in (1_000_000, 3_000):  # one block, and several
        assert sorted(x.doc_id for x in simhash.keep_one(docs(spark, texts), block_shingles=most).collect()) == want


def test_crowded_family_loses_no_link(spark):
    r = random.Random(15)
    some = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for words, members in ((60, 250), (120, 150)):
        base = some(words)
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, words // 12)):
                w[r.randrange(words)] = some(1)[0]
            texts.append(" ".join(w))
    want = least_of_classes(texts)
    assert len(want) > 20
    rows = [(None if i == 3 else i, t, i, i, "x" * i) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, node int, root int, _key string")  # names of the operator's own columns
    got = simhash.keep_one(d).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "node", "root", "_key"} and all(texts[x.node] == x.text and len(x["_key"]) == x.root for x in got)
    assert len(got) == len(want) and len({x.doc_id for x in got} - {None} - set(want)) <= 1  # the class of the null id has another least


def test_truncated_items_against_brute_force(spark):
    r = random.Random(8)
    items = [[f"w{r.randint(0, 10**6)}" for _ in range(n)] for n in (50, 50, 20, 9)]
    texts = [" ".join(w[cut : len(w) - end]) for w in items for cut, end in ((0, 8), (8, 0), (4, 4), (0, 9), (0, 10), (0, 12), (0, 2), (1, 0))]
    want = set()
    for d, t in enumerate(texts):
        for k, w in enumerate(items):
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split(), w))
            if len(a & b) / len(a | b) >= 0.8:  # no shingle comes twice
                want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert (0, 0) in want and 10 < len(want) < len(texts)
    assert {(x.doc_id, x.item_id) for x in decontam.find(docs(spark, texts), bench).collect()} == want
    assert {x.doc_id for x in decontam.drop_contaminated(docs(spark, texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_repeated_passages_and_short_texts_are_compared(spark):
    r = random.Random(12)
    some = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    menu = " home news sport weather contact imprint"
    texts = []
    for _ in range(3):  # the same article, with a menu once and 200 times: alike by their distinct shingles
        article = " ".join(some(200))
        texts += [article + menu, article + menu * 200]
    for _ in range(300):  # 4 of 5 shingles shared
        w = some(9)
        texts += [" ".join(w), " ".join(w[:8])]
    texts += some(3) + ["", " "]
    want = least_of_classes(texts)
    assert len(want) == 307
    assert sorted(x.doc_id for x in simhash.keep_one(docs(spark, texts)).collect()) == want


def test_copies_are_spread_over_shards(spark):
    texts = [f"text {i}" for i in range(400)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] * 2 + [(1000, "hot", "en", "s", 1)] * 400
    found = sharding.assign(spark.createDataFrame(rows, SCHEMA), 8, rows_per_part=100).collect()
    again = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(5), 8, rows_per_part=100).collect()
    assert sorted(found) == sorted(again)
    at = {}
    for x in found:
        at.setdefault(x.doc_id, []).append(x.shard)
    hot = at.pop(1000)
    assert 320 <= sum(a != b for a, b in at.values()) <= 375  # 350 by a uniform shuffle
    assert all(25 <= hot.count(k) <= 75 for k in range(8))
