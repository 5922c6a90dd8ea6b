"""Every stage on an empty table, on very long texts and on columns of odd names; recall of near copies on given documents."""

import random

import corpus_pipeline
import pytest
from spanloom.llm import simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `x y` int, `q``t` string, row int, uid string, size string, part string"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    item = " ".join(f"item{r.randint(0, 999)}" for _ in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_no_rows(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame([], SCHEMA), sf[0])
        assert out.count() == 0 and (name == "shard" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_long_texts_and_odd_names(spark, sf):
    folder, item = sf
    r = random.Random(3)
    say = lambda n: " ".join(f"{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}ing" for _ in range(n))
    long = say(120_000)
    texts = [say(90) for _ in range(12)] + [long, long.replace("ing", "ing", 1), f"{say(60_000)} {item} {say(60_000)}"]
    rows = [(i, t, "en", f"s{i % 2}", 1, f"dot{i}", i, "tick", i, "u", "z", "p") for i, t in enumerate(texts)]
    at, kept = spark.createDataFrame(rows, ODD), {}
    names = at.columns
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        got = at.collect()
        kept[name] = sorted(x["doc_id"] for x in got)
        if name != "shard":
            assert at.columns == names and all(x["a.b"] == f"dot{x['doc_id']}" and x["x y"] == x["doc_id"] == x["row"] for x in got)
            at = spark.createDataFrame([tuple(x) for x in got], ODD)
    assert kept["language_id"] == [*range(15)] and kept["near_duplicates"] == [*range(13), 14] and kept["decontaminate"] == [*range(13)]
    assert kept["mix_sources"] and kept["shard"] == kept["mix_sources"]


def test_recall_of_near_copies_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    shared = {}
    for own in held.values():
        for k, a in enumerate(own):
            for b in own[:k]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    blank = [i for i in texts if not sets[i]]
    for i in blank:
        root[top(i)] = top(blank[0]) if top(i) > top(blank[0]) else top(i)
    classes = len({top(i) for i in texts})
    kept = simhash.keep_one(docs).count()
    assert len(links) > 50 and classes <= kept <= classes + 0.01 * len(links), (classes, kept, len(links))
