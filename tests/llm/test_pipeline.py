"""The pipeline's stages, each on its own input, on small tables with odd rows."""

import random

import corpus_pipeline
from spanloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r = random.Random(2)
    some = lambda n: [f"{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}ing" for _ in range(n)]
    texts = [" ".join(some(120)) for _ in range(40)]
    near = texts[0].split()
    near[60] = "other"
    item = " ".join(some(25))
    texts += [texts[1], texts[1], " ".join(near), f"{' '.join(some(50))} {item} {' '.join(some(50))}", None, "", "12345 !!", None]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)] + [(None, " ".join(some(80)), None, None, None)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen[name] = [x.asDict() for x in at.collect()]
        at = spark.createDataFrame([tuple(x.values()) for x in seen[name]], at.schema)
        assert name == "shard" or at.columns == docs.columns
    ids = lambda n: sorted((x["doc_id"] for x in seen[n]), key=str)
    assert ids("language_id") == sorted([*range(44), None], key=str)  # without letters: gone
    assert ids("near_duplicates") == sorted([*range(40), 43, None], key=str)
    assert ids("decontaminate") == sorted([*range(40), None], key=str)
    assert set(ids("mix_sources")) <= {*range(40), None} and len(ids("shard")) == len(ids("mix_sources"))


def test_near_copies_against_brute_force(spark):
    r = random.Random(4)
    texts = []
    for _ in range(25):
        w = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(6, 400))]
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = list(w)
            for _ in range(r.randint(0, len(w) // 60)):
                v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    kept = sorted(x.doc_id for x in simhash.keep_one(docs).collect())
    root = list(range(len(texts)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert kept == sorted({root[i] for i in range(len(texts))})
