"""How much the pipeline's stages move between tasks."""

import random

from spanloom.llm import simhash


def test_texts_without_links_are_dealt_once(spark):
    r = random.Random(3)
    some = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    base = some(100)
    family = [[*base[:k], *some(20), *base[k + 20 :]] for k in range(0, 80, 4)]  # alike in part: some of their links fail
    near = [[*w[:50], "other", *w[51:]] for w in (*family[:5], base)]
    texts = [" ".join(w) for w in (base, *family, *near, *[some(100) for _ in range(3000)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").localCheckpoint()
    sc = spark.sparkContext
    every = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    written = lambda: sum(every().apply(i).shuffleWriteBytes() for i in range(every().size()))
    before, joins = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes = simhash.similar_classes(docs)
        moved = written() - before
        assert classes.count() == len(texts) and 3000 < classes.select("root").distinct().count() < len(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    assert moved < 1.8 * sum(map(len, texts))
