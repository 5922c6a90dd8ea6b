"""Mixing and sharding against plain versions: tilts, copies, and where each row goes."""

import math
import random

from pyspark.sql import functions as F
from spanloom.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_tilts_and_copies_against_bisection(spark):
    r = random.Random(21)
    rows = [(i, " ".join("w" for _ in range(r.choice([1, 5, 30, 30, 30, 200]))), "en", r.choice("abcde"), 1) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by_source = {}
    for x in got:
        by_source.setdefault(x.source, []).append(x)
    for own in by_source.values():
        target, size = own[0].target, own[0].source_size
        mean = size / len(own)
        classes = {}
        for x in own:
            classes.setdefault(x.size, []).append(x.copies)
        if target >= 2 * size * (1 - 1e-12):
            assert all(x.copies == 2 for x in own)
            continue
        lo, hi = -1e4, 1e4
        rate = lambda t, s, mean=mean: 2 / (1 + math.exp(min(700, -t * s / mean)))
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(len(c) * s * rate(mid, s) for s, c in classes.items()) < target else (lo, mid)
        for s, c in classes.items():  # a class is rounded by less than a copy, and six single copies are moved at most
            assert abs(sum(c) - len(c) * rate(lo, s)) <= 7
            assert max(c) - min(c) <= 1
        assert abs(sum(x.taken for x in own) - target) <= 1


def test_sources_in_rows_and_in_rounds_agree(spark):
    r = random.Random(8)
    classes = [(f"+s{k}", s, r.randint(1, 50)) for k in range(6) for s in r.sample(range(1, 3000), 1 + 30 * k)]
    c = spark.createDataFrame(classes, "source_key string, size long, n long")
    per = c.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    share = F.when(F.col("source_key") == "+s1", 2.0).when(F.col("source_key") == "+s2", 0.0).otherwise(0.4 + F.length("source_key") / 10)
    t = per.withColumns({"target": F.col("source_size") * share, "mean_size": F.col("source_size") / F.col("docs")})
    a, b = (sorted(map(tuple, mixing.class_copies(c, t, row_classes=n).collect())) for n in (20_000, 0))
    assert a == b and len(a) == len(classes) and {x[3] for x in a if x[0] == "+s2"} == {0} and all(x[3] == 2 * x[2] for x in a if x[0] == "+s1")


def test_large_classes_are_ranked_over_parts(spark):
    rows = [(i if i % 3 else None, "one two three", "en", "s", 1) for i in range(3000)] + [(7, f"word {'x ' * (i % 40)}", "en", "t", 1) for i in range(3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d, keep=d.columns)
    counts = {(x.source, x.size): (x.n, x.c) for x in got.groupBy("source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("c")).collect()}
    copies = {(x.source, x.size): sorted(x.c) for x in got.groupBy("source", "size").agg(F.collect_list("copies").alias("c")).collect()}
    for key, (n, total) in counts.items():
        assert copies[key] == [total // n] * (n - total % n) + [total // n + 1] * (total % n)
    assert sorted(map(str, got.select("in_doc_id", "in_text", "in_source").collect())) == sorted(str(x) for x in d.select(F.col("doc_id").alias("in_doc_id"), F.col("text").alias("in_text"), F.col("source").alias("in_source")).collect())


def test_matrix_has_its_margins_and_law(spark):
    sizes = [7, 0, 30, 1, 12, 5]
    table = spark.createDataFrame([(p, n) for p, n in enumerate(sizes) if n], "part int, rows long")
    seen = {}
    for seed in range(5):
        got = {(x.part, x.shard): x.n for x in sharding.communication_matrix(table, 4, seed).collect()}
        assert [sum(got.get((p, s), 0) for s in range(4)) for p in range(6)] == sizes
        assert [sum(got.get((p, s), 0) for p in range(6)) for s in range(4)] == [14, 14, 14, 13]
        seen[seed] = got
        assert all(abs(n - sizes[p] * (14 - (s == 3)) / 55) <= 8 for (p, s), n in got.items())  # deviations are 1.7 at most
    assert len({str(x) for x in seen.values()}) == 5


def test_rows_go_where_the_matrix_says(spark):
    d = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(700)] + [(None, None, None, None, None)] * 30 + [(3, "text 3", "en", "s", 1)] * 30, SCHEMA)
    got = sharding.assign(d, 8, rows_per_part=50).collect()
    at = {}
    for x in got:
        at.setdefault(x.shard, []).append(x)
    assert sorted(len(v) for v in at.values()) == [95] * 8
    # neighbours in a shard come from anywhere in the table: no run of ids
    run = sum(abs((a.doc_id or 0) - (b.doc_id or 0)) == 1 for v in at.values() for a, b in zip(sorted(v, key=lambda x: x.slot), sorted(v, key=lambda x: x.slot)[1:]))
    assert run < 20
    table = {(x.part, x.shard): x.n for x in sharding.communication_matrix(spark.createDataFrame([(0, 700)], "part int, rows long"), 8).collect()}
    assert sorted(table.values()) == [87] * 4 + [88] * 4
    long = sharding.assign(spark.createDataFrame([(1, "é" * 3_000_000, None, None, None)], SCHEMA)).collect()
    assert (long[0].size, long[0].slot) == (6_000_001, 0)
