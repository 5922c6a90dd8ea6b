"""Plans and results that hold at any size: what is sent to the driver, pairs that are not made, work dealt over tasks."""

import difflib
import os
import time

from pyspark.sql import functions as F
from spanloom.functions.tables import dealt, durable, shared_dir
from spanloom.operators import catalog, closure, dataaccess, spans
from spanloom.plans.fixtures import Tables


def test_many_rows_in_a_small_file_are_not_broadcast(spark, tmp_path):
    Tables(spark, str(tmp_path))
    rows = durable(spark.range(1_000_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), F.lit("of one kind").alias("v")))
    other = spark.range(50_000_000).select((F.col("id") % 7).alias("k"))
    plan = other.join(rows, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def shuffled(spark, work):
    """What work gives, and the number of rows that its stages wrote for others."""
    sc = spark.sparkContext
    every = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    count = lambda: sum(every().apply(i).shuffleWriteRecords() for i in range(every().size()))
    before = count()
    out = work()
    return out, count() - before


def test_close_matches_of_all_ids_are_the_best_and_few_are_kept(spark):
    known = [f"app.m{i % 7}:small_ring{i}" for i in range(600)] + ["", "q", "\u00e9t\u00e9"]
    words = [f"app.m{i}:small_rings" for i in range(60)] + ["\u00e9t", ""]
    lost, ids = (spark.createDataFrame([(x,) for x in some] + [(None,)], "id string") for some in (words, known))
    got, rows = shuffled(spark, lambda: catalog.close_matches(lost, ids, exact=True).collect())
    want = set()
    for w in words:
        alike = difflib.SequenceMatcher()
        alike.set_seq2(w)
        scored = []
        for k in known:
            alike.set_seq1(k)
            scored.append((alike.ratio(), k))
        want |= {(w, k, r, i) for i, (r, k) in enumerate(sorted((x for x in scored if x[0] >= 0.5), reverse=True)[:3], 1)}
    assert {(r.word, r.match, r.ratio, r["rank"]) for r in got} == want
    assert rows < 25_000


def test_references_of_a_common_word_make_no_pairs(spark):
    n = 1500
    tables = [(i, f"{'quotation_' if i == 7 else 'core_'}part{i}_ring") for i in range(n)] + [(n, "wheel"), (n + 1, "small_wheel"), (n + 2, "axle")]
    fields = [(i, "ring_id") for i in range(n)] + [(0, "part3_ring_id"), (3, "part3_ring_id"), (n, "axle_ids"), (n + 2, "axle_id"), (n, "small_wheel_id"), (n, "wheel_id"), (7, "wheel_id")]
    t, f = spark.createDataFrame(tables, "table_id long, name string"), spark.createDataFrame(fields, "table_id long, field string")
    got, rows = shuffled(spark, lambda: dataaccess.infer_references(t, f).collect())
    found = {(r.source, r.target, tuple(r.fields)) for r in got}
    assert found == {(0, 3, ("part3_ring_id",)), (n, n + 2, ("axle_ids",)), (n, n + 1, ("small_wheel_id", "wheel_id")), (7, n, ("wheel_id",))}
    assert rows < 100_000


def test_sources_of_one_small_file_are_dealt_over_tasks(spark):
    files = spark.range(40).select(F.concat(F.lit("app/m"), "id", F.lit(".py")).alias("path"), F.lit("x = 1\n").alias("content")).coalesce(1)
    assert catalog.scan_names(files).count() == 80
    assert catalog.scan_route_decls(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_paths_of_spans_make_no_pairs(spark):
    n = 120
    rows = [(r, str(i), str(i - 1) if i else None, f"m:f{i}", i) for r in ("a", "b") for i in range(n)] + [("b", "lost", "gone", "m:g", 500)]
    table = spark.createDataFrame(rows, "request_id string, span_id string, parent_span_id string, name string, seq long")
    small, written = shuffled(spark, lambda: {(r.request_id, r.span_id): (r.path, r.depth, r.sort_key) for r in spans.span_path(table).collect()})
    large = {(r.request_id, r.span_id): (r.path, r.depth, r.sort_key) for r in spans.span_path(table, max_group=120).collect()}
    assert small == large and len(small) == 2 * n + 1
    assert small["a", "5"] == ([f"f{i}" for i in range(6)], 5, ".".join(["000001"] * 6)) and small["b", "lost"] == (["g"], 0, "000002")
    assert written < 10 * len(rows)


def test_windows_over_spans_are_dealt_by_their_count(spark):
    assert dealt(spark.range(10), 10_000_000, "id", part_rows=100_000).rdd.getNumPartitions() == 101
    assert dealt(spark.range(10), 10, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tables_under_a_root_are_counted_without_its_chains(spark):
    n, tables = 60, 100
    calls = spark.createDataFrame([(i, i + 1, 0) for i in range(n)], "caller long, callee long, ordinal int")
    paths = closure.placed(closure.least_paths(calls, spark.createDataFrame([(0,), (30,)], "root long")))
    access = spark.createDataFrame([(i, 1000 + (i + k) % tables, op, 1, i % 2 == 0) for i in range(n + 1) for k in range(50) for op in ("read", "write")], "function_id long, table_id long, op string, n long, uncertain boolean")
    got, rows = shuffled(spark, lambda: dataaccess.table_usage(paths, access).collect())
    for r in got:
        held = [i for i in range(r.root, n + 1) if (r.table_id - 1000 - i) % tables < 50]
        assert (r.functions, r.ops, r.chain) == (2 * len(held), {"read": len(held), "write": len(held)}, list(range(r.root, held[0] + 1)))
    assert {(r.root, r.place) for r in got} == {(root, k + 1) for root in (0, 30) for k in range(sum(1 for r in got if r.root == root))}
    near = {(r.root, r.table_id): r.call_chain for r in dataaccess.index_endpoints(paths, access).collect()}
    assert near == {(r.root, r.table_id): r.chain for r in got}


def test_tables_below_go_up_once(spark):
    n, chains = 7, 300
    calls = spark.createDataFrame([(100 * c + i, 100 * c + i + 1) for c in range(chains) for i in range(n)], "caller long, callee long")
    own = {c: {64 * (c % 10) + (c // 10 + 5 * k) % 64 for k in range(20)} for c in range(chains)}
    access = spark.createDataFrame([(100 * c + n, t) for c, some in own.items() for t in some] + [(2, min(own[0]))], "function_id long, table_id long")
    got, rows = shuffled(spark, lambda: {r.function: (r.tables, r.n) for r in dataaccess.tables_below(calls, access).collect()})
    want = {100 * c + i: sorted(own[c] - ({min(own[0])} if (c, i) == (0, 2) else set())) for c in range(chains) for i in range(n)}
    assert got == {f: (t, len(t)) for f, t in want.items()}
    assert rows < 50_000


def test_tables_below_functions_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5), (0, 1), (0, 5), (6, 7), (7, 6), (7, 2), (8, None), (None, 8), (9, 9), (1, 2)]
    held = [(1, 10), (2, 11), (3, 11), (5, 12), (5, 200), (4, 12), (6, 13), (9, 14), (20, 15), (7, 10)]
    got = dataaccess.tables_below(spark.createDataFrame(edges, "caller long, callee long"), spark.createDataFrame(held, "function_id long, table_id long"))
    below = {a: {b for x, b in edges if x == a} for a in range(10)}
    for _ in range(10):
        below = {a: t | {c for b in t if b is not None for c in below[b]} for a, t in below.items()}
    want = {}
    for a, t in below.items():
        left = {x for f, x in held if f in t} - {x for f, x in held if f == a}
        if left:
            want[a] = (sorted(left), len(left))
    assert {r.function: (r.tables, r.n) for r in got.collect()} == want


def test_what_is_on_no_cycle_is_not_coloured(spark):
    n, chains = 8, 500
    ways = [(100 * c + i, 100 * c + i + 1) for c in range(1, chains + 1) for i in range(n)]
    ways += [(100 * c + n, 0) if c % 2 else (2, 100 * c) for c in range(1, chains + 1)]
    edges = spark.createDataFrame(ways + [(0, 1), (1, 2), (2, 0), (7, 7), (None, 0)], "caller long, callee long")
    got, rows = shuffled(spark, lambda: {(r.caller, r.callee) for r in closure.cycles(edges).collect()})
    assert got == {(0, 1), (1, 2), (2, 0), (7, 7)}
    assert rows < 75_000


def test_many_requests_are_labelled_in_one_call(spark, monkeypatch):
    rows = [(f"r{q}", str(i), str((i - 1) // 2) if i else None, (7 * i) % 11, f"m:f{i % 5}") for q in range(40) for i in range(1 + q % 9)] + [(None, "0", None, 1, "m:g"), (None, "1", "0", 2, None), ("r1", "x", "y", 9, "m:h"), ("r2", "p", "q", 1, "a"), ("r2", "q", "p", 2, "b")]
    table = spark.createDataFrame(rows, "request_id string, span_id string, parent_span_id string, seq long, name string")
    got = []
    for lot in (1, 50, 20_000):
        monkeypatch.setattr(spans, "LOT_ROWS", lot)
        labels = spans.interval_labels(table)
        assert "request_id" not in labels._jdf.queryExecution().sparkPlan().toString().split("FlatMapGroupsInArrow [")[1].split("]")[0]  # no call for each request
        got.append(sorted(map(str, labels.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows) - 2  # a loop has no labels
    assert {(r.pre, r.last) for r in labels.filter("span_id = '0'").collect()} == {(0, q) for q in range(9)}


def test_rounds_of_least_paths_send_no_table_through_the_driver(spark):
    n = 15
    calls = spark.createDataFrame([(i, c, k) for i in range(n) for k, c in enumerate((2 * i + 1, 2 * i + 2, 0)) if c < n], "caller long, callee long, ordinal int")
    roots = spark.createDataFrame([(0,), (1,)], "root long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = {(r.root, r.function): (r.path, r.chain) for r in closure.least_paths(calls, roots).collect()}
    plans = [x.physicalPlanDescription() for x in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert len(got) == 2 * n and got[0, 0] == ([], [0]) and got[0, 8] == ([0, 0, 1], [0, 1, 3, 8]) and got[1, 0] == ([0, 0, 2], [1, 3, 7, 0])


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_what_a_round_shuffled_and_the_rounds_before_it_leave_the_disk(spark):
    had, folder = shuffle_files(spark), f"{shared_dir(spark)}/tables"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    wide = durable(spark.range(10_000).groupBy(F.pmod("id", F.lit(1_000)).alias("k")).agg(F.sum("id").alias("n")))
    for _ in range(50):  # files go soon after
        if not shuffle_files(spark) - had:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - had and wide.count() == 1_000
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "caller long, callee long")
    assert closure.depths(chain, spark.createDataFrame([(0,)], "root long")).count() == 13
    assert len(set(os.listdir(folder)) - before) <= 4


def test_lists_of_tables_are_not_shuffled(spark, monkeypatch):
    calls = spark.createDataFrame([(i, c) for i in range(100) for c in (2 * i + 1, 2 * i + 2) if c < 200], "caller long, callee long")
    access = spark.createDataFrame([(i, 7 * t) for i in range(200) for t in range(i % 90)], "function_id long, table_id long")
    blocks = dataaccess.tables_below(calls, access)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning(function")  # the join is above the only exchange
    assert plan.count("Exchange hashpartitioning(function") == 1
    monkeypatch.setattr(dataaccess, "MAX_LISTED", 0)
    rows = lambda df: sorted((r.function, tuple(r.tables), r.n) for r in df.collect())
    assert rows(blocks) == rows(dataaccess.tables_below(calls, access))


def test_rounds_of_least_paths_write_their_own_paths_only(spark, monkeypatch):
    n = 24
    calls = spark.createDataFrame([(i, (i * k + 1) % n, k) for i in range(n) for k in (1, 5)], "caller long, callee long, ordinal int")  # with cycles
    roots = spark.createDataFrame([(i,) for i in range(0, n, 3)], "root long")
    got = []
    for rounds in (1, 3, 100):
        monkeypatch.setattr(closure, "MERGE_ROUNDS", rounds)
        got.append(sorted((r.root, r.function, tuple(r.path), tuple(r.chain)) for r in closure.least_paths(calls, roots).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 8 * n
    monkeypatch.undo()
    line = spark.createDataFrame([(i, i + 1, 0) for i in range(30)], "caller long, callee long, ordinal int")
    paths, rows = shuffled(spark, lambda: closure.least_paths(line, spark.createDataFrame([(i,) for i in range(31)], "root long")).count())
    assert paths == 31 * 32 // 2 and rows < 7_000  # some 1,000 are the edges of each round


def test_facts_under_a_root_are_merged_before_they_are_dealt(spark):
    n, line = 500, 40
    links = [(i, i + 1, 0) for i in range(line - 1)] + [(line - 1, i, i) for i in range(line, n)]
    facts = [(i, 7 * k, "read" if i % 3 else "write", i + k, i % 2 == 0) for i in range(n) for k in range(4)]
    got = []
    for kind, of in (("long", int), ("string", "app.m:f{:04d}".format)):
        paths = closure.placed(closure.least_paths(spark.createDataFrame([(of(a), of(b), o) for a, b, o in links], f"caller {kind}, callee {kind}, ordinal int"), spark.createDataFrame([(of(i),) for i in range(line)], f"root {kind}")))
        access = spark.createDataFrame([(of(f), *rest) for f, *rest in facts], f"function_id {kind}, table_id long, op string, n long, uncertain boolean")
        usage, rows = shuffled(spark, lambda paths=paths, access=access: dataaccess.table_usage(paths, access).collect())
        got.append(sorted((r.root, r.table_id, sorted(r.ops.items()), r.functions, r.uncertain, r.path, r.place) for r in usage))
        if kind == "long":
            assert rows < 60_000  # of some 77,000 facts under roots
    assert [(of(r), *rest) for r, *rest in got[0]] == got[1]
    assert got[0] == [(r, 7 * k, sorted({"read": sum(i + k for i in range(r, n) if i % 3), "write": sum(i + k for i in range(r, n) if not i % 3)}.items()), n - r, False, [], k + 1) for r in range(line) for k in range(4)]
