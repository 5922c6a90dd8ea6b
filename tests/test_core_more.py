"""Operators and cases that no registered query compares: sources, fingerprints, reasons, nested loops, loops that must end, overlay."""

import pytest
from pyspark.sql import functions as F
from spanloom.operators import catalog, dataaccess, graph, overlay, spans
from spanloom.sources import batches


def test_source_corpus_and_documents(spark, tmp_path):
    for name, text in {"app/a.py": "x = 1\n", "app/b.txt": "no", ".hidden/c.py": "y", "app/venv/d.py": "z", "e.py": "\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: (r.content, r.size) for r in batches.read_source_corpus(spark, str(tmp_path)).collect()}
    assert got == {"app/a.py": ("x = 1\n", 6), "e.py": ("\n", 1)}
    doc = '{"version":1,"project_path":"/p","chains":[{"id":"GET /a","path":"/a","method":"GET","backend":[{"service":{"serviceFunc":"f","rawPath":"/r"},"controller":null,"routes":[]}]},{"id":"GET /b","path":"/b","method":"GET"}]}'
    docs = spark.createDataFrame([(doc,), (doc.replace('"/p"', '"/q"'),), ('{"version":2,"chains":[]}',), ("broken",), (None,)], "json string")
    chains = batches.read_lineage_chains(docs, 1, "/p")
    assert sorted((r.id, r.path, r.handler) for r in chains.collect()) == [("GET /a", "/a", None), ("GET /b", "/b", None)]
    assert [tuple(r) for r in batches.backend_of(chains).collect()] == [("GET /a", "f", "/r", None, None, None, None)] and batches.clients_of(chains).count() == 0


def test_fingerprint_is_free_of_order_and_sees_changes(spark):
    files = [("a.py", 1.0, 10), ("b.py", 2.0, 20), ("c.py", 3.0, 30)]
    mark = lambda rows: tuple(catalog.corpus_fingerprint(spark.createDataFrame(rows, "path string, mtime double, size long")).first())
    assert mark(files) == mark(files[::-1])
    assert len({mark(files), mark(files[:2]), mark([*files[:2], ("c.py", 3.5, 30)]), mark([*files[:2], ("c.py", 3.0, 31)]), mark([*files[:2], ("d.py", 3.0, 30)])}) == 5


def test_reasons_go_with_the_score(spark):
    row = spark.createDataFrame([(3, ["db:x"], 2, 1, 40, False), (0, [], 0, 0, 3, True)], "fan_out int, io array<string>, endpoints int, branches int, loc int, private boolean")
    cols = [F.col(c) for c in row.columns]
    got = row.select(graph.score(*cols).alias("score"), graph.score_reasons(*cols).alias("reasons")).collect()
    assert got[0].score == 9 + 15 + 8 + 5 + 10 and len(got[0].reasons) == 5 and "calls 3 function(s) (+9)" in got[0].reasons
    assert got[1].score < 0 and len(got[1].reasons) >= 2


def test_a_loop_inside_a_loop_is_flagged(spark):
    tree = [("r", "a", None, 1, "root")] + [("r", f"o{i}", "a", 10 + i, "outer") for i in range(3)] + [("r", f"i{i}", "o1", 100 + i, "inner") for i in range(4)]
    s = spark.createDataFrame(tree, "request_id string, span_id string, parent_span_id string, seq long, name string")
    loops = spark.createDataFrame([("r", "a", "outer-key", ["o0", "o1", "o2"]), ("r", "o1", "inner-key", ["i0", "i1", "i2", "i3"])], "request_id string, parent_span_id string, key string, members array<string>")
    assert [tuple(r) for r in spans.nested_loops(s, loops).collect()] == [("inner-key", "outer-key")]


def test_loops_that_do_not_end_raise(spark):
    chain = spark.createDataFrame([(i, i + 1, "call") for i in range(6)], "caller long, callee long, edge string")
    roots = spark.createDataFrame([(0,)], "root long")
    assert graph.reach(chain, roots).count() == 7
    with pytest.raises(RuntimeError):
        graph.reach(chain, roots, max_rounds=3).count()


def test_overlay_of_an_endpoint_is_whole(spark):
    s = spark.createDataFrame([("q", "1", None, "f", 1.0, 1, 5, "ok"), ("q", "2", "1", "g", 2.0, 2, 3, "ok"), ("q", "3", "2", "h", 3.0, 3, 1, "error")], "request_id string, span_id string, parent_span_id string, name string, ts double, seq long, duration_ms long, status string")
    r = spark.createDataFrame([("q", "GET /x", 1.0), ("p", "GET /x", 2.0)], "request_id string, endpoint_id string, ts double")
    one = overlay.endpoint_overlay(s, r, spark.createDataFrame([("g", True)], "id string, deep boolean")).collect()[0]
    assert (one.request_count, one.span_count, one.armed, one.confirmed, one.recent) == (2, 3, ["g"], ["f>g", "f>h", "g>h"], ["p", "q"])
    assert one.functions["h"]["errors"] == 1 and one.functions["h"]["last"]["span_id"] == "3"


def test_graph_query_facts_and_edges(spark):
    rows = [
        (1, "MATCH (a:user:Admin {id: 1})-[r:knows|:`LIKES IT`|SAW_IT]->(:`Odd: (Name)`) WHERE r.since > 1 RETURN a.name"),
        (2, "merge (n:Thing) SET n:Other RETURN n"),
        (3, "MATCH (a)-->(b) WHERE (a.x = 1) RETURN b"),
        (4, None),
        (5, "MATCH (x:A:B) MATCH (y:\x00) MERGE (x)-[:\x00]->(y) CREATE (y)<-[:T_X {k: 1}]-(x)"),
        (6, "MATCH (p:P)<-[:R]-(q:Q)-[:S {a: 1, b: toLower($x)}]-(p) RETURN count(p)"),
    ]
    table = spark.createDataFrame(rows, "k int, query string")
    got = {r.k: r for r in dataaccess.graph_query_facts(table).collect()}
    assert (got[1].op, got[1].labels, got[1].types) == ("read", ["Admin", "Odd: (Name)"], ["LIKES IT", "SAW_IT"])
    assert [tuple(x) for x in got[1].label_props] == [("Admin", "id"), ("Admin", "name")] and [tuple(x) for x in got[1].type_props] == [("LIKES IT", "since"), ("SAW_IT", "since")]
    assert (got[2].op, got[2].labels, got[2].types) == ("write", ["Thing"], [])
    assert (got[3].labels, got[3].types, got[3].dynamic_label) == ([], [], False)
    assert got[4].labels is None and got[4].types is None
    assert (got[5].labels, got[5].types, got[5].dynamic_label, got[5].dynamic_type) == (["A", "B"], ["T_X"], True, True)
    edges = {(r.k, r.source, r.type, r.target) for r in dataaccess.graph_query_edges(table).collect()}
    assert edges == {(1, "Admin", "LIKES IT", "Odd: (Name)"), (1, "Admin", "SAW_IT", "Odd: (Name)"), (6, "Q", "R", "P")}
