"""Golden rows of operators, and cases that the registered queries don't have."""

from spanloom.functions import pysource, text
from spanloom.functions.tables import running_sum
from spanloom.operators import catalog, events, graph, overlay, selection, spans
from spanloom.sources import batches


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_most_specific_endpoint_wins(spark):
    e = spark.createDataFrame([(1, "GET /a/{id}", "GET", "/a/{id}"), (2, "GET /a/new", "GET", "/a/new"), (3, "GET /f/{p:path}", "GET", "/f/{p:path}"), (4, "GET /a.b/{x}", "GET", "/a.b/{x}")], "ord int, endpoint_id string, method string, pattern string")
    r = spark.createDataFrame([("r1", "get", "/a/7?q=1"), ("r2", "GET", "/a/new"), ("r3", "GET", "/f/x/y/z"), ("r4", "POST", "/a/7"), ("r5", "GET", "/a/7/"), ("r6", "GET", "/axb/1")], "request_id string, method string, path string")
    assert rows(overlay.match_endpoint(r, e).select("request_id", "endpoint_id")) == [("r1", "GET /a/{id}"), ("r2", "GET /a/new"), ("r3", "GET /f/{p:path}"), ("r5", "GET /a/{id}")]


def test_large_requests_go_by_joins(spark):
    chain = [("r", f"s{i:03}", f"s{i - 1:03}" if i else None, i, "f") for i in range(30)]
    s = spark.createDataFrame(chain, "request_id string, span_id string, parent_span_id string, seq long, name string")
    assert rows(spans.ancestor_pairs(s, max_group=5)) == rows(spans.ancestor_pairs(s))


def test_whole_requests_and_the_newest_is_kept(spark):
    ev = spark.createDataFrame([(f"r{r}", 100 * r + k) for r in range(3) for k in range(10)], "request_id string, seq long")
    assert {r[0] for r in rows(events.retain_whole_requests(ev, 25).select("request_id").distinct())} == {"r1", "r2"}
    assert {r[0] for r in rows(events.retain_whole_requests(ev, 5).select("request_id").distinct())} == {"r2"}


def test_running_sum_in_groups(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS v")
    got = {r["id"]: r["total"] for r in running_sum(df, "v", "id", "total", part_rows=40).collect()}
    total, want = 0, {}
    for i in range(999, -1, -1):
        total += i % 7
        want[i] = total
    assert got == want


def test_secrets_and_payloads(spark):
    df = spark.createDataFrame([('{"a": {"apiKey": 1, "n": [{"Password": "x"}]}}', "{'k': (1, None)}")], "j string, p string")
    r = df.select(text.redact_nested("j"), text.normalise_payload("p"), text.decode_entities(events.F.lit("&amp;lt;"))).first()
    assert r[0] == '{"a": {"apiKey": "«redacted»", "n": [{"Password": "«redacted»"}]}}' and r[1] == '{"k": [1, null]}' and r[2] == "<"


def test_cycles_and_collapse(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5)], "caller long, callee long")
    assert rows(graph.recursive_edges(e)) == [(1, 2), (2, 3), (3, 1), (4, 4)]
    roles = spark.createDataFrame([(1, "main"), (2, "child"), (3, "child"), (4, "main"), (5, "child")], "function long, role string")
    edges, absorbed = graph.collapse_edges(e, roles)
    assert rows(edges.select("source", "target", "via")) == [(1, 4, 1)]
    assert rows(absorbed.select("source", "child", "shared")) == [(1, 2, False), (1, 3, False), (4, 5, False)]


def test_bad_files_are_rows(spark):
    files = spark.createDataFrame([("a/b.py", "class K:\n    async def m(self, x: int = 1, *a, k, **kw): ...\n"), ("bad.py", "def f(:"), ("a/__init__.py", "")], "path string, content string")
    got = {(r.path, r.kind, r.qualname): r for r in catalog.scan_functions(files).collect()}
    assert set(got) == {("a/b.py", "class", "K"), ("a/b.py", "method", "K.m"), ("bad.py", "error", None)}
    m = got["a/b.py", "method", "K.m"]
    assert [(p.name, p.default, p.kind, p.required) for p in m.params] == [("self", None, "positional_or_keyword", True), ("x", "1", "positional_or_keyword", False), ("a", None, "var_positional", False), ("k", None, "keyword_only", True), ("kw", None, "var_keyword", False)]
    assert m.module == "a.b" and m.is_async


def test_relative_imports():
    assert list(pysource.imports("a/b/c.py", "from . import x\nfrom ..d import y as z\nimport os.path\nfrom q import *\n")) == [("a/b/c.py", "a.b.c", "x", "a.b", "x"), ("a/b/c.py", "a.b.c", "z", "a.d", "y"), ("a/b/c.py", "a.b.c", "os", "os", None)]


def test_close_matches_agree(spark):
    known = spark.createDataFrame([("app.core:load",), ("app.core:loads",), ("app.io:save",)], "id string")
    lost = spark.createDataFrame([("app.core:lod",)], "id string")
    for exact in (False, True):
        got = catalog.close_matches(lost, known, exact=exact).orderBy("rank").collect()
        assert [r.match for r in got][:2] == ["app.core:load", "app.core:loads"]


def test_hidden_folders_are_no_source(spark):
    f = spark.createDataFrame([("a/x.py",), (".venv/x.py",), ("a/node_modules/x.py",), ("a/x.txt",)], "path string")
    assert rows(batches.source_files(f)) == [("a/x.py",)]


def test_selection_log(spark):
    log = [(1, 1, "add", "a", True), (1, 2, "clear", None, None), (1, 2, "add", "b", False), (1, 3, "add", "c", False), (1, 4, "remove", "b", None), (1, 5, "add", "c", True)]
    df = spark.createDataFrame(log, "instance int, change_no int, op string, id string, deep boolean")
    assert rows(selection.apply_selection_log(df)) == [(1, "c", True)]
