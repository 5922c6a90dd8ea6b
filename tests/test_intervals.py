"""Places in request trees, the walks over edges, and what they give, against plain Python."""

import random

import pytest
from spanloom.operators import closure, graph, overlay, spans


def forest(seed, requests=6, most=40):
    r = random.Random(seed)
    rows = []
    for q in range(requests):
        n = r.randint(1, most)
        for k in range(n):
            up = None if k == 0 or r.random() < 0.1 else f"s{r.randrange(k)}" if r.random() < 0.9 else "gone"
            rows.append((f"r{q}", f"s{k}", up, r.randint(0, 30), r.choice(["a", "b", "c", None])))
    return rows


def ancestors(rows):
    up = {(q, s): (q, p) for q, s, p, _, _ in rows}
    out = {}
    for k in up:
        out[k], at = [], up[k]
        while at in up:
            out[k].append(at)
            at = up[at]
    return out


SCHEMA = "request_id string, span_id string, parent_span_id string, seq long, name string"


@pytest.mark.parametrize("most", [5000, 3])
def test_labels_say_who_is_above(spark, most):
    rows = forest(4)
    got = {(x.request_id, x.span_id): x for x in spans.interval_labels(spark.createDataFrame(rows, SCHEMA), most).collect()}
    above = ancestors(rows)
    assert len(got) == len(rows)
    for a in got.values():
        for d in got.values():
            if a.request_id == d.request_id:
                assert (a.pre < d.pre <= a.last) == ((a.request_id, a.span_id) in above[d.request_id, d.span_id])
    name = {(q, s): n for q, s, _, _, n in rows}
    path = {k: (name[k], *[name[a] for a in up]) for k, up in above.items()}
    assert len({(path[k], x.fold, x.up) for k, x in got.items()}) == len(set(path.values())) == len({x.fold for x in got.values()})
    pairs = {(name[a], name[k]) for k, up in above.items() for a in up} 
    want = sorted(p for p in pairs if None not in p)
    assert sorted(tuple(x) for x in spans.folded_pairs(spans.interval_labels(spark.createDataFrame(rows, SCHEMA), most).select("fold", "up", "name")).collect()) == want
    assert sorted(tuple(x) for x in overlay.confirmed_edges(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_nearest_marked_span(spark):
    rows = forest(9)
    r = random.Random(1)
    chosen = {(q, s) for q, s, *_ in rows if r.random() < 0.3}
    labels = spans.interval_labels(spark.createDataFrame(rows, SCHEMA)).join(spark.createDataFrame([(*k, (k in chosen)) for k in {(q, s) for q, s, *_ in rows}], "request_id string, span_id string, marked boolean"), ["request_id", "span_id"])
    above = ancestors(rows)
    for x in spans.marked_above(labels.select("request_id", "span_id", "pre", "last", "marked")).collect():
        up = [a for a in above[x.request_id, x.span_id] if a in chosen]
        assert (x.n_above, x.above) == (len(up), up[0][1] if up else None)


def edges_of(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def reach_of(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize(("n", "m"), [(30, 45), (12, 40), (40, 20)])
def test_walks_against_plain_ones(spark, n, m):
    e = edges_of(n, n, m) + [(3, 3)]
    df = spark.createDataFrame(e, "caller long, callee long")
    roots = spark.createDataFrame([(k,) for k in range(0, n, 3)], "root long")
    want = sorted((k, f) for k in range(0, n, 3) for f in reach_of(e, k))
    assert sorted(tuple(x) for x in graph.reach(df, roots).collect()) == want
    counts = {x.function: x.roots for x in graph.endpoints_reaching(df, roots).collect()}
    assert counts == {f: sum(b == f for _, b in want) for _, f in want}
    on_cycle = sorted({(a, b) for a, b in e if a in reach_of(e, b)})
    found = closure.cycles(df).collect()
    assert sorted((x.caller, x.callee) for x in found) == on_cycle
    for x in found:
        assert x.component in reach_of(e, x.caller) and x.caller in reach_of(e, x.component)


def test_least_paths_are_those_of_a_depth_first_walk(spark):
    r = random.Random(2)
    e = list({(a, b): (a, b, o) for o, (a, b) in enumerate(edges_of(7, 14, 40)) if a != b}.values())
    calls = {}
    for a, b, o in e:
        calls.setdefault(a, []).append((o, b))
    want = []
    for root in (0, 5):
        seen = set()

        def walk(f, path, chain):
            if f not in seen:
                seen.add(f)
                want.append((root, f, path, chain))
                for o, g in sorted(calls.get(f, [])):
                    walk(g, [*path, o], [*chain, g])

        walk(root, [], [root])
    r.shuffle(e)
    got = closure.least_paths(spark.createDataFrame(e, "caller long, callee long, ordinal int"), spark.createDataFrame([(0,), (5,)], "root long")).collect()
    assert sorted((x.root, x.function, list(x.path), list(x.chain)) for x in got) == sorted(want)


def test_totals_are_exact_and_loops_raise(spark):
    deep = [(k, k + 1) for k in range(70) for _ in range(2)]  # 2 ** 70 places
    nodes = spark.createDataFrame([(k, "function" if k else "external", k == 70) for k in range(71)], "node long, kind string, cyclic boolean")
    links = spark.createDataFrame(deep, "parent long, child long")
    x = graph.tree_stats(nodes, links, spark.createDataFrame([(0,)], "root long")).first()
    assert (int(x.nodes), int(x.cyclic), x.max_depth, int(x.external), x.coverage) == (2**71 - 1, 2**70, 70, 1, 1.0)
    with pytest.raises(ValueError):
        graph.tree_stats(nodes, links.union(spark.createDataFrame([(70, 3)], "parent long, child long")), spark.createDataFrame([(0,)], "root long"))
