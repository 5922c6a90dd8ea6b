"""Call-graph analytics over an edge table (caller, callee, edge); the walks are in `closure`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import durable
from .closure import cycles, depths, numbered_roots, pairs_of, roots_reaching, spread, totals_below

#: The first hint that a module's lower-cased name contains gives its layer.
LAYER_HINTS = (
    ("router", "api"), ("route", "api"), ("endpoint", "api"), ("api", "api"), ("handler", "api"),
    ("service", "service"), ("usecase", "service"), ("workflow", "service"), ("logic", "service"),
    ("repo", "data"), ("model", "data"), ("db", "data"), ("database", "data"), ("schema", "data"), ("store", "data"),
    ("util", "util"), ("helper", "util"), ("common", "util"), ("lib", "util"),
)
MAIN_THRESHOLD = 12.0


def reach(edges: DataFrame, roots: DataFrame, through: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(root, function): all that each root reaches, and itself.

    With `through` (function), paths go on only from the functions it lists (and from roots).
    """
    named = numbered_roots(roots)
    return pairs_of(spread(edges, named, through, max_rounds), named)


def endpoints_reaching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(function, roots): how many roots reach each function that any does; no pair of them is made."""
    return roots_reaching(spread(edges, numbered_roots(roots)))


def min_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(function, depth, roots): fewest hops from any root, and how many roots reach the function."""
    return depths(edges, roots).join(endpoints_reaching(edges, roots), "function")


def degree(edges: DataFrame) -> DataFrame:
    """(function, fan_in, fan_out): distinct callers and callees, itself apart."""
    e = edges.select("caller", "callee").filter("caller <> callee").distinct()
    ends = e.select(F.col("caller").alias("function"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("callee", F.lit(0), F.lit(1)))
    return ends.groupBy("function").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def io_tags(access: DataFrame) -> DataFrame:
    """(function_id, io): sorted db:<table> and ext:<root package> tags of each function. `access` has kind and target."""
    tag = F.when(F.col("kind") == "db", F.concat(F.lit("db:"), F.col("target").cast("string"))).when(F.col("kind") == "external", F.concat(F.lit("ext:"), F.substring_index(F.col("target").cast("string"), ".", 1)))
    tags = access.select("function_id", tag.alias("tag")).dropna().distinct()
    return tags.groupBy("function_id").agg(F.array_sort(F.collect_list("tag")).alias("io"))


def score(fan_out: Column, io: Column, endpoints: Column, branches: Column, loc: Column, private: Column) -> Column:
    """A function's weight in the map."""
    n = F.size(F.coalesce(io, F.array().cast("array<string>")))
    points = F.when(fan_out > 0, 3.0 * F.least(fan_out, F.lit(8))).otherwise(0.0)
    points += F.when(n > 0, 15.0).otherwise(0.0)
    points += F.when((endpoints > 1) & (fan_out > 0), 4.0 * F.least(endpoints, F.lit(5))).otherwise(0.0)
    points += F.when(branches > 0, 5.0).otherwise(0.0)
    size = F.least(loc, F.lit(60)) / 4
    points += F.when(size >= 1, size).otherwise(0.0)
    points -= F.when(private, 10.0).otherwise(0.0)
    return points - F.when((loc <= 4) & (fan_out <= 1), 15.0).otherwise(0.0)


def score_reasons(fan_out: Column, io: Column, endpoints: Column, branches: Column, loc: Column, private: Column) -> Column:
    """The reasons behind the score, as an array of text."""
    n = F.size(F.coalesce(io, F.array().cast("array<string>")))
    g = lambda x: F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")
    size = F.least(loc, F.lit(60)) / 4
    parts = [
        F.when(fan_out > 0, F.concat(F.lit("calls "), fan_out.cast("string"), F.lit(" function(s) (+"), g(3 * F.least(fan_out, F.lit(8))), F.lit(")"))),
        F.when(n > 0, F.concat(F.lit("touches I/O: "), F.array_join(F.slice(io, 1, 3), ", "), F.lit(" (+15)"))),
        F.when((endpoints > 1) & (fan_out > 0), F.concat(F.lit("reached from "), endpoints.cast("string"), F.lit(" endpoints (+"), g(4 * F.least(endpoints, F.lit(5))), F.lit(")"))),
        F.when(branches > 0, F.lit("has branching logic (+5)")),
        F.when(size >= 1, F.concat(loc.cast("string"), F.lit(" lines (+"), g(size), F.lit(")"))),
        F.when(private, F.lit("private name (-10)")),
        F.when((loc <= 4) & (fan_out <= 1), F.lit("tiny wrapper (-15)")),
    ]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def classify(metrics: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """metrics (function_id, fan_out, io, endpoints, branches, loc, private, is_handler, is_depends) with score, role and reasons."""
    args = [F.col(c) for c in ("fan_out", "io", "endpoints", "branches", "loc", "private")]
    has_io = F.size(F.coalesce("io", F.array().cast("array<string>"))) > 0
    m = metrics.withColumns({"score": F.round(score(*args), 1), "reasons": score_reasons(*args)})
    depends = F.col("is_depends") & has_io
    leaf = (F.col("fan_out") == 0) & ~has_io
    role = F.when(F.col("is_handler") | depends, "main").when(leaf, "child").when(score(*args) >= MAIN_THRESHOLD, "main").otherwise("child")
    reasons = F.when(F.col("is_handler"), F.concat(F.array(F.lit("endpoint handler")), "reasons")).when(depends, F.concat(F.array(F.lit("dependency with I/O")), "reasons")).when(leaf, F.array(F.lit("leaf helper: calls nothing, no I/O"))).otherwise(F.col("reasons"))
    m = m.withColumns({"role": role, "reasons": reasons})
    if overrides is None:
        return m
    pins = overrides.filter(F.col("role").isin("main", "child")).select("function_id", F.col("role").alias("_pin"))
    pinned = F.concat(F.array(F.concat(F.lit("pinned "), F.col("_pin"), F.lit(" by override"))), "reasons")
    m = m.join(pins, "function_id", "left").withColumn("reasons", F.when(F.col("_pin").isNotNull(), pinned).otherwise(F.col("reasons")))
    return m.withColumn("role", F.coalesce("_pin", "role")).drop("_pin")


def collapse_edges(edges: DataFrame, roles: DataFrame, order: str = "callee") -> tuple[DataFrame, DataFrame]:
    """Edges between mains through chains of children, and what each main absorbs.

    edges (caller, callee, edge) -> (source, target, kind, via) and (source, child, shared). `kind` is that of the source's call
    whose chain reaches the target: of several, the last by `order`. `via` counts the absorbed children that call the target.
    """
    mains = roles.filter("role = 'main'").select("function")
    children = roles.filter("role = 'child'").select("function")
    edges = edges if "edge" in edges.columns else edges.withColumn("edge", F.lit(None).cast("string"))
    known = durable(edges.filter("caller <> callee").groupBy("caller", "callee").agg(F.min(F.struct(F.col(order).alias("order"), "edge")).alias("first")))
    # what each child leads to; a main leads to itself
    led = reach(known, children.select(F.col("function").alias("root")), through=children)
    led = led.union(mains.select(F.col("function").alias("root"), "function"))
    hops = known.join(mains.select(F.col("function").alias("caller")), "caller", "left_semi").select(F.col("caller").alias("source"), F.col("callee").alias("root"), "first")
    hit = durable(hops.join(led, "root").filter("function <> source").groupBy("source", "function").agg(F.max_by("first.edge", "first").alias("kind")))
    to_main = hit.join(mains, "function", "left_semi").select("source", F.col("function").alias("target"), "kind")
    absorbed = hit.join(children, "function", "left_semi").select("source", F.col("function").alias("child"))
    users = absorbed.groupBy("child").agg((F.count("*") > 1).alias("shared"))
    calls = absorbed.join(known, absorbed["child"] == known["caller"]).select("source", F.col("callee").alias("target"), "child")
    via = calls.groupBy("source", "target").agg(F.count("*").alias("via"))
    return to_main.join(via, ["source", "target"], "left").fillna(0, ["via"]), absorbed.join(users, "child")


def layer_of(module: Column) -> Column:
    low, out = F.lower(module), F.lit("core")
    for hint, layer in reversed(LAYER_HINTS):
        out = F.when(F.contains(low, F.lit(hint)), layer).otherwise(out)
    return out


def module_map(functions: DataFrame, depths: DataFrame) -> DataFrame:
    """Per module: layer, number of functions, least depth (99 if never reached) and its column in the map."""
    d = functions.join(depths.select(F.col("function").alias("function_id"), "depth"), "function_id", "left")
    per = d.groupBy("module").agg(F.count("*").alias("functions"), F.coalesce(F.min("depth"), F.lit(99)).alias("min_depth"))
    return per.withColumns({"layer": layer_of(F.col("module")), "column": F.dense_rank().over(W.orderBy("min_depth"))})  # one row per module


def module_edges(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, edges): distinct calls between modules."""
    a = functions.select(F.col("function_id").alias("caller"), F.col("module").alias("source"))
    b = functions.select(F.col("function_id").alias("callee"), F.col("module").alias("target"))
    e = edges.select("caller", "callee").distinct().join(a, "caller").join(b, "callee")
    return e.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("edges"))


def unreached(functions: DataFrame, reached: DataFrame) -> DataFrame:
    return functions.filter(~F.col("name").startswith("_")).join(reached.select(F.col("function").alias("function_id")).distinct(), "function_id", "left_anti")


def neighbours(edges: DataFrame, node: int | str) -> DataFrame:
    """(function, direction): one hop around a function."""
    e = edges.filter("caller <> callee")
    out = e.filter(F.col("caller") == node).select(F.col("callee").alias("function"), F.lit("out").alias("direction"))
    return out.union(e.filter(F.col("callee") == node).select("caller", F.lit("in"))).distinct()


def nearest_function(nodes: DataFrame) -> DataFrame:
    """nodes (tree_id, node_id, parent_id, kind, ...) with owner: the nearest function above, by pointer jumping in log rounds."""
    up = nodes.select("tree_id", "node_id", F.col("parent_id").alias("_up"))
    parent_kind = nodes.select("tree_id", F.col("node_id").alias("_up"), (F.col("kind") == "function").alias("_stop"))
    state = durable(up.join(parent_kind, ["tree_id", "_up"], "left").withColumn("_stop", F.coalesce("_stop", F.lit(True))))
    for _ in range(64):
        if state.filter(~F.col("_stop")).isEmpty():
            break
        nxt = state.select("tree_id", F.col("node_id").alias("_up"), F.col("_up").alias("_up2"), F.col("_stop").alias("_stop2"))
        jumped = state.filter(~F.col("_stop")).join(nxt, ["tree_id", "_up"], "left")
        jumped = jumped.select("tree_id", F.col("_up2").alias("_up"), "node_id", F.coalesce("_stop2", F.lit(True)).alias("_stop"))
        state = durable(state.filter("_stop").unionByName(jumped))
    return nodes.join(state.select("tree_id", "node_id", F.col("_up").alias("owner")), ["tree_id", "node_id"], "left")


def function_view(nodes: DataFrame, library_cap: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Control nodes dissolved: (calls, libraries, data), each by owning function.

    calls: (tree_id, owner, function_id, count); libraries: external, class and unresolved callees of a function, the first
    `library_cap` by kind and name, with how many more there are; data: tables with operations, uncertain if all evidence is.
    """
    owned = nearest_function(nodes)
    names = owned.filter("kind = 'function'").select("tree_id", F.col("node_id").alias("owner"), F.col("function_id").alias("caller"))
    held = owned.join(names, ["tree_id", "owner"], "left")
    calls = held.filter("kind = 'function'").groupBy("tree_id", "caller", "function_id").agg(F.count("*").alias("count"))
    rank = F.when(F.col("kind") == "external", 0).when(F.col("kind") == "class", 1).otherwise(2)
    libs = held.filter(F.col("kind").isin("external", "class", "unresolved")).groupBy("tree_id", "caller", "kind", "name").agg(F.count("*").alias("count"))
    own = W.partitionBy("tree_id", "caller")
    libs = libs.withColumns({"place": F.row_number().over(own.orderBy(rank, "name")), "more": F.greatest(F.count("*").over(own) - library_cap, F.lit(0))}).filter(F.col("place") <= library_cap)
    data = held.filter("kind = 'db'").groupBy("tree_id", "caller", F.col("name").alias("table"), "op").agg(F.count("*").alias("count"), F.min("uncertain").alias("uncertain"))
    return calls, libs, data


#: Kinds of nodes that trees are counted by; the first three are calls that could be named.
TREE_KINDS = ("function", "external", "class", "unresolved", "loop", "branch", "graph", "dispatch")


def tree_stats(nodes: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: positions of each kind in its unrolled tree (shared subtrees counted each time), cyclic ones, nodes, max_depth, coverage.

    nodes (node, kind, cyclic), links (parent, child). Counts are exact. Coverage is named calls over all, 1 without any.
    """
    one = {k: (F.col("kind") == k).cast("int") for k in TREE_KINDS} | {"cyclic": F.col("cyclic").cast("int")}
    below = totals_below(nodes, links, one).join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi")
    known = F.col("function") + F.col("external") + F.col("class")
    coverage = F.when(known + F.col("unresolved") > 0, F.round(known.cast("double") / (known + F.col("unresolved")).cast("double"), 3)).otherwise(1.0)
    return below.select(F.col("node").alias("root"), *TREE_KINDS, "cyclic", F.col("height").alias("max_depth"), coverage.alias("coverage"), sum((F.col(k) for k in TREE_KINDS[1:]), F.col(TREE_KINDS[0])).cast("decimal(38,0)").alias("nodes"))


def view_stats(full: DataFrame, view: DataFrame) -> DataFrame:
    """Per root, of two tree_stats: functions, depth and cycles as the view shows them, libraries and coverage as the full tree has them."""
    shown = view.select("root", "function", "max_depth", "cyclic", F.col("function").alias("nodes"))
    return shown.join(full.select("root", "external", "class", "unresolved", "graph", "coverage"), "root")


def recursive_edges(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(caller, callee): edges whose callee reaches their caller, which are those inside a strongly connected component."""
    return cycles(edges, max_rounds).select("caller", "callee")


def search_tree(nodes: DataFrame, query: str) -> DataFrame:
    """(tree_id, path, is_hit): nodes with the text in any of their texts, and their ancestors, which are the prefixes of their paths.

    Looked at are name, function_id, label, call_expr and external, where nodes have them; the root of a tree is no hit.
    """
    q, hit = query.strip().lower(), F.lit(False)
    for c in ("name", "function_id", "label", "call_expr", "external"):
        if c in nodes.columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    hits = nodes.filter(hit & F.contains("path", F.lit(".")))
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    every = hits.select("tree_id", F.col("path").alias("_hit"), F.explode(prefixes).alias("path"))
    return every.groupBy("tree_id", "path").agg(F.max(F.col("_hit") == F.col("path")).alias("is_hit"))
