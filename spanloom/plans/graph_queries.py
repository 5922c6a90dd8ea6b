"""Registered queries of the call-graph, data-access and lineage operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import free
from ..operators import closure, dataaccess, graph, lineage
from .fixtures import Tables, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


_REACH = """
 walk AS (SELECT root, root AS function, 0 AS depth FROM fx_roots UNION SELECT w.root, e.callee, w.depth + 1 FROM walk w JOIN fx_call_edges e ON e.caller = w.function WHERE w.depth < 60),
 reached AS (SELECT root, function, min(depth) AS depth FROM walk GROUP BY 1, 2)"""


def _reached(t):  # noqa: ANN001, ANN202
    return graph.reach(t("fx_call_edges"), t("fx_roots"))


@query("H1_reach", f"WITH RECURSIVE {_REACH} SELECT root, function FROM reached")
def _(t):
    return _reached(t).select("root", "function")


@query("H2_min_depth", f"WITH RECURSIVE {_REACH} SELECT function, min(depth) AS depth, count(*) AS roots FROM reached GROUP BY 1")
def _(t):
    return graph.min_depth(t("fx_call_edges"), t("fx_roots"))


_DEGREE = """
 deg AS (SELECT function, count(DISTINCT i) AS fan_in, count(DISTINCT o) AS fan_out FROM (
  SELECT caller AS function, NULL AS i, callee AS o FROM fx_call_edges WHERE caller <> callee UNION ALL SELECT callee, caller, NULL FROM fx_call_edges WHERE caller <> callee) x GROUP BY 1)"""


@query("H3_degree", f"WITH {_DEGREE} SELECT * FROM deg")
def _(t):
    return graph.degree(t("fx_call_edges"))


_IO = """
 io AS (SELECT function_id, list_sort(list(DISTINCT tag)) AS io FROM (
  SELECT function_id, concat('db:', CAST(table_id AS STRING)) AS tag FROM fx_db_access UNION ALL SELECT p_partkey, concat('ext:', split_part(lower(replace(p_brand, '#', '.')), '.', 1)) FROM part WHERE p_size % 4 = 0) x GROUP BY 1)"""


def _io(t):  # noqa: ANN001, ANN202
    db = t("fx_db_access").select("function_id", F.lit("db").alias("kind"), F.col("table_id").cast("string").alias("target"))
    ext = t("part").filter("p_size % 4 = 0").select(F.col("p_partkey"), F.lit("external"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))))
    return graph.io_tags(db.union(ext))


@query("H4_io_tags", f"WITH {_IO} SELECT * FROM io")
def _(t):
    return _io(t)


_METRICS = f"""
 {_REACH}, {_DEGREE}, {_IO}, eps AS (SELECT function, count(*) AS endpoints FROM reached GROUP BY 1),
 m AS (SELECT f.function_id, coalesce(fan_out, 0) AS fan_out, io, coalesce(len(io), 0) AS nio, coalesce(endpoints, 0) AS endpoints, branches, loc, starts_with(name, '_') AS private,
  f.function_id IN (SELECT root FROM fx_roots) AS is_handler, f.function_id % 11 = 0 AS is_depends
  FROM fx_functions f LEFT JOIN deg d ON d.function = f.function_id LEFT JOIN io i ON i.function_id = f.function_id LEFT JOIN eps e ON e.function = f.function_id),
 s AS (SELECT *, CASE WHEN fan_out > 0 THEN 3.0 * least(fan_out, 8) ELSE 0 END + CASE WHEN nio > 0 THEN 15 ELSE 0 END + CASE WHEN endpoints > 1 AND fan_out > 0 THEN 4.0 * least(endpoints, 5) ELSE 0 END
  + CASE WHEN branches > 0 THEN 5 ELSE 0 END + CASE WHEN least(loc, 60) / 4.0 >= 1 THEN least(loc, 60) / 4.0 ELSE 0 END - CASE WHEN private THEN 10 ELSE 0 END - CASE WHEN loc <= 4 AND fan_out <= 1 THEN 15 ELSE 0 END AS raw FROM m),
 roles AS (SELECT *, CASE WHEN is_handler OR (is_depends AND nio > 0) THEN 'main' WHEN fan_out = 0 AND nio = 0 THEN 'child' WHEN raw >= 12 THEN 'main' ELSE 'child' END AS role FROM s)"""


def _roles(t):  # noqa: ANN001, ANN202
    f = t("fx_functions")
    degree = graph.degree(t("fx_call_edges")).select(F.col("function").alias("function_id"), "fan_out")
    eps = graph.endpoints_reaching(t("fx_call_edges"), t("fx_roots")).select(F.col("function").alias("function_id"), F.col("roots").alias("endpoints"))
    handlers = t("fx_roots").select(F.col("root").alias("function_id"), F.lit(True).alias("is_handler"))
    m = f.join(degree, "function_id", "left").join(_io(t), "function_id", "left").join(eps, "function_id", "left").join(handlers, "function_id", "left")
    m = m.fillna({"fan_out": 0, "endpoints": 0, "is_handler": False}).withColumns({"private": F.col("name").startswith("_"), "is_depends": F.col("function_id") % 11 == 0})
    return graph.classify(m)


@query("H5_score", f"WITH RECURSIVE {_METRICS} SELECT function_id, round(raw, 1) AS score FROM roles")
def _(t):
    return _roles(t).select("function_id", "score")


@query("H5_reasons")
def _(t):
    return _roles(t).select("function_id", "score", "reasons")


@query("H6_classify", f"WITH RECURSIVE {_METRICS} SELECT function_id, role FROM roles")
def _(t):
    return _roles(t).select("function_id", "role")


_PARITY = """
 role AS (SELECT CAST(p_partkey AS BIGINT) AS function, CASE WHEN p_size % 3 = 0 THEN 'child' ELSE 'main' END AS role FROM part),
 e AS (SELECT caller, callee, min(edge) AS edge FROM fx_call_edges WHERE caller <> callee GROUP BY 1, 2),
 hit AS (SELECT r.function AS source, e.callee AS function, e.callee AS hop FROM role r JOIN e ON e.caller = r.function WHERE r.role = 'main'
  UNION SELECT h.source, e.callee, h.hop FROM hit h JOIN role r ON r.function = h.function AND r.role = 'child' JOIN e ON e.caller = h.function WHERE e.callee <> h.source),
 found AS (SELECT source, function, max(hop) AS hop FROM hit WHERE source <> function GROUP BY 1, 2)"""


def _parity(t):  # noqa: ANN001, ANN202
    return t("part").select(F.col("p_partkey").alias("function"), F.when(F.col("p_size") % 3 == 0, "child").otherwise("main").alias("role"))


@query("H7_collapse_edges", f"""
 WITH RECURSIVE {_PARITY},
 via AS (SELECT a.source, e.callee AS target, count(*) AS via FROM found a JOIN role c ON c.function = a.function AND c.role = 'child' JOIN e ON e.caller = a.function GROUP BY 1, 2)
 SELECT h.source, h.function AS target, k.edge AS kind, coalesce(via, 0) AS via FROM found h JOIN role r ON r.function = h.function AND r.role = 'main' JOIN e k ON k.caller = h.source AND k.callee = h.hop
 LEFT JOIN via v ON v.source = h.source AND v.target = h.function""")
def _(t):
    return graph.collapse_edges(t("fx_call_edges"), _parity(t))[0]


@query("H7_absorbed", f"""
 WITH RECURSIVE {_PARITY}
 SELECT h.source, h.function AS child, count(*) OVER (PARTITION BY h.function) > 1 AS shared FROM found h JOIN role r ON r.function = h.function WHERE r.role = 'child'""")
def _(t):
    return graph.collapse_edges(t("fx_call_edges"), _parity(t))[1].select("source", "child", "shared")


_LAYER = "CASE " + " ".join(f"WHEN contains(lower(module), '{h}') THEN '{layer}'" for h, layer in graph.LAYER_HINTS) + " ELSE 'core' END"


@query("H8_module_map", f"""
 WITH RECURSIVE {_REACH}, d AS (SELECT function, min(depth) AS depth FROM reached GROUP BY 1),
 p AS (SELECT module, count(*) AS functions, coalesce(min(depth), 99) AS min_depth FROM fx_functions f LEFT JOIN d ON d.function = f.function_id GROUP BY 1)
 SELECT module, functions, min_depth, {_LAYER} AS layer, dense_rank() OVER (ORDER BY min_depth) AS "column" FROM p""")
def _(t):
    return graph.module_map(t("fx_functions"), graph.depths(t("fx_call_edges"), t("fx_roots")))


@query("H8_module_edges", """
 SELECT a.module AS source, b.module AS target, count(*) AS edges FROM (SELECT DISTINCT caller, callee FROM fx_call_edges) e JOIN fx_functions a ON a.function_id = e.caller JOIN fx_functions b ON b.function_id = e.callee
 WHERE a.module <> b.module GROUP BY 1, 2""")
def _(t):
    return graph.module_edges(t("fx_functions"), t("fx_call_edges"))


@query("H9_unreached", f"WITH RECURSIVE {_REACH} SELECT function_id, module FROM fx_functions WHERE NOT starts_with(name, '_') AND function_id NOT IN (SELECT function FROM reached)")
def _(t):
    return graph.unreached(t("fx_functions"), graph.depths(t("fx_call_edges"), t("fx_roots"))).select("function_id", "module")


@query("H9_map_stats", f"WITH RECURSIVE {_METRICS} SELECT role, count(*) AS functions FROM roles GROUP BY 1")
def _(t):
    return _roles(t).groupBy("role").agg(F.count("*").alias("functions"))


@query("H9_neighbours", """
 SELECT DISTINCT function, direction FROM (SELECT callee AS function, 'out' AS direction FROM fx_call_edges WHERE caller = 40 UNION ALL SELECT caller, 'in' FROM fx_call_edges WHERE callee = 40) x WHERE function <> 40""")
def _(t):
    return graph.neighbours(t("fx_call_edges"), 40)


_NODES = """
 nodes AS (SELECT request_id AS tree_id, span_id AS node_id, parent_span_id AS parent_id, name, name AS function_id, 'x' AS op, status = 'ok' AS uncertain,
  CASE WHEN parent_span_id IS NULL OR name = 'svc.loop:step' THEN 'function' WHEN name = 'svc.error:run' THEN 'db' WHEN name = 'svc.click:run' THEN 'branch' WHEN name = 'svc.view:run' THEN 'class' ELSE 'external' END AS kind FROM fx_tree),
 up AS (SELECT tree_id, node_id, parent_id AS owner FROM nodes UNION ALL SELECT u.tree_id, u.node_id, n.parent_id FROM up u JOIN nodes n ON n.tree_id = u.tree_id AND n.node_id = u.owner WHERE n.kind <> 'function'),
 owned AS (SELECT n.tree_id, n.kind, n.name, n.function_id, n.op, n.uncertain, f.function_id AS caller FROM nodes n
  LEFT JOIN (SELECT u.tree_id, u.node_id, u.owner FROM up u JOIN nodes f ON f.tree_id = u.tree_id AND f.node_id = u.owner AND f.kind = 'function') o ON o.tree_id = n.tree_id AND o.node_id = n.node_id
  LEFT JOIN nodes f ON f.tree_id = n.tree_id AND f.node_id = o.owner)"""


def _nodes(t):  # noqa: ANN001, ANN202
    name = F.col("name")
    kind = F.when(F.col("parent_span_id").isNull() | (name == "svc.loop:step"), "function").when(name == "svc.error:run", "db").when(name == "svc.click:run", "branch").when(name == "svc.view:run", "class").otherwise("external")
    return t("fx_tree").select(F.col("request_id").alias("tree_id"), F.col("span_id").alias("node_id"), F.col("parent_span_id").alias("parent_id"), "name", name.alias("function_id"), F.lit("x").alias("op"), (F.col("status") == "ok").alias("uncertain"), kind.alias("kind"))


@query("H10_function_view", f"WITH RECURSIVE {_NODES} SELECT tree_id, caller, function_id, count(*) AS count FROM owned WHERE kind = 'function' GROUP BY 1, 2, 3")
def _(t):
    return graph.function_view(_nodes(t))[0]


@query("H10_libraries", f"""
 WITH RECURSIVE {_NODES}, l AS (SELECT tree_id, caller, kind, name, count(*) AS count FROM owned WHERE kind IN ('external', 'class') GROUP BY 1, 2, 3, 4)
 SELECT tree_id, caller, kind, name, count, place, greatest(n - 2, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY tree_id, caller ORDER BY CASE kind WHEN 'external' THEN 0 ELSE 1 END, name) AS place, count(*) OVER (PARTITION BY tree_id, caller) AS n FROM l) x WHERE place <= 2""")
def _(t):
    return graph.function_view(_nodes(t), 2)[1]


@query("H10_data", f"""WITH RECURSIVE {_NODES} SELECT tree_id, caller, name AS "table", op, count(*) AS count, bool_and(uncertain) AS uncertain FROM owned WHERE kind = 'db' GROUP BY 1, 2, 3, 4""")
def _(t):
    return graph.function_view(_nodes(t))[2]


_KIND_COUNTS = ", ".join(f"CAST(coalesce(sum(n) FILTER (kind = '{k}'), 0) AS BIGINT) AS \"{k}\"" for k in graph.TREE_KINDS)
_KNOWN = "sum(n) FILTER (kind IN ('function', 'external', 'class', 'unresolved'))"
_TREES = f"""
 w AS (SELECT root, root AS node, CAST(1 AS HUGEINT) AS n, 0 AS depth FROM fx_roots
  UNION ALL SELECT root, callee, sum(n), depth FROM (SELECT w.root, e.callee, w.n, w.depth + 1 AS depth FROM w JOIN fx_call_edges e ON e.caller = w.node WHERE e.caller <> e.callee AND w.depth < 80) x GROUP BY root, callee, depth),
 trees AS (SELECT root, {_KIND_COUNTS}, CAST(coalesce(sum(n) FILTER (cyclic), 0) AS BIGINT) AS cyclic, max(depth) AS max_depth,
  CASE WHEN {_KNOWN} > 0 THEN round(1 - CAST(coalesce(sum(n) FILTER (kind = 'unresolved'), 0) AS DOUBLE) / CAST({_KNOWN} AS DOUBLE), 3) ELSE 1.0 END AS coverage, CAST(sum(n) AS BIGINT) AS nodes
  FROM w JOIN fx_tree_nodes k ON k.node = w.node GROUP BY root)"""


def _trees(t, kinds=None):  # noqa: ANN001, ANN202
    links = t("fx_call_edges").filter("caller <> callee").select(F.col("caller").alias("parent"), F.col("callee").alias("child"))
    out = graph.tree_stats(t("fx_tree_nodes"), links, t("fx_roots"))
    return out.select("root", *[F.col(c).cast("long").alias(c) for c in (*graph.TREE_KINDS, "cyclic", "nodes")], "max_depth", "coverage")


@query("H11_tree_stats", f"WITH RECURSIVE {_TREES} SELECT * FROM trees")
def _(t):
    return _trees(t)


@query("H11_view_stats", f"""WITH RECURSIVE {_TREES} SELECT root, "function", max_depth, cyclic, "function" AS nodes, external, "class", unresolved, graph, coverage FROM trees""")
def _(t):
    trees = _trees(t)
    return graph.view_stats(trees, trees)


@query("H12_recursive_edges", """
 WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM fx_call_edges_cyclic),
 back AS (SELECT DISTINCT callee AS root, callee AS function FROM e WHERE callee IN (SELECT callee FROM fx_call_edges_cyclic WHERE edge = 'callback') OR true
  UNION SELECT b.root, e.callee FROM back b JOIN e ON e.caller = b.function)
 SELECT e.caller, e.callee FROM e JOIN back b ON b.root = e.callee AND b.function = e.caller""")
def _(t):
    return graph.recursive_edges(t("fx_call_edges_cyclic"))


@query("H14_search_tree", """
 WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY request_id, parent_span_id ORDER BY seq, span_id) AS ordinal FROM fx_tree),
 p AS (SELECT request_id, span_id, name, CAST(ordinal AS STRING) AS path FROM o WHERE parent_span_id IS NULL
  UNION ALL SELECT o.request_id, o.span_id, o.name, concat(p.path, '.', CAST(o.ordinal AS STRING)) FROM p JOIN o ON o.request_id = p.request_id AND o.parent_span_id = p.span_id),
 h AS (SELECT * FROM p WHERE contains(path, '.') AND (contains(lower(name), 'error') OR contains(concat('call_', span_id), 'error') OR contains(concat('ext.', span_id, '.error'), 'p_2.error')))
 SELECT DISTINCT p.request_id AS tree_id, p.path, p.path IN (SELECT path FROM h h2 WHERE h2.request_id = p.request_id) AS is_hit
 FROM p JOIN h ON h.request_id = p.request_id AND (h.path = p.path OR starts_with(h.path, concat(p.path, '.')))""")
def _(t):
    from ..operators import spans

    tree = t("fx_tree")
    key = F.array_join(F.transform(F.split("sort_key", r"\."), lambda x: x.cast("int").cast("string")), ".")
    paths = spans.span_path(tree).select("request_id", "span_id", key.alias("path"))
    texts = [F.concat(F.lit("call_"), "span_id").alias("call_expr"), F.when(F.col("span_id").endswith("p_2"), F.concat(F.lit("ext."), "span_id", F.lit(".Error"))).alias("external")]
    nodes = paths.join(tree.select("request_id", "span_id", "name", *texts), ["request_id", "span_id"]).withColumnRenamed("request_id", "tree_id")
    return graph.search_tree(nodes, " ERROR ")


# -- data access ---------------------------------------------------------------------------------------------------

_QUERY_TEXT = """
 qt AS (SELECT event_id, event_id % 5 AS k, concat('User', CAST(user_id % 3 AS STRING)) AS u, concat('Item', CAST(user_id % 5 AS STRING)) AS i, upper(event_type) AS t, CASE event_id % 5
  WHEN 0 THEN concat('MATCH (a:User', CAST(user_id % 3 AS STRING), ' {id: $id, age: 3})-[r:', upper(event_type), ']->(b:Item', CAST(user_id % 5 AS STRING), ':Thing) WHERE r.at > 2 AND a.age < 9 RETURN b.seen, a.name')
  WHEN 1 THEN concat('MERGE (a:user:User', CAST(user_id % 3 AS STRING), ')<-[:', upper(event_type), '|:`saw it`|knows|SAW_IT {w: 1}]-(b:item) SET a.x = 1')
  WHEN 2 THEN concat('MATCH (x:User', CAST(user_id % 3 AS STRING), ') MATCH (y:Item', CAST(user_id % 5 AS STRING), ') CREATE (x)<-[:', upper(event_type), ' {w: 1}]-(y) RETURN x')
  WHEN 3 THEN 'MATCH (n:$label)-[:$type]-(m:`Odd (Name)`) WHERE size([1, 2]) > 1 AND m.`no` = 1 RETURN n.x'
  ELSE concat('match (a:User', CAST(user_id % 3 AS STRING), ')-[:', upper(event_type), ']->(:Mid)-[:HAS_ONE]->(c:Item', CAST(user_id % 5 AS STRING), ') return c') END AS query FROM events)"""


@query("I1_graph_query_facts", f"""
 WITH {_QUERY_TEXT}
 SELECT event_id, CASE WHEN k IN (1, 2) THEN 'write' ELSE 'read' END AS op, CASE k WHEN 0 THEN [u, i, 'Thing'] WHEN 1 THEN [u] WHEN 2 THEN [u, i] WHEN 3 THEN ['Odd (Name)'] ELSE [u, 'Mid', i] END AS labels,
  CASE k WHEN 1 THEN [t, 'SAW_IT'] WHEN 3 THEN CAST([] AS STRING[]) WHEN 4 THEN [t, 'HAS_ONE'] ELSE [t] END AS types, k = 3 AS dynamic_label, k = 3 AS dynamic_type,
  CASE k WHEN 0 THEN [concat(i, '.seen'), 'Thing.seen', concat(u, '.age'), concat(u, '.id'), concat(u, '.name')] WHEN 1 THEN [concat(u, '.x')] ELSE CAST([] AS STRING[]) END AS label_props,
  CASE k WHEN 0 THEN [concat(t, '.at')] WHEN 1 THEN list_sort([concat(t, '.w'), 'SAW_IT.w']) WHEN 2 THEN [concat(t, '.w')] ELSE CAST([] AS STRING[]) END AS type_props FROM qt""")
def _(t):
    found = dataaccess.graph_query_facts(t.sql(f"WITH {_QUERY_TEXT} SELECT event_id, query FROM qt"))
    dotted = lambda c: F.transform(c, lambda x: F.concat(x["name"], F.lit("."), x["property"])).alias(c)
    return found.select("event_id", "op", "labels", "types", "dynamic_label", "dynamic_type", dotted("label_props"), dotted("type_props"))


@query("I1_graph_query_edges", f"""
 WITH {_QUERY_TEXT}
 SELECT event_id, u AS source, t AS type, unnest([i, 'Thing']) AS target FROM qt WHERE k = 0 UNION ALL SELECT event_id, i, t, u FROM qt WHERE k = 2
 UNION ALL SELECT event_id, u, t, 'Mid' FROM qt WHERE k = 4 UNION ALL SELECT event_id, 'Mid', 'HAS_ONE', i FROM qt WHERE k = 4""")
def _(t):
    return dataaccess.graph_query_edges(t.sql(f"WITH {_QUERY_TEXT} SELECT event_id, query FROM qt")).select("event_id", "source", "type", "target")


_DDL = """
 ddl AS (SELECT p_partkey, concat('CREATE ', CASE WHEN p_size % 3 = 0 THEN 'CONSTRAINT c' WHEN p_size % 3 = 1 THEN 'RANGE INDEX i' ELSE 'INDEX i' END, CAST(p_partkey AS STRING), ' IF NOT EXISTS FOR (n:', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)), ') ',
  CASE WHEN p_size % 3 = 0 THEN 'REQUIRE n.code IS UNIQUE' ELSE 'ON (n.size, n.brand)' END, '; MATCH (x) RETURN x') AS stmt, p_type, p_size FROM part)"""


@query("I2_index_ddl", f"""
 WITH {_DDL}
 SELECT p_partkey, concat('neo4j:', upper(substr(p_type, 1, 1)), lower(substr(p_type, 2))) AS "table", CASE WHEN p_size % 3 = 0 THEN ['code'] ELSE ['size', 'brand'] END AS keys, p_size % 3 = 0 AS is_unique,
  CASE WHEN p_size % 3 = 0 THEN 'constraint' WHEN p_size % 3 = 1 THEN 'range' ELSE 'index' END AS kind, concat(CASE WHEN p_size % 3 = 0 THEN 'c' ELSE 'i' END, CAST(p_partkey AS STRING)) AS name FROM ddl""")
def _(t):
    return dataaccess.index_ddl(t.sql(f"WITH {_DDL} SELECT p_partkey, stmt FROM ddl")).select("p_partkey", "table", "keys", "is_unique", "kind", "name")


_FIELDS = """
 f AS (SELECT table_id, k AS field, CASE WHEN method IN ('insert_one', 'update_one') THEN 'write' ELSE 'query' END AS source,
  CASE WHEN method IN ('insert_one', 'update_one') THEN CASE json_type(doc, concat('$.', k)) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'object' END ELSE 'any' END AS type
  FROM (SELECT *, unnest(json_keys(doc)) AS k FROM fx_op_log) x)"""


@query("I3_infer_fields", f"WITH {_FIELDS} SELECT table_id, field, coalesce(min(CASE WHEN type <> 'any' THEN type END), 'any') AS type, CASE WHEN bool_or(source = 'write') THEN 'write' ELSE 'query' END AS source FROM f GROUP BY 1, 2")
def _(t):
    return dataaccess.infer_fields(t("fx_op_log"))


_WALK = """
 steps AS (SELECT root, root AS function, CAST([] AS INT[]) AS path, [root] AS chain FROM fx_roots
  UNION ALL SELECT w.root, e.callee, list_append(w.path, e.ordinal), list_append(w.chain, e.callee) FROM steps w JOIN fx_call_sites e ON e.caller = w.function),
 paths AS (SELECT root, function, min(path) AS path, arg_min(chain, path) AS chain FROM steps GROUP BY 1, 2)"""
_USAGE = f"""
 {_WALK}, fn AS (SELECT root, table_id, function, op, CAST(sum(n) AS BIGINT) AS count, bool_and(uncertain) AS uncertain, any_value(path) AS path, any_value(chain) AS chain FROM paths p JOIN fx_db_access a ON a.function_id = p.function GROUP BY 1, 2, 3, 4)"""


def _paths(t):  # noqa: ANN001, ANN202
    paths = closure.least_paths(t("fx_call_sites"), t("fx_roots"))
    out = closure.placed(paths)
    free(paths)
    return out


def _ops():  # noqa: ANN202
    return F.array_sort(F.transform(F.map_entries("ops"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("ops")


@query("I4_functions", f"WITH RECURSIVE {_USAGE} SELECT * FROM fn")
def _(t):
    return dataaccess.table_functions(closure.least_paths(t("fx_call_sites"), t("fx_roots")), t("fx_db_access"))


@query("I4_table_usage", f"""
 WITH RECURSIVE {_USAGE}, o AS (SELECT root, table_id, op, sum(count) AS n FROM fn GROUP BY 1, 2, 3), ops AS (SELECT root, table_id, list(concat(op, '=', CAST(n AS STRING)) ORDER BY op) AS ops FROM o GROUP BY 1, 2),
 f AS (SELECT root, table_id, count(*) AS functions, bool_and(uncertain) AS uncertain, min(path) AS path, arg_min(chain, path) AS chain FROM fn GROUP BY 1, 2)
 SELECT f.*, ops, row_number() OVER (PARTITION BY root ORDER BY functions DESC, table_id) AS place FROM f JOIN ops USING (root, table_id)""")
def _(t):
    return dataaccess.table_usage(_paths(t), t("fx_db_access")).withColumn("ops", _ops())


@query("I4_fields", f"""
 WITH RECURSIVE {_WALK} SELECT root, table_id, field, type, source FROM (
  SELECT root, table_id, field, type, source, row_number() OVER (PARTITION BY root, table_id, field ORDER BY path, ord, type, source) AS k FROM paths p JOIN fx_db_field f ON f.function_id = p.function) x WHERE k = 1""")
def _(t):
    return dataaccess.usage_fields(_paths(t), t("fx_db_field")).select("root", "table_id", "field", "type", "source")


@query("I4_edges", f"WITH RECURSIVE {_WALK} SELECT root, table_id, source, target, bool_and(uncertain) AS uncertain FROM paths p JOIN fx_db_edge e ON e.function_id = p.function GROUP BY 1, 2, 3, 4")
def _(t):
    return dataaccess.usage_edges(closure.least_paths(t("fx_call_sites"), t("fx_roots")), t("fx_db_edge"))


@query("I5_access_audit", "SELECT count(DISTINCT a.function_id) AS functions, count(DISTINCT CASE WHEN f.loc > 10 THEN a.function_id END) AS matched FROM fx_db_access a LEFT JOIN fx_functions f ON f.function_id = a.function_id")
def _(t):
    return dataaccess.access_audit(t("fx_db_access"), t("fx_functions").filter("loc > 10"))


@query("I5_access_unmatched", "SELECT DISTINCT function_id, 'not in the catalogue' AS reason FROM fx_db_access WHERE function_id NOT IN (SELECT function_id FROM fx_functions WHERE loc > 10)")
def _(t):
    return dataaccess.access_unmatched(t("fx_db_access"), t("fx_functions").filter("loc > 10"))


_INDEX_FIELDS = f"""
 {_USAGE}, uf AS (SELECT root, table_id, field, type, source FROM (
  SELECT root, table_id, field, type, source, row_number() OVER (PARTITION BY root, table_id, field ORDER BY path, ord, type, source) AS k FROM paths p JOIN fx_db_field f ON f.function_id = p.function) x WHERE k = 1),
 every AS (SELECT *, 0 AS late, CASE source WHEN 'model' THEN 0 WHEN 'write' THEN 1 WHEN 'query' THEN 3 END AS r FROM uf UNION ALL SELECT NULL, table_id, field, type, source, 1, 0 FROM fx_db_model),
 xf AS (SELECT table_id, field, coalesce(arg_min(type, (late, coalesce(root, 0))) FILTER (type <> 'any'), 'any') AS type, arg_min(source, r) AS source FROM every GROUP BY 1, 2)"""


def _index_fields(t, paths):  # noqa: ANN001, ANN202
    return dataaccess.index_fields(dataaccess.usage_fields(paths, t("fx_db_field")), t("fx_db_model"))


@query("I6_database_index", f"""
 WITH RECURSIVE {_INDEX_FIELDS}, o AS (SELECT table_id, op, sum(count) AS n FROM fn GROUP BY 1, 2), ops AS (SELECT table_id, list(concat(op, '=', CAST(n AS STRING)) ORDER BY op) AS ops FROM o GROUP BY 1),
 f AS (SELECT table_id, count(DISTINCT (function, op)) AS functions, bool_and(uncertain) AS uncertain, count(DISTINCT root) AS endpoints FROM fn GROUP BY 1),
 ids AS (SELECT table_id FROM f UNION SELECT table_id FROM fx_db_model UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0), nf AS (SELECT table_id, count(*) AS fields FROM xf GROUP BY 1)
 SELECT i.table_id, ops, coalesce(functions, 0) AS functions, coalesce(uncertain, false) AS uncertain, coalesce(endpoints, 0) AS endpoints, coalesce(fields, 0) AS fields, i.table_id % 2 = 0 AS has_model, CAST(CASE WHEN i.table_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS indexes
 FROM ids i LEFT JOIN f USING (table_id) LEFT JOIN ops USING (table_id) LEFT JOIN nf USING (table_id)""")
def _(t):
    reached = closure.spread(t("fx_call_sites"), closure.numbered_roots(t("fx_roots")))
    indexes = t("supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("table_id"))
    names = dataaccess.index_field_names(reached, t("fx_db_field"), t("fx_db_model"))
    out = dataaccess.database_index(reached, t("fx_db_access"), names, t("fx_db_model"), indexes)
    return out.withColumn("ops", _ops())


@query("I6_functions", f"WITH RECURSIVE {_USAGE} SELECT table_id, function, op, CAST(sum(count) AS BIGINT) AS count, bool_and(uncertain) AS uncertain FROM fn GROUP BY 1, 2, 3")
def _(t):
    return dataaccess.index_functions(closure.least_paths(t("fx_call_sites"), t("fx_roots")), t("fx_db_access"))


@query("I6_endpoints", f"WITH RECURSIVE {_USAGE} SELECT table_id, root, list_sort(list(DISTINCT op)) AS ops, arg_min(chain, (len(chain), op, function)) AS call_chain FROM fn GROUP BY 1, 2")
def _(t):
    return dataaccess.index_endpoints(closure.least_paths(t("fx_call_sites"), t("fx_roots")), t("fx_db_access"))


@query("I6_fields", f"WITH RECURSIVE {_INDEX_FIELDS} SELECT * FROM xf")
def _(t):
    return _index_fields(t, _paths(t))


@query("I7_merge_fields", """
 WITH f AS (SELECT p_brand AS table_id, p_type AS field, CASE p_size % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'write' WHEN 2 THEN 'cypher' ELSE 'query' END AS source, p_size % 4 AS r, CASE WHEN p_size % 2 = 0 THEN 'any' ELSE concat('t', CAST(p_size % 3 AS STRING)) END AS type FROM part)
 SELECT table_id, field, arg_min(source, r) AS source, coalesce(arg_min(type, (r, type)) FILTER (type <> 'any'), 'any') AS type FROM f GROUP BY 1, 2""")
def _(t):
    m = F.col("p_size") % 4
    source = F.when(m == 0, "model").when(m == 1, "write").when(m == 2, "cypher").otherwise("query")
    kind = F.when(F.col("p_size") % 2 == 0, "any").otherwise(F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")))
    return dataaccess.merge_fields(t("part").select(F.col("p_brand").alias("table_id"), F.col("p_type").alias("field"), source.alias("source"), kind.alias("type")))


@query("I8_tables_below", """
 WITH RECURSIVE own AS (SELECT DISTINCT function_id, table_id FROM fx_db_access),
 up AS (SELECT e.caller AS function, o.table_id FROM own o JOIN fx_call_edges e ON e.callee = o.function_id UNION SELECT e.caller, u.table_id FROM up u JOIN fx_call_edges e ON e.callee = u.function)
 SELECT function, list(table_id ORDER BY table_id) AS tables, count(*) AS n FROM up u WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.function_id = u.function AND x.table_id = u.table_id) GROUP BY 1""")
def _(t):
    return dataaccess.tables_below(t("fx_call_edges"), t("fx_db_access"))


_NAMES = """
 tb AS (SELECT CAST(p_partkey AS BIGINT) AS table_id, concat(CASE p_size % 4 WHEN 0 THEN 'quotation_' WHEN 1 THEN 'execution_' ELSE '' END, replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN 's_' ELSE '_' END), CAST(p_partkey % 400 AS STRING), 's') AS name FROM part)"""
_ALIAS = """
 b AS (SELECT *, regexp_replace(name, '^(quotation_|execution_|core_)', '') AS base FROM tb),
 w AS (SELECT *, string_split(base, '_') AS p FROM b),
 a3 AS (SELECT table_id, name, unnest([base, p[-1], p[1]]) AS word, unnest([0, 1, 2]) AS rank FROM w),
 al AS (SELECT table_id, name, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN concat(substr(word, 1, length(word) - 3), 'y') WHEN word LIKE '%sses' THEN substr(word, 1, length(word) - 2)
  WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN substr(word, 1, length(word) - 1) ELSE word END AS alias, min(rank) AS rank FROM a3 GROUP BY 1, 2, 3)"""


@query("I9_entity_aliases", f"WITH {_NAMES}, {_ALIAS} SELECT table_id, name, alias, rank FROM al")
def _(t):
    return dataaccess.entity_aliases(t.sql(f"WITH {_NAMES} SELECT * FROM tb"))


_FK = " fk AS (SELECT CAST(p_partkey AS BIGINT) AS table_id, concat(CASE WHEN p_size % 2 = 0 THEN 'main_' ELSE '' END, replace(p_name, ' ', '_'), CAST((p_partkey * 7) % 400 AS STRING), CASE WHEN p_size % 5 = 0 THEN '_ids' ELSE '_id' END) AS field FROM part)"


@query("I10_infer_references", f"""
 WITH {_NAMES}, {_FK}, {_ALIAS}, dm AS (SELECT table_id, coalesce(nullif(regexp_extract(name, '^(quotation|execution)_', 1), ''), 'other') AS d FROM tb),
 st AS (SELECT table_id AS source, field, string_split(regexp_extract(field, '^(.+?)_ids?$', 1), '_') AS p FROM fk),
 sx AS (SELECT source, field, unnest(range(0, len(p))) AS pos, p FROM st),
 hits AS (SELECT s.source, s.field, s.pos, a.rank, a.table_id AS target, x.d = y.d AS same FROM sx s JOIN al a ON a.alias = array_to_string(list_slice(s.p, s.pos + 1, len(s.p)), '_') JOIN dm x ON x.table_id = s.source JOIN dm y ON y.table_id = a.table_id WHERE a.table_id <> s.source),
 top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY source, field ORDER BY pos, rank) AS k FROM hits) z WHERE k = 1),
 r AS (SELECT source, field, CASE WHEN count(*) = 1 THEN min(target) WHEN count(*) FILTER (same) = 1 THEN min(target) FILTER (same) END AS target FROM top GROUP BY 1, 2),
 g AS (SELECT source, target, list(DISTINCT field) AS fields FROM r WHERE target IS NOT NULL GROUP BY 1, 2)
 SELECT source, target, list_sort(fields) AS fields, concat(array_to_string(list_slice(list_sort(fields), 1, 2), ', '), CASE WHEN len(fields) > 2 THEN ' …' ELSE '' END) AS label FROM g""")
def _(t):
    return dataaccess.infer_references(t.sql(f"WITH {_NAMES} SELECT * FROM tb"), t.sql(f"WITH {_FK} SELECT * FROM fk"))


_EDGES = " ge AS (SELECT p_type AS source, p_brand AS type, p_name AS target, p_partkey AS function_id FROM part)"


@query("I11_exact_edges", f"""
 WITH {_EDGES}, ev AS (SELECT type, list(function_id ORDER BY function_id)[1:6] AS evidence FROM (SELECT DISTINCT type, function_id FROM ge) x GROUP BY 1)
 SELECT DISTINCT g.source, g.type, g.target, evidence FROM ge g JOIN ev USING (type)""")
def _(t):
    e = t.sql(f"WITH {_EDGES} SELECT * FROM ge")
    return dataaccess.exact_edges(e, e).select("source", "type", "target", "evidence")


@query("I11_membership_edges", f"WITH {_EDGES} SELECT source, type AS target FROM ge UNION SELECT type, target FROM ge")
def _(t):
    return dataaccess.membership_edges(t.sql(f"WITH {_EDGES} SELECT * FROM ge"))


_SCHEMAS = """
 doc AS (SELECT DISTINCT concat(CASE WHEN p_brand < 'Brand#3' THEN 'mongo:' ELSE 'neo4j:' END, p_brand) AS table_id, p_type AS field FROM part WHERE p_size < 20 AND p_brand <> 'Brand#17' AND p_brand <> 'Brand#37'),
 inf AS (SELECT DISTINCT concat(CASE WHEN p_brand < 'Brand#3' THEN 'mongo:' ELSE 'neo4j:' END, p_brand) AS table_id, p_type AS field, CASE WHEN p_brand < 'Brand#2' THEN 'model' ELSE 'query' END AS source FROM part WHERE p_size > 47),
 rel AS (SELECT concat(CASE WHEN p_brand < 'Brand#3' THEN 'mongo:' ELSE 'neo4j:' END, p_brand) AS source, concat('neo4j:Brand#', CAST(p_size AS STRING)) AS target, CASE WHEN p_size % 2 = 0 THEN 'exact' ELSE 'inferred' END AS confidence FROM part),
 acc AS (SELECT concat(CASE WHEN p_brand < 'Brand#3' THEN 'mongo:' ELSE 'neo4j:' END, p_brand) AS table_id, p_partkey AS function_id, CASE p_size % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'upsert' ELSE 'delete' END AS op, concat('m', CAST(p_size % 6 AS STRING)) AS method, p_size % 9 AS root, p_type AS name FROM part WHERE p_size % 5 <> 0)"""


def _schema(t, name: str):  # noqa: ANN001, ANN202
    return t.sql(f"WITH {_SCHEMAS} SELECT * FROM {name}")


@query("I12_merge_schema", f"""
 WITH {_SCHEMAS}, x AS (SELECT table_id, field FROM inf UNION SELECT table_id, '_id' FROM inf WHERE starts_with(table_id, 'mongo:') AND table_id NOT IN (SELECT table_id FROM doc))
 SELECT table_id, field, 'documented' AS origin FROM doc UNION ALL
 SELECT i.table_id, i.field, CASE WHEN i.table_id IN (SELECT table_id FROM doc) THEN 'inferred' ELSE 'code only' END FROM x i WHERE NOT EXISTS (SELECT 1 FROM doc d WHERE d.table_id = i.table_id AND d.field = i.field)""")
def _(t):
    return dataaccess.merge_schema(_schema(t, "doc"), _schema(t, "inf"))


@query("I12_links", f"""
 WITH {_SCHEMAS}, ids AS (SELECT table_id FROM doc UNION SELECT table_id FROM inf)
 SELECT i.table_id, count(DISTINCT function_id) AS functions, count(DISTINCT root) AS endpoints, count(DISTINCT CASE WHEN root = 3 THEN name END) AS indexes FROM ids i LEFT JOIN acc a ON a.table_id = i.table_id GROUP BY 1""")
def _(t):
    access = _schema(t, "acc")
    return dataaccess.merge_links(_schema(t, "doc"), _schema(t, "inf"), access, access, access.filter("root = 3"))


@query("I12_relationships", f"WITH {_SCHEMAS} SELECT source, target, confidence, count(*) AS n FROM rel WHERE source IN (SELECT table_id FROM doc) AND target IN (SELECT table_id FROM doc) GROUP BY 1, 2, 3")
def _(t):
    return dataaccess.merge_relationships(_schema(t, "rel"), _schema(t, "doc")).groupBy("source", "target", "confidence").agg(F.count("*").alias("n"))


@query("I13_schema_audit", f"""
 WITH {_SCHEMAS}
 SELECT DISTINCT 'unused' AS problem, table_id, CAST(NULL AS STRING) AS field, true AS exact FROM doc WHERE table_id NOT IN (SELECT table_id FROM inf)
 UNION ALL SELECT DISTINCT 'undocumented', table_id, NULL, true FROM inf WHERE table_id NOT IN (SELECT table_id FROM doc)
 UNION ALL SELECT 'stale', table_id, field, table_id IN (SELECT table_id FROM inf WHERE source = 'model') FROM doc d WHERE table_id IN (SELECT table_id FROM inf) AND NOT EXISTS (SELECT 1 FROM inf i WHERE i.table_id = d.table_id AND i.field = d.field)""")
def _(t):
    return dataaccess.schema_audit(_schema(t, "doc"), _schema(t, "inf"))


@query("I13_audit_counts", f"""
 WITH {_SCHEMAS} SELECT 'documented tables' AS measure, count(DISTINCT table_id) AS n FROM doc UNION ALL SELECT 'code tables', count(DISTINCT table_id) FROM inf UNION ALL SELECT 'tables with inferred fields', count(DISTINCT table_id) FROM inf WHERE source <> 'model'
 UNION ALL SELECT concat(confidence, ' relations'), count(*) FROM rel GROUP BY confidence""")
def _(t):
    return dataaccess.audit_counts(_schema(t, "doc"), _schema(t, "inf"), _schema(t, "rel"))


_TEXT_REFS = """ sd AS (SELECT p_partkey, concat('{fnId: "', CAST(p_partkey * 2 AS STRING), '", method: "GET", path: "/p/', CAST(p_partkey AS STRING), '", keys: ["x"], fromTableId: "mongo:', p_type, '", toTableId: "mongo:a"}', CASE WHEN p_size = 3 THEN ' keys:[1]' ELSE '' END) AS text FROM part)"""


@query("I14_audit_text_references", """
 SELECT 'function' AS kind, CAST(p_partkey * 2 AS STRING) AS ref, 1 AS n FROM part WHERE p_partkey * 2 NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'endpoint', concat('GET /p/', CAST(p_partkey AS STRING)), 1 FROM part WHERE concat('GET /p/', CAST(p_partkey AS STRING)) NOT IN (SELECT endpoint_id FROM fx_roots)
 UNION ALL SELECT 'relationship', concat('mongo:', p_type, '>mongo:a'), count(*) FROM part GROUP BY p_type UNION ALL SELECT 'index', 'keys', count(*) + count(*) FILTER (p_size = 3) FROM part""")
def _(t):
    return dataaccess.audit_text_references(t.sql(f"WITH {_TEXT_REFS} SELECT * FROM sd"), t("fx_functions"), t("fx_roots"))


@query("I15_table_matrix", f"""
 WITH {_SCHEMAS}, l AS (SELECT DISTINCT * FROM rel WHERE confidence = 'exact' AND target IN ('neo4j:Brand#30', 'neo4j:Brand#12')), x AS (SELECT source AS table_id FROM l WHERE starts_with(source, 'mongo') UNION SELECT target FROM l WHERE starts_with(source, 'mongo')),
 fd AS (SELECT table_id, count(DISTINCT field) AS fields, min(field) FILTER (field < 'M') AS primary_key FROM doc GROUP BY 1)
 SELECT a.table_id, count(DISTINCT function_id) AS functions, count(DISTINCT CASE WHEN op = 'read' THEN function_id END) AS reads, count(DISTINCT CASE WHEN op = 'write' THEN function_id END) AS writes,
  count(DISTINCT CASE WHEN op = 'upsert' THEN function_id END) AS upserts, count(DISTINCT CASE WHEN op = 'delete' THEN function_id END) AS deletes, list_sort(list(DISTINCT method)) AS methods, coalesce(any_value(fields), 0) AS fields,
  any_value(primary_key) AS primary_key, count(DISTINCT root) AS endpoints, count(*) FILTER (root = 3) AS indexes, a.table_id IN (SELECT table_id FROM x) AS cross_db FROM acc a LEFT JOIN fd ON fd.table_id = a.table_id GROUP BY 1""")
def _(t):
    access = _schema(t, "acc")
    links = _schema(t, "rel").filter("confidence = 'exact' AND target IN ('neo4j:Brand#30', 'neo4j:Brand#12')")
    return dataaccess.table_matrix(access, _schema(t, "doc").withColumn("is_primary", F.col("field") < "M"), access, access.filter("root = 3"), links)


# -- lineage -------------------------------------------------------------------------------------------------------


def _key(c: str) -> str:
    return f"array_to_string(list_transform(string_split(regexp_replace(split_part({c}, '?', 1), '/+', '/', 'g'), '/'), lambda s: CASE WHEN starts_with(s, ':') OR starts_with(s, '{{') THEN '{{}}' ELSE s END), '/')"


@query("J1_match_paths_strict", f"SELECT e.path, s.service_func, s.raw_path FROM fx_l_endpoint e JOIN fx_l_service s ON {_key('e.path')} = {_key('s.raw_path')}")
def _(t):
    return lineage.match_paths_strict(t("fx_l_endpoint"), t("fx_l_service"), "path", "raw_path").select("path", "service_func", "raw_path")


@query("J2_match_paths_wild", """
 WITH a AS (SELECT page_id, url, list_filter(string_split(lower(split_part(concat('/', regexp_replace(url, '^https?://[^/]*/', '')), '?', 1)), '/'), lambda s: s <> '') AS x FROM pages),
 b AS (SELECT * FROM (VALUES ('/api/{lang}/:id'), ('/en/{id}'), ('/fr/:page'), ('/{x}/100'), ('/de/{y}/z')) AS v(pattern)),
 c AS (SELECT pattern, list_filter(string_split(lower(CASE WHEN starts_with(pattern, '/api/') THEN substr(pattern, 5) ELSE pattern END), '/'), lambda s: s <> '') AS y FROM b)
 SELECT page_id, pattern FROM a JOIN c ON len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: x[i] = y[i] OR starts_with(y[i], ':') OR starts_with(y[i], '{'))) = len(x)""")
def _(t):
    pages = t("pages").select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^https?://[^/]*/", "")).alias("path"))
    patterns = t.spark.createDataFrame([("/api/{lang}/:id",), ("/en/{id}",), ("/fr/:page",), ("/{x}/100",), ("/de/{y}/z",)], "pattern string")
    return lineage.match_paths_wild(pages, patterns, "path", "pattern").select("page_id", "pattern")


@query("J3_normalise", """
 SELECT page_id, concat('/', ltrim(regexp_replace(regexp_replace(split_part(url, '?', 1), '^https?:', ''), '^/*[^/]*', ''), '/')) AS service,
  concat('/api/', ltrim(regexp_replace(regexp_replace(split_part(url, '?', 1), '^https?:', ''), '^/*[^/]*', ''), '/')) AS client FROM pages""")
def _(t):
    raw = F.concat(F.lit("${BASE}"), F.regexp_replace("url", "^https?://[^/]*", ""))
    return t("pages").select("page_id", lineage.normalise_service_path(raw).alias("service"), lineage.normalise_client_url(raw).alias("client"))


_CHAINS = f"""
 clients AS (SELECT DISTINCT r.full_path, r.sub_path, a.app, a.api_func FROM fx_l_route r JOIN fx_l_api a ON {_key('r.full_path')} = {_key('a.url')} OR {_key('r.sub_path')} = {_key('a.raw_url')}),
 bridges AS (SELECT e.id, e.path, e.method, e.handler, s.service_func, c.controller_func FROM fx_l_endpoint e JOIN fx_l_service s ON {_key('e.path')} = {_key('s.raw_path')} LEFT JOIN fx_l_controller c ON c.service_func = s.service_func),
 way AS (SELECT b.*, r.full_path, r.sub_path FROM bridges b JOIN fx_l_route r ON r.controller_func = b.controller_func),
 met AS (SELECT w.*, c.app, c.api_func FROM way w JOIN clients c ON c.full_path = w.full_path AND c.sub_path = w.sub_path),
 seen AS (SELECT m.*, u.component FROM met m JOIN fx_l_ui u ON u.app = m.app AND u.api_func = m.api_func),
 n AS (SELECT e.id, e.path, e.method, (SELECT count(*) FROM bridges b WHERE b.id = e.id) AS services, (SELECT count(*) FROM way b WHERE b.id = e.id) AS routes, (SELECT count(*) FROM met b WHERE b.id = e.id) AS clients,
  (SELECT count(*) FROM seen b WHERE b.id = e.id) AS usages, coalesce((SELECT list_sort(list(DISTINCT app)) FROM met b WHERE b.id = e.id), CAST([] AS STRING[])) AS apps FROM fx_l_endpoint e),
 st AS (SELECT *, CASE WHEN usages > 0 THEN 'full_chain' WHEN clients > 0 THEN 'client_api' WHEN routes > 0 THEN 'backend_exposed' WHEN services > 0 THEN 'service_only' ELSE 'unexposed' END AS status FROM n)"""
_LAYERS = ("fx_l_endpoint", "fx_l_service", "fx_l_controller", "fx_l_route", "fx_l_api", "fx_l_ui")


def _layers(t):  # noqa: ANN001, ANN202
    return [t(x) for x in _LAYERS]


@query("J4_lineage_chains", f"""
 WITH {_CHAINS}
 SELECT e.id, e.path, e.method, e.handler, b.service_func, b.controller_func, r.full_path, c.app, c.api_func, u.component, u.caller FROM fx_l_endpoint e LEFT JOIN bridges b ON b.id = e.id LEFT JOIN fx_l_route r ON r.controller_func = b.controller_func
 LEFT JOIN clients c ON c.full_path = r.full_path AND c.sub_path = r.sub_path LEFT JOIN fx_l_ui u ON u.app = c.app AND u.api_func = c.api_func""")
def _(t):
    return lineage.lineage_chains(*_layers(t))


@query("J5_chain_status", f"WITH {_CHAINS} SELECT * FROM st")
def _(t):
    return lineage.chain_status(*_layers(t))


@query("J6_lineage_summary", f"""
 WITH {_CHAINS} SELECT status AS measure, count(*) AS n FROM st GROUP BY 1 UNION ALL SELECT concat('from ', app), count(DISTINCT id) FROM met GROUP BY 1""")
def _(t):
    return lineage.lineage_summary(lineage.chain_status(*_layers(t)))


@query("J7_filter_chains", f"WITH {_CHAINS} SELECT id, status FROM st WHERE status = 'full_chain' AND path LIKE '/small/%' AND id IN (SELECT s.id FROM seen s JOIN fx_l_ui u ON u.app = s.app AND u.api_func = s.api_func WHERE contains(u.caller, 'admin'))")
def _(t):
    layers = _layers(t)
    return lineage.filter_chains(lineage.lineage_chains(*layers), lineage.chain_status(*layers), " useADMIN ", status="full_chain", domain="small").select("id", "status")


@query("J9_dedup_ui_usage", "SELECT DISTINCT event_type AS app, user_id % 9 AS component, user_id % 4 AS api_func, CAST(floor(value) AS BIGINT) % 50 AS line FROM events")
def _(t):
    ui = t("events").select(F.col("event_type").alias("app"), (F.col("user_id") % 9).alias("component"), (F.col("user_id") % 4).alias("api_func"), (F.floor("value") % 50).alias("line"), F.col("event_id").alias("file"))
    return lineage.dedup_ui_usage(ui).drop("file")
