"""Registered queries of sources, catalogue, selection and streaming operators, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import PART_ROWS, durable, shared_dir
from ..operators import catalog, selection
from ..sources import batches
from ..streaming import streams
from .event_queries import _REQUESTS, _SPANS
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


# -- sources -------------------------------------------------------------------------------------------------------


def _batch_files(t) -> str:  # noqa: ANN001
    """The event log as JSON batches of up to 100 events, with every tenth batch a handshake, written and read as files."""
    ev = t("fx_events").withColumn("_b", F.floor(F.col("seq") / 100))
    e = F.struct("kind", "request_id", "span_id", "parent_span_id", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.struct("method", "path", "name", "duration_ms", "status").alias("data"))
    sent = ev.groupBy("_b").agg(F.collect_list(e).alias("events")).select(F.to_json(F.struct(F.lit("events").alias("kind"), (F.col("_b") % 3).alias("dropped"), "events")).alias("value"))
    hello = ev.select("_b").distinct().filter("_b % 10 = 0").select(F.to_json(F.struct(F.lit("register").alias("kind"), F.concat(F.lit("http://t"), F.col("_b").cast("string")).alias("brain_base_url"))).alias("value"))
    path = f"{shared_dir(t.spark)}/batches/{uuid.uuid4().hex}"
    sent.union(hello).write.text(path)
    return path


def _batches(t):  # noqa: ANN001, ANN202
    return batches.read_batches(t.spark, _batch_files(t))


@query("A1_read_event_batches", "SELECT kind, request_id, span_id, seq, name, duration_ms, status FROM fx_events")
def _(t):
    return batches.events_of(_batches(t)).select("kind", "request_id", "span_id", "seq", "name", "duration_ms", "status")


@query("A2_ingest_counters", """
 WITH b AS (SELECT CAST(floor(seq / 100) AS BIGINT) AS b, count(*) AS n FROM fx_events GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS events_in, CAST(sum(b % 3) AS BIGINT) AS dropped, count(*) FILTER (b % 10 = 0) AS registers FROM b""")
def _(t):
    return batches.ingest_counters(_batches(t))


def _chain_documents(t):  # noqa: ANN001, ANN202
    """One JSON document per part, as an analysis would write it."""
    s, n = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x]), F.col("p_size")
    route = F.struct(F.lit("GET").alias("method"), s("/api/", n).alias("fullPath"), s("/", n).alias("subPath"))
    backend = F.struct(
        F.struct(s("svc", n).alias("serviceFunc"), s("/raw/", F.col("p_partkey")).alias("rawPath")).alias("service"),
        F.when(n % 3 != 0, F.struct(s("ctl", n).alias("controllerFunc"))).alias("controller"), F.when(n % 3 != 0, F.array_repeat(route, n % 2 + 1)).otherwise(F.array().cast("array<struct<method:string,fullPath:string,subPath:string>>")).alias("routes"),
    )
    ui = F.struct(s("Comp", n).alias("component"), s("use", n).alias("callerFunc"))
    api = F.struct(s("get", n).alias("apiFunc"), s("/api/", n).alias("url"), F.when(n % 5 == 0, s("/", n)).alias("rawUrl"))
    client = F.struct(F.when(n % 2 == 0, "admin").otherwise("frontend").alias("app"), api.alias("api"), F.when(n % 7 == 0, F.array(ui, ui)).otherwise(F.array().cast("array<struct<component:string,callerFunc:string>>")).alias("ui"))
    chain = F.struct(s("GET /p/", F.col("p_partkey")).alias("id"), F.lit("GET").alias("method"), s("/p/", F.col("p_partkey")).alias("path"), F.lit("p").alias("domain"), F.lit("full_chain").alias("status"), F.struct(s("h", n).alias("handler_id")).alias("endpoint"), F.array(backend).alias("backend"), F.when(n % 4 != 0, F.array(client)).alias("clients"))
    doc = F.struct((F.col("p_partkey") % 3).alias("version"), F.when(F.col("p_partkey") % 2 == 0, "/srv/a").otherwise("/srv/b").alias("project_path"), F.array(chain).alias("chains"))
    return batches.read_lineage_chains(t("part").select(F.to_json(doc).alias("json")), 1, "/srv/a")


_OWN = "FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0"


@query("A5_chains", f"SELECT concat('GET /p/', CAST(p_partkey AS STRING)) AS id, 'GET' AS method, concat('/p/', CAST(p_partkey AS STRING)) AS path, 'p' AS domain, 'full_chain' AS status, concat('h', CAST(p_size AS STRING)) AS handler {_OWN}")
def _(t):
    return _chain_documents(t).drop("backend", "clients")


@query("A5_backend", f"""
 SELECT concat('GET /p/', CAST(p_partkey AS STRING)) AS id, concat('svc', CAST(p_size AS STRING)) AS service_func, concat('/raw/', CAST(p_partkey AS STRING)) AS raw_path, CASE WHEN p_size % 3 <> 0 THEN concat('ctl', CAST(p_size AS STRING)) END AS controller_func,
  CASE WHEN p_size % 3 <> 0 THEN 'GET' END AS route_method, CASE WHEN p_size % 3 <> 0 THEN concat('/api/', CAST(p_size AS STRING)) END AS full_path, CASE WHEN p_size % 3 <> 0 THEN concat('/', CAST(p_size AS STRING)) END AS sub_path
 FROM (SELECT *, unnest(range(0, CASE WHEN p_size % 3 <> 0 THEN p_size % 2 + 1 ELSE 1 END)) AS k {_OWN}) x""")
def _(t):
    return batches.backend_of(_chain_documents(t))


@query("A5_clients", f"""
 SELECT concat('GET /p/', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_size % 2 = 0 THEN 'admin' ELSE 'frontend' END AS app, concat('get', CAST(p_size AS STRING)) AS api_func, concat('/api/', CAST(p_size AS STRING)) AS url,
  CASE WHEN p_size % 5 = 0 THEN concat('/', CAST(p_size AS STRING)) END AS raw_url, CASE WHEN p_size % 7 = 0 THEN concat('Comp', CAST(p_size AS STRING)) END AS component, CASE WHEN p_size % 7 = 0 THEN concat('use', CAST(p_size AS STRING)) END AS caller
 FROM (SELECT *, unnest(range(0, CASE WHEN p_size % 7 = 0 THEN 2 ELSE 1 END)) AS k {_OWN} AND p_size % 4 <> 0) x""")
def _(t):
    return batches.clients_of(_chain_documents(t))


_FILES = """
 files AS (SELECT p_partkey AS k, concat(CASE p_size % 5 WHEN 0 THEN 'app/api/' WHEN 1 THEN 'app/services/core/' WHEN 2 THEN 'tests/' WHEN 3 THEN '.venv/lib/' ELSE 'app/repo/node_modules/' END, 'm', CAST(p_partkey AS STRING), CASE WHEN p_size = 7 THEN '/__init__.py' WHEN p_size = 9 THEN '.txt' ELSE '.py' END) AS path,
  concat('from app.api.m', CAST(p_partkey - 1 AS STRING), ' import f', CAST(p_partkey - 1 AS STRING), ' as prev', chr(10), 'import os', chr(10), CASE WHEN p_size = 11 THEN 'def broken(:' ELSE concat('def f', CAST(p_partkey AS STRING), '(self, a, b=1, *, c):', chr(10),
   '    "', p_name, '"', chr(10), '    if a:', chr(10), '        prev(b)', chr(10), '    return os.path.join(a)') END, chr(10)) AS content, p_retailprice AS size,
  TIMESTAMP '2024-01-01 00:00:00' + p_size * INTERVAL 1 HOUR AS mtime, p_size, p_name FROM part WHERE p_partkey > 0)"""
_SOURCE = " src AS (SELECT * FROM files WHERE p_size <> 9 AND p_size % 5 IN (0, 1, 2))"
_MODULE = "concat(CASE p_size % 5 WHEN 0 THEN 'app.api.' WHEN 1 THEN 'app.services.core.' ELSE 'tests.' END, 'm', CAST(k AS STRING))"


def _files(t):  # noqa: ANN001, ANN202
    return t.sql(f"WITH {_FILES} SELECT path, content, mtime, size FROM files")


@query("A3_source_files", f"WITH {_FILES}, {_SOURCE} SELECT path, size FROM src")
def _(t):
    return batches.source_files(_files(t)).select("path", "size")


@query("A5_read_templates", """
 SELECT concat('t', CAST(user_id AS STRING)) AS template_id, min(event_type) AS id, user_id % 2 = 0 AS deep FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def _(t):
    per = t("events").groupBy("user_id").agg(F.min("event_type").alias("id"))
    f = F.array(F.struct("id", (F.col("user_id") % 2 == 0).alias("deep")))
    doc = F.struct(F.when(F.col("user_id") % 3 == 0, 1).otherwise(2).alias("version"), F.lit("p").alias("project"), F.array(F.struct(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.lit("n").alias("name"), f.alias("functions"))).alias("templates"))
    read = batches.read_templates(per.select(F.to_json(doc).alias("json")), 2, "p")
    return read.select("template_id", F.inline("functions"))


@query("B4_redact_nested", """SELECT event_id, concat('{"outer": {"api_key": "«redacted»", "k": ', CAST(user_id AS STRING), '}, "list": [{"password": "«redacted»"}]}') AS doc FROM events""")
def _(t):
    doc = F.concat(F.lit('{"outer": {"api_key": "'), "event_type", F.lit('", "k": '), F.col("user_id").cast("string"), F.lit('}, "list": [{"password": 1}]}'))
    return t("events").select("event_id", text.redact_nested(doc).alias("doc"))


@query("B5_summarise_nested", """
 SELECT doc_id, concat('{"text": "', substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 100), CASE WHEN length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) > 100 THEN concat('…(+', CAST(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) - 100 AS STRING), ' chars)') ELSE '' END, '"}') AS doc FROM documents""")
def _(t):
    doc = F.concat(F.lit('{"text": "'), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit('"}'))
    return t("documents").select("doc_id", text.summarise_nested(doc, chars=100).alias("doc"))


@query("B14_decode_entities", "SELECT doc_id, concat('<', lang, '> & ', source) AS decoded FROM documents")
def _(t):
    return t("documents").select("doc_id", text.decode_entities(F.concat(F.lit("&amp;lt;"), "lang", F.lit("&gt; &amp;amp; "), "source")).alias("decoded"))


@query("B15_normalise_payload", """
 SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('{"a": [', CAST(user_id AS STRING), ', true], "b": null}') END AS doc FROM events""")
def _(t):
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("{'a': ("), F.col("user_id").cast("string"), F.lit(", True), 'b': None}"))).otherwise("not a payload")
    return t("events").select("event_id", text.normalise_payload(raw).alias("doc"))


# -- catalogue -----------------------------------------------------------------------------------------------------


def _functions(t):  # noqa: ANN001, ANN202
    return catalog.scan_functions(batches.source_files(_files(t)))


@query("F1_scan_functions", f"""
 WITH {_FILES}, {_SOURCE}
 SELECT path, CASE WHEN p_size = 11 THEN 'error' ELSE 'function' END AS kind, CASE WHEN p_size <> 11 THEN concat('f', CAST(k AS STRING)) END AS name, CASE WHEN p_size = 11 THEN CAST([] AS VARCHAR[]) ELSE ['self', 'a', 'b', 'c'] END AS params,
  CASE WHEN p_size <> 11 THEN p_name END AS doc, 3 AS line FROM src""")
def _(t):
    out = _functions(t)
    return out.select("path", "kind", "name", F.col("params.name").alias("params"), F.when(F.col("kind") != "error", F.col("doc")).alias("doc"), "line")


@query("F2_module_name", f"WITH {_FILES}, {_SOURCE} SELECT path, {_MODULE} AS module FROM src")
def _(t):
    return batches.source_files(_files(t)).select("path", catalog.module_name(F.col("path")).alias("module"))


@query("F3_function_ids", "SELECT function_id AS part_id, substr(sha1(concat(module, '.', name)), 1, 16) AS function_id, concat(module, ':', name) AS catalogue_id FROM fx_functions")
def _(t):
    f = t("fx_functions").select(F.col("function_id").alias("part_id"), "module", F.col("name").alias("qualname"))
    return catalog.function_ids(f).select("part_id", "function_id", "catalogue_id")


_CATALOGUE = f"""
 cat AS (SELECT CASE WHEN p_size % 5 = 0 THEN {_MODULE} ELSE 'app.services.core' END AS package, concat({_MODULE}, ':f', CAST(k AS STRING)) AS id, concat('f', CAST(k AS STRING)) AS name, '(a, b, c)' AS signature, p_name AS doc FROM src WHERE p_size <> 11 AND p_size % 5 <> 2)"""


@query("F4_catalogue", f"WITH {_FILES}, {_SOURCE}, {_CATALOGUE} SELECT * FROM cat")
def _(t):
    return catalog.catalogue(_functions(t)).select("package", "id", "name", "signature", "doc")


@query("F5_search_catalogue", f"WITH {_FILES}, {_SOURCE}, {_CATALOGUE} SELECT id, doc, (SELECT count(*) FROM cat WHERE contains(lower(doc), 'widget')) AS total_matches FROM cat WHERE contains(lower(doc), 'widget') ORDER BY package, id LIMIT 50")
def _(t):
    return catalog.search_catalogue(catalog.catalogue(_functions(t)), "Widget", 50).select("id", "doc", "total_matches")


@query("F6_close_matches")
def _(t):
    known = t("fx_functions").select(F.concat_ws(":", "module", "name").alias("id"))
    gone = t("supplier").select(F.concat(F.lit("app.api.brand"), F.col("s_suppkey").cast("string"), F.lit(":small_rings")).alias("id"))
    return catalog.close_matches(gone, known, exact=True)


@query("F7_corpus_fingerprint")
def _(t):
    return catalog.corpus_fingerprint(batches.source_files(_files(t)))


@query("F8_run_vs_disk", f"""
 WITH {_FILES}, n AS (SELECT * FROM files WHERE p_size <> 9 AND starts_with(path, 'app/') AND p_size > 20)
 SELECT 'older' AS state, count(*) AS newer_files, arg_max(path, (mtime, path)) AS newest_file FROM n""")
def _(t):
    return catalog.run_vs_disk(_files(t), "2024-01-01 20:00:00")


@query("F9_resolve_imports", f"""
 WITH {_FILES}, {_SOURCE}, ok AS (SELECT *, {_MODULE} AS module FROM src WHERE p_size <> 11)
 SELECT a.module, 'prev' AS alias, CASE WHEN b.k IS NOT NULL THEN b.module END AS found_module, CASE WHEN b.k IS NOT NULL THEN concat('f', CAST(b.k AS STRING)) END AS found_name
 FROM ok a LEFT JOIN ok b ON b.k = a.k - 1 AND starts_with(b.module, 'app.api.') UNION ALL SELECT module, 'os', NULL, NULL FROM ok""")
def _(t):
    files = batches.source_files(_files(t))
    return catalog.resolve_imports(catalog.scan_imports(files), catalog.scan_names(files)).select("module", "alias", "found_module", "found_name")


@query("F10_scan_steps", f"""
 WITH {_FILES}, {_SOURCE}, s AS (SELECT {_MODULE} AS module, concat('f', CAST(k AS STRING)) AS function FROM src WHERE p_size <> 11)
 SELECT module, function, step_id, kind, callee FROM s, (VALUES ('0', 'if', NULL), ('0.0', 'arm', NULL), ('0.0.0', 'call', 'prev'), ('1', 'call', 'os.path.join'), ('2', 'return', NULL)) AS v(step_id, kind, callee)""")
def _(t):
    return catalog.scan_steps(batches.source_files(_files(t))).select("module", "function", "step_id", "kind", "callee")


@query("F11_resolve_calls", f"""
 WITH {_FILES}, {_SOURCE}, ok AS (SELECT *, {_MODULE} AS module FROM src WHERE p_size <> 11)
 SELECT a.module, 'prev' AS callee, CASE WHEN b.k IS NOT NULL THEN 'import' ELSE 'external' END AS how, CASE WHEN b.k IS NOT NULL THEN concat(b.module, ':f', CAST(b.k AS STRING)) ELSE concat('app.api.m', CAST(a.k - 1 AS STRING)) END AS target
 FROM ok a LEFT JOIN ok b ON b.k = a.k - 1 AND starts_with(b.module, 'app.api.') UNION ALL SELECT module, 'os.path.join', 'external', 'os.path.join' FROM ok""")
def _(t):
    files = batches.source_files(_files(t))
    resolved = catalog.resolve_imports(catalog.scan_imports(files), catalog.scan_names(files))
    return catalog.resolve_calls(catalog.scan_steps(files), resolved, catalog.scan_functions(files)).select("module", "callee", "how", "target")


_STEPS = " nd AS (SELECT user_id AS tree_id, user_id % 3 AS parent_id, event_id AS ordinal, CASE WHEN user_id % 7 = 0 THEN 'function' ELSE 'external' END AS kind, event_type AS name, 'call' AS edge, 'x' AS op, [concat('f', CAST(event_id % 3 AS STRING)), concat('f', CAST(event_id % 2 AS STRING))] AS fields FROM events)"


@query("F12_merge_adjacent_calls", f"""
 WITH {_STEPS}, r AS (SELECT *, CASE WHEN kind = 'external' THEN row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY ordinal) - row_number() OVER (PARTITION BY tree_id, parent_id, kind, name ORDER BY ordinal) ELSE -row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY ordinal) END AS run FROM nd)
 SELECT tree_id, parent_id, kind, name, edge, op, min(ordinal) AS ordinal, count(*) AS count,
  list_reduce(flatten(list(fields ORDER BY ordinal)), lambda s, x: CASE WHEN contains(concat(s, ' '), concat(x, ' ')) THEN s ELSE concat(s, ' ', x) END) AS fields FROM r GROUP BY tree_id, parent_id, kind, name, edge, op, run""")
def _(t):
    nodes = t.sql(f"WITH {_STEPS} SELECT * FROM nd".replace("[concat", "array(concat").replace("AS STRING))] AS fields", "AS STRING))) AS fields"))
    return catalog.merge_adjacent_calls(nodes).withColumn("fields", F.array_join("fields", " "))


@query("F13_scan_route_decls", """
 SELECT concat('app.r', CAST(p_partkey AS STRING)) AS module, kind, target, method, path FROM part, (VALUES ('router', 'router', NULL, NULL), ('route', 'router', 'GET', '/x/{id}'), ('include', 'app', NULL, NULL)) AS v(kind, target, method, path)""")
def _(t):
    code = F.lit('from fastapi import APIRouter\nrouter = APIRouter(prefix="/v1", tags=["t"])\n@router.get("/x/{id}")\ndef h(id):\n    return id\napp.include_router(router, prefix="/p")\n')
    files = t("part").select(F.concat(F.lit("app/r"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content"))
    return catalog.scan_route_decls(files).select("module", "kind", "target", "method", "path")


_MOUNTS = """
 co AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey < 2 THEN 'app' ELSE 'router' END AS kind, concat('/n', CAST(n_nationkey AS STRING)) AS prefix FROM nation),
 inc AS (SELECT CAST(floor(n_nationkey / 3.0) AS INT) AS parent, n_nationkey AS child FROM nation WHERE n_nationkey BETWEEN 2 AND 20),
 ro AS (SELECT s_nationkey AS container, 'GET' AS method, concat('/s', CAST(s_suppkey % 5 AS STRING)) AS path, s_suppkey AS ord FROM supplier)"""


def _mounts(t):  # noqa: ANN001, ANN202
    tags = F.array(F.concat(F.lit("t"), F.col("id").cast("string")))
    none = F.array().cast("array<string>")
    c = t.sql(f"WITH {_MOUNTS} SELECT CAST(id AS STRING) AS id, kind, prefix FROM co").withColumns({"tags": tags, "deps": none})
    i = t.sql(f"WITH {_MOUNTS} SELECT CAST(parent AS STRING) AS parent, CAST(child AS STRING) AS child FROM inc").withColumns({"prefix": F.lit(""), "tags": none, "deps": none})
    r = t.sql(f"WITH {_MOUNTS} SELECT CAST(container AS STRING) AS container, method, path, ord FROM ro").withColumns({"tags": none, "deps": none, "handler": F.lit("h")})
    return c, i, r


@query("F14_expand_mounts", f"""
 WITH RECURSIVE {_MOUNTS},
 m AS (SELECT id AS at, prefix, concat('t', CAST(id AS STRING)) AS tags FROM co WHERE kind = 'app' UNION ALL SELECT c.id, concat(m.prefix, c.prefix), concat(m.tags, ',t', CAST(c.id AS STRING)) FROM m JOIN inc ON inc.parent = m.at JOIN co c ON c.id = inc.child WHERE inc.parent <> inc.child)
 SELECT method, concat(m.prefix, ro.path) AS path, tags, count(*) AS n FROM m JOIN ro ON ro.container = m.at GROUP BY 1, 2, 3""")
def _(t):
    return catalog.expand_mounts(*_mounts(t)).groupBy("method", "path", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


@query("F15_unmounted_routers", f"""
 WITH {_MOUNTS} SELECT CAST(id AS STRING) AS id, count(*) AS route_count FROM co JOIN ro ON ro.container = co.id WHERE id > 20 GROUP BY 1""")
def _(t):
    c, i, r = _mounts(t)
    return catalog.unmounted_routers(c, catalog.expand_mounts(c, i, r), r)


@query("F16_group_endpoints", r"""
 WITH p AS (SELECT path, list_filter(string_split(path, '/'), lambda s: s <> '' AND NOT starts_with(s, '{')) AS s FROM fx_l_endpoint), n AS (SELECT s[1] AS k, count(*) AS n FROM p GROUP BY 1)
 SELECT path, concat('/', CASE WHEN n > 20 THEN array_to_string(list_slice(s, 1, 2), '/') ELSE s[1] END) AS prefix FROM p JOIN n ON n.k = p.s[1]""")
def _(t):
    return catalog.group_endpoints(t("fx_l_endpoint")).select("path", "prefix")


# -- selection -----------------------------------------------------------------------------------------------------

_LOG = """ lg AS (SELECT user_id % 5 AS instance, event_id AS change_no, CASE WHEN event_id % 997 = 0 THEN 'clear' WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, concat('f', CAST(user_id AS STRING)) AS id, value > 20 AS deep FROM events)"""


@query("G1_apply_selection_log", f"""
 WITH {_LOG}, c AS (SELECT instance, max(change_no) AS f FROM lg WHERE op = 'clear' GROUP BY 1),
 l AS (SELECT lg.*, row_number() OVER (PARTITION BY lg.instance, id ORDER BY change_no DESC) AS k FROM lg LEFT JOIN c ON c.instance = lg.instance WHERE op <> 'clear' AND (f IS NULL OR change_no >= f))
 SELECT instance, id, deep FROM l WHERE k = 1 AND op = 'add'""")
def _(t):
    return selection.apply_selection_log(t.sql(f"WITH {_LOG} SELECT * FROM lg"))


@query("G2_template_status", "SELECT CAST(p_partkey AS BIGINT) AS template_id, CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'missing' END AS status FROM part")
def _(t):
    name = F.concat(F.lit("app.m:"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    p = t("part")
    templates = p.select(F.col("p_partkey").alias("template_id"), name.alias("id"), F.lit(True).alias("deep"))
    return selection.template_status(templates, p.filter("p_partkey % 2 = 0").select(name.alias("id"))).select("template_id", "status")


@query("G4_expand_template", "SELECT user_id AS template_id, event_type AS id, event_type = 'error' AS deep, event_type <> 'view' AS resolved FROM events GROUP BY user_id, event_type")
def _(t):
    f = F.collect_set(F.struct(F.col("event_type").alias("id"), (F.col("event_type") == "error").alias("deep")))
    templates = t("events").groupBy(F.col("user_id").alias("template_id")).agg(f.alias("functions"))
    known = t("events").select(F.col("event_type").alias("id")).filter("id <> 'view'").distinct()
    return selection.expand_template(templates, known)


@query("G5_selection_diff", """
 WITH a AS (SELECT DISTINCT user_id AS id, user_id % 2 = 0 AS deep FROM events WHERE user_id % 3 <> 0), b AS (SELECT DISTINCT user_id AS id, user_id % 4 = 0 AS deep FROM events WHERE user_id % 5 <> 0)
 SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.deep <> b.deep THEN 'mode_changed' END AS change FROM a FULL JOIN b ON a.id = b.id) x WHERE change IS NOT NULL""")
def _(t):
    u = t("events").select(F.col("user_id").alias("id")).distinct()
    return selection.selection_diff(u.filter("id % 3 <> 0").withColumn("deep", F.col("id") % 2 == 0), u.filter("id % 5 <> 0").withColumn("deep", F.col("id") % 4 == 0))


_FILL = """
 sk AS (SELECT p_partkey AS function_id, concat('h', CAST(p_size AS STRING)) AS body_hash, s AS step_id, concat('step ', s) AS text, p_name AS doc FROM part, (VALUES ('0'), ('1')) AS v(s)),
 fl AS (SELECT p_partkey AS function_id, concat('h', CAST(CASE WHEN p_partkey % 7 = 0 THEN 99 ELSE p_size END AS STRING)) AS body_hash, CASE WHEN p_partkey % 5 = 0 THEN 'why' ELSE '' END AS purpose, CASE WHEN p_partkey % 11 = 0 THEN '9' ELSE '1' END AS step_id, 'a label' AS label, CAST(NULL AS STRING) AS note FROM part WHERE p_partkey % 2 = 0)"""


@query("G6_validate_fills", f"""
 WITH {_FILL} SELECT function_id, 'body_hash does not match the current code (stale fill)' AS problem FROM fl WHERE function_id % 7 = 0
 UNION ALL SELECT function_id, 'unknown step id ''9'' (the structure is locked)' FROM fl WHERE function_id % 11 = 0""")
def _(t):
    return selection.validate_fills(t.sql(f"WITH {_FILL} SELECT * FROM sk"), t.sql(f"WITH {_FILL} SELECT * FROM fl"))


@query("G7_merge_fills", f"""
 WITH {_FILL} SELECT s.function_id, s.step_id, CASE WHEN ok AND s.step_id = '1' THEN 'a label' ELSE s.text END AS label, CASE WHEN ok AND s.function_id % 5 = 0 THEN 'why' ELSE s.doc END AS purpose,
  CASE WHEN ok THEN 'filled' WHEN ok IS NOT NULL THEN 'stale' ELSE 'deterministic' END AS fill_status FROM sk s LEFT JOIN (SELECT function_id, function_id % 7 <> 0 AND function_id % 11 <> 0 AS ok FROM fl) f ON f.function_id = s.function_id""")
def _(t):
    return selection.merge_fills(t.sql(f"WITH {_FILL} SELECT * FROM sk"), t.sql(f"WITH {_FILL} SELECT * FROM fl")).select("function_id", "step_id", "label", "purpose", "fill_status")


# -- streaming: the events as files, run to their end ---------------------------------------------------------------


def _fresh(t) -> str:  # noqa: ANN001
    return f"{shared_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def _stream(t, name: str = "fx_events", shuffled: bool = False):  # noqa: ANN001, ANN202
    """A file stream over the view, in files that come one after the other: spans and requests go on over micro-batches.

    The first, the next and the last events of each request come in turn, or, shuffled, any of them at any time. A tick of a far
    later time ends it, so that all timers fire.
    """
    rows = durable(t(name).withColumn("ts", F.col("ts").cast("timestamp")))  # the view is made once for all turns
    files = max(4, 1 + rows.count() // PART_ROWS)
    folder = f"{_fresh(t)}/in"
    place = F.coalesce(F.col("seq") % 100000, F.lit(0))  # of an event in its request
    part = F.pmod(F.xxhash64("kind", "request_id", "span_id"), F.lit(3))
    for turn in (part == 0, part == 1, part == 2) if shuffled else (place <= 20, (place > 20) & (place <= 100), place > 100):
        rows.filter(turn).repartition(files).write.mode("append").parquet(folder)
    tick = rows.limit(1).select(*[F.lit({"kind": "log", "request_id": "tick"}.get(f.name)).cast(f.dataType).alias(f.name) if f.name != "ts" else F.lit("2030-01-01").cast("timestamp").alias("ts") for f in rows.schema])
    tick.coalesce(1).write.mode("append").parquet(folder)
    return streams.event_stream(t.spark, folder, rows.schema, files)


@query("A2_stream_counters", """
 WITH b AS (SELECT CAST(floor(seq / 100) AS BIGINT) AS b, count(*) AS n FROM fx_events GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS events_in, CAST(sum(b % 3) AS BIGINT) AS dropped, count(*) FILTER (b % 10 = 0) AS registers FROM b""")
def _(t):
    base = _fresh(t)
    stream = t.spark.readStream.schema(batches.BATCH).json(_batch_files(t))
    streams.count_ingest(stream, base, f"{base}/state", batches.events_of).awaitTermination()
    return t.spark.read.parquet(f"{base}/counters").agg(*[F.sum(c).alias(c) for c in ("events_in", "dropped", "registers")])


@query("E1_event_stream", "SELECT kind, count(*) AS n FROM fx_events GROUP BY 1")
def _(t):
    base = _fresh(t)
    streams.fan_out(_stream(t), {"starts": lambda b: b.filter("kind LIKE '%.start'"), "rest": lambda b: b.filter("kind NOT LIKE '%.start' AND request_id <> 'tick'")}, f"{base}/out", f"{base}/state").awaitTermination()
    both = t.spark.read.parquet(f"{base}/out/starts").unionByName(t.spark.read.parquet(f"{base}/out/rest"))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query("E2_stream_dedup", """
 SELECT kind, request_id, span_id, seq, count(*) AS n FROM (
  SELECT kind, request_id, span_id, seq FROM fx_events_dup WHERE seq IS NULL
  UNION ALL SELECT DISTINCT kind, request_id, span_id, seq FROM fx_events_dup WHERE seq IS NOT NULL) x GROUP BY 1, 2, 3, 4""")
def _(t):
    got = streams.run_available(streams.stream_dedup(_stream(t, "fx_events_dup"), "400 days")).filter("request_id <> 'tick'")
    return got.groupBy("kind", "request_id", "span_id", "seq").agg(F.count("*").alias("n"))


@query("E3_stream_spans", f"WITH {_SPANS} SELECT * FROM spans")
def _(t):
    return streams.run_available(streams.stream_spans(_stream(t, shuffled=True), "400 days")).drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("E4_stream_requests", f"WITH {_REQUESTS} SELECT * FROM requests")
def _(t):
    return streams.run_available(streams.stream_requests(_stream(t, shuffled=True), "400 days")).drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("E5_stream_overlay", "SELECT name, count(*) AS calls, count(*) FILTER (kind = 'fn.error') AS errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(duration_ms) AS max_ms FROM fx_events WHERE kind IN ('fn.end', 'fn.error') GROUP BY 1")
def _(t):
    base = _fresh(t)
    streams.upsert(streams.stream_overlay(_stream(t, shuffled=True)), ["name"], f"{base}/table", f"{base}/state").awaitTermination()
    return streams.current(t.spark, f"{base}/table")


@query("E6_stream_caps", """
 SELECT request_id, span_id, n, n <= 5 AS captured FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, name ORDER BY seq) AS n, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS k FROM fx_events WHERE kind = 'fn.start') x WHERE k <= 60""")
def _(t):
    return streams.run_available(streams.stream_caps(_stream(t), 5, 60, "400 days")).select("request_id", "span_id", "n", "captured")


_REGISTERS = "SELECT CAST(user_id AS STRING) AS target, ts, CAST(floor(event_id / 1000.0) AS BIGINT) AS started_at FROM events"


@query("E7_stream_liveness", f"""
 WITH r AS ({_REGISTERS}), g AS (SELECT *, lag(started_at) OVER (PARTITION BY target ORDER BY ts, started_at) AS b FROM r)
 SELECT target, max(ts) AS last_seen, arg_max(started_at, (ts, started_at)) AS started_at, count(*) FILTER (b IS NOT NULL AND b <> started_at) AS restarts, count(*) AS handshakes, false AS connected FROM g GROUP BY 1""")
def _(t):
    base, rows = _fresh(t), t.sql(_REGISTERS).withColumn("ts", F.col("ts").cast("timestamp"))
    files = max(4, 1 + rows.count() // PART_ROWS)
    for turn in ("ts < '2024-01-11'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts >= '2024-01-21'"):
        rows.filter(turn).repartition(files).write.mode("append").parquet(f"{base}/in")
    rows.limit(1).select(F.lit("tick").alias("target"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("started_at")).write.mode("append").parquet(f"{base}/in")
    live = streams.run_available(streams.stream_liveness(streams.event_stream(t.spark, f"{base}/in", rows.schema, files), watermark="400 days"))
    newest = live.filter("target <> 'tick'").groupBy("target").agg(F.max_by(F.struct("last_seen", "started_at", "restarts", "handshakes", "connected"), F.struct("batch", ~F.col("connected"))).alias("l"))
    return newest.select("target", "l.*").withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("E7_liveness", """
 WITH r AS (SELECT user_id AS target, ts, CAST(floor(event_id / 1000.0) AS BIGINT) AS started_at FROM events), g AS (SELECT *, lag(started_at) OVER (PARTITION BY target ORDER BY ts, started_at) AS b FROM r)
 SELECT target, max(ts) AS last_seen, count(*) FILTER (b IS NOT NULL AND b <> started_at) AS restarts, count(*) AS handshakes, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 90 SECOND AS connected FROM g GROUP BY 1""")
def _(t):
    r = t("events").select(F.col("user_id").alias("target"), "ts", F.floor(F.col("event_id") / 1000).alias("started_at"))
    return streams.liveness(r, "2024-01-30 12:00:00")
