"""Operator inputs derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import sized_by_rows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "fx_spans": """
 SELECT user_id, event_id, n AS span_no, pn AS parent_no, ts, CASE WHEN pn IS NULL THEN 'api.root:handler' WHEN pn % 3 = 2 THEN 'svc.loop:step' ELSE concat('svc.', event_type, ':run') END AS name,
  CAST(floor(value) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status
 FROM (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n <= 7 THEN CAST(floor(n / 2.0) AS INT) ELSE CAST(4 + floor((n - 8) / 12.0) AS INT) END AS pn
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS n FROM events) a) b""",
    "fx_requests": """
 SELECT user_id, concat('req_', CAST(user_id AS STRING)) AS request_id, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE user_id % 4 WHEN 0 THEN '/q/health' WHEN 1 THEN concat('/q/', CAST(user_id AS STRING)) WHEN 2 THEN concat('/q/', CAST(user_id AS STRING), '/items?x=1') ELSE concat('/files/a/', CAST(user_id AS STRING), '/b') END AS path,
  min(ts) AS ts, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, max(CASE WHEN status = 'error' THEN 500 ELSE 200 END) AS status
 FROM fx_spans GROUP BY user_id""",
    "fx_events": """
 SELECT 'request.start' AS kind, request_id, CAST(NULL AS STRING) AS span_id, CAST(NULL AS STRING) AS parent_span_id, CAST(user_id * 100000 AS BIGINT) AS seq, ts, method, path, CAST(NULL AS STRING) AS name, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS INT) AS status FROM fx_requests
 UNION ALL SELECT 'request.end', request_id, NULL, NULL, CAST(user_id * 100000 + 99999 AS BIGINT), ts, NULL, NULL, NULL, duration_ms, CAST(status AS INT) FROM fx_requests WHERE user_id % 10 <> 9
 UNION ALL SELECT 'fn.start', concat('req_', CAST(user_id AS STRING)), concat('sp_', CAST(span_no AS STRING)), CASE WHEN parent_no IS NULL THEN NULL ELSE concat('sp_', CAST(parent_no AS STRING)) END, CAST(user_id * 100000 + 2 * span_no AS BIGINT), ts, NULL, NULL, name, NULL, NULL FROM fx_spans
 UNION ALL SELECT CASE WHEN status = 'error' THEN 'fn.error' ELSE 'fn.end' END, concat('req_', CAST(user_id AS STRING)), concat('sp_', CAST(span_no AS STRING)), CASE WHEN parent_no IS NULL THEN NULL ELSE concat('sp_', CAST(parent_no AS STRING)) END, CAST(user_id * 100000 + 2 * span_no + 1 AS BIGINT), ts, NULL, NULL, name, duration_ms, NULL FROM fx_spans WHERE event_id % 97 <> 0""",
    "fx_events_full": """
 SELECT e.*, CASE WHEN kind = 'fn.start' THEN concat('app/', replace(name, ':', '/'), '.py') END AS file, CASE WHEN kind = 'fn.start' THEN CAST(seq % 97 AS INT) END AS src_line,
  CASE WHEN kind = 'fn.start' THEN repeat(concat(span_id, ' '), CAST(seq % 5 AS INT) * 300) END AS args, CASE WHEN kind = 'fn.start' THEN seq % 5 = 4 END AS args_truncated, CASE WHEN kind = 'fn.end' THEN repeat('ok ', CAST(seq % 7 AS INT) * 300) END AS result,
  CASE WHEN kind = 'fn.end' THEN seq % 7 = 6 END AS result_truncated, CASE WHEN kind = 'fn.error' THEN 'ValueError' END AS exc_type, CASE WHEN kind = 'fn.error' THEN concat('boom ', span_id) END AS message,
  CASE WHEN kind = 'request.end' THEN concat('/route/', CAST(duration_ms % 5 AS STRING)) END AS route, CASE WHEN kind = 'request.end' THEN 'api.root:handler' END AS handler, CAST(NULL AS STRING) AS label, CAST(NULL AS STRING) AS model FROM fx_events e
 UNION ALL SELECT 'llm.call', request_id, span_id, parent_span_id, seq + 1, ts, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, concat('ask ', span_id), concat('m', CAST(seq % 3 AS STRING)) FROM fx_events WHERE kind = 'fn.start' AND seq % 6 = 0""",
    "fx_static_edges": """
 SELECT DISTINCT p.name AS caller, t.name AS callee FROM fx_tree t JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id WHERE t.name <> 'svc.error:run' AND p.name <> 'svc.click:run'""",
    "fx_events_dup": """
 SELECT *, 1 AS copy FROM fx_events UNION ALL SELECT *, 2 AS copy FROM fx_events WHERE seq % 11 = 0
 UNION ALL SELECT 'log', request_id, NULL, NULL, NULL, ts, NULL, NULL, NULL, NULL, NULL, 1 FROM fx_requests
 UNION ALL SELECT 'log', request_id, NULL, NULL, NULL, ts, NULL, NULL, NULL, NULL, NULL, 2 FROM fx_requests""",
    "fx_tree": """
 SELECT concat('req_', CAST(user_id AS STRING)) AS request_id, concat('sp_', CAST(span_no AS STRING)) AS span_id, CASE WHEN parent_no IS NULL THEN NULL ELSE concat('sp_', CAST(parent_no AS STRING)) END AS parent_span_id,
  CAST(user_id * 100000 + 2 * span_no AS BIGINT) AS seq, ts, name, duration_ms, status FROM fx_spans""",
    "fx_endpoints": """
 SELECT * FROM (VALUES (1,'GET /q/{id}','GET','/q/{id}'),(2,'GET /q/health','GET','/q/health'),(3,'POST /q/{id}','POST','/q/{id}'),(4,'GET /q/{id}/items','GET','/q/{id}/items'),(5,'GET /files/{p:path}','GET','/files/{p:path}')) AS t(ord, endpoint_id, method, pattern)""",
    "fx_selection": "SELECT * FROM (VALUES ('svc.error:run', true), ('svc.loop:step', false), ('svc.gone:run', true)) AS t(id, deep)",
    "fx_call_edges": """
 SELECT CAST(caller AS BIGINT) AS caller, CAST(callee AS BIGINT) AS callee, edge FROM (
  SELECT p_partkey AS caller, 2 * p_partkey + 1 AS callee, 'call' AS edge FROM part
  UNION ALL SELECT p_partkey, 2 * p_partkey + 2, CASE WHEN p_size > 25 THEN 'await' ELSE 'call' END FROM part
  UNION ALL SELECT p_partkey, 3 * p_partkey + 7, 'spawn' FROM part WHERE p_size % 5 = 0) e WHERE callee IN (SELECT p_partkey FROM part)""",
    "fx_call_edges_cyclic": """
 SELECT * FROM fx_call_edges UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 4.0) AS BIGINT), 'callback' FROM part WHERE p_partkey % 50 = 49""",
    "fx_roots": "SELECT CAST(p_partkey AS BIGINT) AS root, concat('GET /p/', CAST(p_partkey AS STRING)) AS endpoint_id FROM part WHERE p_type = 'ECONOMY'",
    "fx_call_sites": """
 SELECT caller, callee, CAST(row_number() OVER (PARTITION BY caller ORDER BY callee % 5, callee) - 1 AS INT) AS ordinal FROM (SELECT DISTINCT caller, callee FROM fx_call_edges WHERE caller <> callee) s""",
    "fx_tree_nodes": """
 SELECT CAST(p_partkey AS BIGINT) AS node, CASE p_size % 10 WHEN 0 THEN 'external' WHEN 1 THEN 'class' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'loop' WHEN 4 THEN 'branch' WHEN 5 THEN 'graph' WHEN 6 THEN 'dispatch' ELSE 'function' END AS kind, p_size % 7 = 0 AS cyclic FROM part""",
    "fx_db_field": """
 SELECT l_partkey AS function_id, l_suppkey AS table_id, concat('f', CAST(l_linenumber % 4 AS STRING)) AS field, CASE WHEN l_linenumber % 3 = 0 THEN 'any' WHEN l_returnflag = 'R' THEN 'string' ELSE 'integer' END AS type,
  CASE WHEN l_linestatus = 'O' THEN 'write' ELSE 'query' END AS source, min(l_orderkey) AS ord FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "fx_db_edge": """
 SELECT l_partkey AS function_id, l_suppkey AS table_id, concat('L', CAST(l_orderkey % 3 AS STRING)) AS source, concat('L', CAST(l_linenumber % 2 AS STRING)) AS target, bool_and(l_tax > 0.04) AS uncertain FROM lineitem GROUP BY 1, 2, 3, 4""",
    "fx_db_model": "SELECT CAST(s_suppkey AS BIGINT) AS table_id, concat('f', CAST(s_suppkey % 6 AS STRING)) AS field, CASE WHEN s_suppkey % 4 = 0 THEN 'any' ELSE 'object' END AS type, 'model' AS source FROM supplier WHERE s_suppkey % 2 = 0",
    "fx_functions": """
 SELECT CAST(p_partkey AS BIGINT) AS function_id, concat(CASE p_type WHEN 'ECONOMY' THEN 'app.api' WHEN 'SMALL' THEN 'app.services' WHEN 'MEDIUM' THEN 'app.repo' WHEN 'PROMO' THEN 'app.utils' ELSE 'app.main' END, '.', lower(replace(p_brand, '#', ''))) AS module,
  concat(CASE WHEN p_size % 7 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '_')) AS name, CAST(p_size AS INT) AS loc, p_size % 3 AS branches FROM part""",
    "fx_db_access": """
 SELECT l_partkey AS function_id, l_suppkey AS table_id, CASE WHEN l_returnflag = 'R' THEN 'read' WHEN l_returnflag = 'A' THEN 'write' WHEN l_linestatus = 'O' THEN 'upsert' ELSE 'delete' END AS op,
  count(*) AS n, bool_and(l_discount > 0.05) AS uncertain FROM lineitem GROUP BY 1, 2, 3""",
    "fx_llm": """
 SELECT conv_id, turn, role, text, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS tokens, CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model FROM conversations""",
    "fx_op_log": """
 SELECT event_id, CASE event_type WHEN 'view' THEN 'find' WHEN 'click' THEN 'find_one' WHEN 'error' THEN 'delete_one' WHEN 'signup' THEN 'insert_one' ELSE 'update_one' END AS method,
  concat('mongo:t', CAST(user_id % 7 AS STRING)) AS table_id, props AS doc FROM events""",
    "fx_paths": "SELECT page_id, url FROM pages",
    "fx_l_endpoint": "SELECT DISTINCT concat('/', lower(p_type), '/{id}/', CAST(p_size AS STRING)) AS path, 'POST' AS method, concat('POST /', lower(p_type), '/{id}/', CAST(p_size AS STRING)) AS id, concat('handle_', lower(p_type)) AS handler FROM part",
    "fx_l_service": """
 SELECT DISTINCT concat('svc_', CAST(l_suppkey AS STRING)) AS service_func, concat('/', lower(p_type), '/:sid/', CAST(CAST(l_quantity AS INT) AS STRING), '?v=1') AS raw_path
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_l_controller": "SELECT concat('svc_', CAST(s_suppkey AS STRING)) AS service_func, concat('ctl_', CAST(s_nationkey AS STRING)) AS controller_func FROM supplier WHERE s_suppkey % 3 <> 0",
    "fx_l_route": "SELECT concat('ctl_', CAST(n_nationkey AS STRING)) AS controller_func, concat('/api/n/', CAST(n_regionkey AS STRING), '/:id') AS full_path, concat('/n/', CAST(n_regionkey AS STRING), '/:id') AS sub_path FROM nation WHERE n_nationkey % 4 <> 3",
    "fx_l_api": """
 SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'admin' ELSE 'frontend' END AS app, concat('get', CAST(r_regionkey AS STRING)) AS api_func, CASE WHEN r_regionkey = 3 THEN '/v2/n' ELSE concat('/api/n/', CAST(r_regionkey AS STRING), '/{x}') END AS url,
  CASE WHEN r_regionkey = 2 THEN '/elsewhere' ELSE concat('/n/', CAST(r_regionkey AS STRING), '/{x}') END AS raw_url FROM region WHERE r_regionkey < 4""",
    "fx_l_ui": "SELECT app, api_func, concat('Comp', api_func) AS component, concat('use', app) AS caller FROM fx_l_api WHERE api_func <> 'get1'",
}


def with_views(sql: str, recursive: bool = False) -> str:
    """sql with the views that it names, and those that they name, as common table expressions before its own."""
    found: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in found:
                need(VIEWS[name])
                found.append(name)

    need(sql)
    parts = [f"{n} AS ({VIEWS[n]})" for n in found]
    sql = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        recursive, sql = recursive or bool(own[1]), ", " + sql[own.end() :]
    if not parts:
        return ("WITH " + ("RECURSIVE " if recursive else "") + sql[2:]) if own else sql
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + ("" if own else "\n") + sql


class Tables:
    """The driver's tables under a folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        sized_by_rows(spark)

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for t in TABLES:
            if re.search(rf"\b(FROM|JOIN)\s+{t}\b", full):
                self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return self.spark.sql(full)
