"""Registered queries of the event, span and overlay operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import events, graph, overlay, spans
from ..sources import batches
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


@query("A4_replay", "SELECT * FROM fx_events WHERE seq >= 300000")
def _(t):
    import uuid

    path = f"{shared_dir(t.spark)}/logs/{uuid.uuid4().hex}"
    batches.write_event_log(t("fx_events"), path)
    return batches.replay(t.spark, path, since_seq=300000).drop("date")


@query("B1_dedup_events", """
 SELECT kind, request_id, span_id, seq, count(*) AS n FROM (
  SELECT kind, request_id, span_id, seq FROM fx_events_dup WHERE seq IS NULL
  UNION ALL SELECT DISTINCT kind, request_id, span_id, seq FROM fx_events_dup WHERE seq IS NOT NULL) x GROUP BY 1, 2, 3, 4""")
def _(t):
    return events.dedup_events(t("fx_events_dup"), ("copy",)).groupBy("kind", "request_id", "span_id", "seq").agg(F.count("*").alias("n"))


@query("B2_filter_events", """
 SELECT kind, request_id, span_id, seq, name FROM fx_events WHERE kind = 'fn.start' AND instr(lower(name), 'error') > 0 ORDER BY seq DESC LIMIT 50""")
def _(t):
    return events.filter_events(t("fx_events"), 50, name="ERROR", kind="fn.start").select("kind", "request_id", "span_id", "seq", "name")


@query("B3_search_events", """
 SELECT kind, request_id, seq FROM fx_events WHERE contains(lower(coalesce(request_id, '')), 'items') OR contains(lower(coalesce(span_id, '')), 'items')
  OR contains(lower(kind), 'items') OR contains(lower(coalesce(name, '')), 'items') OR contains(lower(coalesce(path, '')), 'items')""")
def _(t):
    return events.search_events(t("fx_events"), " ITEMS ").select("kind", "request_id", "seq")


@query("B4_redact_secrets", """
 SELECT event_id, '«redacted»' AS api_key, props AS note FROM events""")
def _(t):
    m = F.create_map(F.lit("API_key"), F.col("props"), F.lit("note"), F.col("props"))
    out = t("events").select("event_id", events.redact_map(m).alias("m"))
    return out.select("event_id", F.col("m")["API_key"].alias("api_key"), F.col("m")["note"].alias("note"))


@query("B5_summarise_values", """
 SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(substr(text, 1, 2000), '…(+', CAST(length(text) - 2000 AS STRING), ' chars)') ELSE text END AS short FROM documents""")
def _(t):
    return t("documents").select("doc_id", events.shorten(F.col("text")).alias("short"))


@query("B6_preview", """
 SELECT doc_id, CASE WHEN length(text) > 600 THEN concat(substr(text, 1, 600), '…') ELSE text END AS preview, length(text) > 600 AS truncated FROM documents""")
def _(t):
    return t("documents").select("doc_id", events.preview(F.col("text")).alias("p")).select("doc_id", F.col("p.text").alias("preview"), "p.truncated")


@query("B7_capture_cap", """
 SELECT request_id, span_id, n, n <= 5 AS captured, CASE WHEN n <= 5 THEN parent_span_id END AS parent_span_id FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id, name ORDER BY seq, span_id) AS n FROM fx_events WHERE kind = 'fn.start') x""")
def _(t):
    return events.capture_cap(t("fx_events"), 5, ["parent_span_id"]).select("request_id", "span_id", "n", "captured", "parent_span_id")


@query("B8_span_cap", """
 WITH s AS (SELECT request_id, span_id, row_number() OVER (PARTITION BY request_id ORDER BY seq, span_id) AS n FROM fx_events WHERE kind = 'fn.start')
 SELECT e.kind, e.request_id, e.span_id, e.seq, e.name FROM fx_events e LEFT JOIN s ON s.request_id = e.request_id AND s.span_id = e.span_id WHERE n IS NULL OR n <= 60
 UNION ALL SELECT 'log', request_id, NULL, NULL, concat('span cap reached: ', CAST(max(n) AS STRING)) FROM s GROUP BY request_id HAVING max(n) > 60""")
def _(t):
    return events.span_cap(t("fx_events"), 60).select("kind", "request_id", "span_id", "seq", "name")


@query("B9_call_counts", """
 SELECT request_id, name, calls, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY calls DESC, first_seq) AS rank FROM (
   SELECT request_id, name, count(*) AS calls, min(seq) AS first_seq FROM fx_events WHERE kind = 'fn.start' GROUP BY 1, 2) x) y WHERE rank <= 4""")
def _(t):
    return events.call_counts(t("fx_events"), 4)


@query("B10_retain_whole_requests", """
 WITH p AS (SELECT request_id, count(*) AS n, min(seq) AS f FROM fx_events GROUP BY 1),
 r AS (SELECT *, sum(n) OVER (ORDER BY f DESC) AS total, max(f) OVER () AS newest FROM p)
 SELECT kind, request_id, span_id, seq FROM fx_events WHERE request_id IN (SELECT request_id FROM r WHERE total <= 12000 OR f = newest)""")
def _(t):
    return events.retain_whole_requests(t("fx_events"), 12000).select("kind", "request_id", "span_id", "seq")


@query("B11_retain_last_n", "SELECT kind, request_id, seq FROM fx_events ORDER BY seq DESC, kind DESC LIMIT 12000")
def _(t):
    return events.retain_last_n(t("fx_events"), 12000).select("kind", "request_id", "seq")


@query("B12_retain_values", """
 WITH v AS (SELECT request_id, span_id, name AS field, max(seq) AS seq FROM fx_events WHERE span_id IS NOT NULL GROUP BY 1, 2, 3),
 q AS (SELECT request_id FROM v GROUP BY 1 ORDER BY max(seq) DESC LIMIT 32)
 SELECT request_id, span_id, field, seq FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC, span_id, field) AS n FROM v WHERE request_id IN (SELECT request_id FROM q)) x WHERE n <= 40""")
def _(t):
    values = t("fx_events").filter("span_id IS NOT NULL").withColumnRenamed("name", "field")
    return events.retain_values(values, 40, 32).select("request_id", "span_id", "field", "seq")


@query("B17_duration_bucket", """
 SELECT CASE WHEN value * 20 < 500 THEN 'fast' WHEN value * 20 < 2000 THEN 'med' ELSE 'slow' END AS bucket, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    return t("events").groupBy(events.duration_bucket(F.col("value") * 20).alias("bucket")).agg(F.count("*").alias("n"))


@query("B18_clean_base_url", r"""
 SELECT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u END AS base FROM (
  SELECT page_id, regexp_replace(regexp_extract(split_part(url, '#', 1), '^\s*(\S*)', 1), '/+$', '') AS u FROM pages) x""")
def _(t):
    return t("pages").select("page_id", events.clean_base_url(F.col("url")).alias("base"))


@query("B20_request_ids_since", """
 SELECT request_id, min(seq) AS first_seq FROM fx_events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND request_id <> 'system' GROUP BY 1""")
def _(t):
    return events.request_ids_since(t("fx_events"), F.lit("2024-01-15 00:00:00").cast("timestamp"))


_SPANS = """
 spans AS (SELECT request_id, span_id, max(parent_span_id) AS parent_span_id, max(name) AS name, max(CASE WHEN kind = 'fn.start' THEN ts END) AS ts, min(seq) AS seq,
  max(CASE WHEN kind <> 'fn.start' THEN duration_ms END) AS duration_ms, max(CASE WHEN kind = 'fn.start' THEN 1 ELSE 0 END) = 1 AS has_start,
  CASE WHEN max(CASE WHEN kind = 'fn.error' THEN 1 ELSE 0 END) = 1 THEN 'error' WHEN max(CASE WHEN kind = 'fn.end' THEN 1 ELSE 0 END) = 1 THEN 'ok' ELSE 'running' END AS status
  FROM fx_events WHERE kind IN ('fn.start', 'fn.end', 'fn.error') GROUP BY 1, 2)"""

_REQUESTS = """
 requests AS (SELECT request_id, max(CASE WHEN kind = 'request.start' THEN method END) AS method, max(CASE WHEN kind = 'request.start' THEN path END) AS path,
  max(CASE WHEN kind = 'request.start' THEN ts END) AS ts, min(CASE WHEN kind = 'request.start' THEN seq END) AS seq, max(CASE WHEN kind = 'request.end' THEN status END) AS status, max(CASE WHEN kind = 'request.end' THEN duration_ms END) AS duration_ms,
  sum(CASE WHEN kind = 'fn.start' THEN 1 ELSE 0 END) AS span_count, max(CASE WHEN kind = 'fn.error' THEN 1 ELSE 0 END) = 1 AS raised, max(CASE WHEN kind = 'request.end' THEN 1 ELSE 0 END) = 0 AS active
  FROM fx_events GROUP BY 1)"""

_MATCHED = """
 matched AS (SELECT * FROM (
  SELECT r.*, e.endpoint_id, row_number() OVER (PARTITION BY r.request_id ORDER BY length(regexp_replace(pattern, '[{][^}]+[}]', '', 'g')) DESC, length(pattern) - length(replace(pattern, '{', '')), ord) AS k
  FROM requests r JOIN fx_endpoints e ON r.method = e.method AND regexp_full_match(split_part(r.path, '?', 1),
   concat(regexp_replace(regexp_replace(pattern, '[{][^}]+:path[}]', '.+', 'g'), '[{][^}]+[}]', '[^/]+', 'g'), '/?'))) x WHERE k = 1)"""

_PAIRS = """
 pairs AS (SELECT request_id, parent_span_id AS ancestor, span_id AS descendant, 1 AS hops FROM fx_tree WHERE parent_span_id IS NOT NULL
  UNION ALL SELECT p.request_id, t.parent_span_id, p.descendant, p.hops + 1 FROM pairs p JOIN fx_tree t ON t.request_id = p.request_id AND t.span_id = p.ancestor WHERE t.parent_span_id IS NOT NULL)"""


@query("C1_assemble_spans", f"WITH {_SPANS} SELECT * FROM spans")
def _(t):
    return spans.assemble_spans(t("fx_events"))


@query("C2_assemble_requests", f"WITH {_REQUESTS} SELECT * FROM requests")
def _(t):
    return spans.assemble_requests(t("fx_events"))


_FULL = """
 f AS (SELECT request_id, span_id, max(CASE WHEN kind = 'fn.start' THEN name END) AS name, min(CASE WHEN kind <> 'llm.call' THEN seq END) AS seq, max(CASE WHEN kind = 'fn.start' THEN ts END) AS ts, max(duration_ms) AS duration_ms,
  CASE WHEN max(CASE WHEN kind = 'fn.error' THEN 1 ELSE 0 END) = 1 THEN 'error' WHEN max(CASE WHEN kind = 'fn.end' THEN 1 ELSE 0 END) = 1 THEN 'ok' ELSE 'running' END AS status, max(file) AS file, max(src_line) AS src_line,
  max(args) AS args, bool_or(args_truncated) AS args_truncated, max(result) AS result, bool_or(result_truncated) AS result_truncated, max(exc_type) AS exc_type, max(message) AS message, max(label) AS label, max(model) AS model
  FROM fx_events_full WHERE kind IN ('fn.start', 'fn.end', 'fn.error', 'llm.call') GROUP BY 1, 2)"""
_SHOWN = """request_id, span_id, ts, duration_ms, status, CASE WHEN length(args) > 3000 THEN concat(substr(args, 1, 3000), '…') ELSE args END AS args, CASE WHEN length(result) > 3000 THEN concat(substr(result, 1, 3000), '…') ELSE result END AS result,
  coalesce(args_truncated, false) AS args_truncated, coalesce(result_truncated, false) AS result_truncated, exc_type, message"""


@query("C1_span_parts", f"WITH {_FULL} SELECT request_id, span_id, name, status, file, src_line, args, args_truncated, result, result_truncated, exc_type, message, label, model FROM f")
def _(t):
    return spans.assemble_spans(t("fx_events_full")).select("request_id", "span_id", "name", "status", "file", "src_line", "args", "args_truncated", "result", "result_truncated", "exc_type", "message", "label", "model")


@query("C2_request_parts", """
 WITH c AS (SELECT request_id, name, count(*) AS n, min(seq) AS s FROM fx_events WHERE kind = 'fn.start' GROUP BY 1, 2),
 k AS (SELECT request_id, list_sort(list(concat(name, '=', CAST(n AS STRING)))) AS calls FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, s) AS r FROM c) x WHERE r <= 3 GROUP BY 1),
 q AS (SELECT request_id, max(route) AS route, max(handler) AS handler, bool_or(kind = 'request.start') AS started FROM fx_events_full GROUP BY 1)
 SELECT q.request_id, route, handler, calls FROM q LEFT JOIN k ON k.request_id = q.request_id WHERE started""")
def _(t):
    out = spans.assemble_requests(t("fx_events_full"), call_counts=3)
    listed = F.array_sort(F.transform(F.map_entries("call_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))))
    return out.select("request_id", "route", "handler", listed.alias("calls"))


@query("C15_search_calls", f"""
 WITH {_FULL} SELECT request_id, span_id, name, hit, hit = 1 AS is_first FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq, span_id) AS hit FROM f WHERE contains(lower(coalesce(name, '')), 'sp_1') OR contains(span_id, 'sp_1') OR contains(lower(coalesce(label, '')), 'sp_1') OR contains(coalesce(model, ''), 'sp_1')) x""")
def _(t):
    return spans.search_spans(spans.assemble_spans(t("fx_events_full")), "SP_1")


@query("C3_effective_status", f"WITH {_REQUESTS} SELECT request_id, coalesce(status, CASE WHEN raised THEN 500 ELSE 200 END) AS effective_status FROM requests")
def _(t):
    return spans.effective_status(spans.assemble_requests(t("fx_events"))).select("request_id", "effective_status")


@query("C4_link_tree", """
 SELECT t.request_id, t.span_id, p.span_id AS parent, row_number() OVER (PARTITION BY t.request_id, p.span_id ORDER BY t.seq, t.span_id) AS ordinal
 FROM fx_tree t LEFT JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id""")
def _(t):
    return spans.link_tree(t("fx_tree")).select("request_id", "span_id", "parent", "ordinal")


@query("C5_ancestor_pairs", f"WITH RECURSIVE {_PAIRS} SELECT * FROM pairs")
def _(t):
    return spans.ancestor_pairs(t("fx_tree"))


@query("C6_span_path", """
 WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY request_id, parent_span_id ORDER BY seq, span_id) AS ordinal FROM fx_tree),
 p AS (SELECT request_id, span_id, [split_part(name, ':', -1)] AS path, 0 AS depth, lpad(CAST(ordinal AS STRING), 6, '0') AS sort_key FROM o WHERE parent_span_id IS NULL
  UNION ALL SELECT o.request_id, o.span_id, list_append(p.path, split_part(o.name, ':', -1)), p.depth + 1, concat(p.sort_key, '.', lpad(CAST(o.ordinal AS STRING), 6, '0'))
  FROM p JOIN o ON o.request_id = p.request_id AND o.parent_span_id = p.span_id)
 SELECT * FROM p""")
def _(t):
    return spans.span_path(t("fx_tree"))


@query("C7_descendant_counts", f"WITH RECURSIVE {_PAIRS} SELECT request_id, ancestor AS span_id, count(*) AS descendants FROM pairs GROUP BY 1, 2")
def _(t):
    return spans.descendant_counts(t("fx_tree"))


@query("C9_selected_subtrees", f"""
 WITH RECURSIVE {_PAIRS}, s AS (SELECT request_id, span_id FROM fx_tree WHERE name IN (SELECT id FROM fx_selection))
 SELECT DISTINCT request_id, span_id FROM (SELECT * FROM s UNION ALL SELECT p.request_id, p.descendant FROM pairs p JOIN s ON s.request_id = p.request_id AND s.span_id = p.ancestor) x""")
def _(t):
    return spans.selected_subtrees(t("fx_tree"), t("fx_selection")).select("request_id", "span_id")


@query("C10_project_selection", f"""
 WITH RECURSIVE {_PAIRS}, k AS (SELECT t.request_id, t.span_id, f.deep FROM fx_tree t JOIN fx_selection f ON f.id = t.name),
 kept AS (SELECT DISTINCT request_id, span_id FROM (SELECT request_id, span_id FROM k UNION ALL SELECT p.request_id, p.descendant FROM pairs p JOIN k ON k.request_id = p.request_id AND k.span_id = p.ancestor AND k.deep) x)
 SELECT a.request_id, a.span_id, min_by(p.ancestor, p.hops) AS kept_parent, count(p.ancestor) AS kept_depth
 FROM kept a LEFT JOIN (SELECT p.* FROM pairs p JOIN kept b ON b.request_id = p.request_id AND b.span_id = p.ancestor) p ON p.request_id = a.request_id AND p.descendant = a.span_id GROUP BY 1, 2""")
def _(t):
    return spans.project_selection(t("fx_tree"), t("fx_selection"))


@query("C11_match_selection", """
 SELECT t.request_id, t.span_id, coalesce(e.id, s.id) AS matched_id, coalesce(e.id, s.id) IS NOT NULL AS is_main, coalesce(e.deep, s.deep, false) AS is_deep, t.parent_span_id IS NULL AS is_root
 FROM fx_tree t LEFT JOIN fx_selection e ON e.id = t.name LEFT JOIN (SELECT split_part(id, ':', -1) AS short, min(id) AS id, arg_min(deep, id) AS deep FROM fx_selection GROUP BY 1) s ON s.short = split_part(t.name, ':', -1)""")
def _(t):
    return spans.match_selection(t("fx_tree"), t("fx_selection")).select("request_id", "span_id", "matched_id", "is_main", "is_deep", "is_root")


_LOOPS = """
 runs AS (SELECT *, row_number() OVER (PARTITION BY request_id, parent_span_id ORDER BY seq, span_id) - row_number() OVER (PARTITION BY request_id, parent_span_id, name ORDER BY seq, span_id) AS run FROM fx_tree),
 loops AS (SELECT request_id, parent_span_id, name, run, count(*) AS n, list(span_id ORDER BY seq, span_id) AS members, sum(coalesce(duration_ms, 0)) AS total_ms, max(coalesce(duration_ms, 0)) AS max_ms, count(*) FILTER (status = 'error') AS errors
  FROM runs GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3)"""


@query("C12_fold_loops", f"WITH {_LOOPS} SELECT request_id, parent_span_id, name, concat(request_id, '|', coalesce(parent_span_id, 'root'), '|', name, '|', members[1]) AS key, members FROM loops")
def _(t):
    return spans.fold_loops(t("fx_tree"), 3).select("request_id", "parent_span_id", "name", "key", "members")


@query("C13_loop_stats", f"WITH {_LOOPS} SELECT concat(request_id, '|', coalesce(parent_span_id, 'root'), '|', name, '|', members[1]) AS key, n, CAST(total_ms AS BIGINT) AS total_ms, CAST(round(total_ms / n) AS BIGINT) AS avg_ms, max_ms, errors FROM loops")
def _(t):
    return spans.fold_loops(t("fx_tree"), 3).select("key", "n", "total_ms", "avg_ms", "max_ms", "errors")


@query("C15_search_spans", """
 SELECT request_id, span_id, name, hit, hit = 1 AS is_first FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq, span_id) AS hit FROM fx_tree WHERE contains(lower(name), 'loop') OR contains(lower(span_id), 'loop')) x""")
def _(t):
    return spans.search_spans(t("fx_tree"), "Loop")


@query("C16_time_share", f"""
 WITH {_REQUESTS}
 SELECT t.request_id, t.span_id, CASE WHEN coalesce(p.duration_ms, r.duration_ms, 0) > 0 THEN t.duration_ms / coalesce(p.duration_ms, r.duration_ms) ELSE 0 END AS share
 FROM fx_tree t LEFT JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id LEFT JOIN requests r ON r.request_id = t.request_id""")
def _(t):
    return spans.time_share(t("fx_tree"), spans.assemble_requests(t("fx_events")))


def _matched(t):  # noqa: ANN001, ANN202
    return overlay.match_endpoint(spans.assemble_requests(t("fx_events")), t("fx_endpoints"))


@query("D1_match_endpoint", f"WITH {_REQUESTS}, {_MATCHED} SELECT request_id, endpoint_id FROM matched")
def _(t):
    return _matched(t).select("request_id", "endpoint_id")


@query("D2_function_stats", f"""
 WITH {_SPANS}, {_REQUESTS}, {_MATCHED}
 SELECT endpoint_id, name, count(*) AS calls, count(DISTINCT s.request_id) AS requests, round_even(sum(coalesce(s.duration_ms, 0)) / count(*), 1) AS avg_ms, max(coalesce(s.duration_ms, 0)) AS max_ms, count(*) FILTER (s.status = 'error') AS errors
 FROM spans s JOIN matched m ON m.request_id = s.request_id GROUP BY 1, 2""")
def _(t):
    return overlay.function_stats(spans.assemble_spans(t("fx_events")), _matched(t))


@query("D3_last_call", f"""
 WITH {_FULL}, {_REQUESTS}, {_MATCHED}
 SELECT endpoint_id, name, {_SHOWN} FROM (
  SELECT m.endpoint_id, f.*, row_number() OVER (PARTITION BY endpoint_id, f.name ORDER BY f.ts DESC NULLS LAST, f.seq DESC) AS k FROM f JOIN matched m ON m.request_id = f.request_id) x WHERE k = 1""")
def _(t):
    return overlay.last_call(spans.assemble_spans(t("fx_events_full")), _matched(t))


@query("D4_confirmed_edges", f"""
 WITH RECURSIVE {_PAIRS}
 SELECT DISTINCT a.name AS caller, d.name AS callee FROM pairs p JOIN fx_tree a ON a.request_id = p.request_id AND a.span_id = p.ancestor JOIN fx_tree d ON d.request_id = p.request_id AND d.span_id = p.descendant""")
def _(t):
    return overlay.confirmed_edges(t("fx_tree"))


@query("D5_direct_callees", """
 SELECT p.name AS caller, t.name AS callee, count(*) AS calls FROM fx_tree t JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id GROUP BY 1, 2""")
def _(t):
    return overlay.direct_callees(t("fx_tree"))


@query("D6_unexpected_callees", """
 WITH d AS (SELECT p.name AS caller, t.name AS callee, count(*) AS calls FROM fx_tree t JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id GROUP BY 1, 2),
 c AS (SELECT DISTINCT p.name AS caller, t.name AS callee FROM fx_tree t JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id WHERE t.status = 'ok')
 SELECT * FROM d WHERE caller IN (SELECT caller FROM c) AND caller <> callee AND NOT EXISTS (SELECT 1 FROM c WHERE c.caller = d.caller AND c.callee = d.callee)""")
def _(t):
    tree = t("fx_tree")
    known = overlay.direct_callees(tree.withColumn("name", F.col("name"))).select("caller", "callee")
    ok = tree.filter("status = 'ok'").select("request_id", "parent_span_id", F.col("name").alias("callee"))
    closure = ok.join(tree.select("request_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("caller")), ["request_id", "parent_span_id"]).select("caller", "callee").distinct()
    return overlay.unexpected_callees(overlay.direct_callees(tree), closure.join(known, ["caller", "callee"], "left_semi"))


@query("D7_recent_requests", f"""
 WITH {_REQUESTS}, {_MATCHED}
 SELECT endpoint_id, request_id, span_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY ts DESC NULLS LAST, request_id) AS rank FROM (SELECT * EXCLUDE (k) FROM matched) m) x WHERE rank <= 20""")
def _(t):
    return overlay.recent_requests(_matched(t), 20).select("endpoint_id", "request_id", "span_count", "rank")


@query("D8_endpoint_overlay", f"""
 WITH RECURSIVE {_PAIRS}, {_FULL}, {_REQUESTS}, {_MATCHED},
 own AS (SELECT m.endpoint_id, f.* FROM f JOIN matched m ON m.request_id = f.request_id),
 st AS (SELECT endpoint_id, name, concat_ws('|', name, count(*), count(DISTINCT request_id), CAST(max(coalesce(duration_ms, 0)) AS STRING), count(*) FILTER (status = 'error')) AS line FROM own GROUP BY 1, 2),
 lc AS (SELECT endpoint_id, name, concat_ws('|', request_id, span_id, coalesce(exc_type, '-'), length(coalesce(args, ''))) AS line FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id, name ORDER BY ts DESC NULLS LAST, seq DESC) AS k FROM (SELECT * REPLACE (CASE WHEN length(args) > 3000 THEN concat(substr(args, 1, 3000), '…') ELSE args END AS args) FROM own) y) x WHERE k = 1),
 fu AS (SELECT endpoint_id, list_sort(list(concat(st.line, '|', lc.line))) AS functions, list_sort(list(name) FILTER (name IN (SELECT id FROM fx_selection))) AS armed FROM st JOIN lc USING (endpoint_id, name) GROUP BY 1),
 co AS (SELECT endpoint_id, list_sort(list(DISTINCT concat(a.name, '>', d.name))) AS confirmed FROM pairs p JOIN matched m ON m.request_id = p.request_id JOIN fx_tree a ON a.request_id = p.request_id AND a.span_id = p.ancestor JOIN fx_tree d ON d.request_id = p.request_id AND d.span_id = p.descendant GROUP BY 1),
 re AS (SELECT endpoint_id, list(request_id ORDER BY ts DESC NULLS LAST, request_id) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY ts DESC NULLS LAST, request_id) AS r FROM (SELECT * EXCLUDE (k) FROM matched) m) x WHERE r <= 20 GROUP BY 1),
 cl AS (SELECT DISTINCT caller, callee FROM fx_static_edges UNION SELECT c.caller, e.callee FROM cl c JOIN fx_static_edges e ON e.caller = c.callee),
 di AS (SELECT m.endpoint_id, p.name AS caller, t.name AS callee, count(*) AS calls FROM fx_tree t JOIN fx_tree p ON p.request_id = t.request_id AND p.span_id = t.parent_span_id JOIN matched m ON m.request_id = t.request_id GROUP BY 1, 2, 3),
 ex AS (SELECT endpoint_id, list(concat(caller, '>', callee, '=', calls) ORDER BY calls DESC, caller, callee) AS extras FROM di WHERE caller <> callee AND caller IN (SELECT caller FROM cl) AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.caller = di.caller AND cl.callee = di.callee) GROUP BY 1)
 SELECT m.endpoint_id, count(*) AS request_count, (SELECT count(*) FROM own o WHERE o.endpoint_id = m.endpoint_id) AS span_count, any_value(functions) AS functions, any_value(armed) AS armed, any_value(confirmed) AS confirmed, any_value(recent) AS recent, any_value(extras) AS extras
 FROM matched m LEFT JOIN fu USING (endpoint_id) LEFT JOIN co USING (endpoint_id) LEFT JOIN re USING (endpoint_id) LEFT JOIN ex USING (endpoint_id) GROUP BY 1""")
def _(t):
    static = t("fx_static_edges")
    closure = graph.reach(static, static.select(F.col("caller").alias("root")).distinct()).filter("root <> function").select(F.col("root").alias("caller"), F.col("function").alias("callee"))
    out = overlay.endpoint_overlay(spans.assemble_spans(t("fx_events_full")), _matched(t), t("fx_selection"), closure)
    text = lambda *c: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("-")) for x in c])
    line = lambda e: text(e["key"], e["value"]["calls"], e["value"]["requests"], e["value"]["max_ms"], e["value"]["errors"], e["value"]["last"]["request_id"], e["value"]["last"]["span_id"], e["value"]["last"]["exc_type"], F.length(F.coalesce(e["value"]["last"]["args"], F.lit(""))))
    functions = F.array_sort(F.transform(F.map_entries("functions"), line))
    extras = F.transform("extras", lambda x: F.concat(x["caller"], F.lit(">"), x["callee"], F.lit("="), x["calls"].cast("string")))
    return out.select("endpoint_id", "request_count", "span_count", functions.alias("functions"), "armed", "confirmed", "recent", extras.alias("extras"))


@query("D9_last_io", f"WITH {_FULL} SELECT name, {_SHOWN} FROM f WHERE name = 'svc.error:run' ORDER BY ts DESC, seq DESC LIMIT 1")
def _(t):
    return overlay.last_io(spans.assemble_spans(t("fx_events_full")), "svc.error:run")


_CALLS = "SELECT concat('l', CAST(conv_id % 4 AS STRING)) AS label, model, CASE WHEN role = 'user' THEN tokens END AS tokens_in, CASE WHEN role <> 'user' THEN tokens END AS tokens_out, length(text) % 1000 AS duration_ms FROM fx_llm"


@query("D10_llm_usage", f"""
 SELECT label, model, count(*) AS calls, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM ({_CALLS}) c GROUP BY 1, 2""")
def _(t):
    return overlay.llm_usage(t.sql(_CALLS))


@query("D10_transcripts", "SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM fx_llm GROUP BY 1")
def _(t):
    out = overlay.transcripts(t("fx_llm"))
    return out.select("conv_id", "n_turns", F.col("transcript.role").alias("roles"), F.aggregate("transcript", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("n_chars"))
