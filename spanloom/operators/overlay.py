"""Runtime overlay: what ran under each endpoint, from assembled spans and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import durable
from . import paths
from .events import preview
from .spans import folded_pairs, interval_labels


def _pattern_regex(pattern: Column) -> Column:
    """A whole-path regular expression: literal parts quoted, {x} one segment, {x:path} any rest, optional slash at the end."""
    quoted = F.regexp_replace(pattern, r"([.+*?^$()\[\]|\\])", r"\\$1")
    rest = F.regexp_replace(quoted, r"\{[^}]+:path\}", ".+")
    return F.concat(F.lit("^"), F.regexp_replace(rest, r"\{[^}]+\}", "[^/]+"), F.lit("/?$"))


def _pattern_keys(pattern: Column) -> Column:
    """Trie keys of a pattern: literal segments, ANY for one with a parameter in it, REST from {x:path} on."""
    parts = F.split(F.regexp_replace(pattern, "/$", ""), "/")
    first = F.array_position(F.transform(parts, lambda s: s.rlike(r"\{[^}]+:path\}")), True)
    cut = F.when(first > 0, F.slice(parts, F.lit(1), first.cast("int"))).otherwise(parts)
    return F.transform(cut, lambda s: F.when(s.rlike(r"\{[^}]+:path\}"), F.lit(paths.REST)).when(F.contains(s, F.lit("{")), F.lit(paths.ANY)).otherwise(s))


def match_endpoint(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """requests with endpoint_id: most literal characters win, then fewer parameters, then listing order; no match drops the row.

    Distinct (method, path) walk a trie of the patterns, a segment a join, with the method as its first level; the few patterns
    at whose nodes they end are compared as a whole.
    """
    cut = F.substring_index(F.col("path"), "?", 1)
    e = endpoints.select(F.col("endpoint_id").alias("_id"), F.upper("method").alias("_method"), "pattern", F.col("ord").alias("_ord"))
    e = e.withColumns({"_rx": _pattern_regex(F.col("pattern")), "_literal": F.length(F.regexp_replace("pattern", r"\{[^}]+\}", "")), "_params": F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit("{"), F.lit("")))})
    e = durable(e.withColumn("_keys", F.concat(F.array("_method"), _pattern_keys(F.col("pattern")))).withColumn("end", paths.ends(F.col("_keys"))))
    edges, deepest = paths.trie(e, "_keys")
    asked = requests.select(F.upper("method").alias("_method"), cut.alias("_path")).distinct().dropna()
    asked = asked.withColumn("_segs", F.concat(F.array("_method"), F.split(F.regexp_replace("_path", "/$", ""), "/")))
    hits = paths.walk(asked, "_segs", edges, deepest).drop("_segs").join(e.drop("_method", "_keys"), "end").filter("_path RLIKE _rx")
    best = hits.groupBy("_method", "_path").agg(F.max_by("_id", F.struct("_literal", -F.col("_params"), -F.col("_ord"))).alias("endpoint_id"))
    joined = requests.withColumns({"_method": F.upper("method"), "_path": cut}).join(best, ["_method", "_path"])
    return joined.drop("_method", "_path")


def function_stats(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """Per endpoint and function: calls, requests, avg_ms, max_ms, errors. `requests` carry endpoint_id; running calls count 0 ms."""
    ms = F.coalesce("duration_ms", F.lit(0))
    joined = spans.filter("name IS NOT NULL").join(requests.select("request_id", "endpoint_id"), "request_id")
    per_request = joined.groupBy("endpoint_id", "name", "request_id").agg(F.count("*").alias("calls"), F.sum(ms).alias("total"), F.max(ms).alias("most"), F.count(F.when(F.col("status") == "error", 1)).alias("bad"))
    out = per_request.groupBy("endpoint_id", "name").agg(F.sum("calls").alias("calls"), F.count("*").alias("requests"), F.sum("total").alias("_total"), F.max("most").alias("max_ms"), F.sum("bad").alias("errors"))
    return out.select("endpoint_id", "name", "calls", "requests", F.bround(F.col("_total") / F.col("calls"), 1).alias("avg_ms"), "max_ms", "errors")


#: Characters that an overlay shows of an argument or a result.
CLIP = 3000


def _call_parts(spans: DataFrame) -> list[Column]:
    """What is shown of a call: its values clipped, its flags and its error, where spans have them."""
    out = [F.col(c) for c in ("request_id", "span_id", "ts", "duration_ms", "status")]
    for c in ("args", "result"):
        if c in spans.columns:
            text = F.col(c) if spans.schema[c].dataType.simpleString() == "string" else F.to_json(c)
            out.append(preview(text, CLIP)["text"].alias(c))
    return out + [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("args_truncated", "result_truncated") if c in spans.columns] + [F.col(c) for c in ("exc_type", "message") if c in spans.columns]


def _newest() -> Column:
    """Order of spans by start time (none counts as the oldest), then arrival."""
    return F.struct(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)), "seq")


def last_call(spans: DataFrame, requests: DataFrame) -> DataFrame:
    """Per endpoint and function, its newest span: by start time (none counts as the oldest), then arrival, with values, flags and error."""
    joined = spans.filter("name IS NOT NULL").join(requests.select("request_id", "endpoint_id"), "request_id")
    last = F.max_by(F.struct(*_call_parts(spans)), _newest())
    return joined.groupBy("endpoint_id", "name").agg(last.alias("l")).select("endpoint_id", "name", "l.*")


def confirmed_edges(spans: DataFrame) -> DataFrame:
    """(caller, callee): distinct function names of which one ran above the other, from the different paths of names that occurred."""
    return folded_pairs(interval_labels(spans).select("fold", "up", "name"))


def direct_callees(spans: DataFrame) -> DataFrame:
    """(caller, callee, calls) from direct parents."""
    parents = spans.select("request_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("caller"))
    return spans.join(parents, ["request_id", "parent_span_id"]).filter("caller IS NOT NULL AND name IS NOT NULL").groupBy("caller", F.col("name").alias("callee")).agg(F.count("*").alias("calls"))


def unexpected_callees(direct: DataFrame, closure: DataFrame) -> DataFrame:
    """Observed direct callees that the static closure (caller, callee) of a known caller lacks, itself apart."""
    known = direct.join(closure.select("caller").distinct(), "caller", "left_semi").filter("caller <> callee")
    return known.join(closure, ["caller", "callee"], "left_anti")


def recent_requests(requests: DataFrame, n: int = 20) -> DataFrame:
    """The newest n requests of each endpoint, with their rank."""
    rank = F.row_number().over(W.partitionBy("endpoint_id").orderBy(F.desc_nulls_last("ts"), "request_id"))
    return requests.withColumn("rank", rank).filter(F.col("rank") <= n)


def endpoint_overlay(spans: DataFrame, requests: DataFrame, armed: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """One row per endpoint: request_count, span_count, functions (map, with each one's last call), confirmed edges
    (``caller>callee`` of functions of which one ran above the other), the newest 20 requests, the armed functions and, given the
    static closure (caller, callee), extras: observed direct callees that it lacks, with calls, most called first.

    The collections are bounded by the functions of an endpoint, not by its calls.
    """
    spans, requests = durable(spans), durable(requests)  # each is read by all the parts below
    of = requests.select("request_id", "endpoint_id")
    per = requests.groupBy("endpoint_id").agg(F.count("*").alias("request_count"))
    joined = spans.join(of, "request_id")
    counts = joined.groupBy("endpoint_id").agg(F.count("*").alias("span_count"))
    stats = function_stats(spans, requests).join(armed.select(F.col("id").alias("name"), F.col("deep").alias("armed_deep")), "name", "left")
    calls = last_call(spans, requests)
    last = calls.select("endpoint_id", "name", F.struct(*[c for c in calls.columns if c not in ("endpoint_id", "name")]).alias("last"))
    stats = stats.join(last, ["endpoint_id", "name"], "left")
    folded = interval_labels(spans).join(of, "request_id").select("endpoint_id", "fold", "up", "name")
    edges = folded_pairs(folded, ("endpoint_id",)).select("endpoint_id", F.concat("caller", F.lit(">"), "callee").alias("edge"))
    edges = edges.groupBy("endpoint_id").agg(F.array_sort(F.collect_list("edge")).alias("confirmed"))
    recent = recent_requests(requests).groupBy("endpoint_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "request_id"))), lambda x: x["request_id"]).alias("recent"))
    functions = stats.groupBy("endpoint_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("calls", "requests", "avg_ms", "max_ms", "errors", "last")))).alias("functions"), F.array_sort(F.collect_list(F.when(F.col("armed_deep").isNotNull(), F.col("name")))).alias("armed"))
    out = per.join(counts, "endpoint_id", "left").join(functions, "endpoint_id", "left").join(edges, "endpoint_id", "left").join(recent, "endpoint_id", "left")
    if closure is not None:
        parents = joined.select("endpoint_id", "request_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("caller"))
        direct = joined.join(parents, ["endpoint_id", "request_id", "parent_span_id"]).filter("caller IS NOT NULL AND name IS NOT NULL").groupBy("endpoint_id", "caller", F.col("name").alias("callee")).agg(F.count("*").alias("calls"))
        more = unexpected_callees(direct, closure)
        listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("order"), "caller", "callee", "calls"))), lambda x: x.dropFields("order"))
        out = out.join(more.groupBy("endpoint_id").agg(listed.alias("extras")), "endpoint_id", "left")
    return out.fillna(0, ["span_count"])


def last_io(spans: DataFrame, name: str) -> DataFrame:
    """The newest call of a function, in one row: args, result, error and flags, clipped."""
    newest = spans.filter(F.col("name") == name).groupBy("name").agg(F.max_by(F.struct(*_call_parts(spans)), _newest()).alias("l"))
    return newest.select("name", "l.*")


def llm_usage(calls: DataFrame) -> DataFrame:
    """Per label and model of model calls (label, model, tokens_in, tokens_out, duration_ms): calls and what they add up to; nulls count 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "duration_ms")]
    return calls.groupBy("label", "model").agg(F.count("*").alias("calls"), *sums)


def transcripts(calls: DataFrame) -> DataFrame:
    """(conv_id, n_turns, transcript): the turns in order, as an array bounded by the conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return calls.groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("transcript"))
