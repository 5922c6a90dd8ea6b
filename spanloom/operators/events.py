"""Event normalisation: projections, filters, caps and retention over the flat event log.

Events are rows (kind, request_id, span_id, parent_span_id, seq, ts, method,
path, name, duration_ms, status, ...); arrival order is (seq, kind).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import running_sum

#: Fixed value: names of keys whose values are secrets.
SECRET_KEYS = r"(?i)(pass|pwd|secret|token|api[_-]?key|apikey|authorization|bearer|cookie|credential)"
REDACTED = "«redacted»"


def dedup_events(ev: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """One row per (request, span, kind, seq), nulls as '', the first by `tie`; rows without a seq are all kept."""
    key = [F.coalesce(c, F.lit("")) for c in ("request_id", "span_id", "kind")]
    first = F.row_number().over(W.partitionBy(*key, "seq").orderBy(*(tie or ("ts",))))
    numbered = ev.filter("seq IS NOT NULL").withColumn("_n", first).filter("_n = 1").drop("_n")
    return numbered.unionByName(ev.filter("seq IS NULL"))


def filter_events(ev: DataFrame, limit: int = 50, name: str | None = None, request_id: str | None = None, kind: str | None = None) -> DataFrame:
    """The newest `limit` (1 to 500) matching events; name matches as a case-insensitive substring."""
    out = ev
    if request_id:
        out = out.filter(F.col("request_id") == request_id)
    if kind:
        out = out.filter(F.col("kind") == kind)
    if name:
        out = out.filter(F.instr(F.lower("name"), name.lower()) > 0)
    return out.orderBy(F.desc("seq"), F.desc("kind")).limit(min(500, max(1, limit))).orderBy("seq", "kind")


def search_events(ev: DataFrame, query: str, columns: Sequence[str] = ("request_id", "span_id", "kind", "name", "path")) -> DataFrame:
    """Events with the text in any of the columns, regardless of case; a blank text finds all."""
    needle = query.strip().lower()
    if not needle:
        return ev
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)), F.lit(False))
    return ev.filter(hit)


def redact_map(values: Column) -> Column:
    """Map values under secret keys replaced."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit(REDACTED)).otherwise(v))


def shorten(text: Column, most: int = 2000) -> Column:
    """Texts over `most` characters cut, with a note of how many are gone."""
    n = F.length(text)
    return F.when(n > most, F.concat(F.substring(text, 1, most), F.lit("…(+"), (n - most).cast("string"), F.lit(" chars)"))).otherwise(text)


def preview(text: Column, most: int = 600) -> Column:
    """struct(text, truncated): at most `most` characters, an ellipsis after a cut."""
    long = F.length(text) > most
    return F.struct(F.when(long, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text).alias("text"), F.coalesce(long, F.lit(False)).alias("truncated"))


def capture_cap(ev: DataFrame, most: int = 50, values: Sequence[str] = ()) -> DataFrame:
    """fn.start rows with n, their number among the function's calls in the request, and captured; values past the cap are nulled."""
    n = F.row_number().over(W.partitionBy("request_id", "name").orderBy("seq", "span_id"))
    out = ev.filter("kind = 'fn.start'").withColumn("n", n).withColumn("captured", F.col("n") <= most)
    return out.withColumns({c: F.when(F.col("captured"), F.col(c)) for c in values})


def span_cap(ev: DataFrame, most: int = 5000) -> DataFrame:
    """The first `most` fn.start of each request with their ends, all other kinds, and one warn log row for each request over it."""
    is_start = F.col("kind") == "fn.start"
    n = F.row_number().over(W.partitionBy("request_id", is_start).orderBy("seq", "span_id"))
    numbered = ev.withColumn("_n", F.when(is_start, n))
    start = F.max(F.col("_n")).over(W.partitionBy("request_id", "span_id"))
    is_fn = F.col("kind").isin("fn.start", "fn.end", "fn.error")
    marked = numbered.withColumn("_start", F.when(is_fn, start))
    kept = marked.filter(~F.coalesce(is_fn & (F.col("_start") > most), F.lit(False))).select(*ev.columns)
    over = ev.filter(is_start).groupBy("request_id").agg(F.count("*").alias("_spans"), F.max("ts").alias("ts")).filter(F.col("_spans") > most)
    note = over.select("request_id", "ts", F.lit("log").alias("kind"), F.concat(F.lit("span cap reached: "), F.col("_spans").cast("string")).alias("name"))
    return kept.unionByName(note, allowMissingColumns=True).select(*ev.columns)


def call_counts(ev: DataFrame, top: int = 200) -> DataFrame:
    """(request_id, name, calls, rank): calls of each function in a request before any cap; its most called `top`, first seen first."""
    calls = ev.filter("kind = 'fn.start'").groupBy("request_id", "name").agg(F.count("*").alias("calls"), F.min("seq").alias("first_seq"))
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("calls"), "first_seq"))
    return calls.withColumn("rank", rank).filter(F.col("rank") <= top).select("request_id", "name", "calls", "rank")


def call_count_map(ev: DataFrame, top: int = 200) -> DataFrame:
    """(request_id, call_counts map)."""
    pairs = F.collect_list(F.struct("name", "calls"))
    return call_counts(ev, top).groupBy("request_id").agg(F.map_from_entries(pairs).alias("call_counts"))


def retain_whole_requests(ev: DataFrame, tail: int = 12000) -> DataFrame:
    """Events of the newest whole requests whose running total stays within `tail`; the newest stays even if larger."""
    per = ev.filter("request_id IS NOT NULL").groupBy("request_id").agg(F.count("*").alias("_events"), F.min("seq").alias("_first"))
    total = running_sum(per, "_events", "_first", "_total")
    newest = per.agg(F.max("_first").alias("_newest"))
    kept = total.crossJoin(F.broadcast(newest)).filter((F.col("_total") <= tail) | (F.col("_first") == F.col("_newest")))  # one row
    return ev.join(kept.select("request_id"), "request_id", "left_semi")


def retain_last_n(ev: DataFrame, n: int = 12000) -> DataFrame:
    return ev.orderBy(F.desc("seq"), F.desc("kind")).limit(n)


def retain_values(values: DataFrame, per_request: int = 400, requests: int = 32) -> DataFrame:
    """(request_id, span_id, field, seq): the newest `per_request` values of each of the newest `requests` requests; a re-set value moves up."""
    last = values.groupBy("request_id", "span_id", "field").agg(F.max("seq").alias("seq"))
    newest = last.groupBy("request_id").agg(F.max("seq").alias("_last")).orderBy(F.desc("_last")).limit(requests).select("request_id")
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("seq"), "span_id", "field"))
    return last.join(newest, "request_id", "left_semi").withColumn("_n", rank).filter(F.col("_n") <= per_request).drop("_n")


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 500, "fast").when(ms < 2000, "med").otherwise("slow")


def clean_base_url(url: Column) -> Column:
    """Up to '#' and then the first white space, no slash at the end; null unless http or https."""
    cut = F.regexp_extract(F.substring_index(url, "#", 1), r"^\s*(\S*)", 1)
    bare = F.regexp_replace(cut, "/+$", "")
    return F.when(bare.rlike("^https?://"), bare)


def request_ids_since(ev: DataFrame, since: Column) -> DataFrame:
    """(request_id, first_seq) of requests with an event at or after `since`, in order of arrival; 'system' is none."""
    recent = ev.filter((F.col("ts") >= since) & F.col("request_id").isNotNull() & (F.col("request_id") != "system"))
    return recent.groupBy("request_id").agg(F.min("seq").alias("first_seq")).orderBy("first_seq")
