"""Structured Streaming forms of the event operators.

Stateful operators run on `transformWithState` (RocksDB state): value states for
what is known of a request and for its waiting spans or its functions, each read
and written once a micro-batch, and one event-time timer a key. Rows come as such,
as a frame for each key costs far more than its rows. State is bounded by its key
and goes with the timer: a request is settled when the watermark has passed its last event by `late_ms` once
its end was seen, or by `keep_ms` without one. Events may come in any order and
over any number of micro-batches until then. Sinks are written per micro-batch
under the batch's number, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.tables import shared_dir


def _stateful(stream: DataFrame, key: str, columns: Sequence[str], processor: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    """stream, keyed and timed by `ts`, through a processor, as rows (key, *columns, ts, at): `at` is ts in microseconds, as are all its times.

    Timers need the RocksDB provider, set here for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.withWatermark("ts", watermark).select(key, *columns, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = rows.groupBy(key).transformWithState(processor, schema.replace("timestamp", "long"), "Append", "EventTime")
    return out.select(*[F.timestamp_micros(c).alias(c) if kind == "timestamp" else c for c, kind in (x.strip().split(" ") for x in schema.split(","))])


def _rows(found: Iterable[tuple], schema: str) -> list[Row]:
    named = Row(*[c.strip().split(" ")[0] for c in schema.split(",")])
    return [named(*x) for x in found]


class Settled(StatefulProcessor):
    """State that one timer a key ends: `take` rows as they come, `settle` what is left when the timer fires."""

    def __init__(self, late_ms: int, keep_ms: int) -> None:
        self.late_ms, self.keep_ms = late_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest long, over boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, over, due = self.clock.get() or (0, False, None)

        def noted() -> Iterator[Row]:
            nonlocal newest, over
            for row in rows:
                newest = max(newest, (row[-1] or 0) // 1000)
                over = over or row[1] == "request.end"  # kind is the first column, where there is one
                yield row

        yield from self.take(key, noted())
        now = max(newest + (self.late_ms if over else self.keep_ms), timerValues.getCurrentWatermarkInMs() + 1)
        if now != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now)
        self.clock.update((newest, over, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.settle(key)
        self.clock.clear()

    def close(self) -> None:
        pass


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """Events from a growing folder of Parquet files: what is there is replayed, then what comes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> object:
    """One query that writes each sink's view of a micro-batch under path/<sink>/batch=<number>, replacing that folder if it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, view in sinks.items():
            view(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all input that is there now: each micro-batch's rows, with its number."""
    import uuid

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema]).add("batch", "long")
    return spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out/*")


def stream_dedup(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The first of each (request, span, kind, seq) inside the watermark, whose keys then leave the state, and all rows without a seq.

    The two kinds of rows are branches of one query, whose watermark is that of the slower one.
    """
    keyed = stream.filter("seq IS NOT NULL").withWatermark("ts", watermark)
    return keyed.dropDuplicatesWithinWatermark(["request_id", "span_id", "kind", "seq"]).unionByName(stream.filter("seq IS NULL").withWatermark("ts", watermark))


SPANS = "request_id string, span_id string, parent_span_id string, name string, ts timestamp, seq long, duration_ms long, has_start boolean, status string"


class _Spans(Settled):
    """Starts and ends that wait for each other, by span."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        started, ended = "span: string, parent: string, name: string, ts: long, seq: long", "span: string, parent: string, name: string, kind: string, duration_ms: long, seq: long"
        self.waiting = handle.getValueState("waiting", f"started array<struct<{started}>>, ended array<struct<{ended}>>")

    @staticmethod
    def _row(request: str, span: str, start: tuple | None, end: tuple | None) -> tuple:
        parent, name, ts, seq = start or (None, None, None, None)
        end_parent, end_name, kind, duration, end_seq = end or (None, None, None, None, None)
        status = "running" if end is None else "error" if kind == "fn.error" else "ok"
        return request, span, parent or end_parent, name or end_name, ts, min((x for x in (seq, end_seq) if x is not None), default=None), duration, start is not None, status

    def take(self, key: tuple, rows: Iterator[Row]) -> list[Row]:
        starts, ends = {}, {}
        for _, kind, span, parent, name, duration, seq, _, at in rows:
            if span is not None and kind == "fn.start":
                starts[span] = (parent, name, at, seq)
            elif span is not None and kind in ("fn.end", "fn.error"):
                ends[span] = (parent, name, kind, duration, seq)
        if not (starts or ends):
            return []
        started, ended = ({x[0]: tuple(x[1:]) for x in some} for some in self.waiting.get() or ((), ()))
        out = []
        for span, end in ends.items():
            start = starts.pop(span, None) or started.pop(span, None)
            if start is None:
                ended[span] = end
            else:
                out.append(self._row(key[0], span, start, end))
        for span, start in starts.items():
            if span in ended:
                out.append(self._row(key[0], span, start, ended.pop(span)))
            else:
                started[span] = start
        self.waiting.update(([(k, *v) for k, v in started.items()], [(k, *v) for k, v in ended.items()]))
        return _rows(out, SPANS)

    def settle(self, key: tuple) -> list[Row]:
        started, ended = self.waiting.get() or ((), ())
        self.waiting.clear()
        return _rows([self._row(key[0], x[0], tuple(x[1:]), None) for x in started] + [self._row(key[0], x[0], None, tuple(x[1:])) for x in ended], SPANS)


def stream_spans(stream: DataFrame, watermark: str = "10 minutes", late_ms: int = 0, keep_ms: int = 600_000) -> DataFrame:
    """One row per span, as assemble_spans: when both its start and end are there, whichever comes first, in whatever micro-batch.

    Starts without an end come as running, and ends without a start with has_start false, when their request is settled.
    """
    columns = ("kind", "span_id", "parent_span_id", "name", "duration_ms", "seq")
    return _stateful(stream, "request_id", columns, _Spans(late_ms, keep_ms), SPANS, watermark)


REQUESTS = "request_id string, method string, path string, ts timestamp, seq long, status int, duration_ms long, span_count long, raised boolean, active boolean"


class _Requests(Settled):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getValueState("known", "started boolean, method string, path string, ts long, seq long, ended boolean, status int, duration_ms long, spans long, raised boolean")

    def take(self, key: tuple, rows: Iterator[Row]) -> list[Row]:
        known = self.known.get() or (False, None, None, None, None, False, None, None, 0, False)
        start, end, (spans, raised) = None, None, known[8:]
        for _, kind, method, path, seq, status, duration, _, at in rows:
            if kind == "request.start":
                start = start or (True, method, path, at, seq)
            elif kind == "request.end":
                end = end or (True, status, duration)
            spans, raised = spans + (kind == "fn.start"), raised or kind == "fn.error"
        self.known.update((*(start or known[:5]), *(end or known[5:8]), spans, raised))
        return []

    def settle(self, key: tuple) -> list[Row]:
        started, method, path, ts, seq, ended, status, duration, spans, raised = self.known.get()
        self.known.clear()
        return _rows([(key[0], method, path, ts, seq, status, duration, spans, raised, not ended)] if started else [], REQUESTS)


def stream_requests(stream: DataFrame, watermark: str = "10 minutes", late_ms: int = 0, keep_ms: int = 600_000) -> DataFrame:
    """One row per request, as assemble_requests, when it is settled: with an end as done, without one as active."""
    return _stateful(stream, "request_id", ("kind", "method", "path", "seq", "status", "duration_ms"), _Requests(late_ms, keep_ms), REQUESTS, watermark)


def stream_overlay(spans: DataFrame) -> DataFrame:
    """Calls, errors and total time of each function so far; use update mode and keep the last row of each name."""
    ms = F.coalesce("duration_ms", F.lit(0))
    return spans.filter("kind IN ('fn.end', 'fn.error')").groupBy("name").agg(F.count("*").alias("calls"), F.count(F.when(F.col("kind") == "fn.error", 1)).alias("errors"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"))


CAPS = "request_id string, span_id string, name string, seq long, n long, captured boolean"


class _Caps(Settled):
    def __init__(self, captures: int, spans: int, late_ms: int, keep_ms: int) -> None:
        super().__init__(late_ms, keep_ms)
        self.captures, self.spans = captures, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getValueState("counts", "total long, calls map<string, long>")

    def take(self, key: tuple, rows: Iterator[Row]) -> list[Row]:
        starts = sorted(((seq is None, seq or 0, seq, span, name) for _, kind, span, name, seq, _, _ in rows if kind == "fn.start"), key=lambda x: x[:2])
        before, calls = self.counts.get() or (0, {})
        calls, out = dict(calls), []
        for _, _, seq, span, name in starts:
            calls[name or ""] = n = calls.get(name or "", 0) + 1  # counted past the caps too
            out.append((key[0], span, name, seq, n, n <= self.captures))
        self.counts.update((before + len(starts), calls))
        return _rows(out[: max(0, self.spans - before)], CAPS)

    def settle(self, key: tuple) -> list[Row]:
        self.counts.clear()
        return []


def stream_caps(stream: DataFrame, captures: int = 50, spans: int = 5000, watermark: str = "10 minutes", late_ms: int = 0, keep_ms: int = 600_000) -> DataFrame:
    """The first `spans` starts of each request, with the number of the call of its function and whether its values are kept.

    Calls are numbered as they come, in order of seq inside a micro-batch.
    """
    return _stateful(stream, "request_id", ("kind", "span_id", "name", "seq"), _Caps(captures, spans, late_ms, keep_ms), CAPS, watermark)


LIVE = "target string, last_seen timestamp, started_at long, restarts long, handshakes long, connected boolean"


class _Live(Settled):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "last_seen long, started_at long, restarts long, handshakes long")

    def take(self, key: tuple, rows: Iterator[Row]) -> list[Row]:
        last, began, restarts, handshakes = self.seen.get() or (None, None, 0, 0)
        new = sorted(((at, began is None, began or 0) for _, began, _, at in rows))
        marks = [began] * (handshakes > 0) + [None if none else mark for _, none, mark in new]
        restarts += sum(a is not None and a != b for a, b in zip(marks, marks[1:]))
        last, began, handshakes = max(x for x in (last, new[-1][0]) if x is not None), marks[-1], handshakes + len(new)
        self.seen.update((last, began, restarts, handshakes))
        return _rows([(key[0], last, began, restarts, handshakes, True)], LIVE)

    def settle(self, key: tuple) -> list[Row]:
        return _rows([(key[0], *self.seen.get(), False)], LIVE)  # kept: a later handshake may be a restart


def stream_liveness(registers: DataFrame, gone_after_s: int = 90, watermark: str = "0 seconds") -> DataFrame:
    """A row per target of registers (target, ts, started_at) after each micro-batch that names it, and one when it is gone.

    It is gone when the watermark passes its last handshake by gone_after_s. The newest row of a target is its state.
    """
    return _stateful(registers, "target", ("started_at",), _Live(gone_after_s * 1000, gone_after_s * 1000), LIVE, watermark)


def upsert(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str, mode: str = "update") -> object:
    """One query that keeps a table of the newest row of each key under path/v=<batch>: the version before, with the batch's rows over it.

    A batch that is repeated makes its version anew from the same one before, so it changes nothing. Versions older than that are
    removed. Rows are dealt by key; inside a batch, a key must stand once (as in update mode).
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        have = [v for v in versions(spark, path) if v < number]
        rows = batch.withColumn("_new", F.lit(True))
        if have:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={have[-1]}").withColumn("_new", F.lit(False)))
        first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))
        rows.withColumn("_n", first).filter("_n = 1").drop("_n", "_new").write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in have[:-1]:
            _delete(spark, f"{path}/v={old}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    store, at = _folder(spark, path)
    store.delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table that `upsert` keeps, in order."""
    store, at = _folder(spark, path)
    if not store.exists(at):
        return []
    found = [x.getPath() for x in store.listStatus(at) if x.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a table that `upsert` keeps."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def count_ingest(stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame], DataFrame] = lambda b: b) -> object:
    """Write each micro-batch of JSON batches through `sink` under path/events, and what was observed on the way under path/counters.

    (events_in, dropped, registers) of a batch are counted while it is written, not in a pass of their own.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        n = F.coalesce(F.sum(F.when(F.col("events").isNotNull(), F.size("events"))), F.lit(0)).cast("long")
        dropped = F.coalesce(F.sum("dropped"), F.lit(0)).cast("long")
        observed = batch.observe(seen, n.alias("events_in"), dropped.alias("dropped"), F.count_if(F.col("kind") == "register").alias("registers"))
        sink(observed).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        got = seen.get
        row = [(got["events_in"], got["dropped"], got["registers"])]
        spark.createDataFrame(row, "events_in long, dropped long, registers long").coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def liveness(registers: DataFrame, now: object, gone_after_s: int = 90) -> DataFrame:
    """Per target of registers (target, ts, started_at): latest handshake, restarts seen, and whether it counts as connected at `now`."""
    before = F.lag("started_at").over(W.partitionBy("target").orderBy("ts", "started_at"))
    marked = registers.withColumn("_restart", before.isNotNull() & ~before.eqNullSafe(F.col("started_at")))
    per = marked.groupBy("target").agg(F.max("ts").alias("last_seen"), F.count_if("_restart").alias("restarts"), F.count("*").alias("handshakes"))
    return per.withColumn("connected", F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("last_seen").cast("timestamp")) <= gone_after_s)
