"""Streams: state that leaves, late ends, repeated batches, all orders of arrival."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from spanloom.operators import spans
from spanloom.streaming import streams

SCHEMA = "kind string, request_id string, span_id string, parent_span_id string, seq long, ts timestamp, method string, path string, name string, duration_ms long, status int"
T0 = datetime(2024, 1, 1)


def event(kind, request, span=None, seq=0, at=0, parent=None, name=None, duration=None, status=None):
    first = kind == "request.start"
    return (kind, request, span, parent, seq, T0 + timedelta(minutes=at), "GET" if first else None, "/x" if first else None, name, duration, status)


def stream(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return streams.event_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1)


def test_spans_meet_in_any_order_and_settle(spark, tmp_path):
    batches = [
        [event("fn.end", "a", "1", 5, 2, name="f", duration=7), event("request.end", "a", seq=9, at=3, status=200, duration=9)],
        [event("fn.start", "a", "1", 2, 1, name="f"), event("fn.start", "a", "2", 3, 1, "1", "g"), event("fn.error", "b", "8", 4, 2, name="h", duration=1)],
        [event("request.start", "a", seq=1, at=0), event("fn.start", "c", "3", 1, 2, name="k")],
        [event("log", "tick", at=10_000)],
    ]
    got = streams.run_available(streams.stream_spans(stream(spark, f"{tmp_path}/in", batches), "1 hour"))
    rows = {(x.request_id, x.span_id): x for x in got.collect()}
    assert len(rows) == got.count() == 4
    one = rows["a", "1"]
    assert (one.status, one.duration_ms, one.has_start, one.seq, one.ts, one.batch) == ("ok", 7, True, 2, T0 + timedelta(minutes=1), 1)
    assert {k: (x.status, x.has_start) for k, x in rows.items() if k != ("a", "1")} == {("a", "2"): ("running", True), ("b", "8"): ("error", False), ("c", "3"): ("running", True)}
    whole = spans.assemble_spans(spark.createDataFrame([e for b in batches for e in b], SCHEMA))
    same = [c for c in whole.columns]
    assert sorted(map(str, got.select(same).collect())) == sorted(map(str, whole.select(same).collect()))
    requests = streams.run_available(streams.stream_requests(stream(spark, f"{tmp_path}/again", batches), "1 hour")).collect()
    assert [(x.request_id, x.method, x.status, x.span_count, x.raised, x.active) for x in requests] == [("a", "GET", 200, 2, False, False)]


def test_state_leaves_with_the_watermark(spark, tmp_path):
    batches = [
        [event("fn.start", "a", "1", 1, 0, name="f"), event("fn.start", "a", "1", 1, 0, name="f")],
        [event("log", "tick", at=60)],  # 60 minutes on: a's state (10 minutes and no end) leaves in the next batch
        [event("log", "tick", at=60)],
        [event("log", "tick", at=61), event("fn.end", "a", "1", 2, 61, name="f", duration=3), event("fn.start", "a", "1", 1, 61, name="f")],
        [event("log", "tick", at=500)],
    ]
    got = [(x.span_id, x.status, x.has_start) for x in streams.run_available(streams.stream_spans(stream(spark, f"{tmp_path}/in", batches), "1 minute")).orderBy("batch").collect()]
    assert got == [("1", "running", True), ("1", "ok", True)]  # settled, then known anew
    caps = streams.run_available(streams.stream_caps(stream(spark, f"{tmp_path}/caps", batches), 1, 5, "1 minute")).orderBy("batch", "n").collect()
    assert [(x.n, x.captured) for x in caps] == [(1, True), (2, False), (1, True)]  # counts begin anew
    start, note = lambda at: event("fn.start", "a", "1", 1, at, name="f"), lambda at: event("log", "a", seq=None, at=at)
    again = [[start(0), start(0), note(0), note(0)], [start(200), note(200)], [event("log", "tick", seq=7, at=201), note(201)], [start(202)]]
    kept = streams.run_available(streams.stream_dedup(stream(spark, f"{tmp_path}/dup", again), "10 minutes"))
    found = [(x.kind, x.seq) for x in kept.filter("request_id <> 'tick'").collect()]
    assert sorted(found, key=str) == [("fn.start", 1)] * 2 + [("log", None)] * 4  # an evicted key is new; rows without a seq stay


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    batches = [[event("fn.end", "a", str(k), k, k, name=f"f{k % 3}", duration=k) for k in range(n)] for n in (5, 9, 4)]
    source = stream(spark, f"{tmp_path}/in", batches)
    path = f"{tmp_path}/table"
    streams.upsert(streams.stream_overlay(source), ["name"], path, f"{tmp_path}/state").awaitTermination()
    before = sorted(map(tuple, streams.current(spark, path).collect()))
    assert before == sorted((n, len(x), 0, sum(x), max(x)) for n in ("f0", "f1", "f2") for x in [[k for b in (5, 9, 4) for k in range(b) if f"f{k % 3}" == n]])
    assert streams.versions(spark, path) == [1, 2]  # older ones are gone
    import shutil

    shutil.rmtree(f"{tmp_path}/state/commits")  # as if the driver had died before the last commit
    streams.upsert(streams.stream_overlay(source), ["name"], path, f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, streams.current(spark, path).collect())) == before


def test_targets_are_gone_and_back(spark, tmp_path):
    rows = [[("t", T0, 1), ("u", T0, 1)], [("t", T0 + timedelta(seconds=80), 1)], [("z", T0 + timedelta(seconds=300), 1)], [("z", T0 + timedelta(seconds=301), 1)], [("t", T0 + timedelta(seconds=400), 2)], [("z", T0 + timedelta(days=1), 1)]]
    for r in rows:
        spark.createDataFrame(r, "target string, ts timestamp, started_at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = streams.event_stream(spark, f"{tmp_path}/in", "target string, ts timestamp, started_at long", 1)
    got = streams.run_available(streams.stream_liveness(source)).filter("target <> 'z'").orderBy("batch", F.desc("connected"))
    t = [(x.handshakes, x.restarts, x.connected) for x in got.collect() if x.target == "t"]
    assert t[0] == (1, 0, True) and t[-1] == (3, 1, False) and (2, 0, False) in t and (3, 1, True) in t


class Handle:
    """State of one key, and how often it is read or written."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        handle = self

        class Value:
            def get(self):
                handle.calls += 1
                return handle.held.get(name)

            def update(self, value):
                handle.calls += 1
                handle.held[name] = value

            def clear(self):
                handle.calls += 1
                handle.held.pop(name, None)

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_state_of_a_request_is_read_and_written_once_a_batch():
    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    n, handle, spans_of = 500, Handle(), streams._Spans(0, 600_000)
    spans_of.init(handle)
    starts = [("a", "fn.start", str(i), None, "f", None, 2 * i, None, 1000 * i) for i in range(n)]
    ends = [("a", "fn.error" if i % 2 else "fn.end", str(i), None, "f", i, 2 * i + 1, None, None) for i in range(0, n, 5)]
    assert list(spans_of.handleInputRows(("a",), iter(starts), Now())) == []
    got = list(spans_of.handleInputRows(("a",), iter(ends), Now()))
    assert {(x.span_id, x.ts, x.seq, x.duration_ms, x.status) for x in got} == {(str(i), 1000 * i, 2 * i, i, "error" if i % 2 else "ok") for i in range(0, n, 5)}
    assert handle.calls <= 12 and handle.timers == {600_000 + n - 1}
    left = list(spans_of.handleExpiredTimer(("a",), Now(), None))
    assert [x.span_id for x in left] == [str(i) for i in range(n) if i % 5] and {x.status for x in left} == {"running"} and handle.held == {}
