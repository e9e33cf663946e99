"""Streams against what their batch operators give, with late and repeated rows, and stopped and started again."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import ledger, refresh, runs, text_index, traces
from siltstone.sources import tables
from siltstone.streaming import sinks, usage
from siltstone.streaming.refresh import stream_fetches
from siltstone.streaming.traces import stream_traces

START = datetime.datetime(2026, 1, 1, 10, 0, 0)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


class Feed:
    """Batches of rows as files that a stream reads one by one."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def drain(self, df, mode="append", sink=None, name="state"):
        writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/{name}").trigger(availableNow=True)
        q = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{self.folder}/out")).start()
        try:
            assert q.awaitTermination(180), "the stream doesn't end"
        finally:
            q.stop()

    def out(self):
        return self.spark.read.parquet(f"{self.folder}/out")


# --- traces


def stage_rows():
    rows = []
    for r in range(6):
        names = ["ping", "classify", "retrieve", "classify", "generate"][: 2 + r % 4]
        rows += [(f"r{r}", at(10 * r + 2 * i), i, n, None) for i, n in enumerate(names)]
        if r % 3 != 2:
            rows.append((f"r{r}", at(10 * r + 30), 9, "error" if r % 2 else "result", f"d{r}"))
            rows.append((f"r{r}", at(10 * r + 31), 10, "late stage", None))
    rows += [("r0", at(4000), 0, "ping", None), ("r0", at(4003), 1, "result", "again"), (None, at(1), 0, "ping", None), ("only", at(77), 0, "result", None)]
    return rows


EVENTS = "request_id string, at timestamp, seq long, event string, detail string"


def test_traces(spark):
    got = {(r.request_id, r.started): r for r in traces.traces(spark.createDataFrame(stage_rows(), EVENTS), 60).collect()}
    first = got["r0", at(0)]
    assert (first.outcome, first.detail, first.events, first.ended) == ("result", "d0", 3, at(30)) and [(s.stage, s.micros) for s in first.stages] == [("ping", 2_000_000), ("classify", 28_000_000)]
    third = got["r3", at(30)]
    assert third.outcome == "error" and [(s.stage, s.micros // 1_000_000) for s in third.stages] == [("ping", 2), ("classify", 4), ("retrieve", 2), ("generate", 22)]
    assert got["r0", at(4000)].detail == "again" and got["r2", at(20)].outcome == "incomplete" and got["r2", at(20)].stages[-1].micros is not None
    assert got["only", at(77)].stages == [] and len(got) == 8


def test_stream_of_traces_equals_batch(spark, tmp_path):
    feed, rows = Feed(spark, tmp_path, EVENTS), stage_rows()
    feed.put(rows[1::2])
    feed.put(rows[::4])
    feed.drain(stream_traces(feed.stream(), 60))
    feed.put(rows[2::4])  # some late, as the newest is of second 4003
    feed.put([("end", at(90_000), 0, "ping", None)])
    feed.drain(stream_traces(feed.stream(), 60))
    feed.put([("end", at(200_000), 1, "ping", None)])
    feed.drain(stream_traces(feed.stream(), 60))
    behind = [r for r in rows[2::4] if r[1] < at(4003 - 600)]
    kept = [r for r in rows if r not in behind]
    want = {tuple(r) for r in map(hashable, traces.traces(spark.createDataFrame(kept, EVENTS), 60).collect())}
    got = [tuple(r) for r in map(hashable, feed.out().where("request_id <> 'end'").collect())]
    assert set(got) == want and len(got) == len(want)


def hashable(r):
    return (r["request_id"], r["started"], r["ended"], r["outcome"], r["detail"], r["events"], tuple(map(tuple, r["stages"])))


# --- usage

CALLS = "event_id long, ts timestamp, user_id long"


def call_rows():
    return [(i, at(i * 1700 + (i % 7) * 11), i % 5 if i % 9 else None) for i in range(120)]


def test_usage_equals_batch(spark, tmp_path):
    rows = call_rows()
    feed = Feed(spark, tmp_path, CALLS)
    order = [*range(0, 40, 2), *range(1, 40, 2), *range(5, 9), *range(40, 80), *range(60, 70)]  # late and repeated rows
    root = f"file://{tmp_path}/tables"
    for part in (order[:30], order[30:]):
        feed.put([rows[i] for i in part])
    late = "1 day"
    seen = lambda: usage.sessions(usage.once(feed.stream(), "event_id", "ts", late), F.col("user_id").cast("string"), "ts")
    tables.write_tables(spark, root, {"sessions": spark.createDataFrame([], "session string, n long, first_seen timestamp"), "days": spark.createDataFrame([], "day date, n long")})
    sink = sinks.upserts(spark, root, "sessions", "sessions", "session")
    feed.drain(seen(), "update", sink, "a")
    feed.put([rows[i] for i in range(75, 120)])
    feed.drain(seen(), "update", sink, "a")
    state = spark.createDataFrame(rows, CALLS)
    want = {tuple(r) for r in state.where("user_id IS NOT NULL").groupBy(F.col("user_id").cast("string")).agg(F.count("*"), F.min("ts")).collect()}
    assert {tuple(r) for r in latest(spark, root, "sessions", "session").collect()} == want
    feed.drain(usage.totals(usage.once(feed.stream(), "event_id", "ts", late), F.to_date("ts")), "update", sinks.upserts(spark, root, "days", "days", "day"), "b")
    assert {tuple(r) for r in latest(spark, root, "days", "day").collect()} == {tuple(r) for r in state.groupBy(F.to_date("ts")).count().collect()}


def latest(spark, root, name, key):
    out = tables.read_table(spark, root, name)
    assert out.count() == out.select(key).distinct().count()
    return out


def test_cap_is_decided_in_order(spark, tmp_path):
    rows = call_rows()
    feed = Feed(spark, tmp_path, CALLS)
    feed.put([rows[i] for i in [*range(0, 60, 3), *range(1, 60, 3)]])
    feed.put([rows[i] for i in range(2, 60, 3)])
    feed.drain(usage.capped(feed.stream(), "event_id", "ts", 20, "2 days"))
    feed.put([rows[i] for i in range(119, 59, -1)])
    feed.put([(1000, at(30 * 86_400), 1)])
    feed.drain(usage.capped(feed.stream(), "event_id", "ts", 20, "2 days"))
    feed.put([(1001, at(60 * 86_400), 1)])
    feed.drain(usage.capped(feed.stream(), "event_id", "ts", 20, "2 days"))
    by_day = {}
    want = {}
    for i, ts, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        by_day[ts.date()] = by_day.get(ts.date(), 0) + 1
        want[i] = by_day[ts.date()] > 20
    got = {r.event_id: r.over_budget for r in feed.out().where("event_id < 1000").collect()}
    assert got == want and feed.out().where("event_id < 1000").count() == len(want)


# --- bookkeeping

RESULTS = "source_url string, seq long, at timestamp, status string, reason string, http_status int"


def results():
    kinds = ["fetch_failed", "unchanged", "fetch_failed", "fetch_failed", "robots_disallowed", "meaningful", "fetch_failed", "cosmetic", "fetch_failed"]
    return [(f"s{i % 4}", i, at(i * 60), kinds[(i * i + i // 4) % 9], None if i % 5 == 0 else f"why {i}", 500 + i if i % 3 else None) for i in range(60)] + [("unknown", 99, at(1), "unchanged", None, None)]


def sources_frame(spark):
    rows = [(f"s{i}", "body", "ok", i, "old", 404, at(-9), at(-9), at(-9), 2) for i in range(5)]
    return spark.createDataFrame(rows, runs.SOURCES)


def one_by_one(spark):
    """The table after each result by itself, in Python."""
    out = {r["source_url"]: r.asDict() for r in sources_frame(spark).collect()}
    for source, _, when, status, reason, http in sorted(results(), key=lambda r: r[1]):
        if source not in out:
            continue
        r, good = out[source], status in ("unchanged", "cosmetic", "meaningful")
        r["status"] = "ok" if good else status
        r["consecutive_failures"] = 0 if good else r["consecutive_failures"] + (status == "fetch_failed")
        r["last_error"] = None if good else reason or r["last_error"]
        r["last_http_status"] = http if status == "fetch_failed" else None
        if good:
            r["last_verified_at"] = r["last_success_at"] = when
        if status == "meaningful":
            r["last_changed_at"], r["change_count"] = when, r["change_count"] + 1
    return sorted(out.values(), key=lambda r: r["source_url"])


def held(spark, root):
    return [r.asDict() for r in tables.read_table(spark, root, "sources").orderBy("source_url").collect()]


def test_bookkeeping_is_exactly_once(spark, tmp_path):
    root, feed = f"file://{tmp_path}/tables", Feed(spark, tmp_path, RESULTS)
    tables.write_tables(spark, root, {"sources": sources_frame(spark)}, "source_url")
    rows = results()
    for part in (rows[:25], rows[25:50]):
        feed.put(part)
    feed.drain(feed.stream(), sink=sinks.bookkeeping(spark, root))
    number = tables.current(spark, root)
    last = max(glob.glob(f"{tmp_path}/state/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):  # killed after its commit: the batch is run again
        os.remove(f)
    feed.drain(feed.stream(), sink=sinks.bookkeeping(spark, root))
    assert tables.current(spark, root) == number == 3
    feed.put(rows[50:])
    feed.drain(feed.stream(), sink=sinks.bookkeeping(spark, root))
    assert held(spark, root) == one_by_one(spark)
    fails = ledger.failure_counts(spark.createDataFrame(rows, RESULTS), "source_url", ["seq"], F.col("status") == "fetch_failed", F.col("status") == "robots_disallowed")
    last = {r.source_url: r.n for r in fails.groupBy("source_url").agg(F.max_by("consecutive_failures", "seq").alias("n")).collect()}
    assert all(r["consecutive_failures"] == last[r["source_url"]] for r in held(spark, root) if r["source_url"] in ("s0", "s1", "s2", "s3"))


def test_bookkeeping_of_one_batch(spark):
    out = sinks.bookkeep_all(sources_frame(spark), spark.createDataFrame(results(), RESULTS))
    assert [r.asDict() for r in out.orderBy("source_url").collect()] == one_by_one(spark)


def test_bookkeeping_after_another_writer(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/tables"
    tables.write_tables(spark, root, {"sources": sources_frame(spark)}, "source_url")
    write, commit, n = sinks.bookkeeping(spark, root), tables.commit, []

    def other_first(*args, **kw):
        if not n:
            n.append(1)
            some = sources_frame(spark).where("source_url = 's1'").withColumn("change_count", F.lit(50))
            commit(spark, root, {"sources": some}, {"sources": some})
        return commit(*args, **kw)

    monkeypatch.setattr(tables, "commit", other_first)
    write(spark.createDataFrame([("s1", 1, at(5), "meaningful", None, None)], RESULTS), 0)
    assert [r["change_count"] for r in held(spark, root)] == [2, 51, 2, 2, 2]


# --- refresh

FETCH = "source_url string, at timestamp, attempt int, outcome string, body string, http_status int"


def test_refresh_stream_goes_on_after_a_stop(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = Feed(spark, tmp_path, FETCH)
        outcomes = {f"s{i:02d}": [["ok"], ["http_error", "ok"], ["timeout", "http_error", "http_error"], ["robots"], ["http_error", "http_error", "ok"]][i % 5] for i in range(14)}
        feed.put([(s, at(0), 0, "start", None, None) for s in outcomes])
        tries = lambda k: [(s, at(100 * k + i), k, o[k - 1], f"body {s}" if o[k - 1] == "ok" else None, 503 if o[k - 1] == "http_error" else None) for i, (s, o) in enumerate(outcomes.items()) if len(o) >= k]
        feed.put(tries(1))
        feed.drain(stream_fetches(feed.stream()))
        asked = feed.out().where("kind = 'fetch'").count()
        assert feed.out().where("kind = 'settled'").count() == sum(len(o) == 1 for o in outcomes.values())
        feed.put([(s, at(150), 0, "start", None, None) for s in outcomes])  # the run is started again
        feed.put(tries(1)[:5] + tries(2))
        feed.put(tries(3))
        feed.drain(stream_fetches(feed.stream()))
        assert asked == 14 + sum(len(o) > 1 for o in outcomes.values())
        assert feed.out().where("kind = 'fetch'").count() == sum(map(len, outcomes.values()))
        attempts = spark.createDataFrame([(s, k + 1, x, f"body {s}" if x == "ok" else None, 503 if x == "http_error" else None) for s, o in outcomes.items() for k, x in enumerate(o)], "source_url string, attempt int, outcome string, body string, http_status int")
        columns = ["source_url", "attempts", "outcome", "body", "http_status"]
        settled = feed.out().where("kind = 'settled'").select(columns)
        assert sorted(map(tuple, settled.collect())) == sorted(map(tuple, refresh.settle_fetches(attempts).select(columns).collect()))
        # one that never answers: timers try again, and give up
        feed.put([("silent", at(1000), 0, "start", None, None)])
        for t in (3000, 6000, 9000, 12_000, 15_000):
            feed.put([("clock", at(t), 0, "start", None, None)])
            feed.drain(stream_fetches(feed.stream()))
        last = feed.out().where("source_url = 'silent' AND kind = 'settled'").collect()
        assert [(r.attempts, r.outcome) for r in last] == [(3, "timeout")]
    finally:
        spark.conf.unset(provider)


def test_a_run_goes_on_after_a_kill(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    runs.begin(spark, root)
    manifest = spark.createDataFrame([(f"u{i:02d}",) for i in range(14)], "source_url string")
    fetched = []

    def fetch(todo, fail_at=None):
        names = [r.source_url for r in todo.orderBy("source_url").collect()]
        if fail_at is not None and len(fetched) >= fail_at:
            raise RuntimeError("killed")
        fetched.extend(names)
        return spark.createDataFrame([(s, "ok" if s != "u03" else "http_error", f"# Page {s}\n\nword{s} text" if s != "u03" else None, None if s != "u03" else 500) for s in names], "source_url string, outcome string, body string, http_status int")

    old, new, now = F.col("last_indexed_body"), F.col("body"), F.lit("2026-09-14").cast("timestamp")
    verdict = F.when(old == new, "unchanged").otherwise("meaningful")
    with pytest.raises(RuntimeError, match="killed"):
        runs.run(spark, root, "run-1", manifest, lambda t: fetch(t, 6), verdict, now, 6)
    assert len(fetched) == 6 and tables.read_table(spark, root, "runs").count() == 6
    out = runs.run(spark, root, "run-1", manifest, fetch, verdict, now, 8)
    assert sorted(fetched) == [f"u{i:02d}" for i in range(14)] and out.count() == 14  # 6 resumed, 8 fetched
    assert {r.status for r in out.where("source <> 'u03'").collect()} == {"meaningful"}
    assert tables.read_table(spark, root, "chunks").count() == 13
    again = runs.run(spark, root, "run-2", manifest, fetch, verdict, now, 14)
    assert {(r.source, r.status) for r in again.collect()} == {(f"u{i:02d}", "fetch_failed" if i == 3 else "unchanged") for i in range(14)}
    assert tables.read_table(spark, root, "chunks").count() == 13  # those that didn't change keep theirs
    sources = {r.source_url: r for r in tables.read_table(spark, root, "sources").collect()}
    assert sources["u03"].consecutive_failures == 2 and sources["u00"].change_count == 1 and len(sources) == 14
    found = text_index.rank(spark, root, spark.createDataFrame([(1, "wordu07")], "query_id long, text string"))
    assert found.count() == 1
