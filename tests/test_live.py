import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import live

AGENTS = ["plan", "search", "write"]
SCHEMA = "run_id string, seq long, event_type string, agent string, stage string, progress double"


def run_log(seed=1, n=3000, runs=6):
    rng = random.Random(seed)
    kinds = ["agent_started", "agent_completed", "agent_failed", "progress", "telemetry_update", None]
    rows = []
    for i in range(n):
        kind = rng.choice(["run_started", "run_completed", "run_failed"]) if rng.random() < 0.006 else rng.choice(kinds)
        run = "hot" if rng.random() < 0.4 else f"r{rng.randrange(runs)}"
        rows.append((run, i, kind, rng.choice([*AGENTS, "other", None]), rng.choice(["one", "two", "", None]), rng.choice([None, rng.random()])))
    return rows


def fold(rows, ring):
    """The rule, event by event."""
    states = {}
    for run, seq, kind, agent, stage, progress in sorted(rows, key=lambda r: r[1]):
        new = {"status": "idle", "stage": "Waiting", "current": "", "progress": 0.0, "agents": dict.fromkeys(AGENTS, "pending"), "events": []}
        s = states.setdefault(run, new)
        if kind == "run_started":
            s = states[run] = {**new, "status": "running", "stage": "Starting"}
        if progress is not None:
            s["progress"] = progress
        if stage:
            s["stage"] = stage
        if kind == "agent_started":
            s["current"] = agent or ""
        elif kind in ("agent_completed", "agent_failed"):
            s["current"] = ""
        if kind in live.AGENT_STATUS and agent in AGENTS:
            s["agents"][agent] = live.AGENT_STATUS[kind]
        if kind in ("run_completed", "run_failed"):
            s["status"], s["stage"] = kind[4:], kind[4:].title()
        if kind == "run_failed":
            s["agents"] = {a: "skipped" if x == "pending" else x for a, x in s["agents"].items()}
        s["events"] = [*s["events"], (seq, kind, agent)][-ring:]
    return sorted((r, s["status"], s["stage"], s["current"], s["progress"], list(s["agents"].items()), s["events"]) for r, s in states.items())


def plain(rows):
    return sorted((r.run_id, r.run_status, r.stage, r.current_agent, r.progress, [tuple(a) for a in r.agents], [tuple(e) for e in r.events]) for r in rows)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.ROCKSDB)
    yield
    spark.conf.set(name, before)


def in_files(spark, df, path, order, files=5):
    """A stream that reads ``df`` in several files, in order."""
    n = df.count()
    for i in range(files):
        low, high = n * i // files, n * (i + 1) // files
        part = df.orderBy(order).offset(low).limit(high - low)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def finished(spark, df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return spark.table(name)


def test_run_states_equal_the_fold(spark):
    rows = run_log()
    got = live.run_states(spark.createDataFrame(rows, SCHEMA).repartition(3), AGENTS, 50)
    assert plain(got.collect()) == fold(rows, 50)
    assert live.run_states(spark.createDataFrame([], SCHEMA), AGENTS).count() == 0


def test_stream_of_run_states_equals_the_batch(spark, tmp_path, rocksdb):
    events = spark.createDataFrame(run_log(2, 1200, 2), SCHEMA)
    out = finished(spark, live.stream_run_states(in_files(spark, events, str(tmp_path / "in"), "seq"), AGENTS, 40), "states", "update", tmp_path)
    latest = {}
    for r in out.collect():
        if r.run_id not in latest or r.events[-1].seq > latest[r.run_id].events[-1].seq:
            latest[r.run_id] = r
    assert plain(latest.values()) == plain(live.run_states(events, AGENTS, 40).collect()) == fold([tuple(r) for r in events.collect()], 40)
    assert all(len(r.events) <= 40 for r in latest.values())


def timed(seed, n):
    rng, t, rows = random.Random(seed), datetime(2024, 5, 1), []
    for i in range(n):
        t += timedelta(microseconds=rng.choice([0, 1, 400_000, 999_999, 1_000_000, 5_000_000]))
        rows.append((rng.choice(["a", "a", "b", None]), t, i))
    return rows


def test_throttle(spark, tmp_path, rocksdb):
    rows = timed(4, 2000)
    last, want = {}, []
    for k, t, i in rows:
        if k not in last or t - last[k] >= timedelta(seconds=1):
            last[k] = t
            want.append((k, t, i))
    df = spark.createDataFrame(rows + [("a", None, 9999)], "k string, ts timestamp, seq long")
    assert sorted(map(tuple, live.throttle(df.repartition(3), 1, "k").collect()), key=lambda r: r[2]) == want
    stream = live.stream_throttle(in_files(spark, df.filter("ts is not null"), str(tmp_path / "in"), "seq"), 1, "k")
    assert sorted(map(tuple, finished(spark, stream, "throttled", "append", tmp_path).collect()), key=lambda r: r[2]) == want


def test_running_metrics_within_the_sketch_error(spark, tmp_path):
    rng = random.Random(0)
    rows = [(rng.choice("ab"), rng.lognormvariate(0, 2) if rng.random() < 0.98 else None) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "kind string, value double").withColumn("n", F.monotonically_increasing_id())
    out = finished(spark, live.running_metrics(in_files(spark, df, str(tmp_path / "in"), "n"), "kind", "value", 400), "metrics", "update", tmp_path)
    latest = {r.kind: r for r in sorted(out.collect(), key=lambda r: r.events)}
    for kind, r in latest.items():
        values = sorted(v for k, v in rows if k == kind and v is not None)
        assert (r.events, round(r.mean, 4)) == (len(values), round(sum(values) / len(values), 4))
        for q, found in ((0.5, r.median), (0.95, r.p95)):
            rank = sum(v <= found + 1e-6 for v in values) / len(values)
            assert abs(rank - q) < 2.3 / 400**0.9 * 3, (q, rank)
    exact = live.running_metrics(df.limit(900), "kind", "value").collect()
    for r in exact:  # a sketch with room for all rows
        values = sorted(x.value for x in df.limit(900).collect() if x.kind == r.kind and x.value is not None)
        assert r.median == round(values[(len(values) - 1) // 2], 6)


def test_collected_metrics(spark, tmp_path):
    """A stream in update mode ends with the batch's numbers, late and odd rows included."""
    rows = [
        ("question_completed", 2.0, {"retrieval_latency_seconds": "0.5", "tokens": "9", "odd_seconds": "x"}, "done", "answered", None), ("question_failed", None, None, "failed", "", None), ("agent_completed", 1.0, {}, None, None, None),
        ("agent_failed", 3.0, None, None, None, None), ("warning", None, None, None, None, None), ("consensus_decided", None, None, None, None, "accept"), ("consensus_decided", None, None, None, None, None), (None, 5.0, {"retrieval_latency_seconds": "1.5"}, None, None, None), ("question_completed", 4.0, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, event_type string, elapsed_seconds double, metrics map<string,string>, status string, answer_status string, decision string")
    counts = {(r.kind, r.name): r.events for r in live.outcome_counts(df).collect()}
    assert counts == {("warning", "all"): 1, ("error", "all"): 2, ("answer_status", "answered"): 1, ("answer_status", "failed"): 1, ("answer_status", "unknown"): 1, ("decision", "accept"): 1, ("decision", "unknown"): 1}
    want = {r.category: tuple(r)[1:] for r in live.running_metrics(live.latencies(df), "category", "seconds").collect()}
    assert want == {"total_question": (2, 3.0, 2.0, 4.0, 2.0, 4.0), "agent": (1, 1.0, 1.0, 1.0, 1.0, 1.0), "retrieval_latency": (2, 1.0, 0.5, 1.5, 0.5, 1.5)}
    out = finished(spark, live.running_metrics(live.latencies(in_files(spark, df, str(tmp_path / "in"), "n", 3)), "category", "seconds"), "collected", "update", tmp_path).collect()
    latest = {r.category: tuple(r)[1:] for r in sorted(out, key=lambda r: r.events)}
    assert latest == want
