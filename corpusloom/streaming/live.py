"""Live views of running jobs: state with the last events, throttled events, running metrics.

Each has a batch form on whole tables and a stream form whose state is bounded: a ring of events and
one status per agent for a run, one time for a throttled key, one sketch for a category. The stream forms that keep
state of their own need ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider.

Events of a key are folded in the order of ``seq`` (``ts``, then ``seq``, for throttling) within a micro-batch, and micro-batches in their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RING = 250
#: What an event makes of its agent, and of its run.
AGENT_STATUS = {"agent_started": "running", "agent_completed": "completed", "agent_failed": "failed"}
RUN_STATUS = {"run_started": "running", "run_completed": "completed", "run_failed": "failed"}
RUN_STAGE = {"run_started": "Starting", "run_completed": "Completed", "run_failed": "Failed"}
EVENT = "struct<seq:bigint,event_type:string,agent:string>"
STATE = f"run_id {{}}, run_status string, stage string, current_agent string, progress double, agents array<struct<agent:string,status:string>>, events array<{EVENT}>"


def _mapped(names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def run_states(events: DataFrame, agents: Sequence[str], ring: int = RING) -> DataFrame:
    """A row for each run: status, stage, current agent, progress, the status of each agent and the last ``ring`` events, all since the run last started.

    ``events`` has (run_id, seq, event_type, agent, stage, progress). An agent without events is pending, or skipped once
    the run has failed; events of a run that never started count too, its status is idle until one ends it. Events with a null type or agent change nothing but the ring.
    Everything but the ring is one aggregate that combines before its shuffle; of the ring each task passes on ``ring`` events of a run.
    """
    starts = events.groupBy(F.col("run_id").alias("_run")).agg(F.max(F.when(F.col("event_type") == "run_started", F.col("seq"))).alias("_from"))
    live = events.join(starts, F.col("run_id").eqNullSafe(F.col("_run")), "left").drop("_run").filter(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    kind = F.col("event_type")

    def last(value: Column, where: Column) -> Column:
        return F.max_by(F.when(where, value), F.when(where, F.col("seq")))

    stage = F.coalesce(F.when(kind.isin("run_completed", "run_failed"), _mapped(RUN_STAGE)), F.nullif("stage", F.lit("")), _mapped(RUN_STAGE))
    of_agent = kind.isin(*AGENT_STATUS)
    state = live.groupBy("run_id").agg(
        F.coalesce(last(_mapped(RUN_STATUS), kind.isin(*RUN_STATUS)), F.lit("idle")).alias("run_status"),
        F.coalesce(last(stage, stage.isNotNull()), F.lit("Waiting")).alias("stage"),
        F.coalesce(last(F.when(kind == "agent_started", F.coalesce("agent", F.lit(""))).otherwise(F.lit("")), of_agent), F.lit("")).alias("current_agent"),
        F.coalesce(last(F.col("progress"), F.col("progress").isNotNull()), F.lit(0.0)).alias("progress"),
        F.coalesce(F.bool_or(kind == "run_failed"), F.lit(False)).alias("_failed"),
        *[last(_mapped(AGENT_STATUS), of_agent & (F.col("agent") == a)).alias(f"_agent{i}") for i, a in enumerate(agents)],
    )
    idle = F.when(F.col("_failed"), "skipped").otherwise("pending")
    state = state.withColumn("agents", F.array(*[F.struct(F.lit(a).alias("agent"), F.coalesce(f"_agent{i}", idle).alias("status")) for i, a in enumerate(agents)]))
    newest = live.withColumn("_place", F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("seq")))).filter(F.col("_place") <= ring)
    rings = newest.groupBy(F.col("run_id").alias("_run")).agg(F.array_sort(F.collect_list(F.struct("seq", "event_type", "agent"))).alias("events"))
    return state.join(rings, F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", "run_status", "stage", "current_agent", "progress", "agents", "events")


class RunState(StatefulProcessor):
    """The fold behind ``run_states`` for one run: a ring of events by place, a status for each agent and one row of scalars."""

    def __init__(self, agents: Sequence[str], ring: int) -> None:
        self.agents, self.ring = list(agents), ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seen long, run_status string, stage string, current_agent string, progress double, failed boolean")
        self.of_agents = handle.getMapState("agents", "agent string", "status string")
        self.events = handle.getMapState("events", "place long", "seq long, event_type string, agent string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        seen, status, stage, current, progress, failed = tuple(self.held.get()) if self.held.exists() else (0, "idle", "Waiting", "", 0.0, False)
        for r in sorted(rows, key=lambda r: r["seq"]):
            kind = r["event_type"]
            if kind == "run_started":
                self.of_agents.clear()
                self.events.clear()
                seen, current, progress, failed = 0, "", 0.0, False
            ended = kind in ("run_completed", "run_failed")
            stage = (RUN_STAGE[kind] if ended else None) or r["stage"] or RUN_STAGE.get(kind) or stage
            status, failed = RUN_STATUS.get(kind, status), failed or kind == "run_failed"
            progress = progress if r["progress"] is None else r["progress"]
            if kind in AGENT_STATUS:
                current = (r["agent"] or "") if kind == "agent_started" else ""
                if r["agent"] in self.agents:
                    self.of_agents.updateValue((r["agent"],), (AGENT_STATUS[kind],))
            self.events.updateValue((seen % self.ring,), (r["seq"], kind, r["agent"]))
            seen += 1
        self.held.update((seen, status, stage, current, progress, failed))
        known = {k[0]: v[0] for k, v in self.of_agents.iterator()}
        idle = "skipped" if failed else "pending"
        events = [tuple(self.events.getValue((n % self.ring,))) for n in range(max(0, seen - self.ring), seen)]
        yield Row(run_id=key[0], run_status=status, stage=stage, current_agent=current, progress=progress, agents=[(a, known.get(a, idle)) for a in self.agents], events=events)

    def close(self) -> None:
        pass


def stream_run_states(events: DataFrame, agents: Sequence[str], ring: int = RING) -> DataFrame:
    """As ``run_states`` on a stream: the state of each run that a micro-batch touches, in update mode."""
    kind = events.schema["run_id"].dataType.simpleString()
    return events.select("run_id", "seq", "event_type", "agent", "stage", "progress").groupBy("run_id").transformWithState(RunState(agents, ring), STATE.format(kind), "update", "none")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def throttle(events: DataFrame, seconds: float, key: str) -> DataFrame:
    """(key, ts, seq) of the events that pass: a key's first, and then each that comes ``seconds`` or more after the last that passed.

    ``events`` has ``key``, ts and seq. The rule is sequential in a key, so a key's three columns are sorted into one task, where
    one pass carries the last time; nothing is gathered. Events with a null time are left out; null is a key of its own.
    """
    least = round(seconds * 1e6)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        last = 0
        for b in batches:
            keep = []
            for h, n, t in zip(b["_key"], b["_null"], b["_at"], strict=True):
                new = at != (h, n)
                if new or t - last >= least:
                    at, last = (h, n), t
                    keep.append(True)
                else:
                    keep.append(False)
            yield b[keep]

    rows = events.filter("ts is not null").select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_null"), _micros(F.col("ts")).alias("_at"), key, "ts", "seq")
    sorted_ = rows.repartition("_key", "_null").sortWithinPartitions("_key", "_null", "_at", "seq")
    return sorted_.mapInPandas(passed, rows.schema).select(key, "ts", "seq")


class Throttle(StatefulProcessor):
    """Lets an event of a key pass ``micros`` after the last that passed; the state is that one time."""

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: (r["_at"], r["seq"])):
            if last is None or r["_at"] - last >= self.micros:
                last = r["_at"]
                yield Row(key=key[0], ts=r["ts"], seq=r["seq"])
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, seconds: float, key: str) -> DataFrame:
    """As ``throttle`` on a stream, in append mode. An event that is older than the last that passed doesn't pass, so events come at least ``seconds`` apart in any case."""
    rows = events.filter("ts is not null").select(F.col(key).alias("_key"), _micros(F.col("ts")).alias("_at"), "ts", "seq")
    schema = f"key {rows.schema['_key'].dataType.simpleString()}, ts {rows.schema['ts'].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}"
    return rows.groupBy("_key").transformWithState(Throttle(round(seconds * 1e6)), schema, "append", "none").withColumnRenamed("key", key)


#: Size of a quantile sketch: ranks are right to about 2.3 / size ** 0.9 of the rows, exact while a category has fewer rows than that.
SKETCH = 4096


def running_metrics(events: DataFrame, by: str, value: str, size: int = SKETCH) -> DataFrame:
    """(by, events, mean, least, most, median, p95) of a batch or a stream.

    Quantiles come from mergeable sketches, so a stream in update mode keeps one of them for each category and late rows count when they come;
    other columns are exact. Each quantile is a value that occurs. Rows without a value, or with NaN, don't count.
    """
    held = events.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg(
        F.count("*").alias("events"), F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("_sketch")
    )
    quantile = lambda q: F.round(F.kll_sketch_get_quantile_double("_sketch", F.lit(q)), 6)
    return held.select(by, "events", "mean", "least", "most", quantile(0.5).alias("median"), quantile(0.95).alias("p95"))


#: The latency that a finished step's event tells of.
LATENCY_EVENTS = {
    "retrieval_completed": "retrieval", "reranking_completed": "reranking", "evidence_selection_completed": "evidence_selection", "generation_completed": "generation",
    "question_completed": "total_question", "question_failed": "total_question", "agent_completed": "agent", "indexing_completed": "indexing",
}


def latencies(events: DataFrame, of_events: Mapping[str, str] = LATENCY_EVENTS) -> DataFrame:
    """(category, seconds): what the events (event_type, elapsed_seconds, metrics) tell of latencies, of a batch or a stream, for ``running_metrics``.

    An event of a known type gives its elapsed time, and each entry of the map ``metrics`` whose name ends with _seconds its value, under the name without that end. Nulls and what is no number give nothing.
    """
    pairs = [F.lit(x) for kv in of_events.items() for x in kv]
    own = F.array(F.struct(F.try_element_at(F.create_map(*pairs), F.col("event_type")).alias("category"), F.col("elapsed_seconds").cast("double").alias("seconds")))
    given = F.transform(F.map_entries(F.coalesce("metrics", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.when(F.endswith(e["key"], F.lit("_seconds")), F.regexp_replace(e["key"], "_seconds$", "")).alias("category"), e["value"].try_cast("double").alias("seconds")))
    return events.select(F.explode(F.concat(own, given)).alias("x")).select("x.*").filter("category is not null and seconds is not null")


def outcome_counts(events: DataFrame, errors: Sequence[str] = ("error", "question_failed", "agent_failed")) -> DataFrame:
    """(kind, name, events) of a batch or a stream: warnings, errors, the answer status of each finished question and each consensus decision.

    ``events`` has (event_type, status, answer_status, decision). A finished question's status is its answer's, else its own, else "unknown"; a decision that isn't named is "unknown". An event counts in each kind it belongs
    to; a stream keeps one number for each name.
    """
    kind = F.col("event_type")
    named = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit("unknown"))
    found = F.filter(F.array(
        F.when(kind == "warning", F.struct(F.lit("warning").alias("kind"), F.lit("all").alias("name"))),
        F.when(kind.isin(*errors), F.struct(F.lit("error").alias("kind"), F.lit("all").alias("name"))),
        F.when(kind.isin("question_completed", "question_failed"), F.struct(F.lit("answer_status").alias("kind"), named("answer_status", "status").alias("name"))),
        F.when(kind == "consensus_decided", F.struct(F.lit("decision").alias("kind"), named("decision").alias("name"))),
    ), lambda x: x.isNotNull())
    return events.select(F.explode(found).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("events"))
