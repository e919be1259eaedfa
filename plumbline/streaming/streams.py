"""Structured Streaming forms: change feeds, audit streams, drift, leases, states, rings.

Order-dependent state sorts each micro-batch's rows of a key by (ts, seq) before
folding them. State is kept per key by ``transformWithStateInPandas`` (RocksDB
state store), deduplication by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from plumbline.operators.sequences import ALPHA, DRIFT, SAMPLES, TRANSITIONS

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
AUDIT = "timestamp timestamp, event_type string, provider string, connection_id string, repo_id string, details map<string,string>"


def audit_stream(spark: SparkSession, path: str, since: str | None = None, line_cap: int = 1 << 20) -> DataFrame:
    """The events of NDJSON files as they appear; blank, unparsable and over-long lines are passed over (the cap is the format's own)."""
    text = spark.readStream.text(path).where((F.trim("value") != "") & (F.octet_length("value") <= line_cap))
    rows = text.select(F.from_json("value", AUDIT).alias("e"), F.sha2("value", 256).alias("digest")).where("e.event_type IS NOT NULL").select("e.*", "digest")
    return rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp")) if since else rows


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream that may deliver twice, without what came again within ``delay``."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["digest"])


class _Keyed(StatefulProcessor):
    """One value of state per key; ``step(state or None, row)`` -> (state, output or None)."""

    def __init__(self, state_schema: str, columns: list[str], order: list[str], step: Callable[[tuple | None, Any], tuple[tuple | None, dict | None]]):
        self.state_schema, self.columns, self.order, self.step = state_schema, columns, order, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order)
        state = self.value.get() if self.value.exists() else None
        out = []
        for row in frame.itertuples(index=False):
            state, found = self.step(state, row)
            if found is not None:
                out.append(found)
        if state is None:
            self.value.clear()
        else:
            self.value.update(tuple(state))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, schema: str, state: str, order: list[str], step: Callable) -> DataFrame:
    columns = [c.strip().split()[0] for c in schema.split(",")]
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=_Keyed(state, columns, order, step), outputStructType=schema, outputMode="Append", timeMode="None")


def drift_stream(samples: DataFrame, alpha: float = ALPHA, threshold: float = DRIFT, min_samples: int = SAMPLES) -> DataFrame:
    """W5 over a stream of (key, ts, seq, score)."""

    def step(state, row):
        if state is None:
            value, n, off = row.score, 1, 0.0
        else:
            value, n = alpha * row.score + (1 - alpha) * state[0], state[1] + 1
            off = abs(row.score - value)
        return (float(value), int(n)), {"key": row.key, "seq": row.seq, "ewma": value, "drift": off, "alert": off > threshold and n > min_samples}

    return _stateful(samples, "key", "key string, seq bigint, ewma double, drift double, alert boolean", "value double, n bigint", ["ts", "seq"], step)


def state_stream(requests: DataFrame, start: str = "idle") -> DataFrame:
    """W8 over a stream of (key, ts, seq, to_state)."""

    def step(state, row):
        now = state[0] if state else start
        ok = row.to_state in TRANSITIONS.get(now, ())
        return (row.to_state if ok else now,), {"key": row.key, "seq": row.seq, "from_state": now, "to_state": row.to_state, "valid": ok}

    return _stateful(requests, "key", "key string, seq bigint, from_state string, to_state string, valid boolean", "state string", ["ts", "seq"], step)


def lease_stream(requests: DataFrame, seconds: float = 300.0) -> DataFrame:
    """W12 over a stream of (path, ts, seq, agent_id, op)."""

    def step(state, row):
        now = row.ts.timestamp()
        mine = state is not None and state[0] == row.agent_id
        out = {"path": row.path, "seq": row.seq, "agent_id": row.agent_id, "op": row.op}
        if row.op == "acquire" and (pd.isna(row.agent_id) or not row.agent_id):
            return state, out | {"outcome": "invalid"}
        if row.op == "acquire" and (state is None or mine or now >= state[1]):
            return (row.agent_id, now + seconds), out | {"outcome": "extended" if mine else "granted"}
        if state is None:
            return state, out | {"outcome": "not_locked"}
        if not mine:
            return state, out | {"outcome": "denied"}
        if row.op == "release":
            return None, out | {"outcome": "released"}
        return (row.agent_id, now + seconds), out | {"outcome": "extended"}

    return _stateful(requests, "path", "path string, seq bigint, agent_id string, op string, outcome string", "agent string, until double", ["ts", "seq"], step)


def change_stream(snapshots: DataFrame) -> DataFrame:
    """W1 over a stream of scans (path, scan, size, mod_time; size null: not there): created, modified and deleted, once each (Q20)."""

    def step(state, row):
        gone = pd.isna(row.size_)
        out = {"path": row.path, "scan": row.scan}
        if state is None:
            return (None, None) if gone else ((int(row.size_), row.mod_time.timestamp()), out | {"change": "created"})
        if gone:
            return None, out | {"change": "deleted"}
        new = (int(row.size_), row.mod_time.timestamp())
        return new, out | {"change": "modified"} if new[1] > state[1] or new[0] != state[0] else None

    return _stateful(snapshots.withColumnRenamed("size", "size_"), "path", "path string, scan bigint, change string", "size bigint, time double", ["scan"], step)


def _awaited(events: DataFrame, time: str, delay: str | None) -> DataFrame:
    return events.withWatermark(time, delay) if delay and events.isStreaming else events


def windowed(events: DataFrame, time: str, size: str, *measures: Column, by: tuple[str, ...] = (), slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(start, end, by, measures) of tumbling windows, or sliding ones; rows without a time are in no window.

    In a stream, a window comes out once, ``delay`` after its end by the rows' own time;
    rows for a window that a micro-batch before has let out are left out.
    """
    rows = _awaited(events, time, delay).groupBy(F.window(time, size, slide).alias("_w"), *by).agg(*measures)
    return rows.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in rows.columns if c != "_w"])


def sessions(events: DataFrame, time: str, gap: str, *measures: Column, by: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    """(start, end, by, measures) of sessions, which end when nothing comes for ``gap``; lateness as in ``windowed``."""
    rows = _awaited(events, time, delay).groupBy(F.session_window(time, gap).alias("_w"), *by).agg(*measures)
    return rows.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in rows.columns if c != "_w"])


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[SparkSession], None], checkpoint: str, trigger: dict):
    """``rebuild`` once for each micro-batch that holds a change, however many it holds."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            rebuild(batch.sparkSession)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def to_sinks(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, trigger: dict):
    """Every sink gets every row of a micro-batch; none is dropped for a slow one."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for sink in sinks:
            sink(batch, batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class Metrics(StreamingQueryListener):
    """Gauges and counters of the running queries, to be read by whatever exports them."""

    def __init__(self) -> None:
        self.gauges: dict[str, float] = {}
        self.counters: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.counters["queries_started"] = self.counters.get("queries_started", 0) + 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.gauges["rows_per_second"] = p.processedRowsPerSecond or 0.0
        self.counters["rows"] = self.counters.get("rows", 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.counters["queries_ended"] = self.counters.get("queries_ended", 0) + 1
