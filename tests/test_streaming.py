import json
import time

import pytest

from plumbline.operators import sequences as sq
from plumbline.streaming import streams as st


@pytest.fixture(autouse=True)
def state_store(spark):
    for k, v in st.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in st.STATE_STORE:
        spark.conf.unset(k)


def put(folder, number, rows):
    (folder / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
    time.sleep(1.1)  # files are taken in order of their times


def drain(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp_path}/out")


def test_drift_state_lives_on_across_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"key": f"k{i % 3}", "seq": i, "ts": f"2024-01-01 00:00:{i:02d}", "score": (i * 7 % 10) / 10} for i in range(40)]
    kind = "key string, seq bigint, ts timestamp_ntz, score double"
    for part in range(2):
        put(src, part, rows[part * 20 : part * 20 + 20])
        got = drain(st.drift_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(src))), tmp_path)
    batch = sq.ewma(spark.read.schema(kind).json(str(src)))
    assert sorted((r.seq, round(r.ewma, 9), r.alert) for r in got.collect()) == sorted((r.seq, round(r.ewma, 9), r.alert) for r in batch.collect())


def test_leases(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = "path string, seq bigint, ts timestamp_ntz, agent_id string, op string"
    put(src, 0, [{"path": "f", "seq": 0, "ts": "2024-01-01 00:00:00", "agent_id": "a", "op": "acquire"}])
    put(src, 1, [{"path": "f", "seq": 1, "ts": "2024-01-01 00:00:10", "agent_id": "b", "op": "acquire"}, {"path": "f", "seq": 2, "ts": "2024-01-01 00:06:00", "agent_id": "b", "op": "acquire"}, {"path": "f", "seq": 3, "ts": "2024-01-01 00:06:01", "agent_id": "b", "op": "release"}])
    got = drain(st.lease_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(src))), tmp_path)
    assert {r.seq: r.outcome for r in got.collect()} == {0: "granted", 1: "denied", 2: "granted", 3: "released"}


def test_changes_once_each(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = "path string, scan bigint, size bigint, mod_time timestamp_ntz"
    t = "2024-01-01 00:00:00"
    for scan, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2), ("b", None)], [("a", 2), ("b", None)], [("b", 5)]]):
        put(src, scan, [{"path": p, "scan": scan, "size": s, "mod_time": t} for p, s in rows])
    got = drain(st.change_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(src))), tmp_path)
    assert sorted((r.scan, r.path, r.change) for r in got.collect()) == [(0, "a", "created"), (0, "b", "created"), (1, "a", "modified"), (1, "b", "deleted"), (3, "b", "created")]


def test_windows_leave_out_what_comes_too_late(spark, tmp_path):
    from pyspark.sql import functions as F

    src = tmp_path / "in"
    src.mkdir()
    put(src, 0, [{"ts": f"2024-01-01 {t}:00"} for t in ("00:10", "00:50", "05:00")])
    put(src, 1, [{"ts": f"2024-01-01 {t}:00"} for t in ("04:30", "09:00")])
    put(src, 2, [{"ts": f"2024-01-01 {t}:00"} for t in ("00:20", "09:10", "12:00")])
    rows = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    got = drain(st.windowed(rows, "ts", "1 hour", F.count("*").alias("n"), delay="1 hour"), tmp_path)
    assert sorted((r.start.hour, r.end.hour, r.n) for r in got.collect()) == [(0, 1, 2), (4, 5, 1), (5, 6, 1), (9, 10, 2)]


def test_an_acquisition_needs_an_agent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    kind = "path string, seq bigint, ts timestamp_ntz, agent_id string, op string"
    rows = [{"path": "f", "seq": k, "ts": f"2024-01-01 00:00:0{k}", "agent_id": a, "op": "acquire"} for k, a in enumerate([None, "", "b"])]
    put(src, 0, rows)
    got = drain(st.lease_stream(spark.readStream.schema(kind).json(str(src))), tmp_path)
    assert {r.seq: r.outcome for r in got.collect()} == {0: "invalid", 1: "invalid", 2: "granted"}


def test_rebuild_once_per_batch_and_sinks_get_all(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, 0, [{"x": 1}, {"x": 2}, {"x": 3}])
    built, first, second = [], [], []
    stream = spark.readStream.schema("x int").json(str(src))
    st.rebuild_on_change(stream, lambda s: built.append(1), f"{tmp_path}/c1", {"availableNow": True}).awaitTermination()
    st.to_sinks(stream, [lambda b, k: first.extend(b.collect()), lambda b, k: second.append(b.count())], f"{tmp_path}/c2", {"availableNow": True}).awaitTermination()
    assert built == [1] and len(first) == 3 and second == [3]


def test_audit_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = {"timestamp": "2024-01-02T00:00:00Z", "event_type": "scan", "provider": "p"}
    (src / "a.json").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"timestamp": "2023-01-01T00:00:00Z"}), json.dumps(good), "x" * 2000]))
    got = drain(st.once(st.audit_stream(spark, str(src), "2024-01-01 00:00:00", line_cap=1000)), tmp_path)
    assert got.count() == 1
