import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import memory as me
from plumbline.operators import sequences as sq

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_ewma(spark):
    rows = [("a", k, at(k), s) for k, s in enumerate([0.5, 0.6, 0.9])]
    got = sq.ewma(spark.createDataFrame(rows, "key string, seq long, ts timestamp_ntz, score double")).orderBy("seq").collect()
    assert got[2].ewma == pytest.approx(0.641) and not any(r.alert for r in got)


def test_the_twenty_first_reinforcement_promotes(spark):
    rows = [("p", k, at(k)) for k in range(22)]
    got = sq.learn(spark.createDataFrame(rows, "pattern_id string, seq long, ts timestamp_ntz")).first()
    assert (got.strength, got.promoted_at, got.n) == (0.902, 21, 22)


def test_leases(spark):
    rows = [("f", 0, at(0), "a", "acquire"), ("f", 1, at(10), "b", "acquire"), ("f", 2, at(20), "a", "extend"), ("f", 3, at(321), "b", "acquire"), ("f", 4, at(330), "a", "release"), ("f", 5, at(331), "b", "release"), ("f", 6, at(332), "b", "extend"), ("f", 7, at(333), "", "acquire")]
    got = sq.leases(spark.createDataFrame(rows, "path string, seq long, ts timestamp_ntz, agent_id string, op string")).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["granted", "denied", "extended", "granted", "denied", "released", "not_locked", "invalid"]


def test_circuit(spark):
    ok = [False, False, True, True, True, True, True]
    times = [0, 1, 2, 40, 41, 42, 43]
    rows = [("k", k, at(t), o) for k, (t, o) in enumerate(zip(times, ok, strict=True))]
    got = sq.circuit(spark.createDataFrame(rows, "key string, seq long, ts timestamp_ntz, ok boolean"), 2, 30).orderBy("seq").collect()
    assert [(r.allowed, r.state) for r in got] == [(True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "half_open"), (True, "closed"), (True, "closed")]


def test_token_bucket(spark):
    rows = [("k", k, at(t)) for k, t in enumerate([0, 0, 0, 0.5, 1, 10])]
    got = sq.token_bucket(spark.createDataFrame(rows, "key string, seq long, ts timestamp_ntz"), 1, 2).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True] and got[-1].tokens == 1.0


def test_scopes(spark):
    agents = spark.createDataFrame([("a", ["src/*"]), ("b", ["src/x/*", "lib"]), ("c", ["*"]), ("d", ["other"]), ("e", None)], "agent_id string, scope array<string>")
    assert {(r.agent_a, r.agent_b) for r in sq.scope_overlaps(agents).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")}


def test_scopes_meet_in_blocks_and_every_pair_is_made_once(spark, monkeypatch):
    monkeypatch.setattr(sq, "TASK_PAIRS", 10, raising=False)
    kinds = ["*", "", "a*", "a**", "a/", "a/b", "a/b*", "a/c", "b", None]
    rows = [(f"u{k}", [kinds[k % 10], kinds[k * 7 % 9], kinds[k % 10]]) for k in range(60)] + [(None, ["a"])]
    clean = lambda x: x.rstrip("*")
    flat = {(a, x) for a, xs in rows for x in xs if a is not None and x is not None}
    want = sorted((a, b, x, y) for a, x in flat for b, y in flat if a < b and (clean(x).startswith(clean(y)) or clean(y).startswith(clean(x))))
    got = sq.scope_overlaps(spark.createDataFrame(rows, "agent_id string, scope array<string>"), 7)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_scope_of_many_agents_is_one_task(spark):
    agents = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("agent_id"), F.array(F.lit("src/*"), F.concat(F.lit("src/"), F.col("id") % 3)).alias("scope"))
    parts = [r["n"] for r in sq.scope_overlaps(agents).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    each = [1667, 1667, 1666]
    assert sum(parts) == 5000 * 4999 // 2 + 5000 * 4999 + sum(n * (n - 1) // 2 for n in each)
    assert max(parts) < 0.4 * sum(parts)


def test_changes_of_snapshots(spark):
    kind = "path string, size long, mod_time timestamp_ntz"
    a = spark.createDataFrame([("same", 1, T0), ("grown", 1, T0), ("older", 1, at(9)), ("gone", 1, T0)], kind)
    b = spark.createDataFrame([("same", 1, T0), ("grown", 2, T0), ("older", 1, T0), ("new", 1, T0)], kind)
    assert {r.path: r.change for r in sq.changes(a, b).collect()} == {"grown": "modified", "gone": "deleted", "new": "created"}


def test_a_fold_does_not_care_how_rows_are_dealt(spark):
    rows = [(f"k{k % 7}", k, at(k * 37 % 101), (k * 13 % 50) / 50) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, seq long, ts timestamp_ntz, score double")
    assert sorted(map(tuple, sq.ewma(df.repartition(1)).collect())) == sorted(map(tuple, sq.ewma(df.repartition(9)).collect()))


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, []), (5, [3.0, 4.0])], "id long, v array<float>")
    got = {r.id: r.c for r in df.select("id", me.cosine(df.v, [1.0, 0.0]).alias("c")).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.6})


def test_fallback_embedding_has_length_one_and_follows_the_text():
    import numpy as np

    a, b = me.fallback_embedding("abc", 16), me.fallback_embedding("abd", 16)
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-5) and not np.array_equal(a, b) and np.array_equal(a, me.fallback_embedding("abc", 16))


def test_upsert_keeps_what_it_should(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v long, made string")
    new = spark.createDataFrame([("a", 10, "new", 1), ("a", 11, "new", 2), ("c", 3, "new", 1)], "k string, v long, made string, seq long")
    assert sorted(map(tuple, me.upsert(table, new, ["k"], ("made",)).collect())) == [("a", 11, "old"), ("b", 2, "old"), ("c", 3, "new")]
