"""Operators whose state follows an ordered sequence of rows of a key, in batch form.

Sequential ones are folds (one key's state in memory, never its rows); the others
are windows, aggregations and joins. ``seq`` breaks ties of time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.fold import fold

# Drift.
ALPHA, DRIFT, SAMPLES = 0.3, 0.15, 5


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between snapshots (path, size, mod_time): created, modified (later or of another size), deleted, once each (Q20)."""
    a = before.select("path", F.col("size").alias("_size"), F.col("mod_time").alias("_time"), F.lit(True).alias("_old"))
    b = after.select("path", "size", "mod_time", F.lit(True).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when((F.col("mod_time") > F.col("_time")) | (F.col("size") != F.col("_size")), "modified")
    return a.join(b, "path", "full").select("path", kind.alias("change")).where("change IS NOT NULL")


def included(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """No exclusion fits the path or a part of it, and an inclusion, if there are any, fits the whole."""
    from plumbline.functions.text import glob_to_regex

    parts = F.split(path, "/")
    out = F.lit(True)
    for g in exclude:
        out = out & ~(path.rlike(glob_to_regex(g)) | _any_part(parts, glob_to_regex(g)))
    if include:
        out = out & path.rlike("|".join(glob_to_regex(g) for g in include))
    return out


def _any_part(parts: Column, regex: str) -> Column:
    return F.exists(parts, lambda p: p.rlike(regex))


def last_events(events: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` events by time, then seq (the ring's size is the operator's own)."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def ewma(samples: DataFrame, alpha: float = ALPHA, threshold: float = DRIFT, min_samples: int = SAMPLES) -> DataFrame:
    """(key, seq, score, ewma, drift, alert) of samples (key, seq, ts, score): the first sample is the average; an alert if the new average is off by more than ``threshold`` after more than ``min_samples``."""

    def step(state, row):
        x = row["score"]
        if state is None:
            state, drift = (x, 1), 0.0
        else:
            value = alpha * x + (1 - alpha) * state[0]
            state, drift = (value, state[1] + 1), abs(x - value)
        return state, {"key": row["key"], "seq": row["seq"], "score": x, "ewma": state[0], "drift": drift, "alert": drift > threshold and state[1] > min_samples}

    rows = samples.select("key", "seq", "ts", "score").where("score IS NOT NULL")
    return fold(rows, ["key"], ["ts", "seq"], lambda key: None, step, f"key {samples.schema['key'].dataType.simpleString()}, seq bigint, score double, ewma double, drift double, alert boolean")


#: Scopes that meet as many others at a time, and pairs that a partition makes of them.
BLOCK, TASK_PAIRS = 1_000, 2_000_000


def scope_overlaps(agents: DataFrame, block: int = BLOCK) -> DataFrame:
    """(agent_a, agent_b, scope_a, scope_b) of agents (agent_id, scope array) one of whose scopes, trailing stars off, begins with the other's; an empty one meets all.

    Beginnings are matched by equality, among distinct ones. What has a beginning then
    meets what is equal to it or goes on from it, in blocks against blocks, so that a
    widespread beginning is dealt evenly. Every pair is made once and none that does not
    overlap; only the pairs themselves may be many.
    """
    s = agents.select("agent_id", F.explode("scope").alias("scope")).where("agent_id IS NOT NULL AND scope IS NOT NULL").distinct().withColumn("p", F.regexp_replace("scope", r"\*+$", ""))
    known = s.select("p").distinct()
    longer = known.where("p <> ''").select(F.col("p").alias("clean"), F.explode(F.transform(F.sequence(F.lit(0), F.length("p") - 1), lambda n: F.substring("p", F.lit(1), n))).alias("p"))
    on = s.withColumnRenamed("p", "clean").join(longer.join(known, "p", "left_semi"), "clean").select("agent_id", "scope", "p")  # what goes on from p
    sizes = s.select("p", F.lit(1).alias("t"), F.lit(0).alias("d")).union(on.select("p", F.lit(0), F.lit(1))).groupBy("p").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
    pairs = sizes.agg(F.sum(F.col("t").cast("double") * (F.col("t") / 2 + F.col("d")))).first()[0] or 0
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1).cast("long")).alias(c)
    large = F.broadcast(sizes.where((F.col("t") > block) | (F.col("d") > block)).select(F.col("p").alias("large"), blocks("t"), blocks("d")))  # few: each has more than a block

    def dealt(rows: DataFrame, count: str, places) -> DataFrame:
        own = F.pmod(F.xxhash64("agent_id", "scope"), F.coalesce(count, F.lit(1).cast("long")))
        t, d = (F.coalesce(c, F.lit(1).cast("long")) for c in ("t", "d"))
        rows = rows.join(large, F.col("p") == F.col("large"), "left").select("agent_id", "scope", "p", t.alias("t"), d.alias("d"), own.alias("own"))
        return rows.select("agent_id", "scope", "p", F.explode(places).alias("at")).select("agent_id", "scope", "p", "at.*")

    upto = lambda a, b, at: F.transform(F.sequence(a, b), at)
    task = lambda same, i, j: F.struct(F.lit(same).alias("same"), i.alias("i"), j.alias("j"))
    none, own = F.lit(0).cast("long"), F.col("own")
    left = dealt(s, "t", F.concat(upto(none, F.col("d") - 1, lambda j: task(False, own, j)), upto(own, F.col("t") - 1, lambda j: task(True, own, j))))
    right = dealt(on, "d", upto(none, F.col("t") - 1, lambda i: task(False, i, own))).union(dealt(s, "t", upto(none, own, lambda i: task(True, i, own))))
    key = ["p", "same", "i", "j"]
    left, right = left.withColumnsRenamed({"agent_id": "x", "scope": "sx"}), right.withColumnsRenamed({"agent_id": "y", "scope": "sy"})
    if pairs > TASK_PAIRS:  # the rows that meet are few, so adaptive execution would put them in few tasks
        n = max(int(agents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
        left, right = left.repartition(n, *key), right.repartition(n, *key)
    met = left.join(right, key).where((F.col("x") != F.col("y")) & (~F.col("same") | (F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    first = F.col("x") < F.col("y")
    return met.select(
        F.when(first, F.col("x")).otherwise(F.col("y")).alias("agent_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("agent_b"), F.when(first, F.col("sx")).otherwise(F.col("sy")).alias("scope_a"), F.when(first, F.col("sy")).otherwise(F.col("sx")).alias("scope_b")
    )


def active_agents(events: DataFrame) -> DataFrame:
    """(agent_id, status, ts) of agents whose last event (register, checkpoint, handoff, deregister) leaves them active."""
    last = events.groupBy("agent_id").agg(F.max_by(F.struct("op", "ts"), F.struct("ts", "seq")).alias("l"))
    status = F.when(F.col("l.op") == "handoff", "handed_off").when(F.col("l.op") == "deregister", "deregistered").otherwise("active")
    return last.select("agent_id", status.alias("status"), F.col("l.ts").alias("ts")).where("status <> 'deregistered'")


# The states that follow each state.
TRANSITIONS = {"idle": ("working",), "working": ("fixing", "handoff", "done", "idle"), "fixing": ("working", "done", "handoff"), "handoff": ("idle", "working"), "done": ("idle", "working")}


def state_machine(requests: DataFrame, start: str = "idle") -> DataFrame:
    """(key, seq, from_state, to_state, valid) of requests (key, seq, ts, to_state); an invalid one leaves the state as it is."""

    def step(state, row):
        ok = row["to_state"] in TRANSITIONS.get(state, ())
        return row["to_state"] if ok else state, {"key": row["key"], "seq": row["seq"], "from_state": state, "to_state": row["to_state"], "valid": ok}

    return fold(requests.select("key", "seq", "ts", "to_state"), ["key"], ["ts", "seq"], lambda key: start, step, f"key {requests.schema['key'].dataType.simpleString()}, seq bigint, from_state string, to_state string, valid boolean")


def valid_transition(from_state: Column, to_state: Column) -> Column:
    """W8, one pair at a time."""
    out = F.lit(False)
    for state, following in TRANSITIONS.items():
        out = out | ((from_state == state) & to_state.isin(*following))
    return out


def _round3(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def learn(observations: DataFrame, first: float = 0.1, hard: float = 0.9) -> DataFrame:
    """(pattern_id, n, strength, last_seen, promoted_at) of observations (pattern_id, seq, ts): .1 at first, then a tenth of what is missing, three decimals; promoted at ``hard``, never at first sight."""

    def step(state, row):
        n, s, _, promoted = state
        s = first if n == 0 else _round3(min(1.0, s + 0.1 * (1.0 - s)))
        if promoted is None and n > 0 and s >= hard:
            promoted = row["seq"]
        return (n + 1, s, row["ts"], promoted), None

    def finish(key, state):
        return {"pattern_id": key[0], "n": state[0], "strength": state[1], "last_seen": state[2], "promoted_at": state[3]}

    rows = observations.select("pattern_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return fold(rows, ["pattern_id"], ["ts", "seq"], lambda key: (0, 0.0, None, None), step, "pattern_id string, n bigint, strength double, last_seen timestamp_ntz, promoted_at bigint", finish)


def decay_patterns(patterns: DataFrame, as_of: str, rate: float = 0.01, least: float = 0.1) -> DataFrame:
    """The patterns left: less the rate for every day since last seen, and once; at least 0; gone below ``least``."""
    hours = F.timestamp_diff("SECOND", F.col("last_seen"), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    new = F.greatest(F.col("strength") - rate * (1.0 + hours / 24.0), F.lit(0.0))
    return patterns.withColumn("strength", new).where(F.col("strength") >= least)


def strong(patterns: DataFrame, threshold: float) -> DataFrame:
    """W11."""
    return patterns.where(F.col("strength") >= threshold)


def pattern_stats(patterns: DataFrame) -> DataFrame:
    """(patterns, hard_rules, avg_strength, max_strength)."""
    return patterns.agg(F.count("*").alias("patterns"), F.count("promoted_at").alias("hard_rules"), F.coalesce(F.avg("strength"), F.lit(0.0)).alias("avg_strength"), F.coalesce(F.max("strength"), F.lit(0.0)).alias("max_strength"))


def rule_fits(rule: Column, path: Column) -> Column:
    """The rule names the path's extension, or the path has one of the rule's words of more than three bytes."""
    ext = F.regexp_extract(path, r"(\.[^.]*)$", 1)
    words = F.filter(F.split(F.trim(rule), r"\s+"), lambda w: F.octet_length(w) > 3)
    return ((ext != "") & F.lower(rule).contains(ext)) | F.exists(words, lambda w: F.lower(path).contains(F.lower(w)))


def leases(requests: DataFrame, seconds: float = 300.0) -> DataFrame:
    """(path, seq, agent_id, op, outcome, expires_at) of requests (path, seq, ts, agent_id, op): acquire (again by the holder: extended; an expired one is taken over), release, extend."""
    from datetime import timedelta

    def step(lease, row):
        ts, agent, op = row["ts"], row["agent_id"], row["op"]
        until = ts + timedelta(seconds=seconds)
        out = {"path": row["path"], "seq": row["seq"], "agent_id": agent, "op": op}
        if op == "acquire":
            if not agent:
                return lease, out | {"outcome": "invalid", "expires_at": None}
            if lease is None or lease[0] == agent or ts >= lease[1]:
                return (agent, until), out | {"outcome": "extended" if lease and lease[0] == agent else "granted", "expires_at": until}
            return lease, out | {"outcome": "denied", "expires_at": lease[1]}
        if lease is None:
            return lease, out | {"outcome": "not_locked", "expires_at": None}
        if lease[0] != agent:
            return lease, out | {"outcome": "denied", "expires_at": lease[1]}
        if op == "release":
            return None, out | {"outcome": "released", "expires_at": None}
        return (agent, until), out | {"outcome": "extended", "expires_at": until}

    rows = requests.select("path", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "agent_id", "op")
    return fold(rows, ["path"], ["ts", "seq"], lambda key: None, step, "path string, seq bigint, agent_id string, op string, outcome string, expires_at timestamp_ntz")


def circuit(calls: DataFrame, threshold: int = 5, timeout: float = 30.0, half_open: int = 3) -> DataFrame:
    """(key, seq, allowed, state) of calls (key, seq, ts, ok): closed, open after ``threshold`` failures, half open ``timeout`` seconds later, closed again after ``half_open`` successes. A call that is not allowed has no result."""

    def step(s, row):
        state, failures, successes, last = s
        if state == "open":
            if (row["ts"] - last).total_seconds() <= timeout:
                return s, {"key": row["key"], "seq": row["seq"], "allowed": False, "state": state}
            state, successes = "half_open", 0
        if row["ok"]:
            if state == "closed":
                failures = 0
            else:
                successes += 1
                if successes >= half_open:
                    state, failures = "closed", 0
        else:
            failures, last = failures + 1, row["ts"]
            if state == "half_open" or failures >= threshold:
                state = "open"
        return (state, failures, successes, last), {"key": row["key"], "seq": row["seq"], "allowed": True, "state": state}

    rows = calls.select("key", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "ok")
    return fold(rows, ["key"], ["ts", "seq"], lambda key: ("closed", 0, 0, None), step, f"key {calls.schema['key'].dataType.simpleString()}, seq bigint, allowed boolean, state string")


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, seq, allowed, tokens) of requests (key, seq, ts): ``rate`` tokens a second, at most ``burst``, full at first."""

    def step(s, row):
        tokens, last = s
        if last is not None:
            tokens = min(burst, tokens + (row["ts"] - last).total_seconds() * rate)
        ok = tokens >= 1.0
        tokens -= 1.0 if ok else 0.0
        return (tokens, row["ts"]), {"key": row["key"], "seq": row["seq"], "allowed": ok, "tokens": tokens}

    rows = requests.select("key", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return fold(rows, ["key"], ["ts", "seq"], lambda key: (float(burst), None), step, f"key {requests.schema['key'].dataType.simpleString()}, seq bigint, allowed boolean, tokens double")


def backoff(attempt: Column, initial: float = 1.0, multiplier: float = 2.0, most: float = 60.0) -> Column:
    """The bound, in seconds, below which the delay is drawn; 0 before the first attempt."""
    return F.when(attempt <= 0, 0.0).otherwise(F.least(F.lit(initial) * F.pow(F.lit(multiplier), attempt), F.lit(most)))


def retryable(status: Column) -> Column:
    """W15. Fixed values."""
    return status.isin(429, 500, 502, 503, 504)
