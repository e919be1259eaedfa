"""Queries of the sequence operators, in batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import sequences as sq
from plumbline.plans.tables import frame
from plumbline.streaming import streams as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, view))
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE v AS ({view}){sql}"


_SNAPSHOT = "SELECT 'f/' || o_orderkey AS path, o_custkey AS size, o_orderdate AS mod_time, o_orderstatus AS s, o_orderpriority AS p FROM orders"


def _after(v: DataFrame) -> DataFrame:
    moved = v.where("s <> 'F'").select(F.when(F.col("p") == "1-URGENT", F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(F.col("p") == "2-HIGH", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mod_time")
    return moved


_add(
    "w01_snapshot_changes",
    _SNAPSHOT,
    lambda v: sq.changes(v.select("path", "size", "mod_time"), _after(v)),
    " SELECT path, CASE WHEN s = 'F' OR p = '1-URGENT' THEN 'deleted' ELSE 'modified' END AS change FROM v WHERE s = 'F' OR p IN ('1-URGENT', '2-HIGH') UNION ALL SELECT path || 'x', 'created' FROM v WHERE s <> 'F' AND p = '1-URGENT'",
)
_PATHS = "SELECT 'src/' || p_type || '/' || replace(p_name, ' ', '/') || CASE WHEN p_size > 25 THEN '.go' ELSE '.md' END AS path, p_partkey AS id FROM part"
_add("w02_included_paths", _PATHS, lambda v: v.where(sq.included(F.col("path"), ("**/*.go", "src/PROMO/**"), ("red", "**/ring.*"))).select("id", "path"), " SELECT id, path FROM v WHERE (suffix(path, '.go') OR starts_with(path, 'src/PROMO/')) AND NOT contains(path, '/red/') AND NOT regexp_matches(path, '/ring[.][^/]*$')")
_EVENTS = "SELECT event_id AS seq, ts, user_id, event_type, value, 'u' || user_id AS key FROM events"
_add("w03_last_events", _EVENTS, lambda v: sq.last_events(v, 100).select("seq"), " SELECT seq FROM v ORDER BY ts DESC, seq DESC LIMIT 100")
_SAMPLES = "SELECT 'u' || user_id AS key, event_id AS seq, ts, value / 300 AS score FROM events"
_add(
    "w05_ewma_drift",
    _SAMPLES,
    lambda v: sq.ewma(v).select("key", "seq", F.round("ewma", 6).alias("ewma"), F.round("drift", 6).alias("drift"), "alert"),
    """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS k FROM v),
    w AS (SELECT key, seq, score, k, score AS ewma, 0::DOUBLE AS drift FROM o WHERE k = 1 UNION ALL SELECT o.key, o.seq, o.score, o.k, 0.3::DOUBLE * o.score + (1 - 0.3::DOUBLE) * w.ewma, abs(o.score - (0.3::DOUBLE * o.score + (1 - 0.3::DOUBLE) * w.ewma)) FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)
    SELECT key, seq, round(ewma, 6) AS ewma, round(drift, 6) AS drift, drift > 0.15 AND k > 5 AS alert FROM w""",
)


def _scopes(v: DataFrame) -> DataFrame:
    return sq.scope_overlaps(v.select(F.col("path").alias("agent_id"), F.array(F.concat(F.lit("src/"), "s", F.lit("*")), F.concat(F.lit("doc/"), "n")).alias("scope")))


_AGENTS = "SELECT 'a' || s_suppkey AS path, CASE WHEN s_acctbal < 0 THEN '' ELSE 'N' || s_nationkey || '/' END AS s, s_name AS n FROM supplier"
_add(
    "w06_scope_overlaps",
    _AGENTS,
    _scopes,
    """, x AS (SELECT path AS agent, 'src/' || s || '*' AS scope, 'src/' || s AS clean FROM v UNION ALL SELECT path, 'doc/' || n, 'doc/' || n FROM v)
    SELECT a.agent AS agent_a, b.agent AS agent_b, a.scope AS scope_a, b.scope AS scope_b FROM x a JOIN x b ON a.agent < b.agent AND (starts_with(a.clean, b.clean) OR starts_with(b.clean, a.clean))""",
)
_LIFE = "SELECT 'u' || user_id AS agent_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'deregister' WHEN 'purchase' THEN 'handoff' ELSE 'checkpoint' END AS op FROM events"
_add("w07_active_agents", _LIFE, sq.active_agents, " SELECT agent_id, CASE op WHEN 'handoff' THEN 'handed_off' ELSE 'active' END AS status, ts FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, seq DESC) = 1) WHERE op <> 'deregister'")
_STATES = "SELECT 'u' || user_id AS key, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'idle' WHEN 'error' THEN 'fixing' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'working' ELSE 'handoff' END AS to_state FROM events"
_OK = "(f = 'idle' AND t = 'working' OR f = 'working' AND t IN ('fixing', 'handoff', 'done', 'idle') OR f = 'fixing' AND t IN ('working', 'done', 'handoff') OR f IN ('handoff', 'done') AND t IN ('idle', 'working'))"
_add(
    "w08_state_machine",
    _STATES,
    sq.state_machine,
    f""", o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS k FROM v),
    w AS (SELECT key, k, seq, 'idle' AS f, to_state AS t FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.seq, CASE WHEN {_OK} THEN w.t ELSE w.f END, o.to_state FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)
    SELECT key, seq, f AS from_state, t AS to_state, {_OK} AS valid FROM w""",
)
_add(
    "w08_valid_pairs",
    _STATES,
    lambda v: v.select("key", "seq", "to_state", F.expr("lag(to_state) OVER (PARTITION BY key ORDER BY ts, seq)").alias("f")).select("key", "seq", F.coalesce(sq.valid_transition(F.col("f"), F.col("to_state")), F.lit(False)).alias("valid")),
    f" SELECT key, seq, coalesce({_OK}, false) AS valid FROM (SELECT key, seq, to_state AS t, lag(to_state) OVER (PARTITION BY key ORDER BY ts, seq) AS f FROM v)",
)
_OBS = "SELECT event_type || '/' || (user_id % 100) AS pattern_id, event_id AS seq, ts FROM events"
_LEARNT = """, o AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY ts, seq) AS k FROM v),
w AS (SELECT pattern_id, k, ts, 0.1::DOUBLE AS s, NULL::BIGINT AS promoted FROM o WHERE k = 1 UNION ALL
  SELECT o.pattern_id, o.k, o.ts, floor((w.s + 0.1::DOUBLE * (1 - w.s)) * 1000 + 0.5::DOUBLE) / 1000, CASE WHEN w.promoted IS NOT NULL THEN w.promoted WHEN floor((w.s + 0.1::DOUBLE * (1 - w.s)) * 1000 + 0.5::DOUBLE) / 1000 >= 0.9::DOUBLE THEN o.seq END FROM w JOIN o ON o.pattern_id = w.pattern_id AND o.k = w.k + 1),
p AS (SELECT pattern_id, max(k) AS n, max_by(s, k) AS strength, max_by(ts, k) AS last_seen, any_value(promoted) AS promoted_at FROM w GROUP BY pattern_id)"""
_add("w09_pattern_learning", _OBS, sq.learn, _LEARNT + " SELECT * FROM p")
_LEFT = "strength - 0.01::DOUBLE * (1 + date_sub('second', last_seen, TIMESTAMP '2024-02-10 00:00:00') / 3600.0::DOUBLE / 24)"
_add("w10_pattern_decay", _OBS, lambda v: sq.decay_patterns(sq.learn(v), "2024-02-10 00:00:00").select("pattern_id", F.round("strength", 6).alias("strength")), _LEARNT + f" SELECT pattern_id, round({_LEFT}, 6) AS strength FROM p WHERE greatest({_LEFT}, 0) >= 0.1")
_add("w11_pattern_stats", _OBS, lambda v: sq.pattern_stats(sq.strong(sq.learn(v), 0.5)).withColumn("avg_strength", F.round("avg_strength", 6)), _LEARNT + " SELECT count(*) AS patterns, count(promoted_at) AS hard_rules, round(avg(strength), 6) AS avg_strength, max(strength) AS max_strength FROM p WHERE strength >= 0.5")
_RULES = "SELECT n_name AS id, CASE WHEN n_regionkey = 1 THEN 'keep every .go file small' ELSE 'a PROMO or red part' END AS rule FROM nation"


def _w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, paths = frame(spark, sf_dir, _RULES).select("rule").distinct(), frame(spark, sf_dir, _PATHS).select("id", "path")
    return rules.join(paths, sq.rule_fits(F.col("rule"), F.col("path"))).select("rule", "id")


QUERIES["w11_rule_matches"] = _w11
ORACLES["w11_rule_matches"] = (
    f"WITH r AS (SELECT DISTINCT rule FROM ({_RULES})), p AS ({_PATHS}) SELECT rule, id FROM r, p WHERE contains(lower(rule), regexp_extract(path, '([.][^.]*)$', 1)) OR len(list_filter(string_split(rule, ' '), lambda w: strlen(w) > 3 AND contains(lower(path), lower(w)))) > 0"
)
_LEASES = "SELECT event_type AS path, event_id AS seq, ts, 'u' || (user_id / 50) AS agent_id, CASE WHEN value > 80 THEN 'release' WHEN value > 60 THEN 'extend' ELSE 'acquire' END AS op FROM events".replace("(user_id / 50)", "CAST(floor(user_id / 50) AS INT)")
_NUMBERED = ", o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, seq) AS k FROM v), w AS (SELECT DISTINCT {key}, 0::BIGINT AS k, {start} FROM v UNION ALL SELECT {step})"
_add(
    "w12_leases",
    _LEASES,
    lambda v: sq.leases(v, 3600),
    _NUMBERED.format(
        key="path",
        start="NULL::BIGINT AS seq, NULL::VARCHAR AS agent_id, NULL::VARCHAR AS op, NULL::VARCHAR AS outcome, NULL::TIMESTAMP AS expires_at, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS until",
        step="""path, k, seq, agent_id, op, outcome, CASE WHEN outcome IN ('granted', 'extended') THEN ts + INTERVAL 1 HOUR WHEN outcome = 'denied' THEN until END,
      CASE WHEN outcome IN ('granted', 'extended') THEN agent_id WHEN outcome <> 'released' THEN holder END, CASE WHEN outcome IN ('granted', 'extended') THEN ts + INTERVAL 1 HOUR WHEN outcome <> 'released' THEN until END
    FROM (SELECT o.path, o.k, o.seq, o.agent_id, o.op, o.ts, w.holder, w.until, CASE
        WHEN o.op = 'acquire' THEN CASE WHEN coalesce(o.agent_id, '') = '' THEN 'invalid' WHEN w.holder = o.agent_id THEN 'extended' WHEN w.holder IS NULL OR o.ts >= w.until THEN 'granted' ELSE 'denied' END
        WHEN w.holder IS NULL THEN 'not_locked' WHEN w.holder IS DISTINCT FROM o.agent_id THEN 'denied' WHEN o.op = 'release' THEN 'released' ELSE 'extended' END AS outcome
      FROM w JOIN o ON o.path = w.path AND o.k = w.k + 1)""",
    )
    + " SELECT path, seq, agent_id, op, outcome, expires_at FROM w WHERE k > 0",
)
_CALLS = "SELECT 'u' || user_id AS key, event_id AS seq, ts, event_type NOT IN ('error', 'click', 'view') AS ok FROM events"
_add(
    "w13_circuit_breaker",
    _CALLS,
    lambda v: sq.circuit(v, 3, 86400.0),
    _NUMBERED.format(
        key="key",
        start="NULL::BIGINT AS seq, true AS allowed, 'closed' AS state, 0 AS failures, 0 AS successes, NULL::TIMESTAMP AS failed",
        step="""key, k, seq, now <> 'open', CASE WHEN now = 'open' THEN 'open' WHEN NOT ok THEN CASE WHEN now = 'half_open' OR failures + 1 >= 3 THEN 'open' ELSE now END WHEN now = 'half_open' AND successes + 1 < 3 THEN 'half_open' ELSE 'closed' END,
      CASE WHEN now = 'open' THEN failures WHEN NOT ok THEN failures + 1 WHEN now = 'half_open' AND successes + 1 < 3 THEN failures ELSE 0 END,
      CASE WHEN now = 'half_open' AND ok THEN successes + 1 ELSE successes END, CASE WHEN now <> 'open' AND NOT ok THEN ts ELSE failed END
    FROM (SELECT o.key, o.k, o.seq, o.ts, o.ok, w.failures, w.failed, CASE WHEN w.state = 'open' AND o.ts - w.failed > INTERVAL 24 HOUR THEN 'half_open' ELSE w.state END AS now,
        CASE WHEN w.state = 'open' AND o.ts - w.failed > INTERVAL 24 HOUR THEN 0 ELSE w.successes END AS successes FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)""",
    )
    + " SELECT key, seq, allowed, state FROM w WHERE k > 0",
)
_add(
    "w14_token_bucket",
    "SELECT 'u' || user_id AS key, event_id AS seq, ts FROM events",
    lambda v: sq.token_bucket(v, 1 / 14400, 3).withColumn("tokens", F.round("tokens", 6)),
    _NUMBERED.format(
        key="key",
        start="NULL::BIGINT AS seq, false AS allowed, 3::DOUBLE AS tokens, NULL::TIMESTAMP AS last",
        step="""key, k, seq, full_now >= 1, CASE WHEN full_now >= 1 THEN full_now - 1 ELSE full_now END, ts
    FROM (SELECT o.key, o.k, o.seq, o.ts, CASE WHEN w.last IS NULL THEN w.tokens ELSE least(3::DOUBLE, w.tokens + date_sub('microsecond', w.last, o.ts) / 1e6::DOUBLE * (1 / 14400::DOUBLE)) END AS full_now FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)""",
    )
    + " SELECT key, seq, allowed, round(tokens, 6) AS tokens FROM w WHERE k > 0",
)
_add("w15_backoff", "SELECT o_orderkey AS id, CAST(o_custkey % 9 AS INT) - 1 AS attempt, CAST(400 + o_custkey % 105 AS INT) AS status FROM orders", lambda v: v.select("id", sq.backoff(F.col("attempt")).alias("bound"), sq.retryable(F.col("status")).alias("retry")), " SELECT id, CASE WHEN attempt <= 0 THEN 0 ELSE least(pow(2, attempt), 60) END AS bound, status IN (429, 500, 502, 503, 504) AS retry FROM v")
_WINDOWS = "SELECT event_type, ts, user_id, value FROM events"
def _n():
    return F.count("*").alias("n")


def _plain_times(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


_add(
    "w18_windows",
    _WINDOWS,
    lambda v: _plain_times(st.windowed(v, "ts", "1 hour", _n(), F.round(F.sum("value"), 4).alias("total"), by=("event_type",))),
    " SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM v GROUP BY ALL",
)
_add(
    "w18_sliding_windows",
    _WINDOWS,
    lambda v: _plain_times(st.windowed(v, "ts", "3 hours", _n(), by=("event_type",), slide="1 hour")),
    ", x AS (SELECT event_type, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest([0, 1, 2]) AS start FROM v) SELECT start, start + INTERVAL 3 HOUR AS end, event_type, count(*) AS n FROM x GROUP BY ALL",
)
_add(
    "w18_sessions",
    _WINDOWS,
    lambda v: _plain_times(st.sessions(v, "ts", "6 hours", _n(), by=("user_id",))),
    ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM h GROUP BY user_id, k",
)
