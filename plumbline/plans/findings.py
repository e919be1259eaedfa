"""Queries of the findings and scorecard operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import findings as fi
from plumbline.operators import fleet as fl
from plumbline.plans.tables import frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Findings from events; the families of rule ids follow the user.
FINDINGS = """
SELECT seq, rule_id, prefix, category, rule, level, CASE WHEN level IN ('error', 'warning', 'note') THEN level ELSE 'none' END AS severity, message, file, line, tool, ts,
       sha2(concat(rule_id, chr(0), file, chr(0), CAST(line AS STRING)), 256) AS fingerprint
FROM (
  SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN 'deps.dependabot.' WHEN 1 THEN 'ast.complexity.' WHEN 2 THEN 'adr.conflict.' WHEN 3 THEN 'standards.gap.' ELSE '' END || CASE WHEN value > 100 THEN 'big.' ELSE '' END || event_type AS rule_id,
         CASE user_id % 5 WHEN 0 THEN 'deps.dependabot' WHEN 1 THEN 'ast.complexity' WHEN 2 THEN 'adr.conflict' WHEN 3 THEN 'standards.gap' ELSE 'sarif' END AS prefix,
         CASE WHEN user_id % 5 < 4 AND value > 100 THEN 'big' ELSE '' END AS category, CASE WHEN user_id % 5 = 4 AND value > 100 THEN 'big.' ELSE '' END || event_type AS rule,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'note' END AS level,
         'seen at user/' || user_id || '.go:' || regexp_extract(props, '([0-9]+)', 1) || ' by ' || event_type AS message,
         'user/' || user_id || '.go' AS file, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS line, 'tool' || (user_id % 3) AS tool, ts
  FROM events) AS e
"""
_DUCK = FINDINGS.replace("sha2(concat(rule_id, chr(0), file, chr(0), CAST(line AS STRING)), 256)", "sha256(rule_id || chr(0) || file || chr(0) || line)")
_WITH = f"WITH RECURSIVE f AS ({_DUCK})"


def _findings(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, FINDINGS))
    ORACLES[name] = _WITH + sql


def _documents(f: DataFrame) -> DataFrame:
    return fi.reports_of(f).select(F.lit(0).cast("bigint").alias("seq"), "doc")


_findings("s12_f01_flatten_reports", lambda f: fi.flatten(fi.parse_reports(_documents(f))).select("rule_id", "level", "message", "file", "line", "tool", "tool_version"), " SELECT rule_id, level, message, file, line, tool, '1.0' AS tool_version FROM f")
_findings(
    "s13_report_export",
    lambda f: fi.reports_of(f).select("tool", F.get_json_object("doc", "$.version").alias("version"), F.size(F.from_json("doc", fi.REPORT_SCHEMA)["runs"][0]["results"]).cast("long").alias("n")).groupBy("tool", "version").agg(F.sum("n").alias("n_results")),
    " SELECT tool, '2.1.0' AS version, count(*) AS n_results FROM f GROUP BY tool",
)
_findings(
    "f02_pick_fingerprint",
    lambda f: f.select("seq", fi.pick_fingerprint(F.when(F.col("tool") == "tool1", F.create_map(F.lit("vulnerability/v1"), F.col("rule_id"), F.lit("other"), F.lit("x"))), F.col("rule_id"), F.col("file"), F.col("line")).alias("fingerprint")),
    " SELECT seq, CASE WHEN tool = 'tool1' THEN rule_id ELSE fingerprint END AS fingerprint FROM f",
)
_findings("f03_fingerprint", lambda f: f.select("seq", fi.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")).alias("fingerprint")), " SELECT seq, fingerprint FROM f")
_findings("f04_normalise_rule", lambda f: f.select("seq", fi.normalise_rule(F.col("rule_id")).alias("r")).select("seq", "r.*"), " SELECT seq, prefix, category, rule FROM f")
_findings(
    "f05_severity",
    lambda f: f.select("seq", fi.severity(F.col("level")).alias("severity"), fi.severity_weight(fi.severity(F.col("level"))).alias("weight")),
    " SELECT seq, severity, CASE severity WHEN 'error' THEN 4 WHEN 'warning' THEN 3 WHEN 'note' THEN 2 ELSE 0 END AS weight FROM f",
)
_findings(
    "f06_summary",
    fi.summary,
    """ SELECT 'total' AS part, '' AS name, count(*) AS n FROM f UNION ALL SELECT 'files', '', count(DISTINCT file) FROM f WHERE file <> ''
    UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity UNION ALL SELECT 'tool', tool, count(*) FROM f GROUP BY tool UNION ALL SELECT 'prefix', prefix, count(*) FROM f GROUP BY prefix
    UNION ALL SELECT * FROM (SELECT 'rule', rule_id, count(*) FROM f GROUP BY rule_id ORDER BY 3 DESC, 2 LIMIT 10)""",
)
_FP = ", k AS (SELECT *, min(seq) OVER (PARTITION BY fingerprint) AS kept_seq, count(*) OVER (PARTITION BY fingerprint) AS group_size FROM f)"
_findings("f07_dedup_fingerprint", lambda f: fi.dedup_fingerprint(f).select("seq", "kept_seq", "group_size", "duplicate"), _FP + " SELECT seq, kept_seq, group_size, seq <> kept_seq AS duplicate FROM k")
_findings(
    "f07_dedup_ratio",
    lambda f: fi.dedup_ratio(fi.dedup_fingerprint(f)).withColumn("ratio", F.round("ratio", 9)),
    _FP + " SELECT count(*) AS original, count(*) FILTER (seq = kept_seq) AS kept, count(*) FILTER (seq <> kept_seq) AS removed, round(avg((seq <> kept_seq)::INT), 9) AS ratio, avg((seq <> kept_seq)::INT) >= 0.3 AS target_met FROM k",
)
_WINDOW = """, o AS (SELECT seq, rule_id, file, line, ts, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY ts, seq) AS k FROM {0}),
w AS (SELECT *, seq AS kept_seq, ts AS kept_ts, false AS duplicate FROM o WHERE k = 1
  UNION ALL SELECT o.*, CASE WHEN o.ts - kept_ts <= INTERVAL {1} HOUR THEN kept_seq ELSE o.seq END, CASE WHEN o.ts - kept_ts <= INTERVAL {1} HOUR THEN kept_ts ELSE o.ts END, o.ts - kept_ts <= INTERVAL {1} HOUR
  FROM w JOIN o ON o.rule_id = w.rule_id AND o.file = w.file AND o.line = w.line AND o.k = w.k + 1)"""
_findings("f08_dedup_window", lambda f: fi.dedup_window(f, 96).select("seq", "kept_seq", "duplicate"), _WINDOW.format("f", 96) + " SELECT seq, kept_seq, duplicate FROM w")
_TRUST = "CASE prefix WHEN 'deps.dependabot' THEN 1 WHEN 'ast.complexity' THEN 2 WHEN 'adr.conflict' THEN 3 WHEN 'standards.gap' THEN 4 ELSE 5 END"
for _merge in (False, True):
    _key = ("" if _merge else "prefix, ") + "rule, file, line"
    _findings(
        f"f09_dedup_cross_tool{'_merged' if _merge else ''}",
        lambda f, merge=_merge: fi.dedup_cross_tool(f, merge).select("seq", "kept_seq", "duplicate", "recorded"),
        f", k AS (SELECT *, first(seq) OVER w AS kept_seq, first(fingerprint) OVER w AS fp FROM f WINDOW w AS (PARTITION BY {_key} ORDER BY {_TRUST}, seq)) SELECT seq, kept_seq, seq <> kept_seq AS duplicate, seq <> kept_seq AND fingerprint <> fp AS recorded FROM k",
    )
_findings(
    "f10_dedup_pipeline",
    lambda f: fi.dedup_all(f, hours=96).select("seq"),
    ", a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY prefix, rule, file, line ORDER BY seq) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1)"
    + _WINDOW.format("b", 96)
    + " SELECT seq FROM w WHERE NOT duplicate",
)
_findings(
    "f11_staleness_action",
    lambda f: f.select("seq", *[fi.staleness_action(F.col("line").cast("double"), 24.0, m).alias(m) for m in ("block", "warn", "ignore")]),
    " SELECT seq, CASE WHEN line <= 24 THEN 'allow' ELSE 'block' END AS block, CASE WHEN line <= 24 THEN 'allow' ELSE 'warn' END AS warn, 'allow' AS ignore FROM f",
)
_findings(
    "f12_locate",
    lambda f: fi.locate(
        f.select("seq", F.when(F.col("tool") == "tool0", F.col("file")).alias("file"), "line", F.when(F.col("level") != "note", F.col("message")).alias("message"), F.when(F.col("tool") == "tool1", F.create_map(F.lit("file_path"), F.col("rule"), F.lit("line"), F.col("line").cast("string"))).alias("metadata"))
    ),
    r""" SELECT seq, CASE WHEN tool = 'tool0' THEN file WHEN tool = 'tool1' THEN rule WHEN level <> 'note' THEN file ELSE '' END AS file, CASE WHEN tool <> 'tool2' OR level <> 'note' THEN line ELSE 0 END AS line,
    CASE WHEN tool = 'tool0' THEN 'sarif' WHEN tool = 'tool1' THEN 'metadata' WHEN level <> 'note' THEN 'description' ELSE 'unknown' END AS source FROM f""",
)


def _collide(strategy: str) -> Callable[[DataFrame], DataFrame]:
    def run(f: DataFrame) -> DataFrame:
        existing = f.where("tool = 'tool1'").select("rule_id").union(f.where("tool = 'tool2' AND line < 3").select(F.concat_ws(".", "rule_id", (F.col("line") + 1).cast("string"))))
        return fi.resolve_collisions(f.select("rule_id").distinct(), existing, strategy)

    return run


_TAKEN = ", e AS (SELECT rule_id FROM f WHERE tool = 'tool1' UNION SELECT rule_id || '.' || (line + 1) FROM f WHERE tool = 'tool2' AND line < 3), r AS (SELECT DISTINCT rule_id, rule_id IN (SELECT rule_id FROM e) AS conflict FROM f)"
_findings(
    "f13_collisions_prefix",
    _collide("prefix"),
    _TAKEN + " SELECT rule_id, CASE WHEN NOT conflict THEN rule_id WHEN contains(rule_id, '.') THEN regexp_replace(rule_id, '^([^.]*)[.]', '\\1.dup.') ELSE 'unknown.dup.' || rule_id END AS resolved_id, CASE WHEN conflict THEN 'prefix' ELSE 'none' END AS strategy, conflict FROM r",
)
_findings(
    "f13_collisions_suffix",
    _collide("suffix"),
    _TAKEN + " SELECT rule_id, CASE WHEN NOT conflict THEN rule_id ELSE rule_id || '.' || (SELECT min(n) FROM (SELECT unnest(range(1, 9)) AS n) WHERE rule_id || '.' || n NOT IN (SELECT rule_id FROM e)) END AS resolved_id, CASE WHEN conflict THEN 'suffix' ELSE 'none' END AS strategy, conflict FROM r",
)
_findings("f13_collisions_reject", _collide("reject"), _TAKEN + " SELECT rule_id, CASE WHEN conflict THEN '' ELSE rule_id END AS resolved_id, CASE WHEN conflict THEN 'reject' ELSE 'none' END AS strategy, conflict FROM r")
_findings("f13_collisions_none", _collide("none"), _TAKEN + " SELECT rule_id, rule_id AS resolved_id, 'none' AS strategy, conflict FROM r")
_findings("f14_dispatch_fallback", lambda f: f.select("seq", fi.fallback(F.col("rule"), F.col("level") != "error").alias("x")).select("seq", "x.*"), " SELECT seq, CASE WHEN level = 'error' THEN 'fallback' ELSE 'dispatched' END AS status, CASE WHEN level = 'error' THEN 'retry later' ELSE '' END AS advice FROM f")
_findings("f15_sla", lambda f: fi.sla(f).withColumn("regression_rate", F.round("regression_rate", 9)), " SELECT count(*) AS total, count(*) FILTER (severity IN ('error', 'warning')) AS open, count(*) FILTER (severity NOT IN ('error', 'warning')) AS closed, round(avg((severity NOT IN ('error', 'warning'))::INT), 9) AS regression_rate FROM f")
_findings("f20_external_severity", lambda f: f.groupBy(fi.external_severity(F.col("severity")).alias("severity")).agg(F.count("*").alias("n")), " SELECT CASE severity WHEN 'error' THEN 'High' WHEN 'warning' THEN 'Medium' WHEN 'note' THEN 'Low' ELSE 'Info' END AS severity, count(*) AS n FROM f GROUP BY 1")

#: Scorecards from customers and their orders.
_SCORES = """
SELECT c_custkey AS seq, 'r' || c_custkey AS repo_id, c_name AS repo_name, CASE WHEN c_acctbal < 0 THEN '' ELSE 'n' || c_nationkey END AS connection_id,
       CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS DOUBLE) AS score, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 THEN CAST(0 AS DOUBLE) ELSE CAST(count(o_orderkey) AS DOUBLE) END AS max_score,
       count(o_orderkey) AS n_checks, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS n_passed
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_acctbal, c_nationkey, c_mktsegment
"""
_CHECKS = "SELECT 'r' || o_custkey AS repo_id, 'k' || o_orderkey AS check_id, o_orderpriority AS name, o_orderstatus = 'F' AS passed, o_orderpriority AS category FROM orders"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = frame(spark, sf_dir, _CHECKS).groupBy("repo_id").agg(F.collect_list(F.struct("check_id", "name", "passed", "category")).alias("checks"))
    return frame(spark, sf_dir, _SCORES).join(checks, "repo_id", "left")


def _fleet(name: str, run: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(_scores(spark, sf_dir))
    ORACLES[name] = f"WITH s AS ({_SCORES}), p AS (SELECT *, CASE WHEN max_score > 0 THEN score / max_score END AS pct FROM s), h AS (SELECT *, CASE WHEN coalesce(pct, 0) >= 0.8 THEN 'healthy' WHEN coalesce(pct, 0) >= 0.5 THEN 'degraded' ELSE 'critical' END AS health_tier FROM p)" + sql


def _tiers(s: DataFrame) -> DataFrame:
    pct = F.coalesce(fl.share(F.col("score"), F.col("max_score")), F.lit(0.0))
    return s.select("seq", F.col("repo_id").alias("path"), F.col("repo_name").alias("name"), pct.alias("score"), fl.tier(pct).alias("health_tier"), F.create_map(F.lit("c"), F.col("connection_id")).alias("labels"))


_fleet("f16_fleet_average", lambda s: fl.fleet_average(s).withColumn("average", F.round("average", 9)), " SELECT count(*) AS repos, round(sum(coalesce(pct, 0)) / count(*), 9) AS average FROM p")
_fleet(
    "f17_fleet_metrics",
    fl.fleet_metrics,
    """ SELECT count(*) AS total_repos, least(min(pct), 1) AS min_score, greatest(max(pct), 0) AS max_score, count(*) FILTER (pct >= 0.8) AS passing_repos, count(*) FILTER (pct < 0.5) AS failing_repos,
    count(DISTINCT nullif(connection_id, '')) AS connections, sum(n_checks)::BIGINT AS total_checks, sum(n_passed)::BIGINT AS passing_checks, sum(n_checks - n_passed)::BIGINT AS failing_checks FROM p""",
)
_fleet("f18_by_connection", fl.by_connection, " SELECT CASE WHEN connection_id = '' THEN '__unknown__' ELSE connection_id END AS connection, count(*) AS repos, sum(score) AS score, sum(max_score) AS max_score FROM s GROUP BY 1")
_fleet(
    "f19_moved",
    lambda s: fl.moved(s, s.withColumn("connection_id", F.when(F.col("score") > 5, F.concat("connection_id", F.lit("x"))).otherwise(F.col("connection_id")))),
    " SELECT repo_id, connection_id AS old, connection_id || 'x' AS new FROM s WHERE score > 5",
)
_RESULTS = "SELECT 'm' || c_nationkey AS remediation_id, 'r' || c_custkey AS repo_id, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_mktsegment = 'BUILDING' THEN 'skipped' ELSE 'success' END AS status, CASE WHEN c_acctbal < -500 THEN 'i/o timeout' ELSE 'bad config' END AS message FROM customer"
QUERIES["f21_remediation_summary"] = lambda spark, sf_dir: fl.remediation_summary(frame(spark, sf_dir, _RESULTS))
ORACLES["f21_remediation_summary"] = (
    f"WITH r AS ({_RESULTS}), t AS (SELECT remediation_id, count(*) AS total, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM r GROUP BY 1) SELECT *, failed = 0 AS is_complete, failed > 0 AND succeeded > 0 AS is_partial FROM t"
)
QUERIES["f22_transient_errors"] = lambda spark, sf_dir: fl.failed_repos(frame(spark, sf_dir, _RESULTS)).select("repo_id", fl.is_transient(F.col("message")).alias("transient"))
ORACLES["f22_transient_errors"] = f"SELECT repo_id, message = 'i/o timeout' AS transient FROM ({_RESULTS}) WHERE status = 'failed'"
_COUNCIL = """SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'reliability' WHEN 3 THEN 'maintainability' ELSE 'compliance' END AS persona,
CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END AS severity,
CASE WHEN value > 150 THEN 'standards-gap' ELSE 'other' END AS category, event_type AS title, props AS message, 'fix ' || event_type AS remediation FROM events"""
QUERIES["f23_council_report"] = lambda spark, sf_dir: fl.council_report(frame(spark, sf_dir, _COUNCIL), ("security", "compliance"))
ORACLES["f23_council_report"] = f"SELECT count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in fl.SEVERITIES)} FROM ({_COUNCIL}) WHERE persona IN ('security', 'compliance')"
QUERIES["f24_standards_gaps"] = lambda spark, sf_dir: fl.standards_gaps(frame(spark, sf_dir, _COUNCIL))
ORACLES["f24_standards_gaps"] = f"SELECT id, 'ADR: ' || title AS adr_title, message AS adr_summary, 'Detected by ' || persona || ' persona during governance review' AS adr_context, remediation AS proposed FROM ({_COUNCIL}) WHERE category = 'standards-gap'"
_fleet(
    "f25_portfolio_summary",
    lambda s: fl.portfolio_summary(_tiers(s)).withColumn("average", F.round("average", 9)),
    " SELECT count(*) AS total, count(*) FILTER (health_tier = 'healthy') AS healthy, count(*) FILTER (health_tier = 'degraded') AS degraded, count(*) FILTER (health_tier = 'critical') AS critical, 0::BIGINT AS unknown, round(avg(coalesce(pct, 0)), 9) AS average FROM h",
)
_fleet("f26_in_tier", lambda s: fl.in_tier(_tiers(s), "degraded").select("path", "score"), " SELECT repo_id AS path, coalesce(pct, 0) AS score FROM h WHERE health_tier = 'degraded'")
_fleet(
    "f27_cross_repo_health",
    lambda s: fl.cross_repo_health(_tiers(s)).select(F.round("overall_score", 9).alias("overall_score"), "overall_tier", F.array_join("best", ",").alias("best"), F.array_join("worst", ",").alias("worst")),
    """ SELECT round(avg(coalesce(pct, 0)), 9) AS overall_score, CASE WHEN avg(coalesce(pct, 0)) >= 0.8 THEN 'healthy' WHEN avg(coalesce(pct, 0)) >= 0.5 THEN 'degraded' ELSE 'critical' END AS overall_tier,
    array_to_string((SELECT list(repo_name ORDER BY p DESC, seq) FROM (SELECT repo_name, seq, coalesce(pct, 0) AS p FROM h ORDER BY p DESC, seq LIMIT 5)), ',') AS best,
    array_to_string((SELECT list(repo_name ORDER BY p, seq) FROM (SELECT repo_name, seq, coalesce(pct, 0) AS p FROM h ORDER BY p, seq LIMIT 5)), ',') AS worst FROM h""",
)
_fleet("f28_portfolio_query", lambda s: fl.portfolio_query(_tiers(s), min_score=0.2, label=("c", "n3"), limit=20, offset=5).select("path", "score"), " SELECT repo_id AS path, coalesce(pct, 0) AS score FROM h WHERE coalesce(pct, 0) >= 0.2 AND connection_id = 'n3' ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5")
