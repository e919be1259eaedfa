"""Queries of the graph operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph as g
from plumbline.plans.tables import CUSTOMERS, EDGES, NATIONS, NODES, REFERRALS, TRADE, frame
from plumbline.session import shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_RUN: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

_WITH = f"WITH RECURSIVE edges AS ({EDGES}), nodes AS ({NODES}), trade AS ({TRADE}), nations AS ({NATIONS})"
_DEGREES = """, deg AS (
  SELECT id, coalesce(a, 0)::BIGINT AS fan_in, coalesce(b, 0)::BIGINT AS fan_out FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS a FROM edges GROUP BY dst) ON id = dst LEFT JOIN (SELECT src, count(*) AS b FROM edges GROUP BY src) ON id = src)"""


def _query(name: str, run: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None, nodes: str = NODES, edges: str = EDGES) -> None:
    """Registers ``run(nodes, edges)``; ``sql`` continues a WITH list of edges, nodes, trade and nations."""
    _RUN[name] = run
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, nodes), frame(spark, sf_dir, edges))
    if sql is not None:
        ORACLES[name] = _WITH + sql


def _walk(start: str, forward: bool = True, depth: int = 99, edges: str = "edges") -> str:
    """CTEs: walk(id, depth) of all walks' ends, reach(id, depth) with the least depth."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f""", step AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {edges}),
walk AS ({start} UNION SELECT b, depth + 1 FROM walk JOIN step ON id = a WHERE depth < {depth}),
reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


_ONE = "SELECT '{}' AS id, 0 AS depth"

_query("g01_direct_callers", lambda n, e: g.callers(e, "N:3"), " SELECT src AS id FROM edges WHERE dst = 'N:3'")
_query("g01_direct_callees", lambda n, e: g.callees(e, "P:7"), " SELECT dst AS id FROM edges WHERE src = 'P:7'")
_query("g02_fan_in_out", g.degrees, _DEGREES + " SELECT * FROM deg")
_query("g03_roots", g.roots, " SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
_query("g03_leaves", lambda n, e: g.leaves(n, e.where("call_type = 'interface'")), " SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE call_type = 'interface')")
_PARENTS = " SELECT r.id, r.depth::INT AS depth, (SELECT min(p.id) FROM step JOIN reach p ON p.id = a WHERE b = r.id AND p.depth = r.depth - 1) AS parent FROM reach r WHERE depth > 0"
_query("g_callees_within_3", lambda n, e: g.bounded(e, "P:7", 3), _walk(_ONE.format("P:7"), depth=3) + _PARENTS)
_query("g04_callers_within_10", lambda n, e: g.bounded(e, "R:1", 0, reverse=True), _walk(_ONE.format("R:1"), False, 10) + _PARENTS)
_query("g05_transitive_callers", lambda n, e: g.transitive(e, "N:3", 3, reverse=True), _walk(_ONE.format("N:3"), False, 3) + " SELECT id FROM reach WHERE depth > 0")
_query("g06_reachable", lambda n, e: g.reachable(e, e.where("src = 'P:7'").select(F.col("src").alias("id"))), _walk(_ONE.format("P:7")) + " SELECT id FROM reach")
_query("g06_reaching", lambda n, e: g.reachable(e, e.where("dst = 'N:3'").select(F.col("dst").alias("id")), reverse=True), _walk(_ONE.format("N:3"), False) + " SELECT id FROM reach")
_query("g07_reachable_from_many", lambda n, e: g.reachable(e, n.where("kind = 'function' AND exported")), _walk("SELECT id, 0 AS depth FROM nodes WHERE kind = 'function' AND exported") + " SELECT id FROM reach")
_CLOSURE = ", closure AS (SELECT DISTINCT src, dst FROM trade UNION SELECT c.src, t.dst FROM closure c JOIN trade t ON c.dst = t.src)"
_query("g08_transitive_closure", lambda n, e: g.closure(e), _CLOSURE + " SELECT * FROM closure", NATIONS, TRADE)
_SCC = (
    _CLOSURE
    + """, every AS (SELECT id FROM nations UNION SELECT src FROM trade UNION SELECT dst FROM trade),
scc AS (SELECT id, least(id, coalesce((SELECT min(x.dst) FROM closure x JOIN closure y ON x.dst = y.src AND y.dst = x.src WHERE x.src = id), id)) AS component FROM every),
comp AS (SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM scc)"""
)
_query("g09_cycles", g.cycles, _SCC + " SELECT * FROM comp WHERE size > 1", NATIONS, TRADE)
_query("g10_strong_components", g.strong_components, _SCC + " SELECT * FROM comp", NATIONS, TRADE)
_query(
    "g11_topological_order",
    g.topological,
    """, step AS (SELECT DISTINCT src, dst FROM edges), every AS (SELECT id FROM nodes UNION SELECT src FROM edges UNION SELECT dst FROM edges),
    up AS (SELECT id, 0 AS level FROM every WHERE id NOT IN (SELECT src FROM step) UNION SELECT src, level + 1 FROM up JOIN step ON dst = id)
    SELECT id, max(level)::INT AS level FROM up GROUP BY id""",
)
_query(
    "g12_impact",
    lambda n, e: g.impact(e, "N:3"),
    _walk(_ONE.format("N:3"), False)
    + """ SELECT 'N:3' AS node, (SELECT count(*) FROM edges WHERE dst = 'N:3') AS direct_callers, count(*) AS transitive_callers, count(*) - 1 AS affected,
    CASE WHEN count(*) > 51 THEN 'critical' WHEN count(*) > 21 THEN 'high' WHEN count(*) > 11 THEN 'medium' ELSE 'low' END AS risk_level FROM reach""",
)
_query("g13_degree_centrality", g.degree_centrality, _DEGREES + " SELECT id, (fan_in + fan_out)::DOUBLE AS degree FROM deg")
_query("g14_betweenness", g.betweenness, None, NATIONS, TRADE)
_query(
    "g15_closeness",
    g.closeness,
    """, step AS (SELECT DISTINCT src, dst FROM trade), walk AS (SELECT id AS s, id, 0 AS d FROM nations UNION SELECT s, dst, d + 1 FROM walk JOIN step ON id = src WHERE d < 26),
    near AS (SELECT s, id, min(d) AS d FROM walk WHERE s <> id GROUP BY s, id)
    SELECT id, coalesce((SELECT count(*) / sum(d) FROM near WHERE s = nations.id), 0)::DOUBLE AS closeness FROM nations""",
    NATIONS,
    TRADE,
)
_query(
    "g16_package_metrics",
    lambda n, e: g.package_metrics(n, e).select("package", "n_nodes", "n_edges", F.round("avg_fan_in", 6).alias("avg_fan_in"), F.round("avg_fan_out", 6).alias("avg_fan_out"), "max_fan_in", "max_fan_out", "cyclic_depth"),
    _SCC
    + """, deg AS (SELECT id, package, (SELECT count(*) FROM trade WHERE dst = id) AS i, (SELECT count(*) FROM trade WHERE src = id) AS o FROM nations),
    inside AS (SELECT package, component, count(*) AS n FROM comp JOIN nations USING (id) WHERE size > 1 GROUP BY ALL)
    SELECT package, count(*) AS n_nodes, sum(o)::BIGINT AS n_edges, round(avg(i), 6) AS avg_fan_in, round(avg(o), 6) AS avg_fan_out, max(i) AS max_fan_in, max(o) AS max_fan_out,
           coalesce((SELECT max(n) FROM inside x WHERE x.package = deg.package), 0) AS cyclic_depth FROM deg GROUP BY package""",
    NATIONS,
    TRADE,
)
for _name in ("g08_transitive_closure", "g09_cycles", "g10_strong_components", "g16_package_metrics"):  # the same over graphs that grow with the tables
    QUERIES[f"{_name}_of_customers"] = lambda spark, sf_dir, run=_RUN[_name]: run(frame(spark, sf_dir, CUSTOMERS), frame(spark, sf_dir, REFERRALS))
    ORACLES[f"{_name}_of_customers"] = f"WITH RECURSIVE trade AS ({REFERRALS}), nations AS ({CUSTOMERS})" + ORACLES[_name].removeprefix(_WITH)
_query(
    "g17_cross_package_edges",
    g.cross_package,
    " SELECT src, dst, call_type, a.package AS src_package, b.package AS dst_package FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.package <> b.package",
)
_query(
    "g18_resolve_interfaces",
    g.resolve_interfaces,
    """ SELECT * FROM edges UNION ALL
    SELECT src, o.id, 'interface_impl' FROM edges JOIN nodes t ON dst = t.id JOIN nodes o ON o.name = t.name AND o.receiver <> t.receiver
    WHERE call_type = 'interface' AND t.kind = 'method' AND o.kind = 'method'""",
)
_query(
    "g19_unreachable_and_orphaned",
    g.analysed_dead_code,
    _walk("SELECT id, 0 AS depth FROM nodes WHERE exported AND kind IN ('function', 'method')")
    + _DEGREES
    + """ SELECT id, unreachable, orphaned FROM (SELECT id, id NOT IN (SELECT id FROM reach) AS unreachable, fan_in = 0 AND fan_out = 0 AS orphaned FROM deg) WHERE unreachable OR orphaned""",
)
_INIT = "(name = 'init' OR contains(name, '.init') OR starts_with(name, 'init.') OR starts_with(name, 'init#'))"
_TEST = "regexp_matches(split_part(name, '.', -1), '^(Test|Benchmark|Fuzz|Example)')"
_ENTRY = f""", entry AS (SELECT id, reason FROM (SELECT id, CASE WHEN split_part(name, '.', -1) = 'main' THEN 'main' WHEN {_INIT} THEN 'init'
  WHEN exported AND (contains(package, '/cmd/') OR starts_with(package, 'cmd') OR package = 'main') THEN 'command'
  WHEN contains(signature, 'http.ResponseWriter') AND contains(signature, '*http.Request') THEN 'handler' END AS reason FROM nodes) WHERE reason IS NOT NULL)"""
_query("g20_entry_points", lambda n, e: g.entry_points(n), _ENTRY + " SELECT * FROM entry")
_DEAD = (
    _ENTRY
    + _walk("SELECT id, 0 AS depth FROM entry")
    + _DEGREES
    + """, conf AS (SELECT n.*, fan_in, id IN (SELECT id FROM reach) AS alive,
   CASE WHEN id IN (SELECT id FROM reach) THEN 0 ELSE greatest(0, least(1,
     CASE WHEN NOT exported AND fan_in = 0 THEN 0.95::DOUBLE WHEN exported AND fan_in = 0 AND (contains(package, '/cmd/') OR package = 'main') THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END
     * CASE WHEN exported AND fan_in > 0 AND NOT (contains(package, '/cmd/') OR package = 'main') THEN 0.6::DOUBLE ELSE 1 END
     * CASE WHEN kind = 'method' AND id IN (SELECT dst FROM edges WHERE call_type = 'interface') THEN 0.5::DOUBLE ELSE 1 END
     * CASE WHEN fan_in > 0 THEN 1 - 0.1::DOUBLE * fan_in ELSE 1 END)) END AS confidence FROM nodes n JOIN deg USING (id))"""
)
_query("g21_dead_code_confidence", lambda n, e: g.dead_code_confidence(n, e, g.reachable(e, g.entry_points(n).select("id"))).select("id", F.round("confidence", 6).alias("confidence")), _DEAD + " SELECT id, round(confidence, 6) AS confidence FROM conf")
_FOUND = f""", found AS (SELECT id, confidence, CASE WHEN fan_in > 0 THEN 'called only from unreachable code' WHEN exported THEN 'exported, never called' ELSE 'never called' END AS reason
  FROM conf WHERE NOT alive AND NOT {_INIT} AND NOT {_TEST} AND confidence >= 0.5)"""
_query("g22_dead_code", g.dead_code, _DEAD + _FOUND + " SELECT * FROM found")
_query("g22_dead_code_summary", g.dead_code_summary, _DEAD + _FOUND + " SELECT (SELECT count(*) FROM nodes) - count(*) AS alive, count(*) AS dead FROM found")
_PRIORITY = (
    _DEGREES
    + """, back AS (SELECT DISTINCT dst AS a, src AS b FROM edges WHERE src <> dst),
b2 AS (SELECT DISTINCT x.a, y.b FROM back x JOIN back y ON x.b = y.a), b3 AS (SELECT DISTINCT x.a, y.b FROM b2 x JOIN back y ON x.b = y.a),
near AS (SELECT a AS id, count(*) AS near FROM (SELECT * FROM back UNION SELECT * FROM b2 UNION SELECT * FROM b3) WHERE a <> b GROUP BY a),
prio AS (SELECT n.*, round(0.35 * least(fan_in / 20.0::DOUBLE, 1) + 0.25 * CASE WHEN exported THEN 1 ELSE 0.3 END
  + 0.15 * CASE WHEN kind <> 'method' THEN 0.2 WHEN regexp_matches(lower(receiver), 'error|reader|writer|readcloser|writecloser|readwriter|handler|roundtripper|transport|database|sql|tx|conn|listener') THEN 1 ELSE 0.5 END
  + 0.15 * CASE WHEN name = 'main.main' OR (contains(lower(signature), 'http.responsewriter') AND contains(lower(signature), '*http.request')) THEN 1 WHEN coalesce(near, 0) = 0 THEN 0.1 ELSE least(near, 6) / 6.0::DOUBLE END
  + 0.1 * CASE WHEN regexp_matches(lower(package), 'cmd|main|handler|server|api|gateway') THEN 1 WHEN regexp_matches(lower(package), 'internal|pkg') THEN 0.6 ELSE 0.3 END, 6)::DOUBLE AS priority
  FROM nodes n JOIN deg USING (id) LEFT JOIN near USING (id))"""
)
_query("g23_untested", g.untested, _PRIORITY + _walk(f"SELECT id, 0 AS depth FROM nodes WHERE {_TEST}", depth=10) + f" SELECT id, priority FROM prio WHERE kind IN ('function', 'method') AND NOT {_TEST} AND NOT {_INIT} AND id NOT IN (SELECT id FROM reach)")
_query("g24_untested_priority", g.untested_priority, _PRIORITY + " SELECT id, priority FROM prio")
_query("g25_test_names", lambda n, e: n.where(g.is_test_name(F.col("name"))).select("id", "name"), f" SELECT id, name FROM nodes WHERE {_TEST}")
_COVERAGE = "SELECT p_brand || '/' || p_name || '.go' AS file, avg(p_size) AS pct FROM part WHERE p_size > 10 GROUP BY p_brand, p_name"


def _g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = frame(spark, sf_dir, NODES), frame(spark, sf_dir, EDGES)
    return g.with_coverage(g.untested(nodes, edges), nodes, frame(spark, sf_dir, _COVERAGE)).select("id", "priority", "file", F.round("pct", 6).alias("pct"))


QUERIES["g26_untested_with_coverage"] = _g26
ORACLES["g26_untested_with_coverage"] = ORACLES["g23_untested"].replace("SELECT id, priority FROM prio WHERE", f"SELECT id, priority, prio.file, round(pct, 6) AS pct FROM prio LEFT JOIN ({_COVERAGE}) c ON c.file = prio.file WHERE")
_FILES = "SELECT 'lib/' || p_name || '.go' AS file FROM part UNION SELECT 'lib/' || p_name || '_test.go' FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#2' UNION SELECT 'README.md' FROM region"
QUERIES["g27_has_test_file"] = lambda spark, sf_dir: g.has_test_file(frame(spark, sf_dir, _FILES))
ORACLES["g27_has_test_file"] = f"WITH f AS ({_FILES}) SELECT file, replace(file, '.go', '_test.go') IN (SELECT file FROM f) AS has_test FROM f WHERE suffix(file, '.go') AND NOT suffix(file, '_test.go')"
_query("g28_audit", g.audit, None)
ORACLES["g28_audit"] = (
    _WITH
    + _DEAD
    + _FOUND
    + _PRIORITY.replace(_DEGREES, "")
    + f""", tested AS (SELECT id, 0 AS depth FROM nodes WHERE {_TEST} UNION SELECT b, depth + 1 FROM tested JOIN step ON id = a WHERE depth < 10)
    SELECT * FROM (SELECT 'dead_code' AS part, id, confidence AS score FROM found ORDER BY confidence DESC, id LIMIT 10) UNION ALL
    SELECT * FROM (SELECT 'untested' AS part, id, priority AS score FROM prio WHERE kind IN ('function', 'method') AND NOT {_TEST} AND NOT {_INIT} AND id NOT IN (SELECT id FROM tested) ORDER BY priority DESC, id LIMIT 10)"""
)
_query("g29_graph_stats", g.stats, " SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges")


def _s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(frame(spark, sf_dir, EDGES), f"{shared_dir(spark)}/edges")


QUERIES["s07_s08_graph_round_trip"] = _s07
ORACLES["s07_s08_graph_round_trip"] = EDGES
