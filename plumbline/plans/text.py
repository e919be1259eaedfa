"""Queries of the safety, DLP and packet operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import dlp
from plumbline.operators import packets as pk
from plumbline.operators import safety as sa
from plumbline.plans.tables import frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """Registers ``run`` over the result of ``view``; ``sql`` follows a WITH list that names it ``v``."""
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir, view))
    if sql is not None:
        ORACLES[name] = f"WITH RECURSIVE v AS ({view}){sql}"


_FILES = """
SELECT 'src/' || source || '/' || doc_id || '.go' AS path, CASE WHEN lang IN ('en', 'de') THEN 'go' ELSE 'py' END AS language,
       text || chr(10) || CASE WHEN lang = 'de' THEN '// plumbline:allow GO004 GO001' ELSE 'cmd := exec.Command("ls " + name)' END || chr(10) || 'token = "abcdefghijk" // TODO' || chr(10) || 'defer exec.Command(name)' AS content
FROM documents
"""
_LINES = ", l AS (SELECT path, language, content, unnest(range(1, len(s) + 1)) AS line, s FROM (SELECT *, string_split(content, chr(10)) AS s FROM v)), t AS (SELECT path, language, content, line, s[line] AS text, array_to_string(s[greatest(line - 4, 1):line], chr(10)) AS near FROM l)"
_RULES = ", ".join(f"({_q(r.id)}, {r.severity}, {_q(r.action)}, {_q(r.pattern)}, {'security' in r.tags}, {_q(r.message)})" for r in sa.RULES)
_FOUND = (
    _LINES
    + f""", rules(rule_id, severity, action, pattern, security, message) AS (VALUES {_RULES}),
found AS (SELECT path, line, rule_id, severity, action, message,
  round(least(CASE severity WHEN 4 THEN 9 WHEN 3 THEN 6 WHEN 2 THEN 3.5::DOUBLE ELSE 1 END * CASE WHEN security THEN 1.2::DOUBLE ELSE 1 END, 10), 6)::DOUBLE AS risk,
  (SELECT bool_or(contains(x, 'plumbline:allow') AND contains(x, rule_id)) FROM (SELECT unnest(string_split(near, chr(10))) AS x)) AS suppressed
  FROM t JOIN rules ON regexp_matches(text, pattern))"""
)
_CALL_REGEX, _CALL_NAMES = sa.compile_pattern(r"exec\.Command\($ARG, $OTHER2\)")
_add(
    "t01_compiled_pattern",
    "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'x := exec.Command(arg' || o_custkey || ', b)' WHEN 'O' THEN 'exec.Command(1, b)' ELSE 'exec_Command(a, b)' END AS line, o_orderstatus AS s, o_custkey AS k FROM orders",
    lambda v: v.where(F.col("line").rlike(_CALL_REGEX)).select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("line", _CALL_REGEX, k + 1).alias("value")) for k, n in enumerate(_CALL_NAMES)])).alias("x")).select("id", "x.*"),
    " SELECT id, 'ARG' AS name, 'arg' || k AS value FROM v WHERE s = 'F' UNION ALL SELECT id, 'OTHER2', 'b' FROM v WHERE s = 'F'",
)
_add("t02_t05_rule_findings", _FILES, sa.rule_findings, _FOUND + " SELECT * FROM found")
_add(
    "t03_metavariables",
    _FILES,
    lambda v: sa.metavariables(tx.lines(v.select("path", F.col("content").alias("text"))), r"$CMD\.Command\($ARG\)").select("path", "line", F.col("values")["CMD"].alias("cmd"), F.col("values")["ARG"].alias("arg")),
    _LINES + r""" SELECT path, line, regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]*)\.Command\(([A-Za-z_][A-Za-z0-9_]*)\)', 1) AS cmd, regexp_extract(text, '([A-Za-z_][A-Za-z0-9_]*)\.Command\(([A-Za-z_][A-Za-z0-9_]*)\)', 2) AS arg
    FROM t WHERE regexp_matches(text, '([A-Za-z_][A-Za-z0-9_]*)\.Command\(([A-Za-z_][A-Za-z0-9_]*)\)')""",
)
_add("t04_calls", _FILES, lambda v: sa.calls(tx.lines(v.select("path", F.col("content").alias("text"))), "exec.Command").select("path", "line"), _LINES + r" SELECT path, line FROM t WHERE regexp_matches(text, '(^|[^0-9A-Za-z_])Command\s*\(')")
_RISK = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY risk DESC, line, rule_id) AS k FROM found WHERE NOT suppressed),
risk AS (SELECT path, round(least(max(risk) + sum(risk / k * 0.1::DOUBLE), 10), 2) AS risk FROM ranked GROUP BY path)"""
_LEVEL = "CASE WHEN risk >= 8 THEN 'critical' WHEN risk >= 5 THEN 'high' WHEN risk >= 2.5 THEN 'medium' ELSE 'low' END"
_add("t07_t08_aggregate_risk", _FILES, lambda v: sa.aggregate_risk(sa.rule_findings(v)), _FOUND + _RISK + f" SELECT path, risk, {_LEVEL} AS level FROM risk")
_add(
    "t06_rule_risk_in_production",
    _FILES,
    lambda v: sa.rule_findings(v, production=True, test=True).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("risk").alias("risk")),
    _FOUND.replace("END, 10), 6)", "END * 0.75::DOUBLE, 10), 6)") + " SELECT rule_id, count(*) AS n, max(risk) AS risk FROM found GROUP BY rule_id",
)
_CVSS = "SELECT o_orderkey AS id, substr('NALP', 1 + CAST(o_totalprice AS INT) % 4, 1) AS av, substr('LH', 1 + CAST(o_custkey AS INT) % 2, 1) AS ac, substr('NLH', 1 + CAST(o_orderkey AS INT) % 3, 1) AS pr, substr('NR', 1 + CAST(o_totalprice AS INT) % 2, 1) AS ui, substr('HLN', 1 + CAST(o_custkey AS INT) % 3, 1) AS c, substr('HLN', 1 + CAST(o_orderkey / 3 AS INT) % 3, 1) AS i, substr('HLN', 1 + CAST(o_totalprice / 7 AS INT) % 3, 1) AS a FROM orders"
_IMPACT = " * CASE {0} WHEN 'H' THEN 0.56::DOUBLE WHEN 'L' THEN 0.22::DOUBLE ELSE 1 END"


def _t09(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "SELECT o_orderkey AS id, o_orderpriority AS p, o_orderstatus AS s FROM orders")
    pick = lambda c, pairs: F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)
    first = F.substring("p", 1, 1)
    vector = {
        "AV": pick(first, {"1": "N", "2": "A", "3": "L", "4": "P", "5": "N"}), "AC": pick(F.col("s"), {"F": "L", "O": "H", "P": "L"}), "PR": pick(first, {"1": "N", "2": "L", "3": "H", "4": "N", "5": "L"}), "UI": pick(F.col("s"), {"F": "N", "O": "R", "P": "R"}),
        "C": pick(first, {"1": "H", "2": "L", "3": "N", "4": "H", "5": "L"}), "I": pick(F.col("s"), {"F": "H", "O": "L", "P": "N"}), "A": pick(first, {"1": "L", "2": "L", "3": "H", "4": "N", "5": "N"}),
    }
    return v.select("id", sa.cvss_like(vector).alias("score"))


QUERIES["t09_cvss_like"] = _t09
ORACLES["t09_cvss_like"] = (
    """WITH v AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS s FROM orders)
SELECT id, round((CASE p WHEN '1' THEN 0.85::DOUBLE WHEN '2' THEN 0.62::DOUBLE WHEN '3' THEN 0.55::DOUBLE WHEN '4' THEN 0.2::DOUBLE ELSE 0.85::DOUBLE END + CASE s WHEN 'O' THEN 0.44::DOUBLE ELSE 0.77::DOUBLE END
 + CASE p WHEN '1' THEN 0.85::DOUBLE WHEN '2' THEN 0.62::DOUBLE WHEN '3' THEN 0.27::DOUBLE WHEN '4' THEN 0.85::DOUBLE ELSE 0.62::DOUBLE END + CASE s WHEN 'F' THEN 0.85::DOUBLE ELSE 0.62::DOUBLE END)
 * CASE p WHEN '1' THEN 0.56::DOUBLE WHEN '2' THEN 0.22::DOUBLE WHEN '3' THEN 1 WHEN '4' THEN 0.56::DOUBLE ELSE 0.22::DOUBLE END * CASE s WHEN 'F' THEN 0.56::DOUBLE WHEN 'O' THEN 0.22::DOUBLE ELSE 1 END
 * CASE p WHEN '1' THEN 0.22::DOUBLE WHEN '2' THEN 0.22::DOUBLE WHEN '3' THEN 0.56::DOUBLE ELSE 1 END, 2) AS score FROM v"""
)
_VERDICT = """, active AS (SELECT * FROM found WHERE NOT suppressed),
verdict AS (SELECT path, bool_or(action = 'block') AS blocked, coalesce(string_agg(DISTINCT rule_id || ': ' || message, '; ' ORDER BY rule_id || ': ' || message) FILTER (WHERE action = 'block'), '') AS reason FROM active GROUP BY path)"""
_add("t10_verdict", _FILES, lambda v: sa.verdict(sa.rule_findings(v)), _FOUND + _VERDICT + " SELECT path, blocked, CASE WHEN blocked THEN reason ELSE '' END AS reason FROM verdict")
_add(
    "t10_verdict_strict",
    _FILES,
    lambda v: sa.verdict(sa.rule_findings(v), "strict"),
    _FOUND + _VERDICT + " SELECT path, true AS blocked, CASE WHEN reason = '' THEN 'policy violation' ELSE reason END AS reason FROM verdict",
)
_add(
    "t11_validate",
    _FILES,
    sa.validate,
    (_FOUND + _RISK + _VERDICT).replace("FROM t JOIN rules", "FROM (SELECT * FROM t WHERE language = 'go' AND strlen(content) <= 1048576) AS t JOIN rules")
    + f" SELECT v.path, coalesce(blocked, false) AS blocked, CASE WHEN blocked THEN reason ELSE '' END AS reason, coalesce(risk, 0) AS risk, CASE WHEN risk IS NULL THEN 'low' ELSE {_LEVEL} END AS level FROM v LEFT JOIN verdict USING (path) LEFT JOIN risk USING (path)",
)
_add(
    "t12_obfuscation",
    "SELECT path, content || chr(10) || 'x := \"' || substr(content, 1, 3) || '\" + \"b\" // \"c\" + \"d\"' AS content FROM (" + _FILES.replace("text || chr(10)", "regexp_replace(text, '[\"\\x0a\\\\\\\\]', ' ') || chr(10)") + ") AS f",
    lambda v: sa.obfuscation(v).groupBy("code").agg(F.count("*").alias("n")),
    None,
)


def _t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "SELECT 'u' || user_id AS log, event_id AS seq, props AS entry, sha2('' || props, 256) AS hash FROM events")
    return sa.verify_chain(v)


QUERIES["t13_verify_chain"] = _t13
ORACLES["t13_verify_chain"] = "SELECT 'u' || user_id AS log, event_id AS seq, sha256(coalesce(lag(sha256(props)) OVER (PARTITION BY user_id ORDER BY event_id), '') || props) = sha256(props) AS valid FROM events"
_DOCS = "SELECT doc_id, text, 'docs/' || source || '/' || doc_id || '.md' AS path FROM documents"
_DOC_LINES = ", t AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM v))"


def _hits(patterns: tuple[tuple[str, str], ...]) -> str:
    table = ", ".join(f"({_q(n)}, {_q(p)})" for n, p in patterns)
    return f""", p(kind, pattern) AS (VALUES {table}), m AS (SELECT doc_id, line, kind, text, regexp_extract(text, pattern) AS x FROM t JOIN p ON regexp_matches(text, pattern)),
    h AS (SELECT doc_id, line, kind, strlen(split_part(text, x, 1)) AS position, CASE WHEN strlen(x) <= 6 THEN '***' ELSE substr(x, 1, 3) || repeat('*', strlen(x) - 6) || right(x, 3) END AS snippet FROM m)"""


_add("t14_secrets", _DOCS, dlp.secrets, _DOC_LINES + _hits(dlp.SECRETS) + " SELECT * FROM h")
_add("t15_personal_data", _DOCS, dlp.personal_data, _DOC_LINES + _hits(dlp.PERSONAL) + " SELECT * FROM h")
_add(
    "t16_entropy",
    _DOCS,
    lambda v: tx.lines(v.select("doc_id", "text")).select("doc_id", "line", F.round(tx.entropy(F.col("text")), 6).alias("entropy")),
    _DOC_LINES + """, c AS (SELECT doc_id, line, ch, count(*) AS k, any_value(length(text)) AS n FROM (SELECT doc_id, line, text, unnest(string_split(text, '')) AS ch FROM t WHERE text <> '') GROUP BY doc_id, line, ch)
    SELECT doc_id, line, round(coalesce((SELECT -sum(k / n * log2(k / n)) FROM c WHERE c.doc_id = t.doc_id AND c.line = t.line), 0), 6) AS entropy FROM t""",
)
_add(
    "t17_entropy_windows",
    _DOCS,
    lambda v: dlp.entropy_hits(v).withColumn("entropy", F.round("entropy", 6)),
    # of the windows above the threshold, the first of a text, and then always the first that does not overlap the one before
    """, w AS (SELECT doc_id, i, substr(text, i + 1, 20) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 19)) AS i FROM v WHERE length(text) >= 20)),
    h AS MATERIALIZED (SELECT doc_id, i, s, e FROM (SELECT *, list_aggregate(string_split(s, ''), 'entropy') AS e FROM w) WHERE e > 4.0 + 1e-9),
    g AS (SELECT doc_id, list(struct_pack(i := i, s := s, e := e) ORDER BY i) AS hits FROM h GROUP BY doc_id),
    r AS (
      SELECT doc_id, hits, 1 AS k, 0::BIGINT AS free, false AS taken, NULL::BIGINT AS pick FROM g
      UNION ALL
      SELECT doc_id, hits, k + 1, CASE WHEN hits[k].i >= free THEN hits[k].i + 20 ELSE free END, hits[k].i >= free, k FROM r WHERE k <= len(hits))
    SELECT doc_id, hits[pick].i::BIGINT AS position, round(hits[pick].e, 6) AS entropy,
           substr(hits[pick].s, 1, 3) || repeat('*', strlen(hits[pick].s) - 6) || right(hits[pick].s, 3) AS snippet
    FROM r WHERE taken""",
)
_add("t18_redact", _DOCS, lambda v: v.select("doc_id", tx.redact(F.col("path")).alias("snippet")), " SELECT doc_id, substr(path, 1, 3) || repeat('*', strlen(path) - 6) || right(path, 3) AS snippet FROM v")
_add(
    "t19_dlp_verdict",
    _DOCS,
    lambda v: dlp.check(v, exempt=("src1/", "*.txt")).select("doc_id", "n_secrets", "n_personal", "exempt", "blocked"),
    _DOC_LINES + _hits(dlp.SECRETS + dlp.PERSONAL) + f""" SELECT doc_id, CASE WHEN e THEN 0 ELSE a END AS n_secrets, CASE WHEN e THEN 0 ELSE b END AS n_personal, e AS exempt, NOT e AND a + b > 0 AS blocked FROM (SELECT doc_id, contains(path, 'src1/') AS e,
    (SELECT count(*) FROM h WHERE h.doc_id = v.doc_id AND kind IN ({', '.join(_q(n) for n, _ in dlp.SECRETS)})) AS a, (SELECT count(*) FROM h WHERE h.doc_id = v.doc_id AND kind IN ({', '.join(_q(n) for n, _ in dlp.PERSONAL)})) AS b FROM v)""",
)
_add("t20_exempt_paths", _DOCS, lambda v: v.select("doc_id", dlp.is_exempt(F.col("path"), ("docs/src1*", "*7.md", "src4/")).alias("exempt")), " SELECT doc_id, starts_with(path, 'docs/src1') OR suffix(path, '7.md') OR contains(path, 'src4/') AS exempt FROM v")
_DIFF_FILES = "SELECT l_orderkey AS diff_id, CASE l_returnflag WHEN 'A' THEN 'api/' WHEN 'R' THEN 'docs/' ELSE 'go.mod' END || l_partkey AS filename, CAST(l_quantity AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem"
_add(
    "t21_architectural_diff",
    _DIFF_FILES,
    lambda v: pk.architectural_diff(v, ("api/", "go.mod"), 20),
    " SELECT diff_id, count(*) FILTER (k) AS total_files, coalesce(sum(additions) FILTER (k), 0)::BIGINT AS total_add, coalesce(sum(deletions) FILTER (k), 0)::BIGINT AS total_delete, coalesce(sum(additions + deletions) FILTER (k), 0) < 20 AS trivial FROM (SELECT *, starts_with(filename, 'api/') OR starts_with(filename, 'go.mod') AS k FROM v) GROUP BY diff_id",
)
_COMMANDS = "SELECT event_id AS id, CASE event_type WHEN 'error' THEN '  /adr Accept  ' || user_id || ' now ' WHEN 'click' THEN '/adr' WHEN 'view' THEN '/adr publish x' WHEN 'signup' THEN 'please /adr accept' ELSE '/adr update' END AS body FROM events"
_add(
    "t22_slash_commands",
    _COMMANDS,
    lambda v: v.select("id", pk.slash_command(F.col("body")).alias("c")).select("id", "c.action", F.array_join("c.args", ",").alias("args")),
    " SELECT id, CASE WHEN NOT starts_with(trim(body), '/adr') THEN NULL WHEN contains(lower(body), '/adr accept') THEN 'accept' WHEN contains(body, 'update') THEN 'update' ELSE 'help' END AS action, CASE WHEN NOT starts_with(trim(body), '/adr') THEN NULL WHEN contains(body, 'Accept') THEN regexp_extract(body, 'Accept +([0-9]+) now', 1) || ',now' ELSE '' END AS args FROM v",
)
_HOOKS = """SELECT o_orderkey AS id, '{"action": "' || CASE o_orderstatus WHEN 'F' THEN 'closed' ELSE 'opened' END || '", "pull_request": {"merged": ' || CASE WHEN o_totalprice > 200000 THEN 'true' ELSE 'false' END || ', "merge_commit_sha": "' || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'abc' END || '"}}' AS payload FROM orders UNION ALL SELECT -1, 'not json' FROM region"""
_add("t23_merged_requests", _HOOKS, lambda v: v.select("id", pk.merged_request(F.col("payload")).alias("merged")), " SELECT id, contains(payload, 'closed') AND contains(payload, 'true') AND contains(payload, '\"abc\"') AS merged FROM v")
_PACKETS = """SELECT doc_id AS id, 'Gate: ' || CASE WHEN lang = 'en' THEN 'missing_readme' WHEN lang = 'de' THEN 'nested_callbacks' ELSE source END || chr(10) || CASE WHEN lang <> 'es' THEN 'Severity: ' || CASE lang WHEN 'fr' THEN 'CRIT' ELSE 'err' END || chr(10) ELSE '' END
 || 'Files: src/' || doc_id || '.go:' || n_chars || '-' || (n_chars + 5) || ', a.md:7 , b.md' || chr(10) || '1. do this ' || lang || chr(10) || ' 2) do that' || chr(10) || 'do_not_touch: src/1, vendor' || chr(10) || 'max_files: 2' || chr(10) || 'paradigm: functional style' || chr(10) || 'Verify: go test ./...' AS text FROM documents"""
_PACKET = lambda v: v.select("id", pk.parse_packet(F.col("text")).alias("p"))
_add(
    "t24_fix_packets",
    _PACKETS,
    lambda v: _PACKET(v).select(
        "id", "p.gate", "p.severity", F.array_join(F.transform("p.files", lambda f: F.concat_ws("|", f["path"], f["start"].cast("string"), f["end"].cast("string"))), ";").alias("files"), F.array_join("p.steps", ";").alias("steps"), F.array_join("p.protected", ";").alias("protected"), "p.max_files", "p.paradigm", F.array_join("p.verification", ";").alias("verification")
    ),
    """ SELECT id, regexp_extract(v.text, 'Gate: ([a-zA-Z0-9_]+)', 1) AS gate, CASE WHEN contains(v.text, 'CRIT') THEN 'critical' WHEN contains(v.text, 'Severity: err') THEN 'error' ELSE 'warning' END AS severity,
    'src/' || id || '.go|' || d.n_chars || '|' || (d.n_chars + 5) || ';a.md|7|7;b.md|0|0;1|0|0' AS files, 'do this ' || d.lang || ';do that' AS steps, 'src/1;vendor' AS protected, 2 AS max_files, 'functional' AS paradigm, 'go test ./...' AS verification FROM v JOIN documents d ON d.doc_id = id""".replace(";1|0|0'", ";2|0|0'"),
)
_add(
    "t25_fix_strategy",
    _PACKETS,
    lambda v: _PACKET(v).select("id", pk.strategy(F.col("p.gate"), F.col("p.steps")).alias("strategy")),
    " SELECT id, CASE d.lang WHEN 'en' THEN 'create' WHEN 'de' THEN 'rewrite' ELSE 'delegate' END AS strategy FROM v JOIN documents d ON d.doc_id = id",
)
_add(
    "t26_constraints",
    _PACKETS,
    lambda v: _PACKET(v).select("id", pk.violates(F.col("p.files"), F.col("p.protected"), F.col("p.max_files")).alias("violation")),
    " SELECT id, CASE WHEN starts_with(id::VARCHAR, '1') THEN 'protected path' ELSE 'too many files' END AS violation FROM v",
)
_PAIRS = "SELECT 'c/' || a.conv_id || '/' || a.turn AS path, a.text AS original, b.text AS shadow FROM conversations AS a JOIN conversations AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
_SIDES = ", s AS (SELECT path, unnest(range(1, greatest(len(o), len(w)) + 1)) AS line, o, w FROM (SELECT path, string_split(original, chr(10)) AS o, string_split(shadow, chr(10)) AS w FROM v)), x AS (SELECT path, line, coalesce(o[line], '') AS original, coalesce(w[line], '') AS shadow FROM s)"
_add("t27_conflicts", _PAIRS, pk.conflicts, _SIDES + " SELECT * FROM x WHERE original <> shadow")
_add("t27_merge_last_write", _PAIRS, pk.merge, _SIDES + " SELECT path, (SELECT any_value(shadow) FROM v WHERE v.path = x.path) AS merged, count(*) FILTER (original <> shadow) AS n_conflicts FROM x GROUP BY path")
_add("t27_merge_auto", _PAIRS, lambda v: pk.merge(v, "auto"), _SIDES + " SELECT path, string_agg(CASE WHEN shadow = '' THEN original ELSE shadow END, chr(10) ORDER BY line) AS merged, count(*) FILTER (original <> shadow) AS n_conflicts FROM x GROUP BY path")
_SOME_ALIKE = _PAIRS.replace("b.text AS shadow", "CASE WHEN a.turn % 3 = 0 THEN a.text ELSE b.text END AS shadow")
_add("t27_merge_manual", _SOME_ALIKE, lambda v: pk.merge(v, "manual"), _SIDES + " SELECT path, CASE WHEN count(*) FILTER (original <> shadow) = 0 THEN (SELECT any_value(shadow) FROM v WHERE v.path = x.path) END AS merged, count(*) FILTER (original <> shadow) AS n_conflicts FROM x GROUP BY path")
_add("t28_content_hash", _DOCS, lambda v: v.select("doc_id", pk.content_hash(F.col("text")).alias("hash")), " SELECT doc_id, sha256(text) AS hash FROM v")


def _t29(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frame(spark, sf_dir, "SELECT event_id AS id, event_type, props, user_id FROM events")
    headers = F.create_map(F.lit("X-Event"), F.array("event_type"), F.lit("Cookie"), F.array("props"), F.lit("X-User"), F.array(F.col("user_id").cast("string")))
    rules = [{"action": "remove", "match": "(?i)^cookie$"}, {"action": "rename", "match": "^X-User$", "new_name": "User"}, {"action": "append", "match": "^X-", "replace": "seen"}, {"action": "set", "match": "^Use", "replace": "hidden"}]
    out = v.select("id", pk.rewrite_headers(headers, rules).alias("h"))
    return out.select("id", F.array_join(F.array_sort(F.map_keys("h")), ",").alias("names"), F.array_join(F.col("h")["X-Event"], ",").alias("event"), F.array_join(F.col("h")["User"], ",").alias("user"))


QUERIES["t29_rewrite_headers"] = _t29
ORACLES["t29_rewrite_headers"] = "SELECT event_id AS id, 'User,X-Event' AS names, event_type || ',seen' AS event, 'hidden' AS user FROM events"
_DIFF = """SELECT lang AS diff_id, doc_id * 10 + k AS seq, CASE k WHEN 0 THEN 'diff --git a/docs/' || doc_id || '.md b/docs/' || doc_id || '.md' WHEN 1 THEN '--- a/docs/' || doc_id || '.md' WHEN 2 THEN '+++ b/docs/' || doc_id || '.md'
WHEN 3 THEN '@@ -1,2 +1,2 @@' WHEN 4 THEN ' source ' || source WHEN 5 THEN '-old ' || n_chars WHEN 6 THEN '+new ' || n_chars ELSE '+tail' END AS line FROM documents CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS t(k)"""
_add(
    "s14_parse_diff",
    _DIFF,
    sa.parse_diff,
    " SELECT lang AS diff_id, 'docs/' || doc_id || '.md' AS path, 'source ' || source || chr(10) || 'old ' || n_chars || chr(10) AS old_content, 'source ' || source || chr(10) || 'new ' || n_chars || chr(10) || 'tail' || chr(10) AS content FROM documents",
)
_PROFILE = "SELECT CAST(1 AS BIGINT) AS line_no, 'mode: set' AS value UNION ALL SELECT l_orderkey + 2, CASE WHEN l_returnflag = 'N' AND l_quantity < 3 THEN 'odd line' ELSE 'pkg/' || l_suppkey || '.go:' || l_linenumber || '.2,9.1 ' || CAST(l_quantity AS INT) || ' ' || CASE WHEN l_returnflag = 'R' THEN '0' ELSE '3' END END FROM lineitem"
_add(
    "s15_parse_coverage",
    _PROFILE,
    lambda v: sa.parse_coverage(v).withColumn("pct", F.round("pct", 6)),
    " SELECT file, covered, total, round(covered * 100.0::DOUBLE / total, 6) AS pct FROM (SELECT 'pkg/' || l_suppkey || '.go' AS file, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::INT END)::BIGINT AS covered, sum(l_quantity::INT)::BIGINT AS total FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_quantity < 3) GROUP BY l_suppkey)",
)
