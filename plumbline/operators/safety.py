"""Line rules, suppression, risk and verdicts; diffs and audit chains.

Rules are data: (id, severity 1-4, action, pattern, tags, message). Files:
(path, content, ..). Rule ids, actions and severities follow the rule table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lines, re2_to_java
from plumbline.operators.fold import fold


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int
    action: str
    pattern: str
    tags: tuple[str, ...]
    message: str


LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4

# The built-in rules.
RULES = (
    Rule("GO001", HIGH, "block", r"exec\.Command", ("security", "command-execution"), "command execution"),
    Rule("GO002", CRITICAL, "block", r"fmt\.Sprintf.*(SELECT|INSERT|UPDATE|DELETE).*\+", ("security", "sql-injection"), "query built from strings"),
    Rule("GO003", MEDIUM, "warn", r"(md5\.New|sha1\.New)", ("security", "crypto"), "weak hash"),
    Rule("GO004", CRITICAL, "block", r'(password|secret|token|api_key)\s*[:=]\s*"[^"]{8,}"', ("security", "secrets"), "hard-coded secret"),
    Rule("GO005", HIGH, "block", r"unsafe\.Pointer", ("security", "unsafe"), "unsafe pointer"),
    Rule("GO006", CRITICAL, "block", r"rm\s+-rf?", ("security", "destructive"), "destructive command"),
    Rule("GO007", HIGH, "block", r"InsecureSkipVerify\s*:\s*true", ("security", "tls"), "certificates not verified"),
    Rule("GO008", HIGH, "block", r"os\.Open\(.*\+.*\)", ("security", "path-traversal"), "path built from strings"),
    Rule("GO009", HIGH, "block", r"(exec\.Command|os\.StartProcess).*\+", ("security", "command-injection"), "command built from strings"),
    Rule("GO010", LOW, "warn", r'fmt\.Println\([^"]', ("code-quality", "debug"), "debug output"),
    Rule("GO011", LOW, "warn", r"//\s*TODO", ("code-quality",), "open task"),
    Rule("GO012", MEDIUM, "warn", r"_\s*=\s*[a-zA-Z]", ("code-quality", "error-handling"), "ignored result"),
)
POLICIES = {"default": "warn", "strict": "block", "permissive": "allow"}
#: The comment that allows a rule.
MARKER = "plumbline:allow"


def compile_pattern(pattern: str) -> tuple[str, list[str]]:
    """A regex and its metavariables' names: ``$NAME`` captures an identifier, the rest is a regex already."""
    import re

    names: list[str] = []

    def capture(m: re.Match) -> str:
        names.append(m[1])
        return "([A-Za-z_][A-Za-z0-9_]*)"

    return re2_to_java(re.sub(r"\$([A-Z][A-Z0-9_]*)", capture, pattern)), names


def _lookup(rules: tuple[Rule, ...], value) -> Column:
    return F.element_at(F.array(*[F.lit(value(r)) for r in rules]), F.col("rule_no") + 1)


def rule_risk(severity: Column, security: Column, production: bool = False, deployment: bool = False, test: bool = False) -> Column:
    """T6. 9, 6, 3.5, 1 by severity; times 1.5, 1.3, .5 and 1.2; at most 10."""
    base = F.when(severity == CRITICAL, 9.0).when(severity == HIGH, 6.0).when(severity == MEDIUM, 3.5).when(severity == LOW, 1.0).otherwise(0.0)
    factor = (1.5 if production else 1.0) * (1.3 if deployment else 1.0) * (0.5 if test else 1.0)
    return F.least(base * factor * F.when(security, 1.2).otherwise(1.0), F.lit(10.0))


def rule_findings(files: DataFrame, rules: tuple[Rule, ...] = RULES, marker: str = MARKER, production: bool = False, deployment: bool = False, test: bool = False) -> DataFrame:
    """(path, line, rule_id, severity, action, message, risk, suppressed), one row per rule and line (Q16).

    A finding is suppressed by the marker with the rule's id on its line or one of
    the four lines above. All of a file's lines stand in its row, so they are looked
    back upon where they are read, and only lines with findings become rows.
    """
    every = files.select("path", F.split("content", "\n").alias("_lines"))

    def judged(text: Column, i: Column) -> Column:
        hits = F.array_compact(F.array(*[F.when(text.rlike(compile_pattern(r.pattern)[0]), F.lit(k)) for k, r in enumerate(rules)]))
        above = [F.get("_lines", i - k) for k in range(5)]
        marks = F.concat_ws("\n", *[F.when(x.contains(marker), x) for x in above])
        return F.struct((i + 1).cast("long").alias("line"), hits.alias("hits"), marks.alias("marks"))

    found = every.select("path", F.explode(F.filter(F.transform("_lines", judged), lambda x: F.size(x["hits"]) > 0)).alias("x"))
    found = found.select("path", "x.line", F.col("x.marks").alias("_marks"), F.explode("x.hits").alias("rule_no"))
    rule_id = _lookup(rules, lambda r: r.id)
    severity = _lookup(rules, lambda r: r.severity)
    return found.select(
        "path",
        "line",
        rule_id.alias("rule_id"),
        severity.alias("severity"),
        _lookup(rules, lambda r: r.action).alias("action"),
        _lookup(rules, lambda r: r.message).alias("message"),
        F.round(rule_risk(severity, _lookup(rules, lambda r: "security" in r.tags), production, deployment, test), 6).alias("risk"),
        (F.col("_marks").contains(rule_id)).alias("suppressed"),
    )


def metavariables(text_lines: DataFrame, pattern: str) -> DataFrame:
    """(.., line, values) of lines that match, values a map from metavariable to text."""
    regex, names = compile_pattern(pattern)
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.regexp_extract("text", regex, k + 1) for k in range(len(names))])) if names else F.create_map().cast("map<string,string>")
    return text_lines.where(F.col("text").rlike(regex)).withColumn("values", values).drop("text")


def calls(text_lines: DataFrame, name: str) -> DataFrame:
    """T4: lines that call ``name`` or a selector whose last part it is; by its text, as there is no parser for the language here."""
    return text_lines.where(F.col("text").rlike(rf"(^|[^0-9A-Za-z_]){name.rsplit('.', 1)[-1]}\s*\("))


def aggregate_risk(findings: DataFrame, production: bool = False, deployment: bool = False) -> DataFrame:
    """(path, risk, level). The greatest risk and a tenth of each over its place (by risk, line, rule), times 1.2 and 1.1, at most 10; levels from 8, 5 and 2.5."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("risk"), "line", "rule_id"))
    ranked = findings.where("NOT suppressed").withColumn("_k", place)
    factor = (1.2 if production else 1.0) * (1.1 if deployment else 1.0)
    total = F.round(F.least((F.max("risk") + F.sum(F.col("risk") / F.col("_k") * 0.1)) * factor, F.lit(10.0)), 2)
    return ranked.groupBy("path").agg(total.alias("risk")).select("path", "risk", risk_level(F.col("risk")).alias("level"))


def risk_level(score: Column) -> Column:
    """T8. Fixed values."""
    return F.when(score >= 8, "critical").when(score >= 5, "high").when(score >= 2.5, "medium").otherwise("low")


# T9's terms.
CVSS_TERMS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "UI": {"N": 0.85, "R": 0.62}}
CVSS_IMPACT = {"H": 0.56, "L": 0.22}


def cvss_like(vector: dict[str, Column]) -> Column:
    """The sum of four terms times the product of three impacts (C, I, A), two decimals."""

    def choose(column: Column, values: dict[str, float], other: float) -> Column:
        out = F.lit(other)
        for key, value in values.items():
            out = F.when(column == key, value).otherwise(out)
        return out

    score = sum((choose(vector[k], v, 0.0) for k, v in CVSS_TERMS.items()), F.lit(0.0))
    for k in ("C", "I", "A"):
        score = score * choose(vector[k], CVSS_IMPACT, 1.0)
    return F.round(F.least(score, F.lit(10.0)), 2)


def verdict(findings: DataFrame, policy: str = "default") -> DataFrame:
    """(path, blocked, reason): the blocking findings' rules and messages by line and rule, or the policy's own block.

    A reason names each blocking rule once, so it stays as short as the rule table.
    """
    active = findings.where("NOT suppressed")
    block = F.col("action") == "block"
    by_policy = (F.col("action") != "allow") if POLICIES[policy] == "block" else F.lit(False)
    rules = active.groupBy("path", "rule_id", "message").agg(F.bool_or(block).alias("block"), F.bool_or(block | by_policy).alias("blocks"))
    named = F.sort_array(F.collect_set(F.when(F.col("block"), F.concat_ws(": ", "rule_id", "message"))))
    out = rules.groupBy("path").agg(F.bool_or("blocks").alias("blocked"), F.array_join(named, "; ").alias("reason"))
    return out.select("path", "blocked", F.when(~F.col("blocked"), "").when(F.col("reason") == "", "policy violation").otherwise(F.col("reason")).alias("reason"))


def validate(files: DataFrame, policy: str = "default", max_bytes: int = 1 << 20, languages: tuple[str, ...] = ("go",), **context: bool) -> DataFrame:
    """(path, blocked, reason, risk, level) of every file; files of other languages, or larger than ``max_bytes`` (the operator's own rule), have no findings."""
    checked = files.where(F.col("language").isin(*languages) & (F.octet_length("content") <= max_bytes))
    found = rule_findings(checked, **context)
    risk = aggregate_risk(found, context.get("production", False), context.get("deployment", False))
    out = files.select("path").join(verdict(found, policy), "path", "left").join(risk, "path", "left")
    return out.select("path", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("level", F.lit("low")).alias("level"))


def obfuscation(files: DataFrame) -> DataFrame:
    """(path, code) of signs of obfuscation in comment-free text: joined string literals, reflective calls, conversions by an anonymous interface, long hexadecimal literals.

    By the text, as there is no parser for the language here.
    """
    code = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?s)/\*.*?\*/", " "), r"(?m)//.*$", "")
    literals = F.regexp_extract_all("_c", F.lit(r'"(?:[^"\\\n]|\\.)*"'), F.lit(0))
    long_hex = F.exists(literals, lambda x: (F.length(x) > 50) & (F.regexp_count(x, F.lit("[0-9a-fA-F]")) > 0.7 * F.length(x)))
    signs = [
        (r'"(?:[^"\\\n]|\\.)*"\s*\+\s*"', "OBFUSC001"),
        (r"reflect\.(ValueOf|TypeOf)\s*\(|\.MethodByName\s*\(", "OBFUSC002"),
        (r"interface\s*\{[^{}]*\}\s*\(", "OBFUSC003"),
    ]
    found = [F.when(F.col("_c").rlike(p), F.lit(k)) for p, k in signs] + [F.when(long_hex, F.lit("OBFUSC004"))]
    return files.select("path", code.alias("_c")).select("path", F.explode(F.array_compact(F.array(*found))).alias("code"))


def audit_hash(previous: Column, entry: Column) -> Column:
    """The hash of an entry after the one before."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), entry), 256)


def verify_chain(entries: DataFrame) -> DataFrame:
    """(log, seq, valid): whether an entry's hash follows from the one stored before it in its log (Q17).

    The entry before comes by a streaming pass in order, so a long log costs no memory.
    """
    import hashlib

    def step(last, row):
        expected = hashlib.sha256(((last or "") + (row["entry"] or "")).encode()).hexdigest()
        return row["hash"], {"log": row["log"], "seq": row["seq"], "valid": row["hash"] == expected}

    return fold(entries.select("log", "seq", "entry", "hash"), ["log"], ["seq"], lambda key: None, step, "log string, seq bigint, valid boolean")


def parse_diff(diff: DataFrame) -> DataFrame:
    """(diff_id, path, old_content, content) of a unified diff's files, from (diff_id, seq, line).

    Context lines go to both sides. A file's lines meet in one row, its content being the result.
    """
    line = F.col("line")
    header = line.startswith("diff --git")
    order = Window.partitionBy("diff_id").orderBy("seq")
    rows = diff.withColumn("file_no", F.sum(header.cast("int")).over(order)).where("file_no > 0")
    new = (line.startswith("+") & ~line.startswith("+++")) | line.startswith(" ")
    old = (line.startswith("-") & ~line.startswith("---")) | line.startswith(" ")
    body = F.substring(line, F.lit(2), F.length(line))
    last = F.element_at(F.split(F.trim(line), r"\s+"), -1)
    side = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("seq", F.concat(body, F.lit("\n")).alias("t"))))), lambda x: x["t"]), "")
    out = rows.groupBy("diff_id", "file_no").agg(F.max(F.when(header, F.regexp_replace(last, "^[ab]/", ""))).alias("path"), side(old).alias("old_content"), side(new).alias("content"))
    return out.select("diff_id", "path", "old_content", "content")


def parse_coverage(profile: DataFrame) -> DataFrame:
    """(file, covered, total, pct) from (line_no, value); without a ``mode:`` header first, ValueError; odd lines are passed over."""
    first = profile.where("line_no = 1").select(F.trim("value").alias("v")).first()
    if first is not None and not (first["v"] or "").startswith("mode:"):
        raise ValueError("invalid cover profile: missing mode header")
    text = F.trim("value")
    pattern = r"^(\S+):\S* (-?[0-9]+) (-?[0-9]+)$"
    rows = profile.where("line_no > 1").where(text.rlike(pattern))
    rows = rows.select(F.regexp_extract(text, pattern, 1).alias("file"), F.regexp_extract(text, pattern, 2).try_cast("long").alias("n"), F.regexp_extract(text, pattern, 3).try_cast("long").alias("hits"))
    out = rows.groupBy("file").agg(F.sum(F.when(F.col("hits") > 0, F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("total"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(0.0))
