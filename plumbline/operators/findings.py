"""Findings: report flattening, normalisation, summaries and deduplication.

Findings: (seq, rule_id, prefix, category, rule, level, severity, message, file,
line, tool, fingerprint, ts). ``seq`` orders rows where order matters. A null
string counts as empty. Wherever the first of several rows is kept, ties go to the
least ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.fold import fold

REPORT_SCHEMA = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,version:string>>,"
    "results array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,"
    "region:struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>>>>,"
    "fingerprints:map<string,string>>>,timestamps:struct<startTime:string,endTime:string>>>"
).replace("results array", "results:array")

#: Families of rule ids, most trusted first; pass others as an argument.
PREFIXES = ("deps.dependabot", "ast.complexity", "adr.conflict", "standards.gap")
UNKNOWN_PREFIX = "sarif"


def parse_reports(docs: DataFrame, version: str = "2.1.0") -> DataFrame:
    """``docs`` (seq, doc) with ``report``, parsed; rows of another version or that do not parse have none."""
    report = F.from_json("doc", REPORT_SCHEMA)
    return docs.select("seq", F.when(report["version"] == version, report).alias("report"))


def flatten(reports: DataFrame) -> DataFrame:
    """one row per result; the first location only, the run's start time or else its end."""
    runs = reports.select("seq", F.posexplode("report.runs").alias("run_no", "run"))
    rows = runs.select("seq", "run_no", F.col("run.tool.driver").alias("tool"), F.coalesce("run.timestamps.startTime", "run.timestamps.endTime").alias("time"), F.posexplode("run.results").alias("result_no", "r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(
        F.col("seq").alias("report_seq"),
        "run_no",
        "result_no",
        F.col("r.ruleId").alias("rule_id"),
        F.coalesce("r.level", F.lit("")).alias("level"),
        F.col("r.message.text").alias("message"),
        F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("file"),
        F.coalesce(place["region"]["startLine"], F.lit(0)).alias("line"),
        F.coalesce(place["region"]["startColumn"], F.lit(0)).alias("column"),
        F.col("tool.name").alias("tool"),
        F.col("tool.version").alias("tool_version"),
        F.to_timestamp("time").alias("ts"),
        F.col("r.fingerprints").alias("fingerprints"),
    )


def fingerprint(rule: Column, file: Column, line: Column) -> Column:
    """sha256 of rule, file and line with a zero byte between."""
    zero = F.lit("\0")
    return F.sha2(F.concat(F.coalesce(rule, F.lit("")), zero, F.coalesce(file, F.lit("")), zero, F.coalesce(line, F.lit(0)).cast("string")), 256)


def pick_fingerprint(found: Column, rule: Column, file: Column, line: Column) -> Column:
    """the value of the least key that names ``sha256`` or ``vulnerability``, else F3."""
    keys = F.array_sort(F.filter(F.map_keys(found), lambda k: k.contains("sha256") | k.contains("vulnerability")))
    return F.coalesce(F.try_element_at(found, F.get(keys, F.lit(0))), fingerprint(rule, file, line))


def normalise_rule(rule_id: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """struct (prefix, category, rule): what follows a known prefix is ``category.rule`` or ``rule``."""
    none = F.struct(F.lit(UNKNOWN_PREFIX).alias("prefix"), F.lit("").alias("category"), rule_id.alias("rule"))
    out = none
    for p in reversed(prefixes):
        rest = F.substring(rule_id, F.lit(len(p) + 2), F.length(rule_id))
        parts = F.split(rest, r"\.", 2)
        two = F.size(parts) == 2
        known = F.struct(F.lit(p).alias("prefix"), F.when(two, parts[0]).otherwise("").alias("category"), F.when(two, parts[1]).otherwise(rest).alias("rule"))
        out = F.when(rule_id.startswith(p + "."), known).otherwise(out)
    return out


def severity(level: Column) -> Column:
    """F5. Fixed values."""
    low = F.lower(level)
    return F.when(low.isin("error", "warning", "note"), low).otherwise("none")


def severity_weight(level: Column) -> Column:
    """F5. 4, 3, 2, 0."""
    return F.when(level == "error", 4).when(level == "warning", 3).when(level == "note", 2).otherwise(0)


def external_severity(level: Column) -> Column:
    """F20. Fixed values."""
    return F.when(level == "error", "High").when(level == "warning", "Medium").when(level == "note", "Low").otherwise("Info")


def summary(findings: DataFrame, top: int = 10) -> DataFrame:
    """(part, name, n): totals, by severity, tool and prefix, distinct files, and the ``top`` rules (a report of its nature)."""
    name = lambda part, c: findings.groupBy(F.coalesce(c, F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    total = findings.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("file") != "", F.col("file"))).alias("files"))
    whole = total.select(F.explode(F.array(F.struct(F.lit("total").alias("part"), F.lit("").alias("name"), F.col("n")), F.struct(F.lit("files").alias("part"), F.lit("").alias("name"), F.col("files").alias("n")))).alias("x")).select("x.*")
    rules = name("rule", F.col("rule_id")).orderBy(F.desc("n"), "name").limit(top)
    return whole.unionByName(name("severity", F.col("severity"))).unionByName(name("tool", F.col("tool"))).unionByName(name("prefix", F.col("prefix"))).unionByName(rules)


def _first(findings: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``findings`` with the first row's seq of each group, the row's number there and the group's size; aggregated before it is joined, so that no group meets in one task."""
    best = findings.groupBy(*keys).agg(F.min(F.struct(*order, F.col("seq").alias("_seq"))).alias("_b"), F.count("*").alias("group_size"))
    best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b._seq").alias("kept_seq"), "group_size")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return findings.join(best, on).drop(*[f"_{k}" for k in keys])


def dedup_fingerprint(findings: DataFrame) -> DataFrame:
    """findings with ``kept_seq`` (the first of their fingerprint), ``group_size`` and ``duplicate``."""
    return _first(findings, ["fingerprint"], []).withColumn("duplicate", F.col("seq") != F.col("kept_seq"))


def dedup_ratio(flagged: DataFrame, target: float = 0.30) -> DataFrame:
    """(original, kept, removed, ratio, target_met)."""
    removed = F.sum(F.col("duplicate").cast("long"))
    out = flagged.agg(F.count("*").alias("original"), F.coalesce(removed, F.lit(0)).alias("removed"))
    ratio = F.coalesce(F.try_divide("removed", "original"), F.lit(0.0))
    return out.select("original", (F.col("original") - F.col("removed")).alias("kept"), "removed", ratio.alias("ratio"), (ratio >= target).alias("target_met"))


def dedup_window(findings: DataFrame, hours: float = 24.0) -> DataFrame:
    """F8: (seq, rule_id, file, line, ts, kept_seq, duplicate): a row within ``hours`` (inclusive) of the last kept row of its rule, file and line is its duplicate.

    Rows are taken by time, then seq; a row without a time comes first and starts a window (Q5).
    """

    def step(last, row):
        ts = row["ts"]
        near = last is not None and last[0] is not None and ts is not None and (ts - last[0]).total_seconds() <= hours * 3600
        last = last if near else (ts, row["seq"])
        return last, {**row, "kept_seq": last[1], "duplicate": near}

    rows = findings.select("seq", "rule_id", "file", "line", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return fold(rows, ["rule_id", "file", "line"], [F.asc_nulls_first("ts"), "seq"], lambda key: None, step, "seq bigint, rule_id string, file string, line bigint, ts timestamp_ntz, kept_seq bigint, duplicate boolean")


def trust(prefix: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """a family's place in the order of trust, unknown ones last."""
    out = F.lit(len(prefixes) + 1)
    for k, p in enumerate(prefixes):
        out = F.when(prefix == p, k + 1).otherwise(out)
    return out


def dedup_cross_tool(findings: DataFrame, merge_across_tools: bool = False, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """findings with ``kept_seq`` and ``duplicate``; a duplicate is noted only if its fingerprint differs from the kept row's (``recorded``).

    The key holds the prefix, unless ``merge_across_tools``, when the most trusted prefix is kept (Q7).
    """
    keys = ["rule", "file", "line"] if merge_across_tools else ["prefix", "rule", "file", "line"]
    flagged = _first(findings, keys, [trust(F.col("prefix"), prefixes).alias("_t")]).withColumn("duplicate", F.col("seq") != F.col("kept_seq"))
    kept = findings.select(F.col("seq").alias("kept_seq"), F.col("fingerprint").alias("_fp"))
    return flagged.join(kept, "kept_seq").withColumn("recorded", F.col("duplicate") & (F.col("fingerprint") != F.col("_fp"))).drop("_fp")


def dedup_all(findings: DataFrame, cross_tool: bool = True, hours: float = 24.0) -> DataFrame:
    """what is left after F9 (if asked for), F7 and F8."""
    left = findings
    if cross_tool:
        left = dedup_cross_tool(left).where("NOT duplicate").select(*findings.columns)
    left = dedup_fingerprint(left).where("NOT duplicate").select(*findings.columns)
    return left.join(dedup_window(left, hours).where("NOT duplicate").select("seq"), "seq", "left_semi")


def staleness_action(age_hours: Column, threshold_hours: float, mode: str) -> Column:
    """F11. Fresh data is allowed; stale data blocked, allowed or warned of."""
    stale = {"block": "block", "ignore": "allow"}.get(mode, "warn")
    return F.when(age_hours <= threshold_hours, "allow").otherwise(stale)


#: Fixed value: a file with an extension, a colon and a line number.
PLACE = r"([^\s:]+\.[0-9A-Za-z_]+):([0-9]+)"


def locate(findings: DataFrame, strategy: str = "extract") -> DataFrame:
    """(seq, file, line, source) from the finding, its ``metadata`` (map), its message, or unknown; ``skip`` leaves those without out."""
    message = F.coalesce("message", F.lit(""))
    in_text = F.regexp_extract(message, PLACE, 1)
    own, meta = F.coalesce("file", F.lit("")), F.coalesce(F.try_element_at("metadata", F.lit("file_path")), F.lit(""))
    source = F.when(own != "", "sarif").when(meta != "", "metadata").when(in_text != "", "description").otherwise("unknown")
    file = F.when(own != "", own).when(meta != "", meta).otherwise(in_text)
    number = F.regexp_extract(F.coalesce(F.try_element_at("metadata", F.lit("line")), F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
    line = F.when(own != "", F.coalesce("line", F.lit(0))).when(meta != "", F.coalesce(number.try_cast("bigint"), F.lit(0))).otherwise(F.coalesce(F.regexp_extract(message, PLACE, 2).try_cast("bigint"), F.lit(0)))
    out = findings.select("seq", file.alias("file"), line.alias("line"), source.alias("source"))
    return out.where("source <> 'unknown'") if strategy == "skip" else out


def resolve_collisions(rules: DataFrame, existing: DataFrame, strategy: str = "prefix") -> DataFrame:
    """``rules`` (rule_id) with (resolved_id, strategy, conflict) against ``existing`` (rule_id).

    suffix: the least free number; taken numbers of an id are gathered as a set, which only that id's own variants enter.
    """
    taken = existing.select("rule_id").distinct()
    hit = rules.join(taken.withColumn("_hit", F.lit(True)), "rule_id", "left")
    if strategy == "suffix":
        number = F.regexp_extract("rule_id", r"^(.*)\.([1-9][0-9]{0,8})$", 2)
        base = F.regexp_extract("rule_id", r"^(.*)\.([1-9][0-9]{0,8})$", 1)
        numbers = taken.select(base.alias("rule_id"), number.try_cast("int").alias("n")).where("n IS NOT NULL").distinct()
        run = numbers.withColumn("k", F.row_number().over(Window.partitionBy("rule_id").orderBy("n"))).where("n = k").groupBy("rule_id").agg(F.max("n").alias("_last"))
        hit = hit.join(run, "rule_id", "left")
        new = F.concat_ws(".", "rule_id", (F.coalesce("_last", F.lit(0)) + 1).cast("string"))
    elif strategy == "prefix":
        parts = F.split("rule_id", r"\.", 2)
        new = F.when(F.size(parts) == 2, F.concat(parts[0], F.lit(".dup."), parts[1])).otherwise(F.concat(F.lit("unknown.dup."), "rule_id"))
    elif strategy == "reject":
        new = F.lit("")
    else:
        new = F.col("rule_id")
    named = strategy if strategy in ("prefix", "suffix", "reject") else "none"
    conflict = F.coalesce("_hit", F.lit(False))
    return hit.select("rule_id", F.when(conflict, new).otherwise(F.col("rule_id")).alias("resolved_id"), F.when(conflict, F.lit(named)).otherwise("none").alias("strategy"), conflict.alias("conflict"))


#: F14. What to do when a phase cannot be dispatched, as (part of the phase's name, advice).
FALLBACKS = (("scan", "use cached scan results"), ("review", "queue for manual review"), ("dedup", "skip deduplication"))


def fallback(phase: Column, ok: Column, rules: tuple[tuple[str, str], ...] = FALLBACKS) -> Column:
    """struct (status, advice) of a dispatch; the dispatch itself is no computation over data."""
    advice = F.lit("retry later")
    for part, text in reversed(rules):
        advice = F.when(phase.contains(part), text).otherwise(advice)
    return F.struct(F.when(ok, "dispatched").otherwise("fallback").alias("status"), F.when(ok, "").otherwise(advice).alias("advice"))


def sla(findings: DataFrame) -> DataFrame:
    """(total, open, closed, regression_rate)."""
    is_open = F.col("severity").isin("error", "warning")
    out = findings.agg(F.count("*").alias("total"), F.count_if(is_open).alias("open"))
    closed = F.col("total") - F.col("open")
    return out.select("total", "open", closed.alias("closed"), F.coalesce(F.try_divide(closed, "total"), F.lit(0.0)).alias("regression_rate"))


#: About how many characters of text and bytes of numbers a report document holds before a tool gets another one.
REPORT_BYTES = 1 << 20


def reports_of(findings: DataFrame, tool_version: str = "1.0", most: int = REPORT_BYTES) -> DataFrame:
    """(tool, part, doc): findings as report documents; level defaults to warning, a location only with a file.

    A tool has one document, part 0, or where its findings are more than about ``most``
    bytes as many as they fill, to which they are dealt by a hash. Each holds its
    findings in order.
    """
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    level = F.when(F.coalesce("level", F.lit("")) == "", "warning").otherwise(F.col("level"))
    result = F.struct(F.col("seq"), F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.when(F.col("file") != "", place).alias("locations"))
    held = F.lit(160) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("rule_id", "level", "message", "file")), F.lit(0))
    large = findings.groupBy(F.col("tool").alias("_tool")).agg(F.sum(held.cast("long")).alias("n")).where(F.col("n") > most)
    large = large.select("_tool", F.ceil(F.col("n") / most).alias("_parts"))  # no more rows than documents
    part = F.coalesce(F.pmod(F.xxhash64("seq", "rule_id", "file", "line", "message"), F.col("_parts")), F.lit(0).cast("long"))
    dealt = findings.select("tool", result.alias("result"), "seq", "rule_id", "file", "line", "message").join(F.broadcast(large), F.col("tool").eqNullSafe(F.col("_tool")), "left")
    rows = dealt.select("tool", part.alias("part"), "result").repartition("tool", "part").groupBy("tool", "part").agg(F.sort_array(F.collect_list("result")).alias("r"))
    results = F.transform("r", lambda x: x.dropFields("seq"))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name"), F.lit(tool_version).alias("version")).alias("driver")).alias("tool"), results.alias("results"))
    return rows.select("tool", "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("doc"))
