"""Document governance: types, freshness, validation, recommendations.

Documents: (path, content, mod_time). Types are a small table given as data. Ages
are measured against an explicit ``as_of`` (Q12), in seconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import glob_to_regex

DAY = 86_400


@dataclass(frozen=True)
class DocType:
    """Patterns are globs of a whole relative path; ages in days, 0 for none; fields of the front matter that must be there."""

    type: str
    patterns: tuple[str, ...]
    required: bool
    max_days: int
    warn_days: int
    validator: str
    fields: tuple[str, ...]


# The default types, in the order in which patterns are tried.
TYPES = (
    DocType("adr", ("adr/*.md", "docs/adr/*.md", "architecture/decisions/*.md"), True, 90, 30, "madr", ("title", "status", "context", "decision", "consequences")),
    DocType("api_spec", ("api/*.yaml", "api/*.yml", "api/*.json", "docs/api/*.yaml", "specs/*.yaml"), True, 30, 7, "openapi", ("openapi", "info", "paths")),
    DocType("api_changelog", ("api/changelog*.md", "docs/api/changelog*.md", "docs/api-changelog*.md"), False, 90, 30, "api_changelog", ("title", "versions")),
    DocType("arch_overview", ("docs/arch/context*.md", "architecture/context*.md", "docs/c4/context*.md"), True, 180, 60, "c4_context", ("title", "context")),
    DocType("arch_container", ("docs/arch/container*.md", "architecture/container*.md", "docs/c4/container*.md"), False, 180, 60, "c4_container", ("title", "containers")),
    DocType("arch_component", ("docs/arch/component*.md", "architecture/component*.md", "docs/c4/component*.md"), False, 180, 60, "c4_component", ("title", "components")),
    DocType("runbook", ("runbooks/*.md", "docs/runbooks/*.md", "ops/runbooks/*.md"), True, 90, 30, "runbook", ("title", "steps", "owner", "severity")),
    DocType("disaster_recovery", ("runbooks/disaster-recovery*.md", "docs/disaster-recovery*.md", "ops/disaster-recovery*.md"), False, 90, 30, "disaster_recovery", ("title", "steps", "owner", "severity")),
    DocType("runbook_operational", ("runbooks/operational*.md", "docs/runbooks/operational*.md", "ops/runbooks/*.md"), False, 90, 30, "runbook_operational", ("title", "steps", "owner", "severity")),
    DocType("incident_playbook", ("runbooks/incident*.md", "docs/incident*.md", "ops/incident*.md"), True, 60, 14, "incident_playbook", ("title", "triage", "roles", "escalation", "communication")),
    DocType("threat_model", ("security/threat-model*.md", "docs/security/threat*.md", "threat-model/*.md"), True, 90, 30, "stride", ("title", "system", "threats", "mitigations")),
    DocType("data_dictionary", ("docs/data/dictionary*.md", "data/dictionary*.md", "schemas/*.md"), False, 180, 60, "data_dictionary", ("title", "tables")),
    DocType("slo", ("docs/slo*.md", "slo/*.md", "observability/slo*.md"), True, 90, 30, "slo", ("title", "slis", "slo_targets", "error_budget")),
    DocType("postmortem", ("postmortems/*.md", "docs/postmortems/*.md", "incidents/*.md"), False, 0, 0, "postmortem", ("title", "summary", "timeline", "root_cause", "action_items")),
    DocType("changelog", ("CHANGELOG.md", "changelog.md", "CHANGES.md", "docs/changelog.md"), True, 30, 7, "changelog", ("title", "versions")),
    DocType("migration_guide", ("migrations/*.md", "docs/migration-guide*.md", "docs/migrations/*.md"), False, 90, 30, "migration_guide", ("title", "from_version", "to_version")),
    DocType("release_notes", ("RELEASE*.md", "docs/release*.md", "releases/*.md"), False, 90, 30, "release_notes", ("title", "version", "highlights", "breaking_changes")),
    DocType("code_guide", ("docs/code-guide*.md", "CONTRIBUTING.md", "docs/contributing*.md"), False, 180, 60, "code_guide", ("title", "standards")),
)


@dataclass(frozen=True)
class Keywords:
    """Of ``words``, at least ``least`` must occur anywhere in the lower-cased content, or ``penalty`` is taken off."""

    words: tuple[str, ...]
    least: int
    penalty: float


# What each validator looks for.
VALIDATORS: dict[str, tuple[Keywords, ...]] = {
    "madr": (Keywords(("context",), 1, 0.1), Keywords(("decision",), 1, 0.1), Keywords(("consequence",), 1, 0.1)),
    "c4_context": (Keywords(("system", "external", "user", "person", "actor"), 2, 0.15),),
    "c4_container": (Keywords(("container", "service", "database", "queue", "api", "frontend", "backend"), 2, 0.15),),
    "c4_component": (Keywords(("component", "responsibility", "interface", "dependency", "module", "service"), 2, 0.15),),
    "runbook": (Keywords(("prerequisite", "step", "verification", "rollback", "reference"), 3, 0.15),),
    "runbook_operational": (Keywords(("steps", "monitoring", "checks", "alerts", "rollback", "verification"), 3, 0.15),),
    "disaster_recovery": (Keywords(("recovery", "restore", "backup", "failover", "replication", "rto", "rpo"), 3, 0.15),),
    "incident_playbook": (Keywords(("triage", "role", "escalation", "communication", "diagnosis", "mitigation"), 4, 0.15),),
    "stride": (Keywords(("spoofing", "tampering", "repudiation", "information disclosure", "denial of service", "elevation of privilege"), 4, 0.15),),
    "data_dictionary": (Keywords(("table", "field", "column"), 1, 0.15),),
    "slo": (Keywords(("sli", "slo", "error budget", "burn rate"), 3, 0.15),),
    "postmortem": (Keywords(("summary", "timeline", "root cause", "action item", "lesson"), 4, 0.15),),
    "changelog": (Keywords(("added", "changed", "deprecated", "removed", "fixed", "security"), 1, 0.2), Keywords(("## [", "### ["), 1, 0.15)),
    "api_changelog": (Keywords(("added", "changed", "deprecated", "removed", "fixed", "breaking"), 2, 0.15), Keywords(("## [", "### ["), 1, 0.1)),
    "migration_guide": (Keywords(("prerequisite", "upgrade", "migration", "rollback", "compatibility", "verification", "steps"), 3, 0.15),),
    "release_notes": (Keywords(("highlight", "breaking change", "migration", "deprecat", "bug fix", "new feature"), 3, 0.15),),
    "code_guide": (Keywords(("godoc", "jsdoc", "rustdoc", "docstring", "comment", "example", "naming", "format"), 3, 0.15),),
}
#: These read no front matter.
PLAIN = ("openapi", "changelog", "release_notes", "code_guide")
STATUSES = ("proposed", "accepted", "rejected", "deprecated", "superseded")
SEVERITIES = ("sev-0", "sev-1", "sev-2", "sev-3", "0", "1", "2", "3")


def _case(pairs: list[tuple[Column, object]], other: object = None) -> Column:
    out = F.lit(other)
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def doc_type(path: Column, types: tuple[DocType, ...] = TYPES) -> Column:
    """The first type one of whose patterns fits the path, null if none."""
    return _case([(path.rlike("|".join(glob_to_regex(p) for p in t.patterns)), t.type) for t in types])


def _of_type(kind: Column, value, types: tuple[DocType, ...], other: object = None) -> Column:
    """A value by type, looked up in a constant map: ``kind`` stands once in it, so filters on it stay small."""
    known = [F.lit(x) for t in types if (v := value(t)) is not None for x in (t.type, v)]
    found = F.element_at(F.create_map(*known), kind) if known else F.lit(None)
    return found if other is None else F.coalesce(found, F.lit(other))


def staleness(age: Column, max_age: Column, warn_age: Column) -> Column:
    """Of an age and its limits in the same unit; a limit of 0 or null is none."""
    most, warn = F.coalesce(max_age, F.lit(0)), F.coalesce(warn_age, F.lit(0))
    return F.when((most == 0) & (warn == 0), "unknown").when((most > 0) & (age > most), "stale").when((warn > 0) & (age > warn), "warning").otherwise("fresh")


def age_seconds(mod_time: Column, as_of: str) -> Column:
    return F.timestamp_diff("SECOND", mod_time.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))


def staleness_report(files: DataFrame, paths: DataFrame, as_of: str, max_age: int, warn_age: int) -> DataFrame:
    """(level, n) of the ``paths`` that exist among ``files`` (path, mod_time)."""
    level = staleness(age_seconds(F.col("mod_time"), as_of), F.lit(max_age), F.lit(warn_age))
    return files.join(paths.select("path").distinct(), "path", "left_semi").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


FRONT = r"\A\x{FEFF}?(?:[ \t\r]*\n)*[ \t\r]*---[ \t\r]*\n((?:.*\n)*?)[ \t\r]*---[ \t\r]*(?:\n|\z)"


def front_matter(content: Column) -> Column:
    """The text between the leading and the next ``---`` line, null if there is none."""
    return F.when(content.rlike(FRONT), F.regexp_extract(content, FRONT, 1))


def body(content: Column) -> Column:
    """What follows the front matter; the content itself without one."""
    return F.when(content.rlike(FRONT), F.trim(F.regexp_replace(content, FRONT, ""))).otherwise(content)


def keys(front: Column) -> Column:
    """The top-level keys of a front matter, by the text (a YAML parser is not needed for that)."""
    return F.regexp_extract_all(F.coalesce(front, F.lit("")), F.lit(r"(?m)^[\"']?([A-Za-z0-9_][A-Za-z0-9_ -]*?)[\"']?[ \t]*:(?:[ \t\r]|$)"), F.lit(1))


def scalar(front: Column, key: str) -> Column:
    """A top-level string value, null if absent or empty; lists, maps, numbers and booleans are no strings."""
    raw = F.trim(F.regexp_extract(F.coalesce(front, F.lit("")), rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t\r]*$", 1))
    quoted = raw.rlike("^\"[^\"]*\"$|^'[^']*'$")
    plain = (raw != "") & ~raw.rlike(r"^[\[{|>&*!%@`#]|^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$|^(true|false|yes|no|on|off|null|~|True|False|Null|NULL)$")
    return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).when(plain, raw)


def string_list(front: Column, key: str) -> Column:
    """The strings of a top-level list, in brackets or in lines that begin with a dash; what is no string is left out, an absent list is empty."""
    text = F.coalesce(front, F.lit(""))
    inline = F.split(F.regexp_extract(text, rf"(?m)^{key}[ \t]*:[ \t]*\[([^\]]*)\]", 1), ",")
    block = F.regexp_extract_all(F.regexp_extract(text, rf"(?m)^{key}[ \t]*:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|\z))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
    every = F.transform(F.concat(inline, block), lambda x: F.trim(x))
    bare = F.filter(every, lambda x: (x != "") & ~x.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$|^(true|false|yes|no|on|off|null|~)$|^[\[{]"))
    return F.transform(bare, lambda x: F.regexp_replace(x, "^[\"'](.*)[\"']$", "$1"))


def _title(front: Column, text: Column, path: Column) -> Column:
    named = scalar(front, "title")
    heading = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*##? (.*)$", 1))
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(F.when(F.length(named) > 0, named), F.when(text.rlike(r"(?m)^[ \t]*##? "), heading), name)


def title(content: Column, path: Column) -> Column:
    """Of the front matter, else the first heading of level one or two, else the file's name without extension."""
    return _title(front_matter(content), body(content), path)


def status(value: Column) -> Column:
    """D5. Fixed values; others stay as they are."""
    return F.when(value.isin("accepted", "approved"), "approved").when(value.isin("proposed", "rejected"), "review").otherwise(value)


def missing_fields(front: Column, fields: Column) -> Column:
    """Required fields that the front matter lacks; without a front matter, one entry that says so."""
    return F.when(front.isNull(), F.array(F.lit("frontmatter"))).otherwise(F.array_except(fields, keys(front)))


def _parsed(docs: DataFrame, types: tuple[DocType, ...], *more: str) -> DataFrame:
    """Typed documents with their front matter and body, which are looked for once a document."""
    rows = docs.withColumn("type", doc_type(F.col("path"), types)).where("type IS NOT NULL")
    content = F.coalesce("content", F.lit(""))
    validator = _of_type(F.col("type"), lambda t: t.validator, types)
    fields = F.from_json(_of_type(F.col("type"), lambda t: "[" + ",".join(f'"{f}"' for f in t.fields) + "]", types), "array<string>")
    rows = rows.select("path", "type", *more, content.alias("_content"), F.lower(content).alias("_low"), F.regexp_extract(content, FRONT, 0).alias("_head"), validator.alias("_v"), fields.alias("_fields"))
    has = F.col("_head") != ""
    rest = F.trim(F.substring("_content", F.length("_head") + 1, F.length("_content")))
    return rows.select("*", F.when(has, F.regexp_extract("_head", FRONT, 1)).alias("_front"), F.when(has, rest).otherwise(F.col("_content")).alias("_body"))


def _judged(rows: DataFrame) -> DataFrame:
    """``_parsed`` rows with ``score`` and ``_lacking``."""
    plain = F.col("_v").isin(*PLAIN)
    openapi = _openapi_missing(F.col("_content"))
    lacking = F.when(F.col("_v") == "openapi", openapi).when(plain, F.array().cast("array<string>")).otherwise(missing_fields(F.col("_front"), F.col("_fields")))
    rows = rows.withColumn("_lacking", lacking)
    score = F.lit(1.0) - F.when(~plain & F.col("_front").isNull(), 0.3).otherwise(0.0) - 0.2 * F.size("_lacking")
    for name, groups in VALIDATORS.items():
        for g in groups:
            n = sum((F.col("_low").contains(w).cast("int") for w in g.words), F.lit(0))
            score = score - F.when((F.col("_v") == name) & (n < g.least), g.penalty).otherwise(0.0)
    odd_status = ~F.lower(scalar(F.col("_front"), "status")).isin(*STATUSES)
    odd_severity = ~F.lower(scalar(F.col("_front"), "severity")).isin(*SEVERITIES)
    score = score - F.when((F.col("_v") == "madr") & odd_status, 0.1).otherwise(0.0) - F.when(F.col("_v").isin("runbook", "runbook_operational") & odd_severity, 0.1).otherwise(0.0)
    score = score - F.when(F.col("_v") == "openapi", _openapi_penalty(F.col("_content"))).otherwise(0.0)
    return rows.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 6))


def validate(docs: DataFrame, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """(path, type, score, valid, missing) of typed documents: 1 less the penalties, at least 0; valid without missing fields."""
    return _judged(_parsed(docs, types)).select("path", "type", "score", (F.size("_lacking") == 0).alias("valid"), F.array_join("_lacking", ",").alias("missing"))


def _has_key(content: Column, key: str) -> Column:
    return content.rlike(rf"(?m)^[\"']?{key}[\"']?[ \t]*:|[{{,]\s*\"{key}\"\s*:")


def _openapi_missing(content: Column) -> Column:
    return F.filter(F.array(*[F.when(~_has_key(content, k), F.lit(k)) for k in ("openapi", "info", "paths")]), lambda x: x.isNotNull())


def _openapi_penalty(content: Column) -> Column:
    """A version other than 3, and an info without title or version, a tenth each."""
    other = content.rlike(r"(?m)^\s*[\"']?openapi[\"']?\s*:\s*[\"']?[0-24-9]")
    info = _has_key(content, "info")
    part = lambda k: ~content.rlike(rf"(?m)^[ \t]+[\"']?{k}[\"']?[ \t]*:")
    empty = content.rlike(r"(?m)^[\"']?paths[\"']?[ \t]*:[ \t]*\{[ \t]*\}")
    return sum((F.when(c, 0.1).otherwise(0.0) for c in (other, info & part("title"), info & part("version"), empty)), F.lit(0.0))


def registry(docs: DataFrame, as_of: str, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """(path, type, title, status, level, age_days, score, valid) of typed documents."""
    rows = _judged(_parsed(docs, types, "mod_time"))
    age = age_seconds(F.col("mod_time"), as_of)
    most, warn = _of_type(F.col("type"), lambda t: t.max_days * DAY, types), _of_type(F.col("type"), lambda t: t.warn_days * DAY, types)
    return rows.select(
        "path",
        "type",
        _title(F.col("_front"), F.col("_body"), F.col("path")).alias("title"),
        F.coalesce(status(scalar(F.col("_front"), "status")), F.lit("draft")).alias("status"),
        staleness(age, most, warn).alias("level"),
        F.floor(age / DAY).alias("age_days"),
        "score",
        (F.size("_lacking") == 0).alias("valid"),
    )


def listing(reg: DataFrame, type: str | None = None, status: str | None = None, level: str | None = None) -> DataFrame:
    """Rows of the registry that fit the filters."""
    for name, value in (("type", type), ("status", status), ("level", level)):
        if value:
            reg = reg.where(F.col(name) == value)
    return reg


def get(reg: DataFrame, path: str, root: str = "") -> DataFrame:
    """The document of a relative path, or of an absolute one below ``root``."""
    return reg.where(F.col("path") == (path.removeprefix(root).lstrip("/") if root and path.startswith(root) else path))


def by_type(reg: DataFrame) -> DataFrame:
    """(type, n, valid)."""
    return reg.groupBy("type").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def missing_required(reg: DataFrame, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """(type) that must exist and does not."""
    wanted = reg.sparkSession.createDataFrame([(t.type,) for t in types if t.required], "type string")
    return wanted.join(reg.select("type").distinct(), "type", "left_anti")


# Fixed values: (type, signals any of which recommends it, priority, reason).
ADVICE = (
    ("arch_container", ("overview",), 95, "an overview exists; show containers and technologies"),
    ("postmortem", ("runbooks",), 90, "runbooks exist; record incidents with action items"),
    ("disaster_recovery", ("runbooks",), 88, "runbooks exist; write recovery down before an outage"),
    ("code_guide", ("code",), 85, "there is code; keep comments and names consistent"),
    ("api_changelog", ("api",), 82, "an API exists; tell its changes apart"),
    ("release_notes", ("changelog",), 80, "a changelog exists; summarise it for users"),
    ("migration_guide", ("api", "changelog"), 78, "releases are tracked; ease upgrades"),
    ("arch_component", ("overview", "code"), 72, "an overview or code exists; describe components"),
    ("data_dictionary", ("data",), 70, "there are data files; describe tables and fields"),
    ("runbook_operational", ("runbooks",), 68, "runbooks exist; keep recurring procedures apart"),
)
CODE = r"(?i)\.(go|js|ts|jsx|tsx|py|rs|java|rb|php|c|h|cpp|sh)$"
DATA = ("data/*.sql", "data/*.db", "data/*.sqlite*", "schemas/*.yml", "schemas/*.yaml", "migrations/*.sql", "migrations/*.yml", "migrations/*.yaml", "docs/data/*.md")
API = ("api/*.yaml", "api/*.yml", "api/*.json", "docs/api/*.yaml", "docs/api/*.yml", "docs/api/*.json", "specs/*.yaml", "specs/*.yml", "specs/*.json")


def recommendations(reg: DataFrame, files: DataFrame, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """(type, priority, reason) of optional types that are absent and that ``files`` (path) or documents call for; highest priority first, then by type."""
    path, kind = F.col("path"), F.col("type")
    any_of = lambda patterns: path.rlike("|".join(glob_to_regex(p) for p in patterns))
    skipped = path.rlike(r"(^|/)(\.git|node_modules|vendor)/")
    seen = files.agg(F.bool_or(path.rlike(CODE) & ~skipped).alias("code"), F.bool_or(any_of(DATA)).alias("data"), F.bool_or(any_of(API)).alias("api_file"))
    docs = reg.agg(F.bool_or(kind == "api_spec").alias("api_doc"), F.bool_or(kind == "changelog").alias("changelog"), F.bool_or(kind == "arch_overview").alias("overview"), F.bool_or(kind.isin("runbook", "incident_playbook")).alias("runbooks"))
    signals = seen.crossJoin(docs).select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("code", "data", "changelog", "overview", "runbooks")], (F.coalesce("api_file", F.lit(False)) | F.coalesce("api_doc", F.lit(False))).alias("api"))
    optional = {t.type for t in types if not t.required}
    rows = [F.struct(F.lit(t).alias("type"), F.lit(p).alias("priority"), F.lit(r).alias("reason"), F.greatest(*[F.col(s).cast("int") for s in (*on, on[0])]).alias("on")) for t, on, p, r in ADVICE if t in optional]
    advice = signals.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("on = 1").drop("on")
    return advice.join(reg.select("type").distinct(), "type", "left_anti").orderBy(F.desc("priority"), "type")


def freshness_lists(reg: DataFrame) -> DataFrame:
    """The stale and the warned documents."""
    return reg.where("level IN ('stale', 'warning')").select("path", "title", "type", "age_days", "level")


def freshness_summary(reg: DataFrame) -> DataFrame:
    """(total, fresh, warning, stale, unknown)."""
    n = lambda v: F.count_if(F.col("level") == v)
    return reg.agg(F.count("*").alias("total"), n("fresh").alias("fresh"), n("warning").alias("warning"), n("stale").alias("stale"), n("unknown").alias("unknown"))


def registry_stats(reg: DataFrame, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """(part, name, n): by type, status and level, invalid documents, missing required types. The registry is read once."""
    one = lambda part, name, n=1: F.struct(F.lit(part).alias("part"), name.alias("name"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n"))
    parts = F.array(*[one(c, F.col(c)) for c in ("type", "status", "level")], one("invalid", F.lit(""), F.when(F.col("valid"), 0).otherwise(1)))
    none = reg.sparkSession.createDataFrame([("invalid", "", 0)], "part string, name string, n long")
    counts = reg.select(F.explode(parts).alias("x")).select("x.*").union(none).groupBy("part", "name").agg(F.sum("n").alias("n"))
    lacking = missing_required(counts.where("part = 'type'").select(F.col("name").alias("type")), types).agg(F.count("*").alias("n"))
    return counts.unionByName(lacking.select(F.lit("required_missing").alias("part"), F.lit("").alias("name"), "n"))


def suggestions(reg: DataFrame, files: DataFrame, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """D11 at priority 100, and D12."""
    wanted = missing_required(reg, types).select("type", F.lit(100).alias("priority"), F.lit("required by governance policy").alias("reason"))
    return wanted.unionByName(recommendations(reg, files, types))


def refresh(reg: DataFrame, changed: DataFrame, removed: DataFrame, as_of: str, types: tuple[DocType, ...] = TYPES) -> DataFrame:
    """The registry with ``changed`` documents registered anew and ``removed`` (path) taken out."""
    gone = changed.select("path").unionByName(removed.select("path")).distinct()
    return reg.join(gone, "path", "left_anti").unionByName(registry(changed.join(removed.select("path"), "path", "left_anti"), as_of, types).select(*reg.columns))
