"""Diff filters, commands, fix packets, merges, header rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lines, re2_to_java


def architectural_diff(files: DataFrame, prefixes: tuple[str, ...], min_lines: int = 10) -> DataFrame:
    """(diff_id, total_files, total_add, total_delete, trivial) of the files below one of ``prefixes``; diffs without such files are trivial."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("filename").startswith(p)
    add, delete = (F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)) for c in ("additions", "deletions"))
    out = files.groupBy("diff_id").agg(F.count_if(keep).alias("total_files"), add.alias("total_add"), delete.alias("total_delete"))
    return out.withColumn("trivial", (F.col("total_files") == 0) | (F.col("total_add") + F.col("total_delete") < min_lines))


def slash_command(body: Column, command: str = "/adr") -> Column:
    """Struct (action, args), null if the text is no command; unknown actions are ``help``."""
    text = F.trim(F.regexp_replace(body, r"^\s+|\s+$", ""))
    parts = F.split(F.regexp_replace(F.substring(text, F.lit(len(command) + 1), F.length(text)), r"^\s+", ""), r"\s+")
    action = F.lower(F.get(parts, F.lit(0)))
    known = action.isin("accept", "reject", "update", "help")
    args = F.when(known, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.when(text.startswith(command), F.struct(F.when(known, action).otherwise("help").alias("action"), args.alias("args")))


def merged_request(payload: Column) -> Column:
    """Whether a webhook's JSON tells of a closed and merged request."""
    x = F.from_json(payload, "action string, pull_request struct<merged:boolean,merge_commit_sha:string>")
    return F.coalesce((x["action"] == "closed") & (x["pull_request"]["merged"]) & (x["pull_request"]["merge_commit_sha"] != ""), F.lit(False))


def signature(payload: bytes, secret: bytes) -> str:
    """The HMAC of a payload as ``sha256=..``."""
    import hashlib
    import hmac

    return "sha256=" + hmac.new(secret, payload, hashlib.sha256).hexdigest()


# The packet's fields.
GATE = r"(?i)gate[:\s]+([a-zA-Z0-9_\-]+)"
SEVERITY = r"(?i)severity[:\s]+(critical|error|warning|info|warn|err|crit|information)"
FILES = r"(?i)files?[:\s]+(.+)"
PLACE = r"^(.*?)(?::([0-9]+)(?:\s*[-:]\s*([0-9]+))?)?$"
STEP = r"^\s*([0-9]+)[.)\s]\s+(.+)"
PROTECTED = r"(?i)do_not_touch[:\s]+(.+)"
MOST_FILES = r"(?i)max_files[:\s]+([0-9]+)"
PARADIGM = r"(?i)paradigm[:\s]+(\S+)"
VERIFY = r"(?i)verif(?:y|ication)[:\s]+(.+)"


def _of_lines(text: Column, pattern: str, group: int) -> Column:
    """A group of each line that matches, in order."""
    every = F.split(text, "\n")
    return F.transform(F.filter(every, lambda x: x.rlike(pattern)), lambda x: F.trim(F.regexp_extract(x, pattern, group)))


def _parts(found: Column) -> Column:
    """Parts between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def parse_packet(text: Column) -> Column:
    """Struct of a fix packet's text; null if it names neither a gate nor a step. A file may end in ``:start`` or ``:start-end`` (Q19)."""
    gate = F.regexp_extract(text, GATE, 1)
    level = F.lower(F.regexp_extract(text, SEVERITY, 1))
    severity = F.when(level.isin("critical", "crit"), "critical").when(level.isin("error", "err"), "error").when(level.isin("info", "information"), "info").otherwise("warning")
    number = lambda x, k: F.coalesce(F.regexp_extract(x, PLACE, k).try_cast("int"), F.lit(0))
    file = lambda x: F.struct(F.trim(F.regexp_extract(x, PLACE, 1)).alias("path"), number(x, 2).alias("start"), F.when(number(x, 3) > 0, number(x, 3)).otherwise(number(x, 2)).alias("end"))
    steps = _of_lines(text, STEP, 2)
    protected = F.regexp_extract(text, PROTECTED, 1)
    packet = F.struct(
        gate.alias("gate"),
        severity.alias("severity"),
        F.transform(_parts(_of_lines(text, FILES, 1)), file).alias("files"),
        steps.alias("steps"),
        F.when(protected == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(protected, ","), lambda x: F.trim(x))).alias("protected"),
        F.coalesce(F.regexp_extract(text, MOST_FILES, 1).try_cast("int"), F.lit(0)).alias("max_files"),
        F.regexp_extract(text, PARADIGM, 1).alias("paradigm"),
        _of_lines(text, VERIFY, 1).alias("verification"),
    )
    return F.when((gate != "") | (F.size(steps) > 0), packet)


# Gates that a new file meets.
DOCUMENT_GATES = ("missing_readme", "missing_contributing", "missing_license", "missing_changelog", "missing_docs_dir")
REWRITES = ("cyclomatic_complexity", "nested_callbacks")


def strategy(gate: Column, steps: Column, rewrites: tuple[str, ...] = REWRITES) -> Column:
    """Create a file, rewrite, delegate, or skip."""
    mention = lambda s: F.exists(F.array(*[F.lit(r) for r in rewrites]), lambda r: F.lower(s).contains(F.replace(r, F.lit("_"), F.lit(" "))) | F.lower(s).contains(r))
    return F.when(gate.isin(*DOCUMENT_GATES), "create").when(gate.isin(*rewrites) | F.exists(steps, mention), "rewrite").when(F.size(steps) > 0, "delegate").otherwise("skip")


def violates(files: Column, protected: Column, max_files: Column) -> Column:
    """A protected file or more files than allowed, null if neither."""
    touched = F.exists(files, lambda f: F.exists(protected, lambda p: f["path"].startswith(p)))
    return F.when(touched, "protected path").when((max_files > 0) & (F.size(files) > max_files), "too many files")


def conflicts(pairs: DataFrame) -> DataFrame:
    """(path, line, original, shadow) of lines that differ, from (path, original, shadow); a missing line counts as empty."""
    a = lines(pairs.select("path", F.col("original").alias("text"))).select("path", "line", F.col("text").alias("original"))
    b = lines(pairs.select("path", F.col("shadow").alias("text"))).select("path", "line", F.col("text").alias("shadow"))
    both = a.join(b, ["path", "line"], "full").na.fill("", ["original", "shadow"])
    return both.where("original <> shadow").select("path", "line", "original", "shadow")


def merge(pairs: DataFrame, how: str = "last_write") -> DataFrame:
    """(path, merged, n_conflicts); ``auto`` lets the shadow win unless its line is empty, ``manual`` merges only pairs without conflicts."""
    split = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    rows = pairs.select("path", F.coalesce("shadow", F.lit("")).alias("shadow"), F.arrays_zip(split("original"), split("shadow")).alias("z"))
    fields = rows.schema["z"].dataType.elementType.names
    o, s = (lambda x: F.coalesce(x[fields[0]], F.lit(""))), (lambda x: F.coalesce(x[fields[1]], F.lit("")))
    n = F.size(F.filter("z", lambda x: o(x) != s(x))).cast("long")
    auto = F.array_join(F.transform("z", lambda x: F.when(s(x) == "", o(x)).otherwise(s(x))), "\n")
    merged = auto if how == "auto" else F.when(n == 0, F.col("shadow")) if how == "manual" else F.col("shadow")
    return rows.select("path", merged.alias("merged"), n.alias("n_conflicts"))


def content_hash(text: Column) -> Column:
    """T28."""
    return F.sha2(text, 256)


def rewrite_headers(headers: Column, rules: list[dict[str, str]]) -> Column:
    """Rules {action, match (regex), replace, new_name} applied in turn to a map from name to values; of names renamed alike, the last in order stays."""
    out = headers
    for rule in rules:
        out = _rewritten(out, rule.get("action") or "set", re2_to_java(rule["match"]), rule)
    return out


def _rewritten(headers: Column, action: str, pattern: str, rule: dict[str, str]) -> Column:
    hit = lambda name: name.rlike(pattern)
    if action == "remove":
        return F.map_filter(headers, lambda k, v: ~hit(k))
    if action == "rename":
        kept = F.map_filter(headers, lambda k, v: ~hit(k) & (k != rule["new_name"]))
        moved = F.array_sort(F.map_keys(F.map_filter(headers, lambda k, v: hit(k))))
        value = F.try_element_at(headers, F.element_at(moved, F.size(moved)))
        return F.when(F.size(moved) > 0, F.map_concat(kept, F.create_map(F.lit(rule["new_name"]), value))).otherwise(headers)
    new = F.lit(rule["replace"])
    if action == "append":
        return F.transform_values(headers, lambda k, v: F.when(hit(k), F.concat(v, F.array(new))).otherwise(v))
    return F.transform_values(headers, lambda k, v: F.when(hit(k), F.array(new)).otherwise(v))
