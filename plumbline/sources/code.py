"""Source code as graphs: file discovery and lexical parsing.

There is no compiler here: Python files go through Python's own parser, other
languages through a lexer that knows comments, strings and brackets. Files come
by Spark's readers, so any store will do; each is parsed where it is read.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id string, name string, package string, file string, line bigint, kind string, receiver string, exported boolean, signature string"
EDGE = "src string, dst string, call_type string"

# Extensions of the polyglot parser, and those that rules are applied to.
LANGUAGES = ((".py", "Python"), (".rs", "Rust"), (".ts", "TypeScript"), (".tsx", "TypeScript"), (".js", "JavaScript"), (".jsx", "JavaScript"))
RULE_LANGUAGES = ((".go", "go"), (".py", "python"), (".js", "javascript"), (".ts", "typescript"))
SKIPPED = r"(^|/)(\.[^/]+|node_modules|vendor|__pycache__)/"


def language(path: Column) -> Column:
    """By extension, without regard to case; ``Unknown`` otherwise."""
    out = F.lit("Unknown")
    for ext, name in LANGUAGES:
        out = F.when(F.lower(path).endswith(ext), name).otherwise(out)
    return out


def rule_language(path: Column) -> Column:
    """S5, for rules: by the last three bytes, with regard to case."""
    out = F.lit("unknown")
    for ext, name in RULE_LANGUAGES:
        out = F.when(path.endswith(ext), name).otherwise(out)
    return out


def exported(lang: Column, name: Column, declaration: Column) -> Column:
    """Go by an upper-case first letter, Python without a leading underscore, Rust by ``pub``, the others by ``export``."""
    return (
        F.when(lang == "Go", name.rlike(r"^\p{Lu}"))
        .when(lang == "Python", (name != "") & ~name.startswith("_"))
        .when(lang == "Rust", declaration.rlike(r"\bpub\b"))
        .when(lang.isin("TypeScript", "JavaScript"), F.ltrim(declaration).startswith("export "))
        .otherwise(False)
    )


def discoverable(path: Column) -> Column:
    """S3: the path lies in no hidden folder, no folder of dependencies and no cache."""
    return ~path.rlike(SKIPPED)


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """S3: (path, content) of the files below ``root``, hidden folders, dependencies and caches left out; paths are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.substring_index(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), f"{base}/", -1)
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).where(discoverable(F.col("path")))


def packages(files: DataFrame) -> DataFrame:
    """(name, path, files, imports) of each folder; imports as Go's and Python's files state them. A folder's list of files is its result."""
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    go = F.regexp_extract_all("content", F.lit(r'(?m)^\s*(?:import\s+)?(?:[A-Za-z_.][A-Za-z0-9_]*\s+)?"([^"\n]+)"\s*$'), F.lit(1))
    python = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    found = F.when(F.col("path").endswith(".go"), go).when(F.col("path").endswith(".py"), python).otherwise(F.array().cast("array<string>"))
    declared = F.nullif(F.regexp_extract("content", r"(?m)^package\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))
    rows = files.select(folder.alias("dir"), "path", found.alias("i"), declared.alias("d"))
    out = rows.groupBy("dir").agg(F.min("d").alias("d"), F.sort_array(F.collect_set("path")).alias("files"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("i")))).alias("imports"))
    return out.select(F.coalesce("d", F.substring_index("dir", "/", -1)).alias("name"), F.col("dir").alias("path"), "files", "imports")


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.DOTALL)
_GO_FUNC = re.compile(r"(?m)^func\s*(?:\(\s*(?:(?P<var>\w+)\s+)?\*?(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?(?P<sig>\([^)]*\)[^{\n]*)")
_CALL = re.compile(r"(?<![\w.)\]])(?:(?P<left>\w+)\s*\.\s*)?(?P<name>\w+)\s*\(")
_GO_WORDS = frozenset("if for switch select return go defer func range map chan interface struct type var const package import case else".split())
_SCRIPT_FUNC = re.compile(r"(?m)^(?P<head>[^\n]*?)\b(?:function\s*\*?\s*(?P<a>\w+)\s*|fn\s+(?P<b>\w+)\s*(?:<[^>]*>)?\s*|(?:const|let|var)\s+(?P<c>\w+)\s*=\s*(?:async\s*)?(?=\())(?P<sig>\([^)]*\))")
_SCRIPT_WORDS = frozenset("if for while switch catch return function fn match loop await new typeof super import".split())


def _blanked(text: str) -> str:
    """Comments and literals as spaces, line ends kept."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def parse_go(path: str, text: str, package: str) -> tuple[list[dict], list[dict]]:
    """Functions and calls of a Go file. Calls belong to the last declaration before them; a bare name is the package's, ``x.f`` stays as it is."""
    clean = _blanked(text)
    marks = list(_GO_FUNC.finditer(clean))
    nodes, edges = [], []
    for k, m in enumerate(marks):
        recv = m["recv"] or ""
        node = f"{package}.{recv}.{m['name']}" if recv else f"{package}.{m['name']}"
        nodes.append({"id": node, "name": m["name"], "package": package, "file": path, "line": clean.count("\n", 0, m.start()) + 1, "kind": "method" if recv else "function", "receiver": recv, "exported": m["name"][:1].isupper(), "signature": "func" + text[m.start("sig") : m.end("sig")].rstrip()})
        body = clean[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(clean)]
        for c in _CALL.finditer(body):
            if c["left"]:
                edges.append({"src": node, "dst": f"{c['left']}.{c['name']}", "call_type": "direct"})
            elif c["name"] not in _GO_WORDS:
                edges.append({"src": node, "dst": f"{package}.{c['name']}", "call_type": "direct"})
    return nodes, edges


def parse_python(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Python by its own parser; a file that does not parse has nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    package = path.rpartition("/")[0] or "."
    functions = [x for x in ast.walk(tree) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
    nodes, edges = [], set()
    for f in functions:
        nodes.append({"id": f"{path}:{f.name}", "name": f.name, "package": package, "file": path, "line": f.lineno, "kind": "function", "receiver": "", "exported": not f.name.startswith("_"), "signature": f"({ast.unparse(f.args)})"})
    for call in (x for x in ast.walk(tree) if isinstance(x, ast.Call)):
        name = call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else ""
        inside = [f for f in functions if f.lineno <= call.lineno <= (f.end_lineno or f.lineno)]
        if name and inside:
            edges.add((f"{path}:{min(inside, key=lambda f: f.lineno).name}", f"{path}:{name}"))
    return nodes, [{"src": a, "dst": b, "call_type": "direct"} for a, b in sorted(edges)]


def parse_script(path: str, text: str, lang: str) -> tuple[list[dict], list[dict]]:
    """Rust, TypeScript and JavaScript by a lexer; calls belong to the last declaration before them, repeated ones count once."""
    clean = _blanked(text)
    package = path.rpartition("/")[0] or "."
    marks = list(_SCRIPT_FUNC.finditer(clean))
    nodes, edges = [], set()
    for k, m in enumerate(marks):
        name = m["a"] or m["b"] or m["c"]
        head = m["head"].strip()
        out = bool(re.search(r"\bpub\b", head)) if lang == "Rust" else head.startswith("export")
        nodes.append({"id": f"{path}:{name}", "name": name, "package": package, "file": path, "line": clean.count("\n", 0, m.start("sig")) + 1, "kind": "function", "receiver": "", "exported": out, "signature": m["sig"]})
        body = clean[m.end() : marks[k + 1].start("head") if k + 1 < len(marks) else len(clean)]
        edges |= {(f"{path}:{name}", f"{path}:{c['name']}") for c in _CALL.finditer(body) if c["name"] not in _SCRIPT_WORDS}
    return nodes, [{"src": a, "dst": b, "call_type": "direct"} for a, b in sorted(edges)]


def _parse(path: str, text: str, module: str) -> tuple[list[dict], list[dict]]:
    low = path.lower()
    if low.endswith(".go"):
        folder = path.rpartition("/")[0]
        return parse_go(path, text, "/".join(x for x in (module, folder) if x) or "main")
    if low.endswith(".py"):
        return parse_python(path, text)
    for ext, name in LANGUAGES:
        if low.endswith(ext):
            return parse_script(path, text, name)
    return [], []


def parse_files(files: DataFrame, module: str = "") -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of (path, content). Unknown languages and null contents have none."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def rows(which: int, schema: pa.Schema):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [x for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if path and text for x in _parse(path, text, module)[which]]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

        return work

    pair = files.select("path", "content")
    nodes, edges = (pair.mapInArrow(rows(k, to_arrow_schema(_parse_datatype_string(kind))), kind) for k, kind in enumerate((NODE, EDGE)))
    return nodes, edges


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q1: edges whose callee is no node but ends, after its last dot, like exactly one node's name, led to that node; the others as they are."""
    by_name = nodes.groupBy("name").agg(F.min("id").alias("_id"), F.count("*").alias("_n")).where("_n = 1")
    known = nodes.select(F.col("id").alias("dst")).distinct().withColumn("_known", F.lit(True))
    x = edges.join(known, "dst", "left").withColumn("_short", F.substring_index("dst", ".", -1)).join(by_name, F.col("_short") == F.col("name"), "left")
    return x.select("src", F.when(F.col("_known"), F.col("dst")).otherwise(F.coalesce("_id", "dst")).alias("dst"), "call_type")
