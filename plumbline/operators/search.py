"""Symbol search over nodes: fuzzy, regex, signature, exact, prefix, substring, kind, callers and callees.

A query is a handful of literals, so names are matched by expressions in one scan,
without an index or a join; only the best ``limit`` rows, if asked for, are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import re2_to_java, trigrams
from plumbline.operators import graph as g

THRESHOLD = 0.3


def overlap(name: Column, query: str) -> Column:
    """How many of the query's trigrams, repeated ones each, the name has."""
    low = query.lower()
    of_query = [low] if len(low) < 3 else [low[i : i + 3] for i in range(len(low) - 2)]
    have = F.array_distinct(trigrams(name))
    return sum((F.array_contains(have, t).cast("int") for t in of_query), F.lit(0))


def similarity(name: Column, query: str) -> Column:
    """.7 of the Levenshtein likeness and .3 of the trigrams' (fixed values)."""
    n = overlap(name, query)
    of_query = max(1, len(query) - 2)
    trigram = n / (of_query + F.size(trigrams(name)) - n)
    distance = F.levenshtein(F.lit(query.lower()), F.lower(name))
    most = F.greatest(F.lit(len(query)), F.length(name))
    return 0.7 * (1.0 - distance / most) + 0.3 * trigram


def match_kind(name: Column, query: str) -> Column:
    """N5."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, "exact").when(low.startswith(q), "prefix").when(low.contains(q), "substring").otherwise("fuzzy")


def fuzzy(names: DataFrame, query: str, threshold: float = THRESHOLD) -> DataFrame:
    """(name, score, match) of distinct names that share a trigram with the query and score ``threshold`` or more."""
    name = F.col("name")
    found = names.select("name").distinct().where((overlap(name, query) > 0) & (F.length(name) > 0))
    return found.select("name", similarity(name, query).alias("score"), match_kind(name, query).alias("match")).where(F.col("score") >= threshold)


def rank(score: Column, match: Column, fan_in: Column, kind: Column, name: Column) -> Column:
    """N6. Fixed values: .4, .25 (100 callers), .15 for functions and methods that begin with A-Z, .1 by kind, .1 or .05 by match; 0 to 1."""
    capital = kind.isin("function", "method") & name.rlike("^[A-Z]")
    by_kind = F.when(kind == "function", 1.0).when(kind == "method", 0.8).when(kind == "type", 0.6).when(kind == "package", 0.4).otherwise(0.5)
    total = 0.4 * score + 0.25 * F.least(fan_in / 100.0, F.lit(1.0)) + F.when(capital, 0.15).otherwise(0.0) + 0.1 * by_kind + F.when(match == "exact", 0.1).when(match == "prefix", 0.05).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def ranked(nodes: DataFrame, edges: DataFrame, matched: DataFrame) -> DataFrame:
    """``matched`` (id, match, base) with their rank: (id, name, kind, match, score, callers, callees), best first, ties by id."""
    d = g.degrees(nodes, edges)
    rows = matched.join(nodes, "id").join(d, "id")
    score = rank(F.col("base"), F.col("match"), F.col("fan_in"), F.col("kind"), F.col("name"))
    return rows.select("id", "name", "kind", "match", F.round(score, 6).alias("score"), F.col("fan_in").alias("callers"), F.col("fan_out").alias("callees")).orderBy(F.desc("score"), "id")


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name, ..) of nodes whose name or short name is among ``names`` (name, score, match); of both, the better (Q4)."""
    whole = nodes.select("id", F.col("name").alias("_n"))
    short = nodes.select("id", g.short_name(F.col("name")).alias("_n"))
    hits = whole.unionByName(short).distinct().join(names, F.col("_n") == F.col("name"))
    return hits.groupBy("id").agg(F.max(F.struct("score", "match")).alias("b")).select("id", F.col("b.score").alias("base"), F.col("b.match").alias("match"))


# The node kinds of search kinds.
KINDS = {"function": ("function",), "method": ("method",), "struct": ("type",), "interface": ("type",), "all": None}


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    kinds = KINDS[kind]
    return found if kinds is None else found.where(F.col("kind").isin(*kinds))


def search_fuzzy(nodes: DataFrame, edges: DataFrame, query: str, kind: str = "all", threshold: float = THRESHOLD) -> DataFrame:
    """Names and short names, matched and ranked."""
    both = nodes.select("name").unionByName(nodes.select(g.short_name(F.col("name")).alias("name")))
    return of_kind(ranked(nodes, edges, resolve(nodes, fuzzy(both, query, threshold))), kind)


def _fixed(nodes: DataFrame, test: Column, match: str, base: float = 1.0) -> DataFrame:
    return nodes.where(test).select("id", F.lit(base).alias("base"), F.lit(match).alias("match"))


def search_regex(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """Unanchored, over name or short name."""
    p = re2_to_java(pattern)
    return ranked(nodes, edges, _fixed(nodes, F.col("name").rlike(p) | g.short_name(F.col("name")).rlike(p), "regex"))


def search_neighbours(nodes: DataFrame, edges: DataFrame, node: str, callers: bool) -> DataFrame:
    """Nodes that call, or are called by, ``node`` within ten steps."""
    return g.bounded(edges, node, 0, reverse=callers).join(nodes, "id").select("id", "name", "kind", F.lit("caller" if callers else "callee").alias("match"), F.lit(1.0).alias("score"))


def parameter_types(signature: Column) -> Column:
    """The last word of each part between commas in the first pair of brackets; brackets within are not understood."""
    inside = F.regexp_extract(signature, r"^[^(]*\(([^)]*)\)", 1)
    parts = F.filter(F.transform(F.split(inside, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_extract(x, r"(\S+)$", 1))


def return_types(signature: Column) -> Column:
    """What follows the balanced first pair of brackets, outer brackets off, parts between commas."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "(", 1).when((c == ")") & (s["depth"] > 0), -1).otherwise(0)
        closed = (c == ")") & (s["depth"] == 1) & (s["end"] == 0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(signature, ""), state, step, lambda s: s["end"])
    rest = F.trim(F.when(end > 0, F.substring(signature, end + 1, F.length(signature))).otherwise(""))
    rest = F.when(rest == "{", "").otherwise(F.regexp_replace(F.regexp_replace(rest, r"^\(", ""), r"\)$", ""))
    return F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")


def matches_types(nodes: DataFrame, params: list[str] | None = None, returns: str | None = None, receiver: str | None = None, exact: bool = False) -> Column:
    """N11's condition: every parameter type asked for is part of one that is there; so the return type; a method's signature has the receiver."""
    signature = F.coalesce("signature", F.lit(""))
    is_in = (lambda a, p: a == p) if exact else (lambda a, p: a.contains(p))
    test = signature != ""
    if receiver:
        test = test & ((F.col("kind") != "method") | is_in(signature, receiver))
    if params:
        actual = parameter_types(signature)
        test = test & (F.size(actual) >= len(params))
        for p in params:
            test = test & _any(actual, is_in, p)
    if returns:
        test = test & _any(return_types(signature), is_in, returns)
    return test


def _any(values: Column, is_in: Callable[[Column, str], Column], wanted: str) -> Column:
    return F.exists(values, lambda a: is_in(a, wanted))


def search_types(nodes: DataFrame, params: list[str] | None = None, returns: str | None = None, receiver: str | None = None) -> DataFrame:
    """N11."""
    return nodes.where(matches_types(nodes, params, returns, receiver)).select("id", "name", "kind", F.lit("type").alias("match"), F.lit(0.8).alias("score"))


def search_exact(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Name or short name."""
    return ranked(nodes, edges, _fixed(nodes, (F.col("name") == name) | (g.short_name(F.col("name")) == name), "exact"))


def search_prefix(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """Without regard to case."""
    low = prefix.lower()
    return ranked(nodes, edges, _fixed(nodes, F.lower("name").startswith(low) | F.lower(g.short_name(F.col("name"))).startswith(low), "prefix"))


def search_substring(nodes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """With regard to case."""
    return ranked(nodes, edges, _fixed(nodes, F.col("name").contains(part), "substring"))


def search_kind(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """N14."""
    return ranked(nodes, edges, _fixed(nodes, F.col("kind") == kind, "kind"))


def search(nodes: DataFrame, edges: DataFrame, *, caller_of: str = "", callee_of: str = "", params: list[str] | None = None, returns: str = "", regex: str = "", pattern: str = "", mode: str = "fuzzy", kind: str = "all", limit: int = 50) -> DataFrame:
    """The first of callers, callees, types, regex and pattern that is given; ``mode`` of a pattern: fuzzy, exact, prefix, substring or kind (Q6). The limit is the search's own."""
    if caller_of:
        found = search_neighbours(nodes, edges, caller_of, True)
    elif callee_of:
        found = search_neighbours(nodes, edges, callee_of, False)
    elif params or returns:
        found = search_types(nodes, params, returns)
    elif regex or (pattern and mode == "regex"):
        found = search_regex(nodes, edges, regex or pattern)
    elif not pattern:
        raise ValueError("empty query")
    else:
        modes = {"exact": search_exact, "prefix": search_prefix, "substring": search_substring, "kind": search_kind}
        found = modes[mode](nodes, edges, pattern) if mode in modes else search_fuzzy(nodes, edges, pattern)
    return of_kind(found, kind).orderBy(F.desc("score"), "id").limit(limit)
