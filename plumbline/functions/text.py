"""Text helpers: lines, regex dialects, globs, redaction, trigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def re2_to_java(pattern: str) -> str:
    r"""The pattern with ASCII word boundaries: Java's ``\b`` knows Unicode letters, RE2's does not."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(_EDGE if pattern[i + 1] == "b" and not in_class else pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """A whole-path regex: ``*`` and ``?`` stay within a path part, ``**`` does not, ``[..]`` is a class."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return "^" + "".join(out) + "$"


def simple_glob(path: Column, pattern: str) -> Column:
    """T20's globs: all, a prefix before ``*``, a suffix behind it, or the whole."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*"):
        return path.startswith(pattern[:-1])
    if pattern.startswith("*"):
        return path.endswith(pattern[1:])
    return path == pattern


def lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without its text, one row per line: (.., line from 1, text). A null text has no lines."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(F.split(F.col(text_col), "\n")).alias("_k", "text")).select(*others, (F.col("_k") + 1).cast("long").alias("line"), "text")


def redact(text: Column) -> Column:
    """Three characters at either end stay of more than six (in bytes)."""
    return F.when(F.octet_length(text) <= 6, "***").otherwise(F.concat(F.substring(text, 1, 3), F.repeat(F.lit("*"), F.octet_length(text) - 6), F.right(text, F.lit(3))))


def trigrams(text: Column) -> Column:
    """Windows of three characters of the lower-cased text; a shorter text is its only one."""
    low = F.lower(text)
    n = F.length(low)
    return F.when(n < 3, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, 0 for an empty text.

    Characters are sorted, so equal ones stand together; the lengths of these runs
    tell how often each occurs.
    """
    n = F.length(text)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = F.transform(runs, lambda r: F.length(r) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda bits, k: bits - k * F.log2(k))).otherwise(0.0)
