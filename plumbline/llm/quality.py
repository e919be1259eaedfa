"""Quality rules: a threshold table compiled into one Spark projection.

``features`` derives per-text counts with built-in functions only (no user
functions, no shuffle: every row is handled where it is read). ``compile_rules``
turns a table of ``Rule`` rows into one boolean expression over them.

Defined results: a null or empty text has no words, all counts 0, fails the base
rules and is not kept. Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at
``\\n``. Repeated rows are judged one by one. Only the id and text columns are
read, so further columns of any name cannot clash.

Three-word windows that recur are found by sorting packed (hash, position)
numbers; the few positions whose hashes meet are then compared by their words,
so a clash of hashes never counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that it for on with as was be by are at this from or an have not "
    "der die das und in zu den von mit ist im für auf dem ein eine sich nicht es "
    "de la le les et des en un une que est pour dans qui par sur pas du au "
    "el los las y del se una por con para al lo como su no "
    "il di che per non si da una sono della "
    "o os as do da em um uma com não para "
    "het een van en dat op te zijn met voor"
).split()

#: Low 30 bits of a packed number hold a word's position (a text has under 2**30 words), the others a hash.
_POSITION_BITS = 30


@dataclass(frozen=True)
class Rule:
    """Keep texts whose ``metric`` (SQL over the features) lies within [low, high]; None: no bound."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The default table. Ratios over an empty base are 0.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 16.0),
    Rule("symbol_ratio", "n_symbols / greatest(word_chars, 1)", None, 0.05),
    Rule("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.50),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.30),
    Rule("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)", None, 0.90),
    Rule("upper_word_ratio", "n_upper_words / greatest(n_words, 1)", None, 0.60),
)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ...) for each row."""
    text = F.coalesce(F.col("t"), F.lit(""))
    n = F.size("w")
    at = lambda i: [F.col("w")[i + k] for k in range(3)]
    nothing = F.array().cast("array<bigint>")
    d = docs.select(F.col(id_col), text.alias("t")) if text_col == "t" else docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select(
        id_col,
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.withColumn(
        "packed",
        F.sort_array(
            F.when(n >= 3, F.transform(F.sequence(F.lit(0).cast("long"), (n - 3).cast("long")), lambda i: F.shiftleft(F.xxhash64(*at(i.cast("int"))), _POSITION_BITS).bitwiseOR(i))).otherwise(nothing)
        ),
    )
    high = lambda x: F.shiftright(x, _POSITION_BITS)
    d = d.withColumn("meets", F.filter("packed", lambda x, i: (high(x) == high(F.get("packed", i - 1))) | (high(x) == high(F.get("packed", i + 1)))))
    d = d.withColumn(
        "windows",
        F.sort_array(
            F.transform(
                "meets",
                lambda x: F.struct(F.concat_ws(" ", *at(x.bitwiseAND((1 << _POSITION_BITS) - 1).cast("int"))).alias("words"), x.bitwiseAND((1 << _POSITION_BITS) - 1).alias("at")),
            )
        ),
    )
    same = lambda x, i: x["words"] == F.get("windows", i)["words"]
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])))
    seen = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    repeated = F.aggregate("starts", seen, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(3).cast("long"), i - a["last"])).alias("total")), lambda a: a["total"])
    long_size = lambda c: F.size(c).cast("long")
    return d.select(
        id_col,
        long_size("w").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        long_size("lines").alias("n_lines"),
        long_size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop_words"),
        long_size(F.filter("w", lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))).alias("n_upper_words"),
        long_size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("n_ellipsis_lines"),
        long_size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•‣–]\s"))).alias("n_bullet_lines"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, list[Column]]:
    """One expression that is true if all rules hold, and the metrics as columns."""
    verdict = F.lit(True)
    metrics = []
    for rule in rules:
        value = F.expr(rule.metric)
        metrics.append(value.alias(rule.name))
        if rule.low is not None:
            verdict = verdict & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (value <= F.lit(float(rule.high)))
    return verdict, metrics


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Features, ``base_failed``, ``kept`` and each rule's metric, one row for each row of ``docs``."""
    verdict, metrics = compile_rules(rules)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return features(docs, id_col, text_col).select(id_col, *counts, failed.alias("base_failed"), (~failed & verdict).alias("kept"), *metrics)
