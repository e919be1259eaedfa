"""Mixing sources to target weights by temperature.

A source with t tokens gets weight t**a / sum(t**a). The exponent a in [0, 1] is
bisected: it is the largest that reaches a target entropy of the weights (nats),
or the smallest that keeps every source within ``max_repeats`` passes. Six
bisections at a time are evaluated by one aggregation over the sources, however
many there are; only those sums reach the driver.

The total budget defaults to the least for which every row is used once; source
i is then repeated r_i = weight_i * budget / t_i >= 1 times: ``floor(r_i)`` whole
passes, each in an order of its own (md5 of seed, pass and id), and of a last pass
the longest beginning whose tokens stay within the remaining budget, cut where a
2**-24 part of the order would exceed it. A pass is cut into blocks of about
``block_tokens``; a block's ``position`` in (0, 1) spreads each source's blocks
evenly, so that ordering by position realises the weights all along the mixture.

Only built-in functions are used. Cutting the last pass needs sums over 4,096
parts of each source and then of one part, never the source in one task.

Defined results: a null source is a source of its own; a null id is ordered as the
text ``null``; sources without tokens are passed over once; null texts have no
tokens. Repeated rows are rows like others (they share their place in the order).
Other columns, whatever their names, are carried along. Texts of any length count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._shared import shared_dir, written

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, ROUNDS = 6, 5
#: Up to so many sources their parameters are broadcast.
BROADCAST_SOURCES = 10_000


def token_table(docs: DataFrame, root: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, n_tokens) of every row, written to the shared folder; tokens are words here."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("n_tokens")), root, "tokens")


def _measures(sources: DataFrame, exponents: list[float]) -> list[dict]:
    """For each exponent: the weights' entropy and the ratio of the most to the least repeats, by one aggregation."""
    t = F.col("t").cast("double")
    sums: list[Column] = []
    for k, a in enumerate(exponents):
        p = F.pow(t / F.col("all"), F.lit(a))
        sums += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(t / F.col("all"))).alias(f"l{k}"), F.max(F.pow(t, F.lit(a - 1))).alias(f"x{k}"), F.min(F.pow(t, F.lit(a - 1))).alias(f"n{k}")]
    row = sources.agg(*sums).first()
    return [{"entropy": math.log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"], "repeats": row[f"x{k}"] / row[f"n{k}"]} for k, a in enumerate(exponents)]


def bisect_exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent over sources (t, all) with tokens, to 2**-30, rounded to 6 decimals.

    0 or 1 if the target cannot be met or needs no change.
    """
    if target_entropy is not None:
        raise_it = lambda m: m["entropy"] >= target_entropy  # noqa: E731  the exponent may grow further
    else:
        raise_it = lambda m: m["repeats"] > max_repeats
    at_none, at_one = _measures(sources, [0.0, 1.0])
    if target_entropy is not None and raise_it(at_one):
        return 1.0
    if not raise_it(at_none):
        return 0.0
    low, step = 0.0, 1.0
    for _ in range(ROUNDS):
        step /= 1 << LEVELS
        grid = [low + step * k for k in range(1, 1 << LEVELS)]
        measures = dict(zip(grid, _measures(sources, grid), strict=True))
        for level in range(LEVELS):  # the bisections proper
            middle = low + step * (1 << (LEVELS - 1 - level))
            if raise_it(measures[middle]):
                low = middle
    return round(low + (step if target_entropy is None else 0.0), 6)


def order_of(pass_: Column, id_: Column, seed: int) -> Column:
    """A row's place in a pass: 48 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), pass_.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long")


def plan(tokens: DataFrame, root: str, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, block_tokens: int = 100_000, seed: int = 0) -> DataFrame:
    """(source, t, weight, repeats, passes, cut, blocks) of every source, a table in the shared folder.

    cut: the last, partial pass takes the rows whose place in 2**24 parts is below it.
    """
    by = tokens.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    by = written(by, root, "sources")
    total = by.agg(F.sum("t")).first()[0] or 0
    some = by.where("t > 0").withColumn("all", F.lit(float(total)))
    if not total:
        return by.select("source", "t", F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("cut"), F.lit(1).cast("long").alias("blocks"))
    a = bisect_exponent(some, target_entropy, max_repeats if target_entropy is None else None)
    share = F.pow(F.col("t") / F.lit(float(total)), F.lit(a))
    first = some.agg(F.sum(share).alias("z"), F.max(F.col("t") / share).alias("least")).first()
    scale = first["least"] if budget is None else budget / first["z"]
    repeats = F.when(F.col("t") > 0, F.round(F.lit(scale) * share / F.col("t"), 9)).otherwise(1.0)
    found = by.select(
        "source",
        "t",
        F.when(F.col("t") > 0, F.round(share / F.lit(first["z"]), 9)).otherwise(0.0).alias("weight"),
        repeats.alias("repeats"),
        F.floor(repeats).alias("passes"),
        F.floor((repeats - F.floor(repeats)) * F.col("t")).alias("rest"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("t") / block_tokens)).alias("blocks"),
    )
    found = written(found, root, "repeats")
    rows = tokens.join(_small(found.where("rest > 0").select(F.col("source").alias("s"), "passes", "rest")), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("s", "rest", "n_tokens", F.shiftright(order_of(F.col("passes"), F.col("id"), seed), 24).alias("place"))
    upto = Window.partitionBy("s").orderBy("part")
    coarse = rows.groupBy("s", "rest", F.shiftright("place", 12).alias("part")).agg(F.sum("n_tokens").alias("n")).withColumn("cum", F.sum("n").over(upto))
    over = coarse.where("cum > rest").groupBy("s").agg(F.min(F.struct("part", (F.col("cum") - F.col("n")).alias("before"))).alias("f")).select("s", "f.part", "f.before")
    over = written(over, root, "coarse").withColumnRenamed("part", "high")
    inside = rows.withColumnRenamed("s", "_s").join(_small(over), F.col("_s").eqNullSafe(F.col("s")) & (F.shiftright("place", 12) == F.col("high")))
    fine = inside.groupBy("s", "rest", "before", F.col("place").alias("part")).agg(F.sum("n_tokens").alias("n")).withColumn("cum", F.col("before") + F.sum("n").over(upto))
    cuts = fine.where("cum > rest").groupBy("s").agg(F.min("part").alias("cut"))
    done = found.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(done.select("source", "t", "weight", "repeats", "passes", F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(1 << 24))).otherwise(0).cast("long").alias("cut"), "blocks"), root, "plan")


def _small(df: DataFrame) -> DataFrame:
    """A table with a row per source: broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def realise(rows: DataFrame, sources: DataFrame, id_col: str, source_col: str, seed: int = 0) -> DataFrame:
    """(row, mix): ``rows`` as structs, each as often as its source's plan says, with (copy, block, place, position)."""
    p = sources.select(F.col("source").alias("s"), F.struct("passes", "cut", "blocks", "repeats").alias("plan"))
    out = rows.select(F.struct(*rows.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    out = out.join(_small(p), F.col("source").eqNullSafe(F.col("s")))
    last = F.col("plan.passes") - F.when(F.col("plan.cut") > 0, 0).otherwise(1)
    out = out.select("row", "id", "plan", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))).alias("copy"))
    out = out.withColumn("place", order_of(F.col("copy"), F.col("id"), seed))
    out = out.where((F.col("copy") < F.col("plan.passes")) | (F.shiftright("place", 24) < F.col("plan.cut")))
    block = F.col("copy") * F.col("plan.blocks") + F.floor(F.col("place") / float(1 << 48) * F.col("plan.blocks"))
    position = F.round((block + 0.5) / F.ceil(F.col("plan.repeats") * F.col("plan.blocks")), 9)
    return out.select("row", F.struct("copy", block.alias("block"), "place", position.alias("position")).alias("mix"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **target) -> DataFrame:
    """(id_col, source, n_tokens, copy, block, position): one row for each use of a row of ``docs``."""
    root = shared_dir(docs.sparkSession)
    tokens = token_table(docs, root, id_col, text_col, source_col)
    found = realise(tokens, plan(tokens, root, seed=seed, **target), "id", "source", seed)
    return found.select(F.col("row.id").alias(id_col), "row.source", "row.n_tokens", "mix.copy", "mix.block", "mix.position")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **target) -> DataFrame:
    """``docs`` with its columns, every row repeated as often as the mixture uses it."""
    root = shared_dir(docs.sparkSession)
    tokens = token_table(docs, root, id_col, text_col, source_col)
    return realise(docs, plan(tokens, root, seed=seed, **target), id_col, source_col, seed).select("row.*")
