"""Memory: entities with decay, and hybrid retrieval by vector, text and graph.

Entities: (id, type, content, project, tags array, created_at, updated_at,
access_count, decay_score, embedding array of float). Relationships: (id,
source_id, target_id, kind, weight). Times are measured against ``as_of`` (Q12).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_dir, stored

# The legs' weights, a hop's decay, and the least activation that spreads.
VECTOR_WEIGHT, TEXT_WEIGHT, GRAPH_WEIGHT = 0.5, 0.3, 0.2
HOP_DECAY, LEAST_ACTIVATION = 0.8, 0.1
SEEDS = 5


def matches(types: list[str] | None = None, projects: list[str] | None = None, tags: list[str] | None = None) -> Column:
    """Any of the types, any of the projects, all of the tags (exact, Q8)."""
    test = F.lit(True)
    if types:
        test = test & F.col("type").isin(types)
    if projects:
        test = test & F.col("project").isin(projects)
    for tag in tags or []:
        test = test & F.coalesce(F.array_contains("tags", tag), F.lit(False))
    return test


def listing(entities: DataFrame, types: list[str] | None = None, projects: list[str] | None = None, tags: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """M1: a page of the entities that fit, last updated first, ties by id (the page is the operator's own)."""
    return entities.where(matches(types, projects, tags)).orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)


def text_candidates(entities: DataFrame, text: str) -> DataFrame:
    """M2: entities that contain ``text`` without regard to the case of letters (Q9), by decay, then update."""
    return entities.where(F.lower("content").contains(text.lower())).orderBy(F.desc("decay_score"), F.desc("updated_at"), "id")


def text_score(content: Column, text: str) -> Column:
    """M3: whole occurrences, with regard to case, over each hundred bytes and one; at most 1."""
    size = len(text.encode())
    n = (F.octet_length(content) - F.octet_length(F.replace(content, F.lit(text), F.lit("")))) / size
    return F.least(n / (F.floor(F.octet_length(content) / 100) + 1), F.lit(1.0))


def of_project(entities: DataFrame, project: str, limit: int = 100) -> DataFrame:
    """M4."""
    return entities.where(F.col("project") == project).orderBy(F.desc("decay_score"), F.desc("updated_at"), "id").limit(limit)


def cosine(a: Column, query: list[float]) -> Column:
    """M5: in double precision; 0 for vectors of another length, empty or without length."""
    q = [float(x) for x in query]
    norm = math.sqrt(sum(x * x for x in q))
    lit = F.array(*[F.lit(x) for x in q]) if q else F.array().cast("array<double>")
    dot = F.aggregate(F.zip_with(a, lit, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    own = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == len(q)) & (own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm if norm else 1.0))).otherwise(0.0)


def nearest(entities: DataFrame, query: list[float], k: int) -> DataFrame:
    """M6: the ``k`` entities of highest cosine, ties by id: exact, one scan, best k per task before they meet."""
    return entities.select("*", cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def vector_leg(entities: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.0, **filters) -> DataFrame:
    """M7: (id, score, source) of the 3 * limit nearest that fit the filters."""
    found = nearest(entities, query, 3 * limit).where(matches(**filters) & (F.col("score") >= min_score))
    return found.select("id", (F.col("score") * VECTOR_WEIGHT).alias("score"), F.lit("vector").alias("source"))


def text_leg(entities: DataFrame, text: str, **filters) -> DataFrame:
    """M8."""
    found = entities.where(F.lower("content").contains(text.lower())).where(matches(**filters))
    return found.select("id", (text_score(F.col("content"), text) * TEXT_WEIGHT).alias("score"), F.lit("text").alias("source"))


def graph_leg(entities: DataFrame, relationships: DataFrame, seeds: DataFrame, max_hops: int = 2, **filters) -> DataFrame:
    """M9: (id, score, source, seed): activation spreads from ``seeds`` (id) over weights, all seeds at once; the best arrival wins, ties by the least seed (Q11)."""
    root = shared_dir(entities.sparkSession)
    level = stored(seeds.select("id", F.lit(1.0).alias("activation"), F.col("id").alias("seed")), f"{root}/0")
    seen, parts = [level.select("id")], []
    for hop in range(1, max_hops + 1):
        out = level.where(F.col("activation") >= LEAST_ACTIVATION).join(relationships, F.col("id") == F.col("source_id"))
        arrived = out.select(F.col("target_id").alias("id"), (F.col("activation") * F.col("weight") * HOP_DECAY).alias("activation"), "seed")
        best = arrived.where("activation > 0").groupBy("id").agg(F.max("activation").alias("activation"), F.min_by("seed", F.struct(-F.col("activation"), "seed")).alias("seed"))
        level = stored(best.join(reduce(DataFrame.unionAll, seen), "id", "left_anti"), f"{root}/{hop}")
        if level.isEmpty():
            break
        seen.append(level.select("id"))
        parts.append(level)
    reached = reduce(DataFrame.unionAll, parts) if parts else level.where("false")
    fit = entities.where(matches(**filters)).select("id")
    return reached.join(fit, "id", "left_semi").select("id", (F.col("activation") * GRAPH_WEIGHT).alias("score"), F.lit("graph").alias("source"), "seed")


def hybrid(entities: DataFrame, relationships: DataFrame, text: str, query: list[float], limit: int = 10, min_score: float = 0.0, max_hops: int = 2, **filters) -> DataFrame:
    """(id, score, source): the best leg's score of each entity, ties by source; ``max_hops`` 0 turns the graph off. The limit is the search's own."""
    vector = vector_leg(entities, query, limit, min_score, **filters)
    legs = vector
    if text:
        legs = legs.unionByName(text_leg(entities, text, **filters))
    if max_hops:
        seeds = vector.orderBy(F.desc("score"), "id").limit(SEEDS).select("id")
        legs = legs.unionByName(graph_leg(entities, relationships, seeds, max_hops, **filters).drop("seed"))
    best = legs.groupBy("id").agg(F.max("score").alias("score"), F.min_by("source", F.struct(-F.col("score"), "source")).alias("source"))
    return best.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def days_between(since: Column, as_of: str) -> Column:
    return F.timestamp_diff("SECOND", since.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")) / 86_400.0


def retention(days: Column, access_count: Column) -> Column:
    """M12."""
    return F.least(F.greatest(F.exp(-days / (1.0 + 0.5 * access_count)), F.lit(0.0)), F.lit(1.0))


def decay(entities: DataFrame, as_of: str) -> DataFrame:
    """The entities; where the score changes by more than .01 it is written and ``updated_at`` becomes ``as_of``."""
    new = retention(days_between(F.col("updated_at"), as_of), F.col("access_count"))
    changed = F.abs(new - F.col("decay_score")) > 0.01
    return entities.withColumns({"decay_score": F.when(changed, new).otherwise(F.col("decay_score")), "updated_at": F.when(changed, F.lit(as_of).cast(entities.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))})


def accessed(entities: DataFrame, as_of: str) -> DataFrame:
    """The entities after one more access."""
    n = F.col("access_count") + 1
    boost = 1.0 + 0.1 * F.log1p(n.cast("double"))
    score = F.least(retention(days_between(F.col("updated_at"), as_of), n) * boost, F.lit(1.0))
    return entities.withColumns({"access_count": n, "decay_score": score, "updated_at": F.lit(as_of).cast(entities.schema["updated_at"].dataType)})


def prune(entities: DataFrame, threshold: float = 0.1) -> DataFrame:
    """What stays (Q13)."""
    return entities.where(F.col("decay_score") >= threshold)


def decay_stats(entities: DataFrame) -> DataFrame:
    """(n, avg, min, max); no row for no entities."""
    return entities.agg(F.count("*").alias("n"), F.avg("decay_score").alias("avg"), F.min("decay_score").alias("min"), F.max("decay_score").alias("max")).where("n > 0")


def stats(entities: DataFrame) -> DataFrame:
    """(type, n, avg_decay, oldest, newest) by type and, with type null, of all."""
    return entities.rollup("type").agg(F.count("*").alias("n"), F.avg("decay_score").alias("avg_decay"), F.min("created_at").alias("oldest"), F.max("updated_at").alias("newest"))


def relationships_of(relationships: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    """M18."""
    out, into = F.col("source_id") == entity, F.col("target_id") == entity
    return relationships.where({"out": out, "in": into, "both": out | into}[direction])


def traverse(relationships: DataFrame, entity: str, max_hops: int) -> DataFrame:
    """(id, depth, parent) within ``max_hops`` (breadth first, Q14)."""
    from plumbline.operators.graph import levels

    steps = relationships.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return levels(steps, relationships.sparkSession.createDataFrame([(entity,)], "id string"), max_hops).where("depth > 0")


def delete(entities: DataFrame, relationships: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entities of ``gone`` (id)."""
    left = relationships.join(gone, F.col("source_id") == gone["id"], "left_anti").join(gone, F.col("target_id") == gone["id"], "left_anti")
    return entities.join(gone, "id", "left_anti"), left


def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``new`` rows replace those with their keys; columns in ``keep`` stay as they were. Of several new rows the last by ``seq`` counts."""
    columns = [c for c in table.columns if c not in keys]
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), "seq").alias("_n"))
    value = lambda c: F.when(F.col("_n").isNotNull() & (F.lit(c not in keep) | F.col("_old").isNull()), F.col(f"_n.{c}")).otherwise(F.col(c))
    marked = table.withColumn("_old", F.lit(True)).join(latest, keys, "full")
    return marked.select(*keys, *[value(c).alias(c) for c in columns]).select(*table.columns)


def fallback_embedding(text: str, dim: int) -> np.ndarray:
    """A hash of the text unrolled by a linear congruence (fixed values), of length one, in single precision."""
    mask = (1 << 64) - 1
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & mask
    out = np.empty(dim, np.float32)
    for i in range(dim):
        h = (h * 1664525 + 1013904223) & mask
        out[i] = np.float32((h >> 16) & 0x7FFF) / np.float32(32767.0) * np.float32(2) - np.float32(1)
    norm = np.float32(0)
    for v in out:
        norm += v * v
    norm = np.float32(math.sqrt(float(norm)))
    return out / norm if norm else out


def embed(rows: DataFrame, dim: int = 384) -> DataFrame:
    """(id, embedding) of (id, content)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [fallback_embedding(t or "", dim).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

    return rows.select("id", "content").mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")


def quantise(embedding: Column) -> Column:
    """To whole numbers of -127 to 127, towards 0."""
    return F.transform(embedding, lambda v: (F.greatest(F.least(v, F.lit(1.0).cast("float")), F.lit(-1.0).cast("float")) * F.lit(127).cast("float")).cast("tinyint"))


def dequantise(values: Column) -> Column:
    """M22."""
    return F.transform(values, lambda v: v.cast("float") / F.lit(127.0).cast("float"))


def store(rows: DataFrame, as_of: str, dim: int = 384) -> DataFrame:
    """Rows (id, type, content, project, tags) as new entities: embedded, dated ``as_of``, with decay 1; one per id (Q15)."""
    once = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "id"])
    when = F.lit(as_of).cast("timestamp_ntz")
    return once.join(embed(once, dim), "id").select("*", when.alias("created_at"), when.alias("updated_at"), F.lit(0).cast("long").alias("access_count"), F.lit(1.0).alias("decay_score"))
