"""Packing into optimal length buckets.

Tokens are the ids that a tokenizer gives or, without one, the words. Texts longer
than ``max_length`` tokens become segments of at most that length. A dynamic programme
over the global histogram of segment lengths (at most ``max_length`` + 1 numbers, all
that reaches the driver) chooses the bucket lengths that need the least padding in
all. Within a bucket, segments are dealt into batches of as many as ``batch_tokens``
holds at the bucket's length. A batch holds its segments' tokens, so nothing need be
looked up elsewhere.

Segments are dealt to lanes by a hash of id and tokens, so no bucket passes through one
task. A lane's segments of a bucket are numbered and fill whole batches where they are;
only what is left of each lane, less than a batch, moves once more to fill the bucket's
last batches, of which one may stay short.

Defined results: a null, empty or wordless text is one segment of length 0; every
row of the input is packed, repeated rows too; a null id stays null. Ties are
ordered by id, start and tokens. Texts of any length are cut, never left out. An empty
table gives no batches. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import arrow_map, slices, texts_of
from plumbline.llm._shared import shared_dir, written
from plumbline.llm.token_files import encoder

WORD = r"[^\x20\x09-\x0D]+"


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The ascending bucket lengths, at most ``buckets``, with the least total padding.

    ``lengths`` ascend; the last of them is always a bucket. Of equally good choices
    the one with fewer, then shorter buckets is taken.
    """
    if not lengths:
        return []
    v = np.array(lengths, np.int64)
    n = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(v * np.array(counts, np.int64))])
    size = len(v)
    best = v * n[1:] - tokens[1:]  # the padding of lengths 0..j in one bucket
    back = [np.zeros(size, np.int64)]
    totals = [int(best[-1])]
    for _ in range(1, min(buckets, size)):
        new, cut = np.empty(size, np.int64), np.zeros(size, np.int64)
        new[0] = best[0]
        for j in range(1, size):
            cost = best[:j] + v[j] * (n[j + 1] - n[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        back.append(cut)
        totals.append(int(best[-1]))
    used = int(np.argmin(totals))
    found, j = [], size - 1
    for k in range(used, -1, -1):
        found.append(int(v[j]))
        j = int(back[k][j])
    return found[::-1]


def segments(docs: DataFrame, max_length: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, tokens) of every row's segments; positions count tokens.

    tokens: words, or with a ``tokenizer`` ids as little-endian unsigned integers of
    two bytes (four, if the vocabulary has more than 65,536).
    """
    if tokenizer is None:
        words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
        rows = docs.select(F.col(id_col).alias("id"), words.alias("words"))
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(max_length))
        rows = rows.select("id", F.explode(starts).alias("start"), "words").select("id", "start", F.slice("words", F.col("start") + 1, F.lit(max_length)).alias("tokens"))
        return rows.select("id", F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("length"), "tokens")

    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([pair.schema[0]]).add("start", "long").add("length", "long").add("tokens", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        size = np.dtype(enc.code).itemsize
        for batch in batches:
            texts = texts_of(batch, 1)
            for i, j in slices(texts):
                cut = [(k, at, x[at * size : (at + max_length) * size]) for k, x in enumerate(enc.encode(texts[i:j])) for at in range(0, max(1, len(x) // size), max_length)]
                which, start, tokens = zip(*cut, strict=True)
                ids = batch.column(0).slice(i, j - i).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array([len(x) // size for x in tokens], pa.int64()), pa.array(tokens, pa.binary())], names=schema.names)

    return arrow_map(pair, work, schema)


def pack(docs: DataFrame, max_length: int = 2048, buckets: int = 16, batch_tokens: int = 65_536, id_col: str = "doc_id", text_col: str = "text", lanes: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """(bucket_length, batch, n_segments, n_tokens, n_padding, segments) of every batch.

    segments: array of (id_col, start, length, tokens) in order, tokens as in ``segments()``.
    """
    spark = docs.sparkSession
    lanes = lanes or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = segments(docs, max_length, id_col, text_col, tokenizer).withColumn("lane", F.pmod(F.xxhash64("id", "start", "tokens"), F.lit(lanes)))
    rows = written(rows, shared_dir(spark), "segments")
    histogram = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    chosen = best_buckets([x for x, _ in histogram], [n for _, n in histogram], buckets) or [1]
    bucket = F.coalesce(*[F.when(F.col("length") <= b, F.lit(b).cast("long")) for b in chosen])
    rows = rows.withColumn("bucket", bucket)
    holds = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket"), F.lit(1).cast("long"))))
    deal = rows.groupBy("bucket", "lane").agg(F.count("*").alias("n")).select("bucket", "lane", "n", holds.alias("holds"), F.floor(F.col("n") / holds).alias("whole"))
    bucket_ = Window.partitionBy("bucket")
    before = bucket_.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("n") - F.col("whole") * F.col("holds")
    deal = deal.select("bucket", "lane", "holds", "whole", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum(rest).over(before), F.lit(0)).alias("left"), F.sum("whole").over(bucket_).alias("all"))
    number = F.row_number().over(Window.partitionBy("bucket", "lane").orderBy("id", "start", "tokens")) - 1
    placed = rows.repartitionByRange(lanes, "lane").withColumn("number", number).join(F.broadcast(deal), ["bucket", "lane"])  # at most buckets * lanes rows
    is_whole = F.col("number") < F.col("whole") * F.col("holds")
    one = F.struct(F.col("id").alias(id_col), "start", "length", "tokens")
    found = [
        F.count("*").alias("n_segments"),
        F.sum("length").alias("n_tokens"),
        F.sum(F.col("bucket") - F.col("length")).alias("n_padding"),
        F.sort_array(F.collect_list(one)).alias("segments"),
    ]
    whole = placed.where(is_whole).withColumn("batch", F.col("first") + F.floor(F.col("number") / F.col("holds")))
    moved = F.col("left") + F.col("number") - F.col("whole") * F.col("holds")
    short = placed.where(~is_whole).withColumn("batch", F.col("all") + F.floor(moved / F.col("holds")))
    columns = [F.col("bucket").alias("bucket_length"), "batch", "n_segments", "n_tokens", "n_padding", "segments"]
    return whole.groupBy("bucket", "lane", "batch").agg(*found).select(*columns).union(short.groupBy("bucket", "batch").agg(*found).select(*columns))
