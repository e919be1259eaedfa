"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the high bits choose a bin, the rest compete for
the bin's minimum. Empty bins are filled by optimal densification: bin i takes
the minimum of the first non-empty bin in a pseudo-random order that depends on
i alone. Of each minimum the low ``bits`` are kept and packed. Two fingerprints'
likeness is the share of equal bins, corrected for the 2**-bits of bins that
agree by chance: an estimate of the Jaccard similarity of the shingle sets.

Neighbours in id order: documents are dealt into ranges of id whose bounds are
approximate quantiles; the first document of a range is also sent to the range
before, so that every task sees its last document's successor. No order is made
in a single task.

Defined results: a null text counts as empty; a text without words has the empty
fingerprint, which is like (1.0) only to another empty one. Null ids come first;
equal ids are ordered by a hash of their texts. A single document follows itself.
Ids are integers, or strings of such; others fail. Texts of any length are taken
whole. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import arrow_map, slices, texts_of
from plumbline.llm.shingles import mixed, shingle_hashes

BINS = 512
BITS = 4
WIDTH = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def minima(texts: list[str], width: int = WIDTH, bins: int = BINS) -> np.ndarray:
    """The minimum of each text's bins, ``_EMPTY`` where no shingle fell."""
    hashes, offsets = shingle_hashes(texts, width)
    table = np.full((len(texts), bins), _EMPTY)
    shift = np.uint64(64 - (bins - 1).bit_length())
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    np.minimum.at(table.reshape(-1), owner * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    return table


def densified(table: np.ndarray) -> np.ndarray:
    """The table without empty bins, except in rows that have nothing else."""
    out = table.copy()
    row, bin_ = np.nonzero((table == _EMPTY) & (table != _EMPTY).any(axis=1)[:, None])
    attempt = 1
    while len(row):
        with np.errstate(over="ignore"):
            other = (mixed(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(table.shape[1])).astype(np.int64)
        value = table[row, other]
        found = value != _EMPTY
        out[row[found], bin_[found]] = value[found]
        row, bin_ = row[~found], bin_[~found]
        attempt += 1
    return out


def fingerprints(texts: list[str], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Each text's packed fingerprint; empty for a text without words."""
    table = densified(minima(texts, width, bins))
    low = (table & np.uint64((1 << bits) - 1)).astype(np.uint16)
    bitmap = (low[:, :, None] >> np.arange(bits, dtype=np.uint16)) & 1
    packed = np.packbits(bitmap.reshape(len(texts), -1).astype(np.uint8), axis=1, bitorder="little")
    empty = (table == _EMPTY).all(axis=1)
    return [b"" if e else p.tobytes() for p, e in zip(packed, empty, strict=True)]


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """The estimated similarity, 0 to 1."""
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8), bitorder="little").reshape(-1, bits).any(axis=1)
    chance = 2.0**-bits
    return float(max(0.0, (1.0 - differ.mean() - chance) / (1.0 - chance)))


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter is replaced by as many first characters of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """(range, guest, id, h, text) sorted within partitions; guest 1: the first document of the range that follows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] if ranges > 1 else None
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"))

    width = range_of(F.coalesce("id", F.lit(-(1 << 63))))  # only the ids go to Python; a null id stands before all
    rows = rows.select(width.alias("range"), "id", F.xxhash64("text").alias("h"), "text")
    firsts = sorted(rows.groupBy("range").agg(F.min(F.struct("id", "h")).alias("f")).collect(), key=lambda r: r["range"])
    small = spark.createDataFrame([(r["range"], r["f"]["id"], r["f"]["h"], firsts[k - 1]["range"]) for k, r in enumerate(firsts)], "range int, first_id long, first_h long, before int")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("range"), F.lit(1).alias("guest"))
    sent = rows.join(F.broadcast(small), "range").select(F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("to"), "id", "h", "text")
    order = ["range", "guest", F.asc_nulls_first("id"), "h", "text"]
    return sent.select("to.range", "to.guest", "id", "h", "text").repartition("range").sortWithinPartitions(*order)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``."""
    spark = docs.sparkSession
    ranges = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = StructType().add(id_col, "long").add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def emit(chain: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Rows for all of a chain but the last, which only follows."""
        ids, texts = [x[0] for x in chain[:-1]], [x[1] for x in chain]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        prints = fingerprints(texts + changed, width, bins, bits)
        plain, new = prints[: len(texts)], prints[len(texts) :]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([p.hex() for p in plain[:-1]], pa.string()),
            pa.array([p.hex() for p in new], pa.string()),
            pa.array([likeness(a, b, bits) for a, b in zip(plain, new, strict=False)], pa.float64()),
            pa.array([likeness(a, b, bits) for a, b in zip(plain, plain[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[tuple[int | None, str]] = []
        at, closed = None, False
        for batch in batches:
            ranges_, guests, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, 4)
            for i, j in slices(texts):
                for k in range(i, j):
                    if ranges_[k] != at:
                        chain, at, closed = [], ranges_[k], False
                    if closed:
                        continue  # repeated rows of the guest
                    chain.append((ids[k], texts[k]))
                    if guests[k]:
                        yield emit(chain)
                        chain, closed = [], True
                if len(chain) > 1:
                    yield emit(chain)
                    chain = chain[-1:]

    return arrow_map(with_next(docs, id_col, text_col, ranges), work, schema)
