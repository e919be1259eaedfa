"""Token ids in files of directly addressable codes.

A file splits every id into bytes, the low one on level 0. A level holds its
bytes, a bitmap that tells which of them go on at the next level, and a rank
directory: the number of set bits before every 512th position. The k-th
continuing element of a level is element k of the next, so a single token, or
any range of them, is read by seeking, without decoding what stands before it.
A file also lists its documents: ids, and where each begins.

Documents are dealt out by ranges of id (ties: by text), so files follow one
another in ascending id order; nothing passes through one task. A task's files
have names that only its partition determines and appear by renaming, so that a
task that runs again leaves the same files.

Defined results: a null or empty text has only the end id; null document ids
come first; repeated rows are encoded each; ids are integers, or strings of such.
Texts of any length are encoded whole. An empty table makes no file. Other columns,
whatever their names, take no part.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import arrow_map, slices, texts_of
from plumbline.llm._shared import shared_dir, written

MAGIC = b"DACT0001"
BLOCK = 512
#: A file is closed once it has this many ids.
FILE_TOKENS = 4_000_000
#: Word pieces that a worker remembers; others are encoded whenever they come.
MEMORY = 200_000
LONGEST = 40

_HEADER = struct.Struct("<8sQQQ")


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: its bytes, its packed continuation bitmap and its rank directory."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(blocks, dtype=np.uint64)])
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), ranks))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def dump(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file."""
    levels = encode_levels(ids)
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    parts = [_HEADER.pack(MAGIC, len(doc_ids), len(ids), len(levels)), numbers.tobytes(), valid.tobytes(), starts.tobytes()]
    parts += [struct.pack("<Q", len(x[0])) for x in levels]
    for low, bits, ranks in levels:
        parts += [low.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(parts)


class TokenFile:
    """Random access to a file's tokens; reads only the bytes that a range needs."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, self.n_docs, self.n_tokens, n_levels = _HEADER.unpack(file.read_at(_HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEADER.size
        numbers = np.frombuffer(file.read_at(8 * self.n_docs, at), "<i8")
        at += 8 * self.n_docs
        valid = file.read_at(self.n_docs, at)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(numbers, valid, strict=True)]
        at += self.n_docs
        self.starts = np.frombuffer(file.read_at(8 * (self.n_docs + 1), at), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        sizes = struct.unpack(f"<{n_levels}Q", file.read_at(8 * n_levels, at))
        at += 8 * n_levels
        self.levels = []
        for n in sizes:
            bits, ranks = at + n, at + n + (n + 7) // 8
            self.levels.append((at, bits, ranks))
            at = ranks + 8 * ((n + BLOCK - 1) // BLOCK + 1)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        packed = np.frombuffer(self.file.read_at((b + 7) // 8 - a // 8, self.levels[level][1] + a // 8), np.uint8)
        return np.unpackbits(packed, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Continuing elements before position ``i``."""
        block = i // BLOCK
        before = struct.unpack("<Q", self.file.read_at(8, self.levels[level][2] + 8 * block))[0]
        return before + int(self._bits(level, block * BLOCK, i).sum()) if i % BLOCK else before

    def tokens(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b (exclusive)."""
        if a >= b:
            return np.zeros(0, np.uint32)
        found = np.frombuffer(self.file.read_at(b - a, self.levels[level][0] + a), np.uint8).astype(np.uint32)
        more = self._bits(level, a, b)
        if n := int(more.sum()):
            first = self.rank(level, a)
            found[more] += self.tokens(first, first + n, level + 1) << 8
        return found


#: Letters whose class no version of Unicode changes.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
#: Punctuation behind them is a piece of its own (an apostrophe might not be).
_MARKS = r"[!-&(-/:-@\[-`{-~]{0,8}"
_PLAIN = re.compile(f"({_LETTERS})({_MARKS})")
#: Plain words with single line ends between them.
_LINES = re.compile(rf"{_LETTERS}{_MARKS}(?:\n{_LETTERS}{_MARKS})+")
#: A space that is followed by white space belongs to a longer piece.
_RUN = re.compile(r" (?=\s|$)")


def _visible() -> dict[int, str]:
    """The byte-level alphabet by its published rule: printable bytes stand for themselves, others for 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Parts(dict):
    """Ids of parts that follow ``lead`` (a space or nothing), found when first asked for."""

    def __init__(self, encoder: Encoder, lead: str, after: _Parts | None = None):
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.after = self if after is None else after  # an empty dict is false, too
        self.visible_lead = lead.translate(encoder.visible)

    def __missing__(self, part: str) -> bytes:
        e = self.encoder
        if m := _PLAIN.fullmatch(part):
            seen = m[1] if part.isascii() else m[1].encode().decode("latin-1").translate(e.visible)
            ids = array(e.code, [t.id for t in e.tokenizer.model.tokenize(self.visible_lead + seen)]).tobytes()
            if m[2]:
                ids += e.endings[m[2]]
        elif _LINES.fullmatch(part):  # a single line end is a piece of its own, and so is what follows
            head, *rest = part.split("\n")
            return e.endings["\n"].join([self[head], *map(self.after.__getitem__, rest)])
        else:
            ids = e.whole([self.lead + part])[0]
        if len(self) < MEMORY and len(part) <= LONGEST:
            self[part] = ids
        return ids


class _Endings(dict):
    """Ids of pieces that stand alone: punctuation behind a word (short, so there are few that occur), a line end."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.whole([piece])[0]
        if len(self) < 10_000:
            self[piece] = ids
        return ids


class Encoder:
    """The ids of texts under a tokenizer's file, remembering pieces if the file says that text may be cut before spaces.

    That is so for byte-level models without normaliser: there a space before a
    character that is not white space always begins a new piece, so text is cut there
    and each part encoded once. Plain words go straight to the tokenizer's model; any
    other part, and any text with a space before white space, takes the tokenizer's
    whole way, as does every text under another kind of file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        before = file.get("pre_tokenizer") or {}
        model = file.get("model") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.in_parts = plain and not file.get("normalizer") and model.get("type") == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.visible = _visible()
        self.endings = _Endings(self)
        self.first = _Parts(self, "")
        self.later = _Parts(self, " ", self.first)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as native integers of ``self.code``."""
        return [self._by_parts(t) if self.in_parts and not _RUN.search(t) else self.whole([t])[0] for t in texts]

    def _by_parts(self, text: str) -> bytes:
        head, *parts = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; it stays for the tasks to come."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _put(filesystem: pafs.FileSystem, folder: str, name: str, data: bytes) -> None:
    tag = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    with filesystem.open_output_stream(f"{folder}/.{name}.{tag}") as out:
        out.write(data)
    filesystem.move(f"{folder}/.{name}.{tag}", f"{folder}/{name}")


def write_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes ``docs`` into files under the URI ``root``; returns the manifest (part, seq, name, n_docs, n_tokens), a table there too."""
    spark = docs.sparkSession
    filesystem, folder = pafs.FileSystem.from_uri(root)
    filesystem.create_dir(folder, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = pafs.FileSystem.from_uri(root)
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        end = array(enc.code, [end_id]).tobytes()
        numbers: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.dtype(enc.code))
            counts = [len(x) // ids.itemsize for x in held]
            name = f"part-{part:06d}-{seq:06d}.dac"
            _put(out, at, name, dump(numbers, counts, ids))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n_docs": len(numbers), "n_tokens": len(ids)}], manifest)

        for batch in batches:
            texts, ids = texts_of(batch, 1), batch.column(0).to_pylist()
            for i, j in slices(texts):
                for number, found in zip(ids[i:j], enc.encode(texts[i:j]), strict=True):
                    numbers.append(number)
                    held.append(found + end)
                    n += len(held[-1]) // len(end)
                    if n >= file_tokens:
                        yield flush()
                        numbers, held, n, seq = [], [], 0, seq + 1
        if numbers:
            yield flush()

    manifest = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    files = arrow_map(pair.repartitionByRange(*order).sortWithinPartitions(*order, "text"), work, "part long, seq long, name string, n_docs long, n_tokens long")
    return written(files, root, "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids in all files before. One row per partition goes to the driver."""
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, sums = 0, []
    for part, n in totals:
        sums.append((part, before))
        before += n
    base = spark.createDataFrame(sums, "part long, base long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(base, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("base")


def read_files(manifest: DataFrame, root: str, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, read from the files."""
    spark = manifest.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, at = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with source.open_input_file(f"{at}/{row['name']}") as f:
                    file = TokenFile(f)
                    bounds, crcs, a = file.starts, [], 0
                    while a < file.n_docs:  # as many documents as have about ``most`` ids
                        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
                        ids = file.tokens(int(bounds[a]), int(bounds[b])).astype("<u4")
                        crcs += [zlib.crc32(ids[bounds[k] - bounds[a] : bounds[k + 1] - bounds[a]]) for k in range(a, b)]
                        a = b
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), pa.array(crcs, pa.int64())], names=schema.names)

    schema = StructType().add(id_col, "long").add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return starts(manifest).select("name", "start").repartition(n).mapInArrow(work, schema)


def token_files(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` under ``root`` (default: a new shared folder) and reads them back."""
    root = root or shared_dir(docs.sparkSession)
    return read_files(write_files(docs, root, tokenizer, end_id, id_col, text_col), root, id_col)
