"""Language ID by mixture inference.

Training counts character trigrams of labelled texts in a fixed number of hash
buckets and yields, for each language, smoothed probabilities. A text is then a
mixture of the languages and of noise, which deals its trigrams evenly over the
buckets: expectation-maximisation estimates the share of each from the trigrams'
likelihoods. Languages are dropped one by one, the weakest first, as long as the
penalised likelihood (each language beyond the first costs ``penalty * ln(n) / 2``)
does not fall; noise stays. Languages that together account for less than half a
trigram are dropped at once: that loses less than one language costs.

The prediction is the language with the largest share, the score that share. What
the noise leaves over, the sum of the languages' shares, tells whether a text is
written in any of them: ``keep_identified`` rejects by that sum, so a clean text in
several languages stays and strings of letters go.

Training takes a bounded sample: about ``sample_per_language`` texts of each
language, chosen by a hash of id (all, if there are fewer); counting and
prediction are distributed. What reaches the driver and is broadcast is
``buckets`` numbers for each language; more than ``most_languages`` values are
refused, not cut.

Defined results: null, empty and letterless texts give ``und`` with score 0, as
does a model without languages. Equal shares go to the first language by name.
A null id counts as not held out. Repeated rows are predicted one by one. Texts of
any length are taken up whole, in slices that carry two characters over. Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import SLICE_CHARS, arrow_map, map_batches

UNKNOWN = "und"
BUCKETS = 1 << 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # fixed values: odd multipliers

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(text: str, buckets: int, slice_chars: int = SLICE_CHARS) -> np.ndarray:
    """A bucket for each three neighbouring characters of the lower-cased words, with a space between words and around them all."""
    found, tail, inside = [], np.array([32], np.uint64), False
    text = text.lower()

    def add(more: np.ndarray) -> None:
        nonlocal tail
        c = np.concatenate([tail, more])
        tail = c[-2:]
        if len(c) >= 3:
            with np.errstate(over="ignore"):
                h = c[:-2] * _ODD[0] + c[1:-1] * _ODD[1] + c[2:] * _ODD[2]
                h ^= h >> np.uint64(29)
                h *= _ODD[1]
            found.append((h >> np.uint64(40)).astype(np.int64) % buckets)

    for i in range(0, len(text), slice_chars):
        codes = np.frombuffer(text[i : i + slice_chars].encode("utf-32-le", "surrogatepass"), np.uint32)
        word = letters()[codes]
        before = np.concatenate([[inside], word[:-1]])
        add(np.where(word, codes, 32)[word | before].astype(np.uint64))
        inside = bool(word[-1])
    if inside:
        add(np.array([32], np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """``probabilities[l, g]`` of bucket g in language l; ``penalty`` as above."""

    languages: tuple[str, ...]
    probabilities: np.ndarray
    penalty: float = 10.0
    rounds: int = 12

    def shares(self, counts: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """EM from equal shares: the shares of p's rows and the log likelihood."""
        share = np.full(len(p), 1 / len(p))
        total = counts.sum()
        for _ in range(self.rounds if len(p) > 1 else 0):
            share = share * (p @ (counts / (share @ p))) / total
        return share, float(counts @ np.log(share @ p))

    def infer(self, text: str) -> dict[str | None, float]:
        """The selected languages and their shares, and the noise's under None; nothing for a letterless text."""
        buckets = self.probabilities.shape[1]
        grams = trigrams(text, buckets)
        if not len(grams) or not self.languages:
            return {}
        ids, counts = np.unique(grams, return_counts=True)
        counts = counts.astype(np.float64)
        p = np.vstack([self.probabilities[:, ids], np.full((1, len(ids)), 1 / buckets)])
        noise = len(self.languages)
        chosen = list(range(noise + 1))
        share, fit = self.shares(counts, p)
        cost = self.penalty * np.log(max(2.0, counts.sum())) / 2
        order = np.argsort(share[:-1], kind="stable")
        idle = order[np.cumsum(share[order]) * counts.sum() < min(0.5, cost)][: noise - 1]
        if len(idle):
            chosen = [k for k in chosen if k not in set(idle.tolist())]
            share, fit = self.shares(counts, p[chosen])
        while len(chosen) > 2:
            weakest = int(np.argmin(share[:-1]))
            fewer = chosen[:weakest] + chosen[weakest + 1 :]
            new, new_fit = self.shares(counts, p[fewer])
            if new_fit < fit - cost:
                break
            chosen, share, fit = fewer, new, new_fit
        return {self.languages[k] if k < noise else None: float(s) for k, s in zip(chosen, share, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float]:
        return best_of(self.infer(text) if text else {})


def best_of(shares: dict[str | None, float]) -> tuple[str, float]:
    """The language with the largest share, and that share."""
    known = sorted((-s, k) for k, s in shares.items() if k is not None)
    return (known[0][1], min(1.0, -known[0][0])) if known else (UNKNOWN, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 2000, buckets: int = BUCKETS, most_languages: int = 1000, smoothing: float = 0.1) -> Model:
    """The model of rows whose text and language are not null."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang_col}")
    languages = sorted(sizes)
    if not languages:
        return Model((), np.zeros((0, buckets)))
    number = {k: i for i, k in enumerate(languages)}
    one_of = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_per_language / sizes[k]))])
    uniform = F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.lit(0))), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(F.col("lang").isin(languages) & (uniform < one_of[F.col("lang")])).select("lang", "text")

    def count(batches):
        table = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table[number[lang]] += np.bincount(trigrams(text, buckets), minlength=buckets)
        who, gram = np.nonzero(table)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(table[who, gram])], names=["lang", "gram", "n"])

    sums = arrow_map(sample, count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(languages), buckets))
    table[sums["lang"].to_numpy(), sums["gram"].to_numpy()] = sums["n"].to_numpy()
    return Model(tuple(languages), (table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * buckets))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    schema = StructType([rows.schema[0]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return map_batches(rows, work, schema)


#: The least sum of the languages' shares of a text that counts as written in them.
MIN_SHARE = 0.3


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that are written in ``languages`` (None: those of the model); ``lang_col``, where null, is the prediction.

    A row stays if the shares of these languages add up to ``min_share`` or more, so
    a clean text in several of them stays; null, empty and letterless texts go. A
    model without languages can judge no text: all texts with a letter stay, as ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    text_at = docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        stays, langs = [], []
        for text in batch.column(text_at).to_pylist():
            shares = model.infer(text) if text else {}
            wanted = sum(s for k, s in shares.items() if k is not None and (languages is None or k in languages))
            stays.append(wanted >= min_share if model.languages and shares else not model.languages and bool(text) and any(map(str.isalpha, text)))
            langs.append(best_of(shares)[0])
        columns = list(batch.columns)
        if lang_at is not None:
            old = batch.column(lang_at)
            columns[lang_at] = pc.coalesce(old, pa.array(langs, old.type))
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, work, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on rows that are not held out and predicts all."""
    return identify(docs, train(docs.where(~held_out(id_col)), id_col, text_col, lang_col), id_col, text_col)
