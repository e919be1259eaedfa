"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds are patterns (``assign``, ``access``, ``hex``), matched leftmost and
non-overlapping each; a match that is too short is dropped, and the search goes
on behind it. The method adds ``entropy`` spans: within each candidate (a long
run of key characters that holds a digit and a letter) a window of fixed width
slides over every run of one character class, its entropy kept by adding the
character that enters and taking away the one that leaves. Windows at or above
the class's threshold are suspect, unless most of one is made of words, as in names
and paths. Neighbouring ones are joined to spans.

The allow-list is matched against each span and ``MARGIN`` characters on both sides.
A span that is short (less than ``LONG`` characters beside what is allowed) is
suppressed by a match; a longer one loses only the windows that the match touches by
half or more, or that hold it. Spans that meet a base span are left out.

Positions are code points, ends exclusive. A null or empty text has no spans.
Equal spans of different kinds both count. Repeated rows are scanned one by one.
Texts of any length are scanned whole; other columns, whatever their names, stay out.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import map_batches, texts_of

KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches as HEX of 32 characters or more: a run of hex digits is taken whole.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``pattern``; a window of ``width`` is suspect from ``bits`` of entropy on if it holds all of ``needs``.

    Not if more than the share ``words`` of its characters belongs to words (see ``WORDLIKE``).
    """

    pattern: str
    width: int
    bits: float
    needs: tuple[str, ...]
    words: float = 1.0


CLASSES = (
    CharClass("[0-9a-fA-F]+", 20, 3.0, ("[0-9]", "[a-fA-F]")),
    CharClass("[A-Z0-9]+", 20, 3.5, ("[0-9]", "[A-Z]")),
    CharClass("[A-Za-z0-9+/_-]+", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]"), 0.4),
)

#: Three small letters or more, with a capital before them: rare in random strings, most of a name or path.
WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}")
LONG, MARGIN = 36, 16

#: Suppressed: strings marked as examples, identifiers in UUID form, repeated characters, runs of the alphabet.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0000|1234567|abcdef",
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])",
    r"(.)\1{5}",
)


def window_entropies(run: str, width: int) -> list[float]:
    """Entropy in bits of every window, each from the one before in constant time."""
    counts: dict[str, int] = {}
    weight = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    total, found = 0.0, []
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        total += weight[c + 1] - weight[c]
        counts[new] = c + 1
        if i >= width - 1:
            found.append(math.log2(width) - total / width)
            old = run[i - width + 1]
            c = counts[old]
            total += weight[c - 1] - weight[c]
            counts[old] = c - 1
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


class Scanner:
    """The spans of a text. ``classes`` and ``allowed`` are the method's parameters."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, min_assign: int = 8, min_access: int = 16):
        self.min_assign, self.min_access = min_assign, min_access
        self.classes = [(re.compile(c.pattern), c.width, c.bits, [re.compile(x) for x in c.needs], c.words) for c in classes]
        self.candidate = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % min(c.width for c in classes))
        self.digit, self.letter = re.compile("[0-9]"), re.compile("[A-Za-z]")
        self.allowed = [re.compile(x) for x in allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of the patterns' matches, sorted."""
        found = []
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= self.min_assign]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= self.min_access]
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(found)

    def windows(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """The suspect windows of a candidate, sorted, whatever is allowed."""
        found = []
        for pattern, width, bits, needs, words in self.classes:
            for run in pattern.finditer(text, start, end):
                if run.end() - run.start() < width or not all(p.search(run[0]) for p in needs):
                    continue
                within = [0] * (len(run[0]) + 1)  # characters of words before each place
                if words < 1:
                    for w in WORDLIKE.finditer(run[0]):
                        within[w.start() + 1 : w.end() + 1] = [1] * len(w[0])
                    within = list(accumulate(within))
                for i, h in enumerate(window_entropies(run[0], width)):
                    at = run.start() + i
                    if h >= bits and within[i + width] - within[i] <= words * width and all(p.search(text, at, at + width) for p in needs):
                        found.append((at, at + width))
        return sorted(found)

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The method's spans that meet no base span, joined across character classes, without what is allowed."""
        out: list[tuple[int, int]] = []
        for candidate in self.candidate.finditer(text):
            if not self.digit.search(candidate[0]) or not self.letter.search(candidate[0]):
                continue
            windows = self.windows(text, *candidate.span())
            for start, end in joined(windows):
                low, high = max(candidate.start(), start - MARGIN), min(candidate.end(), end + MARGIN)
                allowed = sorted(m.span() for p in self.allowed for m in p.finditer(text, low, high))
                if not allowed:
                    out.append((start, end))
                elif end - start - sum(max(0, min(y, end) - max(x, start)) for x, y in joined(allowed)) >= LONG:
                    left = [(x, y) for x, y in windows if start <= x and y <= end and not any(2 * (min(y, n) - max(x, m)) >= min(y - x, 2 * (n - m)) for m, n in allowed)]
                    out += joined(left)
        return [(start, 3, end) for start, end in out if not any(s < end and start < e for s, _, e in base)]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans, both sorted by start, then kind."""
        base = self.base(text)
        return base, sorted(base + self.entropy(text, base))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by ``[kind]``."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``."""
    scanner = scanner or Scanner()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scanner.spans(t) for t in texts_of(batch, 1)]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
        digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([written(x) for _, x in found], pa.string())], names=schema.names)

    pair = docs.select(F.col(id_col), F.col(text_col))
    schema = StructType([pair.schema[0]]).add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string")
    return map_batches(pair, work, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", scanner: Scanner | None = None) -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced, and ``length_col``, if there is one, counted anew.

    All rows and columns stay; a text without secrets and a null text are left as they are.
    """
    scanner = scanner or Scanner()
    schema = docs.schema
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = [t if t is None else redacted(t, scanner.spans(t)[1]) for t in batch.column(text_at).to_pylist()]
        columns[text_at] = pa.array(texts, pa.string())
        if length_at is not None:
            old = batch.column(length_at)
            columns[length_at] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], pa.int64()).cast(old.type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(docs, work, schema)
