"""Data-loss prevention: secrets, personal data and entropy in texts.

Documents: (doc_id, text, path). Positions within a line are byte offsets, lines
count from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lines, re2_to_java, redact, simple_glob

# Fixed values: (name, pattern). Beside them, in ``NEEDS``, what a matching line has in any case; it is looked for first, as it is cheaper.
SECRETS = (
    ("api_key", r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*['"]?([a-zA-Z0-9_\-]{16,})"""),
    ("secret", r"""(?i)(?:secret|token)\s*[:=]\s*['"]?([a-zA-Z0-9_\-\.]{16,})"""),
    ("password", r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*['"]?([^\s'"]{8,})"""),
    ("bearer", r"""(?i)Bearer\s+[a-zA-Z0-9_\-\.]{20,}"""),
    ("aws_secret", r"""(?i)(?:aws_secret_access_key|aws_secret)\s*[:=]\s*['"]?([a-zA-Z0-9/+]{40})"""),
    ("private_key", r"""-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----"""),
    ("client", r"""(?i)(?:client_secret|client_id)\s*[:=]\s*['"]?([a-zA-Z0-9_\-]{20,})"""),
)
PERSONAL = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ssn", r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b"),
)
NEEDS = {"api_key": "[:=]", "secret": "[:=]", "password": "[:=]", "aws_secret": "[:=]", "private_key": "PRIVATE", "client": "[:=]", "email": "@", "phone": "[0-9]{3}", "ssn": "[0-9]{3}", "credit_card": "[0-9]{12}"}
WINDOW = 20
#: Twenty characters have at most 4.32 bits (Q18).
THRESHOLD = 4.0


def pattern_hits(docs: DataFrame, patterns: tuple[tuple[str, str], ...]) -> DataFrame:
    """(doc_id, line, kind, position, snippet): the first match of each pattern on each line, redacted."""
    found = []
    for name, pattern in patterns:
        java = re2_to_java(pattern)
        match = F.regexp_extract("text", java, 0)
        at = F.octet_length(F.substring("text", F.lit(1), F.regexp_instr("text", F.lit(java)) - 1))
        has = F.col("text").rlike(NEEDS.get(name, "")) & F.col("text").rlike(java)
        found.append(F.when(has, F.struct(F.lit(name).alias("kind"), at.cast("long").alias("position"), redact(match).alias("snippet"))))
    rows = lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "line", F.explode(F.array_compact(F.array(*found))).alias("h")).select("doc_id", "line", "h.*")


def secrets(docs: DataFrame) -> DataFrame:
    """T14."""
    return pattern_hits(docs, SECRETS)


def personal_data(docs: DataFrame) -> DataFrame:
    """T15."""
    return pattern_hits(docs, PERSONAL)


def entropy_hits(docs: DataFrame, threshold: float = THRESHOLD, width: int = WINDOW) -> DataFrame:
    """(doc_id, position, entropy, snippet) of windows above ``threshold``, from left to right without overlap.

    A window of d distinct characters has at most log2(d) bits, so only windows of
    more than 2**threshold can pass. How many are distinct is counted for all windows
    of a text at once: a character is new to a window if it last stood before it.
    """
    import math

    import numpy as np

    least = 2.0**threshold

    def scan(text: str) -> Iterator[tuple[int, float, str]]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes) - width + 1
        if n <= 0:
            return
        order = np.argsort(codes, kind="stable")
        again = codes[order[1:]] == codes[order[:-1]]
        last = np.full(len(codes), -1)
        last[order[1:][again]] = order[:-1][again]
        begins = np.arange(n)
        distinct = np.zeros(n, np.int32)
        for k in range(width):
            distinct += last[k : k + n] < begins
        free = 0
        for at in np.flatnonzero(distinct > least * (1 - 1e-9)).tolist():
            if at >= free:
                raw = text[at : at + width]
                bits = math.log2(width) - math.fsum(c * math.log2(c) for c in map(raw.count, set(raw))) / width
                if bits > threshold:
                    free = at + width
                    yield at, bits, raw[:3] + "*" * (len(raw.encode("utf-8", "surrogatepass")) - 6) + raw[-3:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *hit) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for hit in scan(text)]
            if rows:
                k, at, bits, cut = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.column(0).type), pa.array(at, pa.int64()), pa.array(bits, pa.float64()), pa.array(cut, pa.string())], names=["doc_id", "position", "entropy", "snippet"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, position long, entropy double, snippet string")


def is_exempt(path: Column, patterns: tuple[str, ...]) -> Column:
    """The path contains a pattern or fits it as a glob."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p) | simple_glob(path, p)
    return F.coalesce(out, F.lit(False))


def check(docs: DataFrame, exempt: tuple[str, ...] = (), threshold: float = THRESHOLD, block_bits: float = 5.5) -> DataFrame:
    """(doc_id, n_secrets, n_personal, n_entropy, exempt, blocked, warned). Entropy alone warns, and blocks above ``block_bits``."""
    free = docs.where(~is_exempt(F.col("path"), exempt))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    bits = entropy_hits(free, threshold).groupBy("doc_id").agg(F.count("*").alias("n_entropy"), F.max("entropy").alias("_bits"))
    out = docs.select("doc_id", is_exempt(F.col("path"), exempt).alias("exempt")).join(count(secrets(free), "n_secrets"), "doc_id", "left").join(count(personal_data(free), "n_personal"), "doc_id", "left").join(bits, "doc_id", "left")
    out = out.na.fill(0, ["n_secrets", "n_personal", "n_entropy"]).na.fill(0.0, ["_bits"])
    blocked = (F.col("n_secrets") > 0) | (F.col("n_personal") > 0) | ((F.col("n_secrets") == 0) & (F.col("_bits") > block_bits))
    return out.select("doc_id", "n_secrets", "n_personal", "n_entropy", "exempt", blocked.alias("blocked"), (~blocked & (F.col("n_entropy") > 0)).alias("warned"))
