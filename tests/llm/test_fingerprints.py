import hashlib
import random

import numpy as np

from plumbline.llm import fingerprints as fp
from plumbline.llm.shingles import shingle_sets


def words(text):
    return text.encode().lower().split()


def jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))} for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def sample(r, n):
    return " ".join(f"w{r.randint(0, 3000)}" for _ in range(n))


def test_shingle_sets_have_the_sizes_of_sets_of_tuples():
    r = random.Random(5)
    texts = ["", "  ", "A b", "a B", "a b c d", "a a a a a a a a", "é É x\x0by z"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(200)]
    for width in (1, 4, 5):
        sets = shingle_sets(texts, width)
        true = [{tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))} for w in map(words, texts)]
        assert [len(s) for s in sets] == [len(t) for t in true]
        for _ in range(500):
            i, j = r.randrange(len(texts)), r.randrange(len(texts))
            assert len(np.intersect1d(sets[i], sets[j])) == len(true[i] & true[j])


def test_likeness_estimates_similarity():
    r = random.Random(4)
    errors = []
    for _ in range(60):
        a = sample(r, 400)
        b = fp.edited(a, sample(r, 400)) if r.random() < 0.5 else " ".join(w if r.random() > 0.03 else "zz" for w in a.split())
        x, y = fp.fingerprints([a, b])
        errors.append(fp.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.1
    short = fp.fingerprints(["one two", "one two", "one three", ""])
    assert fp.likeness(short[0], short[1]) == 1.0 and fp.likeness(short[0], short[2]) < 0.1
    assert short[3] == b"" and fp.likeness(b"", b"") == 1.0 and fp.likeness(short[0], b"") == 0.0


def test_densification_takes_minima_of_the_same_text_only():
    table = fp.minima(["a b c d e f", "", "x"])
    full = fp.densified(table)
    for row, out in zip(table, full, strict=True):
        held = set(row[row != fp._EMPTY])
        assert set(out) == (held or {fp._EMPTY})


def brute(rows):
    rows = sorted(((i is not None, i or 0, i, t or "") for i, t in rows), key=lambda x: x[:2])
    out = []
    for k, (_, _, i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][3]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = fp.fingerprints([t, e, nxt])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_neighbours_in_id_order(spark):
    r = random.Random(6)
    rows = [(k * 7 + r.randint(0, 6), r.choice([None, "", "é" * 9, sample(r, r.randint(1, 80))])) for k in range(90)] + [(None, "first of all here")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as range").repartition(5)
    assert sorted((tuple(x) for x in fp.fingerprint(docs).collect()), key=str) == brute(rows)


def test_ties_single_and_none(spark):
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    assert [tuple(x) for x in fp.fingerprint(one).collect()] == brute([(3, "a b c d e f g h")])
    same = spark.createDataFrame([(3, "a b c d")] * 4 + [(4, "x y")], "doc_id long, text string")
    got = fp.fingerprint(same).collect()
    assert sorted(x.doc_id for x in got) == [3, 3, 3, 3, 4]
    assert fp.fingerprint(one.limit(0)).collect() == []


def test_very_long_texts(spark):
    rows = [(1, "a b c d e " * 100_000), (2, "x" * 400_000), (3, None)]
    assert sorted((tuple(x) for x in fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)
