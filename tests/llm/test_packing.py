import itertools
import random

import numpy as np
import pytest

from plumbline.llm import packing as pk


def padding(lengths, counts, chosen):
    return sum(n * (min(b for b in chosen if b >= v) - v) for v, n in zip(lengths, counts, strict=True))


def test_buckets_equal_brute_force():
    r = random.Random(1)
    for _ in range(150):
        lengths = sorted(r.sample(range(60), r.randint(1, 9)))
        counts = [r.randint(1, 20) for _ in lengths]
        k = r.randint(1, 5)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(k) for c in itertools.combinations(lengths[:-1], n))
        chosen = pk.best_buckets(lengths, counts, k)
        assert len(chosen) <= k and chosen[-1] == lengths[-1] and padding(lengths, counts, chosen) == best
    assert pk.best_buckets([], [], 3) == []


def test_batches(spark):
    r = random.Random(2)
    rows = [(i % 190, " ".join(["x"] * r.choice([0, 1, 5, 30, 31, 99, 100, 101, 350])), 1) for i in range(200)] + [(500, None, 1), (None, "a b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int").repartition(5)
    out = pk.pack(docs, max_length=100, buckets=4, batch_tokens=400)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x and "batch#" in x for x in plan.splitlines()) == 1  # only what is left of lanes moves again
    got = out.collect()
    dealt = {(b.bucket_length, b.batch, tuple((s.doc_id, s.start) for s in b.segments)) for b in got}
    assert dealt == {(b.bucket_length, b.batch, tuple((s.doc_id, s.start) for s in b.segments)) for b in pk.pack(docs.repartition(2), max_length=100, buckets=4, batch_tokens=400).collect()}
    packed = sorted(((s.doc_id is None, s.doc_id or 0, s.start, s.length) for b in got for s in b.segments))
    expected = []
    for i, t, _ in rows:
        n = len((t or "").split())
        expected += [(i is None, i or 0, k, min(100, n - k)) for k in range(0, max(1, n), 100)]
    assert packed == sorted(expected)
    by = {}
    for b in got:
        room = max(1, 400 // max(1, b.bucket_length))
        by.setdefault(b.bucket_length, []).append((b.batch, len(b.segments), room))
        assert b.n_segments == len(b.segments) <= room
        assert b.n_tokens == sum(s.length for s in b.segments) and b.n_padding == sum(b.bucket_length - s.length for s in b.segments)
        assert all(s.length <= b.bucket_length for s in b.segments)
    assert len(by) <= 4
    for batches in by.values():  # full but for the last
        batches.sort()
        assert [x[0] for x in batches] == list(range(len(batches)))
        assert all(n == room for _, n, room in batches[:-1])
    assert all(len(s.tokens) == s.length for b in got for s in b.segments)
    assert pk.pack(docs.limit(0)).collect() == []


def test_batches_hold_the_ids_of_all_texts(spark):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(4)
    rows = [(i % 50, " ".join(r.choice(["the", "cat", "Zoë", "x1."]) for _ in range(r.choice([0, 1, 20, 90, 400])))) for i in range(60)] + [(None, "a b"), (None, "a c"), (7, None), (8, "y" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tokens", "2 AS start").repartition(4)
    got = pk.pack(docs, max_length=64, buckets=5, batch_tokens=512, tokenizer=path).collect()
    found = sorted(((s.doc_id is None, s.doc_id or 0, s.start, np.frombuffer(s.tokens, "<u2").tolist()) for b in got for s in b.segments))
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want += [(i is None, i or 0, k, ids[k : k + 64]) for k in range(0, max(1, len(ids)), 64)]
    assert found == sorted(want)
    assert all(b.n_tokens == sum(len(s.tokens) // 2 for s in b.segments) for b in got)
