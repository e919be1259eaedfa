import hashlib
import math
from collections import Counter, defaultdict

import pytest

from plumbline.llm import mixing as mx


def words(n):
    return " ".join(["w"] * n)


def documents(spark):
    rows = [(i, words(20 + i % 7), "big", 1) for i in range(400)] + [(1000 + i, words(30), "mid", 1) for i in range(60)] + [(2000 + i, words(11), None, 1) for i in range(9)]
    rows += [(3000, None, "none", 1), (3001, "", "none", 1), (None, words(5), "big", 1), (7, words(3), "mid", 1), (7, words(3), "mid", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(4)


def place(pass_, id_):
    return int(hashlib.md5(f"0|{pass_}|{'null' if id_ is None else id_}".encode()).hexdigest()[:12], 16)


def test_a_repetition_limit(spark):
    docs = documents(spark)
    rows = mx.mixture(docs, max_repeats=2.5, block_tokens=500).collect()
    used = Counter((r.source, r.doc_id, r.copy) for r in rows)
    t = defaultdict(int)
    for r in docs.collect():
        t[r.source] += len((r.text or "").split())
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens
    assert {(r.source, r.doc_id) for r in rows} == {(r.source, r.doc_id) for r in docs.collect()}  # nothing is left out
    assert abs(tokens["big"] / t["big"] - 1) < 0.01
    assert 2.4 < tokens[None] / t[None] <= 2.5001
    a = 1 - math.log(2.5) / math.log(t["big"] / t[None])
    repeats = (t["big"] / t["mid"]) ** (1 - a)
    whole, rest = int(repeats), (repeats - int(repeats)) * t["mid"]
    order = sorted((place(whole, r.doc_id) >> 24, len(r.text.split())) for r in docs.collect() if r.source == "mid")
    cut = next(p for p, _ in order if sum(n for q, n in order if q <= p) > rest)
    assert tokens["mid"] == whole * t["mid"] + sum(n for q, n in order if q < cut)
    assert used["none", 3000, 0] == 1 and sum(n for (s, _, _), n in used.items() if s == "none") == 2
    assert all(0 < r.position < 1 for r in rows)


@pytest.mark.parametrize(("target", "sign"), [(0.9, 0), (0.0, 1), (50.0, -1)])
def test_a_target_entropy(spark, target, sign, tmp_path):
    root = f"file://{tmp_path}"
    tokens = mx.token_table(documents(spark), root, "doc_id", "text", "source")
    w = [r.weight for r in mx.plan(tokens, root, target_entropy=target, max_repeats=None).collect() if r.t]
    entropy = -sum(x * math.log(x) for x in w)
    t = [r.t for r in mx.plan(tokens, f"{root}/b", target_entropy=target, max_repeats=None).collect() if r.t]
    if sign == 0:
        assert abs(entropy - target) < 1e-4
    elif sign > 0:  # already above: the natural weights
        assert all(abs(x - y / sum(t)) < 1e-6 for x, y in zip(sorted(w), sorted(t), strict=True))
    else:  # out of reach: equal weights
        assert all(abs(x - 1 / len(w)) < 1e-6 for x in w)


def test_a_budget(spark):
    rows = mx.mixture(documents(spark), max_repeats=1.0, budget=3000).collect()
    assert 2850 <= sum(r.n_tokens for r in rows) <= 3000


def test_blocks_interleave(spark):
    rows = mx.mixture(documents(spark), max_repeats=2.0, block_tokens=300).collect()
    big = sorted(r.position for r in rows if r.source == "big")
    assert abs(sum(p < 0.5 for p in big) / len(big) - 0.5) < 0.1


def test_documents_keep_their_columns(spark):
    docs = documents(spark)
    out = mx.mixed_documents(docs, max_repeats=2.0)
    assert out.columns == docs.columns and out.count() == mx.mixture(docs, max_repeats=2.0).count()
    assert {"Python", "Pandas"}.isdisjoint(out._jdf.queryExecution().toString())


def test_columns_of_any_name(spark):
    docs = documents(spark).selectExpr("*", "1 AS _copy", "2 AS _place", "3 AS _mix", "4 AS _plan", "5 AS s", "6 AS place", "7 AS n_tokens", "8 AS id", "9 AS row")
    out = mx.mixed_documents(docs, max_repeats=2.0)
    assert out.columns == docs.columns and out.count() == mx.mixture(docs, max_repeats=2.0).count() and {(r._copy, r.row, r.id) for r in out.collect()} == {(1, 9, 8)}


def test_very_long_texts_count_whole(spark):
    rows = [(1, words(400_000), "a"), (2, words(100_000), "b"), (3, "", None)]
    got = mx.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=2.0).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 400_000), (2, 100_000), (3, 0)} and sum(r.doc_id == 2 for r in got) == 2


def test_no_rows_and_no_tokens(spark):
    docs = documents(spark)
    assert mx.mixture(docs.limit(0)).collect() == []
    assert sorted(r.doc_id for r in mx.mixture(docs.where("source = 'none'")).collect()) == [3000, 3001]
