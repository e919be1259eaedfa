import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_join as nj
from plumbline.llm.components import components


def sets_of(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))})
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least[find(i)] if k is not None else None) for i, (k, _) in enumerate(rows)), key=str)


def corpus(r, n, length):
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                if w:
                    w[r.randrange(len(w))] = f"e{r.randint(0, 50)}"
            text = " ".join(w + [f"z{r.randint(0, 9)}"] * r.randint(0, 1))
        else:
            text = " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(0, length)))
        rows.append((i * 3 + 1, text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "length", "seed"), [(4, 85, 120, 1), (5, 80, 60, 2), (1, 50, 25, 3), (4, 85, 12, 4)])
def test_equals_brute_force(spark, width, percent, length, seed):
    rows = corpus(random.Random(seed), 250, length) + [(None, "w1 w2 w3 w4 w5 w6"), (2, None), (5, ""), (4, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS node").repartition(6)
    for task in (nj.TASK_SHINGLES, 60) if seed < 3 else (150,):
        got = sorted((tuple(x) for x in nj.similar_groups(docs, width, percent, task_shingles=task).collect()), key=str)
        assert got == brute(rows, width, percent)


def test_announcements_lose_no_link():
    r = random.Random(9)
    for percent in (50, 70, 80, 85, 95):
        for _ in range(1500):
            n = r.choice([r.randint(1, 30), r.randint(30, 400)])
            base = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            drop = r.randint(0, n * (100 - percent) // 50)
            add = np.array([r.getrandbits(64) for _ in range(r.randint(0, drop))], np.uint64)
            other = np.unique(np.concatenate([base[np.array(sorted(r.sample(range(len(base)), len(base) - min(drop, len(base)))), np.int64)], add]))
            if not len(other):
                continue
            both = len(np.intersect1d(base, other))
            if 100 * both >= percent * (len(base) + len(other) - both) and not np.array_equal(base, other):
                assert len(np.intersect1d(nj.announced(base, percent), nj.announced(other, percent))), (percent, len(base), len(other), both)


def test_the_tree_connects_what_all_pairs_connect():
    r = np.random.default_rng(7)
    sets = []
    for _ in range(300):
        if sets and r.random() < 0.7:
            s = sets[r.integers(len(sets))]
            sets.append(np.unique(np.concatenate([s[r.random(len(s)) > 0.05], r.integers(0, 1 << 63, r.integers(0, 4), dtype=np.uint64) * np.uint64(2)])))
        else:
            sets.append(np.unique(r.integers(0, 1 << 63, r.integers(5, 200), dtype=np.uint64) * np.uint64(2)))
    sets = [s for s in sets if len(s)]
    tree = nj.SignatureTree(sets, 85)
    groups = np.arange(len(sets))
    links = tree.connect(groups)
    true = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            linked = 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o)
            assert tree.linked(i, j) == linked
            if linked:
                true[true == true[i]] = true[j]
    assert len(links) == len(sets) - len(set(true))
    assert all((groups[i] == groups[j]) == (true[i] == true[j]) for i in range(len(sets)) for j in range(i))


def test_components(spark, tmp_path):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, i) for i in range(2000, 2100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}", "t").collect()}
    true = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(true[a], true[b])
            changed |= true[a] != m or true[b] != m
            true[a] = true[b] = m
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in true.items() if k not in loops}
    assert components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}", "u").collect() == []


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, "x"), (3, text, None), (3, text, None), (9, text + " end", "y"), (4, "else", None), (None, text, "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _out string")
    docs = docs.withColumnRenamed("_out", "source")
    got = nj.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.source) for x in got.collect()), key=str) == sorted([(3, None), (4, None), (None, "n"), (None, "n")], key=str)
    assert nj.keep_one(docs.limit(0)).collect() == []


def test_keep_one_tells_rows_with_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")

    def kept(rows):
        return sorted(nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), key=str)

    assert kept([(1, a), (1, b), (2, c)]) == sorted([(1, a), (1, b), (2, c)], key=str)
    assert kept([(1, a), (2, a), (2, b)]) == [(1, a), (2, b)]
    assert kept([(2, b), (2, a + " x"), (1, a), (2, None), (2, None)]) == sorted([(1, a), (2, b), (2, None), (2, None)], key=str)
    assert kept([(5, a), (5, a), (5, a.upper())]) == [(5, a.upper())]
    assert len(kept([(5, a), (5, a + " x"), (5, b)])) == 2


def test_keep_one_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(k % 40, t) for k, t in corpus(r, 160, 30)]
    got = nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sets = sets_of(rows, 5)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    alive = {}
    for i, (k, _) in enumerate(rows):
        if sets[i]:
            alive.setdefault(group[i], set()).add(k)
    wordless = sum(not s for s in sets)
    assert len(got) == len(alive) + wordless
    assert sorted(x.doc_id for x in got if (x.text or "").split()) == sorted(map(min, alive.values()))


def test_hubs_are_connected_like_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.HUB_EDGES", 3)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(900, i) for i in range(500, 800)] + [(r.randint(0, 800), r.randint(801, 1200)) for _ in range(100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}", "h").collect()}
    true = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            true[a] = true[b] = min(true[a], true[b])
    assert got == true


def test_very_long_texts(spark):
    r = random.Random(5)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(60_000)]
    near = words[:]
    for i in range(0, 60_000, 200):
        near[i] = "edit"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:30_000])), (4, "x" * 500_000), (5, "x" * 500_000)]
    assert sorted(tuple(x) for x in nj.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()) == brute(rows, 4, 85)


def shuffled(spark, run):
    """Bytes that ``run`` writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, no_quantiles, None)
        return {(s := found.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("copies", [1, 20])
def test_texts_of_rows_that_take_no_part_are_not_shuffled(spark, monkeypatch, copies):
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0, raising=False)  # as if there were many members
    words = lambda seed: " ".join("%x" % random.Random(f"{seed}-{k}").getrandbits(800) for k in range(80))
    rows = [(i, words(i // copies)) for i in range(300)] + [(1000, words("x")), (1001, words("x") + " more"), (None, "a b"), (1002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.lit(1))
    found = []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        n = shuffled(spark, lambda: found.extend(r.doc_id for r in nj.keep_one(docs).select("doc_id").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(found, key=str) == sorted([*range(0, 300, copies), 1000, 1002, None], key=str)
    assert n < 0.35 * sum(len(t or "") for _, t in rows)


def test_a_filter_loses_no_id(spark, monkeypatch):
    monkeypatch.setattr(nj, "MOST_FILTER_BITS", nj.ROW_BITS, raising=False)  # more ids than it holds well
    ids = spark.range(-5000, 5000, 7)
    rows = spark.range(-20_000, 20_000).select("id", F.lit("x").alias("at")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'x'"))
    some = nj._having(rows, "id", ids)
    assert some.columns == rows.columns and some.join(ids, "id").count() == ids.count() and some.count() < 8000
    for stay, gone in ((spark.range(100), spark.range(100, 40_000)), (spark.range(100, 40_000), spark.range(100))):
        left = {r.id for r in nj._without(rows.where("id IS NULL OR id >= 0"), "id", gone, stay).collect()}
        assert left == {r.id for r in stay.where("id < 20000").collect()} | {None}
