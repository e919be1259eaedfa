import random

import pytest

from plumbline.operators import graph as g


def edges(spark, pairs, kind="direct"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, call_type string")


def nodes(spark, ids, **more):
    base = {"name": None, "package": "p", "file": "f.go", "line": 1, "kind": "function", "receiver": "", "exported": False, "signature": ""}
    rows = [tuple([i, *[(more.get(i, {}).get(k, v) if v is not None or k in more.get(i, {}) else i) for k, v in base.items()]]) for i in ids]
    return spark.createDataFrame(rows, "id string, name string, package string, file string, line long, kind string, receiver string, exported boolean, signature string")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_fan_and_reach(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("A", "C")])
    n = nodes(spark, "ABC")
    assert ids(g.callees(e, "A")) == ["B", "C"] and ids(g.callers(e, "C")) == ["A", "B"]
    assert ids(g.reachable(e, n.where("id = 'A'"))) == ["A", "B", "C"]
    assert ids(g.reachable(e, n.where("id = 'C'"), reverse=True)) == ["A", "B", "C"]
    assert ids(g.roots(n, e)) == ["A"] and ids(g.leaves(n, e)) == ["C"]


def test_repeated_and_dangling_edges(spark):
    e = edges(spark, [("A", "B"), ("A", "B"), ("B", "X")])
    n = nodes(spark, "AB")
    assert {r.id: (r.fan_in, r.fan_out) for r in g.degrees(n, e).collect()} == {"A": (0, 2), "B": (2, 1)}
    assert "X" in ids(g.reachable(e, n.where("id = 'A'")))


def test_cycles(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "D"), ("C", "E")])
    assert {(r.id, r.component, r.size) for r in g.cycles(nodes(spark, "ABCDE"), e).collect()} == {("A", "A", 3), ("B", "A", 3), ("C", "A", 3)}
    with pytest.raises(ValueError, match="cycle"):
        g.topological(nodes(spark, "A"), edges(spark, [("A", "A")]))


def brute_scc(pairs, names):
    reach = {a: {a} for a in names}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for r in reach.values():
                if a in r and b not in r:
                    r.add(b)
                    changed = True
    return {a: min(b for b in reach[a] if a in reach[b]) for a in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(30)]
    got = {x.id: x.component for x in g.strong_components(nodes(spark, names), edges(spark, pairs)).collect()}
    assert got == brute_scc(pairs, names)


def test_topological_order_puts_callees_first(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")]
    order = [r.id for r in g.topological(nodes(spark, "abcde"), edges(spark, pairs)).collect()]
    assert sorted(order) == list("abcde") and all(order.index(b) < order.index(a) for a, b in pairs)


def brute_between(names, pairs, sources):
    nxt = {a: sorted({b for x, b in pairs if x == a}) for a in {x for p in pairs for x in p} | set(names)}
    counts = {}
    for s in sorted(names)[:sources]:
        seen, level = {s: []}, [s]
        while level:
            found = {}
            for u in sorted(level):
                for v in nxt[u]:
                    if v not in seen and v not in found:
                        found[v] = seen[u] + ([u] if u != s else [])
            seen |= found
            level = list(found)
            for path in found.values():
                for x in path:
                    counts[x] = counts.get(x, 0) + 1
    most = max(counts.values(), default=0)
    return {n: counts.get(n, 0) / most if most else 0.0 for n in names}


def test_betweenness_equals_brute_force(spark):
    r = random.Random(5)
    names = [f"n{i:02d}" for i in range(18)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(34)]
    got = {x.id: x.betweenness for x in g.betweenness(nodes(spark, names), edges(spark, pairs), 10).collect()}
    assert got == pytest.approx(brute_between(names, pairs, 10))


def test_impact_levels(spark):
    e = edges(spark, [(f"c{i:02d}", "t") for i in range(21)])
    row = g.impact(e, "t").first()
    assert (row.direct_callers, row.transitive_callers, row.affected, row.risk_level) == (21, 22, 21, "high")
    assert g.impact(e, "nowhere").first().affected == 0


def test_dead_and_untested(spark):
    more = {"main": {"package": "main"}, "Lib": {"exported": True}, "TestUsed": {}, "x.initialize": {}}
    n = nodes(spark, ["main", "used", "dead", "Lib", "TestUsed", "x.initialize"], **more)
    e = edges(spark, [("main", "used"), ("TestUsed", "used")])
    assert {r.id: round(r.confidence, 3) for r in g.dead_code(n, e).collect()} == {"dead": 0.95, "Lib": 0.7}
    assert set(ids(g.untested(n, e))) == {"main", "dead", "Lib"}


def test_empty_graph(spark):
    n, e = nodes(spark, ["a"]).limit(0), edges(spark, [("a", "b")]).limit(0)
    for found in (g.degrees(n, e), g.closure(e), g.strong_components(n, e), g.topological(n, e), g.betweenness(n, e), g.closeness(n, e), g.dead_code(n, e), g.untested(n, e), g.package_metrics(n, e)):
        assert found.collect() == []
