"""Code-graph operators.

Inputs: ``nodes`` (id, name, package, file, line, kind, receiver, exported,
signature) and ``edges`` (src, dst, call_type). Edges may repeat and may end at
ids that are no nodes. Every traversal runs level by level: a frontier is joined
with the edges by key, what is known is removed by an anti join, and each level is
written to the shared folder, so plans stay short however deep the graph is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import shared_dir, stored

DEFAULT_DEPTH = 10


def callers(edges: DataFrame, node: str) -> DataFrame:
    """G1: direct callers, one row per edge."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("id"))


def callees(edges: DataFrame, node: str) -> DataFrame:
    """G1: direct callees, one row per edge."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of existing nodes; repeated edges count each."""
    n_in = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    n_out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.select("id").join(n_in, "id", "left").join(n_out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without incoming edges."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without outgoing edges."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def _steps(edges: DataFrame, reverse: bool) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, depth, parent): what ``seeds`` (id) reach, at its least depth; parent is the least id one level up (Q3).

    Seeds have depth 0 and no parent. ``max_depth`` None: to the end.
    """
    root = shared_dir(edges.sparkSession)
    steps = stored(_steps(edges, reverse), f"{root}/steps")
    seen = stored(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")), f"{root}/0")
    parts, frontier, depth = [seen], seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.unionAll, parts).select("id")
        reached = frontier.select("id").join(steps, F.col("id") == F.col("_from")).groupBy(F.col("_to").alias("id")).agg(F.min("_from").alias("parent"))
        frontier = stored(reached.join(known, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), f"{root}/{depth}")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionAll, parts)


def _seed(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "id string")


def bounded(edges: DataFrame, node: str, depth: int = DEFAULT_DEPTH, reverse: bool = False) -> DataFrame:
    """(id, depth, parent) of the tree edges found within ``depth`` steps, the start left out; depth <= 0 means the default."""
    return levels(edges, _seed(edges, node), depth if depth > 0 else DEFAULT_DEPTH, reverse).where("depth > 0")


def transitive(edges: DataFrame, node: str, depth: int = 3, reverse: bool = False) -> DataFrame:
    """The distinct ids of G4."""
    return bounded(edges, node, depth, reverse).select("id")


def reachable(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """Ids reached from ``seeds`` (id), which are included."""
    return levels(edges, seeds, None, reverse).select("id")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, id, depth): the least number of steps from each source to all it reaches in one step or more.

    A source on a cycle reaches itself. Quadratic in the worst case by definition.
    """
    root = shared_dir(edges.sparkSession)
    steps = stored(_steps(edges, False), f"{root}/steps")
    frontier = sources.select(F.col("id").alias("src"), "id").distinct()
    parts: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        reached = frontier.join(steps, F.col("id") == F.col("_from")).select("src", F.col("_to").alias("id")).distinct()
        if parts:
            reached = reached.join(reduce(DataFrame.unionAll, parts).select("src", "id"), ["src", "id"], "left_anti")
        frontier = stored(reached.withColumn("depth", F.lit(depth)), f"{root}/{depth}")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        frontier = frontier.select("src", "id")
    return reduce(DataFrame.unionAll, parts) if parts else stored(sources.select(F.col("id").alias("src"), "id", F.lit(0).alias("depth")).where("false"), f"{root}/none")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of the transitive closure by semi-naive iteration; (a, a) only on a cycle."""
    return distances(edges, edges.select(F.col("src").alias("id"))).select("src", F.col("id").alias("dst"))


def _trimmed(edges: DataFrame, root: str) -> DataFrame:
    """The distinct edges that may lie on a cycle: ends without predecessors or successors are taken away again and again."""
    left = stored(edges.select("src", "dst").where("src <> dst").distinct(), f"{root}/trim-0")
    n, turn = left.count(), 0
    while n:
        turn += 1
        core = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = stored(core.select("src", "dst"), f"{root}/trim-{turn}")
        m = left.count()
        if m == n:
            break
        n = m
    return left


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size) of all ids, nodes or not; the component is its least member.

    Forward-backward colouring: every remaining id takes the least id that reaches
    it; what reaches a colour's own id backwards within the colour is that
    component; the rest is coloured again.
    """
    root = shared_dir(edges.sparkSession)
    everything = nodes.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
    left, done, turn = _trimmed(edges, root), [], 0
    while not left.isEmpty():
        turn += 1
        ids = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = stored(ids.withColumn("c", F.col("id")), f"{root}/{turn}-c0")
        step, total = 0, -1
        while True:
            step += 1
            back = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = stored(colour.join(back, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("changed")), f"{root}/{turn}-c{step}")
            total = new.where("changed").limit(1).count()
            colour = new.select("id", "c")
            if not total:
                break
        inner = left.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c = c2")
        inner = stored(inner.select("src", "dst"), f"{root}/{turn}-inner")
        found = reachable(inner, colour.where("id = c").select("id"), reverse=True)
        component = stored(colour.join(found, "id", "left_semi"), f"{root}/{turn}-found")
        done.append(component)
        rest = left.join(component.select(F.col("id").alias("src")), "src", "left_anti").join(component.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = _trimmed(rest, f"{root}/{turn}")
    members = reduce(DataFrame.unionAll, done) if done else everything.where("false").withColumn("c", F.col("id"))
    named = everything.join(members, "id", "left").select("id", F.coalesce("c", "id").alias("component"))
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of components of more than one id; a self-loop is no cycle."""
    return strong_components(nodes, edges).where("size > 1")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level), ordered by level then id; raises ValueError if there is a cycle, self-loops included.

    An id's level is one more than the highest of its callees, as callees come first.
    """
    root = shared_dir(edges.sparkSession)
    left = stored(edges.select("src", "dst").distinct(), f"{root}/left-0")
    ids = stored(nodes.select("id").union(left.select("src")).union(left.select("dst")).distinct(), f"{root}/ids-0")
    parts, level = [], 0
    while not ids.isEmpty():
        ready = stored(ids.join(left.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(level).alias("level")), f"{root}/ready-{level}")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        parts.append(ready)
        level += 1
        ids = stored(ids.join(ready, "id", "left_anti"), f"{root}/ids-{level}")
        left = stored(left.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), f"{root}/left-{level}")
    if not parts:
        return ids.select("id", F.lit(0).alias("level"))
    return reduce(DataFrame.unionAll, parts).orderBy("level", "id")


def risk_of(affected: Column) -> Column:
    """More than 50, 20 and 10 affected."""
    return F.when(affected > 50, "critical").when(affected > 20, "high").when(affected > 10, "medium").otherwise("low")


def impact(edges: DataFrame, node: str) -> DataFrame:
    """(node, direct_callers, transitive_callers, affected, risk_level); transitive counts the node itself, affected does not."""
    direct = callers(edges, node).agg(F.count("*").alias("direct_callers"))
    reach = reachable(edges, _seed(edges, node), reverse=True).agg(F.count("*").alias("transitive_callers"))
    both = direct.crossJoin(reach)  # one row each
    affected = F.col("transitive_callers") - 1
    return both.select(F.lit(node).alias("node"), "direct_callers", "transitive_callers", affected.alias("affected"), risk_of(affected).alias("risk_level"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G13."""
    return degrees(nodes, edges).select("id", (F.col("fan_in") + F.col("fan_out")).cast("double").alias("degree"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int = 100) -> DataFrame:
    """(id, betweenness): on one shortest path per pair from the first ``sources`` ids, how often an id lies inside, over the most.

    The count of sources is the operator's own (an approximation); ties between
    parents go to the least id.
    """
    root = shared_dir(edges.sparkSession)
    steps = stored(_steps(edges, False), f"{root}/steps")
    first = nodes.select("id").distinct().orderBy("id").limit(sources)
    frontier = stored(first.select(F.col("id").alias("src"), "id", F.array().cast("array<string>").alias("inside")), f"{root}/0")
    parts, depth = [frontier], 0
    while True:
        depth += 1
        inner = F.when(F.col("id") == F.col("src"), F.col("inside")).otherwise(F.concat("inside", F.array("id")))
        reached = frontier.join(steps, F.col("id") == F.col("_from")).select("src", F.col("_to").alias("to"), F.col("id").alias("parent"), inner.alias("path"))
        reached = reached.groupBy("src", "to").agg(F.min_by("path", "parent").alias("inside")).withColumnRenamed("to", "id")
        known = reduce(DataFrame.unionAll, parts).select("src", "id")
        frontier = stored(reached.join(known, ["src", "id"], "left_anti").select("src", "id", "inside"), f"{root}/{depth}")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    counts = reduce(DataFrame.unionAll, parts).select(F.explode("inside").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return nodes.select("id").distinct().join(counts, "id", "left").crossJoin(most).select("id", F.coalesce(F.try_divide("n", "most"), F.lit(0.0)).alias("betweenness"))


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, closeness): the number of ids reached over the sum of their distances, 0 if none; an id's way back to itself does not count."""
    d = distances(edges, nodes.select("id")).where("src <> id")
    s = d.groupBy(F.col("src").alias("id")).agg((F.count("*") / F.sum("depth")).alias("c"))
    return nodes.select("id").join(s, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("closeness"))


def package_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, average and most fan-in and fan-out, and the most members of one cycle, for each package."""
    d = degrees(nodes, edges).join(nodes.select("id", "package"), "id")
    base = d.groupBy("package").agg(
        F.count("*").alias("n_nodes"),
        F.sum("fan_out").alias("n_edges"),
        F.avg("fan_in").alias("avg_fan_in"),
        F.avg("fan_out").alias("avg_fan_out"),
        F.max("fan_in").alias("max_fan_in"),
        F.max("fan_out").alias("max_fan_out"),
    )
    inside = cycles(nodes, edges).join(nodes.select("id", "package"), "id").groupBy("package", "component").agg(F.count("*").alias("n"))
    depth = inside.groupBy(F.col("package").alias("_package")).agg(F.max("n").alias("cyclic_depth"))
    return base.join(depth, F.col("package").eqNullSafe(F.col("_package")), "left").drop("_package").na.fill(0, ["cyclic_depth"])


def cross_package(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between existing nodes of different packages, as often as they occur."""
    a = nodes.select(F.col("id").alias("src"), F.col("package").alias("src_package"))
    b = nodes.select(F.col("id").alias("dst"), F.col("package").alias("dst_package"))
    return edges.join(a, "src").join(b, "dst").where("src_package <> dst_package").select("src", "dst", "call_type", "src_package", "dst_package")


def resolve_interfaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges, and for each interface edge to a method one ``interface_impl`` edge to every method of the same name and another receiver."""
    method = nodes.where("kind = 'method'")
    target = method.select(F.col("id").alias("dst"), F.col("name").alias("m_name"), F.coalesce("receiver", F.lit("")).alias("m_receiver"))
    other = method.select(F.col("id").alias("impl"), F.col("name").alias("m_name"), F.coalesce("receiver", F.lit("")).alias("i_receiver"))
    found = edges.where("call_type = 'interface'").join(target, "dst").join(other, "m_name").where("i_receiver <> m_receiver")
    return edges.select("src", "dst", "call_type").unionByName(found.select("src", F.col("impl").alias("dst"), F.lit("interface_impl").alias("call_type")))


def analysed_dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, state): ``unreachable`` from any exported function or method, ``orphaned`` without any edge, or both."""
    exported = nodes.where("exported AND kind IN ('function', 'method')")
    dead = nodes.select("id").join(reachable(edges, exported), "id", "left_anti").withColumn("unreachable", F.lit(True))
    alone = degrees(nodes, edges).where("fan_in = 0 AND fan_out = 0").select("id", F.lit(True).alias("orphaned"))
    return dead.join(alone, "id", "full").na.fill(False, ["unreachable", "orphaned"])


def short_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def entry_points(nodes: DataFrame) -> DataFrame:
    """(id, reason). The names, places and parameter types below."""
    short = short_name(F.col("name"))
    package = F.coalesce("package", F.lit(""))
    signature = F.coalesce("signature", F.lit(""))
    in_command = package.contains("/cmd/") | package.startswith("cmd") | (package == "main")
    reason = (
        F.when(short == "main", "main")
        .when(is_init_name(F.col("name")), "init")
        .when(F.col("exported") & in_command, "command")
        .when(signature.contains("http.ResponseWriter") & signature.contains("*http.Request"), "handler")
    )
    return nodes.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def is_test_name(name: Column) -> Column:
    """Fixed prefixes of the last dotted part."""
    return short_name(name).rlike("^(Test|Benchmark|Fuzz|Example)")


def is_init_name(name: Column) -> Column:
    return (name == "init") | name.contains(".init") | name.startswith("init.") | name.startswith("init#")


def dead_code_confidence(nodes: DataFrame, edges: DataFrame, alive: DataFrame) -> DataFrame:
    """(id, confidence); ``alive`` (id): what entry points reach. Fixed values as in the expression."""
    d = degrees(nodes, edges)
    flags = nodes.join(d, "id").join(alive.select("id").distinct().withColumn("_alive", F.lit(True)), "id", "left")
    flags = flags.join(edges.where("call_type = 'interface'").select(F.col("dst").alias("id")).distinct().withColumn("_interface", F.lit(True)), "id", "left")
    package = F.coalesce("package", F.lit(""))
    command = package.contains("/cmd/") | (package == "main")
    n = F.col("fan_in")
    base = F.when(~F.col("exported") & (n == 0), 0.95).when(F.col("exported") & (n == 0) & command, 0.9).otherwise(0.7)
    base = base * F.when(F.col("exported") & (n > 0) & ~command, 0.6).otherwise(1.0)
    base = base * F.when((F.col("kind") == "method") & F.col("_interface"), 0.5).otherwise(1.0)
    base = base * F.when(n > 0, 1 - 0.1 * n).otherwise(1.0)
    value = F.when(F.col("_alive"), 0.0).otherwise(F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0)))
    return flags.select("id", value.alias("confidence"))


def dead_code(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.5, include_tests: bool = False) -> DataFrame:
    """(id, confidence, reason) of nodes that no entry point reaches, init and, unless asked for, tests left out; ordered by confidence, then id."""
    alive = reachable(edges, entry_points(nodes).select("id"))
    scored = dead_code_confidence(nodes, edges, alive).join(nodes, "id").join(degrees(nodes, edges), "id")
    keep = ~is_init_name(F.col("name")) & (F.lit(include_tests) | ~is_test_name(F.col("name")))
    found = scored.where(keep).join(alive, "id", "left_anti").where(F.col("confidence") >= min_confidence)
    reason = F.when(F.col("fan_in") == 0, F.when(F.col("exported"), "exported, never called").otherwise("never called")).otherwise("called only from unreachable code")
    return found.select("id", "confidence", reason.alias("reason")).orderBy(F.desc("confidence"), "id")


def dead_code_summary(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(alive, dead) counts."""
    dead = dead_code(nodes, edges, min_confidence).agg(F.count("*").alias("dead"))
    return nodes.agg(F.count("*").alias("total")).crossJoin(dead).select((F.col("total") - F.col("dead")).alias("alive"), "dead")


def untested_priority(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, priority).

    Fixed values: the weights .35, .25, .15, .15 and .10, the divisors 20 and 6, the
    steps of each part, and the words that mark receivers and packages.
    """
    d = degrees(nodes, edges)
    near = near_callers(nodes, edges, 3)
    x = nodes.join(d, "id").join(near, "id", "left")
    signature = F.lower(F.coalesce("signature", F.lit("")))
    entry = (F.col("name") == "main.main") | (signature.contains("http.responsewriter") & signature.contains("*http.request"))
    receiver = F.lower(F.coalesce("receiver", F.lit("")))
    method = F.when(F.col("kind") != "method", 0.2).when(receiver.rlike(CRITICAL_RECEIVERS), 1.0).otherwise(0.5)
    package = F.lower(F.coalesce("package", F.lit("")))
    where = F.when(package.rlike(OUTER_PACKAGES), 1.0).when(package.rlike(INNER_PACKAGES), 0.6).otherwise(0.3)
    depth = F.when(entry, 1.0).when(F.coalesce("near", F.lit(0)) == 0, 0.1).otherwise(F.least(F.col("near"), F.lit(6)) / 6.0)
    value = 0.35 * F.least(F.col("fan_in") / 20.0, F.lit(1.0)) + 0.25 * F.when(F.col("exported"), 1.0).otherwise(0.3) + 0.15 * method + 0.15 * depth + 0.10 * where
    return x.select("id", F.round(value, 6).alias("priority"))


# Parts of names.
CRITICAL_RECEIVERS = "error|reader|writer|readcloser|writecloser|readwriter|handler|roundtripper|transport|database|sql|tx|conn|listener"
OUTER_PACKAGES = "cmd|main|handler|server|api|gateway"
INNER_PACKAGES = "internal|pkg"


def near_callers(nodes: DataFrame, edges: DataFrame, hops: int, most: int = 6) -> DataFrame:
    """(id, near): how many distinct other ids call a node within ``hops`` steps, counted up to ``most``.

    Of a node's callers only the ``most`` + 1 least ids are kept at each hop (one may be
    the node itself), so the work is linear in the edges; the bound drops rows of a
    node with many callers before their shuffle.
    """
    steps = _steps(edges, True).where("_from <> _to")

    def some(pairs: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("id").orderBy("by"))
        return pairs.distinct().withColumn("_k", place).where(F.col("_k") <= most + 1).select("id", "by")

    direct = steps.select(F.col("_from").alias("id"), F.col("_to").alias("by"))
    found = some(direct)
    for _ in range(hops - 1):
        found = some(direct.union(steps.join(found, F.col("_to") == F.col("id")).select(F.col("_from").alias("id"), "by")))
    counts = found.where("id <> by").groupBy("id").agg(F.least(F.count("*"), F.lit(most)).alias("near"))
    return nodes.select("id").join(counts, "id")


def untested(nodes: DataFrame, edges: DataFrame, min_priority: float = 0.0, include_exported: bool = True) -> DataFrame:
    """(id, priority) of functions that no test reaches within 10 steps; ordered by priority, then id."""
    tests = nodes.where(is_test_name(F.col("name"))).select("id")
    tested = levels(edges, tests, DEFAULT_DEPTH).select("id")
    keep = ~is_test_name(F.col("name")) & ~is_init_name(F.col("name")) & F.col("kind").isin("function", "method")
    if not include_exported:
        keep = keep & ~F.col("exported")
    left = nodes.where(keep).select("id").join(tested, "id", "left_anti")
    return left.join(untested_priority(nodes, edges), "id").where(F.col("priority") >= min_priority).orderBy(F.desc("priority"), "id")


def with_coverage(found: DataFrame, nodes: DataFrame, coverage: DataFrame) -> DataFrame:
    """``found`` (id, ..) with its file's percentage from ``coverage`` (file, pct), null without an exact match."""
    return found.join(nodes.select("id", "file"), "id").join(coverage.select("file", "pct"), "file", "left")


def has_test_file(files: DataFrame) -> DataFrame:
    """(file, has_test) of the source files of an inventory (file): whether ``x_test.go`` stands beside ``x.go``."""
    source = files.where(F.col("file").endswith(".go") & ~F.col("file").endswith("_test.go"))
    tests = files.where(F.col("file").endswith("_test.go")).select(F.regexp_replace("file", r"_test\.go$", ".go").alias("file")).distinct().withColumn("has_test", F.lit(True))
    return source.join(tests, "file", "left").na.fill(False, ["has_test"]).select("file", "has_test")


def audit(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The first ``top`` findings of G22 and of G23 (a report of its nature)."""
    dead = dead_code(nodes, edges).limit(top).select(F.lit("dead_code").alias("part"), "id", F.col("confidence").alias("score"))
    bare = untested(nodes, edges).limit(top).select(F.lit("untested").alias("part"), "id", F.col("priority").alias("score"))
    return dead.unionByName(bare)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges)."""
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
