"""N-gram Jaccard self-join by signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity is at
least ``percent`` / 100. The result is exact (up to clashes of 64-bit hashes).

1. Equal sets are one node, whatever the number of copies.
2. Candidates. Sizes fall into classes such that linked sets are in the same or
   neighbouring classes. In a class's scheme the hash range is cut into m parts.
   Linked sets differ in at most k shingles, hence agree on at least m - k parts:
   a set announces (scheme, part, hash of its shingles there). As fewer than m - k
   parts of any set may be left out without losing a link, a set leaves out its
   smallest ones, above all empty ones; both sides of an agreeing part judge its
   size alike, so an announced part is common to both (see ``announced``).
   A task links equal announcements of its own rows to the first of them and
   sends only that one on, so a widespread announcement is one row per task.
3. Nodes that announcements connect form candidate groups, made by distributed
   components. A group's sets meet in a task, which builds a signature tree: a
   node of the tree holds the OR of its members' bitmaps, the range of their
   sizes and the largest excess of shingles over bits. Pairs of tree nodes are
   visited together and left when sizes or the most overlap that the bitmaps allow
   exclude a link, or when all members are connected already. What is left is
   compared exactly.
4. A group of more than ``task_shingles`` shingles is dealt into chunks by the sizes
   of its sets. First each chunk is joined by itself together with a few members that
   all chunks get. What that does not connect with the group's largest part is dealt
   into chunks of its own, and each of these is joined with every chunk whose sizes
   allow a link.
5. Links found are connected by distributed components.

Defined results: a null or wordless text has no shingles, links with nothing and
is its own component. A null id takes no part in links; its component is null.
Repeated rows and rows that share an id are documents of their own with that id.
Ids are integers, or strings of such; others fail. Texts of any length are taken
whole. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import arrow_map, slices, texts_of
from plumbline.llm._shared import shared_dir, written
from plumbline.llm.components import components
from plumbline.llm.shingles import mixed, shingle_sets

#: Shingles of sets that a chunk of a candidate group holds; larger groups have several.
TASK_SHINGLES = 40_000
#: Announcements that a task sorts at a time.
HELD = 1_000_000
#: Members that all chunks of a large group get, on average.
HUBS = 32
#: Bits that a filter has for each of its ids, and at most in all (64 MB); beyond, more rows pass, none are lost.
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 29
#: Bits of one row of a filter; what ``bitmap_construct_agg`` makes.
ROW_BITS = 32_768


def set_key(s: np.ndarray) -> int:
    """The identity of a set, from the sum of its hashes and its size."""
    with np.errstate(over="ignore"):
        total = s.sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(np.array([total]))[0].astype(np.int64))


@lru_cache(maxsize=8)
def size_classes(percent: int, most: int) -> tuple[int, ...]:
    """Where classes begin, up to the first beyond ``most``: a set's links lie in its class and the next ones beside it."""
    begins = [1]
    while begins[-1] <= most:
        begins.append(max(begins[-1] + 1, 100 * begins[-1] // percent + 1))
    return tuple(begins)


def _differences(a: int, b: int, percent: int) -> int:
    """The most shingles in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def announced(s: np.ndarray, percent: int) -> np.ndarray:
    """What a set (ascending hashes) announces.

    In a scheme for sets of at most ``top`` shingles there are m parts. This set and
    one it links with differ in at most k parts, so they agree on m - k or more. The
    set leaves out its parts of at most ``cut`` shingles if these are fewer than m - k.
    Of two linked sets take the one with the higher cut: some part they agree on is
    larger than that, and so both announce it.
    """
    n = len(s)
    begins = size_classes(percent, 1 << max(8, (4 * n).bit_length()))
    own = int(np.searchsorted(begins, n, "right")) - 1
    found = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)])
    for scheme in (own, own + 1):
        top = begins[scheme + 1] - 1
        widest = _differences(top, top, percent)
        if not widest:
            continue  # in such small sets a link means equality
        parts = widest + 1 + (widest + 3) // 4
        bounds = (np.arange(1, parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts) << np.uint64(32)
        cuts = np.concatenate([[0], np.searchsorted(s, bounds), [n]])
        sizes = np.diff(cuts)
        spare = parts - 1 - _differences(n, min(top, 100 * n // percent), percent)
        cut = int(np.searchsorted(np.cumsum(np.bincount(sizes)), spare, "right")) - 1
        use = np.flatnonzero(sizes > cut)
        with np.errstate(over="ignore"):
            where = (use.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme)
            found.append(mixed(sums[cuts[use + 1]] - sums[cuts[use]] + mixed(where)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class SignatureTree:
    """A tree over sets for joining them with themselves."""

    LEAF, FAN = 8, 4

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, n = sets, percent, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        width = 1 << int(np.clip((2 * int(np.median(self.sizes))).bit_length(), 8, 15))
        bits = np.zeros((n, width), bool)
        shift = np.uint64(64 - (width - 1).bit_length())
        for i, s in enumerate(sets):
            bits[i, (s >> shift).astype(np.int64)] = True
        self.excess = self.sizes - bits.sum(axis=1)
        self.bitmaps = np.packbits(bits, axis=1).view(np.uint64)
        del bits
        # levels from the leaves up; node k of level d covers the sets from LEAF * FAN**d * k on
        self.levels = []
        step = self.LEAF
        maps, low, high, extra = self.bitmaps, self.sizes, self.sizes, self.excess
        first = True
        while first or len(maps) > 1:
            at = np.arange(0, len(maps), self.LEAF if first else self.FAN)
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            low, high, extra = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)
            self.levels.append((step, maps, low, high, extra))
            step *= self.FAN
            first = False

    def may_link(self, level: int, a: int, b: int) -> bool:
        """Whether sizes and bitmaps of two tree nodes allow a link: two sets share at most the common bits and either one's excess."""
        _, maps, low, high, extra = self.levels[level]
        p = self.percent
        if 100 * high[a] < p * low[b] or 100 * high[b] < p * low[a]:
            return False
        if a == b:
            return True
        common = int(np.bitwise_count(maps[a] & maps[b]).sum()) + int(min(extra[a], extra[b]))
        return (100 + p) * common >= p * int(low[a] + low[b])

    def linked(self, i: int, j: int) -> bool:
        """The exact comparison, behind the bound from the two bitmaps."""
        a, b = self.sets[i], self.sets[j]
        p, need = self.percent, self.percent * (len(a) + len(b))
        if 100 * min(len(a), len(b)) < p * max(len(a), len(b)):
            return False
        if (100 + p) * (int(np.bitwise_count(self.bitmaps[i] & self.bitmaps[j]).sum()) + int(min(self.excess[i], self.excess[j]))) < need:
            return False
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return (100 + p) * int((b[at] == a).sum()) >= need

    def connect(self, groups: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what links connect. ``groups``: what is known to be connected; changed as links are found.

        ``sides``: of two sets with side 0 it is known whether they are linked, so these are not compared.
        """
        found = []
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        n = len(self.sets)
        while stack:
            level, a, b = stack.pop()
            step = self.levels[level][0]
            left, right = slice(a * step, min(n, (a + 1) * step)), slice(b * step, min(n, (b + 1) * step))
            one = groups[left.start]
            if (groups[left] == one).all() and (a == b or (groups[right] == one).all()):
                continue
            if not self.may_link(level, a, b):
                continue
            if level:
                below = len(self.levels[level - 1][2])
                xs = range(self.FAN * a, min(below, self.FAN * (a + 1)))
                ys = range(self.FAN * b, min(below, self.FAN * (b + 1)))
                pairs = [(level - 1, x, y) for x in xs for y in ys if a != b or x <= y]
                stack += sorted(pairs, key=lambda q: q[1] == q[2])  # a node with itself comes off first
                continue
            for i in range(left.start, left.stop):
                for j in range(max(i + 1, right.start), right.stop):
                    if groups[i] != groups[j] and (sides is None or sides[i] or sides[j]) and self.linked(i, j):
                        found.append((i, j))
                        groups[groups == groups[j]] = groups[i]
        return found


def _table(docs: DataFrame, width: int) -> DataFrame:
    """(id, node, n): every row's set by its key (null if empty) and its size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, 1)
            for i, j in slices(texts):
                sets = shingle_sets(texts[i:j], width)
                keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), keys, pa.array([len(s) for s in sets], pa.int64())], names=["id", "node", "n"])

    return arrow_map(docs, work, "id long, node long, n long")


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): nodes with an equal announcement, each linked to the first node that has it."""
    names = ["key", "node", "to"]

    def first_of(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """For rows sorted by key, the node that begins the row's run."""
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return np.repeat(nodes[begins], np.diff(np.concatenate([begins, [len(keys)]])))

    def batch_of(keys, nodes, to) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), to], names=names)

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for k, _ in held]).view(np.int64)
            nodes = np.repeat(np.array([x for _, x in held], np.int64), [len(k) for k, _ in held])
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            head = first_of(keys, nodes)
            lead = np.concatenate([[True], keys[1:] != keys[:-1]])
            yield batch_of(keys[lead], nodes[lead], pa.nulls(int(lead.sum()), pa.int64()))
            a, b = _unique_pairs(head[nodes != head], nodes[nodes != head])
            yield batch_of(mixed(b.view(np.uint64)).view(np.int64), b, pa.array(a, pa.int64()))

        for batch in batches:
            texts = texts_of(batch, 1)
            for i, j in slices(texts):
                for s in shingle_sets(texts[i:j], width):
                    key = set_key(s) if len(s) else None
                    if key is None or key in seen:
                        continue
                    if len(seen) >= HELD // 4:
                        seen.clear()
                    seen.add(key)
                    held.append((announced(s, percent), key))
                    n += len(held[-1][0])
                    if n >= HELD:
                        yield from flush()
                        held, n = [], 0
        if n:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_head = None
        for batch in batches:
            to = batch.column(2)
            is_edge = to.is_valid().to_numpy(zero_copy_only=False)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            a, b = [to.drop_null().to_numpy(zero_copy_only=False)], [node[is_edge]]
            keys, nodes = batch.column(0).to_numpy(zero_copy_only=False)[~is_edge], node[~is_edge]
            if len(keys):
                head = first_of(keys, nodes)
                if last_key is not None and keys[0] == last_key:
                    head[keys == last_key] = last_head
                last_key, last_head = keys[-1], head[-1]
                a.append(head[nodes != head])
                b.append(nodes[nodes != head])
            x, y = _unique_pairs(np.concatenate(a), np.concatenate(b))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    sent = arrow_map(docs, announce, "key long, node long, to long")
    return arrow_map(sent.repartition("key").sortWithinPartitions("key", "node"), meet, "a long, b long", rows=None)


def _linked(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) from rows (task.., node, known, side, text) whose first columns, sorted, name the task."""
    places = [c for c in rows.columns if c.startswith("task")]
    k = len(places)

    def join(nodes: list[int], sets: list[np.ndarray], known: list[int], sides: list[int]) -> Iterator[pa.RecordBatch]:
        if len(nodes) < 2:
            return
        order = sorted(range(len(nodes)), key=lambda i: (int(sets[i][0]), len(sets[i])))  # like sets tend to share their least hash
        tree = SignatureTree([sets[i] for i in order], percent)
        labels = np.unique(np.array([known[i] for i in order], np.int64), return_inverse=True)[1]
        side = np.array([sides[i] for i in order])
        links = tree.connect(labels, side if side.any() else None)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[order[i]] for i, _ in links], pa.int64()), pa.array([nodes[order[j]] for _, j in links], pa.int64())], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nodes, sets, known, sides, have = None, [], [], [], [], set()
        for batch in batches:
            which = list(zip(*[batch.column(c).to_pylist() for c in range(k)], strict=True))
            node, label, side = (batch.column(c).to_pylist() for c in range(k, k + 3))
            texts = texts_of(batch, k + 3)
            for i, j in slices(texts):
                for r, s in zip(range(i, j), shingle_sets(texts[i:j], width), strict=True):
                    if which[r] != task:
                        yield from join(nodes, sets, known, sides)
                        task, nodes, sets, known, sides, have = which[r], [], [], [], [], set()
                    if node[r] not in have and len(s) and set_key(s) == node[r]:  # another row may share the id
                        have.add(node[r])
                        nodes.append(node[r])
                        sets.append(s)
                        known.append(label[r])
                        sides.append(side[r])
        yield from join(nodes, sets, known, sides)

    return arrow_map(rows.repartition(*places).sortWithinPartitions(*places), work, "a long, b long")


def _chunks(members: DataFrame, task_shingles: int) -> DataFrame:
    """``members`` (g, n, node, ..) with ``chunk``: its number in a deal of the group, ordered by n, into chunks of about so many shingles.

    A set's place among those of its size is chosen by a hash, so no group is sorted in one task.
    """
    sizes = members.groupBy("g", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy("g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("g").alias("g2"), F.col("n").alias("n2"), "c", F.coalesce(F.sum(F.col("n") * F.col("c")).over(before), F.lit(0)).alias("before"))
    placed = members.join(sizes, (F.col("g") == F.col("g2")) & (F.col("n") == F.col("n2")))
    at = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n") * F.col("c"))
    return placed.select(*members.columns, F.floor(at / task_shingles).alias("chunk"))


def _screened(rows: DataFrame, id_: Column, ids: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` with columns of a broadcast filter of hashed ``ids`` (id), and whether a row may have one of them.

    A row that has one always passes, about one other in 32 does as well. So texts of
    rows that take no part in a join by id are kept out of its shuffle, at some bytes an id.
    """
    wanted = max(ROW_BITS, FILTER_BITS * ids.count())
    bits = min(MOST_FILTER_BITS, 1 << (wanted - 1).bit_length())
    at, row, map_ = ("_" * (1 + max(map(len, rows.columns))) + x for x in ("at", "row", "map"))  # no columns of ``rows``
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    maps = ids.select(place(F.col("id")).alias(at)).groupBy(F.shiftright(at, 15).alias(row)).agg(F.bitmap_construct_agg(F.col(at) % ROW_BITS).alias(map_))
    found = rows.withColumn(at, place(id_)).join(F.broadcast(maps), F.shiftright(at, 15) == F.col(row), "left")
    byte = F.conv(F.hex(F.expr(f"substring({map_}, CAST({at} % {ROW_BITS} AS INT) DIV 8 + 1, 1)")), 16, 10).cast("int")
    return found, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, CAST({at} % 8 AS INT))")) != 0, F.lit(False))


def _having(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``rows`` whose id may be among ``ids`` (id), for a join."""
    found, may = _screened(rows, rows[id_col], ids)
    return found.where(may).select(*[rows[c] for c in rows.columns])


def _without(docs: DataFrame, id_col: str, gone: DataFrame, stay: DataFrame) -> DataFrame:
    """``docs`` whose id, null or one of ``stay`` (id), is not among ``gone`` (id); only texts of the lesser of the two are shuffled."""
    own = [docs[c] for c in docs.columns]
    id_ = docs[id_col].cast("long")
    if stay.count() < gone.count():
        some = _having(docs, id_col, stay)
        return docs.where(id_.isNull()).union(some.join(stay, some[id_col].cast("long") == stay["id"], "left_semi"))
    found, may = _screened(docs, id_, gone)
    clear, some = found.where(~may).select(*own), found.where(may).select(*own)
    return clear.union(some.join(gone, some[id_col].cast("long") == gone["id"], "left_anti"))


def _connected(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, task_shingles: int, root: str) -> tuple[DataFrame, DataFrame]:
    """(id, node, n) of every row, and (node, root) of the sets that links connect, by the smallest of them."""
    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = pair.where("id IS NOT NULL")
    table = written(_table(pair, width), root, "sets")
    near = components(_candidates(named, width, percent), root, "near")

    ids = table.where("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    members = written(near.join(ids, "node").select("node", F.col("root").alias("g"), "id", "n"), root, "members")
    total = members.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("size")).withColumn("chunks", F.floor((F.col("total") - 1) / task_shingles) + 1)
    total = written(total, root, "groups")
    texts = lambda m: _having(pair, "id", m.select("id")).join(m, "id")

    all_ = members.join(total, "g")
    whole = all_.where("chunks = 1").select("g", "node", "id", F.array(F.lit(0).cast("long")).alias("to"))
    large = written(_chunks(all_.where("chunks > 1"), task_shingles), root, "large")
    is_hub = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("size")) < HUBS
    dealt = large.select("g", "node", "id", F.when(is_hub, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk")).alias("to"))
    first = texts(written(whole.union(dealt), root, "first"))
    first = first.select(F.col("g").alias("task1"), F.explode("to").alias("task2"), "node", F.col("node").alias("known"), F.lit(0).alias("side"), "text")
    links = written(_linked(first, width, percent), root, "links")
    found = components(links, root, "found")

    if large.limit(1).count():
        spread = written(large.join(found, "node", "left").select("g", "node", "id", "n", "chunk", F.coalesce("root", "node").alias("root")), root, "spread")
        parts = spread.groupBy("g", "root").agg(F.count("*").alias("c"))
        main = written(parts.groupBy("g").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("g", F.col("most.root").alias("main")), root, "main")
        open_ = spread.join(main, "g")
        probes = written(_chunks(open_.where("root <> main").drop("chunk"), task_shingles).withColumnRenamed("chunk", "probe"), root, "probes")
        span = [F.min("n").alias("low"), F.max("n").alias("high")]
        left = probes.groupBy("g", "probe").agg(*span)
        right = open_.groupBy("g", "chunk").agg(*span).select(F.col("g").alias("g2"), "chunk", F.col("low").alias("low2"), F.col("high").alias("high2"))
        meet = (F.col("g") == F.col("g2")) & (100 * F.col("high") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low"))
        pairs = written(left.join(right, meet).select("g", "probe", "chunk"), root, "pairs")
        # every member with the tasks (probe, chunk) that it goes to, on the side of the probes, of the chunks or both
        as_probe = probes.join(pairs, ["g", "probe"]).select("g", "node", "id", "root", "probe", "chunk", F.lit(1).alias("side"))
        as_chunk = open_.join(pairs, ["g", "chunk"]).select("g", "node", "id", "root", "probe", "chunk", F.lit(0).alias("side"))
        tasks = as_probe.union(as_chunk).groupBy("g", "node", "id", "root", "probe", "chunk").agg(F.max("side").alias("side"))
        tasks = written(tasks.groupBy("g", "node", "id", "root").agg(F.collect_list(F.struct("probe", "chunk", "side")).alias("to")), root, "tasks")
        rest = texts(tasks).select("g", "node", "root", F.explode("to").alias("to"), "text")
        rest = rest.select(F.col("g").alias("task1"), F.col("to.probe").alias("task2"), F.col("to.chunk").alias("task3"), "node", F.col("root").alias("known"), F.col("to.side").alias("side"), "text")
        more = written(_linked(rest, width, percent), root, "more")
        # what ``rest`` knew as connected are links as well
        found = components(more.union(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), root, "all")
    return table, found


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES, root: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of ``docs``; component_id: the smallest id connected by links."""
    root = root or shared_dir(docs.sparkSession)
    table, found = _connected(docs, width, percent, id_col, text_col, task_shingles, root)
    ids = table.where("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    placed = written(ids.join(found, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), root, "placed")
    least = written(placed.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").select("root", "least"), root, "least")
    named_least = placed.join(least, "root", "left").select("node", F.coalesce("least", "id").alias("least"))
    done = table.where("node IS NOT NULL").join(named_least, "node", "left").select("id", "n", "least")
    done = done.union(table.where("node IS NULL").select("id", "n", F.lit(None).cast("long")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of every component one row stays, that with the smallest id.

    Rows are told apart by id and set of shingles, so rows that share an id but are
    not alike stay. Of a component's rows with the smallest id the one with the least
    set key stays, and of rows equal in both the least by text, then by all columns.
    Rows without id, and texts without a word, stay.
    """
    root = shared_dir(docs.sparkSession)
    table, found = _connected(docs, width, percent, id_col, text_col, task_shingles, root)
    rows = table.where("id IS NOT NULL AND node IS NOT NULL").select("id", "node").distinct()
    placed = written(rows.join(found, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")), root, "placed")
    firsts = written(placed.groupBy("root").agg(F.min(F.struct("id", "node")).alias("x")).select("x.id", "x.node"), root, "firsts")
    by_id = table.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows"), F.min("node").alias("node"))
    out = by_id.where("rows = 1 AND node IS NOT NULL").join(firsts, ["id", "node"], "left_anti").select("id")
    again = written(by_id.where("rows > 1").select("id"), root, "again")
    gone = written(out.union(again), root, "gone")
    stay = written(by_id.select("id").join(gone, "id", "left_anti"), root, "stay")
    kept = _without(docs, id_col, gone, stay)
    if not again.limit(1).count():
        return kept

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row")).join(again, "id", "left_semi")
    schema = StructType(list(packed.schema.fields)).add("node", "long")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch, 1), width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], names=schema.names)

    shared = arrow_map(packed, key, schema)
    least = F.min_by("row", F.struct(F.coalesce("text", F.lit("")), F.to_json("row")))
    ones = shared.where("node IS NOT NULL").join(firsts, ["id", "node"], "left_semi").groupBy("id", "node").agg(least.alias("row")).select("row")
    return kept.union(ones.union(shared.where("node IS NULL").select("row")).select("row.*"))
