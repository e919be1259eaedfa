"""HTML extraction with wrappers inferred per host, as regular expressions without unions.

A page is a stream of tokens: tags and runs of text. A tag and what it holds is a
group, which is one token of the stream around it and a stream itself. Kinds of tokens
that recur in a stream are a repeated group: from the first to the last of them the
stream is ``(kind kind ..)+``, and their contents are one stream. Pages of a host are
aligned stream by stream along longest common subsequences: texts that differ become
slots, tokens that only one side has become optional (their count stays below that of
the group around them). Folding all structures of a host gives its wrapper.

The same pages give the same wrapper, however they are dealt: tasks count each
structure of a host (counts, least and greatest digests and sizes of its texts, which
add up in any order); structures are then folded in order of their digests, first
those with the same beginning of the digest, then these parts in order. A host with
most of the pages so takes no single task, nor memory beyond its structures.

A page is then aligned with its host's wrapper. What a block weighs is the size of the
slots in its place over all pages of the host; constants weigh nothing. Where no text
of the host differs (one page, or copies of one), its own text weighs.

- The article is what the page's tags propose (all outermost ``article``, else main
  content) if that holds at least half of the weight outside of menus, forms and the
  like; else, from the top, the block that holds four fifths of the weight of the one
  around it, and so on down to blocks of text. Of proposals some of which weigh
  something, those that weigh nothing are no article.
- Nothing of the article is left out but elements that are no text of it (``aside``,
  ``nav``, ``form``, scripts ..) and blocks that a class, id or role names such: one of
  ``ASIDE``, alone or with words that only say where or what kind of block (``ad``,
  ``sidebar-left``, ``related-posts``, but not ``related-work``). If nothing is left,
  only elements count, on the whole page.

Defined results: null or empty html gives the empty text; a null url is a host of
its own; repeated rows are extracted one by one; unknown entities stay as written.
Pages of any size and depth are taken whole; other columns, whatever their names,
take no part.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm._batches import arrow_map, texts_of
from plumbline.llm._shared import shared_dir, written
from plumbline.llm.alignment import common

#: Wrappers up to this size in all are broadcast; beyond, pages are joined with them.
BROADCAST_BYTES = 8_000_000
#: Parts in which a host's structures are folded, and shares in which its pages are joined with its wrapper.
PARTS, SHARES = 64, 32
#: Structures that a task holds before it sends them on.
HELD = 2000

# Element names of the HTML standard by their roles here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside button footer form head iframe nav noscript object script select style svg template textarea title video audio canvas dialog".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg"
#: Blocks of text, which are not searched for the article; tables are, as far as a cell of theirs holds blocks.
TEXTUAL = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre ul".split())
TABLE = frozenset("table tbody td tfoot th thead tr".split())
_SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul blockquote".split())
#: A start tag closes open elements of the first kinds that are inside the innermost open one of the second kinds.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th"}), frozenset({"table", "tr"})),
}

_TOKEN = re.compile(
    rf"<(?:!--|(?P<raw>{RAW})\b[^>]*>).*?(?:(?P<closed>(?(raw)</(?P=raw)\s*>|-->))|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)|[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^<]*\Z")
_MARK = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
# Words in classes, ids and roles that name what is not the article.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs toolbar footer header masthead topbar comment comments commentlist respond replies disqus discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget widgets complementary contentinfo skip".split()
)
#: Such words mark the article instead.
MAIN = frozenset("article articlebody post entry story main content maincontent".split())
#: Words that only say where or what kind of block.
GENERIC = frozenset("area bar block body box bottom btn button buttons container group inner items left links list outer page panel posts articles right row section site slot top unit wrap wrapper".split())
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)")
_LIKE_ARTICLE = frozenset({"article", "main"})
#: Such words say that an ``article`` is none.
NO_ARTICLE = frozenset("ad ads advert advertisement comment comments related".split())


class Block:
    """A tag that breaks lines and what it holds: ``parts`` are blocks and runs of inline text (entities decoded) in order."""

    __slots__ = ("aside", "holds", "inside", "key", "marks", "name", "parent", "parts", "weight")

    def __init__(self, name: str, marks: tuple[str, ...], key: str, parent: Block | None):
        self.name, self.marks, self.key, self.parent = name, marks, key, parent
        self.parts: list[Block | str] = []
        self.weight: int = 0  # of what is in it and not aside


def _tag(name: str, rest: str) -> tuple[tuple[str, ...], str]:
    """The classes, ids and roles of a tag, and the kind of its tokens (digits left out: they number items)."""
    if "=" not in rest:
        return (), name
    marks = tuple(w for m in _MARK.finditer(rest) for w in (m[2] or m[3] or m[4] or "").lower().split())
    kind = sorted({"-".join(_WORDS.findall(w)) for w in marks})
    return marks, f"{name}.{'.'.join(kind)}" if marks else name


def names_one_of(marks: tuple[str, ...], words: frozenset[str]) -> bool:
    """Whether one of ``marks`` is made of ``words``, and apart from them of words that only say where or what kind of block."""
    for mark in marks:
        parts = _WORDS.findall(mark)
        if any(p in words for p in parts) and all(p in words or p in GENERIC for p in parts):
            return True
    return False


def parse(page: str) -> list[Block]:
    """The page's blocks, the root first, each before those it holds."""
    blocks = [Block("", (), "", None)]
    stack: list[tuple[str, Block]] = [("", blocks[0])]  # open elements that break lines
    opened: dict[str, list[int]] = {}  # the places in the stack of each name
    scopes: list[int] = []  # the places in the stack that an open p does not reach beyond
    run: list[str] = []

    def close_run() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1][1].parts.append(text)

    def pop_to(at: int) -> None:
        close_run()
        while len(stack) > at:
            opened[stack.pop()[0]].pop()
        while scopes and scopes[-1] >= at:
            scopes.pop()

    def last(names: frozenset[str]) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    at, end, cut = 0, page.rfind(">") + 1, False  # behind the last > there is no tag, and no search for its end
    for m in _TOKEN.finditer(page, 0, end):
        run.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            run.append(" " if m["raw"] else "")
            cut = at == end and m["closed"] is None and (m["raw"] or m[0].startswith("<!--"))
        elif name in INLINE:
            run.append(" " if name == "br" else "")
        elif name in VOID:
            close_run()
        elif m["end"]:
            if opened.get(name):
                pop_to(opened[name][-1])
            else:
                close_run()
        else:
            if opened.get("p") and opened["p"][-1] > (scopes[-1] if scopes else 0):
                pop_to(opened["p"][bisect_right(opened["p"], scopes[-1] if scopes else 0)])
            if name in CLOSES:
                names, scope = CLOSES[name]
                floor = last(scope)
                inside = [opened[x][k] for x in names if opened.get(x) and (k := bisect_right(opened[x], floor)) < len(opened[x])]
                if inside:
                    pop_to(min(inside))
            close_run()
            marks, key = _tag(name, m["rest"])
            block = Block(name, marks, key, stack[-1][1])
            block.parent.parts.append(block)
            blocks.append(block)
            opened.setdefault(name, []).append(len(stack))
            if name in _SCOPE:
                scopes.append(len(stack))
            stack.append((name, block))
    if not cut:  # an unclosed script or comment goes on to the end; a tag that the end cuts off is no text
        run.append(_CUT_TAG.sub("", page[at:]))
    close_run()
    for b in blocks:
        b.holds = 0
    for b in reversed(blocks):
        if b.parent is not None:
            b.parent.holds += b.holds + (b.name in _LIKE_ARTICLE and not names_one_of(b.marks, NO_ARTICLE))
    return blocks


class Token:
    """A token of a wrapper: a kind of group with its stream, or of text (kind ``#``), with what is known of it from ``pages`` pages."""

    __slots__ = ("chars", "high", "kind", "low", "pages", "repeated", "stream", "weight")

    def __init__(self, kind: str, pages: int = 1, repeated: bool = False, low: str = "", high: str = "", chars: int = 0):
        self.kind, self.pages, self.repeated = kind, pages, repeated
        self.low, self.high, self.chars = low, high, chars  # the least and greatest digest of the texts, and their size
        self.stream: list[Token] = []


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=9).hexdigest()


def streams(parts: list[Block | str]) -> list[tuple[str, bool, list[Block | str]]]:
    """(kind, whether in a repeated group, the parts) of a stream in order: each kind once, recurring ones as repeated groups."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    found: dict[str, list[Block | str]] = {}
    for i, p in enumerate(parts):
        kind = "#" if isinstance(p, str) else p.key
        first.setdefault(kind, i)
        last[kind] = i
        found.setdefault(kind, []).append(p)
    out, reach = [], -1
    for kind in found:  # in order of first occurrence
        if last[kind] > first[kind]:
            reach = max(reach, last[kind])
        out.append((kind, first[kind] <= reach, found[kind]))
    return out


def own_wrapper(blocks: list[Block]) -> Token:
    """The wrapper of one page."""
    top = Token("")
    stack: list[tuple[Token, list[Block | str]]] = [(top, blocks[0].parts)]
    while stack:
        token, parts = stack.pop()
        for kind, repeated, some in streams(parts):
            if kind == "#":
                value = digest("\n".join(some))
                token.stream.append(Token(kind, 1, repeated, value, value, sum(map(len, some))))
            else:
                child = Token(kind, 1, repeated)
                token.stream.append(child)
                stack.append((child, [p for b in some for p in b.parts]))
    return top


def merge(a: Token, b: Token) -> None:
    """Makes ``a`` the wrapper of both sides' pages."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        a.repeated |= b.repeated
        a.pages += b.pages
        a.chars += b.chars
        if a.kind == "#":
            a.low, a.high = min(a.low, b.low), max(a.high, b.high)
        out, i, j = [], 0, 0
        pairs = common([t.kind for t in a.stream], [t.kind for t in b.stream])
        for x, y in [*pairs, (len(a.stream), len(b.stream))]:
            out += a.stream[i:x] + b.stream[j:y]
            if x < len(a.stream):
                out.append(a.stream[x])
                stack.append((a.stream[x], b.stream[y]))
            i, j = x + 1, y + 1
        a.stream = out


def flat(top: Token, counts: bool = True) -> str:
    """The wrapper as JSON, a row for each token with its depth; without ``counts``: its structure alone."""
    out, stack = [], [(top, 0)]
    while stack:
        t, depth = stack.pop()
        out.append([depth, t.kind, t.repeated, *([t.pages, t.low, t.high, t.chars] if counts else [])])
        stack += [(c, depth + 1) for c in reversed(t.stream)]
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> Token:
    path: list[Token] = []
    for depth, kind, repeated, pages, low, high, chars in json.loads(text):
        t = Token(kind, pages, repeated, low, high, chars)
        del path[depth:]
        if path:
            path[-1].stream.append(t)
        path.append(t)
    return path[0]


def weighed(top: Token) -> Token:
    """``top`` with the weights of its tokens: the size of the slots in them."""
    order, stack = [], [top]
    while stack:
        t = stack.pop()
        order.append(t)
        stack += t.stream
    for t in reversed(order):
        t.weight = sum(c.weight for c in t.stream) + (t.chars if t.kind == "#" and t.low != t.high else 0)
    return top


def _is_aside(b: Block, by_marks: bool, articles: int) -> bool:
    """Whether a block is none of the article's; ``articles``: how many ``article`` and ``main`` the page has."""
    if b.name in ("", "html", "body", "main") or b.holds and b.holds == articles:
        return False  # what holds them all is around the article
    if b.name in DROPPED:
        return True
    if not by_marks:
        return False
    if b.name == "article":
        return names_one_of(b.marks, NO_ARTICLE)
    if b.name == "header" or names_one_of(b.marks, frozenset({"header"})):
        return not b.inside
    return names_one_of(b.marks, ASIDE)


def weigh(blocks: list[Block], wrapper: Token | None, by_marks: bool = True) -> bool:
    """Notes in the page's blocks what is aside, and what the rest weighs; whether the host's slots told the weights."""
    for b in blocks:
        b.inside = b.parent is not None and (b.parent.inside or b.parent.name == "article")
        b.aside = b.parent is not None and b.parent.aside or _is_aside(b, by_marks, blocks[0].holds)
        b.weight = 0
    if wrapper is not None and wrapper.weight:
        stack: list[tuple[Token, list[Block | str], list[Block]]] = [(wrapper, blocks[0].parts, [blocks[0]])]
        while stack:
            token, parts, holders = stack.pop()
            groups = streams(parts)
            for x, y in common([g[0] for g in groups], [t.kind for t in token.stream]):
                other = token.stream[y]
                if groups[x][0] != "#":
                    some = groups[x][2]
                    stack.append((other, [p for b in some for p in b.parts], some))
                elif other.weight:
                    own = [(b, sum(len(p) for p in b.parts if isinstance(p, str))) for b in holders if not b.aside]
                    total = sum(n for _, n in own)
                    for b, n in own:  # a slot's weight goes to the page's blocks by what each has of the text
                        b.weight += other.weight * n // max(1, total)
    told = any(b.weight for b in blocks)
    if not told:
        for b in blocks:
            b.weight = 0 if b.aside else sum(len(p) for p in b.parts if isinstance(p, str))
    for b in reversed(blocks):
        if b.parent is not None:
            b.parent.weight += b.weight
    return told


def _proposed(blocks: list[Block]) -> list[Block]:
    """The outermost blocks that tags or marks say are the article."""
    for test in (lambda b: b.name == "article", lambda b: b.name == "main" or "articlebody" in b.marks, lambda b: b.name not in TEXTUAL | TABLE and b.name not in ("html", "body") and names_one_of(b.marks, MAIN)):
        found: list[Block] = []
        within: set[int] = set()
        for b in blocks:
            if id(b.parent) in within:
                within.add(id(b))
            elif not b.aside and test(b):
                within.add(id(b))
                if texts(b):
                    found.append(b)
        if found:
            return found
    return []


def article(blocks: list[Block], told: bool) -> list[Block]:
    """The blocks that hold the article; ``told``: by slots of the host, not by this page alone."""
    top = blocks[0]
    proposed = _proposed(blocks)
    heavy = [b for b in proposed if b.weight] or proposed
    if heavy and (not told or 2 * sum(b.weight for b in heavy) >= top.weight):
        return heavy
    block = found = top
    while True:
        inner = [p for p in block.parts if not isinstance(p, str) and not p.aside and p.name not in TEXTUAL]
        most = max(inner, key=lambda b: b.weight, default=None)
        if most is None or not most.weight or 5 * most.weight < 4 * block.weight:
            return [found]
        block = most
        if block.name not in TABLE or block.name == "td" and any(not isinstance(p, str) for p in block.parts):
            found = block


def texts(block: Block) -> list[str]:
    """The block's texts in page order, without what is aside."""
    out: list[str] = []
    stack: list[Block | str] = [block]
    while stack:
        p = stack.pop()
        if isinstance(p, str):
            out.append(p)
        elif not p.aside:
            stack += reversed(p.parts)
    return out


def main_text(page: str, wrapper: Token | None = None) -> str:
    blocks = parse(page)
    told = weigh(blocks, wrapper)
    found = [t for b in article(blocks, told) for t in texts(b)]
    if not found:
        weigh(blocks, wrapper, by_marks=False)
        found = texts(blocks[0])
    return "\n".join(found)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CASE = str.maketrans(_UPPER, _LOWER)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].translate(_CASE) if m else ""


_KIND = "host string, part int, digest string, wrapper string"


def _batch(rows: list[tuple[str, int, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["host", "part", "digest", "wrapper"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The structures of pages (url, html), counted."""
    found: dict[tuple[str, str], Token] = {}

    def rows() -> pa.RecordBatch:
        return _batch([(host, int(d[:4], 16) % PARTS, d, flat(t)) for (host, d), t in found.items()])

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
            if page:
                own = own_wrapper(parse(page))
                key = host_of(url), digest(flat(own, counts=False))
                if key in found:
                    merge(found[key], own)
                else:
                    found[key] = own
                    if len(found) >= HELD:
                        yield rows()
                        found.clear()
    if found:
        yield rows()


def _fold(batches: Iterator[pa.RecordBatch], parts: bool) -> Iterator[pa.RecordBatch]:
    """The wrappers of sorted rows of one host, or, with ``parts``, of one part of a host."""
    key, whole = None, None
    for batch in batches:
        for host, part, _, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            t = unflat(w)
            if (host, part if parts else 0) != key:
                if whole is not None:
                    yield _batch([(*key, "", flat(whole))])
                key, whole = (host, part if parts else 0), t
            else:
                merge(whole, t)
    if whole is not None:
        yield _batch([(*key, "", flat(whole))])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (host, part, digest) with those of one structure added up."""
    key, whole = None, None
    for batch in batches:
        for host, part, d, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (host, part, d) == key:
                merge(whole, unflat(w))
            else:
                if whole is not None:
                    yield _batch([(*key, flat(whole))])
                key, whole = (host, part, d), unflat(w)
    if whole is not None:
        yield _batch([(*key, flat(whole))])


def infer(pages: DataFrame, root: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) of all pages."""

    def fold_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold(_sum(batches), True)  # structures of one digest first, then in order of digests

    def fold_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold(batches, False)

    counted = arrow_map(pages.select(url_col, html_col), _read, _KIND)
    order = ["host", "part", "digest"]
    folded = arrow_map(counted.repartition("host", "part").sortWithinPartitions(*order), fold_parts, _KIND)
    hosts = arrow_map(folded.repartition("host").sortWithinPartitions("host", "part"), fold_hosts, _KIND)
    return written(hosts.select("host", "wrapper"), root, "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars), one row for each row of ``pages``."""
    spark = pages.sparkSession
    wrappers = infer(pages, shared_dir(spark), url_col, html_col)
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = StructType([rows.schema[0]]).add("url", "string").add("text", "string").add("n_chars", "long")
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0

    def result(batch: pa.RecordBatch, found: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=schema.names)

    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[str, Token | None] = {}
            for batch in batches:
                found = []
                for url, page in zip(batch.column(1).to_pylist(), texts_of(batch, 2), strict=True):
                    host = host_of(url)
                    if host not in ready:
                        ready[host] = weighed(unflat(known.value[host])) if host in known.value else None
                    found.append(main_text(page, ready[host]))
                yield result(batch, found)

        return arrow_map(rows, work, schema)

    # Too many wrappers to broadcast: a host's pages, in shares, and a copy of its wrapper for each share meet in a partition, the wrapper first.
    share = F.pmod(F.xxhash64("url", "html"), F.lit(SHARES)).cast("int")
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1), _UPPER, _LOWER)
    page_rows = rows.select(*[F.col(c) for c in rows.columns], host.alias("_host"), share.alias("_share"), F.lit(None).cast("string").alias("_wrapper"))
    for_shares = wrappers.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema],
        F.col("host").alias("_host"),
        F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"),
        F.col("wrapper").alias("_wrapper"),
    )
    both = page_rows.union(for_shares).repartition("_host", "_share").sortWithinPartitions("_host", "_share", F.col("_wrapper").isNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, None
        for batch in batches:
            found, at = [], []
            for k, (page, h, w) in enumerate(zip(texts_of(batch, 2), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if w is not None:
                    host, wrapper = h, weighed(unflat(w))
                else:
                    at.append(k)
                    found.append(main_text(page, wrapper if h == host else None))
            yield result(batch.take(pa.array(at, pa.int64())), found)

    return arrow_map(both, meet, schema)
