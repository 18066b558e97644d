"""Main text of web pages by a site style tree.

``parse`` walks the tags of a page once and knows, for every block of text, the
branch it stands in: the tags and class names below ``body``.

The pages of a host, identical ones once, are merged to a style tree whose nodes
are branches of any depth that HTML parsers allow. A node's presentation
importance is the entropy of the child sequences seen there. Its content
importance is one less the mean quadratic entropy of the text blocks below it
over the pages: a block on k pages has 1 - 1/k, so blocks of one page count in
full, and blocks drawn from a small stock count little however large the stock
(by Shannon's entropy such blocks looked important). They are composed as
(1 - g^l) * presentation + g^l * content for l different child sequences, and
never to less than the content importance, so that a regular layout alone
doesn't condemn what differs from page to page. Branches below ``LEAST`` are
removed from each page, inside main content too; ``article`` and ``main``
themselves stay, and so does what is in them where a host's main content itself
repeats. A node on one page has content importance 1. If nothing would be left,
the tree removes nothing.

Elements whose role says that they are no article text (scripts, navigation,
forms; outside main content also class names, ids and ARIA roles made of such
words; inside it class names and roles of other blocks than headings) go as
well: reader comments differ on every page, which no tree can tell from the
article. Main content (``article`` and ``main``) is a page's text, unless it is
less than half of what is left: then it is a teaser, and all that is left stays.

Markup may be malformed: tags that are never closed end with the page, a quote
that doesn't close a value is a character of its tag, and noise within a line
(hidden spans, buttons, links to share) goes without the rest of its block.

Sums are partial by branch and block, so no host is ever in one task. Blocks
count for the branch they stand in, and only these sums, not the blocks, go to
the branches above. Pages of null url form a host of their own. Null and empty
html gives an empty text; pages of any length are parsed whole, in linear time.
Repeated rows give a text each, ties of importance with ``LEAST`` stay. An empty
table gives an empty result. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import Scratch

#: Nesting at which HTML parsers of browsers stop; what is deeper keeps its text and stands in its ancestor's branch.
NESTING = 512
GAMMA = 0.9
LEAST = 0.4
SALTS = 32
SLICE = 256
#: Up to so many removed branches of all hosts together (8 bytes each) are sent to all tasks; more are joined.
FEW_BRANCHES = 50_000

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NOISE_TAGS = frozenset("head nav aside footer form menu dialog button select option object audio video canvas map".split()) | RAW
#: Start tags that end an open element, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Words in class names, ids and roles that mark what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo related "
    "replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# Words that go with them in names and say nothing themselves.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons container form global group holder inner item items left link links list main message outer "
    "page panel post posts right row section site sticky thread top wrap wrapper".split()
)
#: Names inside main content that decide by id too: readers' comments differ on every page, which no tree can tell from the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())

# a quote opens a value only after =, and only if it ends where a value may; a stray one is a character like any other
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>]|\Z)|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")


def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) - (1 << 63)


def says_noise(names: str) -> bool:
    """Whether one of the names consists of a noise word and, it may be, layout words."""
    for name in names.split():
        words = _WORDS.findall(name)
        if not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in LAYOUT_WORDS for w in words):
            return True
    return False


class _Element:
    __slots__ = ("children", "main", "node", "noise", "own", "tag")

    def __init__(self, tag: str, up: _Element | None, classes: str, ids: str, hidden: bool, host: str, roles: bool):
        self.tag, self.children = tag, []
        in_main = up is not None and up.main
        self.main = in_main or tag in ("article", "main")
        noise = hidden or tag == "head"
        # an article within main content may be a reader's comment
        if roles and not noise and (in_main or tag not in ("article", "main")) and tag not in ("body", "html"):
            noise = tag in NOISE_TAGS or (tag == "header" and not in_main)
            if not noise and (classes or ids) and not (in_main and tag in HEADINGS):
                noise = says_noise(classes) or (says_noise(ids) and (not in_main or not COMMENT_WORDS.isdisjoint(_WORDS.findall(ids))))
        self.noise = noise or (up is not None and up.noise)
        # (key, node above, whether the tree may remove it, depth) of the branch it stands in, None for the body
        self.node, self.own = up.node if up is not None and tag != "body" else None, False
        if up is not None and tag in BLOCKS and tag != "body" and (self.node is None or self.node[3] < NESTING):
            above, self.own = self.node, True
            words = sorted({*_WORDS.findall(classes), *_WORDS.findall(ids)}) if classes or ids else ()
            path = f"{above[0] if above else host}/{tag}.{'.'.join(words)}"
            self.node = (_key(path), above, tag not in ("article", "main"), above[3] + 1 if above else 1)


def parse(page: str | None, host: str = "", roles: bool = True) -> tuple[list[tuple[str, bool, tuple | None]], list[tuple[int, int]], list[tuple[int, int]], dict[int, int]]:
    """(blocks, styles, contents, edges) of a page: its text blocks that aren't noise, with whether they are main content
    and their node; (branch, child sequence) and (nearest branch, block) hashes of the whole style tree; the branch
    above each branch, 0 for the body. Keys of branches are those of ``host``. Without ``roles`` nothing but scripts and
    the like is noise."""
    blocks, styles, contents, edges = [], [], [], {}
    stack = [_Element("html", None, "", "", False, host, roles)]
    held: list[str] = []
    open_ = Counter()  # saves the search of the stack for what isn't there

    # where the text of noise within a line begins in held, and the element that it began with
    muted: list[tuple[int, _Element]] = []

    def flush() -> None:
        e = stack[-1]
        if muted:
            e = next(stack[i - 1] for i in range(len(stack) - 1, 0, -1) if stack[i] is muted[0][1])
            del held[muted[0][0] :]
            muted[0] = (0, muted[0][1])
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            if e.node:
                contents.append((e.node[0], _key(text)))
            if not e.noise:
                blocks.append((text, e.main, e.node))

    def close(upto: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            open_[e.tag] -= 1
            if muted and muted[0][1] is e:
                del held[muted.pop()[0] :]
            if e.own:
                styles.append((e.node[0], _key(">".join(e.children))))
                edges[e.node[0]] = e.node[1][0] if e.node[1] else 0

    pos, page = 0, page or ""
    while True:
        m = _TOKEN.search(page, pos)
        held.append(page[pos : m.start() if m else len(page)])
        if m is None:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if tag == "br":
            held.append(" ")
        elif m[1]:
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if open_[tag] else 0
            if at:
                close(at)
        else:
            ends, bounds = ENDS.get(tag, ({"p"}, {"button", "td", "th", "table"}) if tag in BLOCKS else ((), ()))
            if any(open_[t] for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in bounds:
                        break
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag in ("html", "body") and open_[tag]:
                continue
            if tag in BLOCKS and stack[-1].tag == "head":
                close(len(stack) - 1)
            names = _NAMES.findall(m[3]) if m[3] else ()
            classes, ids = (" ".join(a or b or c for k, a, b, c in names if (k.lower() == "id") == is_id).lower() for is_id in (False, True))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
                stop = page.find(">", end.start()) if end else -1
                pos = stop + 1 if stop >= 0 else len(page)
                continue
            siblings = stack[-1].children
            if tag in BLOCKS and (not siblings or siblings[-1] != tag):
                siblings.append(tag)
            open_[tag] += 1
            e = _Element(tag, stack[-1], classes, ids, bool(m[3]) and _HIDDEN.search(m[3]) is not None, host, roles)
            if e.noise and not stack[-1].noise and tag not in BLOCKS:
                muted[:] = [(len(held), e)]
            stack.append(e)
    flush()
    close(0)
    return blocks, styles, contents, edges


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as pages are long."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def pack_page(styles: list[tuple[int, int]], contents: list[tuple[int, int]], edges: dict[int, int]) -> bytes:
    """The tree of a page in few bytes: each branch's key once, the others as places."""
    places = {k: i for i, k in enumerate(edges)}
    styles, contents = sorted(set(styles)), sorted(set(contents))
    at = lambda keys: np.array([places.get(k, -1) for k in keys], np.int32)
    parts = [np.array([len(edges), len(styles), len(contents)], np.int32), np.array(list(edges), np.int64), at(edges.values())]
    for rows in (styles, contents):
        parts += [at(k for k, _ in rows), np.array([v for _, v in rows], np.int64)]
    return b"".join(x.tobytes() for x in parts)


def unpack_page(data: bytes) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(branches, kind, values): kind 0 child sequences, 1 blocks, 2 the branches of the page, 3 the branches above one with blocks, itself included."""
    n, n_styles, n_contents = (int(x) for x in np.frombuffer(data, np.int32, 3))
    pos = 12

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal pos
        out = np.frombuffer(data, kind, count, pos)
        pos += out.nbytes
        return out

    keys, above = take(np.int64, n), take(np.int32, n)
    at = take(np.int32, n_styles)
    yield keys[at], 0, take(np.int64, n_styles)
    at = take(np.int32, n_contents)
    yield keys[at], 1, take(np.int64, n_contents)
    yield keys, 2, np.zeros(n, np.int64)
    for leaf in np.unique(at).tolist():
        chain = []
        k = leaf
        while k >= 0:
            chain.append(k)
            k = int(above[k])
        yield np.repeat(keys[leaf], len(chain)), 3, keys[chain]


def site_style_tree(pages: DataFrame) -> DataFrame:
    """``branch, n_pages, importance`` of the merged pages of each host; a branch's key is that of one host."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = list(zip(b.column("host").to_pylist(), (x or "" for x in b.column("html").to_pylist()), strict=True))
            packed = [pack_page(*parse(page, host)[1:]) for host, page in rows]
            ids = [xxhash.xxh3_128_digest(f"{host} {page}") for host, page in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(packed, pa.binary())], ["page", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            kinds = np.repeat(np.array([k for _, k, _ in parts], np.int8), [len(v) for _, _, v in parts])
            columns = [np.concatenate([x[i] for x in parts]) for i in (0, 2)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(kinds), pa.array(columns[1])], ["branch", "kind", "value"])

        for b in _slices(batches):
            parts, held = [], 0
            for data in b.column("packed").to_pylist():
                for part in unpack_page(data):
                    parts.append(part)
                    held += len(part[2])
                    if held > 1 << 16:
                        yield out(parts)
                        parts, held = [], 0
            if parts:
                yield out(parts)

    packed = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(pack, "page binary, packed binary")
    # copies of a page count once, so that they don't lower the importance of their own content
    once = packed.groupBy("page").agg(F.first("packed").alias("packed")).select("packed")
    counted = once.mapInArrow(unpack, "branch long, kind byte, value long").groupBy("branch", "kind", "value").agg(F.count("*").alias("n"))
    n, of = F.col("n").cast("double"), lambda kind, x: F.when(F.col("kind") == kind, x)
    sums = counted.groupBy("branch").agg(
        F.coalesce(F.sum(of(2, F.col("n"))), F.lit(0)).alias("n_pages"),
        F.count(of(0, F.lit(1))).alias("n_styles"), F.sum(of(0, n)).alias("seen"), F.sum(of(0, n * F.log(n))).alias("seen_log"),
        F.count(of(1, F.lit(1))).alias("own_blocks"), F.sum(of(1, F.col("n"))).alias("own_places"), F.collect_set(of(3, F.col("value"))).alias("above"),
    )
    sums = Scratch(pages.sparkSession, "html-tree").save(sums, "branches")
    # sums of the blocks that stand in a branch itself, then of all below it; their mean quadratic entropy is 1 - blocks / places
    below = sums.filter("own_blocks > 0").select(F.explode("above").alias("branch"), "own_blocks", "own_places")
    below = below.groupBy("branch").agg(F.sum("own_blocks").alias("n_blocks"), F.sum("own_places").alias("n_places"))
    sums = sums.select("branch", "n_pages", "n_styles", "seen", "seen_log").join(below, "branch", "left")
    log_pages = F.log(F.greatest(F.col("n_pages"), F.lit(2)).cast("double"))
    presentation = (F.log("seen") - F.col("seen_log") / F.col("seen")) / log_pages
    content = F.coalesce(F.col("n_blocks") / F.col("n_places"), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.col("n_styles").cast("double"))
    importance = F.greatest(content, (1 - weight) * presentation + weight * content)
    return sums.select("branch", "n_pages", importance.alias("importance"))


def keep_blocks(blocks: list[tuple[str, bool, int]], nodes: list[tuple[int, int, bool]], low: set[int] | frozenset[int]) -> str:
    """Text of a page from its blocks (text, main, place of its node), its nodes (key, place of the node above, whether
    the tree may remove it) and the keys that the tree removes. Main content is the page's text unless other branches of the site say more."""
    gone, held = [], []  # held: in main content that itself repeats
    for key, above, open_ in nodes:  # what is above comes first
        held.append((above >= 0 and held[above]) or (not open_ and key in low))
        gone.append(open_ and not held[-1] and (key in low or (above >= 0 and gone[above])))
    left = [(t, m) for t, m, k in blocks if k < 0 or not gone[k]] or [(t, m) for t, m, _ in blocks]
    main = [t for t, m in left if m]
    if main and 2 * sum(map(len, main)) >= sum(len(t) for t, _ in left):
        return "\n\n".join(main)
    return "\n\n".join(t for t, _ in left)


def _nodes_of(blocks: list[tuple[str, bool, tuple | None]]) -> tuple[list[tuple[str, bool, int]], list[tuple[int, int, bool]]]:
    """Blocks with the place of their node, and nodes as (key, place of the node above, whether the tree may remove it)."""
    places: dict[int, int] = {}
    nodes: list[tuple[int, int, bool]] = []
    out = []
    for text, main, node in blocks:
        chain = []
        while node is not None and node[0] not in places:
            chain.append(node)
            node = node[1]
        at = places[node[0]] if node is not None else -1
        for x in reversed(chain):
            nodes.append((x[0], at, x[2]))
            at = places[x[0]] = len(nodes) - 1
        out.append((text, main, at))
    return out, nodes


def extract_text(pages: DataFrame, roles: bool = True, few_branches: int = FEW_BRANCHES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    scratch = Scratch(pages.sparkSession, "html")
    low = scratch.save(site_style_tree(pages).filter(F.col("importance") < LEAST).select("branch"), "low")
    id_kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), "html")
    known = low.limit(few_branches + 1).toArrow().column(0).to_numpy()
    if len(known) <= few_branches:
        texts = _judge_known(rows, id_kind, known, roles)
    else:
        texts = _judge_joined(rows, id_kind, low, scratch, roles)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _judge_known(rows: DataFrame, id_kind: str, low: np.ndarray, roles: bool) -> DataFrame:
    """Texts where all removed branches are known to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = frozenset(low.tolist())
        for b in _slices(batches):
            found = zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)
            texts = [keep_blocks(*_nodes_of(parse(page, host_, roles)[0]), keys) for page, host_ in found]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {id_kind}, url string, text string")


def _judge_joined(rows: DataFrame, id_kind: str, low: DataFrame, scratch: Scratch, roles: bool) -> DataFrame:
    """Texts where each page asks for its removed branches by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            data, asked = [], []
            for page, host_ in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True):
                blocks, nodes = _nodes_of(parse(page, host_, roles)[0])
                data.append(zlib.compress(pickle.dumps((blocks, nodes)), 1))
                asked.append([k for k, _, _ in nodes])
            columns = [b.column("page_id"), b.column("url"), pa.array(data, pa.binary()), pa.array(asked, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "data", "asked"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = zip(b.column("data").to_pylist(), b.column("removed").to_pylist(), strict=True)
            texts = [keep_blocks(*pickle.loads(zlib.decompress(data)), set(low or ())) for data, low in found]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    parsed = rows.mapInArrow(run, f"page_id {id_kind}, url string, data binary, asked array<bigint>")
    parsed = scratch.save(parsed.withColumn("row", F.monotonically_increasing_id()), "blocks")
    # a branch that all pages of a large host have is asked for in SALTS parts
    asked = parsed.select("row", F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"), F.explode("asked").alias("branch"))
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    removed = asked.join(salted, ["branch", "salt"]).groupBy("row").agg(F.collect_set("branch").alias("removed"))
    judged = parsed.join(removed, "row", "left").select("page_id", "url", "data", "removed")
    return judged.mapInArrow(judge, f"page_id {id_kind}, url string, text string")
