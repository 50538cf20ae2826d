"""Main text of web pages by a site style tree.

The pages of one host are merged by style: a style node is the path of tags and classes from the root. For
every style node the tree counts its pages m, on how many of them each text stands there, and how many show
each presentation (the styles of the blocks in it). A text on k pages has importance 1 - log k / log m: 1 for
a text of one page, 0 for one on every page. A node's presentation importance is the entropy of its
presentations over log m. A branch has the importance of its texts, weighted by length, and of its
presentation: g^l and 1 - g^l for l presentations (g = 0.9). Branches of low importance are removed from each
page. m counts `SPARSE` pages more than there are, which shrinks what few pages say towards "important", so
that hosts of any size are treated alike.

Some elements say themselves what they are and have no importance whatever they hold: menus, footers, forms,
scripts and so on by tag or role, adverts, notices, comments and so on by a whole class or id name; page heads
count only inside an article or main. What is
left is searched for the article: its `article` elements, or `main`, or the page. Inside an article or main
only containers may be of low importance, and none with most of the text. Pages of the same article text count
as one page of the tree, so that an article that many pages repeat stays whole.

Counts are partial sums by (style node, text), so a host with a third of all pages is no single task and
nobody gathers a host's list. Texts of importance below `COMMON` stand on more than m^0.4 pages, so a host of
m pages with b blocks each has at most b m^0.6 of them: the tree is broadcast to workers, once each, up to
`BROADCAST_KEYS` rows, counted first. A larger one is joined by key, and pages get the rows that they ask for.

Edge cases: null or empty html gives an empty text; broken markup is read as far as it goes (unclosed
elements end with their parent, an unclosed comment or script ends the page; elements deeper than `DEPTH`
count as their ancestor); a null or odd url counts as the host ""; a page of which nothing would stay keeps
its texts; repeated rows are extracted one by one; an empty table gives no rows. Input columns are kept;
`text` and `n_chars` replace columns of that name, `h_`, `mark_` and `own_` are taken.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, stored, tidied

THRESHOLD = 0.4
COMMON = 0.6
GAMMA = 0.9
SPARSE = 4
DEPTH = 100
BROADCAST_KEYS = 1_000_000
PLAIN, GONE, HEAD, NAMED = range(4)

# Fixed values of the HTML standard and of common page markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SCOPE = set("article aside body button div footer form header html main nav section table td th caption blockquote figure".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
DROP_TAGS = set("head nav footer aside form script style noscript template iframe textarea title svg button select input dialog menu".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BRANCHES = set("div section ul ol dl table".split())
# Names of boilerplate: whole class or id names, and nouns that end compound names unless a word of state stands before.
NAMES = set(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-unit sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "masthead footer sidebar sidebars widget widgets cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription "
    "share sharing share-buttons social social-links comment comments commentlist respond replies disqus disqus-thread related recommended recommendations pagination pager login signup search toolbar topbar".split()
)
NOUNS = set("ad ads advert adverts advertisement nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget widgets banner cookies consent notice popup modal newsletter comments pagination".split())
HEADS = set("header site-header page-header main-header banner site-banner top-bar".split())
STATES = set("no not non has have with without hide hidden show is".split())

TOKEN = re.compile(r"""<!--(?:.*?--!?>|[\s\S]*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^<>])*+)>""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?""")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "style", "kind", "items", "up", "parent")

    def __init__(self, tag: str, style: str, kind: int, up: Node | None):
        self.tag, self.style, self.kind, self.items, self.up = tag, style, kind, [], up
        self.parent = False  # of other blocks


def _named(names: list[str]) -> bool:
    """Whether a whole name, or the noun a compound name ends with, says that this is boilerplate."""
    for name in names:
        if name in NAMES:
            return True
        parts = name.split("-")
        if len(parts) > 1 and parts[-1] in NOUNS and not any(p in STATES for p in parts):
            return True
    return False


def _kind(tag: str, raw: str) -> tuple[str, int]:
    """Style of an element, and what it says of itself."""
    if not raw or raw.isspace():
        return tag, GONE if tag in DROP_TAGS else HEAD if tag == "header" else PLAIN
    attrs = {}
    for name, a, b, c in ATTR.findall(raw):
        attrs.setdefault(name.lower(), html.unescape(a or b or c))
    classes = attrs.get("class", "").lower().replace("_", "-").split()
    style = tag + "".join("." + w for w in sorted({DIGITS.sub("", c) for c in classes} - {""}))
    hidden = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if tag in DROP_TAGS or hidden or attrs.get("role", "").lower() in DROP_ROLES:
        return style, GONE
    names = [] if tag in ("html", "body", "main") else [*classes, *attrs.get("id", "").lower().replace("_", "-").split()]
    return style, NAMED if _named(names) else HEAD if tag == "header" or HEADS & set(names) else PLAIN


def parse(page: str) -> Node:
    """The page's tree: nodes, and texts as strings."""
    root = Node("#root", "", PLAIN, None)
    top, at, size = root, 0, len(page)
    known: dict[tuple[str, str], tuple[str, int]] = {}
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            top.items.append(page[at:])
            break
        if m.start() > at:
            top.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            x = top
            while x is not root and x.tag != tag:
                if x.tag in SCOPE and tag not in SCOPE and tag not in ("p", "li", "ul", "ol", "dl", "table", "tr", "thead", "tbody"):
                    x = root  # an inline end tag doesn't close a container
                    break
                x = x.up
            if x is not root:
                top = x.up
            elif tag == "p":
                top.items.append(Node("p", "p", PLAIN, top))
            continue
        raw = m[3]
        if tag in BLOCK and tag != "html" and tag != "body":
            shut = CLOSES.get(tag, ()) if tag in CLOSES else ("p",)
            x = top
            while x is not root:
                if x.tag == "p" or x.tag in shut:
                    top = x.up
                    if x.tag in shut and x.tag != "p":
                        x = x.up
                        continue
                elif x.tag in SCOPE or x.tag in ("ul", "ol", "dl", "table"):
                    break
                x = x.up
        key = (tag, raw)
        if key not in known:
            known[key] = _kind(tag, raw)
        node = Node(tag, *known[key], top)
        top.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if not end:
                break
            at = page.find(">", end.start()) + 1 or size
        elif tag not in VOID and not raw.endswith("/"):
            top = node
    return root


class Blocks:
    """Texts of blocks in page order, each with its style path and the branches above it; elements that are GONE are left out."""

    def __init__(self, root: Node):
        self.found: list[tuple[str, str, tuple[Node, ...]]] = []
        self.paths: dict[int, str] = {id(root): root.style}
        self.parents: list[Node] = []
        self.parts: list[str] = []
        self.at: tuple[str, tuple[Node, ...]] = ("", ())
        self._walk(root)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.found.append((text, *self.at))
        self.parts = []

    def _walk(self, root: Node) -> None:
        """Depth doesn't use the call stack."""
        stack = [("in", root, root.style, (root,))]
        while stack:
            what, x, path, above = stack.pop()
            if what == "text":
                if not self.parts:
                    self.at = (path, above)
                self.parts.append(x)
            elif what == "out":
                self._flush()
            else:
                if x.tag == "br" or x.tag == "hr":
                    self.parts.append(" ")
                if x.tag in BLOCK:
                    self._flush()
                    stack.append(("out", x, path, above))
                for y in reversed(x.items):
                    if isinstance(y, str):
                        stack.append(("text", y, path, above))
                    elif y.kind == GONE:
                        stack.append(("out", y, path, above))
                    elif y.tag in BLOCK and len(above) < DEPTH:
                        if not above[-1].parent:
                            above[-1].parent = True
                            self.parents.append(above[-1])
                        self.paths[id(y)] = f"{path}/{y.style}"
                        stack.append(("in", y, self.paths[id(y)], (*above, y)))
                    else:
                        stack.append(("in", y, path, above))
        self._flush()


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _look(n: Node) -> str:
    """Presentation of an element: the styles of the blocks in it, repeats left out."""
    return " ".join(dict.fromkeys(y.style for y in n.items if not isinstance(y, str) and y.tag in BLOCK and y.kind != GONE))


def _length(found: list, kept) -> int:
    return sum(len(t) for t, _, above in found if kept(above))


def scope(found: list[tuple[str, str, tuple[Node, ...]]]) -> tuple[str, set[int]]:
    """What holds the article: ("article" | "main" | "", ids of the nodes; none for the whole page).

    The outermost articles, where they have half of the text of `main`, or a quarter of the page's without
    one; else `main`. What names itself boilerplate isn't counted.
    """
    real = [x for x in found if not any(n.kind == NAMED for n in x[2])]
    first = lambda above, tag: next((n for n in above if n.tag == tag), None)
    articles = {id(n) for _, _, above in real if (n := first(above, "article"))}
    mains = {id(n) for _, _, above in real if (n := first(above, "main"))}
    within = lambda ids: lambda above: any(id(n) in ids for n in above)
    around = _length(real, within(mains)) if mains else _length(real, lambda above: not any(n.kind == HEAD for n in above) or any(n.tag == "article" for n in above))
    if articles and _length(real, within(articles)) * (2 if mains else 4) >= around:
        return "article", articles
    return ("main", mains) if mains else ("", set())


def extract(page: str | None, host: str = "", texts: Callable[[int], float] = lambda _: 1.0, styles: Callable[[int], tuple[float, float]] = lambda _: (GAMMA, 0.0), evidence: bool = True) -> str:
    """Main text of a page.

    texts: importance of a text block by its key; styles: by the key of a style node, the weight of what is below
    it and the importance of its presentation. evidence=False: the tree decides alone, without scope and names.
    """
    if not page:
        return ""
    blocks = Blocks(parse(page))
    found = blocks.found
    kind, top = scope(found) if evidence else ("", set())
    inside = lambda above: next((i for i, n in enumerate(above) if id(n) in top), None) if top else 0
    placed = [(text, path, above, begin) for text, path, above in found if (begin := inside(above)) is not None]
    size: dict[int, int] = {}
    worth: dict[int, float] = {}
    total = 0
    for text, path, above, begin in placed:
        own = texts(_key(host, path, text)) * len(text)
        total += len(text)
        for n in above[begin:]:
            size[id(n)] = size.get(id(n), 0) + len(text)
            worth[id(n)] = worth.get(id(n), 0.0) + own

    judged: dict[int, bool] = {}

    def low(n: Node) -> bool:
        """Importance below the threshold: of what is below, and of the presentation where there are blocks below."""
        if kind and (n.tag not in BRANCHES or size[id(n)] * 2 > total):
            return False
        below = worth[id(n)] / size[id(n)]
        if n.parent:
            weight, looks = styles(_key(host, blocks.paths[id(n)]))
            below = weight * below + (1 - weight) * looks
        return below < THRESHOLD

    def goes(n: Node) -> bool:
        if id(n) not in judged:
            judged[id(n)] = evidence and (n.kind == NAMED or n.kind == HEAD and not kind) or low(n)
        return judged[id(n)]

    kept = [text for text, _, above, begin in placed if not any(goes(n) for n in above[begin + 1 :])]
    return "\n".join(kept or [t for t, *_ in placed])


def host(url: Column) -> Column:
    """Lower-cased authority of a url; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


TEXTS, LOOKS, PAGES = range(3)
STYLE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("value", T.LongType()), T.StructField("story", T.LongType())])


def page_counts(host: str, page: str) -> set[tuple[int, int, int, int | None]]:
    """Rows of STYLE of one page: its texts, its presentations and its style nodes, each once.

    story: a hash of the article's text, null on pages without an article. Articles of a page outside its scope
    say nothing about the texts of their own pages and aren't counted."""
    blocks = Blocks(parse(page))
    kind, top = scope(blocks.found)
    within = lambda above: any(id(n) in top for n in above)
    story = _key("\n".join(t for t, _, above in blocks.found if within(above))) if kind == "article" else None
    rows = set()
    for text, path, above in blocks.found:
        if kind != "article" or within(above) or not any(n.tag == "article" for n in above):
            node = _key(host, path)
            rows |= {(TEXTS, node, _key(host, path, text), story), (PAGES, node, 0, story)}
    for n in blocks.parents:
        node = _key(host, blocks.paths[id(n)])
        rows |= {(LOOKS, node, _key(_look(n)), story), (PAGES, node, 0, story)}
    return rows


def style_counts(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts: kind, node, value, story, k (pages). pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                rows: dict[tuple, int] = {}
                for h, page in zip(b.column(0).slice(at, 512).to_pylist(), b.column(1).slice(at, 512), strict=True):
                    for r in page_counts(h, page.as_py() or ""):
                        rows[r] = rows.get(r, 0) + 1
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(rows.values()), pa.int64())], names=[*STYLE.names, "k"])

    partial = pages.select("host", "html").mapInArrow(tidied(run), T.StructType([*STYLE.fields, T.StructField("k", T.LongType())]))
    return partial.groupBy(*STYLE.names).agg(F.sum("k").alias("k"))


def importance(counts: DataFrame) -> DataFrame:
    """key, weight, importance: of texts (weight null) and of the presentations of style nodes, as far as they differ
    from those of a text that stands once and of a node of one presentation. counts: style_counts()."""
    apart = F.sum(F.when(F.col("story").isNull(), F.col("k")).otherwise(1))  # pages of one story count once
    sums = counts.groupBy("kind", "node", "value").agg(apart.alias("k"))
    nodes = sums.filter(F.col("kind") == PAGES).select("node", F.log((F.col("k") + SPARSE).cast("double")).alias("log_m"))
    k = F.col("k").cast("double")
    texts = sums.filter((F.col("kind") == TEXTS) & (F.col("k") > 1)).join(nodes, "node")
    texts = texts.select(F.col("value").alias("key"), F.lit(None).cast("double").alias("weight"), (1 - F.log(k) / F.col("log_m")).alias("importance"))
    looks = sums.filter(F.col("kind") == LOOKS).groupBy("node").agg(F.count("*").alias("l"), F.sum(k).alias("n"), F.sum(k * F.log(k)).alias("kl"))
    entropy = F.log("n") - F.col("kl") / F.col("n")
    looks = looks.filter("l > 1").join(nodes, "node").select(F.col("node").alias("key"), F.pow(F.lit(GAMMA), F.col("l")).alias("weight"), F.least(F.lit(1.0), entropy / F.col("log_m")).alias("importance"))
    return texts.filter(F.col("importance") < COMMON).unionByName(looks)


class Tree:
    """Importance by key, from the rows of importance()."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.values = keys[order], weights[order], values[order]

    def _at(self, key: int) -> int:
        at = bisect.bisect_left(self.keys, key) if len(self.keys) else 0
        return at if at < len(self.keys) and self.keys[at] == key else -1

    def text(self, key: int) -> float:
        at = self._at(key)
        return 1.0 if at < 0 else float(self.values[at])

    def style(self, key: int) -> tuple[float, float]:
        at = self._at(key)
        return (GAMMA, 0.0) if at < 0 else (float(self.weights[at]), float(self.values[at]))


def page_keys(host: str, page: str | None) -> list[int]:
    """Keys of the texts and style nodes of a page that extract() may ask for."""
    blocks = Blocks(parse(page or ""))
    return list({_key(host, path, text) for text, path, _ in blocks.found} | {_key(host, blocks.paths[id(n)]) for n in blocks.parents})


def _with_own(pages: DataFrame, url: str, page: str, tree: DataFrame) -> DataFrame:
    """Adds own_: the rows of tree (key, weight, importance) that the page asks for, through joins by key.

    Hot keys are a single row of the tree each, which adaptive execution may send along with every part of the pages' side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                keys = [page_keys(h.as_py(), x.as_py()) for h, x in zip(b.column(1), b.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["mark_", "keys"])

    mark = F.xxhash64(F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(page), F.lit("")))
    asked = pages.select(mark.alias("mark_"), host(F.col(url)).alias("host"), F.col(page).alias("html")).mapInArrow(tidied(run), "mark_ long, keys array<long>")
    hits = asked.select("mark_", F.explode("keys").alias("key")).join(tree, "key").groupBy("mark_").agg(F.collect_set(F.struct("key", "weight", "importance")).alias("own_"))  # a page's own blocks
    return pages.withColumn("mark_", mark).join(hits, "mark_", "left")


def extract_pages(pages: DataFrame, url: str, page: str) -> DataFrame:
    """Adds text and n_chars (code points) to pages."""
    spark, at = pages.sparkSession, shared_dir(pages.sparkSession)
    hosted = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("html"))
    counts = stored(style_counts(hosted), f"{at}/style")
    tree = stored(importance(counts), f"{at}/tree")
    kept = pages.drop("text", "n_chars")
    given, schema = kept.columns, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    joined = kept.withColumn("h_", host(F.col(url)))
    shipped = None
    if tree.count() <= BROADCAST_KEYS:
        rows = tree.toPandas()
        shipped = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("key", "weight", "importance")))
    else:
        joined = _with_own(joined, url, page, tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_tree = Tree(*shipped.value) if shipped else None
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
                texts = []
                for i, (h, x) in enumerate(zip(col("h_"), col(page), strict=True)):
                    own = whole_tree
                    if own is None:
                        held = col("own_")[i].as_py() or []
                        own = Tree(*(np.array([r[c] for r in held], k) for c, k in (("key", np.int64), ("weight", np.float64), ("importance", np.float64))))
                    texts.append(extract(x.as_py(), h.as_py(), own.text, own.style))
                yield pa.RecordBatch.from_arrays([*map(col, given), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(tidied(run), schema)
