"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tag and
classes from the root). Every page votes at each of its nodes with two values: the
presentation (the sequence of child elements) and the content (the text below). A node's
importance is the entropy of these votes over the pages that have the node, relative to the largest possible: 0 if
all pages look alike there, 1 if every page differs. `CONTENT` is the weight of content against
presentation. Nodes of hosts with few pages lean on the tree of all hosts together.
Branches whose importance is below `LEAST` are removed from each page of the host. `article` and `main` are a
prior: `LEAN` is added to the importance of branches inside them and taken from those beside them, in
proportion to the pages that have text in one. A branch above them takes nothing out of them.

Elements that are never main text by their kind (scripts, forms, menus, footers, asides) or by their
class or id (adverts, notices, comments and so on) go first.

A block is the text of one block-level element between the starts and ends of others.
Character references are decoded, white space inside a block becomes one space, and
blocks are joined by an empty line.

Defined results: null and empty html give an empty text; a null url belongs to the host
''; if only unimportant branches hold text, they are kept, those in `article` or `main` alone
if there are any (a site of equal pages has nothing to tell them apart by); a branch without text on a page has no vote there; broken markup never fails, an element that is not closed
ends with its parent; repeated rows vote repeatedly. Unimportant branches are joined to the
branches of each page, so the list that a page gets is bounded by its own nodes, whatever its host has. Columns named like
the results are replaced; all others stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.naming import free

#: Weight of content entropy; presentation has the rest.
CONTENT = 0.9
#: Importance below which a branch goes.
LEAST = 0.3
#: What being inside an article adds to importance, and being beside one takes.
LEAN = 0.1
#: Pages of the tree of all hosts that count beside a host's own.
PRIOR_PAGES = 10
#: Fewest pages on which a branch can be judged.
FEWEST = 3
#: Parts into which the pages of a host are dealt when they meet its branches.
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "xmp", "iframe", "noembed", "noframes"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead"
    " title tr ul".split()
)
NOISE = frozenset(
    "aside audio button canvas datalist dialog embed footer form head header iframe input label map math menu nav"
    " noembed noframes noscript object option script select style svg template textarea title video xmp".split()
)
KEPT = frozenset(("article", "main"))
NOISE_WORDS = re.compile(
    r"(?:^|[-_ ])(?:ad|ads|adv|advert\w*|adsense|banner|billboard|breadcrumbs?|byline-?share|captcha|comments?|commentlist|consent|cookies?"
    r"|disqus|footer|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notice|notification|overlay|pagination|pager|paywall|popup|promo\w*"
    r"|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar"
    r"|topbar|widget\w*)(?:$|[-_ 0-9])"
)
#: Elements that end an open element of the same group when they start.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "div", "section", "menu", "select"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    path: str
    tag: str
    noise: bool
    inside_kept: bool
    children: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    nodes: list[Node]
    #: (nodes from the root, text) of each block with text.
    blocks: list[tuple[tuple[Node, ...], str]]


def _describe(tag: str, attributes: str, parent: Node) -> Node:
    label, noise = tag, tag in NOISE
    if attributes and not attributes.isspace():
        found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        classes = sorted(found.get("class", "").lower().split())
        label = ".".join([tag, *(_DIGITS.sub("0", c) for c in classes)])
        names = " ".join([*classes, found.get("id", "").lower()])
        noise = (
            noise
            or (tag not in ("html", "body") and bool(NOISE_WORDS.search(names)))
            or found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
            or "hidden" in found
            or found.get("aria-hidden", "").lower() == "true"
        )
    if tag == "header" and parent.inside_kept:
        noise = parent.noise  # the head of an article, not of the page
    kept = tag in KEPT
    return Node(f"{parent.path}>{label}", tag, parent.noise or (noise and not kept), parent.inside_kept or kept)


def parse(html: str | None) -> Page:
    """Nodes and text blocks of a page, without scripts, comments and markup."""
    root = Node("", "", False, False)
    nodes: list[Node] = []
    stack = [root]
    blocks: list[tuple[tuple[Node, ...], str]] = []
    pieces: list[str] = []
    text = html or ""

    def close_block() -> None:
        if pieces:
            joined = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if joined:
                blocks.append((tuple(stack), joined))

    def pop_to(tags: tuple[str, ...], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(n.tag in BLOCK for n in stack[i:]):
                    close_block()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if text[m.start()] != "<" or at - m.start() == 1:
                pieces.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            pop_to((tag,), frozenset())
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            close_block()
            pop_to(("p",), SCOPE)
        elif tag in ("td", "th"):
            pieces.append(" ")
        if tag in ENDS:
            pop_to(ENDS[tag], SCOPE)
        node = _describe(tag, m[3], stack[-1])
        stack[-1].children.append(node.path)
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID:
            nodes.append(node)
            stack.append(node)
    close_block()
    return Page(nodes, blocks)


_hashes: dict[str, int] = {}


def path_hash(path: str) -> int:
    """Signed 64-bit hash of a path."""
    found = _hashes.get(path)
    if found is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        found = _hashes[path] = xxhash.xxh3_64_intdigest(path) - 2**63
    return found


def votes(page: Page) -> list[tuple[int, int, int, int]]:
    """(path, presentation, content, lean) of every node that may be judged; equal paths of a page are one node.

    `lean` is 1 inside an article, -1 beside one that has text and 0 on other pages.
    """
    content: dict[str, xxhash.xxh3_64] = {}
    beside = 0
    for chain, text in page.blocks:
        if chain[-1].inside_kept and not chain[-1].noise:
            beside = -1
        for path in {node.path for node in chain}:
            content.setdefault(path, xxhash.xxh3_64()).update(text + "\n")
    style: dict[str, list[str]] = {}
    lean: dict[str, int] = {}
    for node in page.nodes:
        if node.noise or node.tag in ("html", "body") or node.path not in content:
            continue
        run = style.setdefault(node.path, [])
        run += [c for c, before in zip(node.children, [None, *node.children]) if c != before]
        lean[node.path] = 1 if node.inside_kept else beside
    return [
        (path_hash(p), xxhash.xxh3_64_intdigest("\n".join(s)) - 2**63, content[p].intdigest() - 2**63, lean[p]) for p, s in style.items()
    ]


def main_text(page: Page, unimportant: frozenset[int]) -> str:
    """Text of the blocks that are left; a block in an article is judged by the branches from the article on."""
    left = [(chain, text) for chain, text in page.blocks if not chain[-1].noise]
    if unimportant:
        good = [
            (c, t) for c, t in left if not any(path_hash(n.path) in unimportant for n in c if n.inside_kept or not c[-1].inside_kept)
        ]
        left = good or [(c, t) for c, t in left if c[-1].inside_kept] or left
    return "\n\n".join(text for _, text in left)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def _entropy(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy of `value` within `by`, relative to the logarithm of the number of votes."""
    counts = rows.groupBy(*by, value).agg(F.sum("n").alias("n"), F.sum("lean").alias("lean"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("lean").alias("lean"))
    log = F.log("pages")
    return sums.select(*by, "pages", (F.col("lean") / F.col("pages")).alias("lean"), F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), (log - F.col("s") / F.col("pages")) / log)).otherwise(1.0).alias(f"h_{value}"))


def importance(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, pages, lean, importance) for rows (by, style, content, n, lean)."""
    both = _entropy(rows, by, "content").join(_entropy(rows, by, "style").drop("pages", "lean"), by)
    return both.select(*by, "pages", "lean", (CONTENT * F.col("h_content") + (1 - CONTENT) * F.col("h_style")).alias("importance"))


def _host_key(url: str) -> Column:
    return F.xxhash64(host_of(F.col(url)))


def unimportant_branches(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, path): hashes of the branches that go on every page of a host."""

    @F.pandas_udf("array<struct<path: long, style: long, content: long, lean: int>>")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([votes(parse(t)) for t in texts])

    raw = pages.select(_host_key(url).alias("host"), F.explode(vote.asNondeterministic()(html)).alias("v"))
    rows = raw.groupBy("host", "v.path", "v.style", "v.content").agg(F.count("*").alias("n"), F.sum("v.lean").alias("lean"))
    own = importance(rows, ["host", "path"])
    every = importance(rows, ["path"]).select("path", F.col("pages").alias("all_pages"), F.col("importance").alias("all_importance"))
    prior = F.least(F.lit(PRIOR_PAGES), F.col("all_pages"))
    judged = own.join(every, "path").where(F.col("all_pages") >= FEWEST)
    mixed = (F.col("pages") * F.col("importance") + prior * F.col("all_importance")) / (F.col("pages") + prior)
    return judged.where(mixed + LEAN * F.col("lean") < LEAST).select("host", "path")


def branches_of_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, page, branches): the unimportant branches that a page has; a page goes by the hash of its html."""

    @F.pandas_udf("array<long>")
    def paths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted({path_hash(n.path) for c, _ in parse(t).blocks for n in c if not n.noise}) for t in texts])

    each = pages.select(_host_key(url).alias("host"), F.xxhash64(html).alias("page"), paths.asNondeterministic()(html).alias("paths"))
    each = each.distinct().select("host", "page", F.explode("paths").alias("path")).withColumn("salt", F.pmod("page", F.lit(SALTS)))
    low = unimportant_branches(pages, url, html).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return each.join(low, ["host", "path", "salt"]).groupBy("host", "page").agg(F.collect_list("path").alias("branches"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`pages` with the main text of each page and its number of characters."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, branches in batches:
            yield pd.Series([main_text(parse(h), frozenset(() if b is None else b)) for h, b in zip(htmls, branches)], dtype=object)

    host, page, branches, found = free(pages, "_host", "_page", "_branches", "_text")
    low = branches_of_pages(pages, url, html).select(F.col("host").alias(host), F.col("page").alias(page), F.col("branches").alias(branches))
    made = pages.withColumns({host: _host_key(url), page: F.xxhash64(html)}).join(low, [host, page], "left")
    made = made.withColumn(found, extracted.asNondeterministic()(html, branches))
    return made.withColumns({text: F.col(found), n_chars: F.length(found).cast("long")}).drop(host, page, branches, found)
