"""Main text of web pages by host consensus.

Pass 1 scores the containers of every page by their prose (text length, commas and sentence ends against links and
boilerplate names) and votes for the generalised path of the best one, its tags and classes without numbers. Votes are summed per host and
path in Spark. Pass 2 extracts every page again from the containers on its host's winning path; a page without such a container falls back
to its own best one. Inside the container, blocks that are menus, headers, footers, sidebars, notices, adverts, forms or comments are left out.

Defined cases: NULL or empty html gives the empty text; pages without markup give their text; unclosed and crossed tags are closed by the
container that ends; a NULL or broken url is a host of its own ('') and votes together; repeated rows vote and return as often as they occur; an
empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select|object|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on inside a line of text; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset("nav header footer aside form button dialog menu input option".split())
CONTAINERS = frozenset("article main section div td body".split())
#: Words of classes, ids and roles, whole or as parts between - and _.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus "
    "footer foot footnav form gdpr header masthead hidden legal login menu menubar meta modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination popup popular promo promoted promotion recommended related replies reply respond search share sharing "
    "shares sidebar sidebars signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget widgets alert contentinfo complementary "
    "copyright outbrain taboola".split()
)
#: Of these the ones that articles use too (a meta-analysis, a legal-history): as parts they count only beside other names of furniture.
DOUBTFUL = frozenset("alert foot legal meta overlay popular replies reply respond search skip tags".split())
FURNITURE = frozenset(
    "area article bar block box button container content entry field group header icon info inner item items line link links list message "
    "outer page panel post posts row section site story title top wrap wrapper".split()
)
MAIN = frozenset("article articlebody body content entry main maincontent post postbody story storybody text prose".split())
SPACES = re.compile(r"\s+")
NUMBERS = re.compile(r"\d+")
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    label: str  # tag and classes without numbers
    digest: int  # of the labels from the root on
    depth: int
    left_out: bool
    bonus: int
    parent: Node | None
    items: list = field(default_factory=list)  # strings, block marks (None) and child nodes
    prose: int = 0
    links: int = 0


def path_of(node: Node) -> str:
    labels = []
    while node.parent is not None:
        labels.append(node.label)
        node = node.parent
    return "/" + "/".join(reversed(labels))


def digest_of(path: str) -> int:
    """The digest nodes on this path have, in this process."""
    out = 0
    for label in path.split("/")[1:]:
        out = hash((out, label))
    return out


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def boilerplate(names: str) -> bool:
    """Whether classes, ids and roles name something beside the article."""
    for name in names.split():
        parts = {w for w in PARTS.split(name.lower()) if w}
        hit = parts & BOILERPLATE
        if name.lower() in BOILERPLATE or hit - DOUBTFUL or (hit and parts <= BOILERPLATE | FURNITURE):
            return True
    return False


def _open(parent: Node, tag: str, raw: str) -> Node:
    found = _attributes(raw)
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
    left_out = (
        tag in LEFT_OUT or boilerplate(names) or "hidden" in found or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "").lower()
    ) and tag not in ("html", "body", "main", "article")
    # A slash parts labels, so none stays inside one.
    label = (tag + "".join(f".{NUMBERS.sub('#', c)}" for c in sorted(found.get("class", "").lower().split()))).replace("/", "|")
    words = {w for w in PARTS.split(names.lower()) if w} | {w.lower() for w in names.split()}
    bonus = (2 if tag in ("article", "main") else 1 if words & MAIN else 0) if tag in CONTAINERS else 0
    return Node(tag, label, hash((parent.digest, label)), parent.depth + 1, left_out or parent.left_out, bonus, parent)


#: Start tags that end an open element of these kinds.
ENDS = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Their end tags close no container.
SMALL = INLINE | {"p", "li"}


class _Open:
    """The open elements, with the depths of each tag, so that an end tag finds its start without climbing."""

    def __init__(self) -> None:
        self.nodes = [Node("", "", 0, 0, False, 0, None)]
        self.depths: dict[str, list[int]] = {}
        self.containers = [0]
        self.blocks = [0]

    def deepest(self, tag: str) -> int:
        """Depth of the innermost open element of this tag, 0 for none."""
        held = self.depths.get(tag)
        return held[-1] if held else 0

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(node.depth)
        if node.tag in CONTAINERS:
            self.containers.append(node.depth)
        if node.tag not in INLINE and node.tag != "p":
            self.blocks.append(node.depth)

    def close(self, depth: int) -> None:
        """End the element at this depth and all inside."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()
        for held in (self.containers, self.blocks):
            while held[-1] >= depth:
                held.pop()


def parse(page: str) -> Node:
    """A tree of the page's elements with texts decoded; scripts, styles, comments and titles are gone."""
    opened = _Open()
    root = here = opened.nodes[0]
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            here.items.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[0][:9] == "<![CDATA[":
                here.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[2]:
            depth = opened.deepest(tag)
            if depth and (tag not in SMALL or depth > opened.containers[-1]):
                opened.close(depth)
                here = opened.nodes[-1]
            if tag not in INLINE:
                here.items.append(None)
            continue
        if tag in VOID:
            if tag not in INLINE:
                here.items.append(None)
            continue
        closes = ENDS.get(tag, ()) + (("p",) if tag in BLOCKS_END_P else ())
        depth = max(map(opened.deepest, closes), default=0)
        if depth and depth >= opened.blocks[-1]:
            opened.close(depth)
            here = opened.nodes[-1]
            here.items.append(None)
        child = _open(here, tag, m[4])
        if tag not in INLINE:
            here.items.append(None)
        here.items.append(child)
        if not m[4].rstrip().endswith("/") or tag not in ("path", "use"):
            opened.push(child)
            here = child
    if at < len(page):
        here.items.append(entities.unescape(page[at:]))
    return root


def containers(root: Node) -> list[Node]:
    """Containers in page order with the prose and link text below them; deep pages need no recursion."""
    order, stack, found = [], [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.items) if isinstance(c, Node)]
    for node in reversed(order):
        if node.left_out:
            continue
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        inside = [c for c in node.items if isinstance(c, Node)]
        node.prose = own + sum(c.prose for c in inside)
        node.links = (own if node.tag == "a" else 0) + sum(c.links for c in inside)
    for node in order:
        if node.tag in CONTAINERS and not node.left_out:
            found.append(node)
    return found


def score(node: Node, whole: int) -> float:
    """Share of the page's prose outside links, more for a container that is named as main, less for each level of wrapping."""
    return (node.prose - node.links) / max(whole, 1) + 0.35 * node.bonus + 0.002 * node.depth - (0.2 if node.tag == "body" else 0)


def best_container(root: Node) -> Node | None:
    found = containers(root)
    whole = max((n.prose for n in found), default=0)
    return max(found, key=lambda n: score(n, whole), default=None) if whole else None


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space inside a block as one space, blocks joined by one space."""
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        block = SPACES.sub(" ", "".join(run)).strip()
        if block:
            blocks.append(block)
        run.clear()

    for top in nodes:
        stack: list = [None, *reversed(top.items)]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                run.append(item)
            elif not item.left_out:
                stack += [*([] if item.tag in INLINE else [None]), *reversed(item.items)]
        close()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def page_votes(pages: DataFrame) -> DataFrame:
    """``pages`` with the generalised path of each page's best container; NULL where there is none."""

    @F.pandas_udf("string")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            best = [best_container(parse(p)) if p else None for p in pages_]
            yield pd.Series([path_of(b) if b else None for b in best], dtype=object)

    # Not deterministic as far as Spark knows: a filter on the path stays above the function instead of calling it again.
    return pages.withColumn("_path", vote.asNondeterministic()("html"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path`` with most votes; ties to the shorter, then the smaller path. Votes are counted before hosts meet."""
    votes = page_votes(pages.select(host_of(F.col("url")).alias("host"), "html")).filter(F.col("_path").isNotNull())
    counted = votes.groupBy("host", "_path").agg(F.count("*").alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.length("_path"), "_path")
    return counted.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("host", F.col("_path").alias("path"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``."""
    from siltmark.llm.text import written

    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    named = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    winners = written(winning_paths(named), "host-paths")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, paths in batches:
            out = []
            for page, path in zip(htmls, paths):
                if not page:
                    out.append("")
                    continue
                root = parse(page)
                wanted = digest_of(path) if path else None
                on_path = [n for n in containers(root) if n.digest == wanted and n.prose]
                inner = best_container(root)
                if inner and sum(n.prose for n in on_path) * 2 < inner.prose:  # this page's article stands elsewhere
                    on_path = []
                out.append(text_of(on_path or ([inner] if inner else [root])))
            yield pd.Series(out, dtype=object)

    joined = pages.withColumn("_host", host_of(F.col(url_col))).join(
        winners.select(F.col("host").alias("_host"), F.col("path").alias("_path")), "_host", "left"
    )
    out = joined.select(*[F.col(c) for c in keep], extract(F.col(html_col), F.col("_path")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
