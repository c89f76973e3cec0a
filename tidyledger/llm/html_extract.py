"""Main text of web pages by wrapper induction over the pages of each host.

A page becomes a DOM tree; siblings with the same label (tag and class words)
count as one repeated node, so the tree that is compared stays small. Of every
host one page is the first wrapper. Simple tree matching aligns every page of the
host with it, and the own text of each aligned node is counted over all different
pages: nodes whose text is the same on most of them are template, the others are
slots, and the slots' text tells which part of the page holds the article. Then every
page is aligned with its host's wrapper once more and gives its text without template
nodes and without the parts whose tags or class words mark them as no article.

Only node hashes are shuffled, counted map-side first; wrappers join the pages as a
small table, so a host with a third of all pages needs no task of its own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyledger.llm.common import id_back, id_text, ship, stored

# Kinds of elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table body html article section div main".split())
# Elements and class words that are no article.
NO_ARTICLE = RAW | frozenset("head nav footer aside form button select label svg canvas object dialog menu input".split())
NO_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu sidebar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing comment comments "
    "disqus reply replies related recommended recommendations breadcrumb breadcrumbs pagination pager footer masthead topbar "
    "copyright widget widgets search login toolbar skip".split())
# Inside an article these say something only where they are what a class name is about, as in "post-share" but not in "share-price".
UNSURE_WORDS = frozenset(
    "menu banner modal notice notices alert social share sharing reply replies related recommended recommendations "
    "subscription copyright search login toolbar skip".split())
# Words at the end of a class name that do not say what it is about.
FILLER_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards col column container content desktop field form "
    "grid group header heading icon icons image inline inner input item items large left link links list main media mobile outer panel "
    "post posts primary right row secondary section slot small stories text this title top unit wrap wrapper".split())
# Elements that hold an article's own words; an unsure word drops them only if they are mostly links.
PROSE = frozenset("p table thead tbody tr td th blockquote pre code figure figcaption dl dt dd li em strong b i span a h1 h2 h3 h4 h5 h6".split())
LINK_SHARE = 0.5
COMMENT_WORDS = frozenset("comment comments disqus reply replies related recommended recommendations".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER_WORDS = frozenset("header head".split())
ARTICLE_WORDS = frozenset("article post entry content story main body text".split())
MAX_DEPTH = 200  # deeper elements hang at this depth, as in browsers
SAME_SHARE = 0.5  # share of different pages on which a node's text is the same
SAME_PAGES = 4  # and at least so many
NEARLY_ALL = 0.9  # a text on fewer of a host's pages can be an article
WRAP_SHARE = 0.8  # an element that holds so much of the varying text is no boilerplate whatever its words

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "classes", "names", "marks", "found", "children", "depth")

    def __init__(self, tag: str, attributes: str, depth: int):
        self.tag, self.depth, self.children = tag, depth, []
        self.classes, self.names, self.marks, self.found = "", frozenset(), frozenset(), ()
        if attributes:
            self.found = found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attributes)]
            self.classes = " ".join(w for kind, value in found if kind == "class" for w in _WORDS.findall(value.lower()))
            self.names = frozenset(w for _, value in found for w in _WORDS.findall(value.lower()))
            self.marks = frozenset(w for kind, value in found if kind != "id" for w in _WORDS.findall(value.lower()))

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.classes}" if self.classes else self.tag


def parse(text: str) -> Node:
    """DOM tree of a page, however broken: unclosed, misnested and unknown elements are accepted."""
    root = Node("#root", "", 0)
    stack = [root]
    at, end = 0, len(text)

    def add(data: str) -> None:
        if data:
            stack[-1].children.append(data)

    while at < end:
        found = _TOKEN.search(text, at)
        if not found:
            add(text[at:])
            break
        add(text[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        attributes = found[3] or found[6] or ""
        if tag in BLOCK:
            _close(stack, {"p"}, LISTS)
        if tag in CLOSES:
            _close(stack, CLOSES[tag], LISTS)
        node = Node(tag, attributes, stack[-1].depth + 1)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            node.children.append(text[at:close.start() if close else end])
            at = close.end() if close else end
            continue
        if node.depth < MAX_DEPTH:
            stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], border: frozenset) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in border:
            return


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


class Skeleton:
    """Tree of labels in preorder, with the page's elements behind every node."""

    def __init__(self, labels: list[str], parents: list[int], members: list[list[Node]] | None = None):
        self.labels, self.parents, self.members = labels, parents, members
        self.children: list[list[int]] = [[] for _ in labels]
        for i, parent in enumerate(parents):
            if parent >= 0:
                self.children[parent].append(i)

    @classmethod
    def of(cls, root: Node) -> Skeleton:
        labels, parents, members = [], [], []

        def walk(label: str, nodes: list[Node], parent: int) -> None:
            me = len(labels)
            labels.append(label)
            parents.append(parent)
            members.append(nodes)
            groups: dict[str, list[Node]] = {}
            for node in nodes:
                for child in node.children:
                    if not isinstance(child, str) and child.tag not in VOID:
                        groups.setdefault(child.label, []).append(child)
            for child_label, some in groups.items():
                walk(child_label, some, me)

        walk(root.label, [root], -1)
        return cls(labels, parents, members)

    def packed(self) -> str:
        return json.dumps([self.labels, self.parents])

    @classmethod
    def unpacked(cls, text: str) -> Skeleton:
        return cls(*json.loads(text))

    def own_text(self, i: int) -> str:
        return clean(" ".join(c for node in self.members[i] for c in node.children if isinstance(c, str)))


def simple_tree_matching(a: Skeleton, b: Skeleton) -> dict[int, int]:
    """Largest order-preserving match of nodes with equal labels and matched parents: node of a -> node of b."""

    def match(i: int, j: int) -> tuple[int, list]:
        left, right = a.children[i], b.children[j]
        if not left or not right:
            return 1, [(i, j)]
        best = [[(0, None)] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, u in enumerate(left):
            for y, v in enumerate(right):
                up, back = best[x][y + 1], best[x + 1][y]
                top = up if up[0] >= back[0] else back
                if a.labels[u] == b.labels[v]:
                    size, pairs = match(u, v)
                    if best[x][y][0] + size > top[0]:
                        top = (best[x][y][0] + size, (best[x][y][1], pairs))
                best[x + 1][y + 1] = top
        size, chain = best[-1][-1]
        pairs = [(i, j)]
        while chain:
            chain, some = chain
            pairs += some
        return size + 1, pairs

    return dict(match(0, 0)[1]) if a.labels and b.labels and a.labels[0] == b.labels[0] else {}


def _subjects(node: Node, with_ids: bool) -> set[str]:
    """What the element's class names (and id) are about: the last word of each that is no filler."""
    out = set()
    for kind, value in node.found:
        for name in value.lower().split() if with_ids or kind != "id" else ():
            words = [w for w in _WORDS.findall(name) if len(w) > 1 and w not in FILLER_WORDS]
            out |= set(words[-1:])
    return out


def _mostly_links(node: Node) -> bool:
    def chars(some: Node, linked: bool) -> tuple[int, int]:
        every = within = 0
        for child in some.children:
            if isinstance(child, str):
                n = len(clean(child))
                m = n if linked else 0
            else:
                n, m = chars(child, linked or child.tag == "a")
            every, within = every + n, within + m
        return every, within

    every, within = chars(node, node.tag == "a")
    return within > LINK_SHARE * every


def is_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in ("html", "body"):
        return False
    if node.tag in NO_ARTICLE or node.tag == "header" and not in_article:
        return True
    # An id of a heading, or of a section of an article, is made of its title.
    by_marks = node.tag in HEADINGS or node.tag == "section" and in_article
    names = node.marks if by_marks else node.names
    if not names:
        return False
    if in_article and not names & (NO_ARTICLE_WORDS - UNSURE_WORDS):
        if not names & UNSURE_WORDS or not _subjects(node, not by_marks) & UNSURE_WORDS:
            return False
        if node.tag in PROSE:
            return _mostly_links(node)
    if names & NO_ARTICLE_WORDS:
        return node.tag not in ("article", "main") or bool(names & {"comment", "comments", "related"})
    return bool(names & HEADER_WORDS) and not in_article and not names & ARTICLE_WORDS


def may_wrap(tag: str, names: frozenset | set) -> bool:
    """Whether an element that a word marks, or a form, can be the frame around the article."""
    return (tag == "form" or tag not in NO_ARTICLE and tag != "header") and not names & COMMENT_WORDS


def frames(root: Node, template: set[int]) -> set[int]:
    """Ids of marked elements and forms that hold four fifths of the page's text without template."""
    held: dict[int, int] = {}

    def count(node: Node) -> int:
        if node.tag in NO_ARTICLE and node.tag != "form":
            return 0
        held[id(node)] = sum((len(clean(c)) if id(node) not in template else 0) if isinstance(c, str) else count(c)
                             for c in node.children)
        return held[id(node)]

    out, total, level = set(), count(root), [root]
    while level:
        level = [c for node in level for c in node.children if not isinstance(c, str) and held.get(id(c), 0) >= WRAP_SHARE * total > 0]
        out |= {id(c) for c in level if is_boilerplate(c, False) and may_wrap(c.tag, c.names)}
    return out


def article_roots(root: Node, inside: bool = False) -> list[Node]:
    """The outermost article elements outside boilerplate, else the main elements; or also ``inside`` marked frames and forms."""
    found: dict[str, list[Node]] = {"article": [], "main": []}

    def walk(node: Node, kinds: tuple) -> None:
        for child in node.children:
            if isinstance(child, str):
                continue
            if is_boilerplate(child, child.tag == "article"):
                if inside and child.tag != "article" and may_wrap(child.tag, child.names):
                    walk(child, kinds)
                continue
            kind = "article" if child.tag == "article" else "main" if child.tag == "main" or "main" in child.names else None
            if kind in kinds:
                found[kind].append(child)
                kinds_below = tuple(k for k in kinds if k != kind)
            else:
                kinds_below = kinds
            if kinds_below:
                walk(child, kinds_below)

    walk(root, ("article", "main"))
    return found["article"] or found["main"]


def blocks(roots: list[Node], template: set[int], in_article: bool, spared: set[int] | frozenset = frozenset()) -> list[str]:
    """Text blocks in page order. ``template`` holds the ids of elements whose own text is template; ``spared`` ones stay."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = clean("".join(parts))
        if text:
            out.append(text)
        parts.clear()

    def walk(node: Node) -> None:
        constant = id(node) in template
        for child in node.children:
            if isinstance(child, str):
                if not constant:
                    parts.append(child)
            elif child.tag == "br":
                parts.append(" ")
            elif id(child) in spared or not is_boilerplate(child, in_article):
                block = child.tag in BLOCK
                if block:
                    flush()
                walk(child)
                if block:
                    flush()

    for root in roots:
        walk(root)
        flush()
    return out


def main_text(page: str, wrapper: Skeleton | None, template_texts: frozenset, region: int) -> str:
    """``template_texts`` holds (node of the wrapper, hash of its constant own text)."""
    root = parse(page)
    template: set[int] = set()
    place = None
    if wrapper is not None:
        skeleton = Skeleton.of(root)
        matched = simple_tree_matching(wrapper, skeleton)
        template = {id(m) for i in {i for i, _ in template_texts} if i in matched
                    and (i, _text_hash(skeleton.own_text(matched[i]))) in template_texts for m in skeleton.members[matched[i]]}
        place = skeleton.members[matched[region]] if region in matched else None
    roots = article_roots(root)
    if roots:
        return "\n\n".join(blocks(roots, template, True))
    spared = frames(root, template)
    text = "\n\n".join(blocks(place or [root], template, False, spared))
    if not text and place:
        text = "\n\n".join(blocks([root], template, False, spared))
    framed = "\n\n".join(blocks(article_roots(root, True), template, True))
    return framed if 2 * len(framed) > len(text) else text


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, skeleton (JSON), template (node numbers and hashes of their constant texts), region (node that holds most varying text)."""

    @F.pandas_udf("string")
    def skeleton(texts: pd.Series) -> pd.Series:
        return pd.Series([Skeleton.of(parse(t)).packed() for t in texts])

    # An empty page says nothing about its host; among the others the one with the least id starts the wrapper.
    first = pages.filter("html <> ''").groupBy("host").agg(
        F.min_by("html", F.struct(F.col("page_id").isNull(), "page_id", F.xxhash64("html"))).alias("html"))
    reference = stored(first.select("host", skeleton("html").alias("skeleton")), "wrapper-start")

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = {k: Skeleton.unpacked(k) for k in batch["skeleton"].unique()}
            rows = []
            for host, text, start in zip(batch["host"], batch["html"], batch["skeleton"], strict=True):
                page = Skeleton.of(parse(text))
                key = _text_hash(text)
                for i, j in simple_tree_matching(starts[start], page).items():
                    own = page.own_text(j)
                    if own:
                        rows.append((host, i, _text_hash(own), key, len(own)))
            yield pd.DataFrame(rows, columns=["host", "node", "own", "page", "chars"])

    seen = stored(pages.join(reference, "host").select("host", "html", "skeleton")
            .mapInPandas(nodes, "host string, node int, own long, page long, chars long").distinct(), "page-texts")
    # Copies of one article, with other adverts or links, vote once: a page is known by its longest text that is not on nearly all.
    total = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    some = (seen.groupBy("host", "node", "own").agg(F.count("*").alias("n")).join(total, "host")
            .filter(F.col("n") < NEARLY_ALL * F.col("total")).select("host", "node", "own"))
    bodies = seen.join(some, ["host", "node", "own"]).groupBy("host", "page").agg(
        F.max_by("own", F.struct("chars", "own")).alias("body"))
    seen = seen.join(bodies, ["host", "page"], "left").select(
        "host", "node", "own", F.coalesce("body", "page").alias("page"), "chars").distinct()
    by_text = seen.groupBy("host", "node", "own").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    by_node = by_text.groupBy("host", "node").agg(
        F.max("n").alias("same"), F.sum("n").alias("pages"), F.sum("chars").alias("chars"),
        # Two texts with half of the pages each are both template.
        F.when(F.count("*") == 2, F.array(F.min("own"), F.max("own"))).otherwise(F.array(F.max_by("own", F.struct("n", "own")))).alias("top"),
        F.max_by("own", F.struct("n", "own")).alias("most"))
    by_node = by_node.withColumn(
        "texts", F.when(F.col("same") * 2 == F.col("pages"), F.col("top")).otherwise(F.array("most")))
    constant = (F.col("same") >= SAME_PAGES) & (F.col("same") >= SAME_SHARE * F.col("pages"))
    facts = by_node.groupBy("host").agg(
        F.flatten(F.collect_list(F.when(constant, F.transform("texts", lambda t: F.struct("node", t.alias("own")))))).alias("template"),
        F.collect_list(F.when(~constant, F.struct("node", "chars"))).alias("slots"))

    @F.pandas_udf("int")
    def region(skeletons: pd.Series, slots: pd.Series) -> pd.Series:
        return pd.Series([_region(Skeleton.unpacked(s), {r["node"]: r["chars"] for r in some})
                          for s, some in zip(skeletons, slots, strict=True)], dtype="int32")

    return stored(reference.join(facts, "host").select(
        "host", "skeleton", "template", region("skeleton", "slots").alias("region")), "wrappers")


def _region(wrapper: Skeleton, chars: dict[int, int]) -> int:
    """The deepest node that still holds four fifths of the varying text outside boilerplate elements."""
    parts = [label.partition(".") for label in wrapper.labels]
    words = [set(names.split()) for _, _, names in parts]
    held, inside = [0] * len(parts), [0] * len(parts)
    for i in range(len(parts) - 1, -1, -1):
        held[i] += chars.get(i, 0)
        if parts[i][0] in NO_ARTICLE and parts[i][0] != "form":
            held[i] = 0
        elif wrapper.parents[i] >= 0:
            held[wrapper.parents[i]] += held[i]
    for i in range(len(parts) - 1, -1, -1):
        tag = parts[i][0]
        marked = tag in NO_ARTICLE or tag == "header" or tag not in ("html", "body") and NO_ARTICLE_WORDS & words[i]
        if marked and not (may_wrap(tag, words[i]) and held[i] >= WRAP_SHARE * held[0]):
            inside[i] = 0
            continue
        inside[i] += chars.get(i, 0)
        if wrapper.parents[i] >= 0:
            inside[wrapper.parents[i]] += inside[i]
    at = 0
    while True:
        below = [c for c in wrapper.children[at] if inside[c] > 0.8 * inside[0]]
        if not below or wrapper.labels[below[0]].partition(".")[0] not in BLOCK:
            return at
        at = below[0]


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html is empty and gives the empty text. A null url belongs to the host without a name. Repeated pages count
    once in the induction and are extracted like any other; no pages give no rows. Pages whose host has no wrapper,
    or that do not align with it, are read by tags and class words alone. Other columns are never read.
    """
    ship(pages.sparkSession)
    dealt = _hosts(pages)
    found = wrappers(dealt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = {k: Skeleton.unpacked(k) for k in batch["skeleton"].dropna().unique()}
            texts = [main_text(page, known.get(skeleton),
                               frozenset(() if template is None else ((t["node"], t["own"]) for t in template)), -1 if pd.isna(region) else int(region))
                     for page, skeleton, template, region in zip(
                         batch["html"], batch["skeleton"], batch["template"], batch["region"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    paired = dealt.join(found, "host", "left").select(id_text("page_id"), "url", "html", "skeleton", "template", "region")
    return id_back(paired.mapInPandas(run, "page_id string, url string, text string, n_chars long"), "page_id")
