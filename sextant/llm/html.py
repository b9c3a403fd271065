"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is a path of block elements (tag
and class names, and whether a name marks it as noise), its pages are those that have the
path, its contents the text blocks found there, its presentations the sequences of children
that it has on its pages. Text that stands beside elements is a child of its own.

The importance of a node with texts of its own is one minus the mean entropy of its contents,
where a content that k of the node's m pages hold has the entropy log_m k. That of a node around
others is (1 - g^l) P + g^l C: P is the entropy of its l presentations to the base l, so that it
does not fall as a host grows, and C what its branches have for their contents. A branch that is
the same on page after page comes near 0, one whose pages differ near 1. Few pages say little,
so EVIDENCE pages of importance 1/2 are added to each node.

Importance is weighed against what markup says beforehand: what is in an element made for navigation,
notices, adverts, forms or comments, or named so, or beside what the page marks as its
article or main part, is unlikely to be content; an article is likely. Odds are multiplied, and
a branch of which no node comes up to LEAST is removed from each page. The tree's odds are bounded,
so that comments, which differ on every page, are not taken for content.

Copies of a page tell no more about its host than one, so pages are counted by their main
text. Pages and tree meet by host in a join that splits hot hosts; of a host's tree it takes the
topmost nodes removed, of which there are as many as its templates have, however many pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Door, lean, removed, slices, written

#: A branch less likely than this to be content is removed.
LEAST = 0.3
#: How likely a node is content by markup alone: named as noise or beside the main part, plain, and marked as the article.
NOISE_PRIOR, PLAIN_PRIOR, MAIN_PRIOR = 0.02, 0.5, 0.9
#: g of the importance.
DAMPING = 0.9
#: Pages of importance 1/2 added to a node's own, and how near to 0 and 1 the tree may come.
EVIDENCE, BOUND = 8, 0.05
#: Elements below this depth are read as parts of the element there, as browsers do.
DEEPEST = 256

# Elements of HTML by the part they play.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "noembed", "noframes", "xmp"}
NOISE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "map", "head", "label", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that end an open element of these before they start.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = (BLOCK | NOISE) - {"html", "body", "button", "label", "select", "option", "svg", "head", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}
#: Names of classes, ids and roles that mark noise.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "dialog", "footer", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "related", "recommended", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "alert", "alertdialog",
}
#: Pieces that a name of noise may be joined with: `site-header` is one, `market-share` is none.
BESIDE = {"site", "page", "global", "top", "bottom", "left", "right", "primary", "secondary", "main", "list", "box", "wrapper", "container", "area", "block", "bar", "inner", "item", "items", "form", "links", "icons", "section", "unit", "slot"}
MAIN = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HOST = re.compile(r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def names_noise(token: str) -> bool:
    """Whether all pieces of a name stand for noise, or may stand beside one that does."""
    pieces = [p for p in re.split(r"[_-]+", token) if p]
    return not NAMES.isdisjoint(pieces) and all(p in NAMES or p in BESIDE or p.isdigit() for p in pieces)


def marked(attributes: str) -> tuple[str, bool]:
    """Class names of an element, and whether its names or attributes mark it as noise."""
    if not attributes.strip("/ \t\r\n\f"):
        return "", False
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    tokens = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", " ".join(found.get(k, "") for k in ("class", "id", "role"))).lower().split()
    noise = any(map(names_noise, tokens)) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.I))
    return ".".join(sorted(found.get("class", "").lower().split())), noise


def key_of(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class Page:
    """The blocks of a page and the elements around them, in page order.

    Of element i: parent[i] (an earlier one; -1 for the page), name[i], key[i] (of the path),
    noise[i] (marked so itself), tag[i] and children[i] (names, `#` for text). blocks: (element, text).
    """

    def __init__(self, page: str):
        self.parent, self.name, self.key, self.noise, self.tag = [], [], [], [], []
        self.children: list[list[str]] = []
        self.blocks: list[tuple[int, str]] = []
        self._read(page)
        # Text beside elements is a child of its own.
        beside: dict[int, int] = {}
        for k, (i, text) in enumerate(self.blocks):
            if any(c != "#" for c in self.children[i]):
                if i not in beside:
                    beside[i] = self._add(i, "#", "#", False)
                    self.children[beside[i]].append("#")
                self.blocks[k] = (beside[i], text)
        self._inside()

    def _add(self, parent: int, tag: str, name: str, noise: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(name)
        self.noise.append(noise)
        self.key.append(key_of(f"{self.key[parent] if parent >= 0 else ''}/{name}"))
        self.children.append([])
        return len(self.parent) - 1

    def _read(self, page: str) -> None:
        stack = [self._add(-1, "", "", False)]
        tags = self.tag
        mains = 0  # open article and main elements
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    self.blocks.append((stack[-1], text))
                    self.children[stack[-1]].append("#")

        def pop(to: int) -> None:
            nonlocal mains
            flush()
            mains -= sum(tags[i] in MAIN for i in stack[to:])
            del stack[to:]

        at, end = 0, len(page)
        while at < end:
            m = TOKEN.match(page, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    pieces.append(entities.unescape(m[0]) if "&" in m[0] else m[0])
                continue
            tag = tag.lower()
            if tag == "br" or tag == "hr":
                pieces.append(" ") if tag == "br" else flush()
                continue
            if tag in VOID:
                continue
            block = tag in BLOCK or tag in NOISE
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        pop(k)
                        break
                    # An inline or inner element must not close what stands around it.
                    if tags[stack[k]] in ("td", "th", "li", "article", "main", "body") and not block:
                        break
                else:
                    if tag == "p":
                        flush()
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            names, noise = marked(m[3])
            if block:
                flush()
                if tag in CLOSES_P and tags[stack[-1]] == "p":
                    pop(len(stack) - 1)
                if tag in ENDS:
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] in ENDS[tag]:
                            pop(k)
                            break
                        if tags[stack[k]] in ("ul", "ol", "dl", "table", "article", "main", "body"):
                            break
            elif not noise:
                continue  # inline elements have no part in the tree, unless as noise
            else:
                flush()
            if m[3].endswith("/") and not block or len(stack) > DEEPEST:
                continue
            if tag in ("html", "body") and len(stack) > 1 and any(tags[i] == tag for i in stack):
                continue
            # The header of an article is a part of it like others.
            noise = (noise and tag not in ("html", "body")) or (tag in NOISE and not (tag == "header" and mains))
            name = f"{tag}.{names}" if names else tag
            self.children[stack[-1]].append(name)
            stack.append(self._add(stack[-1], tag, f"{name}!" if noise else name, noise))
            mains += tag in MAIN
        flush()

    def _inside(self) -> None:
        """main (whether the page marks a main part), outside[i] (beside it, neither in it nor around it)
        and own (key of the text that markup alone takes for the main text)."""
        n = len(self.parent)
        gone = self.below(self.noise)
        size = [0] * n
        for i, text in self.blocks:
            if not gone[i]:
                size[i] += len(text)
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        tops = [i for i in range(n) if self.tag[i] in MAIN and not gone[i] and size[i]]
        inside_of: dict[str, list[bool]] = {t: self.below([self.tag[i] == t and not gone[i] and size[i] > 0 for i in range(n)]) for t in MAIN}
        # Articles that hold most of a main element's text are the main part, else that element is.
        held = sum(size[i] for i in tops if self.tag[i] == "article" and not inside_of["article"][self.parent[i]] and inside_of["main"][i])
        whole = sum(size[i] for i in tops if self.tag[i] == "main" and not inside_of["main"][self.parent[i]])
        if 2 * held >= whole:
            inside = inside_of["article"] if any(inside_of["article"]) else inside_of["main"]
        else:
            inside = [a or b for a, b in zip(inside_of["article"], inside_of["main"], strict=True)]
        self.main = any(inside)
        around = [False] * n
        for i in range(n - 1, 0, -1):
            around[self.parent[i]] |= inside[i] or around[i]
        self.outside = [self.main and not inside[i] and not around[i] for i in range(n)]
        self.own = key_of(" ".join(t for i, t in self.blocks if not gone[i] and not self.outside[i]))

    def below(self, flags: list[bool]) -> list[bool]:
        """Of each element, whether it or one around it is flagged."""
        out = list(flags)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def path(self, i: int) -> list[int]:
        out = []
        while i >= 0:
            out.append(self.key[i])
            i = self.parent[i]
        return out[::-1]

    def text(self, low: set[int]) -> str:
        """The texts of the blocks that are in no branch of `low`."""
        gone = self.below([k in low for k in self.key])
        return " ".join(t for i, t in self.blocks if not gone[i])

    def facts(self) -> dict[tuple[int, int, int], int]:
        """(key, kind, content) of what the page says of its nodes, with an element that says it.
        Kinds: 0 a content, 1 a presentation, 2 one beside the main part."""
        out = {(self.key[i], 0, key_of(text)): i for i, text in self.blocks}
        shown: dict[tuple[int, int], list[str]] = {}
        at: dict[tuple[int, int], int] = {}
        for i, k in enumerate(self.key):
            of = (k, 2 if self.outside[i] else 1)
            shown.setdefault(of, []).append(",".join(self.children[i]))
            at.setdefault(of, i)
        return out | {(*of, key_of("\n".join(c))): at[of] for of, c in shown.items()}


FACTS = "host string, path array<long>, noise boolean, main boolean, kind int, content long, page long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in FACTS.split(", ")]
    for part in (p for whole in batches for p in slices(whole, "html", 256)):
        out: list[list] = [[] for _ in kinds]
        for url, text in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
            page, host = Page(text or ""), host_of(url)
            noise = page.below(page.noise)
            for (_, kind, content), i in page.facts().items():
                for to, value in zip(out, (host, page.path(i), noise[i], page.tag[i] in MAIN, kind, content, page.own), strict=True):
                    to.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def _texts(payload: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, column, 256)):
            texts = [Page(page or "").text(set(low or ())) for page, low in zip(part.column(column).to_pylist(), part.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in payload), pa.array(texts, pa.string())], names=[*payload, "html_text"])

    return run


def style_trees(pages: DataFrame) -> tuple[DataFrame, str]:
    """The folder of a table written, and of it host, path (keys of a node and those above it), noise, main, pages (m), outside (share of its pages on
    which it is beside the main part) and importance, of the nodes that hold a text."""
    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lean(_facts), FACTS)
    node = ["host", "path", "noise", "main"]
    held = found.distinct().groupBy(*node, "kind", "content").agg(F.count("*").alias("k"))
    shown, ln_k = F.when(F.col("kind") > 0, F.col("k")), F.ln("k")
    # Sums are enough for both entropies, so hot nodes are added up before they move.
    nodes = held.groupBy(*node).agg(
        F.sum(shown).alias("m"), F.count(shown).alias("l"), F.sum(shown * ln_k).alias("presentations"), F.sum(F.when(F.col("kind") == 2, F.col("k"))).alias("beside"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("n"), F.sum(F.when(F.col("kind") == 0, ln_k)).alias("contents"),
    )
    nodes = nodes.withColumn("entropy", F.when(F.col("m") > 1, F.coalesce("contents", F.lit(0.0)) / F.ln("m")).otherwise(0.0))
    nodes, folder = written(nodes, "nodes")
    branches = nodes.select("host", F.explode("path").alias("key"), "n", "entropy").groupBy("host", "key").agg(F.sum("n").alias("all"), F.sum("entropy").alias("entropies")).where(F.col("all") > 0)
    joined = nodes.withColumn("key", F.element_at("path", -1)).join(branches, ["host", "key"])
    diverse = F.when(F.col("m") == 1, 0.5).when(F.col("l") == 1, 0.0).otherwise((F.ln("m") - F.col("presentations") / F.col("m")) / F.ln("l"))
    same = F.pow(F.lit(DAMPING), F.col("l"))
    importance = F.when(F.col("n") > 0, 1 - F.col("entropy") / F.col("n")).otherwise((1 - same) * diverse + same * (1 - F.col("entropies") / F.col("all")))
    trees = joined.select(*node, F.col("m").alias("pages"), (F.coalesce("beside", F.lit(0)) / F.col("m")).alias("outside"), importance.alias("importance"))
    return trees, folder


def removed_branches(trees: DataFrame, least: float = LEAST) -> DataFrame:
    """host and low: keys of the topmost nodes whose branches hold no node that is content with a likelihood of `least`."""
    told = (F.col("importance") * F.col("pages") + EVIDENCE / 2) / (F.col("pages") + EVIDENCE)
    told = F.greatest(F.least(told, F.lit(1 - BOUND)), F.lit(BOUND))
    prior = F.when(F.col("noise"), NOISE_PRIOR).when(F.col("main"), MAIN_PRIOR).otherwise(F.lit(PLAIN_PRIOR) + (NOISE_PRIOR - PLAIN_PRIOR) * F.col("outside"))
    odds = told / (1 - told) * prior / (1 - prior)
    best = trees.select("host", F.explode("path").alias("key"), (odds / (1 + odds)).alias("likely")).groupBy("host", "key").agg(F.max("likely").alias("likely")).where(F.col("likely") < least)
    low = trees.withColumn("key", F.element_at("path", -1)).join(best, ["host", "key"]).select("host", "key", F.slice("path", 1, F.size("path") - 1).alias("above"))
    inner = low.select("host", "key", F.explode("above").alias("over")).join(low.select("host", F.col("key").alias("over")), ["host", "over"], "left_semi").select("host", "key").distinct()
    return low.select("host", "key").join(inner, ["host", "key"], "left_anti").groupBy("host").agg(F.collect_list("key").alias("low"))


def extracted(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """`pages` (url, html; other columns stay) with main_text, the article of each page: the blocks
    that are in no branch removed, in page order, white space within a block made one space,
    joined by one space. At `least` 0 nothing is removed.

    A null or empty html gives ''; a null url, or one without a host, belongs to the host ''.
    Character references are decoded once. Broken markup is read as browsers would mostly: open
    elements end with what is around them. Scripts, styles and the like are no text. Repeated rows
    give repeated results, and count as one page. On a host of few pages markup decides, as the
    tree has little to say. No pages give no rows. A column main_text comes back as main_text_input.
    """
    door = Door(pages, ("main_text",))
    url, text = F.col(door.of("url")).cast("string"), door.string("html", "html_whole")
    trees, nodes_path = style_trees(door.rows.select(url.alias("url"), F.col(text).alias("html")))
    trees, trees_path = written(trees, "trees")
    low, _ = written(removed_branches(trees, least), "low")
    removed(door.spark, nodes_path, trees_path)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST.pattern, 1))
    joined = door.rows.withColumn("host", host).join(low, "host", "left").select(*door.rows.columns, "low")
    return door.out(joined.mapInArrow(lean(_texts(door.own, text)), door.schema("html_text string")), F.col("html_text").alias("main_text"))


def digested(rows: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of the rows of `extracted`."""
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
