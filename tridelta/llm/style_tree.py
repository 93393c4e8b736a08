"""Main text of web pages with a site style tree.

Pages of one host are merged by the paths of their elements (tag and class or
id from the root down). Below a path stand its presentations (the sequences of
its children) with the children of each, and as leaves what elements hold
themselves: neighbouring words, links and images. A leaf's importance is one less
the mean entropy of what it holds, to the base of the number of pages, each
feature by the pages that have it: what most pages share tells little, though a
date or a name in it varies. That of an inner element is composed from below:
with l presentations, (1 - gamma ** l) times the entropy of the presentations
and gamma ** l times the mean importance of the children, by the share of the
presentation that has them. A branch is taken out of the pages if it and all that
lies below it are of low importance. Pages of equal main text count once. A block
of main text (below) is one feature, its digest.

Before that, what marks itself as no part of an article goes: scripts, styles,
navigation, page headers, footers, asides, forms, dialogs, hidden elements and
those whose class, id or role says so (adverts, menus, sidebars, notices,
reader comments): a whole token of it is such a name or a known compound, apart
from digits. A name alone takes out no html, body or main, no article that is
not within another one, nothing that holds main and, but for reader comments,
nothing that holds an article with more text than the rest of the page. If a page has an article or main element, its text is what
stands inside; plain paragraphs, headings and lists of it are never taken for
template text, however often copies repeat them. Nor is, on any page, what holds
more than half of the shown text, whatever its name, with the plain paragraphs,
headings and lists in the innermost such element: a page with hardly any text of
its own keeps a longer notice rather than that a text is lost.

Character references are decoded, white space within a block becomes one
space, and blocks stand in page order, one to a line. Nothing is cut off.

The tree is counted with partial sums by host, path and feature, so a host with
a third of all pages is spread; importance goes up to all ancestors of a path at
once, as the product of weights between two elements is a quotient of two from
the root. Only the unimportant paths are handed to the pages, by broadcast if their measured size allows, else by a join on the host.

Null and empty html: empty text. Null urls, or urls without a host: no site,
so no style tree is applied. Repeated rows are extracted alike, very long pages
whole, one at a time. An empty table gives an empty one. Other columns
of the input are kept in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tridelta.session import broadcast_if_small

from .common import map_arrow, small_batches, store

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# --- fixed values: element classes of HTML and names that sites give to other than main text ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table article section div main body html td th".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure "
                    "figcaption section div".split())
TEXT_TAGS = CONTENT - {"section", "div", "figure"}
NO_TEXT = frozenset("script style noscript template iframe object embed svg math canvas head title nav footer aside form button "
                    "select textarea input dialog menu noembed noframes xmp audio video".split())
NO_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments respond reply replies disqus discussion widget pagination pager toc skip search contentinfo complementary "
    "dialog alertdialog "
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper google-ad top-ad sponsored-content promo-box side-bar "
    "main-nav main-navigation nav-bar nav-links nav-menu page-nav post-navigation primary-nav secondary-nav site-nav "
    "site-navigation top-nav main-menu primary-menu secondary-menu site-menu top-menu side-menu mobile-menu menu-container "
    "site-footer page-footer footer-menu footer-widgets widget-area sidebar-widget cookie-banner cookie-bar cookie-consent "
    "cookie-notice gdpr-banner newsletter-form newsletter-signup subscribe-form share-bar share-buttons share-links "
    "sharing-buttons social-icons social-links social-media social-share related-articles related-content related-links "
    "related-posts recommended-posts comment-form comment-list comments-area comments-list comment-respond comments-section "
    "skip-link skip-to-content search-box search-form toc-container breadcrumb-trail page-numbers".split())
HEAD_NAMES = frozenset("header site-header page-header masthead-header".split())
COMMENT_NAMES = frozenset("comment comments respond reply replies disqus discussion comment-form comment-list comments-area "
                          "comments-list comment-respond comments-section".split())
NOT_IN_TREE = frozenset("html body head meta link title script style base".split())


class Element:
    __slots__ = ("tag", "name", "path", "parent", "children", "dropped", "named", "inside", "plain")

    def __init__(self, tag: str, names: str, parent: "Element | None", dropped: bool, named: frozenset[str] | set[str] = frozenset()):
        self.tag, self.parent = tag, parent
        self.named = named  # what its class, id or role says against it
        self.path = (parent.path + ">" if parent and parent.path else "") + tag + names
        self.name = tag + names
        self.children: list[str] = []
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        # inside an article and reached through nothing but unnamed content elements
        self.plain = bool(parent) and (parent.plain if parent.inside else parent.tag in ("article", "main")) \
            and tag in CONTENT and not names


def _names(attributes: dict[str, str]) -> set[str]:
    return {w for a in ("class", "id", "role") for w in re.split(r"[^a-z]+", attributes.get(a, "").lower()) if w}


def _tokens(attributes: dict[str, str]) -> set[str]:
    """Whole tokens of class, id and role, digits and signs apart."""
    return {re.sub(r"[^a-z]+", "-", w).strip("-") for a in ("class", "id", "role") for w in attributes.get(a, "").lower().split()}


class Page:
    """Elements in order and text blocks of a page: (element, text)."""

    def __init__(self, source: str, names: bool = True):
        """Without ``names``, no class, id or role drops anything."""
        self.root = Element("", "", None, False)
        self.names = names
        self.references: list[tuple[Element, str]] = []  # links and images
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self._open = [self.root]
        self._text: list[str] = []
        self._parse(source)
        self._drop_named()
        self.has_article = any(e.tag in ("article", "main") and not e.dropped for e in self.elements)
        self._mark_main()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text = []
            if text:
                self.blocks.append((self._open[-1], text))

    def _close(self, tags: set[str] | frozenset[str], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of ``tags``, not beyond ``within``."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self._open[k].tag
            if tag in tags:
                self._flush()
                del self._open[k:]
                return
            if tag in within:
                return

    def _parse(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = MARKUP.search(source, at)
            if m is None:
                self._text.append(source[at:])
                break
            if m.start() > at:
                self._text.append(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue  # comment, doctype, processing instruction
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    self._close({tag})
                continue
            if tag in INLINE:
                if tag == "br":
                    self._text.append(" ")
                elif tag in ("a", "img"):
                    own = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(m[3])}
                    target = own.get("href" if tag == "a" else "src")
                    if target:
                        self.references.append((self._open[-1], tag + " " + target))
                continue
            if tag in CLOSES_P:
                self._close({"p"}, SCOPES)
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], SCOPES - SIBLINGS[tag])
            self._flush()
            own = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
            names = _names(own)
            parent = self._open[-1]
            in_article = any(e.tag in ("article", "main") for e in self._open)
            dropped = (tag in NO_TEXT or "hidden" in own or own.get("aria-hidden") == "true"
                       or "display:none" in own.get("style", "").replace(" ", "").lower()
                       or (not in_article and tag == "header"))
            named = _tokens(own) & (NO_TEXT_NAMES if in_article else NO_TEXT_NAMES | HEAD_NAMES) if names and self.names else frozenset()
            if tag in ("html", "body", "main") or (tag == "article" and not any(e.tag == "article" for e in self._open)):
                named = frozenset()
            element = Element(tag, "".join("." + n for n in sorted(names)), parent, dropped, named)
            if not parent.children or parent.children[-1] != tag:  # runs of equal children count once
                parent.children.append(tag)
            self.elements.append(element)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not m[3].rstrip().endswith("/"):
                self._open.append(element)
        self._flush()

    def _drop_named(self) -> None:
        """Drop what its name says against, but not what holds the article."""
        if not any(e.named for e in self.elements):
            return
        hard = {e for e in self.elements if e.dropped}
        named: set[Element] = set()  # those that a name drops, with all below
        comments: set[Element] = set()
        for e in self.elements:
            if e.named or e.parent in named:
                named.add(e)
            if e.named & COMMENT_NAMES or e.parent in comments:
                comments.add(e)
        mains = [e for e in self.elements if e.tag == "main" and e not in hard]
        held = mains
        if not mains:
            articles = [e for e in self.elements if e.tag == "article" and not e.inside and e not in hard and e not in comments]
            if articles and all(e in named for e in articles):
                rest = sum(len(text) for e, text in self.blocks if e not in named and e not in hard)
                inside = set(articles)
                for e in self.elements:
                    if e.parent in inside and not e.named and e not in hard:
                        inside.add(e)
                if sum(len(text) for e, text in self.blocks if e in inside) > rest:
                    held = articles
        kept: set[Element] = set()
        for e in held:
            node = e.parent
            while node is not None and node not in kept:
                kept.add(node)
                node = node.parent
        for e in self.elements:
            e.dropped = e.dropped or e.parent.dropped or (bool(e.named) and e not in kept)

    def _shown(self) -> Iterator[tuple[Element, str]]:
        for e, text in self.blocks:
            if not e.dropped and (not self.has_article or e.inside or e.tag in ("article", "main")):
                yield e, text

    def _mark_main(self) -> None:
        """What holds more than half of the shown text is main text, and so are
        the unnamed content elements of the innermost such element."""
        below: dict[Element, int] = {}
        total = 0
        for e, text in self._shown():
            total += len(text)
            while e is not None:
                below[e] = below.get(e, 0) + len(text)
                e = e.parent
        main = [e for e in self.elements if 2 * below.get(e, 0) > total]  # one branch, from the root down
        core = next((e for e in reversed(main) if e.tag not in TEXT_TAGS), None)
        for e in main:
            e.plain = True
        for e in self.elements:
            if not e.plain and e.tag in CONTENT and "." not in e.path.rpartition(">")[2]:
                e.plain = e.parent is core or (e.parent.plain and e.parent not in main)

    def body(self) -> str:
        """The text by which copies of a page are known: that of its article, or
        of paragraphs, headings, lists and tables if most of its text is there."""
        shown = list(self._shown())
        if not self.has_article:
            content = [(e, text) for e, text in shown if e.tag in TEXT_TAGS]
            if 2 * sum(len(text) for _, text in content) > sum(len(text) for _, text in shown):
                shown = content
        return "\n".join(text for _, text in shown)

    def lines(self, unimportant: frozenset[str] = frozenset()) -> list[str]:
        out = []
        for element, text in self._shown():
            node, low = element, not element.plain and element.tag not in ("article", "main") and f"{element.path}>{LEAF}" in unimportant
            while node is not None and not low:
                low = not node.plain and node.tag not in ("article", "main") and node.path in unimportant
                node = node.parent
            if not low:
                out.append(text)
        return out

    def features(self) -> Iterator[tuple[str, int, bytes, list[str] | None]]:
        """(path, kind, digest, children) of what is shown. Kind 0: an element's
        presentation, with the children that hold anything; kind 1: something a
        leaf holds (its path ends in LEAF); kind 2: that the page has the path."""
        held: dict[Element, set[bytes]] = {}
        for e, text in self._shown():
            words = text.split()
            if e.plain or len(words) < 2:
                held.setdefault(e, set()).add(_digest(text))
            else:
                held.setdefault(e, set()).update(_digest(f"{x} {y}") for x, y in zip(words, words[1:]))
        for e, target in self.references:
            if not e.plain and e in held:
                held[e].add(_digest(target))
        parts: dict[Element, list[str]] = {e: [LEAF] for e in held}
        for e in reversed(self.elements):  # children come after their parents
            if e in parts:
                parts.setdefault(e.parent, []).append(e.name)
        for e, features in held.items():
            if e.path:
                leaf = f"{e.path}>{LEAF}"
                yield leaf, 2, b"", None
                for feature in features:
                    yield leaf, 1, feature, None
        for e, children in parts.items():
            if e.path and e.tag not in NOT_IN_TREE:
                yield e.path, 2, b"", None
                yield e.path, 0, _digest(",".join(e.children)), sorted(set(children))


LEAF = "#"


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8]


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


FEATURES = "host string, path string, kind int, feature binary, children array<string>, page binary"


def tree_features(pages: DataFrame, url_col: str, html_col: str, names: bool = True) -> DataFrame:
    """FEATURES: the elements of every page of a site; page is the digest of its
    main text, so copies that differ in a counter or a tracking value are one page."""
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null and html <> ''")
    kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, rows=256):
            rows: dict[tuple, list[str] | None] = {}
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parsed = Page(text, names)
                page = _digest(parsed.body())
                rows.update(((host, path, kind, feature, page), children) for path, kind, feature, children in parsed.features())
            if rows:
                host, path, kind, feature, page = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip((host, path, kind, feature, list(rows.values()), page), kinds)],
                    ["host", "path", "kind", "feature", "children", "page"])

    return map_arrow(src, run, FEATURES)


def _ancestors(nodes: DataFrame) -> DataFrame:
    """``nodes`` once for each path above them and their own, in column above."""
    steps = F.expr("transform(sequence(1, size(split(path, '>'))), i -> array_join(slice(split(path, '>'), 1, i), '>'))")
    return nodes.withColumn("above", F.explode(steps))


def importance(features: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, path, pages, importance, highest): highest is the largest
    importance in the branch, the path's own included."""
    per_page = features.groupBy("host", "path", "kind", "feature", "page").agg(F.min("children").alias("children"))
    counts = store(per_page.groupBy("host", "path", "kind", "feature").agg(
        F.count("*").alias("n"), F.min("children").alias("children")), "style-counts")
    pages = counts.where("kind = 2").select("host", "path", F.col("n").alias("pages"))
    seen = counts.where("kind < 2").groupBy("host", "path", "kind").agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("n_log_n")).join(pages, ["host", "path"])
    # leaves: mean entropy of the features; elements: entropy of the presentations
    leaf = F.when(F.col("pages") > 1, 1 - F.col("n_log_n") / F.col("total") / F.log("pages")).otherwise(F.lit(1.0))
    look = F.when(F.col("pages") > 1, F.least(F.lit(1.0), (F.log("total") - F.col("n_log_n") / F.col("total")) / F.log("pages"))) \
        .otherwise(F.lit(1.0))
    nodes = store(seen.select(
        "host", "path", "kind", "pages", "total", (F.col("kinds") * F.log(F.lit(gamma))).alias("log_below"),
        F.when(F.col("kind") == 1, leaf).otherwise((1 - F.pow(F.lit(gamma), F.col("kinds"))) * look).alias("own")), "style-nodes")
    looks = counts.where("kind = 0").join(nodes.where("kind = 0").select("host", "path", "total", "log_below"), ["host", "path"])
    share = looks.select("host", F.col("n") / F.col("total") / F.size("children"), "log_below", "path", F.explode("children").alias("child")).toDF(
        "host", "share", "log_below", "parent", "child")
    step = share.groupBy("host", F.concat_ws(">", "parent", "child").alias("above")).agg(
        (F.log(F.sum("share")) + F.max("log_below")).alias("step"))
    # the weights' product from the root down to each path, as a sum of logarithms
    weight = _ancestors(nodes.select("host", "path", "own", "pages")).join(step, ["host", "above"], "left") \
        .groupBy("host", "path").agg(F.max("own").alias("own"), F.max("pages").alias("pages"), F.sum(F.coalesce("step", F.lit(0.0))).alias("weight"))
    weight = store(weight, "style-weights")
    up = _ancestors(weight).join(weight.select("host", F.col("path").alias("above"), F.col("weight").alias("weight_above")), ["host", "above"])
    up = up.groupBy("host", F.col("above").alias("path")).agg(F.sum(F.exp(F.col("weight") - F.col("weight_above")) * F.col("own")).alias("importance"))
    scored = store(up.join(weight.select("host", "path", "pages"), ["host", "path"]), "style-scores")
    highest = _ancestors(scored).groupBy("host", F.col("above").alias("path")).agg(F.max("importance").alias("highest"))
    return scored.join(highest, ["host", "path"]).select("host", "path", "pages", "importance", "highest")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None,
            low: float = 0.25, min_pages: int = 5, names: bool = True) -> DataFrame:
    """row, text, n_chars (code points) and n_template (blocks that the style
    tree takes out) of every page. Without ``names``, the tree works alone, with
    no list of class names before it."""
    keep = pages.columns if keep is None else keep
    tree = importance(tree_features(pages, url_col, html_col, names))
    bad = tree.where((F.col("highest") < low) & (F.col("pages") >= min_pages))
    sites = store(bad.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths")), "style-sites")
    size = sites.select(F.count("*").alias("n"), F.sum(F.length(F.concat_ws("", "paths")) + 16 * F.size("paths")).alias("bytes")).head()
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host"))
    sites = broadcast_if_small(sites, size["n"], 64 + int(size["bytes"] or 0) // max(1, size["n"]))
    rows = rows.join(sites, "host", "left").select("row", "html", "paths")
    schema = StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_template", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, rows=256):
            texts, taken = [], []
            for source, paths in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                page = Page(source, names) if source else None
                lines = page.lines(frozenset(paths or ())) if page else []
                texts.append("\n".join(lines))
                taken.append(len(page.lines()) - len(lines) if page and paths else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(taken, pa.int64())], ["row", "text", "n_template"])

    return map_arrow(rows, run, schema).select("row", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
