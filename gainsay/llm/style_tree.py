"""HTML extraction with site style trees.

The pages of a host are merged into one tree of element paths.  Every path is measured over the pages that have it: how
varied its texts are (content) and how varied the elements below its parent are (presentation), both as entropies from 0, the
same on every page, to 1, different on each.  A path of low importance is decoration of the site and goes.  Elements that
HTML or their names declare as page furniture go in any case, since a small site cannot show that they repeat;
an article or main element always counts as important.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.llm.common import mapped, quoted
from gainsay.llm.url_filter import host_of
from gainsay.shared import staged

#: Share of content in importance, the importance below which a path goes, and the pages that are needed to tell.
CONTENT, LEAST, PAGES = 0.8, 0.3, 8
#: The largest table of paths to remove that is broadcast.
BROADCAST_ROWS = 100_000
#: Characters of an element's name that its path shows.
SHOWN = 40

# Roles of HTML elements and of the parts of class names and ids.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "xmp")
FURNITURE = ("nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head")
MAIN = ("article", "main")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
          "label", "mark", "nobr", "output", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
NAMES = ("ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
         "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
         "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share",
         "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget")
ROLES = ("alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search")
WITHOUT = ("has", "no", "with", "without")
#: First parts of the names by which an article is furniture all the same, and what stays in a head.
REMARKS = ("comment", "reply")
HEAD = ("html", "head", "base", "basefont", "bgsound", "link", "meta")
#: An open element that the start of another closes, unless one of the last group lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav", "footer", "header", "blockquote", "form")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[a-zA-Z!?/][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """An open element.  Paths are digests of the names from the root on, with the last name to read; what holds of all elements
    around is carried along, so nothing walks up the tree."""

    tag: str
    path: str
    furniture: int = 0      # elements from the root on that are declared furniture, and those of them that are plain forms
    forms: int = 0
    main: bool = False
    boxed: bool = False     # a named element lies between the nearest article or main and here
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """Text of one block: its path and its parent's, and whether it lies in declared furniture, in an article, in a form but no other
    furniture, or in a named box."""

    path: str
    text: str
    furniture: bool
    main: bool
    form: bool = False
    boxed: bool = False
    parent: str = ""


def declared(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    """Whether an element says that it is page furniture."""
    if tag in ("html", "body"):
        return False
    if tag in FURNITURE or (tag == "header" and not in_main) or "hidden" in attrs or attrs.get("role", "").lower() in ROLES:
        return True
    if tag == "main":
        return False
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        parts = re.split(r"[-_]+|(?<=[a-z])(?=\d)", name)
        if tag == "article" and parts[0] not in REMARKS:
            continue
        if not set(parts) & set(WITHOUT) and set(parts) & set(NAMES):
            return True
    return False


def form_holds_page(blocks: list[Block]) -> bool:
    """Whether the forms of a page hold its main text: its articles, or most of the text outside other furniture."""
    rest = [b for b in blocks if not b.furniture]
    inside, outside = [b for b in rest if b.form], [b for b in rest if not b.form]
    if any(b.main for b in rest):
        return not any(b.main for b in outside)
    return sum(len(b.text) for b in inside) > sum(len(b.text) for b in outside)


def parsed(page: str) -> tuple[list[Block], dict[str, str]]:
    """Blocks of text in page order, and for every path the elements below it (its presentation).

    Unclosed and cut-off elements are taken as far as they go; a cut-off tag, comment, script or style is dropped.
    """
    root = Element("", "")
    stack, blocks, text, styles = [root], [], [], {}
    at_tag: dict[str, list[int]] = {}                       # places in the stack of the open elements of a tag,
    at_scope: list[int] = []                                # of those that end the reach of a closing rule,
    at_block: list[int] = []                                # and of those that are not inline

    def flush() -> None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            i = at_block[-1] if at_block else 0
            top = stack[-1]
            form = top.furniture == 1 == top.forms
            blocks.append(Block(stack[i].path, joined, top.furniture > 0 and not form, top.main, form, stack[i].boxed, stack[i - 1].path if i else ""))

    def push(tag: str, name: str, furniture: bool, main: bool, form: bool = False) -> None:
        above = stack[-1]
        path = hashlib.blake2b(f"{above.path}/{name}".encode("utf-8", "replace"), digest_size=8).hexdigest() + "/" + name[:SHOWN]
        stack.append(Element(tag, path, above.furniture + furniture, above.forms + (furniture and form), above.main or main,
                             not tag.startswith(MAIN) and (above.boxed or "." in name)))
        for places in (at_tag.setdefault(tag, []), *([at_scope] if tag in SCOPES else []), *([at_block] if tag not in INLINE else [])):
            places.append(len(stack) - 1)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            if element.children:
                styles.setdefault(element.path, []).append(",".join(element.children))
            for places in (at_tag[element.tag], at_scope, at_block):
                if places and places[-1] == len(stack):
                    places.pop()

    def last(tags: tuple[str, ...], scoped: bool = True) -> int | None:
        at = max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=None)
        return None if at is None or scoped and at_scope and at_scope[-1] > at else at

    done = 0
    for token in _TOKEN.finditer(page):
        between = page[done:token.start()]
        done = token.end()
        tag = (token["tag"] or "").lower()
        # A head ends where text or an element of the body starts.
        if stack[-1].tag == "head" and (between.strip() or tag and not token["end"] and tag not in HEAD):
            pop_to(len(stack) - 1)
        text.append(between)
        if not tag:
            continue
        if tag in INLINE and tag != "br":
            if token["end"]:
                at = last((tag,))
                if at is not None and (not at_block or at_block[-1] < at):
                    flush()
                    pop_to(at)
                continue
            # Only inline elements named as furniture matter, and those that their end tag could be taken for.
            named = declared(tag, attributes(token["attrs"]), True)
            if named or (tag not in VOID and at_tag.get(tag)):
                flush()
                push(tag, tag, named, False)
            continue
        if tag == "br":
            text.append(" ")
            continue
        flush()
        if token["end"]:
            at = last((tag,), False)
            if at is not None:
                pop_to(at)
            continue
        if tag == "p" or tag in CLOSES:
            at = last(("p",) if tag == "p" else CLOSES[tag])
        else:
            at = last(("p",))
        if at is not None:
            pop_to(at)
        attrs = attributes(token["attrs"])
        in_main = stack[-1].main
        name = tag + "".join("." + c for c in sorted(set(attrs.get("class", "").lower().split())))
        stack[-1].children.append(name)
        if tag not in VOID:
            main = tag in MAIN or attrs.get("role", "").lower() == "main"
            form = tag == "form" and not declared("div", attrs, in_main)
            push(tag, name, declared(tag, attrs, in_main), main, form)
    if page[done:].strip() and stack[-1].tag == "head":
        pop_to(len(stack) - 1)
    text.append(page[done:].removesuffix("<"))
    flush()
    pop_to(1)
    if root.children:
        styles.setdefault(root.path, []).append(",".join(root.children))
    if any(b.form for b in blocks) and not form_holds_page(blocks):
        for b in blocks:
            b.furniture = b.furniture or b.form
    return blocks, {path: ";".join(seen) for path, seen in styles.items()}


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip() else {}


def kept(blocks: list[Block], removed: set[str]) -> list[str]:
    """Texts of the important blocks; a page with an article or main element gives nothing from outside it.

    Plain elements of an article are its text, also where a site repeats them; those in named boxes count by importance.
    """
    main = any(b.main and not b.furniture for b in blocks)
    return [b.text for b in blocks if not b.furniture and b.main == main and (b.path not in removed or main and not b.boxed)]


def importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path``, ``pages``, ``content``, ``presentation`` and ``importance`` of every path that holds text.

    A page counts once for a path, with all its texts there, and pages of a host that say the same outside declared furniture
    count as one.  The counts per text are combined before they meet by path, so a host with very many pages is no bottleneck.
    """
    def measure(cols: dict[str, list]) -> Iterator[tuple]:
        for host, page in zip(cols["host"], cols["html"]):
            blocks, styles = parsed(page or "")
            texts: dict[str, list[str]] = {}
            said = "\n".join(f"{b.path}\t{b.text}" for b in blocks if not b.furniture)
            same = int.from_bytes(hashlib.blake2b(said.encode("utf-8", "replace"), digest_size=8).digest(), signed=True)
            for b in blocks:
                texts.setdefault(b.path, []).append(b.text)
            parents = {b.path: b.parent for b in blocks}
            for path, found in texts.items():
                yield host, same, path, "\n".join(found), styles.get(parents[path], "")

    rows = mapped(pages.select(host_of(pages[quoted(url_col)]).alias("host"), pages[quoted(html_col)].alias("html")).where("html IS NOT NULL"),
                  measure, "host string, same long, path string, content string, style string")
    once = rows.groupBy(F.coalesce("host", F.lit("")).alias("host"), "path", "same").agg(
        F.min(F.xxhash64("content")).alias("content"), F.min(F.xxhash64("style")).alias("style"))
    hashed = once.select("host", "path", F.explode(F.array(
        F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")),
        F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")))).alias("v")).select("host", "path", "v.*")
    counts = hashed.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.when(F.col("m") > 1, F.log("m") - F.col("clogc") / F.col("m")).otherwise(0.0) / F.when(F.col("m") > 1, F.log("m")).otherwise(1.0)
    both = sums.withColumn("h", entropy).groupBy("host", "path").agg(
        F.max("m").alias("pages"), F.max(F.when(F.col("kind") == "content", F.col("h"))).alias("content"),
        F.max(F.when(F.col("kind") == "style", F.col("h"))).alias("presentation"))
    return both.withColumn("importance", CONTENT * F.col("content") + (1 - CONTENT) * F.col("presentation"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` (blocks in page order, two newlines between) of every row of ``pages``.

    A null or empty page, and one without important blocks, has an empty text.  Pages whose URL names no host share one
    tree.  Repeated rows and ids give a row each; other columns are ignored.
    """
    low = importance(pages, url_col, html_col).where((F.col("pages") >= PAGES) & (F.col("importance") < LEAST))
    low = staged(low.select("host", "path"))
    removed = low.groupBy("host").agg(F.collect_list("path").alias("paths"))
    if low.count() <= BROADCAST_ROWS:
        removed = F.broadcast(removed)
    rows = pages.select(pages[quoted(id_col)].alias("page_id"), pages[quoted(url_col)].alias("url"), pages[quoted(html_col)].alias("html"),
                        F.coalesce(host_of(pages[quoted(url_col)]), F.lit("")).alias("host"))

    def run(cols: dict[str, list]) -> Iterator[tuple]:
        for page_id, url, page, paths in zip(cols["page_id"], cols["url"], cols["html"], cols["paths"]):
            yield page_id, url, "\n\n".join(kept(parsed(page or "")[0], set(paths or ())))

    return mapped(rows.join(removed, "host", "left").select("page_id", "url", "html", "paths"), run,
                  f"page_id {pages.select(pages[quoted(id_col)]).schema[0].dataType.simpleString()}, url string, text string")
