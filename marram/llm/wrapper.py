"""HTML extraction by union-free regular-expression inference.

Pages of a host are token streams of tags and text. A wrapper is a regular expression without unions over them: elements,
each perhaps optional (?) or repeated (+), with constant texts and text slots at the leaves. It begins as a page; each
further page is aligned with it: tags that only one side has become optional, equal neighbours and elements that come again
fold into repeated ones, differing texts become a slot. The wrapper says which element holds the article, by where text
differs from page to page, and which constant texts in it are template. A page is read by aligning it with the wrapper of
its host: every element of the page gets its place in the wrapper, and the texts at places of the article come out.

No step recurs, so pages may be nested to any depth.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, n_buckets, skew_join, written

#: Characters of wrappers that are broadcast at most; beyond that pages are joined to them, those of hot hosts in place.
MOST_BROADCAST = 32_000_000
#: A text on all of at least so many pages of a host may be template; how much constant text weighs as a sign of an article.
LEAST_PAGES, CONSTANT_WEIGHT = 3, 0.2
#: Names of elements and parts of their class, id and role. Fixed values of HTML and of habit.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
AWAY = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head")
AWAY_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "reply", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary", "contentinfo", "search")
ARTICLE = ("article", "main")
ARTICLE_WORDS = ("article", "body", "content", "entry", "main", "post", "story", "text")
#: End tags that an element's start tag implies.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
#: Elements without a meaning of their own: without a class or id they are told apart by where they stand.
GENERIC = ("div", "section", "center", "fieldset")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that a paragraph can't hold.
BREAKS_P = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul")
#: Elements that implied end tags don't reach out of.
SCOPES = ("table", "ul", "ol", "dl", "td", "th", "article", "section", "div", "main", "body", "html", "blockquote", "select", "nav", "aside", "footer", "header", "form")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_KEYS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


def label_of(name: str, attributes: str) -> str:
    """What aligns: the name with class, id and role, figures out of them."""
    keys = [v.strip("\"'") for _, v in _KEYS.findall(attributes)] if attributes else []
    return name + ("." + re.sub(r"\d+", "", " ".join(keys)).strip().lower() if keys else "") + ("!" if attributes and _HIDDEN.search(attributes) else "")


def away(label: str) -> bool:
    """Whether an element isn't part of an article by its name, its class, id or role, or as it is hidden."""
    name, _, keys = label.partition(".")
    if label.endswith("!") or name.rstrip("!") in AWAY:
        return True
    return name not in (*ARTICLE, "body", "html") and any(w in AWAY_WORDS for w in _WORDS.findall(keys))


class Node:
    """An element of a page, or with the label # one of its texts."""

    __slots__ = ("label", "kids", "text", "links")

    def __init__(self, label: str, text: str = "", links: int = 0):
        self.label, self.kids, self.text, self.links = label, [], text, links


def page_tree(html: str) -> Node:
    """A page as elements and blocks of text with white space folded; links are the characters of a block in links."""
    root = Node("")
    path: list[tuple[str, Node]] = [("", root)]
    open_names: Counter = Counter()
    text: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                path[-1][1].kids.append(Node("#", whole, min(links, len(whole))))
            text.clear()
        links = 0

    def pop(name: str, stops: tuple[str, ...] = ()) -> None:
        if not open_names[name]:
            return
        for k in range(len(path) - 1, 0, -1):
            if path[k][0] == name:
                open_names.subtract(n for n, _ in path[k:])
                del path[k:]
                return
            if path[k][0] in stops:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in INLINE:
            in_link = (not end) if name == "a" else in_link
            text.append(" " if name == "br" else "")
            continue
        flush()
        in_link = 0 if name != "hr" else in_link
        if end:
            pop(name)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close.end() if close else n
            continue
        for other in CLOSES.get(name, ()):
            pop(other, tuple(x for x in SCOPES if x != other))
        if name in BREAKS_P:
            pop("p", SCOPES)
        if name not in VOID and not attributes.endswith("/"):
            node = Node(label_of(name, attributes))
            path[-1][1].kids.append(node)
            path.append((name, node))
            open_names[name] += 1
    flush()
    return root


class Place:
    """An element of a wrapper. constant is the hash of its texts, None of a slot; pages counts where it came; chars and links
    add up its text; mark is "in" at the article, "out" at template."""

    __slots__ = ("key", "optional", "repeated", "pages", "constant", "kids", "chars", "links", "mark")

    def __init__(self, key: str):
        self.key, self.optional, self.repeated, self.pages, self.constant, self.kids, self.chars, self.links, self.mark = key, False, False, 1, None, [], 0, 0, ""


def key_of(node: Node) -> str:
    """What aligns: the label; elements without a meaning by their first element too."""
    if node.label in GENERIC:
        first = next((k.label for k in node.kids if k.label != "#"), "")
        return f"{node.label}/{first}" if first else node.label
    return node.label


def by_place(key: str) -> bool:
    """Whether equal elements apart from each other are different places, rather than one that is repeated."""
    return key.split("/")[0] in GENERIC


def runs(keys: list[str]) -> list[tuple[str, list[int]]]:
    """The sequence as (key, positions): neighbours are one run, and so are all of a key that isn't told apart by place."""
    out: list[tuple[str, list[int]]] = []
    seen: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if out and out[-1][0] == k:
            out[-1][1].append(i)
        elif k in seen and not by_place(k):
            seen[k].append(i)
        else:
            out.append((k, [i]))
            seen[k] = out[-1][1]
    return out


def aligned(a: list[str], b: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Pairs of positions, in order; None where one side has nothing."""
    if a == b:
        yield from ((i, i) for i in range(len(a)))
        return
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            yield from zip(range(i, j), range(k, m), strict=True)
        else:
            yield from ((x, None) for x in range(i, j))
            yield from ((None, y) for y in range(k, m))


def join(into: Place, other: Place, same_page: bool = False) -> Place:
    """Align other with into and take it over: what only one has becomes optional, differing texts become a slot.

    On the same page into becomes repeated, and its texts are one after another: their hashes are hashed together.
    """
    todo = [(into, other, same_page)]
    into.repeated = into.repeated or same_page
    while todo:
        a, b, same = todo.pop()
        if same and a.constant is not None and b.constant is not None:
            a.constant = xxhash.xxh64_intdigest(f"{a.constant} {b.constant}")
        else:
            a.constant = a.constant if a.constant == b.constant else None
        a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
        a.pages = max(a.pages, b.pages) if same else a.pages + b.pages
        a.chars, a.links = a.chars + b.chars, a.links + b.links
        if not (a.kids or b.kids):
            continue
        kids: list[Place] = []
        once: dict[str, Place] = {}
        for i, k in aligned([x.key for x in a.kids], [y.key for y in b.kids]):
            if i is not None and k is not None:
                todo.append((a.kids[i], b.kids[k], same))
                own = a.kids[i]
            else:
                own = a.kids[i] if i is not None else b.kids[k]
                own.optional = True
            if own.key in once and not by_place(own.key):
                once[own.key].repeated = True
                todo.insert(0, (once[own.key], own, True))  # after both are whole
            else:
                once[own.key] = own
                kids.append(own)
        a.kids = kids
    return into


def wrapper_of(root: Node) -> Place:
    """A page as a wrapper: runs are folded into repeated elements, children before their parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    made: dict[int, Place] = {}
    for node in reversed(order):
        place = Place(key_of(node))
        if node.label == "#":
            place.constant, place.chars, place.links = xxhash.xxh64_intdigest(node.text), len(node.text), node.links
        for _, at in runs([key_of(k) for k in node.kids]):
            first = made.pop(id(node.kids[at[0]]))
            for i in at[1:]:
                join(first, made.pop(id(node.kids[i])), True)
            place.kids.append(first)
        made[id(node)] = place
    return made[id(root)]


def preorder(root: Place) -> list[tuple[Place, int]]:
    """Places with the position of their parent, parents first."""
    out, todo = [], [(root, -1)]
    while todo:
        place, parent = todo.pop()
        out.append((place, parent))
        todo += [(k, len(out) - 1) for k in reversed(place.kids)]
    return out


def packed(root: Place) -> str:
    return json.dumps([[p.key, int(p.optional), int(p.repeated), p.pages, p.constant, p.chars, p.links, p.mark, parent] for p, parent in preorder(root)], separators=(",", ":"))


def unpacked(text: str) -> Place:
    made: list[Place] = []
    for key, optional, repeated, pages, constant, chars, links, mark, parent in json.loads(text):
        p = Place(key)
        p.optional, p.repeated, p.pages, p.constant, p.chars, p.links, p.mark = bool(optional), bool(repeated), pages, constant, chars, links, mark
        made.append(p)
        if parent >= 0:
            made[parent].kids.append(p)
    return made[0]


def expression(root: Place) -> str:
    """The wrapper as a union-free regular expression."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        after = "+" * x.repeated + "?" * x.optional
        if x.key == "#":
            out.append(("#TEXT" if x.constant is None else "#CONSTANT") + after)
            continue
        out.append(("(" if after else "") + (f"<{x.key}>" if x.key else ""))
        todo.append(("</>" if x.key else "") + (")" + after if after else ""))
        todo += reversed(x.kids)
    return "".join(out)


def marked(root: Place) -> Place:
    """Mark the article and the template in it.

    The article is the element of the best claim: named as one or, else, with the most text outside of links in itself and
    its children. Text that is the same on LEAST_PAGES pages counts little; elements that are away by name count nothing.
    Template are constant texts in an element without a meaning of its own that has no slot, if all of them together are
    less than half of the text in the article's slots: pages that differ in a few words are copies, their text no template.
    """
    order = preorder(root)
    gone = [False] * len(order)
    own, total, direct = [0.0] * len(order), [0.0] * len(order), [0.0] * len(order)
    for i, (p, parent) in enumerate(order):
        p.mark = ""
        gone[i] = (parent >= 0 and gone[parent]) or bool(p.key and p.key != "#" and away(p.key.split("/")[0]))
        if p.key == "#" and not gone[i]:
            own[i] = max(0.0, p.chars - 2.0 * p.links) * (CONSTANT_WEIGHT if p.constant is not None and p.pages >= LEAST_PAGES else 1.0)
    for i in range(len(order) - 1, -1, -1):
        total[i] += own[i]
        parent = order[i][1]
        if parent >= 0:
            total[parent] += total[i]
            if order[i][0].key == "#":
                direct[parent] += own[i]
                if order[parent][1] >= 0:
                    direct[order[parent][1]] += own[i]
    best, claim_best = -1, 0.0
    for i, (p, _) in enumerate(order):
        if gone[i] or p.key == "#":
            continue
        name, _, keys = p.key.split("/")[0].partition(".")
        claim = 3.0 if name in ARTICLE else 1.5 if set(_WORDS.findall(keys)) & set(ARTICLE_WORDS) else 1.0
        score = claim * (total[i] if claim > 1 else direct[i])
        if score > claim_best or score == claim_best > 0:  # of equal ones the innermost, which comes later
            best, claim_best = i, score
    if best < 0:
        return root
    order[best][0].mark = "in"
    inside, slots, holder, slotted = {best}, 0, {best: -1}, set()
    constants: list[int] = []
    for i in range(best + 1, len(order)):
        p, parent = order[i]
        if parent not in inside:
            continue
        if gone[i]:
            continue
        inside.add(i)
        name = p.key.split("/")[0].partition(".")[0]
        holder[i] = -1 if name in HEADINGS else i if name in GENERIC else holder[parent]
        if p.key == "#":
            if p.constant is None or p.pages < LEAST_PAGES:
                slots += p.chars if p.constant is None else 0
                k = i
                while k > best:
                    slotted.add(k)
                    k = order[k][1]
            elif holder[i] >= 0:
                constants.append(i)
    constants = [i for i in constants if holder[i] not in slotted]
    if 2 * sum(order[i][0].chars for i in constants) < slots:
        for i in constants:
            order[i][0].mark = "out"
    return root


def text_by(root: Node, wrapper: Place) -> str | None:
    """The texts of a page at places of the article, one a line; None if the page has no place of it.

    Elements of the page that the wrapper hasn't are read as their neighbours are.
    """
    out: list[str] = []
    found = False
    todo: list[tuple[Node, Place | None, bool]] = [(root, wrapper, False)]
    while todo:
        node, place, inside = todo.pop()
        if node.label == "#":
            if inside and not (place is not None and place.mark == "out"):
                out.append(node.text)
            continue
        if node.label and away(node.label):
            continue
        if place is not None and place.mark == "in":
            inside = found = True
        if not inside and place is None:
            continue
        at: list[Place | None] = [None] * len(node.kids)
        if place is not None and place.kids:
            own = runs([key_of(k) for k in node.kids])
            for i, k in aligned([key for key, _ in own], [p.key for p in place.kids]):
                if i is not None and k is not None:
                    for j in own[i][1]:
                        at[j] = place.kids[k]
        todo += [(k, p, inside) for k, p in zip(reversed(node.kids), reversed(at), strict=True)]
    return "\n".join(out) if found else None


def main_text_of(html: str, wrapper: Place | None) -> str:
    """The text of a page by the wrapper of its host or, where that finds none, by one of the page alone."""
    root = page_tree(html)
    text = text_by(root, wrapper) if wrapper is not None else None
    if not text and root.kids:
        text = text_by(root, marked(wrapper_of(root)))
    return text or ""


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One wrapper for each run of rows with the same host and bucket, folded in the order of the rows."""
    at, whole = None, None
    for b in batches:
        for host, bucket, wrapper in zip(b["host"], b["bucket"], b["wrapper"], strict=True):
            if (host, bucket) != at:
                if at is not None:
                    yield pd.DataFrame({"host": [at[0]], "bucket": [at[1]], "wrapper": [packed(whole)]})
                at, whole = (host, bucket), unpacked(wrapper)
            else:
                join(whole, unpacked(wrapper))
    if at is not None:
        yield pd.DataFrame({"host": [at[0]], "bucket": [at[1]], "wrapper": [packed(whole)]})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper, expression): a row for each host, from all its pages. A url without a host counts as "".

    A page becomes a wrapper of its own, a kilobyte or two. The pages of a host are dealt by the hash of their html to
    buckets of about 1000, and folded in the order of their wrappers; the wrappers of the buckets, in order again, make that
    of the host. So the result doesn't depend on how rows are partitioned, and no task gets all pages of a large host.
    """
    rows = pages.select(_host(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > 1000)
    sizes = {r["host"]: n_buckets(r["n"]) for r in sizes.orderBy(F.desc("n"), "host").limit(1000).collect()}
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("host")), F.lit(1)) if sizes else F.lit(1)

    def page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "bucket": b["bucket"], "wrapper": [packed(wrapper_of(page_tree(h))) for h in b["html"]]})

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [marked(unpacked(w)) for w in b["wrapper"]]
            yield pd.DataFrame({"host": b["host"], "wrapper": [packed(w) for w in found], "expression": [expression(w) for w in found]})

    kinds = "host string, bucket int, wrapper string"
    parts = rows.select("host", F.pmod(F.xxhash64("html"), many).cast("int").alias("bucket"), "html").mapInPandas(page, kinds)
    parts = parts.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "wrapper").mapInPandas(_folded, kinds)
    parts = parts.withColumn("bucket", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInPandas(_folded, kinds)
    return parts.mapInPandas(done, "host string, wrapper string, expression string")


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with one more column, text: the article's blocks joined by line feeds; empty if a page has none.

    A block is what lies between tags that aren't inline; references are decoded, white space in a block becomes one space.
    A page whose elements don't fit its host's wrapper is read by a wrapper of its own. A null html is empty. Repeated rows
    each get their text; other columns stay as they are. Wrappers are broadcast if they have MOST_BROADCAST characters at
    most; else pages are joined to them, those of hot hosts where they are.
    """
    host, wrapper, out = fresh(pages, "_host", "_wrapper", "text")
    found = written(wrappers(pages, url_col, html_col).select(F.col("host").alias(host), F.col("wrapper").alias(wrapper)), "wrappers")
    rows = pages.withColumn(host, _host(url_col))
    small = (found.agg(F.sum(F.length(wrapper)).alias("n")).first()["n"] or 0) <= MOST_BROADCAST
    rows = rows.join(F.broadcast(found), host, "left") if small else skew_join(rows, found, host)

    @F.pandas_udf("string")
    def read(html: pd.Series, own: pd.Series) -> pd.Series:
        held: dict[str, Place] = {}
        texts = []
        for h, w in zip(html, own, strict=True):
            if w is not None and w not in held:
                held[w] = unpacked(w)
            texts.append(main_text_of(h, held.get(w)))
        return pd.Series(texts, dtype=object)

    return rows.withColumn(out, read(F.coalesce(F.col(html_col), F.lit("")), F.col(wrapper))).select(*[F.col(f"`{c}`") for c in pages.columns], out)
