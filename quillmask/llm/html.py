"""Main-text extraction from HTML by composite text density.

Each page becomes a tree; scripts, styles, what holds no text of its own, form controls and hidden elements leave it, nothing else does. For every block the characters per tag are weighed down by the share that stands in links; formatting markup is a part of its block's text.
What an element's tag, role or name says of its part on the page (a menu, a footer, an advert, readers' comments) is evidence: it multiplies the densities within by AGAINST, so that it decides where densities alone would not, as between an article and the remarks on it.

A node's density sum is the sum of its children's densities. The node with the largest sum is the article's core, and the smallest density on the way from it to the body is the threshold: on every level of that way, the siblings that reach it and are written in paragraphs, if the
article is, belong to it, with what stands between them, and with headings, paragraphs, lists and tables that adjoin them, however short, unless there is evidence against them. Link-dominated blocks don't belong to it. If nothing stands outside of the core, the core is the page,
and its own children are held against a threshold in the same way. Only where a way leads through an <article>, that element decides on the short blocks which the threshold leaves out. Within the article, blocks with evidence against them that stay below the threshold are left out.

Pages are independent: one pass, no shuffle. A null or empty page has an empty text, as has a page without text. Of equal sums the denser node counts, then the first. Repeated rows are answered each, an empty table gives no rows;
other columns are kept as they are, but for one of the name of the result, which is replaced. Very long pages, and elements nested to any depth, are read whole, in time that grows with the page, whatever its markup. Malformed markup gets a tree all the same: unknown
end tags are ignored, open elements end with their parent, and what is never closed reaches to the end.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements whose content is no page's text.
DROPPED = frozenset("script style noscript template iframe frame frameset svg canvas object applet audio video math head title button select option textarea input datalist map".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that say what part they have beside the article.
BESIDE = frozenset("nav aside footer form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names in class or id of what surrounds an article. The last word of a name says what a thing is, those of GENERIC aside.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notification alert disclaimer nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs sidebar sidebars side aside footer foot header masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist disqus replies reply "
    "respond responses talk popup modal overlay newsletter subscribe subscription signup login search pagination pager widget widgets skip hidden".split()
)
#: Words for a shape or a place, behind which stands what a thing is.
GENERIC = frozenset("list lists box boxes block blocks wrapper wrap container area section bar strip links link items item button buttons posts post stories form slot unit inner outer panel group row left right top bottom".split())
#: Names with one of these tell of what stands elsewhere.
ABSENT = frozenset("no without has with".split())
#: Of these an element may be the article's own.
HEADS = frozenset({"header", "masthead"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are text by themselves, so that they belong to what they adjoin.
TEXTY = HEADINGS | frozenset("p blockquote pre ul ol dl table figure header hgroup address details".split())
#: Blocks of which a name says nothing within the text.
WRITTEN = HEADINGS | frozenset("p blockquote pre dl table figure".split())
#: Last words of names of what readers say, and whole names of the same.
REMARKS = frozenset("comments commentlist disqus replies respond responses talk".split())
REMARK = frozenset({"comment", "reply"})
#: A heading of readers' remarks: a number and what they are.
_COUNTED = re.compile(r"\d+ [^\W\d]+|[^\W\d]+ \(\d+\)")
#: What evidence leaves of the densities within an element.
AGAINST = 0.01
#: A start tag of the key ends an open element of the value.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>""")
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.IGNORECASE) for name in RAW}


class Tree:
    """Nodes in page order, each after its parent: tag, attributes, parent, and content as strings and child numbers."""

    def __init__(self) -> None:
        self.tag, self.attrs, self.parent, self.content = ["#page"], [{}], [-1], [[]]
        self.stack = [0]
        #: for each tag where its open elements stand in the stack
        self.open: dict[str, list[int]] = {}

    def start(self, tag: str, attrs: dict) -> None:
        if tag not in INLINE:  # a block ends an open paragraph
            self.close(("p",), ("table", "td", "th", "button", "object", "li", "div", "article", "section", "body", "blockquote"))
        if tag in ENDS:
            self.close(ENDS[tag], SCOPES.get(tag, ("table",)))
        node = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self.stack[-1])
        self.content.append([])
        self.content[self.stack[-1]].append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        scope = ("p", "td", "th", "li", "div", "article", "section", "body") if tag in INLINE else ("td", "th") if tag in ("p", "li", "dd", "dt") else ()
        self.close((tag,), scope)

    def close(self, tags, scope) -> None:
        """End the innermost open element of the tags, with all within it, unless one of the scope (another tag) stands within it."""
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if at > max((self.open[t][-1] for t in scope if t not in tags and self.open.get(t)), default=0):
            for node in self.stack[at:]:
                self.open[self.tag[node]].pop()
            del self.stack[at:]

    def text(self, data: str) -> None:
        self.content[self.stack[-1]].append(references.unescape(data))


def parse(page: str) -> Tree:
    tree, at, last = Tree(), 0, page.rfind(">")
    while (to := page.find("<", at)) >= 0:
        if to > at:
            tree.text(page[at:to])
        at = to
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else len(page)
        elif page[at + 1 : at + 2] in ("!", "?") or (page[at + 1 : at + 2] == "/" and not page[at + 2 : at + 3].isalpha()):
            at = page.find(">", at) + 1 or len(page)
        elif at < last and (tag := _TAG.match(page, at)):
            at, name = tag.end(), tag["name"].lower()
            if tag["end"]:
                tree.end(name)
                continue
            rest = tag["rest"]
            tree.start(name, {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(rest)} if rest.strip(" /") else {})
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                tree.text(page[at : end.start() if end else len(page)])
                at = end.start() if end else len(page)
            elif rest.endswith("/") and name in ("svg", "path", "circle", "rect"):
                tree.close((name,), ())
        elif page[at + 1 : at + 2].isalpha() and at > last:  # a tag that never ends
            at = len(page)
        else:
            tree.text("<")
            at += 1
    if at < len(page):
        tree.text(page[at:])
    return tree


def names_of(attrs: dict) -> set[str]:
    """What an element's class and id call it: the last word of each name that isn't a generic one."""
    out = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(name)]
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        if words and not ABSENT & set(words):
            out.add(words[-1])
            out.add("".join(words))
    return out


def unseen(attrs: dict) -> bool:
    """Whether markup says that an element isn't shown."""
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))


class Page:
    """A tree without what isn't text, the evidence on its elements, and their densities."""

    def __init__(self, tree: Tree) -> None:
        self.tree, n = tree, len(tree.tag)
        tag, parent = tree.tag, tree.parent
        own = [sum(len("".join(x.split())) for x in items if isinstance(x, str)) for items in tree.content]
        self.keep = [True] * n
        for i in range(1, n):
            self.keep[i] = self.keep[parent[i]] and tag[i] not in DROPPED and not (tree.attrs[i] and unseen(tree.attrs[i]))
        headed = [False] * n
        for i in range(n - 1, 0, -1):
            headed[parent[i]] |= tag[i] in HEADINGS or headed[i]
        self.weight = self.evidence(own, headed)
        self.block = [t not in INLINE for t in tag]
        self.prose, self.headed = [t in TEXTY for t in tag], [h or t in HEADINGS for h, t in zip(headed, tag, strict=True)]
        link = [False] * n
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        keep = self.keep
        for i in range(n):
            link[i] = i > 0 and (link[parent[i]] or tag[i] == "a")
            if keep[i]:
                chars[i] = own[i]
                link_chars[i] = own[i] * link[i]
        for i in range(n - 1, 0, -1):
            if keep[i]:
                p = parent[i]
                self.prose[p] |= self.prose[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + (self.block[i] or tag[i] == "a")
                link_tags[p] += link_tags[i] + (tag[i] == "a")
        self.chars, self.link_chars = chars, link_chars
        self.body = next((i for i in range(n) if tag[i] == "body" and keep[i]), 0)
        all_c, all_l = max(1, chars[self.body]), link_chars[self.body]
        self.density, self.total = [0.0] * n, [0.0] * n
        for i in range(n):
            if keep[i] and chars[i] > 1:
                c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], link_tags[i]
                base = math.log(c / max(1, c - lc) * lc + all_l / all_c * c + math.e)
                self.density[i] = self.weight[i] * c / t * math.log(c / max(1, lc) * t / max(1, lt)) / base
        #: the block that each node stands in
        self.over = [0] * n
        for i in range(1, n):
            self.over[i] = parent[i] if self.block[parent[i]] else self.over[parent[i]]
            if keep[i] and self.block[i]:
                self.total[self.over[i]] += self.density[i]

    def evidence(self, own: list[int], headed: list[bool]) -> list[float]:
        """For each element what is left of the densities within it: 1 without evidence that it is something beside the article."""
        tree, n = self.tree, len(self.tree.tag)
        tag, parent = tree.tag, tree.parent
        named = [names_of(attrs) if attrs else set() for attrs in tree.attrs]
        inside, holds, furnished = [False] * n, [False] * n, [t in ("body", "html", "#page") for t in tag]
        for i in range(n - 1, 0, -1):
            holds[parent[i]] |= tag[i] in ("article", "main") or holds[i]
            furnished[parent[i]] |= tag[i] in ("nav", "footer", "aside") or bool(named[i] & {"nav", "navbar", "navigation", "menu", "footer", "sidebar"})
        most, out = self.mostly(own, holds[0]), [1.0] * n
        for i in range(1, n):
            p, attrs, weight = parent[i], tree.attrs[i], 1.0
            inside[i] = inside[p] or tag[p] in ("article", "main")
            role = attrs.get("role", "").lower() if attrs else ""
            whole = {w.lower() for w in (attrs.get("class", "") + " " + attrs.get("id", "")).split()} if attrs else set()
            remark = bool(REMARKS & named[i] or REMARK & whole) and tag[i] not in WRITTEN or (tag[i] not in INLINE and self.counted(i))
            written = tag[i] in WRITTEN and (inside[i] or tag[p] not in ("body", "html", "#page"))
            if tag[i] in ("html", "body", "article", "main"):
                weight = AGAINST if tag[i] == "article" and remark else 1.0
            elif remark and not holds[i]:
                weight = AGAINST
            elif (tag[i] in BESIDE and not (tag[i] == "footer" and tag[p] == "blockquote")) or role in ROLES or (not written and (NAMES - HEADS - REMARKS - REMARK) & named[i]) or (not written and REMARK & whole):
                # an element around the article, or around most of the text, may be named after what else it holds
                weight = 1.0 if holds[i] or most[i] else AGAINST
            elif (tag[i] == "header" or HEADS & named[i]) and not (inside[i] or tag[i] in HEADINGS or holds[i] or (headed[i] and not furnished[p])):
                weight = AGAINST  # a page's head; an article's is its own
            out[i] = min(out[p], weight)
        return out

    def counted(self, node: int) -> bool:
        """Whether a block begins with a heading that counts what follows, as in "3 responses"."""
        content = self.tree.content[node]
        first = next((x for x in content if not isinstance(x, str) or x.strip()), None)
        if not isinstance(first, int) or self.tree.tag[first] not in HEADINGS:
            return False
        inner = self.tree.content[first]
        return len(content) > 1 and all(isinstance(x, str) for x in inner) and bool(_COUNTED.fullmatch(" ".join("".join(inner).split())))

    def mostly(self, own: list[int], articles: bool) -> list[bool]:
        """Whether a node holds over half of the text outside links: of the <article> or <main> it stands in, of the page where there is neither."""
        tree, n = self.tree, len(self.tree.tag)
        out, scope, plain, chars = [False] * n, [0] * n, [True] * n, [0] * n
        for i in range(1, n):
            p = tree.parent[i]
            scope[i] = p if tree.tag[p] in ("article", "main") else scope[p]
            plain[i] = plain[p] and self.keep[i] and tree.tag[i] != "a" and tree.tag[i] not in ("nav", "aside", "footer")
        for i in range(n - 1, -1, -1):
            if plain[i]:
                chars[i] += own[i]
            if i:
                chars[tree.parent[i]] += chars[i]
        for i in range(1, n):
            out[i] = (scope[i] > 0 or not articles) and 2 * chars[i] > chars[scope[i]]
        return out

    def path(self, node: int) -> list[int]:
        """The blocks from a node to the body."""
        out = [node]
        while node not in (self.body, 0):
            node = self.over[node]
            out.append(node)
        return out

    def linked(self, node: int) -> bool:
        """Whether over half of a node's text stands in links."""
        return 2 * self.link_chars[node] > self.chars[node]

    def belonging(self, parent: int, sure: list[int], threshold: float) -> list[int]:
        """Of a node's children those that are the article, sure ones among them; the node itself if all are."""
        tree = self.tree
        kids = [x for x in tree.content[parent] if isinstance(x, int) and self.keep[x] and self.chars[x]]
        held = set(sure)
        kind = lambda x: (tree.tag[x], tree.attrs[x].get("class", ""))
        kinds = {kind(x) for x in sure if kind(x)[1] or tree.tag[x] == "section"}
        # where the article so far, or else the densest block, is written in paragraphs, bare blocks are something else
        written = self.prose[(sure or [max(kids, key=lambda x: self.density[x])])[0]] if kids else False
        dense = lambda x: self.density[x] >= threshold and (self.prose[x] or not written)
        plain = lambda x: self.weight[x] >= self.weight[parent]
        takes = [x in held or (not self.linked(x) and (dense(x) or (plain(x) and kind(x) in kinds))) for x in kids]
        if not any(takes):
            return [parent]
        first, last = takes.index(True), len(takes) - 1 - takes[::-1].index(True)
        adjoins = lambda i: plain(kids[i]) and not self.linked(kids[i]) and (tree.tag[kids[i]] in TEXTY or self.headed[kids[i]] or not self.block[kids[i]])
        while first and adjoins(first - 1):
            first -= 1
        while last + 1 < len(kids) and adjoins(last + 1):
            last += 1
        out = [x for i, x in enumerate(kids) if first <= i <= last and (takes[i] or (plain(x) and (not self.linked(x) or tree.tag[x] in TEXTY - {"ul", "ol", "table"})))]
        return [parent] if len(out) == len(kids) else out

    def article(self) -> list[int]:
        """The nodes whose subtrees are the article, in page order; ``out`` tells which blocks within them are not."""
        tree, n = self.tree, len(self.tree.tag)
        self.out = [not k for k in self.keep]
        below = [False] * n
        below[self.body] = True
        for i in range(self.body + 1, n):
            below[i] = below[tree.parent[i]] and self.keep[i]
        live = [i for i in range(n) if below[i] and self.block[i] and self.chars[i]]
        if not live:
            return []
        core = max(live, key=lambda i: (self.total[i], self.density[i], -i))
        way = self.path(core)
        threshold = min(self.density[i] for i in way)
        # nodes, and lists of what was chosen within one
        chosen: list = [core]
        if self.chars[core] == self.chars[self.body] and tree.tag[core] not in TEXTY | {"article", "main"}:
            kids = [self.density[x] for x in tree.content[core] if isinstance(x, int) and self.keep[x]]
            chosen = self.belonging(core, [], min(self.density[core], max(kids, default=0.0) / 4))
        for below_it, parent in zip(way, way[1:], strict=False):
            if tree.tag[parent] == "article":
                chosen = [parent]
                continue
            held = below_it
            while tree.parent[held] != parent:  # formatting around blocks
                held = tree.parent[held]
            whole = self.belonging(parent, [held], threshold)
            if whole == [parent]:
                if chosen == [below_it]:
                    chosen = [parent]
                    continue
                whole = [x for x in tree.content[parent] if isinstance(x, int) and self.keep[x] and self.chars[x]]
            chosen = [chosen if x == held else x for x in whole]
        nodes, stack = [], [chosen]
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack += x[::-1]
            else:
                nodes.append(x)
        top: list[int] = [-1] * n
        for x in nodes:
            top[x] = x
        for i in range(n):
            if i and top[i] < 0:
                top[i] = top[tree.parent[i]]
            if top[i] >= 0 and top[i] != i and self.block[i] and self.weight[i] < self.weight[top[i]] and self.density[i] < threshold:
                self.out[i] = True
        return nodes

    def text(self, nodes: list[int]) -> str:
        tree, blocks, now = self.tree, [], []

        def flush() -> None:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now.clear()

        for top in nodes:
            flush()
            stack = [(top, 0)]
            while stack:
                node, at = stack.pop()
                items = tree.content[node]
                while at < len(items):
                    x = items[at]
                    at += 1
                    if isinstance(x, str):
                        now.append(x)
                    elif not self.out[x]:
                        if tree.tag[x] == "br":
                            now.append(" ")
                        elif tree.tag[x] not in INLINE:
                            flush()
                        if tree.content[x]:
                            stack += [(node, at), (x, 0)]
                            break
                else:
                    if tree.tag[node] not in INLINE:
                        flush()
        flush()
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(parse(html))
    return page.text(page.article())


def extract_text(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """pages without html_col, with the main text in ``to`` (never null); all other columns stay."""
    rest = [c for c in pages.columns if c not in (html_col, to)]
    df = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(html_col).alias(to))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, html = batch.columns
            yield pa.RecordBatch.from_arrays([*others, pa.array([main_text(x.as_py()) for x in html], pa.string())], batch.schema.names)

    return df.mapInArrow(extracted, df.schema)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
