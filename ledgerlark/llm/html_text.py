"""Main text of web pages by tree scoring.

A page becomes a tree; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
cut off. Paragraphs pass points for length and commas to their ancestors, discounted by the density of links, and the best
container is kept with the siblings that score well. A container inside an ``article`` or ``main`` grows to that element,
and lists that are nearly all links are cut from it.

Every step is linear in the page: open elements are found by their names, and marks are decided in passes over the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import by_value, table

by_value(__name__)

_NAME = r"<(/?)([a-zA-Z][^\s/<>]*+)"
#: A tag: with quoted values that hold no ``<``; else with any quoted values that end where a value can end; else, where a quote is
#: missing, up to the next ``>``. Nothing is tried twice at a place, so a tag takes time in proportion to its length.
TAG = re.compile(
    _NAME + r"((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    + "|" + _NAME + r"((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')(?=[\s/>])|=)*+)>"
    + "|" + _NAME + r"([^<>]*+)>"
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the main text. (A ``form`` or ``header`` may be: see ``decide``.)
OFF = frozenset("script style noscript template nav footer aside button input select option textarea iframe object embed svg canvas audio video dialog menu head title noembed noframes datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that mark readers' comments, adverts and notices, and the page's frame.
COMMENTS = frozenset("comment comments commenter reply replies respond responses disqus discussion discussions".split())
NOTICES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices popup popups modal newsletter subscribe subscription subscriptions signup login related recommended recommendation recommendations paywall".split()
)
FRAME = frozenset("banner banners sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footers header headers masthead overlay share sharing social widget widgets toolbar pagination pager search skip copyright colophon".split())
#: Words that also name a section of an article where they are the whole class or id: see ``sections``.
SECTIONS = frozenset("discussion discussions response responses reply notice notices related subscription subscriptions promotion promotions recommendation recommendations recommended consent overlay social share sharing search navigation".split())
#: What the heading of readers' comments says, and the headings of a list of links that belongs to the article.
TALK = re.compile(r"comment|reader|\breplies|leave a|join (?:the|in)|\bsaid\b|\d+ +respon|newsletter|sign up|cookie|advert|sponsor", re.I)
REFERENCES = re.compile(r"references?|bibliography|sources?|(?:end|foot)?notes|citations?|works cited|literature|further reading|see also|external links|quellen|literatur|einzelnachweise|weblinks|références|bibliographie|referencias|bibliografía|fuentes|notas", re.I)
#: What may follow such a word in a name; and words around one that say whether there is such a part, not that this is it.
GENERIC = frozenset("list lists area areas box boxes slot slots unit units container wrapper wrap section sections block inner outer left right top bottom form thread item items bar bars links link posts articles stories content contents body text title heading panel group row holder module widget menu count meta policy settings dialog banner signup".split())
BEFORE = GENERIC | frozenset("site page main user users reader readers global primary secondary blog post article".split())
STATE = frozenset("has have no not non with without show shows hide hides is are allow allows enable disable open closed on off enabled disabled allowed free".split())
#: What an opening tag closes when it stands in it, and where the search for it stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HOLDS_TEXT = frozenset("div section article main body center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table".split())
WORD = re.compile("[a-z]+|[0-9]+")
CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

#: Why an element is cut off: its name or an attribute (for good), a word of one of the lists, or that it is a form or header.
GOOD, FRAMED, NOTICED, COMMENTED, FORM, HEADER = 6, 1, 2, 3, 4, 5
BY_WORD = (FRAMED, NOTICED, COMMENTED)


class Node:
    """An element: its texts and elements in order, why it is cut off (0: it isn't), and what ``measure`` and ``score`` find.

    ``soft``: it is cut off by words of SECTIONS alone.
    """

    __slots__ = ("tag", "up", "below", "off", "score", "main", "soft", "n", "commas", "linked", "links", "depth", "block")

    def __init__(self, tag: str, up: Node | None, off: int = 0, main: bool = False, soft: bool = False):
        self.tag, self.up, self.below, self.off, self.score, self.main, self.soft = tag, up, [], off, 0.0, main, soft
        self.n = self.commas = self.linked = self.links = 0
        self.depth = up.depth + 1 if up is not None else 0
        self.block = self if up is None or tag in BLOCK else up.block


@lru_cache(maxsize=65536)
def kind_of(word: str) -> int:
    """The list that a word is in, or that it is run together from: a marking word and a general one, either way round."""
    for kind, own in ((COMMENTED, COMMENTS), (NOTICED, NOTICES), (FRAMED, FRAME)):
        if word in own:
            return kind
    for k in range(2, len(word) - 1):
        if word[k:] in GENERIC | COMMENTS | NOTICES | FRAME and (kind := kind_of(word[:k])):
            return kind
        if word[:k] in BEFORE and (kind := kind_of(word[k:])):
            return kind
    return 0


def named(name: str) -> int:
    """What a single class or id says: a mark only if it is or ends with a marking word, or begins with one and goes on in GENERIC words."""
    words = [w for w in WORD.findall(CAMEL.sub(" ", name[:200]).lower()) if not w.isdigit()]  # longer names aren't words
    if not words or words[0] in STATE or words[-1] in STATE:
        return 0
    return kind_of(words[-1]) or (kind_of(words[0]) if all(w in GENERIC or kind_of(w) for w in words[1:]) else 0)


def marked(tag: str, attributes: str) -> tuple[int, bool, bool]:
    """Why an element with these attributes may be cut off (0: for nothing), whether it calls itself the main part, and ``Node.soft``."""
    off, main, soft = GOOD if tag in OFF else FORM if tag == "form" else HEADER if tag == "header" else 0, tag == "main", tag in ("section", "div")
    if not attributes or off == GOOD:
        return off, main, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(a or b or c)
        if name == "role":
            off, main = GOOD if value.strip().lower() in ROLES else off, main or value.strip().lower() == "main"
        elif name in ("class", "id") and tag not in ("html", "body", "main"):
            marks = [(named(v), v.lower() in SECTIONS) for v in value.split()]
            soft = soft and all(plain or not kind for kind, plain in marks)
            if not off:
                off = max((kind for kind, _ in marks), default=0)
                off = 0 if tag == "article" and off != COMMENTED else off
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            off = GOOD
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            off = GOOD
    return off, main, soft and off in BY_WORD


def tree(html: str) -> Node:
    """The page's elements and texts; a missing closing tag is supplied, a stray one ignored, a comment without end goes to the page's end."""
    root = Node("#root", None)
    at, cur, open_ = 0, root, {}
    unended = len(html)  # no "]]>" from here on

    def rise(to: Node) -> Node:
        x = cur
        while x is not to:
            open_[x.tag].pop()
            x = x.up
        return to

    def nearest(tags: tuple[str, ...]) -> Node:
        return max((open_[t][-1] for t in tags if open_.get(t)), key=lambda x: x.depth, default=root)

    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            cur.below.append(html[at:])
            return root
        if begin > at:
            cur.below.append(html[at:begin])
        at = begin + 1
        kind = html[at : at + 1]
        if kind in ("!", "?") and kind:
            if html.startswith("!--", at):
                end = html.find("-->", at + 3)
                at = len(html) if end < 0 else end + 3
                continue
            if html.startswith("![CDATA[", at) and at < unended:
                end = html.find("]]>", at)
                if end >= 0:
                    cur.below.append(html[at + 8 : end].replace("&", "&amp;"))
                    at = end + 3
                    continue
                unended = at
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
            continue
        m = TAG.match(html, begin)
        if m is None:
            cur.below.append("<")
            continue
        at = m.end()
        tag, attributes = (m[2] or m[5] or m[8]).lower(), m[3] or m[6] or m[9] or ""
        if m[1] or m[4] or m[7]:
            if open_.get(tag):
                x = open_[tag][-1]
                crossed = cur.block.depth > x.depth
                if not crossed or tag in BLOCK or tag == "a":  # the end of <b> and the like closes no block
                    cur = rise(x.up)
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            x = cur.block
            if x.tag == "p" or (tag in HEADINGS and x.tag in HEADINGS):
                cur = rise(x.up)
        if tag in CLOSES:
            x = nearest(CLOSES[tag] + SCOPE[tag])
            while x.tag in CLOSES[tag]:
                x = x.up
                cur = rise(x)
        if tag in ("html", "body") and open_.get(tag):
            continue
        node = Node(tag, cur, *marked(tag, attributes))
        cur.below.append(node)
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.below.append(html[at : close.start() if close else len(html)])
            at = close.end() if close else len(html)
            continue
        open_.setdefault(tag, []).append(node)
        cur = node
    return root


def up_from(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


def elements(root: Node) -> Iterator[Node]:
    """All elements, cut off or not, in page order."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(b for b in reversed(x.below) if isinstance(b, Node))


def text_of(node: Node) -> str:
    return SPACE.sub(" ", "".join(unescape(x) for x, _ in walk(node) if isinstance(x, str))).strip()


def sections(order: list[Node]) -> None:
    """Take back the marks of sections of an article that are named, say, Discussion, Notice or Recommendations.

    Such a ``section`` or ``div`` stands in an ``article`` or ``main``, has no other mark, headings of 200 characters at most that don't speak of comments or
    adverts, two paragraphs of 40 characters of its own and at least as many as it has list items and parts, less than a fifth of
    its text in links, and nothing in it that comments have: a marked comment, a form, a field, a time or an article.
    """
    soft = {id(x) for x in order if x.soft}
    if not soft:
        return
    inside, n, linked, talk = {id(order[0]): False}, dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), False)
    for x in order[1:]:
        inside[id(x)] = inside[id(x.up)] or x.up.tag == "article" or x.up.main
    for x in reversed(order):
        n[id(x)] += 0 if x.off == GOOD else sum(len(b.strip()) for b in x.below if isinstance(b, str))
        if x.tag == "a":
            linked[id(x)] = n[id(x)]
        if x.up is not None:
            n[id(x.up)] += n[id(x)]
            linked[id(x.up)] += linked[id(x)]
            talk[id(x.up)] |= talk[id(x)] or x.off == COMMENTED or x.tag in ("form", "input", "textarea", "time", "article")
    for x in order:
        if id(x) in soft and inside[id(x)] and not talk[id(x)] and linked[id(x)] * 5 < n[id(x)]:
            own = [b for b in x.below if isinstance(b, Node)]
            heads = [b for b in own if b.tag in HEADINGS]
            paragraphs = sum(b.tag == "p" and n[id(b)] >= 40 for b in own)
            parts = sum(b.tag in ("div", "section", "li") for b in own)
            if heads and paragraphs >= max(2, parts) and not any(n[id(h)] > 200 or TALK.search(text_of(h)) for h in heads):
                x.off = 0


def decide(root: Node) -> None:
    """Take back marks that only describe the layout.

    * Those of an article's own sections: see ``sections``.
    * A marked element, a form or a header around an ``article`` or ``main`` is the page's layout, unless another one stands
      outside of all marks: then it holds comments or teasers.
    * Without ``article``, ``main`` or a ``h1`` outside, a form with a ``h1`` or with nearly all of the page's paragraphs is layout.
    * A header inside an ``article`` or ``main`` keeps its headings and nothing else.
    * Without ``article``, ``main`` or a ``h1`` outside, a mark by a word gives way where its element has three paragraphs and
      most of the page's text in paragraphs.
    """
    order = list(elements(root))
    sections(order)
    cut: dict[int, Node | None] = {id(root): None}  # the outermost marked element around each one, itself included
    talk: dict[int, bool] = {id(root): root.off == COMMENTED}  # whether it or an element around it is marked as comments
    inside: dict[int, bool] = {id(root): False}  # whether an article or main is around it
    for x in order[1:]:
        cut[id(x)] = cut[id(x.up)] or (x if x.off else None)
        talk[id(x)] = talk[id(x.up)] or x.off == COMMENTED
        inside[id(x)] = inside[id(x.up)] or x.up.tag == "article" or x.up.main
    size, paragraphs = dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), 0)
    dead = {id(root): False}  # cut off for good, or below such an element
    for x in order[1:]:
        dead[id(x)] = dead[id(x.up)] or x.off == GOOD
    for x in reversed(order):
        if not dead[id(x)]:
            if x.tag in PARAGRAPH or x.block.tag in PARAGRAPH:
                size[id(x)] += sum(len(b.strip()) for b in x.below if isinstance(b, str))
            paragraphs[id(x)] += x.tag == "p"
            if x.up is not None:
                size[id(x.up)] += size[id(x)]
                paragraphs[id(x.up)] += paragraphs[id(x)]
    parts = [x for x in order if (x.tag == "article" or x.main) and not dead[id(x)] and x.off != COMMENTED]
    free = [x for x in parts if cut[id(x)] is None]
    if parts and not free:
        calm = [x for x in parts if not talk[id(x)]]
        for x in [*calm, *parts][:1]:  # the first, but one outside of comments where there is one
            for u in up_from(x):
                u.off = 0
    heads = [x for x in order if x.tag == "h1" and not dead[id(x)]]
    seen = bool(parts) or any(cut[id(x)] is None for x in heads)
    if not seen:
        around = {id(cut[id(x)]) for x in heads}
        for x in order:
            if x.off == FORM and not dead[id(x)] and (id(x) in around or (size[id(x)] * 4 >= 3 * size[id(root)] > 0 and paragraphs[id(x)] > 1)):
                x.off, seen = 0, True
    if not seen:
        for x in order:
            if x.off in BY_WORD and not dead[id(x)] and x.off != COMMENTED and paragraphs[id(x)] >= 3 and size[id(x)] * 2 > size[id(root)]:
                x.off = 0
    for x in order:
        if x.off in (HEADER, FRAMED) and inside[id(x)] and not dead[id(x)] and cut[id(x)] is x:
            titles = [h for h in elements(x) if h.tag in ("h1", "h2", "h3") and not any(u.off for u in up_between(h, x))]
            if titles:
                x.below, x.off = titles, 0
                for h in titles:
                    h.up = x


def up_between(node: Node, top: Node) -> Iterator[Node]:
    while node is not top:
        yield node
        node = node.up


def walk(node: Node) -> Iterator[tuple[Node | str, bool]]:
    """Elements (at their start, and again with True at their end) and texts below ``node`` in page order, without what is cut off."""
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, ends = stack.pop()
        yield x, ends
        if isinstance(x, Node) and not ends:
            stack.append((x, True))
            stack.extend((b, False) for b in reversed(x.below) if isinstance(b, str) or not b.off)


def measure(root: Node) -> None:
    """Give every element its number of characters, commas, links and characters inside links, from the bottom up."""
    links = 0
    for x, ends in walk(root):
        if isinstance(x, str):
            continue
        if not ends:
            links += x.tag == "a"
            x.links += x.tag == "a"
            for b in x.below:
                if isinstance(b, str):
                    t = b.strip()
                    x.n += len(t)
                    x.commas += t.count(",") + t.count("、") + t.count("，")
                    x.linked += len(t) if links else 0
            continue
        links -= x.tag == "a"
        if x.up is not None:
            x.up.n += x.n
            x.up.commas += x.commas
            x.up.linked += x.linked
            x.up.links += x.links


def score(root: Node) -> list[Node]:
    """Give every paragraph's points to its ancestors: all to the parent, half to the next, a third of that rate further on."""
    held: dict[int, Node] = {}
    for x, ends in walk(root):
        if isinstance(x, str) or ends or not x.n:
            continue
        if x.tag in PARAGRAPH:
            n, commas, share, above = x.n, x.commas, density(x), x.up
        elif x.tag in HOLDS_TEXT and (direct := [b.strip() for b in x.below if isinstance(b, str) and b.strip()]):
            n, commas, share, above = sum(map(len, direct)), sum(d.count(",") for d in direct), density(x), x
        else:
            continue
        points = (min(n / 100, 3) + commas + (1 if n >= 25 else 0)) * (1 - share)
        for level in range(5):
            if above is None or above.tag in ("#root", "html"):
                break
            above.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            held[id(above)] = above
            above = above.up
    return list(held.values())


def density(node: Node) -> float:
    return node.linked / node.n if node.n else 0.0


def worth(node: Node) -> float:
    return node.score * (1 - density(node))


def chosen(root: Node) -> list[Node]:
    """The parts of the page that hold the main text, in page order."""
    measure(root)
    best = max(((worth(c), -k, c) for k, c in enumerate(score(root))), default=(0.0, 0, None), key=lambda x: x[:2])
    if best[2] is None or best[0] <= 0:
        for want in ("article", "main", "body"):
            for x, ends in walk(root):
                if isinstance(x, Node) and not ends and (x.tag == want or want == "main" and x.main):
                    return [x]
        return [root]
    top, around = best[2], False
    for want in ("article", "main"):
        inside = [x for x in up_from(top) if x.tag == want or (want == "main" and x.main)]
        if inside:
            top, around = inside[-1], True
            break
    if top.up is None or top.tag == "body":
        return [top]
    least, below = max(1.0, worth(top) * 0.2), top.up.below
    at = next(k for k, b in enumerate(below) if b is top)
    kept = {k for k, b in enumerate(below) if b is top or (isinstance(b, Node) and not b.off and joins(b, top, around, k < at, least))}
    return [b for k, b in enumerate(below) if k in kept or (min(kept) < k < max(kept) and (isinstance(b, str) or (not b.off and b.n and not b.links)))]


def joins(b: Node, top: Node, around: bool, before: bool, least: float) -> bool:
    """Whether an element beside the chosen part is kept with it, before or after it. What stands between two kept parts needs no more than to have no link."""
    if worth(b) >= least and (not around or b.tag in ("article", "section", "div")):
        return True
    if around:  # of a main, its title, the paragraphs and the short articles that link nowhere
        return top.up.main and b.n > 0 and not b.links and (b.tag in ("p", "article") or (b.tag == "h1" and before))
    if b.tag in PARAGRAPH:
        return b.n > 0 and density(b) < 0.25 and (b.n >= 80 or b.linked == 0)
    return b.tag in ("h1", "h2", "h3") and density(b) < 0.25


def menu_in(node: Node, part: Node) -> bool:
    """Whether an element below a kept part is a menu: three links or more that are nearly all of its text, and little of the part's."""
    return node is not part and node.tag in LISTS and node.links >= 3 and density(node) > 0.8 and node.n * 4 < part.n


def blocks(parts: list[Node | str]) -> list[str]:
    """The texts of the blocks, white space as one space; empty blocks are left out, and menus with the heading right above them.

    A numbered list and a list below a heading of REFERENCES are no menus.
    """
    out, own = [], []
    head, held = None, 0  # the last heading, and the number of blocks with it

    def close() -> None:
        text = SPACE.sub(" ", "".join(own)).strip()
        own.clear()
        if text:
            out.append(text)

    for part in parts:
        menu = None
        for x, ends in walk(part):
            if menu is not None:
                if x is menu and ends:
                    menu = None
            elif isinstance(x, str):
                own.append(unescape(x))
            elif x.tag == "br":
                own.append(" ")
            elif x.tag in BLOCK:
                close()
                if ends and x.tag in HEADINGS:
                    head, held = x, len(out)
                elif not ends and x.tag != "ol" and menu_in(x, part):
                    right_above = head is not None and held == len(out) > 0 and head.up is x.up
                    if right_above and REFERENCES.fullmatch(out[-1].strip(" :.")):
                        continue
                    menu = x
                    if right_above and head.tag != "h1" and held > 1:
                        out.pop()
    close()
    return out


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in page order, joined by an empty line. Empty for null and for a page without text.

    Where nothing is left because words, forms or headers mark the whole page, those marks are taken back: first the
    frame's, then those of notices, forms and headers, last those of comments.
    """
    if not html:
        return ""
    root = tree(html)
    decide(root)
    found = blocks(chosen(root))
    for kinds in ((FRAMED,), (NOTICED, FORM, HEADER), (COMMENTED,)):
        if not found and release(root, kinds):
            found = blocks(chosen(root))
    return "\n\n".join(found)


def release(root: Node, kinds: tuple[int, ...]) -> bool:
    """Take back the marks of these kinds, and all counts; whether there were any."""
    any_ = False
    for x in elements(root):
        if x.off in kinds:
            any_, x.off = True, 0
        x.score = x.n = x.commas = x.linked = x.links = 0
    return any_


def text_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` of every page (null html: empty text).

    Rows stay rows, repeated ones and those with a null id or url too; other columns are ignored, whatever their names. An
    empty table gives no rows. Whole pages are read, in time linear in their length.
    """
    rows = pages.selectExpr(f"`{id_col}` AS id", f"cast(`{url_col}` AS string) AS url", f"cast(`{html_col}` AS string) AS html")
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(text_batches, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; null html gives an empty text, no rows no rows."""
    return extract_text(table(spark, sf_dir, "pages"))
