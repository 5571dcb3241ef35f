"""Main text of web pages by a tree-structured graphical model over DOM blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
#: Those of them that browsers parse: without an end tag they hide nothing.
PARSED = frozenset("noscript template svg select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that no implied end crosses.
SCOPE = frozenset("html body article aside div footer header main nav section table td th ul ol form blockquote button".split())
TAGS = "body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button address".split()
#: Words of class, id and role that tell of boilerplate, and of content; they are looked for among the parts of a name.
NOISE = re.compile(
    r"nav\w*|menu\w*|foot\w*|sidebar\w*|ads?|advert\w*|banner\w*|cookie\w*|consent|notice\w*|gdpr|comments?|commentlist|repl(?:y|ies)|disqus|discussion|share|sharing|social|related|recommend\w*|promo\w*|"
    r"subscri\w*|newsletter|signup|login|breadcrumbs?|popup|modal|copyright|legal|pagination|pager|outbrain|taboola|contentinfo|complementary|navigation|dialog"
)
#: Words that either may have.
EITHER = re.compile(r"header|side|aside|sponsor\w*|alert|search\w*|widget\w*|tool\w*|tags?|byline|meta|form|module\w*|panel\w*|box\w*|block\w*")
GOOD = re.compile(r"article\w*|content|main\w*|post|entry|story|text|body|page|prose")
#: A name that begins or ends so says what a block is about, or what stands beside it, not what it is.
ABOUT = frozenset("with has no not is are tag category cat term topic section format status type author lang".split())
STATE = frozenset("open closed enabled disabled on off active inactive visible".split())
#: A quote opens a value only right after "=" that follows a name; elsewhere it is part of a name or of an unquoted value.
_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|(?=>)|[^\s>"'][^\s>]*+)|(?!\s*+=)))*+)>""")
_ATTR = re.compile(r"""(=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)?+""")
_EMPTY_COMMENT, _COMMENT_END = re.compile("<!---?>"), re.compile("--!?>")
_NAMED = frozenset(("class", "id", "role", "hidden"))


@dataclass(slots=True)
class Block:
    """A block-level element.  parts: its own text runs, each with its place in the page."""

    tag: str
    attrs: str = ""
    parent: int = -1
    label: int | None = None
    parts: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    below: int = 0
    below_linked: int = 0


def parse(html: str, labels: bool = True) -> list[Block]:
    """The page's blocks, parents first.  Inline elements belong to their block; a tag that never ends, or a script or other raw text
    without an end tag, drops the rest, as in browsers; an svg, select, noscript or template without one doesn't.

    Quotes open an attribute's value only right after its "=".  With ``labels``, a data-label of 0 or 1 is
    a block's label; real pages use that name for words.
    """
    blocks = [Block("html")]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block that each one's text goes to
    links, at, place, n = 0, 0, 0, len(html)

    def put(text: str) -> None:
        nonlocal place
        if not text:
            return
        b = blocks[stack[-1][1]]
        b.parts.append((place, unescape(text) if "&" in text else text))
        place += 1
        size = len(text.strip())
        b.chars += size
        if links:
            b.linked += size

    def close(tags: Iterable[str], stop: frozenset) -> None:
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                links -= sum(x[0] == "a" for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            put(html[at:])
            break
        put(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if html.startswith("<!--", lt):
                end = _EMPTY_COMMENT.match(html, lt) or _COMMENT_END.search(html, lt + 4)
                end = end.end() if end else 0
            else:
                end = html.find(">", lt) + 1
            if not end:
                break
            at = end
            continue
        m = _OPEN.match(html, lt)
        if not m:
            if nxt.isascii() and nxt.isalpha() or nxt == "/":
                break
            put("<")
            at = lt + 1
            continue
        at, tag, attrs = m.end(), m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                put(" ")
            elif any(x[0] == tag for x in stack):
                close((tag,), frozenset() if tag not in INLINE and tag != "p" else SCOPE)
                if tag not in INLINE:
                    blocks[stack[-1][1]].parts.append((place, None))
            continue
        if tag == "svg" and attrs.endswith("/") and not next((v for _, v in reversed(_ATTR.findall(attrs))), "").endswith("/"):  # foreign elements may end in their start tag
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            if not end and tag in PARSED:
                continue
            if not end:
                break
            gt = html.find(">", end.end())
            at = gt + 1 if gt >= 0 else n
            continue
        if tag in ("html", "body", "head"):
            if tag != "body":
                continue
        if tag in ENDS_P:
            close(("p",), SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE)
        if tag == "br" or tag == "hr":
            put(" ")
        if tag in VOID or attrs.endswith("/") and tag in INLINE:
            continue
        own = stack[-1][1]
        if tag not in INLINE:
            found: dict[str, str] = {}
            for k, v in _ATTR.findall(attrs) if "=" in attrs else ():
                found.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v)  # the first of a name counts
            blocks[own].parts.append((place, None))
            label = found.get("data-label") if labels else None
            blocks.append(Block(tag, " ".join(v for k, v in found.items() if k in _NAMED and v), own, int(label) if label in ("0", "1") else None))
            own = len(blocks) - 1
        links += tag == "a"
        stack.append((tag, own))
    for b in reversed(blocks):
        b.below += b.chars
        b.below_linked += b.linked
        if b.parent >= 0:
            blocks[b.parent].below += b.below
            blocks[b.parent].below_linked += b.below_linked
    return blocks


def words_of(names: str) -> str:
    """What class, id and role tell: none, plain, good, noise, either, both (in one name) or mixed (in several).

    Names are taken whole: ``with-sidebar`` and ``tag-news`` tell nothing.
    """
    if not names:
        return "none"
    told = set()
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        if len(parts) > 1 and (parts[0] in ABOUT or parts[-1] in STATE):
            continue
        own = {k for k, words in (("good", GOOD), ("noise", NOISE), ("either", EITHER)) for x in parts if words.fullmatch(x)}
        told.add("both" if own >= {"good", "noise"} else min(own - {"either"} or own or {"plain"}))
    told = told - {"plain", "either"} or told - {"plain"} or {"plain"}
    return told.pop() if len(told) == 1 else "mixed"


def _level(x: float, bounds: tuple) -> int:
    return sum(x > b for b in bounds)


def observe(b: Block) -> tuple[str, ...]:
    """A block's observed features, each one value."""
    tag = b.tag if b.tag in TAGS else "other"
    ends = any(t and t.rstrip()[-1:] in ".!?" for _, t in b.parts) if b.chars else False
    own = f"own{_level(b.chars, (0, 25, 80, 300))}"
    return (
        f"tag={tag}",
        f"words={words_of(b.attrs)}",
        f"{own}{'s' if ends else ''}",
        f"link{_level(b.linked / b.chars, (0, 0.3, 0.7)) if b.chars else 'no'}",
        f"below{_level(b.below, (0, 100, 500, 2000))}l{_level(b.below_linked / b.below, (0.1, 0.3, 0.6)) if b.below else 'no'}",
    )


@dataclass
class Model:
    """Log potentials: of each observation in each state, of a child's state given its parent's (by kind of tag), of the root's state."""

    seen: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]

    def marginals(self, blocks: list[Block], observed: list[tuple[str, ...]] | None = None) -> list[float]:
        """P(content) of each block by sum-product: messages from the leaves up, then from the root down."""
        observed = observed or [observe(b) for b in blocks]
        n = len(blocks)
        unary = [[1.0, 1.0] for _ in range(n)]
        edges = [self.edge[_kind(b)] for b in blocks]
        for i, b in enumerate(blocks):
            s0 = s1 = 0.0
            for f in observed[i]:
                a = self.seen.get(f, (0.0, 0.0))
                s0, s1 = s0 + a[0], s1 + a[1]
            if i == 0:
                s0, s1 = s0 + self.root[0], s1 + self.root[1]
            top = max(s0, s1)
            unary[i] = [math.exp(s0 - top), math.exp(s1 - top)]
        up = [u[:] for u in unary]
        sent = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[i]
            a, b = up[i]
            m0, m1 = a * e00 + b * e01, a * e10 + b * e11
            z = m0 + m1
            sent[i] = (m0 / z, m1 / z)
            p = up[blocks[i].parent]
            p[0], p[1] = p[0] * m0 / z, p[1] * m1 / z
            z = p[0] + p[1]
            p[0], p[1] = p[0] / z, p[1] / z
        down = [(1.0, 1.0)] * n
        out = []
        for i in range(n):
            if i:
                q = blocks[i].parent
                r0, r1 = up[q][0] * down[q][0] / max(sent[i][0], 1e-12), up[q][1] * down[q][1] / max(sent[i][1], 1e-12)
                (e00, e01), (e10, e11) = edges[i]
                d0, d1 = r0 * e00 + r1 * e10, r0 * e01 + r1 * e11
                z = d0 + d1 or 1.0
                down[i] = (d0 / z, d1 / z)
            a, b = up[i][0] * down[i][0], up[i][1] * down[i][1]
            out.append(b / (a + b) if a + b > 0 else 0.0)
        return out


def _kind(b: Block) -> str:
    """The kinds of edges: a block with telling attributes, a plain container, a leaf of text."""
    if b.attrs:
        return "named"
    return "box" if b.tag in ("html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "table", "figure") else "leaf"


def train(pages: Iterable[str], steps: int = 25, rate: float = 0.4) -> Model:
    """Potentials from pages whose blocks carry data-label (1: content; children take their parent's label if they have none).

    Counts give the first potentials.  Observations of a block depend on each other, so counts alone weigh them too much: gradient
    steps on the labels' likelihood then set each observation's weight (its labels less the marginals that the whole tree gives, summed up).
    """
    seen: Counter = Counter()
    edge: Counter = Counter()
    total: Counter = Counter()
    known = []
    for html in pages:
        blocks = parse(html)
        y, observed = [0] * len(blocks), [observe(b) for b in blocks]
        for i, b in enumerate(blocks):
            y[i] = b.label if b.label is not None else y[b.parent] if i else 0
            total[y[i]] += 1
            for f in observed[i]:
                seen[f, y[i]] += 1
            if i:
                edge[_kind(b), y[b.parent], y[i]] += 1
        known.append((blocks, observed, y))
    logs = {f: tuple(math.log((seen[f, s] + 0.5) / (total[s] + 5)) for s in (0, 1)) for f in {f for f, _ in seen}}
    edges = {k: tuple(tuple((edge[k, p, c] + 0.5) / (edge[k, p, 0] + edge[k, p, 1] + 1) for c in (0, 1)) for p in (0, 1)) for k in ("named", "box", "leaf")}
    model = Model(logs, edges, (math.log(0.99), math.log(0.01)))
    power: Counter = Counter()
    for _ in range(steps):
        g: Counter = Counter()
        for blocks, observed, y in known:
            for fs, t, p in zip(observed, y, model.marginals(blocks, observed), strict=True):
                if abs(t - p) > 1e-4:
                    for f in fs:
                        g[f] += t - p
        for f in sorted(g):
            power[f] += g[f] ** 2
            a, b = model.seen[f]
            model.seen[f] = (a, b + rate * g[f] / math.sqrt(power[f] + 1e-9))
    return model


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[str]:
    """Made-up pages of many layouts with known content, for training and tests."""
    rng = random.Random(seed)
    syll = "ta re mi lo ver un ku sha el ino da por wen zi".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sent = lambda a=4, b=18: words(a, b).capitalize() + rng.choice("...!?")
    prose = lambda k: " ".join(sent() for _ in range(rng.randint(1, k)))

    def menu(k: int) -> str:
        item = f' class="{rng.choice(["item", "first", word()])}"' if rng.random() < 0.2 else ""
        return "<ul>" + "".join(f'<li{item}><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, k))) + "</ul>"

    def noise(top: bool) -> str:
        pick = rng.choice(
            ["nav", "navdiv", "header", "ad", "ad", "cookie", "aside", "related", "form", "share"] if top else ["footer", "footerdiv", "comments", "comments", "aside", "related", "form", "share", "ad", "note", "long comments", "long note"]
        )
        c = lambda *xs: rng.choice(xs)
        return {
            "nav": lambda: f"<nav data-label=0>{menu(8)}</nav>",
            "navdiv": lambda: f'<div data-label=0 class="{c("menu", "top-menu", "navbar", "breadcrumb", "site-nav")}">{menu(8)}</div>',
            "header": lambda: f"<header data-label=0><h1>{words(1, 3)}</h1><p>{words(2, 8)}</p>{menu(5) if rng.random() < 0.5 else ''}</header>",
            "ad": lambda: f'<div data-label=0 class="{c("ad", "ads", "advert", "banner", "sponsored", "promo-box")}">{prose(3)}</div>',
            "cookie": lambda: f'<div data-label=0 {c("class", "id")}="{c("cookie-notice", "consent", "notice", "gdpr-banner")}"><p>{prose(2)}</p><button>{word()}</button></div>',
            "aside": lambda: f'<aside data-label=0>{c(menu(6), f"<h3>{words(1, 3)}</h3><p>{prose(3)}</p>")}</aside>' if rng.random() < 0.6 else f'<div data-label=0 class="{c("sidebar", "side", "widget", "content-sidebar")}"><h3>{words(1, 3)}</h3>{c(menu(6), f"<p>{prose(3)}</p>")}</div>',
            "related": lambda: f'<{(t := c("div", "section"))} data-label=0 class="{c("related", "recommended", "related-posts", "story-related")}"><h2>{words(1, 3)}</h2>{menu(6)}</{t}>',
            "form": lambda: f"<form data-label=0><label>{words(1, 4)}</label><input name=q><button>{word()}</button><p>{sent()}</p></form>",
            "share": lambda: f'<div data-label=0 class="{c("share", "social", "tags")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>',
            "footer": lambda: f"<footer data-label=0>{c(f'&copy; {words(1, 3)} &middot; {prose(2)}', f'<p>&copy; {prose(2)}</p>{menu(5)}')}</footer>",
            "footerdiv": lambda: f'<div data-label=0 {c("class", "id")}="{c("footer", "site-footer", "legal", "copyright", "page-footer")}"><p>&copy; {prose(2)}</p></div>',
            "comments": lambda: f'<{(t := c("div", "section", "ul"))} data-label=0 {c("class", "id")}="{c("comments", "comment-list", "discussion", "replies", "post-comments")}"><h3>{words(1, 2)}</h3>' + "".join(f'<{(u := "li" if t == "ul" else "div")} class="comment"><p>{prose(4)}</p></{u}>' for _ in range(rng.randint(1, 5))) + f"</{t}>",
            "long comments": lambda: f'<{(t := c("div", "section"))} data-label=0 {c("class", "id")}="{c("comments", "comment-list", "discussion", "disqus")}">' + "".join(f'<div class="{c("comment", "row", word())}">{"".join(f"<p>{prose(9)}</p>" for _ in range(rng.randint(1, 3)))}</div>' for _ in range(rng.randint(1, 5))) + f"</{t}>",
            "long note": lambda: f'<div data-label=0 class="{c("related", "sponsored-box", "promo", "legal", "newsletter")}">' + "".join(f"<p>{prose(9)}</p>" for _ in range(rng.randint(1, 3))) + "</div>",
            "note": lambda: f'<div data-label=0 class="{c("newsletter", "subscribe", "notice", "disclaimer-notice")}"><p>{prose(2)}</p></div>',
        }[pick]()

    def block() -> str:
        r = rng.random()
        if r < 0.15:
            return f'<p class="{rng.choice(["lead", "intro", "wide", "has-dropcap", word()])}">{prose(8)}</p>'
        if r < 0.2:
            return f'<div class="{rng.choice(["inner", "row", "column", word()])}"><p>{prose(5)}</p><p>{prose(5)}</p></div>'
        if r < 0.65:
            return f"<p>{prose(8)}" + rng.choice(["</p>", "</p>", ""])
        if r < 0.75:
            return f"<h{(k := rng.randint(2, 4))}>{words(2, 8)}</h{k}>"
        if r < 0.82:
            return "<ul>" + "".join(f"<li>{prose(2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.88:
            return f"<blockquote>{prose(4)}</blockquote>"
        if r < 0.93:
            return f'<p>{prose(3)} <a href="/{word()}">{words(1, 3)}</a> {prose(3)}</p>'
        if r < 0.96:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 6)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        return f"<p><b>{sent()}<br>{prose(3)}</b></p>"

    # names that speak of what stands beside the article, or of its subject, and such as speak of both
    beside = ["content with-sidebar", "post tag-news", "entry category-search", "post comments-open", "article-page has-menu", "main-content side-left", "content-widget", "post sponsored", "story header-image", "entry-meta-body", "widget", "tool-box", "panel", "category-search", "left-column", "single", "post sidebar-right", "content navless menu", "entry social-share"]

    for _ in range(n):
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="post-body"'), ("section", ' class="story"'), ("div", ' class="entry"'), ("div", "")])
        if rng.random() < 0.3:
            attrs = f' class="{rng.choice(beside)}"'
        inside = [f"<h1>{words(2, 12)}</h1>"] * (rng.random() < 0.8) + [block() for _ in range(rng.randint(0, 14))]
        if len(inside) < 2:
            inside.append(f"<p>{prose(6)}</p>")
        if rng.random() < 0.35:
            inside.insert(rng.randint(1, len(inside)), noise(rng.random() < 0.5))
        body = [noise(True) for _ in range(rng.randint(1, 4))] + [f"<{tag} data-label=1{attrs}>{''.join(inside)}</{tag}>"] + [noise(False) for _ in range(rng.randint(0, 4))]
        text = "".join(body)
        if rng.random() < 0.3:
            text = f'<div data-label=0 class="{rng.choice(["wrapper", "container", "page", "layout"])}">{text}</div>'
        yield f"<html><head><title>{words(2, 6)}</title></head><body data-label=0>{text}</body></html>"


def main_text(html: str, model: Model) -> str:
    """The text of the blocks that are content with a chance of over a half."""
    blocks = parse(html, labels=False)
    keep = [p > 0.5 for p in model.marginals(blocks)]
    runs = sorted(((at, i, t) for i, b in enumerate(blocks) if keep[i] for at, t in b.parts), key=lambda x: x[0])
    out: list[str] = []
    now = -1
    for _, i, t in runs:
        if t is None:
            now = -1
        elif i == now:
            out[-1] += t
        else:
            out.append(t)
            now = i
    return " ".join(x for x in (" ".join(t.split()) for t in out) if x)


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text.

    Each page is a tree of block elements with two states, content and not.  Observations (tag, words of
    class and id, lengths, link shares) and parent-child potentials, both counted on labelled pages, give
    each block's marginal by sum-product up and down the tree; blocks over a half are the text.  White
    space in a block becomes one space; blocks are joined by one space in page order.

    Without ``model`` one is trained on ``labelled_pages``.  It is a small table and goes to the tasks by
    closure.  Null or empty html gives an empty text, broken or cut html what could be read.  Repeated
    rows give repeated results, an empty table none; other columns are ignored.  Nothing shuffles.
    """
    model = model or train(labelled_pages())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(h or "", model) for h in b["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string")
