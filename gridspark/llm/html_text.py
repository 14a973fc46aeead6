"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the boundaries of block-level elements. A block's features are its ancestors'
tags, what their class, id and role attributes name, and shape of its text; the field's two states are main text and boilerplate.
Weights are fitted by maximum likelihood on labelled pages, made by ``labelled_pages`` from many layouts, and blocks are decoded by
Viterbi. Pages are independent, so there is no shuffle and no page crosses a task.

Defined results: a null or empty html gives an empty text. Whitespace is what Unicode calls so, no-break spaces included; ``br``
counts as such. Comments, scripts, styles and templates hold no text. Unclosed elements end with the page. Repeated rows get equal
results. ``keep`` columns named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import collections
import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_map, table

# Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tr"}, "tbody": {"thead", "tbody", "tr"}, "tfoot": {"tbody", "tr"}}
KEEPS_P = frozenset("body html head td th caption button object".split())
PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

TAGS = frozenset("a article aside blockquote body button dd dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main nav noscript ol option p pre section select table td textarea th title ul".split())
#: Elements that say what part of a page they are; with elements whose names say so, the innermost one is a feature of its own.
PARTS = frozenset("article aside button dialog fieldset footer form header label main menu nav noscript select textarea title".split())
#: What names in class, id and role attributes are about; a name is cut at anything but letters and at inner capitals.
NAMED = {
    "ad": "ad ads adv advert adverts advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored dfp adsense",
    "menu": "menu menus nav navs navbar navigation breadcrumb breadcrumbs pagination pager topnav subnav tabs toc",
    "comment": "comment comments commenter reply replies respond discussion disqus thread reader readers feedback",
    "side": "sidebar sidebars side aside complementary widget widgets related recommend recommended recommendations more trending popular rail also teaser",
    "foot": "footer foot copyright legal colophon bottom contentinfo credits imprint",
    "head": "header head masthead logo brand branding top site topbar tagline",
    "notice": "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup alert paywall dialog privacy message toast",
    "social": "share sharing social follow tweet facebook buttons tools toolbar",
    "form": "form search login input field contact poll survey",
    "content": "content article post entry story main body text prose page hentry copy detail",
    "hidden": "hidden invisible offscreen",
}
NAME_OF = {w: k for k, words in NAMED.items() for w in words.split()}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("features", "text")

    def __init__(self, text: str, features: list[str]):
        self.text, self.features = text, features


@functools.lru_cache(maxsize=1 << 14)
def _marks(tag: str, attributes: str) -> frozenset[str]:
    """What an element says about the blocks below it."""
    out = {f"t:{tag}"} if tag in TAGS else set()
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                out.add("n:hidden")
            elif name in ("class", "id", "role"):
                out |= {f"n:{NAME_OF[w.lower()]}" for w in NAME.findall(value) if w.lower() in NAME_OF}
    return frozenset(out)


class _Open:
    """The open elements, and what blocks need to know of them, kept up to date element by element whatever their number."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.tags: collections.Counter[str] = collections.Counter()
        self.marks: collections.Counter[str] = collections.Counter()
        self.blocks: list[int] = []  # places of block elements, and of elements that name a part of the page
        self.parts: list[int] = []

    def push(self, tag: str, marks: frozenset[str]) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if tag in PARTS or any(x[0] == "n" for x in marks):
            self.parts.append(len(self.stack))
        self.stack.append((tag, marks))
        self.tags[tag] += 1
        self.marks.update(marks)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag, marks = self.stack.pop()
            self.tags[tag] -= 1
            for x in marks:
                self.marks[x] -= 1
                if not self.marks[x]:
                    del self.marks[x]
        for places in (self.blocks, self.parts):
            while places and places[-1] >= k:
                places.pop()

    def features(self) -> list[str]:
        inner = self.stack[self.blocks[-1]][0] if self.blocks else "none"
        closest = self.stack[self.parts[-1]][1] if self.parts else ("none",)
        return [*self.marks, *(f"c:{x}" for x in closest), f"i:{inner}"]


def blocks(page: str) -> list[Block]:
    """A page's leaf blocks with text, in order."""
    out: list[Block] = []
    open_now = _Open()
    stack = open_now.stack
    texts: list[str] = []
    linked = size = 0

    def flush() -> None:
        nonlocal linked, size, texts
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Block(text, [*open_now.features(), *_shape(text, linked / max(size, 1))]))
        texts, linked, size = [], 0, 0

    def close(k: int) -> None:
        if open_now.blocks and open_now.blocks[-1] >= k:
            flush()
        open_now.cut(k)

    at, end = 0, len(page)
    while at < end:
        m = PART.match(page, at)
        at = m.end()
        if m[7] is not None:
            texts.append(m[7])
            n = len(m[7])
            size += n
            linked += n * (open_now.tags["a"] > 0)
            continue
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "title" and open_now.tags["svg"]:  # of a drawing, no block
            tag = "svg-title"
        if m[1] or m[4]:  # an end tag
            if open_now.tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCKS:
                flush()
        elif tag in RAW:
            ends = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = ends.end() if ends else end
        elif tag == "br":
            texts.append(" ")
        else:
            if tag in BLOCKS:
                flush()
                if tag not in ("option", "optgroup"):
                    if open_now.blocks and stack[open_now.blocks[-1]][0] == "p":
                        close(open_now.blocks[-1])
                ended = ENDED_BY.get(tag, ())
                for k in range(len(stack) - 1, -1, -1) if any(open_now.tags[x] for x in ended) else ():
                    if stack[k][0] in ended:
                        close(k)
                        if tag not in ("tr", "thead", "tbody", "tfoot"):
                            break
                    elif stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu", "div", "section", "article"):
                        break
            if tag not in VOID:
                attributes = m[3] if m[2] else m[6]
                if not (attributes or "").endswith("/") or tag in BLOCKS:
                    open_now.push(tag, _marks(tag, attributes or ""))
    flush()
    return out


def _shape(text: str, linked: float) -> list[str]:
    n = len(text)
    out = ["long" if n >= 200 else "middle" if n >= 60 else "short", "links:most" if linked > 0.6 else "links:some" if linked > 0.1 else "links:none"]
    if text[-1] in ".!?…:;»”\"":
        out.append("ended")
    if "©" in text or "All rights" in text:
        out.append("rights")
    return out


# --------------------------------------------------------------------------- the field


class Field:
    """Weights of features by state (0 boilerplate, 1 main text) and of transitions."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights, self.steps = np.zeros((len(names), 2)), np.zeros((2, 2))
        self.scores: list[tuple[float, float]] | None = None

    def fit(self, pages: list[tuple[list[Block], list[int]]], rounds: int = 160, rate: float = 0.12, ridge: float = 0.02) -> Field:
        """Maximum likelihood with a ridge: gradients by forward-backward over all pages at once, steps by Adam."""
        n, longest, d = len(pages), max(len(b) for b, _ in pages), len(self.index)
        x, y, on = np.zeros((n, longest, d), np.float32), np.zeros((n, longest), int), np.zeros((n, longest))
        for i, (bs, ls) in enumerate(pages):
            for j, b in enumerate(bs):
                x[i, j, [self.index[f] for f in b.features if f in self.index]] = 1
            y[i, : len(ls)], on[i, : len(ls)] = ls, 1
        real = on.astype(bool)
        flat, w = x[real], np.concatenate((self.weights.ravel(), self.steps.ravel()))
        one = np.eye(2)[y] * on[..., None]
        seen = np.concatenate(((flat.T @ one[real]).ravel(), np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:]).ravel()))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, rounds + 1):
            e, t = np.zeros((n, longest, 2)), w[2 * d :].reshape(2, 2)
            e[real] = flat @ w[: 2 * d].reshape(d, 2)
            a, b = e.copy(), np.zeros_like(e)
            for j in range(1, longest):
                a[:, j] = np.logaddexp.reduce(a[:, j - 1, :, None] + t, axis=1) + e[:, j]
            for j in range(longest - 2, -1, -1):
                b[:, j] = np.where(on[:, j + 1, None] > 0, np.logaddexp.reduce(t + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2), 0)
            last = on.sum(1).astype(int) - 1
            z = np.logaddexp.reduce(a[np.arange(n), last], axis=1)[:, None]
            p = np.exp(a + b - z[..., None]) * on[..., None]
            both = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, :, None, None]) * on[:, 1:, None, None]
            g = (seen - np.concatenate(((flat.T @ p[real]).ravel(), both.sum((0, 1)).ravel()))) / n - ridge * w / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.steps = w[: 2 * d].reshape(d, 2), w[2 * d :].reshape(2, 2)
        return self

    def decode(self, bs: list[Block]) -> list[int]:
        """The likeliest states, by Viterbi. Only differences between the two states matter."""
        if not bs:
            return []
        if self.scores is None:
            self.scores = [tuple(r) for r in self.weights.tolist()]
        index, scores = self.index, self.scores
        (t00, t01), (t10, t11) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for k, b in enumerate(bs):
            e0 = e1 = 0.0
            for f in b.features:
                if (i := index.get(f)) is not None:
                    e0 += scores[i][0]
                    e1 += scores[i][1]
            if k:
                from0, from1 = (int(s1 + t10 > s0 + t00), int(s1 + t11 > s0 + t01))
                back.append((from0, from1))
                s0, s1 = max(s0 + t00, s1 + t10) + e0, max(s0 + t01, s1 + t11) + e1
            else:
                s0, s1 = e0, e1
        state = int(s1 > s0)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def labelled_pages(count: int = 500, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with a label per leaf block: 1 in the article, 0 elsewhere."""
    r = random.Random(seed)

    def words(a: int, b: int, stop: bool = True) -> str:
        n = r.randint(a, b)
        s = " ".join("".join(r.choice("aeioutnrslmdpk") for _ in range(r.randint(1, 9))) for _ in range(n)).capitalize()
        return s + r.choice([".", ".", ".", "!", "?", ""]) * stop

    def sentence() -> str:
        return r.choice([words(1, 3), words(4, 12), words(10, 40), words(40, 120)])

    def page() -> tuple[str, list[int]]:
        out, labels = [], []

        def put(tag: str, text: str, label: int, attributes: str = "") -> None:
            out.append(f"<{tag}{attributes}>{text}</{tag.split()[0]}>")
            labels.append(label)

        def named(tag: str, *names: str) -> str:
            kind = r.choice(["class", "class", "id", "both"])
            n = r.choice(names)
            return f'<{tag} class="{n}">' if kind == "class" else f'<{tag} id="{n}">' if kind == "id" else f'<{tag} id="{n}-{r.randint(1, 9)}" class="x {n}">'

        def links(n: int) -> None:
            if r.random() < 0.7:
                out.append("<ul>")
                for _ in range(n):
                    put("li", f'<a href="/{r.random()}">{words(1, 4, False)}</a>', 0)
                out.append("</ul>")
            else:
                put("div", " | ".join(f"<a href=x>{words(1, 3, False)}</a>" for _ in range(n)), 0)

        def menu() -> None:
            tag = r.choice(["nav", "nav", "div", "ul"])
            out.append(f"<{tag}>" if tag == "nav" and r.random() < 0.6 else named(tag, "menu", "navbar", "navigation", "breadcrumbs", "top-nav", "pagination"))
            if tag == "ul":
                for _ in range(r.randint(1, 6)):
                    put("li", f"<a href=a>{words(1, 3, False)}</a>", 0)
            else:
                links(r.randint(1, 7))
            out.append(f"</{tag}>")

        def box(tag: str, *names: str, bare: float = 0.0, most: int = 3) -> None:
            out.append(f"<{tag}>" if r.random() < bare else named(tag, *names))
            for _ in range(r.randint(1, most)):
                k = r.random()
                if k < 0.3:
                    put(r.choice(["h2", "h3", "h4"]), words(1, 6, False), 0)
                elif k < 0.75:
                    put(r.choice(["p", "p", "div", "span"]) if tag != "footer" or r.random() < 0.5 else "p", sentence() + r.choice(["", "", f" <a href=z>{words(1, 3)}</a>"]), 0)
                    if out[-1].startswith("<span"):
                        out[-1] = out[-1].replace("span", "p")
                else:
                    links(r.randint(1, 4))
            out.append(f"</{tag}>")

        def advert() -> None:
            k = r.random()
            if k < 0.5:
                put("div", sentence(), 0, f' class="{r.choice(["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo-box", "advertisement"])}"')
            else:
                box(r.choice(["div", "aside", "section"]), "ad", "advert", "sponsored", "promo", "ad-container", most=2)

        def notice() -> None:
            box(r.choice(["div", "section", "aside", "dialog"]), "cookie-notice", "consent", "newsletter", "popup", "gdpr-banner", "notice", "subscribe-box", "paywall", "alert", most=2)

        def side() -> None:
            box(r.choice(["aside", "aside", "div", "section"]), "sidebar", "related", "widget", "recommended", "more-stories", "trending", bare=0.3, most=4)

        def simple() -> None:
            """One block whose element alone says what it is."""
            k = r.random()
            if k < 0.4:
                names = [w for part in ("ad", "menu", "comment", "side", "foot", "notice", "social", "form") for w in r.sample(NAMED[part].split(), 2)]
                put(r.choice(["div", "div", "p", "section", "ul"]), sentence(), 0, r.choice([' class="{}"', ' class="box {}"', ' id="{}"', ' class="site-{}"']).format(r.choice(names)))
            elif k < 0.6:
                put(r.choice(["div", "section"]), f"<p>{sentence()}</p>", 0, f' role="{r.choice(["navigation", "complementary", "contentinfo", "search", "banner", "alert", "dialog"])}"')
            elif k < 0.9:
                tag = r.choice(["aside", "aside", "nav", "form", "noscript", "dialog", "footer"])
                put(tag, r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(sentence()), 0, r.choice(["", "", ' class="x"']))
            else:
                put("div", f"<p>{sentence()}</p>", 0, r.choice([" hidden", ' style="display:none"', ' aria-hidden="true"']))

        def comments() -> None:
            tag = r.choice(["div", "section", "ol", "aside"])
            out.append(named(tag, "comments", "comment-list", "reader-comments", "discussion", "replies", "disqus_thread"))
            if tag != "ol" and r.random() < 0.7:
                put(r.choice(["h2", "h3"]), words(1, 3, False), 0)
            for _ in range(r.randint(1, 5)):
                inner = "li" if tag == "ol" else r.choice(["div", "article", "p"])
                if inner == "p":
                    put("p", sentence(), 0)
                    continue
                out.append(f"<{inner}{r.choice(['', ' class=comment', ' class=reply'])}>")
                for _ in range(r.randint(1, 2)):
                    put("p", sentence(), 0)
                out.append(f"</{inner}>")
            out.append(f"</{tag}>")

        def form() -> None:
            out.append("<form action=s>" if r.random() < 0.6 else named("form", "search", "login", "contact-form", "signup"))
            for _ in range(r.randint(1, 4)):
                put(r.choice(["p", "div", "label", "fieldset"]), words(1, 12, False), 0)
                if out[-1].startswith("<label"):
                    out[-1] = out[-1].replace("label", "p")
            out.append("</form>")

        def article(wrapped: bool) -> None:
            k = r.random()
            if k < 0.7:
                put("h1", words(2, 12, False), 1)
            elif k < 0.85 and wrapped:
                out.append(r.choice(["<header>", '<header class="entry-header">', '<div class="headline">']))
                put("h1", words(2, 12, False), 1)
                if r.random() < 0.4:
                    put("p", words(2, 30), 1)
                out.append("</header>" if "header" in out[-2] or "header" in out[-3] else "</div>")
            for _ in range(r.choice([1, 1, 2, 4, 6, 9, 14])):
                k = r.random()
                if k < 0.62:
                    put("p", r.choice(["", "", "", "<b>", "<em>"]) + sentence() + r.choice(["", "", f" <a href=q>{words(1, 3)}</a> {words(1, 9)}", "<br>" + words(2, 8)]), 1)
                elif k < 0.7:
                    put(r.choice(["h2", "h2", "h3", "h4", "h5"]), words(1, 8, False), 1)
                elif k < 0.75:
                    tag = r.choice(["ul", "ul", "ol", "dl"])
                    out.append(f"<{tag}>")
                    for i in range(r.randint(1, 4)):
                        put("li" if tag != "dl" else ("dt", "dd")[i % 2], words(1, 15), 1)
                    out.append(f"</{tag}>")
                elif k < 0.77 and wrapped:
                    put("div", r.choice(["{}", "<p>{}</p>"]).format(sentence()), 1)
                elif k < 0.78 and wrapped:
                    put("section", f"<p>{sentence()}</p>", 1)
                elif k < 0.8:
                    put("blockquote", sentence(), 1)
                elif k < 0.82:
                    put("pre", words(2, 20, False), 1)
                elif k < 0.83:
                    out.append("<table>")
                    for _ in range(2):
                        out.append("<tr>")
                        for _ in range(2):
                            put("td", words(1, 4, False), 1)
                        out.append("</tr>")
                    out.append("</table>")
                elif k < 0.85:
                    out.append("<figure>")
                    put("figcaption", words(2, 15), 1)
                    out.append("</figure>")
                elif wrapped:
                    r.choice([advert, notice, side, form, simple, simple, simple])()

        put("title", words(2, 8, False), 0)
        for f, chance in ((notice, 0.2), (advert, 0.3), (simple, 0.3)):
            if r.random() < chance:
                f()
        if r.random() < 0.5:
            box("header", "header", "masthead", "site-header", "top", bare=0.6, most=2) if r.random() < 0.7 else box("div", "header", "masthead", "logo", "site-header", "topbar", most=2)
        for f, chance in ((menu, 0.8), (form, 0.2), (advert, 0.4), (side, 0.2), (menu, 0.15), (simple, 0.3)):
            if r.random() < chance:
                f()
        start = r.choice(["<article>", "<article>", "<article class=post>", "<main>", '<main id="main">', "<main><article>", '<div id="content">', '<div class="article-body">', '<div class="post"><div class="entry-content">', '<section class="story">', '<div class="page"><article>', "<div>"])
        out.append(start)
        article(start != "<div>")
        if start != "<div>" and r.random() < 0.15:
            comments()
        out.extend(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", start)))
        for f, chance in ((comments, 0.4), (side, 0.3), (advert, 0.3), (form, 0.25), (menu, 0.15), (notice, 0.2), (simple, 0.4), (simple, 0.3)):
            if r.random() < chance:
                f()
        if r.random() < 0.8:
            if r.random() < 0.5:
                put("footer", "&copy; " + sentence(), 0, r.choice(["", ' class="footer"']))
            else:
                box(*(("footer", "footer", "site-footer") if r.random() < 0.7 else ("div", "footer", "copyright", "bottom", "legal")), bare=0.0, most=3)
        return "<body>" + "".join(out), labels

    return [page() for _ in range(count)]


@functools.lru_cache(maxsize=2)
def trained(count: int = 500, seed: int = 7) -> Field:
    """The field fitted on labelled pages; a page whose markup gives other blocks than were labelled would be an error."""
    pages = []
    for page, labels in labelled_pages(count, seed):
        bs = blocks(page)
        if len(bs) != len(labels):
            raise AssertionError("a labelled page has other blocks than labels")
        pages.append((bs, labels))
    seen: dict[str, int] = {}
    for bs, _ in pages:
        for b in bs:
            for f in b.features:
                seen[f] = seen.get(f, 0) + 1
    return Field(sorted(f for f, n in seen.items() if n >= 5)).fit(pages)


def main_text(field: Field, page: str) -> str:
    bs = blocks(page)
    return "\n".join(b.text for b, s in zip(bs, field.decode(bs), strict=True) if s)


def extract(spark: SparkSession, pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with text and n_chars."""
    field = spark.sparkContext.broadcast(trained())

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(field.value, x.as_py() or "") for x in column]
        return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

    return arrow_map(pages, column, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])
