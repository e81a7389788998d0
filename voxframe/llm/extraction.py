"""Main text of web pages: a linear-chain CRF over the leaf blocks of the document tree, decoded by Viterbi.

A leaf block is a run of text that no block-level tag interrupts. Its features are the tags and class words of its
ancestors and a few facts of its text. The model is trained on labelled pages; those built in are drawn by rule from the
ways in which pages are put together. Edge cases: null, empty and tagless pages are handled (a page without tags is one
block); unclosed and stray tags are tolerated as browsers do; nothing is dropped or capped but what the model rejects, the
raw text of scripts and the like (RAW) and what is drawn or inert (HIDING). One of HIDING that is not closed ends where its
parent closes, an svg also at a block-level tag; if nothing ends it, its text counts. A heading that lies in the body itself, in no
marked element, or that a notice parts from all else of the article, may be taken for the site's.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm import crf
from voxframe.llm.arrow import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
HIDING = {"svg", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes if that is open, up to the tag that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_CLOSERS = BLOCK - {"button", "label", "option", "optgroup", "select", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
TAG_BITS = {t: k for k, t in enumerate("nav header footer aside form article main ul ol table section blockquote pre figure figcaption head dialog menu address details".split())} | {"button": 4, "select": 4, "label": 4, "option": 4, "fieldset": 4, "search": 4}
WORDS = [
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense partner",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip",
    "footer foot copyright colophon legal imprint bottom",
    "sidebar side aside related recommended recommendations widget widgets rail popular trending more teaser teasers",
    "comment comments disqus reply replies respond discussion feedback reader readers",
    "cookie cookies consent notice notices popup modal newsletter subscribe subscription alert gdpr warning message signup announcement paywall overlay toast",
    "share sharing social follow tags toolbox likes",
    "header masthead top topbar logo brand branding site",
    "content article post entry story text main body page prose",
    "form login search signin register contact input",
]
WORD_BITS = {w: 20 + k for k, line in enumerate(WORDS) for w in line.split()}
BITS = 30
HOLDERS = {t: k for k, g in enumerate(["h1 h2 h3 h4 h5 h6", "p", "li dt dd", "td th caption", "div section article main body html", "blockquote pre", "button label option legend summary"]) for t in g.split()}
HINTS = re.compile(r"cookie|privacy|subscri|newsletter|log ?in|sign ?(?:in|up)|comment|advert|sponsor|copyright|all rights|share|follow us|©")  # in lower case

#: One such word in so many characters counts in full, in more in proportion.
HINT_CHARS = 60


class Block:
    __slots__ = ("parts", "mask", "holder", "links")

    def __init__(self, mask: int, holder: int):
        self.parts: list[str] = []
        self.mask, self.holder, self.links = mask, holder, 0


@cache
def _name_bits(names: str) -> int:
    bits = 0
    for word in PIECES.findall(names):
        k = WORD_BITS.get(word.lower())
        if k is not None:
            bits |= 1 << k
    return bits


def _bits(tag: str, attributes: str) -> int:
    k = TAG_BITS.get(tag)
    bits = 0 if k is None else 1 << k
    if attributes and tag not in ("html", "body"):
        for value in NAMES.findall(attributes):
            # long values seldom recur: the cache does not hold them
            bits |= _name_bits(value) if len(value) < 200 else _name_bits.__wrapped__(value)
    return bits


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """(text, bits of the ancestors, kind of the innermost block tag, share of link text) of the leaf blocks in order."""
    out: list[tuple[str, int, int, float]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, list[int]] = defaultdict(list)  # places of each tag on the stack: no search of deep trees
    now = Block(0, 7)
    link = 0

    def flush() -> None:
        nonlocal now
        text = " ".join("".join(now.parts).split())
        if text:
            out.append((text, now.mask, now.holder, min(1.0, now.links / len(text))))
        tag, mask = stack[-1]
        now = Block(mask, HOLDERS.get(tag, 7))

    def push(tag: str, mask: int) -> None:
        opened[tag].append(len(stack))
        stack.append((tag, mask))

    def pop_to(k: int) -> None:
        for tag, _ in stack[k:]:
            opened[tag].pop()
        del stack[k:]

    def innermost(tags: set[str]) -> int:
        """The place of the last of these that is open; 0: none."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    at, end, last = 0, len(page), page.rfind(">")
    # the open element of HIDING, where its content begins and what is open in it; those that nothing ends
    hide, begin, within, endless = "", 0, Counter(), set()
    while at < end or hide:
        # past the last ">" there are no tags, and no need to look for their ends; an open comment hides the rest
        m = TOKEN.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if m is None and (hidden := page.find("<!--", max(at, last))) >= 0:
            stop = hidden
        if stop > at and not hide:
            text = entities.unescape(page[at:stop]) if "&" in page[at:stop] else page[at:stop]
            now.parts.append(text)
            if link:
                now.links += len(text)
        if not m:
            if not hide:
                break
            endless.add(hide)
            at, hide = begin, ""
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, tag, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if hide and (tag not in RAW or closing or (hide, tag) == ("svg", "title")):
            if tag in BLOCK and (within[tag] == 0 and opened[tag] if closing else hide == "svg" and not within["foreignobject"] and not within["desc"]):
                hide = ""
            elif closing and tag == hide:
                hide = ""
                continue
            else:
                if tag in BLOCK or tag in ("foreignobject", "desc"):
                    within[tag] = max(0, within[tag] + (-1 if closing else not attributes.endswith("/")))
                continue
        if tag == "br":
            now.parts.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in RAW:
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = over.end() if over else end
        elif tag in HIDING:
            if not closing and not attributes.endswith("/") and tag not in endless:
                hide, begin, within = tag, at, Counter()
        elif tag in BLOCK:
            if closing:
                k = innermost({tag})
                flush()
                if k:
                    pop_to(k)
                    now = Block(stack[-1][1], HOLDERS.get(stack[-1][0], 7))
                link = 0
                continue
            flush()
            if tag in P_CLOSERS:
                k = len(stack) - 1
                if stack[k][0] == "p":
                    pop_to(k)
            if tag in CLOSES:
                shut, bound = CLOSES[tag]
                edge = innermost(bound)
                while (k := innermost(shut)) > edge:
                    pop_to(k)
                    if tag != "tr":
                        break
            if tag == "body" and opened["head"]:
                held = [s for s in stack[1:] if s[0] != "head"]
                pop_to(1)
                for s in held:
                    push(*s)
            if tag not in VOID:
                push(tag, stack[-1][1] | _bits(tag, attributes))
            link = 0
            now = Block(stack[-1][1], HOLDERS.get(stack[-1][0], 7))
    flush()
    return out


def features(found: list[tuple[str, int, int, float]], lengths: list[int]) -> np.ndarray:
    n = len(found)
    if not n:
        return np.zeros((0, BITS + 8 + 9))
    mask = np.array([b[1] for b in found], dtype=np.int64)
    size = np.array([len(b[0]) for b in found], dtype=float)
    words = np.array([b[0].count(" ") + 1 for b in found], dtype=float)
    own = np.column_stack(
        [
            np.log1p(size) / 5,
            words < 4,
            words > 20,
            [b[3] for b in found],
            [b[3] > 0.6 for b in found],
            [b[0][-1] in ".!?…:;\"'»”" for b in found],
            [min(1.0, HINT_CHARS * sum(1 for _ in HINTS.finditer(b[0].lower())) / len(b[0])) for b in found],
            np.concatenate([np.arange(k) / max(k, 1) for k in lengths]),
            mask == 0,
        ]
    ).astype(float)
    return np.hstack([(mask[:, None] >> np.arange(BITS)) & 1, np.eye(8)[[b[2] for b in found]], own]).astype(float)


# ---- labelled pages -------------------------------------------------------------------------------------------------


def _sentence(rng: random.Random, least: int, most: int) -> str:
    parts = ["re", "an", "ti", "on", "er", "the", "in", "ou", "é", "ch", "un", "la", "keit", "ción", "o", "st", "to", "of"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    if rng.random() < 0.15:
        words = [w + rng.choice(["###", "$$$", "***", "&amp;&amp;", "!!"]) for w in words]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page and, for each of its leaf blocks in order, 1 if it belongs to the article."""
    out: list[str] = []
    marks: list[int] = []
    say = lambda least=1, most=12: _sentence(rng, least, most)
    pick = rng.choice

    def put(tag: str, text: str, label: int, names: str = "") -> None:
        close = "" if tag == "p" and rng.random() < 0.2 else f"</{tag}>"
        if rng.random() < (0.04 if label else 0.12):
            text += " " + pick(["Cookie policy", "subscribe", "log in", "share", "comments", "privacy", "advertisement", "follow us", "newsletter"])
        inner = pick(["{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>", "<em>{}", "<b>{}<br>"]).format(text)
        out.append(f"<{tag}{names}>{inner}{close}")
        marks.append(label)

    def names(*words: str) -> str:
        return pick([f' class="{pick(words)}"', f' id="{pick(words)}"', f' class="{pick(words)} {pick(["box", "inner", "wide", "x1", "clearfix"])}"'])

    def menu() -> None:
        kind = pick(["nav", "nav", "ul", "div", "navul"])
        head = {"nav": "<nav>", "navul": "<nav><ul>", "ul": f"<ul{names('menu', 'nav', 'navigation', 'main-menu')}>", "div": f"<div{names('menu', 'navbar', 'breadcrumbs', 'nav')}>"}[kind]
        out.append(head)
        for _ in range(rng.randint(2, 7)):
            text = f'<a href="/x">{say(1, 2)}</a>' if rng.random() < 0.9 else say(1, 2)
            if kind in ("ul", "navul"):
                put("li", text, 0)
            else:
                put(pick(["p", "div", "li"]), text, 0)
        out.append({"nav": "</nav>", "navul": "</ul></nav>", "ul": "</ul>", "div": "</div>"}[kind])

    def group(tags: list[str], words: tuple[str, ...], least: int, most: int, named: float = 0.9, body: tuple[str, ...] = ("p", "p", "div", "li", "h3")) -> None:
        tag = pick(tags)
        out.append(f"<{tag}{names(*words) if tag in ('div', 'section', 'ul', 'form', 'table') and rng.random() < named or rng.random() < 0.3 else ''}>")
        if rng.random() < 0.35 and tag != "form":
            out.append(say(2, 14))
            marks.append(0)
        else:
            for _ in range(rng.randint(least, most)):
                text = say(1, pick([3, 12, 40]))
                put(pick(body), f'<a href="/y">{text}</a>' if rng.random() < 0.3 else text, 0)
        out.append(f"</{tag}>")

    advert = lambda: group(["div", "div", "aside", "section"], ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "banner"), 1, 2, 1.0)
    notice = lambda: group(["div", "section", "dialog"], ("cookie-notice", "notice", "cookie-banner", "consent", "alert", "newsletter", "popup", "subscribe", "modal", "gdpr"), 1, 3, 1.0)
    side = lambda: group(["aside", "aside", "div", "section"], ("sidebar", "related", "widget", "recommended", "popular", "right-sidebar"), 1, 5)
    form = lambda: group(["form", "form", "div"], ("login-form", "search-form", "newsletter", "contact-form", "subscribe"), 1, 4, 1.0, ("label", "p", "button", "div"))
    share = lambda: group(["div", "ul"], ("share", "social", "share-buttons", "tags"), 1, 4, 1.0, ("li", "p"))

    def comments() -> None:
        tag = pick(["section", "div", "ol"])
        out.append(f"<{tag}{names('comments', 'comment-list', 'reader-comments', 'discussion', 'responses comments', 'disqus')}>")
        if rng.random() < 0.6:
            put(pick(["h2", "h3"]), say(1, 3), 0)
        for _ in range(rng.randint(1, 5)):
            wrap = pick(["article", "div", "li", "div"])
            out.append(f"<{wrap}{names('comment', 'reply', 'comment-body') if rng.random() < 0.8 else ''}>")
            for _ in range(rng.randint(1, 2)):
                put(pick(["p", "p", "div"]), say(2, pick([10, 40])), 0)
            out.append(f"</{wrap}>")
        out.append(f"</{tag}>")

    def article() -> None:
        tag = pick(["article", "article", "article", "main", "div", "div", "section"])
        inside = pick(["", "", "", "div"])
        out.append(f"<{tag}{names('content', 'article', 'post', 'entry-content', 'story', 'main-content', 'article-body', 'post-body') if tag in ('div', 'section') and rng.random() < 0.85 or rng.random() < 0.25 else ''}>")
        headed = rng.random() < 0.15
        if headed:
            out.append("<header>")
        if rng.random() < 0.9:
            put(pick(["h1", "h1", "h2"]), say(1, 12), 1)
        if headed:
            if rng.random() < 0.4:
                put("p", say(2, 10), 1)
            out.append("</header>")
        if inside:
            out.append(f"<div{names('text', 'body', 'entry', 'content', 'prose')}>")
        for _ in range(pick([0, 1, 2, 4, 8, 16, 24])):
            kind = rng.random()
            if kind < 0.72:
                text = say(1, pick([1, 4, 20, 60, 120]))
                put("p", text if rng.random() < 0.9 else f'{text} <a href="/z">{say(1, 3)}</a>', 1)
            elif kind < 0.78:
                put(pick(["h2", "h3", "h4"]), say(1, 6), 1)
            elif kind < 0.84:
                tag2 = pick(["ul", "ol"])
                out.append(f"<{tag2}>")
                for _ in range(rng.randint(1, 5)):
                    put("li", say(1, 20), 1)
                out.append(f"</{tag2}>")
            elif kind < 0.88:
                put(pick(["blockquote", "pre", "div"]), say(3, 30), 1)
            elif kind < 0.90:
                out.append("<table>")
                for _ in range(rng.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(2):
                        put(pick(["td", "td", "th"]), say(1, 4), 1)
                    out.append("</tr>")
                out.append("</table>")
            elif kind < 0.92:
                out.append("<figure>")
                put("figcaption", say(2, 12), 1)
                out.append("</figure>")
            else:
                pick([advert, side, form, share, notice])()
        if inside:
            out.append("</div>")
        if rng.random() < 0.08:
            comments()
        out.append(f"</{tag}>")

    out.append('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Name</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
    wrapped = rng.random() < 0.4
    if wrapped:
        out.append(f"<div{names('page', 'wrapper', 'container', 'site')}>")
    if rng.random() < 0.4:
        tag = pick(["header", "header", "div"])
        out.append(f"<{tag}{names('header', 'masthead', 'top', 'site-header') if tag == 'div' else ''}>")
        for _ in range(rng.randint(1, 3)):
            put(pick(["h1", "h2", "p", "div"]), say(1, 8), 0)
        if rng.random() < 0.5:
            menu()
        out.append(f"</{tag}>")
    before = [menu, advert, notice, form]
    rng.shuffle(before)
    for part in before:
        if rng.random() < (0.8 if part is menu else 0.35):
            part()
    if rng.random() < 0.25:
        side()
    article()
    after = [side, advert, notice, form, share, comments]
    rng.shuffle(after)
    for part in after:
        if rng.random() < 0.3:
            part()
    if rng.random() < 0.85:
        tag = pick(["footer", "footer", "div"])
        out.append(f"<{tag}{names('footer', 'copyright', 'colophon', 'site-footer') if tag == 'div' else ''}>")
        if rng.random() < 0.5:
            out.append("&copy; site.example.com &middot; " + say(2, 10))
            marks.append(0)
        else:
            for _ in range(rng.randint(1, 4)):
                put(pick(["p", "p", "li", "div"]), pick([say(1, 12), f'<a href="/l">{say(1, 3)}</a>']), 0)
        out.append(f"</{tag}>")
    if wrapped:
        out.append("</div>")
    out.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(out), marks


@cache
def built_in_model(pages: int = 500, seed: int = 23) -> crf.Chain:
    rng = random.Random(seed)
    return train([labelled_page(rng) for _ in range(pages)])


def train(pages: list[tuple[str, list[int]]]) -> crf.Chain:
    """Pages with a label per leaf block, as blocks() gives them."""
    found = [blocks(p) for p, _ in pages]
    for f, (page, marks) in zip(found, pages):
        if len(f) != len(marks):
            raise ValueError(f"{len(marks)} labels for {len(f)} blocks of {page[:80]!r}")
    lengths = [len(f) for f in found]
    return crf.fit(features([b for f in found for b in f], lengths), np.array([k for _, m in pages for k in m]), lengths, steps=160, piece=64)


def extract(pages: DataFrame, model: crf.Chain | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text: the article's blocks joined by line feeds."""
    model = model or built_in_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            found = [blocks(h.decode("utf-8", "surrogatepass")) for h in raw]
            lengths = [len(f) for f in found]
            label = model.decode(features([b for f in found for b in f], lengths), np.array(lengths))
            texts, at = [], 0
            for f in found:
                texts.append("\n".join(b[0] for b, keep in zip(f, label[at : at + len(f)]) if keep))
                at += len(f)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string")
