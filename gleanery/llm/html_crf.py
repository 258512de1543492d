"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A leaf block is the text between two block-level tags. Its features are its ancestors' tags and class, id and role words,
and its own text: length, share of linked text, closing punctuation, stock phrases. Two labels, article and rest; weights
and transitions are trained by gradient steps on the exact likelihood (forward-backward) of labelled pages, and Viterbi
picks a page's labels. Labelled pages are made by ``labelled_pages`` from page layouts, a fixed number and seed.

Never text: scripts, styles, comments, form controls, options, templates, the head. Character references are decoded, white space in
a block becomes one space, a ``br`` is white space, blocks are joined in page order by one newline.

A page that would have no text, though blocks stand outside menus, headers, footers, asides, forms, hidden and otherwise
named parts, gets the best labels of those that make such a block article.

Edge cases: null and empty html give an empty text; unclosed and stray tags are closed or skipped as browsers do; a page cut
off in a tag ends there; blocks without text don't count; repeated rows are each extracted; an empty table gives an empty
result; other columns are not read. A page is one row of one task, whatever its size; nothing is cut off.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav object ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul video audio".split()
)
RAW = frozenset("script style textarea title noscript template svg select datalist head iframe".split())
#: Of these, the elements that run to the end of the page if nothing closes them; others without an end are skipped as tags.
TO_END = frozenset("script style textarea title".split())
ENDS_P = BLOCK - {"button", "label", "select", "caption", "td", "th", "tr", "iframe", "video", "audio", "body", "html"}
CLOSES = {"option": {"option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"option": {"select", "datalist"}, "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Words of class, id and role attributes that layouts use.
NAMES = frozenset(
    "ad advert advertisement sponsor sponsored promo promotion banner sidebar side aside widget related recommended recommendation "
    "share social menu nav navbar navigation breadcrumb footer header masthead top bottom cookie consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe signup login search form comment reply respond discussion thread disqus "
    "pagination pager tag category meta byline author skip toolbar copyright legal disclaimer content article post entry main body "
    "story text page contentinfo complementary dialog hidden".split()
)
CUES = (
    "cookie", "privacy", "subscrib", "newsletter", "sign up", "sign in", "log in", "login", "advert", "sponsor", "copyright", "©", "all rights reserved",
    "share this", "share on", "follow us", "read more", "related", "comment", "reply", "replies", "terms of", "contact us", "home page", "menu",
    "posted by", "wrote:", "promoted", "buy now", "search",
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|[^>]*(?:>|\Z))", re.S)
#: Elements and names that hold an article, and those under which a block is no part of one when a page must have a text.
HOLDS_TEXT = frozenset("in:article in:main named:content named:article named:post named:entry named:story named:body".split())
NO_TEXT = frozenset("in:nav in:footer in:header in:aside in:form in:dialog in:menu in:button in:label named:hidden named:comment".split())
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
WORD = re.compile(r"[a-z]+")


class Element:
    """An open element; ``context`` are the features that all blocks under it share."""

    __slots__ = ("tag", "context")

    def __init__(self, tag: str, context: frozenset):
        self.tag, self.context = tag, context


@lru_cache(100_000)
def _context(above: frozenset, tag: str, attributes: str) -> frozenset:
    own = {f"in:{tag}"}
    for name, value in ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or "display:none" in value.replace(" ", "") or value == "true":
                own.add("named:hidden")
        else:
            for w in WORD.findall(value):
                w = w if w in NAMES else w.removesuffix("s").removesuffix("ie") + ("y" if w.endswith("ies") else "")
                if w in NAMES:
                    own.add(f"named:{w}")
    return above | own


def leaf_blocks(page: str | None) -> list[tuple[str, int, str, frozenset]]:
    """(text, linked characters, parent tag, context) of every block with text, in page order."""
    page = page or ""
    stack, out, parts, linked, in_link, at, size = [Element("", frozenset())], [], [], 0, False, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and stack[-1].tag != "option":
                out.append((text, linked, stack[-1].tag, stack[-1].context))
            parts.clear()
        linked = 0

    def close(tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < size:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                flush()
                in_link = False
                close({tag}, set())
        elif tag in RAW:
            flush() if tag in BLOCK or tag == "head" else None
            if not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_END:
                    at = size
        elif tag == "a":
            in_link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            in_link = False
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "button", "caption", "table"})
            if tag in CLOSES:
                close(CLOSES[tag], SCOPE[tag])
            if tag != "hr":
                stack.append(Element(tag, _context(stack[-1].context, tag, m[3][:-1])))
    flush()
    return out


def text_features(text: str, linked: int, parent: str) -> list[str]:
    words = text.count(" ") + 1
    return [
        "bias",
        f"words:{min(6, words.bit_length())}",
        f"linked:{min(3, 4 * linked // max(1, len(text)))}",
        "stop" if text[-1] in ".!?…\"”'" else "no stop",
        "cue" if len(text) < 400 and any(map(text.lower().__contains__, CUES)) else "no cue",
        f"parent:{parent}",
    ]


def _may_be_text(context: frozenset) -> bool:
    """Whether a block stands under no menu, form, header, footer or named part that isn't an article's."""
    return NO_TEXT.isdisjoint(context) and all(f in HOLDS_TEXT or not f.startswith("named:") or f in ("named:page", "named:text") for f in context)


def place_features(parent: str, context: frozenset) -> list[str]:
    """Of a block's place: a heading where articles are held; outside of menus, forms and named parts."""
    heading = parent[:1] == "h" and parent[1:].isdigit() and not HOLDS_TEXT.isdisjoint(context)
    return ["heading in article"] * heading + ["outside named parts"] * _may_be_text(context)


def block_features(block: tuple[str, int, str, frozenset]) -> list[str]:
    text, linked, parent, context = block
    return [*text_features(text, linked, parent), *sorted(context), *place_features(parent, context)]


class Crf:
    """Two labels; ``weights[feature]`` is the score of label 1 over label 0."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)

    def emissions(self, blocks: list) -> list[float]:
        get, seen = self.weights.get, {}
        out = []
        for text, linked, parent, context in blocks:
            above = (context, parent)
            if above not in seen:
                seen[above] = sum(get(f, 0.0) for f in (*context, *place_features(parent, context)))
            out.append(seen[above] + sum(get(f, 0.0) for f in text_features(text, linked, parent)))
        return out

    def decode(self, blocks: list) -> list[int]:
        """Viterbi. A page that would have no text, though blocks stand outside menus, forms and named parts, gets the
        best labels among those that make one of these blocks article."""
        if not blocks:
            return []
        scores = self.emissions(blocks)
        y = self._best(scores)
        if not any(y):
            free = [k for k, (_, _, _, context) in enumerate(blocks) if _may_be_text(context)]
            if free:
                return self._best_with(scores, free)
        return y

    def _best_with(self, scores: list[float], free: list[int]) -> list[int]:
        """The best labels with some block of ``free`` as article: the best paths up to and from each, joined there."""
        e, n = np.array(scores), len(scores)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + (0, e[0])
        for k in range(1, n):
            ahead[k] = (ahead[k - 1][:, None] + self.trans).max(0) + (0, e[k])
        for k in range(n - 2, -1, -1):
            behind[k] = (self.trans + behind[k + 1] + (0, e[k + 1])).max(1)
        chosen = max(free, key=lambda k: (ahead[k, 1] + behind[k, 1], -k))
        forced = list(scores)
        forced[chosen] += 1e9
        return self._best(forced)

    def _best(self, scores: list[float]) -> list[int]:
        (t00, t01), (t10, t11) = self.trans.tolist()
        a, b, back = float(self.start[0]), float(self.start[1]) + scores[0], []
        for e in scores[1:]:
            p0, p1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((p0, p1))
            a, b = (b + t10 if p0 else a + t00), (b + t11 if p1 else a + t01) + e
        y = [int(b > a)]
        for p in reversed(back):
            y.append(int(p[y[-1]]))
        return y[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Adaptive gradient ascent on the log-likelihood, page by page."""
        order, past = random.Random(5), {}
        past_trans, past_start = np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(rounds):
            order.shuffle(pages)
            for rows, labels in pages:
                n = len(rows)
                e = np.zeros((n, 2))
                e[:, 1] = [sum(self.weights.get(f, 0.0) for f in r) for r in rows]
                ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
                ahead[0] = self.start + e[0]
                for k in range(1, n):
                    ahead[k] = np.logaddexp(ahead[k - 1, 0] + self.trans[0], ahead[k - 1, 1] + self.trans[1]) + e[k]
                for k in range(n - 2, -1, -1):
                    later = e[k + 1] + behind[k + 1]
                    behind[k] = np.logaddexp(self.trans[:, 0] + later[0], self.trans[:, 1] + later[1])
                whole = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
                p = np.exp(ahead + behind - whole)
                for r, y, q in zip(rows, labels, p[:, 1], strict=True):
                    for f in r:
                        g = (y - q) - decay * self.weights.get(f, 0.0)
                        past[f] = past.get(f, 1e-6) + g * g
                        self.weights[f] = self.weights.get(f, 0.0) + rate * g / past[f] ** 0.5
                pair = np.exp(ahead[:-1, :, None] + self.trans + (e[1:] + behind[1:])[:, None, :] - whole).sum(0)
                g = -pair
                np.add.at(g, (labels[:-1], labels[1:]), 1)
                past_trans += g * g
                self.trans += rate * g / np.sqrt(past_trans)
                g = -p[0]
                g[labels[0]] += 1
                past_start += g * g
                self.start += rate * g / np.sqrt(past_start)


#: What holds the article of a training page: an article or main element, a div with a telling name, one without, or the body.
FAMILY_WEIGHTS = {"article": 50, "main": 13, "named": 22, "plain": 10, "body": 5}
FAMILIES = tuple(FAMILY_WEIGHTS)


def labelled_pages(count: int = 600, seed: int = 11, families: tuple[str, ...] = FAMILIES) -> list[tuple[str, list[int]]]:
    """Pages of varied layouts, and the label of each leaf block. A sixth of them hold an article and nothing else."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "mo", "li", "sen", "kor", "eau", "ung", "ción", "the", "an"]) for _ in range(r.randint(1, 3)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: phrase(1, 30) + r.choice([".", ".", ".", "!", "?", "", ":"])
    label: list[int] = []

    def put(tag: str, text: str, y: int, attributes: str = "") -> str:
        label.append(y)
        return f"<{tag}{attributes}>{text}" + ("" if tag == "p" and r.random() < 0.3 else f"</{tag}>")

    def named(*names: str) -> str:
        return r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f" class='{r.choice(names)} x{r.randint(1, 9)}'"])

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(put("li", f'<a href="/{word()}">{phrase(1, 3)}</a>', 0) for _ in range(r.randint(2, 7))) + f"</{tag}>"

    def wrapped(tags: list[str], names: list[str], inner, always: bool = False) -> str:
        tag = r.choice(tags)
        mark = named(*names) if tag == "div" or tag == "section" or always or r.random() < 0.3 else ""
        return f"<{tag}{mark}>{inner()}</{tag}>"

    few = lambda tag, y, n=3: lambda: "".join(put(tag, sentence(), y) for _ in range(r.randint(1, n)))
    stock = lambda *texts: lambda: put(r.choice(["p", "div", "span-p"]).replace("span-p", "p"), r.choice(texts), 0)
    nav = lambda: wrapped(["nav", "div", "header"], ["menu", "nav", "navbar", "main-menu", "top-nav", "navigation", "breadcrumb"], links)
    header = lambda: wrapped(["header", "div"], ["header", "masthead", "top-header", "site-header"], lambda: put(r.choice(["h1", "p", "div"]), phrase(1, 6), 0) + (links() if r.random() < 0.5 else ""))
    footer = lambda: wrapped(["footer", "footer", "div"], ["footer", "site-footer", "copyright", "bottom"], lambda: put("p", f"&copy; {r.randint(1999, 2026)} {sentence()}", 0) + (links() if r.random() < 0.4 else "") + few("div", 0)())
    side = lambda: wrapped(["aside", "div", "section"], ["sidebar", "widget", "side", "related", "recommended"], lambda: put(r.choice(["h2", "h3", "p"]), phrase(1, 4), 0) + r.choice([links, few("p", 0, 4)])())
    advert = lambda: wrapped(["div", "div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-box"], few(r.choice(["p", "div"]), 0), True)
    bare = lambda: f"<div{named('ad', 'promo', 'sponsor', 'notice', 'banner')}>{put('div', sentence(), 0)}</div>"
    notice = lambda: wrapped(["div", "section", "dialog", "aside"], ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "modal"], lambda: r.choice([stock("We use cookies to improve this site.", "Subscribe to our newsletter!", "Please accept our privacy terms."), few("p", 0)])() + (put("button", phrase(1, 2), 0) if r.random() < 0.5 else ""), True)
    form = lambda: f"<form action=/{word()}{named('search', 'login', 'signup', 'form') if r.random() < 0.5 else ''}>{put('label', phrase(1, 3), 0)}<input name=q>{put('button', phrase(1, 2), 0)}{few('p', 0)() if r.random() < 0.4 else ''}</form>"
    comments = lambda: wrapped(["section", "div", "ol", "aside"], ["comments", "comment-list", "replies", "discussion", "respond", "comment-thread"], lambda: (put("h3", f"{r.randint(1, 90)} comments", 0) if r.random() < 0.5 else "") + "".join(f"<{(t := r.choice(['div', 'li', 'article']))}{named('comment', 'reply', 'comment-body')}>{few('p', 0)()}</{t}>" for _ in range(r.randint(1, 5))), True)
    share = lambda: f"<div{named('share', 'social', 'tags', 'meta', 'byline')}>{put('p', r.choice(['Share this', phrase(1, 5)]), 0)}</div>"
    junk = [advert, bare, notice, form, share, side]

    def part(heading: bool, divs: bool) -> str:
        if heading:
            return put(r.choice(["h2", "h3"]), phrase(1, 8), 1)
        kind = 0.14 if divs else r.random()
        if kind < 0.07:
            return put("p", r.choice(["All rights reserved.", "Read more about cookies and privacy in this article.", f"Copyright {sentence()}", f"Subscribe to {sentence()}", f"She wrote: {sentence()}"]), 1)
        if kind < 0.1:
            return put("p", f'<a href="/{word()}">{sentence()}</a>', 1)
        if kind < 0.12:
            return put("p", r.choice(["&lt;&amp;&eacute;", "&hellip;", "*", "&mdash; &mdash;", phrase(1, 2)]), 1)
        if kind < 0.14:
            return put("p", sentence(), 0, r.choice([' style="display:none"', " hidden", ' style="display: none;"', ' aria-hidden="true"']))
        if kind < 0.2:
            lead = r.choice(["", f"<span>{phrase(1, 12)}</span>", sentence()])
            label.extend([1] * bool(lead))
            return f"<div>{lead}{put('div', f'{sentence()}<br><br>{sentence()}', 1)}</div>"
        if kind < 0.75:
            return put("p", " ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 8]))) + (f' <a href="/x">{phrase(1, 4)}</a> {sentence()}' if r.random() < 0.2 else ""), 1)
        if kind < 0.83:
            return put("p", f"<b>{phrase(1, 12)}<br>", 1)
        if kind < 0.9:
            return "<ul>" + "".join(put("li", sentence(), 1) for _ in range(r.randint(2, 5))) + "</ul>"
        return f"<blockquote>{put('p', sentence(), 1)}</blockquote>" if kind < 0.95 else put("pre", sentence(), 1)

    def article() -> str:
        family = r.choices(families, [FAMILY_WEIGHTS[f] for f in families])[0]
        divs = family in ("plain", "body") and r.random() < 0.4
        title = put("h1", phrase(1, 12), 1) if r.random() < (0.2 if divs else 0.85) else ""
        title = f"<header>{title}</header>" if title and r.random() < 0.15 else title
        body = [title]
        for k in range(r.choice([1, 2, 5, 9, 14])):
            body.append(part(k > 0 and r.random() < 0.15, divs and r.random() < 0.6))
            if r.random() < 0.06:
                body.append(r.choice(junk)())
        if r.random() < 0.15:
            body.append(comments())
        if family == "article":
            open_, close_ = f"<article{named('post', 'story', 'entry') if r.random() < 0.3 else ''}>", "</article>"
        elif family == "main":
            open_, close_ = "<main>", "</main>"
        elif family == "named":
            open_, close_ = f"<div{named('content', 'article', 'post', 'entry-content', 'main', 'article-body', 'story', 'page-content')}>", "</div>"
        elif family == "plain":
            open_, close_ = f"<div{r.choice(['', ' id=wrap', ' class=x1', ' id=container'])}>", "</div>"
        else:
            open_, close_ = "", ""
        return open_ + "".join(body) + close_

    out = []
    for _ in range(count):
        label.clear()
        made, alone = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>", r.random() < 1 / 6
        for f, chance in ((notice, 0.2), (header, 0.4), (nav, 0.8), (advert, 0.3), (bare, 0.2), (side, 0.2), (form, 0.15)):
            made += f() if r.random() < chance and not alone else ""
        made += article()
        for f, chance in ((comments, 0.3), (share, 0.15), (side, 0.3), (form, 0.15), (advert, 0.2), (notice, 0.1), (footer, 0.85)):
            made += f() if r.random() < chance and not alone else ""
        out.append((made + "</body></html>" * r.randint(0, 1), list(label)))
    return out


@lru_cache(1)
def trained() -> Crf:
    rows = []
    for page, labels in labelled_pages():
        found = [block_features(b) for b in leaf_blocks(page)]
        if len(found) == len(labels):
            rows.append((found, labels))
    crf = Crf()
    crf.train(rows)
    return crf


def main_text(page: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b[0] for b, y in zip(blocks, crf.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    model = crf or trained()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h, model) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
