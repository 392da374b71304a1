"""Main text of web pages: a linear-chain conditional random field over DOM
leaf blocks, decoded by Viterbi.

A page is its leaf blocks in page order (:mod:`html_blocks`); a block is main
text or not.  Features of a block are the tags and the class and id words
above it, pairs of parent and child tags, its own element, and its text:
length, link share, punctuation, case, digits, words of short blocks.  The
transition between two blocks depends on whether one element holds both.

Training pages are of two kinds, both labelled block by block: real pages of
the table that mark their article themselves (one ``article`` or ``main``
element), at most ``TRAIN_PAGES`` of ``TRAIN_CHARS`` characters, chosen by a
hash; and pages that :func:`layout` composes of the usual parts of web pages
from words of those, which cover parts and class names that the table may not
have.  Some copies lose their class words or all marks, so that the text
features learn as well.

Scale: the field is fitted on that bounded sample and is a table of some
thousand weights; every page is read and decoded whole in one pass, without a
shuffle.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.html_blocks import Block, blocks

#: Real pages that training sees at most, their length at most, and composed pages.
TRAIN_PAGES, TRAIN_CHARS, LAYOUT_PAGES = 100, 100_000, 2000
#: Chance of a training page to lose its class words, and to lose all marks.
LOSE_WORDS, LOSE_MARKS = 0.25, 0.1
STEPS, RATE, DECAY = 120, 0.1, 1e-4
SEED = 12
#: Mark of the blocks that :func:`layout` labels as main text.
MAIN = "mainblock"
PAGES_AT_ONCE = 200

_SIGN = re.compile(r"[^\w\s]")
_SENTENCE_END = (".", "!", "?", "…", "。", ".”", ".\"")


# ------------------------------------------------------------------- features
def _step(value: float, cuts) -> int:
    return sum(value >= c for c in cuts)


def text_marks(block: Block, at: int, count: int) -> list[str]:
    """Features of the text and the place of a block."""
    text = block.text
    words = text.split()
    n = len(words)
    out = [
        "1", f"n{_step(n, (2, 4, 8, 16, 32, 64))}", f"l{_step(block.linked, (0.01, 0.35, 0.8))}",
        f"s{_step(len(_SIGN.findall(text)) / n, (0.02, 0.08, 0.2, 0.6))}",
        f"d{_step(sum(map(str.isdigit, text)) / len(text), (0.01, 0.1, 0.3))}",
        f"p{_step(at / count, (0.1, 0.3, 0.7, 0.9))}",
        f"e{int(text.endswith(_SENTENCE_END))}", f"u{int(text[0].isupper())}{int(n > 1 and text.isupper())}",
        f"o:{block.tag}", f"on:{block.tag}{_step(n, (4, 16))}", f"ol:{block.tag}{int(block.linked > 0.5)}",
    ]
    if "©" in text:
        out.append("c")
    out += [f"ow:{w}" for w in block.own]
    if n <= 8:
        out += [f"w:{w.strip('.,:!?()|').lower()}" for w in words]
    return out


def features(page: list[Block]) -> tuple[list[list[str]], list[int]]:
    """Features of every block, and the kind of the edge to the one before: 1
    where one element holds both."""
    marks, edges, before = [], [], None
    for at, block in enumerate(page):
        marks.append([*text_marks(block, at, len(page)), *block.above])
        edges.append(int(block.parent == before))
        before = block.parent
    return marks, edges


# ------------------------------------------------------------------ the field
@dataclass
class Field:
    """Weights of the features for main text, of starts, ends and transitions
    (by kind of edge, label before, label)."""

    weights: dict
    start: np.ndarray
    end: np.ndarray
    moves: np.ndarray

    def decode(self, marks: list[list[str]], edges: list[int]) -> list[int]:
        """The likeliest labels of a page, by Viterbi; a tie goes to 0."""
        get, moves = self.weights.get, self.moves.tolist()
        low, high, back = float(self.start[0]), float(self.start[1]), []
        for at, ms in enumerate(marks):
            if at:
                (a, b), (c, d) = moves[edges[at]]
                to0, to1 = int(high + c > low + a), int(high + d > low + b)
                back.append((to0, to1))
                low, high = (high + c if to0 else low + a), (high + d if to1 else low + b)
            high += sum(get(m, 0.0) for m in ms)
        if not marks:
            return []
        label = int(high + float(self.end[1]) > low + float(self.end[0]))
        labels = [label]
        for steps in reversed(back):
            label = steps[label]
            labels.append(label)
        return labels[::-1]


class Batch:
    """Training pages as arrays, the longest first: pages by place, features by
    block, and how many pages reach a place."""

    def __init__(self, pages, vocabulary: dict[str, int]):
        pages = sorted(pages, key=lambda p: -len(p[0]))
        longest = len(pages[0][0])
        self.size = np.array([len(m) for m, _, _ in pages])
        self.labels = np.zeros((len(pages), longest), np.int64)
        self.edges = np.zeros((len(pages), longest), np.int64)
        slot, index = [], []
        for i, (marks, edges, labels) in enumerate(pages):
            self.labels[i, :len(labels)] = labels
            self.edges[i, :len(edges)] = edges
            for t, ms in enumerate(marks):
                known = {vocabulary[m] for m in ms if m in vocabulary}
                slot += [i * longest + t] * len(known)
                index += known
        self.slot, self.index = np.array(slot, np.int64), np.array(index, np.int64)
        self.real = np.arange(longest) < self.size[:, None]
        self.reach = self.real.sum(axis=0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(*np.moveaxis(x, axis, 0))


def loss_and_gradient(batch: Batch, w, start, end, moves):
    """Mean negative log-likelihood of the labels by the forward recursion, and
    its gradient by forward and backward, over all pages at once."""
    pages, longest = batch.labels.shape
    rows, last, y = np.arange(pages), batch.size - 1, batch.labels
    gain = np.zeros((pages, longest, 2))
    gain[:, :, 1] = np.bincount(batch.slot, w[batch.index], pages * longest).reshape(pages, longest)
    ahead, behind = np.zeros_like(gain), np.zeros_like(gain)
    ahead[:, 0] = start + gain[:, 0]
    for t in range(1, longest):
        n = batch.reach[t]
        ahead[:n, t] = gain[:n, t] + _log_sum(ahead[:n, t - 1, :, None] + moves[batch.edges[:n, t]], 1)
    behind[rows, last] = end
    for t in range(longest - 1, 0, -1):
        n = batch.reach[t]
        behind[:n, t - 1] = _log_sum(
            moves[batch.edges[:n, t]] + (gain[:n, t] + behind[:n, t])[:, None, :], 2)
    total = _log_sum(ahead[rows, last] + end, 1)
    share = np.exp(ahead + behind - total[:, None, None]) * batch.real[:, :, None]
    inner = batch.real[:, 1:]
    steps = (batch.edges[:, 1:][inner], y[:, :-1][inner], y[:, 1:][inner])
    pair = np.exp(ahead[:, :-1][inner][:, :, None] + moves[steps[0]] + (gain + behind)[:, 1:][inner][:, None, :]
                  - np.broadcast_to(total[:, None], inner.shape)[inner][:, None, None])
    d_moves = np.stack([pair[steps[0] == e].sum(axis=0) for e in range(len(moves))])
    np.add.at(d_moves, steps, -1)
    told = (np.take_along_axis(gain, y[:, :, None], 2)[:, :, 0] * batch.real).sum()
    told += (start[y[:, 0]] + end[y[rows, last]]).sum() + moves[steps].sum()
    off = (share[:, :, 1] - y * batch.real).reshape(-1)
    d_w = np.bincount(batch.index, off[batch.slot], len(w))
    d_start, d_end = share[:, 0].sum(axis=0), share[rows, last].sum(axis=0)
    np.add.at(d_start, y[:, 0], -1)
    np.add.at(d_end, y[rows, last], -1)
    return (total.sum() - told) / pages, [g / pages for g in (d_w, d_start, d_end, d_moves)]


def fit_field(pages, steps: int = STEPS) -> Field:
    """Fits the field to (features, edges, labels) of pages by Adam; features
    of one page alone are left out.  No pages: every block is main text."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for marks, _, _ in pages:
        for m in {m for ms in marks for m in ms}:
            seen[m] = seen.get(m, 0) + 1
    vocabulary = {m: i for i, m in enumerate(sorted(m for m, n in seen.items() if n > 1))}
    values = [np.zeros(len(vocabulary)), np.zeros(2), np.zeros(2), np.zeros((2, 2, 2))]
    if not pages:
        return Field({"1": 1.0}, *values[1:])
    batch = Batch(pages, vocabulary)
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        _, grads = loss_and_gradient(batch, *values)
        for i, g in enumerate(grads):
            g = g + DECAY * values[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            values[i] = values[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (
                np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return Field(dict(zip(vocabulary, values[0].tolist())), *values[1:])


# ------------------------------------------------------------- training pages
# Usual class words and phrases of the parts of web pages.
PARTS = {
    "ad": ("ad ads advert advertisement adbox ad-slot sponsored sponsor promo banner-ad adsense dfp",
           ("Advertisement", "Sponsored")),
    "notice": ("cookie cookie-notice cookie-banner consent gdpr notice alert announcement banner message "
               "privacy-notice toast popup modal overlay paywall",
               ("We use cookies to improve this site.", "Accept all cookies", "Privacy notice",
                "This site uses cookies. By continuing you agree.", "Please enable JavaScript.")),
    "menu": ("nav menu navbar navigation main-nav topnav breadcrumb breadcrumbs tabs pager pagination toc "
             "skip-links tags categories", ("Home", "About", "Contact", "News", "Next", "Previous")),
    "head": ("header site-header masthead top topbar branding logo page-header hero-bar",
             ("Search", "Log in", "Sign up", "Menu")),
    "side": ("sidebar side aside widget rail related related-posts popular recommended trending "
             "see-also author-bio archive secondary right-column", ("Related", "Popular posts", "Read more")),
    "form": ("form signup newsletter subscribe subscription login search-form contact-form signup-box",
             ("Subscribe to our newsletter", "Your email", "Leave a reply", "Search")),
    "share": ("share social sharing share-buttons follow-us like-box", ("Share", "Tweet", "Follow us", "Print")),
    "talk": ("comments comments comments comment comment comment-list discussion replies responses reply disqus thread user-comments",
             ("Comments", "3 comments", "Reply", "Leave a comment", "says:")),
    "foot": ("footer site-footer bottom colophon copyright legal credits imprint page-footer",
             ("© 2024 All rights reserved.", "Terms of use", "Privacy policy", "Imprint")),
    "main": ("content post entry article article-body entry-content post-body story text body-copy "
             "main-content page-content post-content story-body prose", ()),
    "wrap": ("container wrapper page row col inner outer site layout grid section block box clearfix", ()),
}
WORDS = ("the of and to in that was for with his her from this which had not are but have were they one all "
         "their there been when who more will would some time what into only other could these two may then "
         "about first made people years over such great must work life where before").split()


class Layout:
    """Composes one labelled page; main blocks carry the mark ``MAIN``."""

    def __init__(self, rng: random.Random, words: list[str]):
        self.rng, self.words = rng, words

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(low, high)))

    def sentence(self) -> str:
        low, high = self.rng.choice([(1, 3), (5, 15), (10, 60), (10, 60)])
        return self.some(low, high).capitalize() + self.rng.choice([".", ".", ".", "", "!"])

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 4])))
        if self.rng.random() < 0.2:
            text = f"<b>{text}</b>" if self.rng.random() < 0.5 else f"{text} <a href='/x'>{self.some(1, 3)}</a>."
        return text

    def named(self, part: str) -> str:
        """A class or id of a part, and sometimes a neutral one."""
        kinds = PARTS[part][0].split()
        said = self.rng.choice(kinds)
        if self.rng.random() < 0.2:
            said += " " + self.rng.choice(kinds + PARTS["wrap"][0].split())
        return f' {self.rng.choice(["class", "class", "id"])}="{said}"'

    def phrase(self, part: str) -> str:
        return self.rng.choice(PARTS[part][1])

    def wrap(self, body: str, chance: float = 0.3) -> str:
        while self.rng.random() < chance:
            name = self.named("wrap") if self.rng.random() < 0.8 else ""
            tag = self.rng.choice(["div", "div", "section"])
            body = f"<{tag}{name}>{body}</{tag}>"
        return body

    def holder(self, part: str, tags: str, body: str, bare: float = 0.0) -> str:
        """An element of a part; a telling tag may go without a class."""
        tag = self.rng.choice(tags.split())
        named = "" if tag not in ("div", "section", "ul", "p") and self.rng.random() < 0.5 + bare else self.named(part)
        return f"<{tag}{named}>{body}</{tag}>"

    def links(self, part: str) -> str:
        items = [self.rng.choice([self.some(1, 3), self.phrase(part)]) for _ in range(self.rng.randint(2, 9))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(items)) + "</ul>"
        return self.rng.choice([" ", " | ", ""]).join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(items))

    def side_text(self, part: str) -> str:
        """Prose, phrases or links that are not main text."""
        kind = self.rng.random()
        if kind < 0.3:
            return self.links(part)
        said = self.phrase(part) if kind < 0.55 else self.prose()
        more = f"<p>{self.prose()}</p>" if self.rng.random() < 0.3 else ""
        head = f"<h{self.rng.randint(2, 4)}>{self.some(1, 4)}</h3>" if self.rng.random() < 0.2 else ""
        return head + (f"<p>{said}</p>" if self.rng.random() < 0.5 else said) + more

    def ad(self) -> str:
        return self.holder("ad", "div div aside ins section", self.side_text("ad"))

    def notice(self) -> str:
        return self.holder("notice", "div div section dialog aside", self.side_text("notice"))

    def menu(self) -> str:
        return self.holder("menu", "nav nav div ul", self.links("menu"), 0.3)

    def head(self) -> str:
        title = self.rng.choice(["", f"<h1>{self.some(1, 4)}</h1>", f"<p>{self.some(2, 8)}</p>", f"<a href='/'>{self.some(1, 3)}</a>"])
        return self.holder("head", "header header div", title + (self.menu() if self.rng.random() < 0.4 else "")
                           + (self.form() if self.rng.random() < 0.2 else self.phrase("head")), 0.3)

    def side(self) -> str:
        return self.holder("side", "aside aside div section", "".join(
            self.wrap(f"<h3>{self.some(1, 4)}</h3>" + self.side_text("side"), 0.2)
            for _ in range(self.rng.randint(1, 3))), 0.3)

    def form(self) -> str:
        inside = (f"<p>{self.rng.choice([self.phrase('form'), self.prose()])}</p><label>{self.some(1, 2)}</label>"
                  f"<input name=q>")
        return (f"<form action='/f'>{inside}</form>" if self.rng.random() < 0.6
                else f"<div{self.named('form')}><form>{inside}</form></div>")

    def share(self) -> str:
        return self.holder("share", "div ul p", self.links("share"))

    def talk(self) -> str:
        one, rng = [], self.rng
        for _ in range(rng.randint(1, 5)):
            who = self.rng.choice(["", f"<cite>{self.some(1, 2)}</cite> says: ", f"<h4>{self.some(1, 2)}</h4>",
                                   f"<p>{self.some(1, 2)}</p>"])
            reply = self.rng.choice(["", "<a href='#r'>Reply</a>", f"<footer>{self.some(1, 3)}</footer>"])
            tag, named = self.rng.choice([("div", ' class="comment"'), ("article", ' class="comment"'), ("li", ""),
                                          ("li", ""), ("p", ""), ("blockquote", ""), ("div", self.named("talk"))])
            said = self.prose() if tag == "p" or rng.random() < 0.4 else f"<p>{self.prose()}</p>"
            one.append(f"<{tag}{named}>{who}{said}{reply}</{tag}>")
        title = rng.choice(["", f"<h2>{self.phrase('talk')}</h2>", f"<h3>{self.some(1, 3)}</h3>"])
        listed = f"<ol>{''.join(one)}</ol>" if rng.random() < 0.3 else "".join(one)
        return self.holder("talk", "section div div ol ul", title + listed
                           + (self.form() if self.rng.random() < 0.3 else ""), -0.5)

    def foot(self) -> str:
        said = self.rng.choice([self.phrase("foot"), f"&copy; {self.some(1, 3)} &middot; {self.prose()}", self.prose(),
                                self.links("foot")])
        return self.holder("foot", "footer footer div", said if self.rng.random() < 0.5 else f"<p>{said}</p>", 0.3)

    def article(self) -> str:
        rng, mark = self.rng, f' class="{MAIN}"'
        title = f"<h1{mark}>{self.some(2, 10).capitalize()}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        out = [title if rng.random() < 0.75 else ""]
        for _ in range(rng.choice([1, 2, 4, 6, 8, 12])):
            kind = rng.random()
            if kind < 0.5:
                out.append(f"<p{mark}>{self.prose()}</p>")
            elif kind < 0.58:
                out.append(f"<p{mark}><b>{self.prose()}<br><p{mark}>{self.prose()}</p>")
            elif kind < 0.66:
                out.append(f"<h{rng.randint(2, 4)}{mark}>{self.some(1, 7)}</h2>")
            elif kind < 0.78:
                tag = rng.choice(["ul", "ol"])
                items = [rng.choice([self.prose(), self.some(1, 5)]) for _ in range(rng.randint(1, 6))]
                out.append(f"<{tag}>" + "".join(f"<li{mark}>{t}</li>" for t in items)
                           + f"</{tag}>")
            elif kind < 0.84:
                out.append(f"<blockquote{mark}>{self.prose()}</blockquote>")
            elif kind < 0.9:
                out.append(f"<pre{mark}>{self.prose()}</pre>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption{mark}>{self.prose()}</figcaption></figure>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td{mark}>{self.some(1, 4)}</td><td{mark}>{self.some(1, 9)}</td></tr>"
                                               for _ in range(rng.randint(1, 3))) + "</table>")
            else:
                out.append(f"<div{mark}>{self.prose()}</div>")
            if rng.random() < 0.2:
                out.append(rng.choice([self.ad, self.ad, self.side, self.side, self.form, self.share, self.notice, self.menu])())
        if rng.random() < 0.2:
            out.append(rng.choice([self.share, self.side, self.talk, self.talk])())
        body = "".join(out)
        kind = rng.random()
        if kind < 0.35:
            return f"<article{self.named('main') if rng.random() < 0.4 else ''}>{body}</article>"
        if kind < 0.5:
            return f"<main>{self.wrap(body)}</main>"
        if kind < 0.6:
            return f"<main>{self.wrap(f'<article>{body}</article>')}</main>"
        if kind < 0.9:
            return f"<div{self.named('main')}>{self.wrap(body)}</div>"
        return self.wrap(body)

    def page(self) -> str:
        rng = self.rng
        parts = [self.menu, self.head, self.ad, self.notice, self.side]
        if rng.random() < 0.05:  # text alone
            tag = rng.choice(["body", "div", "p"])
            return f"<{tag} class='{MAIN}'>{self.prose()}</{tag}>" if rng.random() < 0.5 else self.article()
        top = [f() for f in rng.sample(parts, rng.randint(0, 4))]
        parts = [self.side, self.ad, self.talk, self.talk, self.notice, self.share, self.form, self.menu]
        low = [f() for f in rng.sample(parts, rng.randint(0, 4))] + [self.foot()] * (rng.random() < 0.9)
        body = "".join(top) + self.article() + "".join(low)
        return f"<html><head><title>{self.some(2, 6)}</title></head><body>{self.wrap(body)}</body></html>"


def labelled_blocks(page: str) -> list[tuple[Block, int]]:
    """Blocks of a composed page with their labels, the mark taken away."""
    out = []
    for b in blocks(page):
        own = tuple(w for w in b.own if w != MAIN)
        above = tuple(a for a in b.above if a != "k:" + MAIN)
        out.append((Block(b.text, b.tag, own, above, b.parent, b.linked), int(own != b.own)))
    return out


#: Elements inside an article that are not its text.
ASIDE = {"t:nav", "t:aside", "t:footer", "t:form", "t:dialog"}


def self_labelled(page: str) -> list[tuple[Block, int]]:
    """Blocks of a page that marks its article itself, else none."""
    low = page.lower()
    for tag in ("article", "main"):
        if low.count(f"<{tag}") == 1:
            return [(b, int(f"t:{tag}" in b.above and not ASIDE & set(b.above))) for b in blocks(page)]
    return []


def training_pages(real: list[str], seed: int = SEED, composed: int = LAYOUT_PAGES):
    """(features, edges, labels) of the training pages."""
    rng = random.Random(seed)
    labelled = [p for p in map(self_labelled, real) if p]
    words = [w for page in labelled for b, y in page if y for w in b.text.split()[:200]] or WORDS
    labelled += [labelled_blocks(Layout(rng, words).page()) for _ in range(composed)]
    out = []
    for page in labelled:
        found = [b for b, _ in page]
        marks, edges = features(found)
        lot = rng.random()
        if lot < LOSE_MARKS:
            marks = [[m for m in ms if m[:2] not in ("t:", "b:", "k:", "ow")] for ms in marks]
        elif lot < LOSE_MARKS + LOSE_WORDS:
            marks = [[m for m in ms if m[:2] not in ("k:", "ow")] for ms in marks]
        out.append((marks, edges, [y for _, y in page]))
    return out


# -------------------------------------------------------------------- on Spark
def train_field(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                train_pages: int = TRAIN_PAGES) -> Field:
    """Fits the field on at most ``train_pages`` pages of the table, by id
    hash, and the composed pages."""
    text = F.col(html_col)
    rows = pages.where((F.length(text) > 0) & (F.length(text) <= TRAIN_CHARS)).select(
        F.xxhash64(F.col(id_col), F.lit(SEED)).alias("h"), text.alias("html"))
    # the cut-off comes from hashes alone, so tasks send no pages that are not used
    cut = rows.select("h").orderBy("h").limit(train_pages).agg(F.max("h")).first()[0]
    if cut is None:
        return fit_field(training_pages([]))
    sample = rows.where(F.col("h") <= cut).orderBy("h", F.xxhash64("html")).limit(train_pages)
    return fit_field(training_pages([r.html for r in sample.collect()]))


def main_text(page: str | None, field: Field) -> str:
    """The texts of the blocks labelled as main text, joined by a space."""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, field.decode(*features(found))) if y)


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per page: id, url, ``text`` and ``n_chars``, its code points.

    Null and empty pages, and pages without main text, have an empty text.
    Rows that repeat an id are pages of their own; null ids and urls stay null.
    An empty table gives no rows.
    """
    field = field or train_field(pages, id_col, html_col)
    kept = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    schema = f"{id_col} {kept.schema[0].dataType.simpleString()}, {url_col} string, text string, n_chars bigint"

    def extract(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                texts = [main_text(p.as_py(), field) for p in batch.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return kept.withColumn(url_col, F.col(url_col).cast("string")).mapInArrow(extract, schema)
