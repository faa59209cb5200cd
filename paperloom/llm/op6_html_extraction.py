"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of its ancestors
(tags, and groups of class and id words) and of its text (length, share of links, punctuation, place). A chain over
the blocks, with a weight for every feature and label and for every step from label to label, is trained by maximum
likelihood on labelled pages, and Viterbi decoding gives the blocks of the article.

The tables hold no labelled pages, so the training pages are built here: ``labelled_pages`` writes pages of many
layouts out of random words and knows which blocks are the article's. Training takes ``TRAIN_PAGES`` of them.
"""

from __future__ import annotations

import functools
import html as html_module
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, release, table

TRAIN_PAGES = 400
_TEXT = re.compile(r"[^<]+")
#: A tag whose quoted attributes may hold a >, and one whose quotes do not match. Neither pattern goes back over what it has read.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
RAW = {"script", "style", "noscript", "template", "title", "iframe", "textarea", "svg", "object"}
#: Raw elements that reach to the end of the page if they are not closed; the others then count as ordinary ones.
TO_THE_END = {"script", "style"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "input",
}
#: What an element's start closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAGS = ("article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "p", "h1", "h2", "h3", "blockquote",
        "pre", "figure", "figcaption", "button", "select", "dialog", "head", "div", "body")
GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs topbar skip",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "comment": "comment comments reply replies respond response discussion disqus reader feedback review reviews",
    "side": "sidebar side aside widget related recommended recommendations popular trending rail teaser more",
    "foot": "footer foot copyright legal imprint colophon bottom",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe subscription gdpr overlay paywall message warning",
    "share": "share sharing social follow tags meta byline",
    "form": "form login signup signin search register contact",
    "head": "header head masthead hero logo brand top",
    "text": "content article post entry story main body text articlebody prose copy page",
}
_GROUP_OF = {word: i for i, words in enumerate(GROUPS.values()) for word in words.split()}
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_GROUP_BIT = [1 << (len(TAGS) + i) for i in range(len(GROUPS))]
_INSIDE = len(TAGS) + len(GROUPS)
_PHRASES = re.compile(r"©|copyright|all rights reserved|cookie|subscribe|advert|sponsor|sign up|log in|read more|share this", re.I)
N_FEATURES = _INSIDE + 30


class Block:
    __slots__ = ("flags", "links", "tag", "text")

    def __init__(self, text: str, flags: int, tag: str, links: int):
        self.text, self.flags, self.tag, self.links = text, flags, tag, links


class _Stack:
    """The open elements, with the places of each name and of the elements that are no inline ones."""

    def __init__(self):
        self.items: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, flags: int) -> None:
        self.places.setdefault(name, []).append(len(self.items))
        if name not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append((name, flags))

    def close(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.items) > depth:
            name, _ = self.items.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def end(self, name: str) -> None:
        """An end tag closes the last element of its name; that of an inline element closes no block."""
        at = self.places.get(name)
        if at and (name not in INLINE or at[-1] > self.block()):
            self.close(at[-1])

    def block(self) -> int:
        """The place of the innermost element that is no inline one, or -1."""
        return self.blocks[-1] if self.blocks else -1

    def block_name(self) -> str:
        return self.items[self.blocks[-1]][0] if self.blocks else "body"

    def flags(self) -> int:
        return self.items[-1][1] if self.items else 0

    def in_link(self) -> bool:
        return bool(self.places.get("a"))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, their character references decoded and white space made single. The time is
    linear in the page, however it is nested and whatever is left open."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    page = page or ""
    last_end = page.rfind(">")
    lower = None
    missing: set[str] = set()
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, stack.flags(), stack.block_name(), linked))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        text = html_module.unescape(text) if "&" in text else text
        parts.append(text)
        if stack.in_link():
            linked += len(text.strip())

    while at < len(page):
        if page[at] != "<":
            m = _TEXT.match(page, at)
            say(m[0])
            at = m.end()
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at) and at < last_end:
            at = page.find(">", at) + 1
            continue
        m = (_TAG.match(page, at) or _LOOSE_TAG.match(page, at)) if at < last_end else None
        if m is None:  # no tag, or one that never ends
            if page[at + 1 : at + 2].isascii() and page[at + 1 : at + 2].isalpha() and at > last_end:
                break
            say("<")
            at += 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            stack.end(name)
            continue
        if name in RAW:
            if m[3].endswith("/"):
                continue
            lower = lower if lower is not None else page.lower()
            if name in missing:
                end = -1
            elif len(lower) != len(page):  # a letter whose lower case is longer
                found = re.compile(rf"</{re.escape(name)}", re.I).search(page, at)
                end = found.start() if found else -1
            else:
                end = lower.find(f"</{name}", at)
            if end >= 0 or name in TO_THE_END:
                if name not in INLINE and name != "noscript":
                    flush()
                close_at = page.find(">", end) if end >= 0 else -1
                at = len(page) if close_at < 0 else close_at + 1
                continue
            missing.add(name)
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in VOID:
                continue
            if stack.block_name() == "p" or stack.block_name() in CLOSES.get(name, ()):
                if stack.blocks:
                    stack.close(stack.block())
        elif name in VOID:
            continue
        flags = stack.flags() | _TAG_BIT.get(name, 0)
        if m[3]:
            for found in _NAMES.findall(m[3]):
                for word in _SPLIT.split(max(found).lower()):
                    if word in _GROUP_OF:
                        flags |= _GROUP_BIT[_GROUP_OF[word]]
        stack.push(name, flags)
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    """Blocks x features, each 0 or 1."""
    x = np.zeros((len(page), N_FEATURES), dtype=np.float32)
    x[:, :_INSIDE] = np.array([b.flags for b in page], dtype=np.int64)[:, None] >> np.arange(_INSIDE) & 1
    for i, b in enumerate(page):
        f = b.flags
        words = b.text.count(" ") + 1
        density = b.links / len(b.text)
        article = f & (_TAG_BIT["article"] | _TAG_BIT["main"]) or f & _GROUP_BIT[9]
        own = (
            1, words <= 3, 3 < words <= 10, 10 < words <= 30, words > 30, density == 0, 0 < density < 0.3, 0.3 <= density < 0.8, density >= 0.8,
            b.text[-1] in ".!?…\"”»", bool(_PHRASES.search(b.text)), b.text[0] == "©", "," in b.text, i == 0, i == len(page) - 1,
            b.tag == "p", b.tag == "li", b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("td", "th"), b.tag == "div", b.tag in ("blockquote", "pre", "figcaption"),
            bool(article) and bool(f & (_TAG_BIT["header"])), bool(article) and bool(f & (_TAG_BIT["aside"] | _TAG_BIT["footer"] | _TAG_BIT["nav"] | _TAG_BIT["form"])),
            bool(article) and bool(f & _GROUP_BIT[2]), bool(article) and b.tag == "p", bool(article) and words > 10, not article and b.tag == "p" and words > 10,
            bool(article) and b.tag == "li" and density < 0.5, f == 0, bool(article) and bool(f & (_GROUP_BIT[1] | _GROUP_BIT[3] | _GROUP_BIT[5] | _GROUP_BIT[6] | _GROUP_BIT[7])),
        )
        x[i, _INSIDE:] = own
    return x


class Chain:
    """Weights of the field: features x 2 labels, and steps between labels; label 1 is the article."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels, by Viterbi; ties go to label 0."""
        score = (x @ self.weights).tolist()
        s = self.steps.tolist()
        a, b = score[0]
        back = []
        for p, q in score[1:]:
            to0 = (a + s[0][0], b + s[1][0])
            to1 = (a + s[0][1], b + s[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + p, max(to1) + q
        label = int(b > a)
        out = [label]
        for row in reversed(back):
            label = row[label]
            out.append(label)
        return np.array(out[::-1])


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood by Adagrad; forward and backward sums run over all pages at once, padded to one length."""
    n, longest = len(pages), max(len(y) for _, y in pages)
    x = np.zeros((n, longest, N_FEATURES))
    y = np.zeros((n, longest), dtype=int)
    real = np.zeros((n, longest), dtype=bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], real[i, : len(b)] = a, b, True
    w, s = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    seen = np.zeros((n, 2, 2))
    for t in range(1, longest):
        ok = np.flatnonzero(real[:, t])
        seen[ok, y[ok, t - 1], y[ok, t]] += 1
    seen = seen.sum(axis=0)
    truth = np.eye(2)[y] * real[..., None]
    total_w, total_s = np.full_like(w, 1e-8), np.full_like(s, 1e-8)
    for _ in range(rounds):
        score = x @ w
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(forward[:, t - 1, 0, None] + s[0], forward[:, t - 1, 1, None] + s[1]) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(s[:, 0] + ahead[:, :1], s[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(real[:, t + 1, None], step, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward + backward - z[:, None, None]) * real[..., None]
        grad_w = np.einsum("ntf,ntl->fl", x, truth - p) / n - penalty * w
        pair = forward[:, :-1, :, None] + s + (score + backward)[:, 1:, None, :] - z[:, None, None, None]
        grad_s = (seen - (np.exp(pair) * real[:, 1:, None, None]).sum(axis=(0, 1))) / n - penalty * s
        total_w += grad_w**2
        total_s += grad_s**2
        w += rate * grad_w / np.sqrt(total_w)
        s += rate * grad_s / np.sqrt(total_s)
    return Chain(w, s)


def labelled_pages(n: int, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(html, the article's blocks) for n pages of varied layout, made of random words."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("aeiourstnlmdpébü"))

    def pick(*options):
        return options[rng.integers(len(options))]

    def word() -> str:
        return "".join(letters[rng.integers(0, len(letters), rng.integers(2, 11))])

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.integers(low, high)))

    def sentence(low=3, high=25) -> str:
        return words(low, high).capitalize() + pick(".", ".", ".", "!", "?")

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.integers(1, 9)))

    def name(group: str) -> str:
        return pick(*GROUPS[group].split()) + pick("", "", "-box", "_1", " wrapper", "-area")

    def links(tag: str) -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.integers(2, 9)))
        return f"<{tag}>{items}</{tag}>"

    def boilerplate(kind: str) -> str:
        if kind == "menu":
            return pick(f"<nav>{links('ul')}</nav>", f'<div class="{name("menu")}">{links("ul")}</div>', f'<div id="{name("menu")}"><a href="/">{word()}</a> | <a href="/b">{words(1, 3)}</a></div>')
        if kind == "head":
            return pick(f"<header><a href='/'>{words(1, 4)}</a><p>{words(2, 9)}</p></header>", f'<div class="{name("head")}"><h1>{words(1, 4)}</h1></div>', f"<header><h2>{words(2, 5)}</h2>{links('ul')}</header>")
        if kind == "ad":
            return pick(f'<div class="{name("ad")}">{prose()}</div>', f'<aside class="{name("ad")}"><p>{sentence()}</p><a href="#">{words(1, 4)}</a></aside>', f'<div id="{name("ad")}"><p>{prose()}</p></div>')
        if kind == "side":
            return pick(f"<aside><h3>{words(1, 3)}</h3>{links('ul')}</aside>", f'<div class="{name("side")}"><h3>{words(1, 4)}</h3><p>{prose()}</p>{links("ul")}</div>', f"<aside><p>{prose()}</p></aside>")
        if kind == "notice":
            return pick(f'<div class="{name("notice")}"><p>{prose()}</p><button>{word()}</button></div>', f'<div role="alert" class="{name("notice")}">{sentence()}</div>', f'<dialog class="{name("notice")}">{prose()}</dialog>')
        if kind == "form":
            return pick(f"<form><label>{words(1, 3)}</label><input><button>{word()}</button></form>", f'<form class="{name("form")}"><p>{sentence()}</p><select><option>{word()}<option>{word()}</select></form>')
        if kind == "comment":
            one = "".join(pick(f"<p>{prose()}</p>", f'<div class="{name("comment")}"><b>{word()}</b> <p>{prose()}</p></div>', f"<li><p>{prose()}</p></li>") for _ in range(rng.integers(1, 6)))
            return pick(f'<section id="{name("comment")}"><h3>{words(1, 3)}</h3>{one}</section>', f'<div class="{name("comment")}">{one}</div>', f'<ol class="{name("comment")}">{one}</ol>')
        if kind == "share":
            return f'<div class="{name("share")}"><a href="#">{word()}</a> <a href="#">{word()}</a></div>'
        return pick(f"<footer>&copy; {words(1, 4)} &middot; {sentence()}</footer>", f"<footer><p>{prose()}</p>{links('ul')}</footer>", f'<div class="{name("foot")}">© {words(2, 6)}. All rights reserved.</div>')

    for _ in range(n):
        found: list[str] = []

        def own(text: str) -> str:
            found.append(text)
            return text

        body = []
        inside = pick(True, False)
        if pick(True, True, False):
            title = f"<h1>{own(words(2, 14) + pick('', '.'))}</h1>"
            body.append(pick(title, title, f"<header>{title}</header>"))
        for _ in range(rng.integers(1, 16)):
            kind = rng.integers(0, 14)
            if kind == 0:
                body.append(f"<h2>{own(words(1, 8))}</h2>")
            elif kind == 1:
                body.append("<ul>" + "".join(f"<li>{own(pick(sentence(), words(1, 12)))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif kind == 2:
                body.append(f"<blockquote>{own(prose())}</blockquote>")
            elif kind == 3:
                body.append("<table><tr>" + "".join(f"<td>{own(words(1, 5))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind == 4:
                body.append(f"<p><b>{own(pick(prose(), words(1, 5)))}<br>")
            elif kind == 5:
                body.append(f"<p>{own(pick(words(1, 3), sentence(1, 4), prose() + ' ' + prose()))}</p>")
            elif kind == 6:
                a, b, c = sentence(), words(1, 4), sentence()
                found.append(f"{a} {b} {c}")
                body.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
            elif kind == 7 and inside:
                body.append(boilerplate(pick("ad", "side", "share", "notice", "form", "menu")))
            else:
                body.append(f"<p>{own(prose())}</p>")
        if inside and pick(True, False, False):
            body.append(boilerplate(pick("comment", "share", "foot")))
        open_, close_ = pick(
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{name("text")}">', "</div>"),
            (f'<main><article class="{name("text")}">', "</article></main>"), (f'<section id="{name("text")}">', "</section>"), ("", ""),
        )
        before = [boilerplate(pick("menu", "head", "ad", "notice", "form", "side", "menu")) for _ in range(rng.integers(0, 4))]
        after = [boilerplate(pick("foot", "comment", "side", "ad", "share", "form", "foot", "notice")) for _ in range(rng.integers(0, 4))]
        yield f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{''.join(before)}{open_}{''.join(body)}{close_}{''.join(after)}</body></html>", found


@functools.lru_cache(maxsize=1)
def trained(n: int = TRAIN_PAGES) -> Chain:
    """The field trained on n built pages; the same on every call."""
    examples = []
    for page, own in labelled_pages(n):
        found, mine = blocks(page), set(own)
        if found:
            examples.append((features(found), np.array([int(b.text in mine) for b in found])))
    return train(examples)


def main_text(page: str | None, chain: Chain) -> str:
    """The article's blocks, one a line; empty for a null or empty page or one without an article."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, own in zip(found, chain.decode(features(found)), strict=True) if own)


def _extract(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    for rows in portions(batches, 1):
        texts = [main_text(p.as_py(), chain.value) for p in rows.column(1)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])
    release()


def extract_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, text, n_chars) for every row of pages (html string): row holds the row's columns, or ``keep``, as a
    struct, so names cannot clash. A null html gives an empty text; repeated rows are extracted alike; an empty table
    gives no rows. Long pages are read whole."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    shaped = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep or pages.columns]).alias("row"), F.col("html").cast("string").alias("html"))
    out = shaped.select("row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return shaped.mapInArrow(lambda it: _extract(it, sent), out)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", "n_chars")
