"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rideframe.llm.common import key_of, with_nulls

#: Element names by their part in a page.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = "script style noscript template iframe textarea noembed noframes xmp title".split()
SKIPPED = set("head button select option canvas audio video object svg math map datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BAD = set("nav footer aside form menu dialog search".split())
GOOD = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role that tell what a container holds; a name is taken word by word.
BAD_NAMES = re.compile(r"ad|ads|adv|advert\w*|alert|banner|breadcrumbs?|byline|comments?|commentlist|complementary|consent|contentinfo|cookies?|copyright|discussion|disqus|disclaimer|foot|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notice|notification|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|side|sidebar|sitemap|skip|social|sponsor\w*|subscribe|subscription|tags?|teaser|toolbar|topbar|widget\w*", re.I)
GOOD_NAMES = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
#: First words of names that tell of a page or its state, such as no-sidebar or tag-news, and not of what the element holds.
STATES = set("no has with without not type tag category cat format status is on hide show".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+")

_ATTRIBUTES = r"(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/](?=[^a-zA-Z]|[dD\[])[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_CLOSES_P = BLOCKS - {"html", "body", "head", "title"}


@dataclass
class Block:
    text: str
    linked: int  # words inside links
    kind: str
    good: bool  # inside an article or main container
    bad: bool  # inside a container of other page parts
    wrapped: bool  # inside an article or main container that stands in one with a name of other page parts
    box: int  # number of the outermost such container, -1 outside of any
    layers: int  # how many such containers stand around it

    @property
    def words(self) -> int:
        return len(self.text.split())


#: Words of names that say nothing of what an element holds.
FRAMES = set("area block box container group inner item items list outer section site top wrap wrapper page bottom".split())


@lru_cache(4096)
def told(name: str, strict: bool = False) -> int:
    """What one class, id or role tells: 1 for a container of the article, -1 for one of other page parts, else 0.

    The header of an entry, post or story is part of it. Names of paragraphs and sections are
    often about their subject (``strict``), so there every word has to tell of another page part, or of nothing.
    """
    words = _WORDS.findall(name)
    if len(words) > 1 and words[0].lower() in STATES:
        return 0
    good = any(GOOD_NAMES.fullmatch(w) for w in words)
    bad = [w for w in words if BAD_NAMES.fullmatch(w)]
    if strict and len(bad) + sum(w.lower() in FRAMES for w in words) < len(words):
        return 0
    if bad and not (good and all(w.lower() == "header" for w in bad)):
        return -1
    return int(good)


class _Stack:
    """Open elements, with the places of each name, so that every tag costs the same however many are open."""

    def __init__(self):
        self.open: list[tuple] = []  # name, hidden, nearest kind, good, bad, soft, wrapped, box, layers
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, name: str) -> int:
        return (self.places.get(name) or [-1])[-1]

    def push(self, name: str, *rest) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        if name in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((name, *rest))

    def cut(self, at: int) -> None:
        """Close everything from ``at`` on."""
        while len(self.open) > at:
            name = self.open.pop()[0]
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """An end tag: of a block, it closes what is inside too; of another element, not beyond a block."""
        at = self.last(name)
        if at >= 0 and (name in BLOCKS or at > (self.blocks or [-1])[-1]):
            self.cut(at)

    def make_room(self, name: str) -> None:
        """A block ends an open paragraph, with the inline elements that it left open; items and cells end the one before them."""
        if name in _CLOSES_P and self.blocks and self.open[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1])
        if name in ("li", "dt", "dd", "td", "th", "tr"):
            around = max(map(self.last, ("ul", "ol", "menu", "dl", "table", *(() if name == "tr" else ("tr",)))))
            if self.last(name) > around:
                self.cut(self.last(name))


OUTSIDE = ("", False, "", False, False, False, False, -1, 0)


def blocks(page: str) -> list[Block]:
    """Flat blocks of visible text, in page order: what stands between two block-level tags.

    A container that only its name, or a form, makes another page part is soft: an article or
    main container inside it is one again, but wrapped, and the tree decides what that is worth.
    """
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    linked: list[str] = []
    boxes: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                _, _, kind, good, bad, _, wrapped, box, layers = stack.open[-1] if stack.open else OUTSIDE
                out.append(Block(text, len("".join(linked).split()), kind, good, bad, wrapped, box, layers))
            pieces.clear()
        linked = []

    def take(raw: str) -> None:
        if raw and not (stack.open and stack.open[-1][1]):
            text = entities.unescape(raw)
            pieces.append(text)
            if links:
                linked.append(text + " ")

    at = 0
    while match := _TOKEN.search(page, at):
        take(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                flush()
            stack.close(name)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if name in BLOCKS:
                flush()
            continue
        if name == "br":
            take(" ")
            continue
        if name in BLOCKS:
            flush()
            stack.make_room(name)
            links = 0
        if name == "a":
            links = 1
        if name in VOID:
            continue
        _, hidden, kind, good, bad, soft, wrapped, box, layers = stack.open[-1] if stack.open else OUTSIDE
        named: list[int] = []
        for k, *values in _NAMES.findall(match[3]) if match[3].strip("/ ") else ():
            value = "".join(values)
            k = k.lower()
            if k in ("class", "id", "role"):
                named += [told(x, name in ("p", "section")) for x in value.split()]
            elif k == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif k == "hidden" or value.lower() == "true":
                hidden = True
        if name not in BLOCKS or name in ("body", "html"):
            named = []
        other = name in BAD or name == "header" and not good
        told_bad = -1 in named and not (name in GOOD or name in HEADINGS)
        if other or told_bad:
            soft = (soft or not bad) and (told_bad and not other or name == "form")
            box = box if bad or wrapped else len(boxes)
            boxes.append(name)
            bad, layers = True, layers + 1
        elif -1 not in named and (name in GOOD or 1 in named):
            wrapped, good, bad = wrapped or bad and soft, good or not bad or soft, bad and not soft
        elif name in GOOD and not bad:
            good = True
        if name in BLOCKS:
            kind = name
        stack.push(name, hidden or name in SKIPPED, kind, good, bad, soft, wrapped, box, layers)
    take(page[at:])
    flush()
    return out


FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "item", "good", "bad", "page_good", "paragraph", "wrapped", "share", "layers"]


def features(found: list[Block]) -> np.ndarray:
    """Word count and link density of every block and its neighbours, and where it stands.

    share: of the unlinked words of its box and of those outside of any, how many are in the box; 0 outside.
    """
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    x[:, 0] = [b.words for b in found]
    x[:, 1] = [b.linked for b in found]
    x[:, 1] /= np.maximum(1, x[:, 0])
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    x[:, 6] = [b.kind in HEADINGS for b in found]
    x[:, 7] = [b.kind in ("li", "dd", "dt", "td", "th", "a") for b in found]
    x[:, 8] = [b.good for b in found]
    x[:, 9] = [b.bad for b in found]
    x[:, 10] = any(b.good and not b.bad and not b.wrapped for b in found)
    x[:, 11] = [b.kind == "p" for b in found]
    x[:, 12] = [b.wrapped for b in found]
    held: dict[int, int] = {}
    for b in found:
        held[b.box] = held.get(b.box, 0) + b.words - b.linked
    x[:, 13] = [held[b.box] / max(1, held[b.box] + held.get(-1, 0)) if b.box >= 0 else 0.0 for b in found]
    x[:, 14] = [b.layers for b in found]
    return x


def labelled_blocks(seed: int = 5, pages: int = 480) -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: blocks of invented pages in several layouts, 1 for main text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    link = lambda a, b: f'<a href="/">{words(a, b)}</a>'
    xs, ys = [], []
    for _ in range(pages):
        layout = rng.choice(["article", "main", "named", "bare"])
        marked = layout != "bare"
        chance = lambda p: marked and rng.random() < p
        paragraphs = lambda n, a, b: "".join(f"<p>{words(a, b)}</p>" for _ in range(n))
        parts: list[tuple[str, int]] = []
        if chance(0.5):
            parts.append((rng.choice(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>']).format(f"<h1>{words(1, 5)}</h1>" + paragraphs(rng.randint(0, 1), 2, 20)), 0))
        alone = rng.random() < 0.25  # a page of its text only
        inside = rng.random() < 0.25  # a container of the whole page has a name of other page parts
        if chance(0.4):
            parts.append((rng.choice(['<div class="cookie-notice">{}</div>', '<div id="consent" role="dialog">{}</div>', '<div class="alert notice">{}</div>']).format(paragraphs(1, 4, 40)), 0))
        menu = "".join(f"<li>{link(1, 3)}</li>" for _ in range(rng.randint(2, 8)))
        parts.append((f"<div><ul>{menu}</ul></div>" if not marked else f"<nav><ul>{menu}</ul></nav>" if rng.random() < 0.7 else f'<div class="menu"><ul>{menu}</ul></div>', 0))
        if rng.random() < 0.5:
            parts.append((f'<div class="ad">{words(3, 40)}</div>' if marked else f"<div>{link(2, 6)}</div>", 0))
        body: list[tuple[str, int]] = [(f"<h1>{words(2, 9)}</h1>", 1)]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.1:
                body.append((f"<h2>{words(1, 6)}</h2>", 1))
            elif kind < 0.2 and marked:
                body.append(("<ul>" + "".join(f"<li>{words(1, 14)}</li>" for _ in range(3)) + "</ul>", 1))
            elif kind < 0.3 and marked:
                body.append((paragraphs(1, 1, 6), 1))
            elif kind < 0.36:  # a list of links is a menu wherever it stands; a lone one belongs to the text
                body.append(("<ul>" + "".join(f"<li>{link(1, 8)}</li>" for _ in range(rng.randint(4, 9))) + "</ul>", 0))
            elif kind < 0.4 and marked:
                body.append((f"<p>{link(2, 8)}</p>", 1))
            elif kind < 0.5 and marked:
                inner = rng.choice(['<div class="ad">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<div class="share">{}</div>', '<div class="related">{}</div>', '<div class="comments">{}</div>', "<footer>{}</footer>"])
                body.append((inner.format(paragraphs(rng.randint(1, 2), 1, 60)), 0))
            else:
                body.append((f"<p>{words(12, 90)}{' ' + link(1, 3) if rng.random() < 0.3 else ''}</p>", 1))
                if not marked and rng.random() < 0.3:
                    body += [(paragraphs(1, 1, 6), 1), (paragraphs(1, 14, 60), 1)]
        if marked and rng.random() < 0.3:
            body.append((paragraphs(1, 1, 6), 1))
        if alone:
            parts.clear()
            if not marked and rng.random() < 0.5:
                body = [(paragraphs(1, 1, 12), 1) for _ in range(rng.randint(1, 6))]
        if inside and marked and rng.random() < 0.5:
            parts = [(x, y) for x, y in parts if x.startswith("<nav>") or x.startswith("<header>")]
        before, after = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "named": ('<div class="post-content">', "</div>"), "bare": ("<div>", "</div>")}[layout]
        parts += [(before + x + after, label) for x, label in body]
        first = len(parts) - len(body)
        if rng.random() < 0.5 and not alone:
            parts.append((f"<aside><h3>{words(1, 4)}</h3>{paragraphs(3, 2, 40)}</aside>" if rng.random() < 0.5 else f'<div class="sidebar"><h3>{words(1, 4)}</h3>{paragraphs(2, 2, 40)}</div>' if marked else "".join(f"<div>{link(3, 9)}</div>" for _ in range(3)), 0))
        if chance(0.5) and not alone:
            parts.append((f"<section class='comments'><h2>{words(1, 3)}</h2>{paragraphs(3, 3, 60)}</section>", 0))
        if rng.random() < 0.4 and not alone and not inside:
            holder = rng.choice(["comments", "related-posts", "replies"])
            parts.append((f'<div class="{holder}">' + "".join(f"<article>{paragraphs(rng.randint(1, 2), 3, 50)}</article>" for _ in range(rng.randint(1, 6 if marked else 2))) + "</div>", 0))
        if chance(0.3) and not alone and not inside:
            parts.append((f"<div>{words(1, 30)}</div>", 0))
        if rng.random() < 0.8 and not alone:
            parts.append((f"<footer>&copy; {words(1, 25)}</footer>" if marked else f"<div>{link(1, 2)}</div><div>&copy; {words(1, 4)}</div>", 0))
        ys += [label for part, label in parts for _ in blocks(part)]
        texts = [part for part, _ in parts]
        if inside:
            a, z = rng.choice([(0, len(texts)), (first, first + len(body))])
            opened, closed = rng.choice([("<form>", "</form>"), *((f'<div class="{x}">', "</div>") for x in ("content-sidebar-wrap", "layout-with-nav", "menu-open", "search-page", "ad-free"))])
            texts[a], texts[z - 1] = opened + texts[a], texts[z - 1] + closed
        xs.append(features(blocks("".join(texts))))
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 3):
    """CART by Gini impurity: a share of main blocks, or (feature, threshold, below, above)."""
    share = float(y.mean())
    if not depth or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        a, b = np.cumsum(t)[:-1], t.sum() - np.cumsum(t)[:-1]
        gini = a * (1 - a / n) + b * (1 - b / (len(t) - n))
        gini[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = np.inf
        i = int(np.argmin(gini))
        if np.isfinite(gini[i]) and (best is None or gini[i] < best[0] - 1e-12):
            best = (gini[i], f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return share
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


@lru_cache(1)
def tree():
    return grow(*labelled_blocks(), depth=8)


def judge(node, row: np.ndarray) -> bool:
    while not isinstance(node, float):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None, model=None) -> str:
    if not page:
        return ""
    found = blocks(page)
    model = tree() if model is None else model
    return "\n\n".join(b.text for b, row in zip(found, features(found)) if judge(model, row))


def _extract(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(x, model) for x in batch["html"]]
            yield batch.drop(columns="html").assign(n_chars=[len(x) for x in batch["text"]])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points); one row per input row, in one pass without a shuffle.

    text joins the blocks that the tree takes for the article with two line feeds. Null, empty
    and tag-only pages have an empty text, and so have pages without a main block. Elements
    that aren't closed end where their container does; comments, scripts and styles that
    aren't closed reach to the end of the page. Rows that repeat give equal texts; an empty
    table gives an empty result. A page is read once from start to end, however long it is or
    however many elements it leaves open.
    """
    narrow = pages.select(key_of("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return with_nulls(narrow.mapInPandas(_extract(tree()), "page_id long, url string, text string, n_chars long"), "page_id")
