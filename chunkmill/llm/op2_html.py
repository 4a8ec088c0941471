"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of tags, which score below zero, and of blocks of words. A word's score is the log-odds that it belongs
to the main text, given the elements around it (their kinds and the parts of their names, also without vowels, so that
"hdr" is like "header"), whether it lies in a link, and its block (length, ending, share of links). The weights are fitted on
labelled pages: a fixed set that is built from parts, a third of which have names that mean nothing. One linear scan over
words and tags finds the contiguous run with the largest sum; blocks inside it that score below zero, such as an advert
between two paragraphs, are left out of the text, and cost a run inside an article no more than a tag does. Blocks end at block-level tags; <br> counts as white space.

Names on an element that holds the first article, or a main heading with paragraphs, say nothing about what is inside, nor do
parts of names that are words of the page's title or main heading: an article on cookies may have a "cookie-recipe". Inside an
element of main text, links alone don't speak against a block where nothing else does: an article may list links.
The weights are fitted once, on the driver, and sent to the tasks.

Defined results: null html is an empty text, as is a page without a run above zero; cut-off pages, unclosed elements,
comments, scripts and quoted ">" are read to the end; form controls, noscript, iframes and the like have no words, formulas
and drawings have; repeated rows give repeated results; other columns are ignored. Time is linear in the page, however
deeply its elements are nested.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm.common import arrow_limits, table

# HTML's element kinds.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
EMPTY = {"hr"}
#: Elements that a start tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
CELL = {"td", "th", "br"}
#: Bound of a word's score; score of a tag (from -1 to -0.02, precision and recall on held-out labelled pages differ by less than 0.002).
MOST, TAG = 4.0, -0.1
#: What the elements around can add at most to what speaks against an element; a sum that no element inside makes good.
CAP, LOST = 2.0, -2.8
#: Sum of the elements around, now and at most on the way in, above which links don't speak against a block unless one of the elements
#: speaks as much against it, and what the block then has at least.
SURE, LISTED = 1.5, 0.3
#: Least letters of a word of the topic; shorter ones are names by chance.
TOPIC = 6
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|object|canvas|button)\b(?>[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
VOWELS = re.compile(r"(?<=.)[aeiou]+")
DOUBLE = re.compile(r"(.)\1+")


@cache
def skeleton(part: str) -> str:
    """The part without plural, doubled letters and vowels but a first one."""
    return DOUBLE.sub(r"\1", VOWELS.sub("", part.removesuffix("s")))


def name_features(attributes: str, topic: set[str] = frozenset()) -> set[str]:
    """Of the parts of the names that aren't words of the topic."""
    out: set[str] = set()
    for m in NAMES.finditer(attributes):
        for part in PART.findall((m[1] or m[2] or m[3] or "").lower()):
            if len(part) >= TOPIC and part.removesuffix("s") in topic:
                continue
            out.add("." + part)
            if len(part) > 2:
                out.add("~" + skeleton(part))
    return out


class Block:
    """Words between block-level tags: texts with whether they lie in a link, the features around, and the tags before."""

    __slots__ = ("texts", "linked", "around", "tags")

    def __init__(self, around: object, tags: int):
        self.texts: list[str] = []
        self.linked: list[bool] = []
        self.around, self.tags = around, tags


def shape(block: Block) -> tuple[str, int, list[str]]:
    """The block's text, its number of words, and its own features."""
    text = " ".join("".join(block.texts).split())
    n = text.count(" ") + 1 if text else 0
    inside = sum(len(t.split()) for t, a in zip(block.texts, block.linked, strict=True) if a)
    own = ["words:" + ("0" if n <= 2 else "1" if n <= 5 else "2" if n <= 12 else "3")]
    own.append("links:" + ("none" if not inside else "all" if inside >= n - 1 else "most" if 4 * inside >= 3 * n else "few"))
    if text[-1:] in ".!?…。！？”\"":
        own.append("ends")
    return text, n, own


class Page:
    """Blocks of a page; weigh(features) is asked once for each element that opens, for the features that it adds."""

    def __init__(self, page: str, weigh):
        self.blocks: list[Block] = []
        self.tags = 0  # after the last block
        tokens = [(m.start(), m.end(), (m[3] or m[6] or "").lower(), (m[2] if m[3] else m[5]) or "", m[4] or m[7] or "") for m in TOKEN.finditer(page)]
        holds, topic = self._wrappers(tokens), self._topic(page, tokens)
        stack: list[tuple[str, set[str], object]] = []
        names: Counter = Counter()
        active: Counter = Counter()
        around = weigh(None, ())
        base = around
        block, links, tags = Block(around, 0), 0, 0

        def text(part: str) -> None:
            if part:
                block.texts.append(entities.unescape(part) if "&" in part else part)
                block.linked.append(links > 0)

        def close(depth: int) -> None:
            nonlocal around
            while len(stack) > depth:
                name, own, _ = stack.pop()
                names[name] -= 1
                active.subtract(own)
            around = stack[-1][2] if stack else base

        at = 0
        for k, (start, end, name, closing, attributes) in enumerate(tokens):
            text(page[at:start])
            at = end
            if not name:
                continue
            if name in CELL:
                block.texts.append(" ")
                block.linked.append(False)
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            if name not in BLOCK:
                continue
            if any(map(str.strip, block.texts)):
                block.tags = tags
                self.blocks.append(block)
                tags = 0
            tags += 1
            links = 0
            if closing:
                if names[name] > 0:
                    depth = len(stack) - 1
                    while stack[depth][0] != name:
                        depth -= 1
                    close(depth)
            elif name not in EMPTY:
                while stack and stack[-1][0] in CLOSES.get(name, {"p"} if name != "p" else ()):
                    close(len(stack) - 1)
                own = {name} | (set() if k in holds else name_features(attributes, topic))
                fresh = [f for f in own if not active[f]]
                active.update(own)
                names[name] += 1
                around = weigh(around, fresh)
                stack.append((name, own, around))
            block = Block(around, 0)
        text(page[at:])
        if any(map(str.strip, block.texts)):
            block.tags = tags
            self.blocks.append(block)
            tags = 0
        self.tags = tags

    @staticmethod
    def _topic(page: str, tokens: list[tuple]) -> set[str]:
        """Words of the title and of main headings, without a plural's s."""
        out: set[str] = set()
        open_name, at = None, 0
        for start, end, name, closing, _ in tokens:
            if open_name:
                out.update(w.removesuffix("s") for w in PART.findall(entities.unescape(page[at:start]).lower()))
            at = end
            if name in ("title", "h1"):
                open_name = None if closing else name
            elif name in BLOCK:
                open_name = None
        return out

    @staticmethod
    def _wrappers(tokens: list[tuple]) -> set[int]:
        """Start tags of elements that hold the first article, or a main heading and two paragraphs."""
        out: set[int] = set()
        stack: list[tuple[str, int, tuple[int, int, int]]] = []
        names: Counter = Counter()
        firsts: set[str] = set()
        seen = [0, 0, 0]  # articles, main headings, paragraphs

        def close() -> None:
            name, k, before = stack.pop()
            names[name] -= 1
            article, heading, paragraphs = (a - b for a, b in zip(seen, before, strict=True))
            if article > 0 or (heading > 0 and paragraphs > 1):
                out.add(k)

        for k, (_, _, name, closing, _) in enumerate(tokens):
            if name not in BLOCK or name in EMPTY:
                continue
            if closing:
                while names[name] > 0 and stack:
                    last = stack[-1][0]
                    close()
                    if last == name:
                        break
                continue
            if stack and stack[-1][0] == "p" and name == "p":
                close()
            seen[0] += name in ("article", "main") and name not in firsts
            firsts.add(name)
            seen[1] += name == "h1"
            seen[2] += name == "p"
            stack.append((name, k, tuple(seen)))
            names[name] += 1
        while stack:
            close()
        return out


# Parts that the labelled pages are built from. Kind, elements, names; what stands in it is of the kind.
PARTS = (
    ("menu", "nav div ul header", "nav navbar menu navigation topnav mainmenu breadcrumb breadcrumbs pagination pager tabs toc skip"),
    ("links", "aside div section ul", "related recommended more links tags categories archive popular trending latest widget sidebar rail promo teaser"),
    ("header", "header div", "header masthead banner top brand logo topbar site-header branding"),
    ("footer", "footer div", "footer copyright colophon legal bottom site-footer imprint disclaimer"),
    ("advert", "div aside section p", "ad ads advert advertisement sponsor sponsored promo dfp banner adslot"),
    ("notice", "div section p dialog", "cookie consent notice alert notification warning gdpr privacy popup modal overlay paywall message"),
    ("form", "form div section", "search login signup subscribe newsletter contact account register form"),
    ("comments", "div section ol ul", "comments comment disqus thread replies reply responses respond discussion feedback reviews guestbook"),
    ("share", "div ul p", "share sharing social follow buttons toolbar actions"),
    ("meta", "div p", "meta byline author date posted published credit timestamp"),
    ("aside", "aside div section", "sidebar side rail widget secondary about bio teaser"),
)
MARKS = dict.fromkeys(map(ord, "«»"))
MAIN = ("article main div section", "article content post story entry body text main page blog news hentry prose copy single")
PLAIN = "box wrap row col inner outer block unit grid cell container module panel item group left center wide x".split()
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def labelled_pages(n: int = 600, seed: int = 11) -> Iterator[str]:
    """Pages whose main text is between « and »."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randrange(a, b)))
    sentence = lambda a=6, b=20: words(a, b).capitalize() + r.choice("....?!")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randrange(a, b))).removesuffix("." if r.random() < 0.3 else " ")
    link = lambda a=1, b=4: f"<a href=/{word()}>{words(a, b)}</a>"

    def named(tag: str, names: str, inner: str, known: bool) -> str:
        parts = r.sample(names.split(), r.randrange(1, 3)) if known else r.sample(PLAIN, r.randrange(0, 2))
        parts += r.sample(PLAIN, r.randrange(0, 2))
        attribute = f' {r.choice(["class", "class", "id"])}="{r.choice([" ", "-", "_"]).join(parts)}"' if parts else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def inside(kind: str, known: bool, names: str) -> str:
        items = lambda low, high, make: "".join(f"<li>{make()}</li>" for _ in range(r.randrange(low, high)))
        if kind in ("menu", "links"):
            form = r.randrange(4)
            title = f"<h{r.randrange(2, 5)}>{words(1, 3)}</h{r.randrange(2, 5)}>" if kind == "links" and r.random() < 0.7 else ""
            body = "<ul>" + items(3, 12, lambda: link(1, 8 if kind == "links" else 3)) + "</ul>" if form < 2 else " | ".join(link() for _ in range(r.randrange(3, 9))) if form == 2 else "".join(f"<div>{link(1, 6)}</div>" for _ in range(r.randrange(3, 9)))
            return title + body
        if kind == "header":
            return r.choice([f"<div>{link()}</div>", f"<h{r.choice('123')}>{link()}</h1>", f"<span>{words(1, 4)}</span>"]) + (f"<p>{words(2, 6)}</p>" if r.random() < 0.4 else "")
        if kind == "footer":
            return r.choice([f"&copy; {words(2, 8)}", f"<p>{words(3, 14)} {link()} {link()}</p>", f"{link()} &middot; {link()} <p>{sentence()}</p>"])
        if kind == "comments":
            one = lambda: named("div", names, f"<{r.choice(['span', 'b', 'div'])}>{words(1, 3)}</span> <p>{prose(1, 8)}</p>" + (link(1, 2) if r.random() < 0.6 else ""), known)
            return (f"<h3>{r.randrange(1, 90)} {words(1, 2)}</h3>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randrange(1, 8)))
        if kind == "form":
            return f"<form><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button><p>{words(3, 10)}</p></form>"
        if kind == "share":
            return " ".join(link(1, 2) for _ in range(r.randrange(2, 6)))
        if kind == "meta":
            return f"{words(1, 4)} {r.randrange(1, 30)} {words(1, 2)} " + (link(1, 3) if r.random() < 0.5 else "")
        return r.choice([f"<p>{prose(1, 3)}</p>", f"{sentence()} {link()}", prose(1, 3), f"<h4>{words(1, 4)}</h4><p>{sentence()}</p>"])

    def part(share: float, only: tuple[str, ...] = ()) -> str:
        kind, tags, names = r.choice([p for p in PARTS if not only or p[0] in only])
        known = r.random() >= share
        tag = r.choice(tags.split())
        # Nothing but a name or an element's kind can tell a notice or a comment from the main text.
        if not known and kind not in ("menu", "links", "share", "meta", "header") and tag in ("div", "section", "p", "ol", "ul"):
            known = True
        return named(tag, names, inside(kind, known, names), known)

    for _ in range(n):
        blocks = [f"<h1>«{words(2, 9)}»</h1>"]
        if r.random() < 0.4:
            blocks.append(part(0.3, ("meta", "share")))
        if r.random() < 0.3:
            blocks = ["<header>", *blocks, "</header>"]
        for _ in range(r.randrange(1, 16)):
            kind = r.random()
            if kind < 0.62:
                text = prose()
                if r.random() < 0.3:
                    text = text.replace(" ", f" <a href=/{word()}>{words(1, 9)}</a> ", 1)
                blocks.append(f"<p>«{text}»</p>" if r.random() < 0.85 else f"<div>«{text}»</div>")
            elif kind < 0.72:
                blocks.append(f"<h{r.choice('234')}>«{words(1, 7)}»</h2>")
            elif kind < 0.79:
                blocks.append("<ul>" + "".join(f"<li>«{words(1, 12)}»</li>" for _ in range(r.randrange(2, 6))) + "</ul>")
            elif kind < 0.83:
                blocks.append("<table>" + "".join(f"<tr><td>«{words(1, 4)}»</td><td>«{words(1, 3)}»</td></tr>" for _ in range(r.randrange(2, 5))) + "</table>")
            elif kind < 0.87:
                blocks.append(f"<{r.choice(['blockquote', 'pre', 'figcaption', 'dd'])}>«{prose(1, 3)}»</pre>")
            elif kind < 0.96:
                blocks.append(part(0.2, ("advert", "advert", "links", "share", "form", "notice", "aside")))
            else:
                blocks.append(f"<p>«{sentence(2, 6)}»</p>")
        main = named(r.choice(MAIN[0].split()), MAIN[1], "".join(blocks), r.random() < 0.6) if r.random() < 0.85 else "".join(blocks)
        before = [part(0.35, ("menu", "header", "notice", "advert", "form", "links")) for _ in range(r.randrange(0, 5))]
        after = [part(0.35, ("links", "comments", "comments", "footer", "aside", "advert", "share", "form", "menu")) for _ in range(r.randrange(0, 6))]
        body = "".join([*before, main, *after])
        if r.random() < 0.4:
            body = named("div", " ".join(PLAIN), body, True)
        footer = f"<footer>{words(2, 9)}</footer>" if r.random() < 0.7 else ""
        yield f"<html><head><title>{words(2, 8)}</title></head><body>{body}{footer}</body></html>"


class Weights:
    """Log-odds by logistic regression over the blocks of labelled pages; a block counts with the square root of its words."""

    def __init__(self, pages: Iterator[str] | None = None, rounds: int = 500, decay: float = 1e-5):
        rows: list[list[str]] = []
        main, size = [], []
        for page in labelled_pages() if pages is None else pages:
            for block in Page(page, lambda around, fresh: [*(around or ()), *fresh]).blocks:
                main.append(any("«" in t for t in block.texts))
                block.texts = [t.translate(MARKS) for t in block.texts]
                _, n, own = shape(block)
                rows.append([*block.around, *own])
                size.append(n**0.5)
        seen = Counter(f for row in rows for f in row)
        number = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
        x = np.zeros((len(rows), len(number) + 1), np.float32)
        for k, row in enumerate(rows):
            x[k, [number[f] for f in row if f in number]] = 1
        x[:, -1] = 1
        y, c = np.array(main, np.float32), np.array(size, np.float32)
        c /= c.sum()
        w = np.zeros(x.shape[1], np.float32)
        speed = np.full(len(w), 1e-8, np.float32)
        for _ in range(rounds):
            slope = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * c) + decay * w
            speed += slope * slope
            w -= 0.5 * slope / np.sqrt(speed)
        self.word = {f: float(w[k]) for f, k in number.items()}
        self.plain = float(w[-1])
        self.tag, self.cap = TAG, CAP

    def block(self, around: tuple[float, float, float], own: list[str]) -> tuple[float, float]:
        """Score of each word of a block; and of where it stands, whatever its length and ending."""
        place = around[0] + sum(self.word.get(f, 0.0) for f in own if f[:5] == "links")
        value = place + sum(self.word.get(f, 0.0) for f in own if f[:5] != "links")
        if around[1] > SURE and around[0] > SURE and around[2] > -SURE:
            place, value = max(place, LISTED), max(value, LISTED)
        return max(-MOST, min(MOST, value)), place

    def around(self, before: tuple[float, float, float] | None, fresh) -> tuple[float, float, float]:
        """The sum over the elements around, the largest of such sums on the way in, and what the element adds that speaks most against it."""
        total, most, worst = before or (self.plain, 0.0, 0.0)
        more = sum(self.word.get(f, 0.0) for f in fresh)
        total = total + min(more, 0.0) if total < LOST else min(total, self.cap) + more
        return total, max(most, total), min(worst, more)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum above zero; the earliest of equals, as long as possible."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, bounds = total, (start, k + 1)
    return bounds


def main_text(page: str, weights: Weights) -> str:
    texts, values, scores = [], [], []
    for block in Page(page, weights.around).blocks:
        text, n, own = shape(block)
        value, place = weights.block(block.around, own)
        texts += ["", text]
        values += [0.0, max(value, place)]
        # A run may pass over what is left out of a container of main text, as it passes over a tag.
        least = weights.tag if block.around[1] > 1 else -MOST * n
        scores += [weights.tag * block.tags, max(value * n, least)]
    start, end = best_run(scores)
    return "\n\n".join(t for t, v in zip(texts[start:end], values[start:end], strict=True) if t and v > 0)


@cache
def weights() -> Weights:
    return Weights()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. No shuffle."""
    arrow_limits(pages.sparkSession, 500)
    fitted = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text("" if h is None else h, fitted) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
