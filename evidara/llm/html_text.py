"""HTML main text by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with the path of its open tags and its words. A bidirectional LSTM in
numpy reads a hashed vector of the path, one of the words and a few numbers for every block, and labels each block with
the whole page as context. As no table has labels for blocks, it is trained on pages that a fixed grammar writes.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import column, in_arrow
from evidara.llm.token_counts import texts_of

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]{2,}")
#: Element sets (fixed values).
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("head iframe noscript object script style svg template textarea title".split())
RAW = frozenset("iframe noscript script style template textarea title".split())
#: An opening tag closes these if they are open, up to the nearest of the last column.
CLOSES = {"p": ({"p"}, {"td", "th", "li", "div", "article", "section", "body"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PATH, WORDS, NUMBERS, HIDDEN = 48, 24, 8, 16


@dataclass
class Block:
    path: np.ndarray  # the vector of all open elements' marks
    last: str = ""  # the last mark
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks(page: str) -> list[Block]:
    """The leaf blocks that have text, in page order. Linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    current: Block | None = None
    at, size, silent, anchors, strict = 0, len(page), 0, 0, True
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    trail = [(np.zeros(PATH, np.float32), "")]  # of the open elements that have something to say: the path's vector, the last mark

    def say(raw: str) -> None:
        nonlocal current
        if not raw or silent:
            return
        if current is None:
            if not raw.strip():
                return
            current = Block(*trail[-1])
        current.parts.append(html.unescape(raw))
        if anchors:
            current.linked += len(raw.strip())

    def end() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
        current = None

    def pop(depth: int) -> None:
        nonlocal silent, anchors
        for name, own in reversed(stack[depth:]):
            places[name].pop()
            silent -= name in SILENT
            anchors -= name == "a"
            if own:
                trail.pop()
        del stack[depth:]

    def nearest(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else size
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else size
            continue
        named = page[lt + 1 + page.startswith("/", lt + 1) :][:1].isalpha() if size - lt < 64 else page[lt + 1 + page.startswith("/", lt + 1)].isalpha()
        tag = (TAG if strict else LOOSE).match(page, lt) if named else None
        if not tag and named and strict:  # an open quote; it is looked for only once
            strict = False
            tag = LOOSE.match(page, lt)
        if not tag:
            if named and page.find(">", lt) < 0:  # no tag any more
                say(page[lt:])
                break
            say("<")
            at = lt + 1
            continue
        at = tag.end()
        name = tag[1].lower()
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            end()
        if page[lt + 1] == "/":
            depth = nearest((name,))
            if depth >= 0:
                pop(depth)
            continue
        if name in ENDS_P or name in CLOSES:
            close, bounds = CLOSES.get(name, CLOSES["p"]) if name in CLOSES else CLOSES["p"]
            while (i := nearest(close)) > nearest(bounds):
                pop(i)
                if name not in ("tr", "dt", "dd"):
                    break
        if name == "body" and silent:  # a head that was not closed
            pop(0)
        if name in VOID or tag[2].endswith("/") and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close = page.find(">", stop.end()) if stop else -1
            at = close + 1 if close >= 0 else size
            continue
        marks = (name,) if name not in INLINE or name == "a" else ()
        if tag[2]:
            for found in MARKS.finditer(tag[2]):
                marks += tuple("." + w for w in WORD.findall((found[1] or found[2] or found[3] or "").lower()))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, marks))
        if marks:
            trail.append((trail[-1][0] + _path_vector(marks), marks[-1]))
        silent += name in SILENT
        anchors += name == "a"
    end()
    return out


@lru_cache(1 << 16)
def _slot(text: str, size: int) -> tuple[int, float]:
    code = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return code % size, 1.0 if code >> 16 & 1 else -1.0


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    for name in path:
        if name not in ("html", "body"):
            for k in range(3):  # several slots, so that no two names look alike
                place, sign = _slot(f"{k}{name}", PATH)
                out[place] += sign
    return out


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH + WORDS + NUMBERS), np.float32)
    for i, b in enumerate(page):
        out[i, :PATH] = b.path
        places, signs = zip(*(_slot(word.strip(".,:;!?()"), WORDS) for word in b.text.lower().split()), strict=True)
        out[i, PATH : PATH + WORDS] = np.bincount(places, signs, WORDS)
        out[i, PATH : PATH + WORDS] /= max(1.0, float(np.abs(out[i, PATH : PATH + WORDS]).sum()))
        n = len(b.text)
        out[i, PATH + WORDS :] = (
            np.log1p(n) / 8, min(1.0, b.linked / n), min(1.0, b.text.count(".") / 8), min(1.0, b.text.count(",") / 8), float(b.text[-1] in ".!?…"), i / len(page), float(b.last in ("p", "blockquote", "pre")), float(b.last[:1] == "h" and len(b.last) == 2),
        )
    return out


class Labeller:
    """A bidirectional LSTM with one output for each step."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = 0):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"x{side}"] = (r.normal(size=(width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.w[f"h{side}"] = (r.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w[f"c{side}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        self.w["o"] = (r.normal(size=2 * hidden + width) * 0.1).astype(np.float32)
        self.w["d"] = np.zeros(1, np.float32)

    def _side(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        steps, n, h = len(x), x.shape[1], self.hidden
        drive = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        out = np.zeros((steps, n, h), np.float32)
        state = cell = np.zeros((n, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = drive[t] + state @ self.w[f"h{side}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            m = mask[t, :, None]
            new = f * cell + i * g
            if keep is not None:
                keep.append((t, state, cell, i, f, o, g, np.tanh(new)))
            cell = np.where(m, new, cell)
            state = np.where(m, o * np.tanh(new), state)
            out[t] = state
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """x: steps, pages, width. mask: whether a page has that step."""
        kept: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
        top = np.concatenate([self._side(x, mask, s, kept[s]) for s in "fb"] + [x], 2)
        if keep is not None:
            keep |= {"top": top, **kept}
        return top @ self.w["o"] + self.w["d"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        z = self.logits(x, mask, keep)
        d = (1 / (1 + np.exp(-z)) - y) * mask / max(1, mask.sum())
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"] = np.tensordot(d, keep["top"], ((0, 1), (0, 1)))
        grads["d"] = d.sum(keepdims=True).reshape(1)
        h = self.hidden
        for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            dh = dc = np.zeros((x.shape[1], h), np.float32)
            for t, state, cell, i, f, o, g, tanh in reversed(keep[side]):
                m = mask[t, :, None]
                dh = dh + d[t][:, None] * self.w["o"][part]
                live = np.where(m, dh, 0)
                dn = np.where(m, dc, 0) + live * o * (1 - tanh * tanh)
                dz = np.concatenate((dn * g * i * (1 - i), dn * cell * f * (1 - f), live * tanh * o * (1 - o), dn * i * (1 - g * g)), 1)
                grads[f"x{side}"] += x[t].T @ dz
                grads[f"h{side}"] += state.T @ dz
                grads[f"c{side}"] += dz.sum(0)
                dh = np.where(m, dz @ self.w[f"h{side}"].T, dh)
                dc = np.where(m, dn * f, dc)
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def _grammar(n: int, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages of all sorts of layouts with the label of each block: 1 for the article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 10)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentence = lambda: words(3, 22) + r.choice((".", ".", ".", "!", "?"))
    say = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    mark = lambda *names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="{r.choice(names)} {word()}"'))
    pages = []
    for _ in range(n):
        body: list[tuple[str, int | None]] = []
        add = lambda text, label=None: body.append((text, label))  # noqa: E731, B023

        def menu(tag: str) -> None:
            add(tag)
            if r.random() < 0.7:
                add("<ul>")
                for _ in range(r.randint(2, 9)):
                    add(f'<li><a href="/{word()}">{words(1, 3)}</a></li>', 0)
                add("</ul>")
            else:
                add("".join(f'<a href="/{word()}">{words(1, 2)}</a> ' for _ in range(r.randint(2, 7))), 0)
            add(f"</{tag[1:].split()[0].rstrip('>')}>")

        def box(tag: str, lines: list[str]) -> None:
            add(tag)
            for line in lines:
                add(line, 0)
            add(f"</{tag[1:].split()[0].rstrip('>')}>")

        def junk() -> None:
            kind = r.randrange(9)
            if kind == 0:
                menu(r.choice(("<nav>", f"<div{mark('nav', 'menu', 'navbar', 'navigation', 'breadcrumb', 'topbar')}>", "<nav>")))
            elif kind == 1:
                box(r.choice(("<aside>", f"<div{mark('sidebar', 'side', 'related', 'widget', 'aside')}>")), [f"<h3>{words(1, 4)}</h3>", *(f'<p><a href="/{word()}">{words(2, 8)}</a></p>' for _ in range(r.randint(1, 4))), *([f"<p>{say(1, 3)}</p>"] if r.random() < 0.5 else [])])
            elif kind == 2:
                box(f"<div{mark('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'advertisement')}>", [r.choice((f"{say(1, 2)}", f"<p>{say(1, 2)}</p>"))])
            elif kind == 3:
                box(f"<div{mark('cookie', 'notice', 'consent', 'alert', 'gdpr', 'popup', 'newsletter')}>", [f"<p>{say(1, 3)}</p>"] * 1)
            elif kind == 4:
                box(r.choice((f'<form action="/{word()}">', f"<form{mark('search', 'signup', 'subscribe', 'login')}>")), [f"<label>{words(1, 3)}</label><input>", f"<button>{words(1, 2)}</button>"])
            elif kind == 5:
                tag = r.choice((f"<section{mark('comments', 'comment', 'discussion', 'replies')}>", f"<div{mark('comments', 'comment', 'reviews', 'disqus')}>"))
                box(tag, [f"<h3>{words(1, 3)}</h3>", *(f'<div class="comment">{r.choice(("<p>", "<p><b>" + words(1, 2) + "</b> "))}{say(1, 4)}</p></div>' for _ in range(r.randint(1, 4)))])
            elif kind == 6:
                box(f"<div{mark('share', 'social', 'tags', 'meta', 'byline', 'pagination', 'author')}>", [f'<a href="/{word()}">{words(1, 2)}</a> <a href="#">{words(1, 2)}</a>'])
            elif kind == 7:
                box(r.choice(("<footer>", f"<div{mark('footer', 'copyright', 'bottom')}>")), [r.choice((f"&copy; {words(1, 3)} {say(1, 2)}", f"<p>{say(1, 2)}</p>"))])
            else:
                box(r.choice(("<header>", f"<div{mark('header', 'masthead', 'logo', 'branding')}>")), [f"<h1>{words(1, 4)}</h1>" if r.random() < 0.3 else f'<a href="/">{words(1, 4)}</a>', *([f"<p>{words(2, 8)}</p>"] if r.random() < 0.4 else [])])

        def article() -> None:
            wrap = r.choice(("<article>", "<article>", "<article>", "<main>", f"<div{mark('content', 'post', 'entry', 'article', 'story', 'main', 'text')}>", "<div>"))
            add(wrap)
            if r.random() < 0.85:
                inner = wrap == "<article>" and r.random() < 0.3  # an article's own header
                add("<header>" if inner else "")
                add(f"<h1>{words(2, 12)}</h1>", 1)
                if inner and r.random() < 0.4:
                    add(f"<p>{say(1, 2)}</p>", 1)
                add("</header>" if inner else "")
            for k in range(r.randint(1, 9)):
                kind = r.random()
                if kind < 0.7:
                    add(f"<p>{say(1, 6)}" + r.choice(("</p>", "</p>", "")), 1)
                elif kind < 0.76:
                    add(f"<p><b>{say(1, 3)}<br>", 1)
                elif kind < 0.82:
                    add(f"<h2>{words(1, 7)}</h2>", 1)
                elif kind < 0.86:
                    add("<ul>")
                    for _ in range(r.randint(2, 4)):
                        add(f"<li>{r.choice((words(2, 8), sentence()))}</li>", 1)
                    add("</ul>")
                elif kind < 0.9:
                    add(f"<blockquote>{say(1, 2)}</blockquote>", 1)
                elif kind < 0.93:
                    add(f"<pre>{words(3, 12)}</pre>", 1)
                elif kind < 0.96:
                    add(f'<p>{say(1, 2)} <a href="/{word()}">{words(1, 3)}</a> {say(1, 2)}</p>', 1)
                else:
                    add(f"<p>{words(1, 4)}</p>", 1)
                if r.random() < 0.06:
                    junk()
            add(f"</{wrap[1:].split()[0].rstrip('>')}>")

        for _ in range(r.randint(0, 4)):
            junk()
        article()
        for _ in range(r.randint(0, 4)):
            junk()
        pages.append(("<html><head><title>x</title></head><body>" + "".join(t for t, _ in body) + "</body></html>", [(t, v) for t, v in body]))
    out = []
    for page, parts in pages:
        labels: list[int] = []
        for text, label in parts:
            if label is not None:
                labels += [label] * len(blocks(text))
        out.append((page, labels))
    return out


def train(pages: int = 900, epochs: int = 6, batch: int = 24, rate: float = 0.01) -> Labeller:
    data = [(vectors(own), labels) for page, labels in _grammar(pages) if (own := blocks(page)) and len(own) == len(labels)]
    model = Labeller(PATH + WORDS + NUMBERS)
    first, second, step = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2)), None, 0
    first, second = first
    r = np.random.default_rng(1)
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), batch):
            own = [data[i] for i in order[a : a + batch]]
            x, mask = padded([v for v, _ in own])
            y, _ = padded([np.array(v, np.float32)[:, None] for _, v in own])
            step += 1
            for k, g in model.gradients(x, mask, y[:, :, 0]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - rate * (0.5 ** (epoch // 2)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def labelled(pages: list[list[Block]], model: Labeller) -> list[np.ndarray]:
    """For each page which blocks are article. Pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and z - a < 128 and len(pages[order[z]]) * (z + 1 - a) <= 20_000:
            z += 1
        x, mask = padded([vectors(pages[i]) for i in order[a:z]])
        keep = model.logits(x, mask) > 0
        for k, i in enumerate(order[a:z]):
            out[i] = keep[: len(pages[i]), k]
        a = z
    return out


def main_text(pages: list[str], model: Labeller) -> list[str]:
    split = [blocks(p) for p in pages]
    return ["\n\n".join(b.text for b, k in zip(own, keep, strict=True) if k) for own, keep in zip(split, labelled(split, model), strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, key: str = "page_id", uri: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points of text) of every page.

    A null page counts as empty and has an empty text. Rows are independent: repeated rows, null keys and empty tables do
    no harm; other columns are ignored. Nothing is cut, whatever a page's length.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in texts_of(batch, "t"):
                found = main_text(texts, sent.value)
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(i, j - i) for c in ("k", "u")), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["k", "u", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, uri)]
    out = in_arrow(pages.select(F.col(key).alias("k"), F.col(uri).alias("u"), F.col(page).alias("t")), run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"k": key, "u": uri})
