"""Main-text extraction with a recurrent block labeller.

A page is read as the sequence of its leaf blocks.  Each block becomes a vector:
hashed tags and class names on the way to it, hashed words, and a few shapes
(length, share of link text, punctuation).  A bidirectional LSTM in NumPy reads
the sequence in both directions, so that every block is classified with the
whole document around it.  The blocks labelled as main text are joined in page
order by one newline.

The labeller is trained on the driver, on generated layouts and on a bounded
sample of the pages whose own markup tells the article from the rest
(``article`` or ``main`` against ``nav``, ``header``, ``footer``, ``aside``,
forms and adverts).  Tags, class names and words are dropped at random in
training, so that none of them decides alone.

Defined cases: null html is empty, without blocks the text is empty; broken
markup is read as far as it goes; character references are decoded; white space
in a block becomes one space; scripts, styles, comments, the head and other
invisible parts are no blocks.  Equal pages get equal texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.hashing import hash_words

#: Pages read for training (those with the smallest hashes, of at most so many characters), and layouts generated.
TRAINING_PAGES, TRAINING_CHARS, LAYOUTS = 160, 60_000, 800
EPOCHS, BATCH, LEARNING_RATE, DROPPED = 8, 16, 0.01, 0.15
PATH_SIZE, WORD_SIZE, SHAPES, HIDDEN = 160, 16, 10, 20
INPUT = PATH_SIZE + WORD_SIZE + SHAPES
#: Blocks in a padded batch when labelling, at most (a longer page is a batch of its own).
BATCH_BLOCKS = 8192

HIDDEN_TAGS = {"head", "script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "math", "canvas"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE_TAGS = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img",
}
#: Tags that end an open paragraph, as browsers do.
CLOSES_P = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "article", "section", "nav", "header", "footer", "aside",
    "form", "blockquote", "pre", "figure", "main", "hr",
}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form"}
SIDE_NAMES = {"ad", "ads", "advert", "advertisement", "banner", "sidebar", "menu", "comments", "comment", "cookie", "notice", "promo", "sponsored"}


@lru_cache(1 << 16)
def _place(name: str) -> tuple[int, float]:
    """Where a name of a path counts in its vector, and with which sign."""
    code = zlib.crc32(name.encode())
    return code % PATH_SIZE, 1.0 if code >> 31 else -1.0


class Open:
    """An open element, linked to the one around it: the path of a block costs nothing more however deep it is."""

    __slots__ = ("parent", "tag", "names", "size", "label", "side", "main", "counted", "own")

    def __init__(self, parent: Open | None, tag: str, names: tuple[str, ...], fresh: list[str], label: int | None):
        self.parent, self.tag, self.names = parent, tag, names
        self.size = len(names) + (parent.size if parent else 0)
        self.label = label if label is not None or parent is None else parent.label
        self.side = tag in SIDE_TAGS or not SIDE_NAMES.isdisjoint(names) or bool(parent and parent.side)
        self.main = tag in MAIN_TAGS or bool(parent and parent.main)
        # Each name of the path counts once; elements without a new one share the vector.
        self.counted = parent.counted if parent else np.zeros(PATH_SIZE, np.float32)
        self.own: np.ndarray | None = None
        if fresh:
            self.counted = self.counted.copy()
            for name in fresh:
                at, sign = _place(name)
                self.counted[at] += sign

    def vector(self) -> np.ndarray:
        """The path, with the last two tags once more as such."""
        if self.own is None:
            self.own = self.counted.copy()
            for name in [f"last <{self.tag}>"] + ([f"above <{self.parent.tag}>"] if self.parent else []):
                at, sign = _place(name)
                self.own[at] += sign
        return self.own


@dataclass
class Block:
    text: str
    inside: Open | None
    link_chars: int

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and names around the block, the outermost first."""
        found, at = [], self.inside
        while at is not None:
            found.append(at.names)
            at = at.parent
        return tuple(name for names in reversed(found) for name in names)

    @property
    def label(self) -> int | None:
        return self.inside.label if self.inside else None


_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?<![\w-])(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no markup.
RAW_TAGS = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}


class _Blocks:
    """Leaf blocks of a page with the path of tags and names above each."""

    def __init__(self, labelled: bool = False) -> None:
        self.labelled = labelled
        self.stack: list[Open] = []
        #: How often each name is on the path, and each tag is open.
        self.names: dict[str, int] = {}
        self.tags: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = self.hidden = self.anchors = 0

    def read(self, html: str) -> list[Block]:
        at = 0
        while (found := _TAG.search(html, at)) is not None:
            self.text(html[at : found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self.end(name)
                continue
            self.start(name, found[3])
            if name in RAW_TAGS:
                closing = re.compile(f"</{re.escape(name)}(?![a-zA-Z0-9])", re.I).search(html, at)
                if closing is None:
                    at = len(html)
                    break
                self.text(html[at : closing.start()])
                at = closing.start()
        self.text(html[at:])
        self.flush()
        return self.blocks

    def text(self, data: str) -> None:
        if data and not self.hidden:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data)

    def flush(self) -> None:
        if not self.parts:
            return
        text = "".join(self.parts)
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if text:
            self.blocks.append(Block(text, self.stack[-1] if self.stack else None, min(self.links, len(text))))
        self.parts, self.links = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE_TAGS:
            self.flush()
            if tag in CLOSES_P:
                self.close("p")
            elif tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.close(tag, stop=("ul", "ol", "dl", "table"))
        if tag in VOID_TAGS:
            if tag in ("br", "hr", "wbr"):
                self.parts.append(" ")
            return
        names, label = [f"<{tag}>"], None
        if "=" in attributes:
            for key, *values in _NAMES.findall(attributes):
                value = "".join(values)
                if key.lower() != "data-label":
                    names += re.findall("[a-z]+", value.lower())
                elif self.labelled:
                    label = int(value)
        fresh = []
        for name in names:
            n = self.names.get(name, 0)
            self.names[name] = n + 1
            if not n:
                fresh.append(name)
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.stack.append(Open(self.stack[-1] if self.stack else None, tag, tuple(names), fresh, label))
        self.hidden += tag in HIDDEN_TAGS
        self.anchors += tag == "a"
        if attributes.endswith("/") and tag not in INLINE_TAGS and tag not in CLOSES_P:
            self.close(tag)

    def end(self, tag: str) -> None:
        if tag not in INLINE_TAGS:
            self.flush()
        if tag not in VOID_TAGS:
            self.close(tag)
        elif tag == "br":
            self.parts.append(" ")

    def close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        """Leave the innermost open ``tag`` and all that is open in it; nothing if none is open (before a ``stop``)."""
        if not self.tags.get(tag):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i].tag
            if open_tag == tag:
                for gone in self.stack[i:]:
                    self.hidden -= gone.tag in HIDDEN_TAGS
                    self.anchors -= gone.tag == "a"
                    self.tags[gone.tag] -= 1
                    for name in gone.names:
                        self.names[name] -= 1
                del self.stack[i:]
                return
            if open_tag in stop or (tag == "p" and open_tag not in INLINE_TAGS):
                return


def page_blocks(html: str | None, labelled: bool = False) -> list[Block]:
    """Blocks of a page; ``data-label`` counts in generated layouts alone (``labelled``)."""
    return _Blocks(labelled).read(html or "")


def _told(block: Block) -> int | None:
    """What a page's own markup says of a block: main text, something else, or nothing."""
    if block.inside is None:
        return None
    return 0 if block.inside.side else 1 if block.inside.main else None


# Generated layouts: names as they are common on the web.
MAIN_BOXES = [
    ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("div", "entry content"), ("div", "article body"), ("div", "story"),
    ("section", "text"), ("div", "post content"), ("div", "main"), ("article", "post"), ("div", ""), ("section", "article"), ("td", "content"),
]
SIDE_BOXES = [
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "banner"),
    ("div", "sidebar"), ("div", "menu"), ("ul", "menu"), ("div", "cookie notice"), ("div", "notice"), ("div", "alert"), ("div", "popup"),
    ("div", "promo"), ("div", "sponsored"), ("div", "related"), ("div", "share"), ("div", "social"), ("div", "breadcrumbs"),
    ("section", "comments"), ("div", "comments"), ("article", "comment"), ("li", "comment reply"), ("div", "newsletter"), ("div", "widget"),
    ("div", "header"), ("div", "footer"), ("div", "nav"), ("section", "sidebar"), ("aside", "notice"), ("div", "login"), ("div", "copyright"),
    ("div", "advertisement"), ("p", "ad"), ("p", "notice"), ("div", "consent"), ("div", "subscribe"),
]


def _layout(draw: np.random.Generator, words: list[str]) -> str:
    """A page of an invented layout; ``data-label`` tells main text from the rest."""

    def say(low: int, high: int, end: str = ".") -> str:
        chosen = [words[i] for i in draw.integers(0, len(words), int(draw.integers(low, high + 1)))]
        return " ".join(chosen).replace("<", "").replace("&", "&amp;").capitalize() + end

    def box(tag: str, names: str, label: int, inner: str) -> str:
        kind = "class" if draw.random() < 0.7 else "id"
        names = f' {kind}="{names.replace(" ", "-") if draw.random() < 0.5 else names}"' if names else ""
        return f'<{tag}{names} data-label="{label}">{inner}</{tag}>'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{say(1, 3, "")}</a></li>' for _ in range(n))

    def aside() -> str:
        tag, names = SIDE_BOXES[int(draw.integers(len(SIDE_BOXES)))]
        kind = draw.random()
        if kind < 0.4:
            inner = f"<ul>{links(int(draw.integers(2, 8)))}</ul>"
        elif kind < 0.6:
            inner = say(2, 20)
        elif kind < 0.9:
            inner = "".join(f"<p>{say(2, 30)}</p>" for _ in range(int(draw.integers(1, 5))))
        else:
            inner = f"<h3>{say(1, 3, '')}</h3><div>{say(3, 25)}</div><a href='/y'>{say(1, 3, '')}</a>"
        return box(tag, names, 0, inner)

    def part() -> str:
        kind = draw.random()
        if kind < 0.75:
            inner = say(1, 90)
            if draw.random() < 0.2:
                inner += f" <a href='/z'>{say(1, 4, '')}</a> {say(1, 20)}"
            if draw.random() < 0.3:
                return f"<p><b>{inner}<br>"
            return f"<p>{inner}</p>" if draw.random() < 0.85 else f"<div>{inner}</div>"
        if kind < 0.85:
            return f"<h2>{say(1, 6, '')}</h2>"
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{say(3, 25)}</li>" for _ in range(int(draw.integers(2, 5)))) + "</ul>"
        return f"<blockquote>{say(5, 40)}</blockquote>" if kind < 0.97 else f"<pre>{say(4, 30)}</pre>"

    before = "".join(aside() for _ in range(int(draw.integers(0, 5))))
    after = "".join(aside() for _ in range(int(draw.integers(0, 6))))
    body = f"<h1>{say(2, 12, '')}</h1>" if draw.random() < 0.8 else ""
    for _ in range(int(draw.integers(1, 14))):
        body += part()
        if draw.random() < 0.08:
            body += aside()
    tag, names = MAIN_BOXES[int(draw.integers(len(MAIN_BOXES)))]
    main = box(tag, names, 1, body)
    if draw.random() < 0.4:
        main = f"<div class='wrapper'>{main}</div>"
    return f"<html><body>{before}{main}{after}</body></html>"


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block of a page."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    texts = [b.text.encode() for b in blocks]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    words = hash_words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=True)
    n_words = np.bincount(words.text, minlength=len(blocks))
    bucket = words.text * WORD_SIZE + (words.hash >> np.uint64(40)).astype(np.int64) % WORD_SIZE
    found = np.bincount(bucket, minlength=len(blocks) * WORD_SIZE).reshape(-1, WORD_SIZE)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = found / np.maximum(1, np.sqrt(n_words))[:, None]
    for i, (block, n) in enumerate(zip(blocks, n_words)):
        if block.inside is not None:
            x[i, :PATH_SIZE] = block.inside.vector()
        text = block.text
        x[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(len(text)) / 8,
            np.log1p(n) / 6,
            block.link_chars / len(text),
            min(1.0, (text.count(".") + text.count(",")) / max(1, n) * 4),
            text[-1] in ".!?:;\"')",
            min(1.0, (block.inside.size if block.inside else 0) / 16),
            len(text) < 30,
            n > 20,
            i / len(blocks),
            1.0,
        )
    return x


class Labeller:
    """A bidirectional LSTM with one logit per block."""

    def __init__(self, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        init = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.weights = {}
        for side in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            self.weights |= {f"x{side}": init(INPUT, 4 * HIDDEN), f"h{side}": init(HIDDEN, 4 * HIDDEN), f"c{side}": bias}
        self.weights |= {"o": init(2 * HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states ``(steps, pages, HIDDEN)`` of one direction; what the way back needs, if ``keep``."""
        steps, pages = mask.shape
        wh = self.weights[f"h{side}"]
        gates_in = x @ self.weights[f"x{side}"] + self.weights[f"c{side}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = gates_in[t] + h @ wh
            gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = np.split(gate, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c_new)
            h_new = m * (o * tc) + (1 - m) * h
            if keep:
                kept.append((h, c, i, f, o, g, tc, m))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    @staticmethod
    def _turned(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse order, padding last."""
        sizes = mask.sum(0).astype(int)
        steps = np.arange(len(mask))[:, None]
        at = np.where(steps < sizes, sizes - 1 - steps, steps)
        return np.take_along_axis(x, at[:, :, None], 0)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forth, _ = self._run(x, mask, "f", False)
        back, _ = self._run(self._turned(x, mask), mask, "b", False)
        return np.concatenate([forth, self._turned(back, mask)], 2) @ self.weights["o"] + self.weights["d"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, told: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over blocks that are ``told``."""
        xs = {"f": x, "b": self._turned(x, mask)}
        runs = {side: self._run(xs[side], mask, side, True) for side in "fb"}
        h = np.concatenate([runs["f"][0], self._turned(runs["b"][0], mask)], 2)
        p = 1 / (1 + np.exp(-(h @ self.weights["o"] + self.weights["d"][0])))
        d = ((p - y) * told / max(1.0, told.sum())).astype(np.float32)
        grads = {"o": np.einsum("tb,tbh->h", d, h), "d": np.array([d.sum()])}
        dh = d[:, :, None] * self.weights["o"]
        for side, outer in (("f", dh[:, :, :HIDDEN]), ("b", self._turned(dh[:, :, HIDDEN:], mask))):
            wh = self.weights[f"h{side}"]
            h_next, c_next = np.zeros_like(outer[0]), np.zeros_like(outer[0])
            dz_all, gh = np.zeros((*mask.shape, 4 * HIDDEN), np.float32), np.zeros_like(wh)
            for t in range(len(mask) - 1, -1, -1):
                h0, c0, i, f, o, g, tc, m = runs[side][1][t]
                total = outer[t] + h_next
                dc = m * total * o * (1 - tc * tc) + c_next
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), total * tc * o * (1 - o), dc * i * (1 - g * g)], 1) * m
                dz_all[t] = dz
                gh += h0.T @ dz
                h_next = dz @ wh.T + (1 - m) * total
                c_next = dc * (m * f + (1 - m))
            grads |= {f"x{side}": np.einsum("tbd,tbk->dk", xs[side], dz_all, optimize=True), f"h{side}": gh, f"c{side}": dz_all.sum((0, 1))}
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def fit(pages: list[list[Block]], labels: list[list[int | None]], seed: int = 11) -> Labeller:
    """Train on blocks with a label (1: main text); blocks without one are read but not scored."""
    model, draw = Labeller(), np.random.default_rng(seed)
    both = [(block_vectors(b), y) for b, y in zip(pages, labels) if b]
    moments = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in model.weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = LEARNING_RATE * (1 - epoch / EPOCHS)
        order = draw.permutation(len(both))
        for first in range(0, len(order), BATCH):
            chosen = [both[i] for i in order[first : first + BATCH]]
            x, mask = _padded([v for v, _ in chosen])
            y, told = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
            for i, (_, own) in enumerate(chosen):
                told[: len(own), i] = [v is not None for v in own]
                y[: len(own), i] = [v or 0 for v in own]
            drop = draw.random((1, x.shape[1], 2)) < DROPPED  # whole pages lose their paths' or words' features in part
            x = x.copy()
            x[:, :, :PATH_SIZE] *= (draw.random((1, x.shape[1], PATH_SIZE)) >= 0.5 * drop[:, :, :1]).astype(np.float32)
            x[:, :, PATH_SIZE : PATH_SIZE + WORD_SIZE] *= (~drop[:, :, 1:]).astype(np.float32)
            grads = model.gradients(x, mask, y, told)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def train(pages: DataFrame) -> Labeller:
    """A labeller from generated layouts and a bounded sample of ``pages (html)``."""
    some = pages.select("html").where(F.length("html").between(1, TRAINING_CHARS))
    hashes = some.select(F.xxhash64("html").alias("at"))
    chosen = hashes.groupBy("at").agg(F.lit(1).alias("one")).orderBy("at").limit(TRAINING_PAGES).select("at")
    rows = some.select(F.xxhash64("html").alias("at"), "html").join(F.broadcast(chosen), "at").groupBy("at").agg(F.first("html").alias("html"))
    own = [page_blocks(r["html"]) for r in sorted(rows.collect())]
    blocks = [b for b in own if any(_told(x) for x in b)]
    labels: list[list[int | None]] = [[_told(x) for x in b] for b in blocks]
    words = sorted({w for b in own for x in b for w in x.text.split()[:40]}) or ["the", "of", "and", "word", "text"]
    draw = np.random.default_rng(5)
    for _ in range(LAYOUTS):
        made = page_blocks(_layout(draw, words), labelled=True)
        blocks.append(made)
        labels.append([x.label for x in made])
    return fit(blocks, labels)


def label_pages(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are main text.  Pages of similar length are read together."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    while order:
        batch = [order.pop()]
        longest = len(pages[batch[0]])
        while order and longest * (len(batch) + 1) <= BATCH_BLOCKS:
            batch.append(order.pop())
        x, mask = _padded([block_vectors(pages[i]) for i in batch])
        logits = model.logits(x, mask)
        for k, i in enumerate(batch):
            out[i] = logits[: len(pages[i]), k] > 0
    return out


def _extracted(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                pages = [page_blocks(h) for h in some.column("html").to_pylist()]
                texts = ["\n".join(b.text for b, main in zip(blocks, chosen) if main) for blocks, chosen in zip(pages, label_pages(model, pages))]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages (page_id, url, html)``."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(train(pages)), "page_id long, url string, text string, n_chars long")
