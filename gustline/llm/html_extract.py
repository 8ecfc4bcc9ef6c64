"""Main text of web pages by a recurrent block labeller.

A page's leaf blocks are a sequence. Each block becomes a vector: its tag path
(tags, class and id words, hashed), its words (hashed) and a few measures. A
bidirectional LSTM in numpy reads the whole sequence both ways, so every block
is labelled text or not with the whole document as context.

The weights are learned here from a bounded sample of pages. Its labels come
from the pages' own markup (``marked_text``: what stands inside an article and
not inside navigation, adverts, comments and the like) and from the same
articles set into other layouts, with known labels, so that the labeller also
reads pages without such markup.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col, replace_columns, smallest_hashes
from gustline.llm.html_blocks import Block, blocks

PATH_DIMS, LEAF_DIMS, WORD_DIMS, MEASURES = 96, 32, 32, 8
INPUT = PATH_DIMS + LEAF_DIMS + WORD_DIMS + MEASURES
HIDDEN = 24
FIT_PAGES, FIT_CHARS = 200, 60_000  # the sample: pages, and characters of each at most
EPOCHS, BATCH, RATE = 7, 32, 0.01
MOST_WORDS = 0.4
PAGES_PER_RUN, BLOCKS_PER_RUN = 256, 20_000  # labelled together at most
BLOCKS_PER_PART = 4096  # of a page that is longer than a run
CHARS_PER_CUT = 4_000_000  # of the pages that are cut into blocks at a time

# Markup words that name parts of a page.
ASIDE_TAGS = frozenset("nav footer aside form button menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar side aside widget cookie cookies consent notice alert popup modal newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments reply replies respond disqus "
    "discussion search pagination pager toolbar copyright legal masthead".split())
TEXT_TAGS = frozenset({"article", "main"})
TEXT_WORDS = frozenset("article content post entry story body main text".split())


def marked_text(block: Block) -> bool | None:
    """Whether a block is main text by its page's markup; None: it doesn't say."""
    inside = False
    for tag, words in block.path:
        if tag in TEXT_TAGS or (tag in ("div", "section") and TEXT_WORDS & set(words)
                                and not ASIDE_WORDS & set(words)):
            inside = True
        elif tag in ASIDE_TAGS or ASIDE_WORDS & set(words) or (tag == "header" and not inside):
            return False
    return True if inside else None


# -- vectors of blocks --------------------------------------------------------------
class _Places(dict):
    """Hash of a name or word, remembered within bounds."""

    def __missing__(self, name: str) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[name] = zlib.crc32(name.encode())
        return got


_PLACE = _Places()


@functools.lru_cache(maxsize=20_000)
def _path_vector(path: tuple) -> np.ndarray:
    """Tags and mark words anywhere in the path, the innermost tag, and whether
    the path names a part with text or one beside it."""
    out = np.zeros(PATH_DIMS + LEAF_DIMS + 2, dtype=np.float32)
    for tag, words in path:
        out[_PLACE["t:" + tag] % PATH_DIMS] = 1
        for w in words:
            out[_PLACE["w:" + w] % PATH_DIMS] = 1
            if w in ASIDE_WORDS:
                out[-1] = 1
        if tag in ASIDE_TAGS or (tag == "header" and not out[-2]):
            out[-1] = 1
        if tag in TEXT_TAGS:
            out[-2] = 1
    if path:
        out[PATH_DIMS + _PLACE["l:" + path[-1][0]] % LEAF_DIMS] = 1
    return out


def vectors(page: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block of a page, or of a part of it that begins at
    block ``first`` of ``total``. Words that are repeated again and again count
    up to a bound, so that they don't drown the path."""
    n, base = len(page), PATH_DIMS + LEAF_DIMS
    out = np.zeros((n, INPUT), dtype=np.float32)
    if not n:
        return out
    paths = np.stack([_path_vector(b.path) for b in page])
    out[:, :base], out[:, -2:] = paths[:, :-2], paths[:, -2:]
    tokens = [b.text.split() for b in page]
    count = np.array([len(t) for t in tokens])
    places = np.fromiter(map(_PLACE.__getitem__, itertools.chain.from_iterable(tokens)), np.int64, int(count.sum()))
    cell = np.repeat(np.arange(n), count) * WORD_DIMS + places % WORD_DIMS
    sign = np.where(places >> 16 & 1, 1.0, -1.0)
    words = np.bincount(cell, weights=sign, minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
    out[:, base:base + WORD_DIMS] = np.clip(words / (np.sqrt(count) * 3)[:, None], -MOST_WORDS, MOST_WORDS)
    size = np.array([len(b.text) for b in page])
    marks = np.array([sum(map(b.text.count, ".,;:!?")) for b in page])
    out[:, -MEASURES:-2] = np.stack([
        np.log1p(size) / 6, np.log1p(count) / 5, np.array([b.linked for b in page]) / size, marks / size * 8,
        (first + np.arange(n)) / (total or n), np.array([b.text[-1] in ".!?" for b in page])], axis=1)
    return out


# -- the labeller ----------------------------------------------------------------------
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, learning: bool = True):
    """Hidden states (steps x pages x HIDDEN) of one direction and, if
    ``learning``, what the way back needs. Steps behind a page's end (mask 0)
    keep the state."""
    steps, pages, _ = x.shape
    z_in = x @ w + b
    h, c = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    hs, kept = [], []
    for t in range(steps):
        z = z_in[t] + h @ u
        i, f, o = (_sigmoid(z[:, n * HIDDEN:(n + 1) * HIDDEN]) for n in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tanh = np.tanh(c_new)
        if learning:
            kept.append((h, c, i, f, o, g, tanh))
        h = m * (o * tanh) + (1 - m) * h
        c = m * c_new + (1 - m) * c
        hs.append(h)
    return np.stack(hs), kept


def _states(z_in: np.ndarray, u: np.ndarray, h: np.ndarray, c: np.ndarray):
    """Hidden states of one direction over a part of one page, from the state
    (h, c) before it; and the state behind it."""
    out = np.empty((len(z_in), HIDDEN), z_in.dtype)
    for t in range(len(z_in)):
        z = z_in[t] + h @ u
        gates = _sigmoid(z[:3 * HIDDEN])
        c = gates[HIDDEN:2 * HIDDEN] * c + gates[:HIDDEN] * np.tanh(z[3 * HIDDEN:])
        out[t] = h = gates[2 * HIDDEN:] * np.tanh(c)
    return out, h, c


def _lstm_back(x, mask, w, u, kept, dhs):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], w.dtype)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for t in range(len(dhs) - 1, -1, -1):
        h, c, i, f, o, g, tanh = kept[t]
        m = mask[t][:, None]
        dh = dh + dhs[t]
        own, dh_old = dh * m, dh * (1 - m)
        dc_new = dc * m + own * o * (1 - tanh ** 2)
        dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), own * tanh * o * (1 - o),
                             dc_new * i * (1 - g ** 2)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh = dz @ u.T + dh_old
        dc = dc_new * f + dc * (1 - m)
    return dw, du, db


@dataclass
class Labeller:
    """Weights of the two directions and of the output."""
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w["w" + d] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32)
            w["u" + d] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            w["c" + d][HIDDEN:2 * HIDDEN] = 1
        w["out"] = rng.normal(0, 0.1, (2 * HIDDEN + INPUT, 1)).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return Labeller(w)

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p) for p in pages)
        x = np.zeros((steps, len(pages), INPUT), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[:len(p), k], mask[:len(p), k] = p, 1
        return x, mask

    def forward(self, x: np.ndarray, mask: np.ndarray, learning: bool = True):
        """Probability of main text (steps x pages). The backward direction
        starts at the padding, which leaves its state at zero."""
        w = self.weights
        hf, kf = _lstm(x, mask, w["wf"], w["uf"], w["cf"], learning)
        hb, kb = _lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["cb"], learning)
        both = np.concatenate([hf, hb[::-1], x], axis=2)
        return _sigmoid((both @ w["out"] + w["bias"])[:, :, 0]), (both, kf, kb)

    def long_page(self, page: list[Block]) -> np.ndarray:
        """Whether each block of one page is main text, part by part: each
        direction carries its state from part to part and adds to one number
        per block, so neither vectors nor states of the whole page are held."""
        w, n = self.weights, len(page)
        logits = np.full(n, w["bias"][0], np.float32)
        parts = [(b, min(b + BLOCKS_PER_PART, n)) for b in range(0, n, BLOCKS_PER_PART)]
        h = c = np.zeros(HIDDEN, np.float32)
        for begin, end in parts:
            x = vectors(page[begin:end], begin, n)
            hs, h, c = _states(x @ w["wf"] + w["cf"], w["uf"], h, c)
            logits[begin:end] += (hs @ w["out"][:HIDDEN] + x @ w["out"][2 * HIDDEN:])[:, 0]
        h = c = np.zeros(HIDDEN, np.float32)
        for begin, end in reversed(parts):
            x = vectors(page[begin:end], begin, n)[::-1]
            hs, h, c = _states(x @ w["wb"] + w["cb"], w["ub"], h, c)
            logits[begin:end] += (hs @ w["out"][HIDDEN:2 * HIDDEN])[::-1, 0]
        return logits > 0

    def gradients(self, x, mask, y, known) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the ``known`` labels."""
        w = self.weights
        p, (both, kf, kb) = self.forward(x, mask)
        d = ((p - y) * known / max(known.sum(), 1))[:, :, None].astype(x.dtype)
        dboth = d @ w["out"].T
        g = {"out": np.einsum("tpi,tpo->io", both, d), "bias": d.sum(axis=(0, 1))}
        g["wf"], g["uf"], g["cf"] = _lstm_back(x, mask, w["wf"], w["uf"], kf, dboth[:, :, :HIDDEN])
        g["wb"], g["ub"], g["cb"] = _lstm_back(x[::-1], mask[::-1], w["wb"], w["ub"], kb,
                                               dboth[::-1, :, HIDDEN:2 * HIDDEN])
        return g

    def learn(self, examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int = 6) -> None:
        """Adam over (vectors, labels, known) of pages; unknown labels don't count."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(examples))
            # pages of like length go together: little padding
            order = order[np.argsort([len(examples[k][1]) for k in order], kind="stable")]
            begins = np.arange(0, len(order), BATCH)
            for begin in rng.permutation(begins):
                some = [examples[k] for k in order[begin:begin + BATCH]]
                x, mask = self.padded([e[0] for e in some])
                y, known = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for k, e in enumerate(some):
                    y[:len(e[1]), k], known[:len(e[1]), k] = e[1], e[2]
                step += 1
                for k, g in self.gradients(x, mask, y, known).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    m, v = first[k] / (1 - 0.9 ** step), second[k] / (1 - 0.999 ** step)
                    self.weights[k] -= (RATE * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length go
        through together, very long ones in parts. A labeller that has learned
        nothing goes by the pages' own markup (``by_markup``)."""
        if not self.weights:
            return [by_markup(p) for p in pages]
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        begin = 0
        while begin < len(order):
            run = order[begin:begin + PAGES_PER_RUN]
            while len(run) > 1 and len(pages[run[-1]]) * len(run) > BLOCKS_PER_RUN:
                run = run[:len(run) // 2]
            if len(pages[run[-1]]) > BLOCKS_PER_RUN:
                out[run[0]] = self.long_page(pages[run[0]])
            else:
                x, mask = self.padded([vectors(pages[k]) for k in run])
                p, _ = self.forward(x, mask, learning=False)
                for n, k in enumerate(run):
                    out[k] = p[:len(pages[k]), n] > 0.5
            begin += len(run)
        return out


def by_markup(page: list[Block]) -> np.ndarray:
    """Main text by a page's own markup alone: the blocks that it marks as text;
    where it marks none, all that it doesn't mark as something else."""
    known = [marked_text(b) for b in page]
    return np.array([k if any(known) else k is None for k in known], bool)


# -- learning ------------------------------------------------------------------------------
def _other_layouts(page: list[Block], rng: np.random.Generator) -> Iterator[tuple[list[Block], np.ndarray]]:
    """The page's main text and other blocks in a layout drawn at random."""
    text = [b for b in page if marked_text(b)]
    rest = [b for b in page if marked_text(b) is False]
    if not text or not rest:
        return
    word = lambda words: (str(rng.choice(sorted(words))),)
    body = (("html", ()), ("body", ()))
    outer = body + ((("div", ("wrapper",)),) if rng.random() < 0.5 else ())
    kinds = [("article", ()), ("main", ()), ("div", word(TEXT_WORDS)), ("section", word(TEXT_WORDS)), ("div", ())]
    home = outer + (kinds[rng.integers(len(kinds))],)
    blocks_, labels = [], []

    def add(b: Block, path: tuple, label: bool) -> None:
        text, linked = b.text, b.linked
        if rng.random() < 0.06:  # a few words again and again, in the text as beside it
            some = " ".join(text.split()[:int(rng.integers(1, 9))])
            text, linked = " ".join([some] * int(rng.integers(4, 120))), 0
        blocks_.append(Block(text, path, linked))
        labels.append(label)

    def aside(inside: tuple) -> None:
        tag = (str(rng.choice(sorted(ASIDE_TAGS))), ()) if rng.random() < 0.5 else (
            str(rng.choice(["div", "section", "ul", "p"])), word(ASIDE_WORDS))
        leaf = ((str(rng.choice(["p", "li", "a", "span", "h3", "div"])), ()),) if rng.random() < 0.8 else ()
        for _ in range(int(rng.integers(1, 5))):
            # reader comments and notices read like the text itself
            source = rest if rng.random() < 0.6 else text
            add(source[rng.integers(len(source))], inside + (tag,) + leaf, False)

    for _ in range(int(rng.integers(0, 4))):
        aside(outer)
    for _ in range(int(rng.integers(0, 3))):
        source = rest if rng.random() < 0.5 else text
        add(source[rng.integers(len(source))], outer + (("header", ()), (str(rng.choice(["h1", "p", "div"])), ())), False)
    for n, b in enumerate(text):
        leaf = ("h1", ()) if n == 0 and rng.random() < 0.5 else (
            str(rng.choice(["p", "p", "p", "p", "h2", "li", "blockquote", "td", "div", "pre"])), ())
        add(b, home + (leaf,), True)
        if rng.random() < 0.08:
            aside(home)
    for _ in range(int(rng.integers(0, 4))):
        aside(outer if rng.random() < 0.7 else home)
    yield blocks_, np.array(labels)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = FIT_PAGES,
        chars: int = FIT_CHARS) -> Labeller:
    """A labeller learned from at most ``sample`` pages: of those of at most
    ``chars`` characters the ones with the smallest hashes of their ids. Without
    such a page, or without one whose markup tells anything, it has no weights
    and goes by the markup of the pages it is shown."""
    short = pages.select(col(id_col).alias("id"), col(html_col).alias("html")).filter(F.char_length("html") <= chars)
    chosen = smallest_hashes(short, "id", sample).select("h", "html").orderBy("h", "html").limit(sample).collect()
    rng = np.random.default_rng(9)
    examples = []
    for row in chosen:
        page = blocks(row["html"])
        known = [marked_text(b) for b in page]
        if any(known):
            examples.append((vectors(page), np.array([bool(k) for k in known], np.float32),
                             np.array([k is not None for k in known], np.float32)))
        for _ in range(2):
            for other, labels in _other_layouts(page, rng):
                examples.append((vectors(other), labels.astype(np.float32), np.ones(len(other), np.float32)))
    if not examples:
        return Labeller({})
    labeller = Labeller.fresh()
    labeller.learn(examples)
    return labeller


def _by_length(pages: pd.Series) -> Iterator[list[str]]:
    """Pages in their order, as many at a time as have a bounded length together."""
    held, size = [], 0
    for p in pages:
        if held and (size + len(p) > CHARS_PER_CUT or len(held) == 2 * PAGES_PER_RUN):
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield held


def extract(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text (blocks in page order joined by one
    space, character references decoded, white space as single spaces), and
    ``n_chars``, its code points.

    A narrow map over whole pages. NULL html is an empty page; a page without
    main text has an empty one; repeated rows each keep their own; input
    columns named like an output are replaced. Pages are cut into blocks a few
    million characters at a time; a page of any length is labelled as a whole,
    with memory for its blocks and one number each.
    """
    @F.pandas_udf("string")
    def main_text(pages: pd.Series) -> pd.Series:
        out = []
        for some in _by_length(pages):
            cut = [blocks(p) for p in some]
            out += [" ".join(b.text for b, keep in zip(page, label) if keep)
                    for page, label in zip(cut, labeller.label(cut))]
        return pd.Series(out, dtype=object)

    got = "_main_text"
    while got in pages.columns:
        got = "_" + got
    out = pages.withColumn(got, main_text(F.coalesce(col(html_col).cast("string"), F.lit(""))))
    return replace_columns(out, {"text": F.col(got), "n_chars": F.char_length(F.col(got)).cast("long")}).drop(got)
