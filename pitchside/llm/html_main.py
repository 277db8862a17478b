"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

:func:`leaf_blocks` cuts a page into runs of text between block-level tags, each with
its open elements (tags and the words of class and id).  A block's features are
those elements and measures of its text; a chain of two states (main text or not)
scores blocks and transitions, weights are fitted by gradient ascent on the
conditional likelihood of labelled pages, and Viterbi decoding picks the best
labelling of a page.

Training uses the labelled pages of :mod:`html_pages` (a fixed number), on the driver;
:func:`train` takes any other labelled pages.  Extraction covers all pages and the whole
html.

Text: character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one line break.  The content of ``SKIPPED`` elements is no text; the tags of all other
elements go and their text stays, that of ``math``, ``object`` and custom elements too.

Work per block follows the different names of its open elements that the model knows, not the depth of the page.

Defined cases: a null html is an empty page; a page without main text gives an empty text;
unclosed or cut tags and elements end with the page; an unclosed script or style swallows the rest of the page, of any
other unclosed ``SKIPPED`` element, and of a self-closed ``svg``, the tag alone goes; repeated rows are extracted each
for itself; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pitchside.llm.html_pages import labelled_pages

BATCH_ROWS = 256
EPOCHS, RATE, DECAY = 14, 0.3, 1e-3
# fixed values: elements whose content is no text (the raw ones end only with their own end tag), elements that break blocks,
# elements without content
RAW = "script style".split()
SKIPPED = RAW + "noscript template svg iframe select textarea button title".split()
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
# an opening tag closes an open element of its own kind, and a paragraph
SELF_CLOSING = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
                "tr": ("tr",), "option": ("option",), "body": ("head",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)/?>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)", re.S | re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    elements: tuple[str, ...]     # different names of the open elements, first opened first
    leaf: str                     # the innermost open element
    linked: int                   # characters inside links


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    names = [f"<{tag}>"]
    for found in _NAMES.findall(attributes) if attributes else ():
        names += ["." + w for w in _NAME_WORD.findall("".join(found).lower())]
    return tuple(names)


class _Open:
    """The open elements of a page, with the different names on the way down counted as they come and go."""

    def __init__(self, known: Container[str] | None):
        self.known, self.stack, self.tags, self.names = known, [], Counter(), Counter()
        self._listed: tuple[str, ...] | None = ()

    def push(self, tag: str, attributes: str) -> None:
        names = [n for n in _element(tag, attributes) if self.known is None or n in self.known]
        self.stack.append((tag, names))
        self.tags[tag] += 1
        for n in names:
            self.names[n] += 1
        self._listed = None

    def close(self, tag: str) -> None:
        """Close the innermost element of the kind and all inside it."""
        if not self.tags[tag]:
            return
        while True:
            top, names = self.stack.pop()
            self.tags[top] -= 1
            for n in names:
                self.names[n] -= 1
                if not self.names[n]:
                    del self.names[n]
            if top == tag:
                break
        self._listed = None

    def listed(self) -> tuple[str, ...]:
        if self._listed is None:
            self._listed = tuple(self.names)
        return self._listed


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks of text between block-level tags, in page order; of ``known`` names only, if given."""
    blocks: list[Block] = []
    opened = _Open(known)
    stack, buffer = opened.stack, []
    linked, link_depth = 0, None
    endless: set[str] = set()          # skipped elements without a further end tag

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text and not opened.tags["head"]:
                blocks.append(Block(text, opened.listed(), f"<{stack[-1][0]}>" if stack else "", min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal link_depth
        opened.close(tag)
        if link_depth is not None and len(stack) < link_depth:
            link_depth = None

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at:m.start()]
            buffer.append(piece)
            if link_depth is not None:
                linked += len(piece)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ends = tag.lower(), m[1] or m[4]
        if tag in _END:
            if not ends and tag not in endless and not (tag == "svg" and m[0].endswith("/>")):
                end = _END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
        elif tag == "br":
            buffer.append(" ")
        elif tag == "a":
            link_depth = None if ends else len(stack)
        elif tag in BLOCK_TAGS:
            flush()
            if ends:
                close(tag)
            elif tag not in VOID:
                for other in SELF_CLOSING.get(tag, ("p",)):
                    if other == "p" and tag not in ("p", "li") and not (stack and stack[-1][0] == "p"):
                        continue
                    if any(t == other for t, _ in stack[-3:]) and not (other == "li" and stack[-1][0] in ("ul", "ol", "menu")):
                        close(other)
                opened.push(tag, m[3] or m[6] or "")
    rest = page[at:]
    if "<" in rest[-200:] and re.search(r"<[a-zA-Z/!][^>]*\Z", rest):
        rest = rest[:rest.rindex("<")]
    buffer.append(rest)
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Features of every block: open elements, text measures, place in the page."""
    out = []
    for j, b in enumerate(blocks):
        text, n = b.text, len(b.text)
        words = text.count(" ") + 1
        share = b.linked / n
        f = ["bias", *b.elements,
             f"words={min(words.bit_length(), 8)}",
             "linked=all" if share > 0.8 else "linked=some" if share > 0.2 else "linked=no",
             "end=stop" if text[-1] in ".!?\"”»:;…" else "end=open"]
        if b.leaf:
            f.append("leaf=" + b.leaf)
        if "©" in text or "copyright" in text[:80].lower():
            f.append("copyright")
        f.append("first" if j == 0 else "last" if j == len(blocks) - 1 else "middle")
        out.append(f)
    return out


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray           # features x 2
    moves: np.ndarray             # 2 x 2

    def scores(self, blocks: list[Block]) -> np.ndarray:
        get = self.index.get
        rows = [[i for i in map(get, f) if i is not None] for f in block_features(blocks)]
        flat = np.array([i for r in rows for i in r], dtype=np.int64)
        size = np.array([len(r) for r in rows])
        return np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)     # "bias" is in every row

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labelling (Viterbi); of equally likely ones main text."""
        if not blocks:
            return []
        unary, ((m00, m01), (m10, m11)) = self.scores(blocks).tolist(), self.moves.tolist()
        a, b = unary[0]
        back = []
        for u0, u1 in unary[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 <= b + m11
            back.append((from0, from1))
            a, b = u0 + (b + m10 if from0 else a + m00), u1 + (b + m11 if from1 else a + m01)
        state = b >= a
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page, self.index)
        return "\n".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities per block and expected transition counts (forward-backward)."""
    n = len(unary)
    ahead, back = unary.copy(), np.zeros_like(unary)
    for j in range(1, n):
        ahead[j] += _log_sum(ahead[j - 1][:, None] + moves, 0)
    for j in range(n - 2, -1, -1):
        back[j] = _log_sum(moves + (unary[j + 1] + back[j + 1])[None, :], 1)
    total = _log_sum(ahead[-1], 0)
    pairs = np.zeros((2, 2))
    for j in range(1, n):
        pairs += np.exp(ahead[j - 1][:, None] + moves + (unary[j] + back[j])[None, :] - total)
    return np.exp(ahead + back - total), pairs


def labelled_blocks(page: list[tuple[str, bool]]) -> tuple[list[Block], list[int]]:
    """Blocks of a labelled page; the label of a block is that of the part it begins in."""
    marked = "".join(re.sub(r"(>)([^<]+)", lambda m, y=int(y): f"{m[1]}\x00{y}{m[2]}" if m[2].strip() else m[0], part)
                     if part.strip() else part for part, y in page)
    blocks, labels = [], []
    for b in leaf_blocks(marked):
        found = re.findall("\x00([01])", b.text)
        text = " ".join(re.sub("\x00[01]", "", b.text).split())
        if found and text:
            blocks.append(Block(text, b.elements, b.leaf, max(0, min(b.linked, len(text)))))
            labels.append(int(found[0]))
    return blocks, labels


def train(pages: list[list[tuple[str, bool]]], epochs: int = EPOCHS) -> Model:
    """Fit the chain by stochastic gradient ascent (scaled per weight) on the pages' conditional likelihood."""
    data = [(b, y) for b, y in map(labelled_blocks, pages) if b]
    index: dict[str, int] = {}
    rows = []
    for blocks, y in data:
        rows.append(([[index.setdefault(f, len(index)) for f in fs] for fs in block_features(blocks)], y))
    weights, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    square_w, square_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for j in order.permutation(len(rows)):
            features, y = rows[j]
            flat = np.array([i for r in features for i in r])
            size = np.array([len(r) for r in features])
            unary = np.add.reduceat(weights[flat], np.cumsum(size) - size, axis=0)
            state, pairs = _marginals(unary, moves)
            gap = np.eye(2)[y] - state
            grad_m = -pairs
            np.add.at(grad_m, (y[:-1], y[1:]), 1)
            grad_w = np.zeros_like(weights)
            np.add.at(grad_w, flat, np.repeat(gap, size, axis=0))
            grad_w -= DECAY * weights
            square_w += grad_w ** 2
            square_m += grad_m ** 2
            weights += RATE * grad_w / np.sqrt(square_w)
            moves += RATE * grad_m / np.sqrt(square_m)
    return Model(index, weights, moves)


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with text (main text of html) and n_chars (own columns of these names are replaced)."""
    pages = pages.drop("text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())   # a few thousand weights
    schema = StructType(pages.schema.fields + [StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                texts = [m.extract(page or "") for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    part.schema.names + ["text", "n_chars"])

    return pages.mapInArrow(run, schema)
