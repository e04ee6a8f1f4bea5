"""Main text of HTML pages by a linear-chain conditional random field.

A page is read into its leaf blocks: runs of text between block-level tags, in
page order.  Each block has features of its ancestors (tags, classes and ids)
and of its text (length, links, punctuation, place).  A chain of two states,
main text or not, is trained by maximum likelihood on labelled pages and
decoded by Viterbi; the blocks of the main state, joined by one space, are the
text.  Text that a browser does not show as text (scripts, styles, templates,
comments, head) makes no blocks.

The operator is a map over pages; a page costs memory of its own size only.
The model is small and trained on the driver on a fixed number of pages.

Defined cases: null html is empty, the text then too; unclosed, crossed and
stray tags are read as far as they go; a null url or id stays null; repeated
rows give repeated results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.labelled_pages import FURNITURE, labelled_pages

TRAIN_PAGES = 450
SEED = 5

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template svg math object select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open tag of the key ends open elements of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol dl div article section body main td th aside nav header footer form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]{2,}")


@dataclass
class Block:
    path: tuple[str, ...]
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, white space made single, empty ones left out."""
    stack: list[tuple[str, str]] = []
    path: tuple[str, ...] | None = None
    blocks: list[Block] = []
    now: Block | None = None
    at, links = 0, 0

    def close_to(i: int) -> None:
        nonlocal path, now, links
        for name, _ in stack[i:]:
            links -= name == "a"
            if name not in INLINE:
                now = None
        del stack[i:]
        path = None

    def add(raw: str) -> None:
        nonlocal now, path
        text = unescape(raw) if "&" in raw else raw
        if now is None:
            if not text.strip():
                return
            if path is None:
                path = tuple(x for name, marks in stack if name not in INLINE for x in (name, *marks.split()))
            now = Block(path)
            blocks.append(now)
        now.pieces.append(text)
        if links:
            now.linked += len(text.strip())

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close_to(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else (len(html) if name in ("script", "style", "title", "textarea") else at)
            now = now if name in INLINE else None
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                now = None
            continue
        ends = ENDS.get(name, ())
        for i in range(len(stack) - 1, -1, -1):
            open_ = stack[i][0]
            if (open_ == "p" and name in ENDS_P) or open_ in ends:
                close_to(i)
                break
            if open_ in SCOPE and open_ not in ends and not (name in ("tr",) and open_ in ("td", "th")):
                break
        if name not in INLINE:
            now = None
            path = None
        links += name == "a"
        marks = ""
        if name not in INLINE and ("=" in m[3]):
            marks = " ".join(f".{p}" for x in _NAMES.findall(m[3]) for p in _PARTS.findall(" ".join(x).lower()))
        stack.append((name, marks))
    if at < len(html):
        add(html[at:])
    for b in blocks:
        b.text = " ".join("".join(b.pieces).split())
    return [b for b in blocks if b.text]


_WORDS = {w: k for k, v in FURNITURE.items() for x in v for w in x.lower().split() if len(w) > 2}


def _bin(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def text_features(b: Block, i: int, n: int) -> list[str]:
    text, size = b.text, len(b.text)
    words = text.split()
    lower = text.lower()
    out = [
        f"len{_bin(size, (8, 20, 50, 100, 200, 400, 800))}",
        f"link{_bin(b.linked / size, (0.01, 0.3, 0.7, 0.95))}",
        f"stop{_bin(sum(text.count(c) for c in '.!?'), (1, 2, 4))}",
        f"comma{min(text.count(','), 2)}",
        "end" if text[-1] in ".!?" else "noend",
        f"place{min(4, 5 * i // max(n, 1))}",
        f"lens{_bin(len(words), (2, 5, 10, 25))}+link{_bin(b.linked / size, (0.01, 0.7))}",
    ]
    if "©" in text:
        out.append("copyright")
    if len(words) <= 12:
        out += sorted({f"word-{_WORDS[w]}" for w in lower.split() if w in _WORDS})
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    tags = [x for x in path if x[0] != "."]
    return sorted({f"in {x}" for x in path if x not in ("html", "body")}) + [f"tag {tags[-1] if tags else '-'}", f"two {' '.join(tags[-2:])}", f"near {' '.join(path[-2:])}", f"nearer {' '.join(path[-3:])}", f"depth{min(len(tags), 6)}"]


class ChainModel:
    """Two states; weights of features by state, and of state pairs."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.names, self.unary, self.pairs, self.first = names, unary, pairs, first
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for i, b in enumerate(blocks):
            if (mine := self.paths.get(b.path)) is None:
                mine = self.unary[[self.names[f] for f in path_features(b.path) if f in self.names]].sum(0)
                if len(self.paths) < 20_000:
                    self.paths[b.path] = mine
            out[i] = mine + self.unary[[self.names[f] for f in text_features(b, i, len(blocks)) if f in self.names]].sum(0)
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: whether each block is main text in the best chain."""
        if not blocks:
            return []
        s = self.scores(blocks).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = s[0][0] + self.first[0], s[0][1] + self.first[1]
        back = []
        for u, v in s[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 > b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + p00 if from0 else b + p10) + u, (a + p01 if from1 else b + p11) + v
        state = int(b > a)
        out = [bool(state)]
        for step in reversed(back):
            state = step[state]
            out.append(bool(state))
        return out[::-1]


def train(examples: list[tuple[list[Block], list[bool]]], rounds: int = 120, ridge: float = 1e-3, rate: float = 0.3) -> ChainModel:
    """Maximum likelihood by full-batch gradient steps (Adam); all pages go through the chain together."""
    names: dict[str, int] = {}
    rows, columns = [], []
    longest = max(len(b) for b, _ in examples)
    gold = np.zeros((len(examples), longest), np.int64)
    mask = np.zeros((len(examples), longest))
    for p, (blocks, labels) in enumerate(examples):
        for i, (b, label) in enumerate(zip(blocks, labels)):
            gold[p, i], mask[p, i] = label, 1
            for f in path_features(b.path) + text_features(b, i, len(blocks)):
                rows.append(p * longest + i)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    sizes = [(len(names), 2), (2, 2), (2,)]
    theta = np.zeros(sum(int(np.prod(s)) for s in sizes))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    cuts = np.cumsum([int(np.prod(s)) for s in sizes])[:-1]
    total, hot = mask.sum(), np.eye(2)[gold] * mask[..., None]
    seen = np.einsum("pti,ptj,pt->ij", hot[:, :-1], hot[:, 1:], mask[:, 1:])
    for r in range(1, rounds + 1):
        unary, pairs, first = (x.reshape(s) for x, s in zip(np.split(theta, cuts), sizes))
        s = np.stack([np.bincount(rows, weights=unary[columns, k], minlength=gold.size) for k in (0, 1)], -1).reshape(*gold.shape, 2)
        ahead, behind = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0] + first
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + pairs, axis=1) + s[:, t]
            ahead[:, t] = np.where(mask[:, t, None] > 0, step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(pairs + (s[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        odds = np.exp(ahead + behind - norm[:, None, None]) * mask[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + pairs + (s + behind)[:, 1:, None, :] - norm[:, None, None, None]) * mask[:, 1:, None, None]
        gap = (hot - odds).reshape(-1, 2)
        gradient = np.concatenate([np.stack([np.bincount(columns, weights=gap[rows, k], minlength=len(names)) for k in (0, 1)], -1).ravel(), (seen - joint.sum((0, 1))).ravel(), (hot - odds)[:, 0].sum(0)]) / total - ridge * theta / len(examples)
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta = theta + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8) * (1 - r / (rounds + 1)) ** 0.5
    unary, pairs, first = (x.reshape(s) for x, s in zip(np.split(theta, cuts), sizes))
    return ChainModel(names, unary, pairs, first)


def labelled_blocks(pieces: list[tuple[str, bool]]) -> tuple[list[Block], list[bool]]:
    """The blocks of a labelled page: a mark of one letter at the front of each main text tells them."""
    page = "".join(re.sub(r"(>|^)([^<>]*[^<>\s][^<>]*)", lambda m: m[1] + "\ue000" + m[2], x) if main else x for x, main in pieces)
    blocks = leaf_blocks(page)
    labels = ["\ue000" in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace("\ue000", "")
        b.linked = min(b.linked, len(b.text))
    keep = [i for i, b in enumerate(blocks) if b.text]
    return [blocks[i] for i in keep], [labels[i] for i in keep]


@lru_cache(1)
def model(pages: int = TRAIN_PAGES, seed: int = SEED) -> ChainModel:
    return train([labelled_blocks(p) for p in labelled_pages(pages, seed)])


def main_text(html: str | None, chain: ChainModel) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, main in zip(blocks, chain.decode(blocks)) if main)


def extract(pages: DataFrame, chain: ChainModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(chain or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [main_text(h, held.value) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
