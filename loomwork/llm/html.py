"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between block-level tags, in page order, inline markup removed, references
decoded, white space runs made one space. A block is read as two vectors, hashed from its tag path (tags, class and
id words, role, of the nearest ancestors and of all) and from its words and shape; a numpy bidirectional LSTM
reads the page's block sequence and labels every block main text or not, so what surrounds a block counts.
Weights are in `html_model.npz`, trained by `python -m loomwork.llm.html_train` on generated pages.

Scripts, styles, comments, form controls' values and other text that pages do not show are no blocks. All blocks
of all pages are labelled; nothing is capped.

Defined cases: null or empty html and pages without main text give an empty text and 0 characters; broken or cut
markup is read as far as it goes; repeated rows are extracted each; null page_id or url pass through; extra
columns pass through `extract`, those named like its results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import free_names, table, tidy
from loomwork.llm._words import Words, slices

PATH_SIZE, WORD_SIZE, SHAPE_SIZE, HIDDEN = 192, 24, 8, 24
INPUT = PATH_SIZE + WORD_SIZE + SHAPE_SIZE

# Elements by role. Fixed values of the HTML standard.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption head".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text: to the end of the page if left open, or only if closed.
_RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
_ASIDE = "noscript|template|object|svg|math|canvas|audio|video"
#: An open element of the left is closed by a start tag of the right.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# possessive: what a part has taken it does not give back, so cut or unclosed markup is read once
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ASIDES = frozenset(_ASIDE.split("|"))
_ASIDE_END = re.compile(rf"</({_ASIDE})\s*>", re.I)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_NAME_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Place:
    """A step of a tag path: paths that begin alike share their beginnings, and each keeps the sum of its steps' hashes."""

    __slots__ = ("above", "tag", "step", "below", "sum", "whole")

    def __init__(self, above: Place | None, tag: str, step: str):
        self.above, self.tag, self.step, self.below = above, tag, step, {}
        self.sum = self.whole = None

    def inner(self, tag: str, step: str) -> Place:
        known = self.below.get(step)
        if known is None:
            known = self.below[step] = Place(self, tag, step)
        return known

    def path(self) -> tuple[str, ...]:
        steps, at = [], self
        while at.above is not None:
            steps.append(at.step)
            at = at.above
        return tuple(reversed(steps))


Block = tuple[Place, str, float]


def _label(tag: str, attributes: str) -> str:
    """A path step: the tag, then the words of class, id, role and itemprop."""
    if not attributes:
        return tag
    words = []
    for m in _NAMED.finditer(attributes):
        words += _NAME_WORDS.findall((m[2] or m[3] or m[4] or "").lower())
    if _HIDE.search(attributes):
        words.append("hidden")
    return " ".join([tag, *words])


def blocks(page: str) -> list[Block]:
    """(place, text, share of the text inside links) of each block that has text."""
    out: list[Block] = []
    here = _root(len(page))
    opened: dict[str, int] = {}  # elements of each tag that are open
    parts: list[str] = []
    linked, link, at = 0, False, 0
    ends: dict[str, list[int]] = {}  # of the closing tags of elements whose content is no text
    for m in _ASIDE_END.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.end())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((here, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def leave() -> None:
        nonlocal here
        opened[here.tag] -= 1
        here = here.above

    def close(tag: str) -> None:
        if opened.get(tag, 0):
            while here.tag != tag:
                leave()
            leave()

    def enter(tag: str, attributes: str) -> None:
        nonlocal here
        here = here.inner(tag, _label(tag, attributes))
        opened[tag] = opened.get(tag, 0) + 1

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if link:
                linked += len(text)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[2])
        if tag in _ASIDES and not closing:
            known = ends.get(tag, [])
            k = bisect_right(known, at)
            if k < len(known):
                at = known[k]
                continue
        if tag in _BLOCKS:
            flush()
            link = False
            if closing:
                close(tag)
            elif tag not in _VOID:
                if here.tag in ("p", "head"):
                    leave()
                while tag in _CLOSED_BY.get(here.tag, ()):
                    leave()
                enter(tag, m[4])
        elif tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in ("button", "label", "ins"):
            # these split text, and mark what they hold, like blocks
            flush()
            if closing:
                close(tag)
            else:
                enter(tag, m[4])
    if at < len(page):
        parts.append(page[at:])
        if link:
            linked += len(page) - at
    flush()
    return out


#: Characters of pages whose places a worker remembers together.
REMEMBERED = 4 << 20
_places: list = [Place(None, "", ""), 0]


def _root(size: int) -> Place:
    """The place above all; what is known below it is forgotten after some pages."""
    if _places[1] > REMEMBERED:
        _places[0], _places[1] = Place(None, "", ""), 0
    _places[1] += size
    return _places[0]


def _add(v: np.ndarray, key: str) -> None:
    h = crc32(key.encode())
    v[h % PATH_SIZE] += 1.0 if h >> 31 else -1.0


def _keys(step: str, near: str = "") -> list[str]:
    words = step.split(" ")
    return [f"{near}{'t' if word is words[0] else 'n'}:{word}" for word in dict.fromkeys(words)]


def _steps(place: Place) -> np.ndarray:
    """The sum of the hashes of all steps to a place: that of the place above, and its own."""
    missing = []
    while place.above is not None and place.sum is None:
        missing.append(place)
        place = place.above
    v = place.sum if place.above is not None else np.zeros(PATH_SIZE, dtype=np.float32)
    for p in reversed(missing):
        v = v.copy()
        for key in _keys(p.step):
            _add(v, key)
        p.sum = v
    return v


def path_vector(place: Place) -> np.ndarray:
    """Hashed tag path: the two nearest steps by place, every step, and neighbouring tags."""
    if place.whole is None:
        v, at, tags = _steps(place).copy(), place, []
        for near in range(3):
            if at.above is None:
                break
            tags.append(at.tag)
            if near < 2:
                for key in _keys(at.step, str(near)):
                    _add(v, key)
            at = at.above
        tags.reverse()
        for a, b in zip(tags, tags[-2:], strict=False):
            _add(v, f"{a}>{b}")
        place.whole = v
    return place.whole


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """Block vectors of each page; words are hashed for all pages at once."""
    flat = [b for page in pages for b in page]
    out = np.empty((len(flat), INPUT), dtype=np.float32)
    words = np.zeros((len(flat), WORD_SIZE))
    count = np.zeros(len(flat))
    texts = pa.RecordBatch.from_arrays([pa.array([b[1] for b in flat], pa.string())], names=["t"])
    for lo, hi, data, offsets in slices(texts, "t"):
        w = Words(data, offsets)
        n = np.diff(w.first)
        block = np.repeat(np.arange(hi - lo), n)
        place = block * WORD_SIZE + (w.hash % np.uint64(WORD_SIZE)).astype(np.int64)
        sign = np.where(w.hash >> np.uint64(63), 1.0, -1.0)
        words[lo:hi] = np.bincount(place, weights=sign, minlength=(hi - lo) * WORD_SIZE).reshape(-1, WORD_SIZE)
        count[lo:hi] = n
    safe = np.maximum(count, 1)
    for i, (path, _, _) in enumerate(flat):
        out[i, :PATH_SIZE] = path_vector(path)
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.tanh(words / np.sqrt(safe)[:, None] / 2)  # a word repeated throughout must not drown the rest
    size = np.array([len(t) for _, t, _ in flat])
    link = np.array([k for _, _, k in flat])
    shape = [
        np.log1p(size) / 5, np.log1p(count) / 4, link, link > 0.6, [t[-1] in ".!?…:;\"”»" for _, t, _ in flat],
        np.array([t.count(",") for _, t, _ in flat]) / safe * 4, ["©" in t for _, t, _ in flat], size < 25,
    ]
    out[:, PATH_SIZE + WORD_SIZE :] = np.array(shape, dtype=np.float32).reshape(SHAPE_SIZE, len(flat)).T
    return np.split(out, np.cumsum([len(p) for p in pages])[:-1]) if pages else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
    """Hidden states of sequences x (steps, pages, inputs), from the first step to the last; `state` carries over calls."""
    steps, pages, _ = x.shape
    n = len(u)
    h, c = state or (np.zeros((pages, n), dtype=x.dtype), np.zeros((pages, n), dtype=x.dtype))
    out = np.empty((steps, pages, n), dtype=x.dtype)
    inputs = (x.reshape(-1, x.shape[2]) @ w + b).reshape(steps, pages, -1)
    for t in range(steps):
        z = inputs[t] + h @ u
        i, f, o = _sigmoid(z[:, :n]), _sigmoid(z[:, n : 2 * n]), _sigmoid(z[:, 2 * n : 3 * n])
        g = np.tanh(z[:, 3 * n :])
        if keep is not None:
            keep.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def reversed_pages(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's steps back to front; padding stays behind."""
    steps = np.arange(len(x))[:, None]
    back = np.where(steps < sizes, sizes - 1 - steps, steps)
    return np.take_along_axis(x, back[:, :, None], axis=0)


def label(pages: list[np.ndarray], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page; pages of like length are read together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = [int(i) for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi + 1 - lo) <= 40_000 and len(pages[order[hi]]) <= 1.25 * len(pages[order[lo]]) + 4:
            hi += 1
        group = order[lo:hi]
        sizes = np.array([len(pages[i]) for i in group])
        x = np.zeros((int(sizes.max()), len(group), INPUT), dtype=np.float32)
        for k, i in enumerate(group):
            x[: sizes[k], k] = pages[i]
        p = forward(x, sizes, model)
        for k, i in enumerate(group):
            out[i] = p[: sizes[k], k]
        lo = hi
    return out


def forward(x: np.ndarray, sizes: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    there = lstm(x, model["wf"], model["uf"], model["bf"])
    back = reversed_pages(lstm(reversed_pages(x, sizes), model["wb"], model["ub"], model["bb"]), sizes)
    return _sigmoid(np.concatenate([there, back], axis=2) @ model["v"] + model["c"])


#: Blocks that are vectors at once; a longer page is read by windows, there and back.
WINDOW = 8192


def label_long(page: list[Block], model: dict[str, np.ndarray]) -> np.ndarray:
    """Like label() for one page of any number of blocks: both directions carry their states from window to window."""
    cuts = [page[lo : lo + WINDOW] for lo in range(0, len(page), WINDOW)]
    there, state = [], []
    for cut in cuts:
        there.append(lstm(vectors([cut])[0][:, None], model["wf"], model["uf"], model["bf"], state=state)[:, 0])
    out, state = [], []
    for cut, ahead in zip(reversed(cuts), reversed(there), strict=True):
        back = lstm(vectors([cut])[0][::-1, None], model["wb"], model["ub"], model["bb"], state=state)[::-1, 0]
        out.append(_sigmoid(np.concatenate([ahead, back], axis=1) @ model["v"] + model["c"]))
    return np.concatenate(out[::-1])


_models: dict[str, dict[str, np.ndarray]] = {}


def load_model(path: str | None = None) -> dict[str, np.ndarray]:
    path = path or str(Path(__file__).with_name("html_model.npz"))
    if path not in _models:
        with np.load(path) as f:
            _models[path] = {k: f[k].astype(np.float32) for k in f.files}
    return _models[path]


def main_text(pages: list[str], model: dict[str, np.ndarray]) -> list[str]:
    """The texts of the blocks labelled main, joined by newlines."""
    out = [""] * len(pages)
    held: list[tuple[int, list[Block]]] = []
    join = lambda page, probs: "\n".join(b[1] for b, p in zip(page, probs, strict=True) if p >= 0.5)

    def read() -> None:
        for (i, page), probs in zip(held, label(vectors([page for _, page in held]), model), strict=True):
            out[i] = join(page, probs)
        held.clear()

    for i, p in enumerate(pages):
        page = blocks(p)
        if len(page) > WINDOW:
            out[i] = join(page, label_long(page, model))
            continue
        held.append((i, page))
        if sum(len(page) for _, page in held) > 8 * WINDOW:
            read()
    read()
    return out


def _kernel(model: dict[str, np.ndarray], column: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(column)
            keep = [j for j in range(batch.num_columns) if j != i]
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = main_text([h or "" for h in part.column(i).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*(batch.schema.names[j] for j in keep), "text", "n_chars"],
                )

    return kernel


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """pages (html, ...) without html, with text (its main text) and n_chars (code points of it)."""
    own = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "text string", "n_chars long"])
    [column] = free_names([*pages.columns, "text", "n_chars"], "_html")
    return pages.select(*(f.name for f in own), F.col("html").alias(column)).mapInArrow(tidy(_kernel(model or load_model(), column)), schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE: dict[str, str] = {}
