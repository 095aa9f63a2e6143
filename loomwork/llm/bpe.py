"""Token ids of whole texts, as a tokenizers file gives them, for word-level BPE with word-end symbols.

Most words of a corpus repeat, and the rest are merged by the thousand: merge ranks of all new words form a
matrix, and one pass merges the best pair of each word. Only texts of plain ASCII and Latin-1 letters take this
way, where normalising and splitting are a lower-casing and one pattern; other chunks (between ASCII spaces,
where the tokenizer always splits) and special tokens' strings go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from operator import itemgetter

import numpy as np

_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(rf"[{_LETTERS}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\r {_LETTERS}0-9]+")
_CHUNK = re.compile(r"[^\t-\r ]+")
_NONE = np.int32(2**31 - 1)
#: Words kept while a task runs; when full, the words not asked for since the last time are dropped.
CACHE = 400_000


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class WordBpe:
    """encode(texts) -> ids of each text as little-endian uint32 bytes, equal to the library's."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        chars = _byte_chars()
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of about equal length."""
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        cols = np.arange(width)
        ids = np.where(cols < size[:, None], self.inner[raw], np.int32(-1))
        ids[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        done = [b""] * n
        rank = self._rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), dtype=np.int32)
        row = np.arange(n)
        while len(row):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(row)), at]
                over = best == _NONE
            else:
                over = np.ones(len(row), dtype=bool)
            if over.any():
                final = ids[over].astype("<u4", copy=False)
                length = (ids[over] >= 0).sum(axis=1)
                for r, line, k in zip(row[over].tolist(), final, length.tolist(), strict=True):
                    done[r] = line[:k].tobytes()
                live = ~over
                if not live.any():
                    break
                ids, rank, row, at, best = ids[live], rank[live], row[live], at[live], best[live]
            i = np.arange(len(row))
            ids[i, at] = self.made[best]
            w = ids.shape[1]
            source = np.minimum(cols[: w - 1] + (cols[: w - 1] > at[:, None]), w - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            if w == 2:
                rank = np.empty((len(row), 0), dtype=np.int32)
                continue
            source = np.minimum(cols[: w - 2] + (cols[: w - 2] > at[:, None]), w - 2)
            rank = np.take_along_axis(rank, source, axis=1)
            right = at < w - 2
            rank[i[right], at[right]] = self._rank(ids[i[right], at[right]], ids[i[right], at[right] + 1])
            left = at > 0
            rank[i[left], at[left] - 1] = self._rank(ids[i[left], at[left] - 1], ids[i[left], at[left]])
        return done

    def _learn(self, words: list[str]) -> None:
        coded = sorted(((len(raw := w.encode()), raw, w) for w in words), key=itemgetter(0))
        sizes = [x[0] for x in coded]
        lo = 0
        while lo < len(coded):
            # words of about equal length, 8192 at most
            hi = min(lo + 8192, bisect_right(sizes, max(8, sizes[lo] * 5 // 4)))
            part = coded[lo:hi]
            if sizes[lo] > 200:
                for _, _, w in part:
                    self.cache[w] = self._whole(w)
            else:
                self.cache.update(zip((x[2] for x in part), self._merge([x[1] for x in part]), strict=True))
            lo = hi

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, text: str) -> list:
        """Pre-split words of plain parts; other chunks as a tuple."""
        plain = _PLAIN.fullmatch(text) is not None
        if plain and not any(s in text for s in self.specials):
            return _SPLIT.findall(text.lower())
        out: list = []
        for chunk in _CHUNK.findall(text):
            if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.specials):
                out += _SPLIT.findall(chunk.lower())
            else:
                out.append((chunk,))
        return out

    def forget(self) -> None:
        """Drops the words kept, for what comes after in the same worker."""
        self.cache, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            self.old, self.cache = cache, {}
            cache = self.cache
        new = set().union(*split) - cache.keys()
        if self.old:
            for w in list(new):
                if (ids := self.old.get(w)) is not None:
                    cache[w] = ids
                    new.discard(w)
        for w in [w for w in new if isinstance(w, tuple)]:
            cache[w] = self._whole(w[0])
            new.discard(w)
        if new:
            self._learn(list(new))
        get = cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
