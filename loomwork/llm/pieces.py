"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

Merging pairs by score gives one encoding, and a sequence of pieces is that encoding exactly when every piece merges back to
itself and so does every pair of neighbours: what two neighbours do is not changed by what stands further away. So no merge
queue runs over a text. An Aho-Corasick automaton over the reversed pieces finds the longest piece that starts at each place;
the encoder takes it if it is compatible with the piece before (told once per pair by re-merging the two), else the next
shorter piece that begins it, else gives the last piece back and marks the place as failed in a bitfield. A place is failed
for good: what leads to it is the one encoding of the text before it.

Texts are cut where no piece can reach over: between characters that are neighbours in no piece. The cuts' encodings are
remembered while a task runs, and a long text is dealt with cut by cut. Characters without a piece are their UTF-8 bytes' pieces. Equal scores merge from the left, like the library. Models with
user-defined pieces, which never merge, are beyond this.

Defined cases: a null or empty text has the end id only; texts of spaces only, control pieces' strings and any other
characters are ordinary text; the space sign itself decodes to a space, as in the library; a null id list decodes to null;
repeated rows are encoded each; extra columns pass through, one named like a result is replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm._common import table, tidy

SPACE = "▁"
#: Cuts that a task remembers; when full, those not asked for since the last time are dropped.
CACHE = 200_000
#: Cuts longer than this many characters are not remembered.
LONG = 200
#: Characters whose cuts are found at once.
WINDOW = 1 << 18


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Spelling:
    """What the pieces of a model file decode to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        own = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.text = {i: lib.id_to_piece(i) for i in own}

    @cached_property
    def sounds(self) -> pa.Array:
        """The bytes that each id decodes to."""
        lib = self.library
        out = []
        for i in range(lib.get_piece_size()):
            if lib.is_byte(i):
                out.append(bytes([int(lib.id_to_piece(i)[3:-1], 16)]))
            else:
                out.append(b"" if lib.is_control(i) else self.text[i].replace(SPACE, " ").encode() if i in self.text else None)
        return pa.array(out, pa.large_binary())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids that lie end to end."""
        spelled = pc.take(self.sounds, pa.array(ids, pa.int64()))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), spelled), pa.scalar(b"", pa.large_binary())).to_pylist()
        out = []
        for k, raw in enumerate(joined):
            try:
                text = raw.decode()
            except (AttributeError, UnicodeDecodeError):  # the unknown piece, or bytes that are no text
                text = self.library.decode(ids[offsets[k] : offsets[k + 1]].tolist())
            else:
                text = text[1:] if self._starts_with_space(ids[offsets[k] : offsets[k + 1]]) else text
            out.append(text)
        return out

    def _starts_with_space(self, ids: np.ndarray) -> bool:
        """Whether the first piece that is no control piece begins with the space put in front."""
        for i in ids.tolist():
            if not self.library.is_control(i):
                return i in self.text and self.text[i].startswith(SPACE)
        return False


class Pieces(Spelling):
    """The vocabulary of a model file with its automaton, and what is known of its pairs."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        lib = self.library
        n = lib.get_piece_size()
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.score = {t: lib.get_score(i) for i, t in self.text.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(lib.is_byte(i) for i in self.byte)
        for probe in ("", " a  b ", "ﬁ Å", "a"):
            if lib.normalize(probe) != (SPACE + probe.replace(" ", SPACE) if probe else ""):
                raise ValueError("only models that escape spaces, put one in front and change nothing else are encoded here")
        # characters that only longer pieces hold are pieces here; in the result they are bytes
        self.real = n
        for c in sorted({c for t in self.score for c in t} - self.score.keys()):
            self.text[n] = c
            n += 1
        self.size, self.wide = [len(self.text.get(i, "")) for i in range(n)], n
        sound = {t: i for i, t in self.text.items() if len(t) == 1 or self.merge(t) == [t]}
        #: the longest piece that properly begins each one; -1: none
        self.shorter = [next((sound[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in sound), -1) for t in (self.text.get(i, "") for i in range(n))]
        self.tree = ahocorasick.Automaton()
        for t, i in sound.items():
            self.tree.add_word(t[::-1], i)
        self.tree.make_automaton()
        # two characters that are neighbours in no piece never come to lie in one: texts are cut between them
        letters = sorted({c for t in self.text.values() for c in t})
        self.kinds = np.zeros(0x110000, dtype=np.uint16)
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.near = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for t in self.text.values():
            at = self.kinds[[ord(c) for c in t]]
            self.near[at[:-1], at[1:]] = True
        self._pairs: dict[int, bool] = {}
        self._new, self._old = {}, {}

    def merge(self, text: str) -> list[str]:
        """The definition: the best-scored pair of neighbours that make a piece merges, the leftmost of equals, while any does."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compare(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are side by side."""
        if len(self._pairs) > 4 * CACHE:
            self._pairs.clear()
        fit = self._pairs[a * self.wide + b] = self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return fit

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a text of escaped spaces whose characters all are in pieces."""
        n, wide, size, shorter, pairs = len(text), self.wide, self.size, self.shorter, self._pairs
        longest = [-1] * n
        for at, i in self.tree.iter(text[::-1]):
            if longest[at] < 0:  # of the matches that end at a place the longest comes first
                longest[at] = i
        longest.reverse()
        failed, out, at, last, take = bytearray(n + 1), [], 0, -1, longest[0]
        while True:
            while take >= 0:
                end = at + size[take]
                if not failed[end]:
                    if last < 0:
                        break
                    fit = pairs.get(last * wide + take)
                    if self._compare(last, take) if fit is None else fit:
                        break
                take = shorter[take]
            else:  # nothing goes on from here: the piece before was wrong
                failed[at] = 1
                take = out.pop()
                at -= size[take]
                last, take = (out[-1] if out else -1), shorter[take]
                continue
            out.append(take)
            if end == n:
                return out
            at, last, take = end, take, longest[end]

    def _ids(self, cut: str) -> tuple[int, ...]:
        """Ids of one cut. Unknown characters are cuts of their own."""
        known = self.kinds[ord(cut[0])] > 0
        raw = self.backtrack(cut) if known else [self.real]
        if known and max(raw) < self.real:
            return tuple(raw)
        spell = lambda c: [self.byte[b] for b in c.encode()] if self.has_bytes else [self.unknown]
        return tuple(chain.from_iterable([i] if i < self.real else spell(self.text[i] if known else cut) for i in raw))

    def _learn(self, cut: str) -> tuple[int, ...]:
        ids = self._old.get(cut)
        if ids is None:
            ids = self._ids(cut)
        if len(cut) <= LONG:
            self._new[cut] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the end id."""
        if not text:
            return [self.end]
        text = SPACE + text.replace(" ", SPACE)
        if len(self._new) > CACHE:
            self._old, self._new = self._new, {}
        get, learn, out = self._new.get, self._learn, []
        for lo in range(0, len(text), WINDOW):
            # windows overlap by a character, so that the last place of each is compared with the first of the next
            kind = self.kinds[np.frombuffer(text[lo : lo + WINDOW + 1].encode("utf-32-le"), dtype="<u4")]
            places = np.flatnonzero(~self.near[kind[:-1], kind[1:]]) + (lo + 1)
            begin = 0 if lo == 0 else begin
            for end in places.tolist():
                cut = text[begin:end]
                out += get(cut) or learn(cut)
                begin = end
        out += learn(text[begin:])
        if not self.has_bytes:  # a run of unknown characters is one unknown piece
            out = [i for k, i in enumerate(out) if i != self.unknown or not k or out[k - 1] != self.unknown]
        out.append(self.end)
        return out

    def forget(self) -> None:
        self._new, self._old = {}, {}

_loaded: dict[tuple[str, type], Spelling] = {}


def _one(path: str, kind: type):
    """One vocabulary of a kind per worker process and file."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def pieces(path: str) -> Pieces:
    return _one(path, Pieces)


def spelling(path: str) -> Spelling:
    return _one(path, Spelling)


def _with(df: DataFrame, name: str, kind: T.DataType, column: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with a column that `make` gives from another, batch by batch; a column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower() or f.name == column]
    drop = column.lower() == name.lower()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = make(b.column(b.schema.get_field_index(column)))
            names = [n for n in b.schema.names if not (drop and n == column)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], new], names=[*names, name])

    source = df.select(*[F.col(f"`{f.name}`") for f in kept])
    fields = [f for f in kept if not (drop and f.name == column)]
    return source.mapInArrow(tidy(kernel), T.StructType([*fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, model: str | None = None, column: str = "text") -> DataFrame:
    """docs with `ids`, the ids of a text column and the end id."""
    path = model or default_model()

    def make(texts: pa.Array) -> pa.Array:
        p = pieces(path)
        ids = [np.array(p.encode(t or ""), dtype=np.int32) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))

    return _with(docs, "ids", T.ArrayType(T.IntegerType()), column, make)


def decode(encoded: DataFrame, model: str | None = None, column: str = "ids") -> DataFrame:
    """encoded with `decoded`, the texts of an id column."""
    path = model or default_model()

    def make(lists: pa.Array) -> pa.Array:
        p = spelling(path)
        here = lists.is_valid().to_numpy(zero_copy_only=False)
        lists = lists.fill_null([]) if lists.null_count else lists
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = p.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
        return pa.array([t if ok else None for t, ok in zip(texts, here.tolist(), strict=True)], pa.string())

    return _with(encoded, "decoded", T.StringType(), column, make)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    spelled = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), spelled.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_sentencepiece": op11_sentencepiece}
ORACLE: dict[str, str] = {}
