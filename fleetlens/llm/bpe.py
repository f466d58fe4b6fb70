"""Byte-pair encoding by a prefix-sharing trie, and decoding.

The last token of a prefix's encoding is all that an extension of the prefix needs: token t may end a text exactly if
the encoding of the text before t ends in a token that merges leave apart from t. The distinct words of a batch are
taken in byte order, which is the depth-first order of their trie; the states of the path to the current node lie in
one array, so that a shared prefix is encoded once.

Spark cuts texts into words (a JVM regular expression); Arrow gives each batch's distinct words and their places;
Python walks the trie for words not met before by the worker, and numpy lays the encodings out again.

Null texts count as empty (no tokens); a special token's string in a text is that token, as in the tokenizers
library's default. Rows are kept as they come, repeated ones too, and columns besides the id and the text don't matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ship_package
from fleetlens.llm.wordcodes import word_codes

_BLANK = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: How byte-level vocabularies of this kind cut a text into words.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Encodings that a worker keeps from batch to batch, about 50 bytes each.
KEPT_WORDS = 1_300_000
#: Words laid out at once.
SLICE = 1_000_000


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself where it is printable, else the next from U+0100."""
    plain = [b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for s, i in ids.items():
            if s not in self.special:
                self.bytes[i] = raw(s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.n = len(self.bytes)
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(data["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a] * self.n + ids[b]] = r
            parts.setdefault(ids[a + b], (ids[a], ids[b], r))
        never = len(data["model"]["merges"])
        self.left, self.right = ([self._edge(i, parts, side, never) for i in range(self.n)] for side in (0, 1))
        self._apart: dict[int, bool] = {}
        singles = {b: i for i, b in enumerate(self.bytes) if len(b) == 1}
        # a token that merges never reach can't occur
        self.id_of = {b: i for i, b in enumerate(self.bytes) if b and i not in self.special.values() and (b in singles or i in parts and self.apart(*parts[i][:2], parts[i][2]))}
        self.longest = max(map(len, self.id_of))

    @staticmethod
    def _edge(token: int, parts: dict, side: int, never: int) -> list[tuple[int, int]]:
        """Tokens that stand at one edge of token while merges build it, each with the rank of the merge that ends it."""
        out, until = [(token, never)], never
        while token in parts:
            until, token = parts[token][2], parts[token][side]
            out.append((token, until))
        return out

    def apart(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether merges leave a and b side by side; with before: up to that rank."""
        key = a * self.n + b
        if before is None and (known := self._apart.get(key)) is not None:
            return known
        out = True
        for x, x_ends in self.right[a]:
            for y, y_ends in self.left[b]:
                r = self.rank.get(x * self.n + y)
                # at one rank the leftmost merge goes first
                if r is not None and r < x_ends and r <= y_ends and (before is None or r < before):
                    out = False
        if before is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = out
        return out

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of distinct words in byte order: a depth-first walk of their trie."""
        id_of, apart, longest, pair, n = self.id_of, self.apart, self.longest, self._apart, self.n
        last: list[int] = [-1]  # last[i]: last token of the encoding of the first i bytes on the path
        before = b""
        for w in words:
            depth, most = 0, min(len(before), len(w))
            if before[:most] == w[:most]:
                depth = most
            else:
                while before[depth] == w[depth]:
                    depth += 1
            del last[depth + 1 :]
            for end in range(depth + 1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    t = id_of.get(w[start:end])
                    if t is not None:
                        p = last[start]
                        if p < 0:
                            break
                        ok = pair.get(p * n + t)
                        if ok or ok is None and apart(p, t):
                            break
                else:
                    raise ValueError("a byte has no token in this vocabulary")
                last.append(t)
            out, at = [], len(w)
            while at:
                out.append(last[at])
                at -= len(self.bytes[last[at]])
            out.reverse()
            yield out
            before = w


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def laid_out(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(total)]


class Kept:
    """Encodings that a worker keeps from batch to batch: arrays in order of the words' codes, and a dictionary of the newest."""

    def __init__(self):
        self.codes, self.words = np.zeros(0, np.uint64), pa.array([], pa.large_binary())
        self.flat, self.starts, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.newest: dict[bytes, list[int]] = {}

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(marks of the words that the arrays have, places there); a code only finds a word, its bytes decide."""
        codes = word_codes(words)
        place = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[place] == codes if len(self.codes) else np.zeros(len(words), bool)
        at = np.flatnonzero(known)
        known[at] = pc.equal(self.words.take(pa.array(place[at])), words.take(pa.array(at))).to_numpy(zero_copy_only=False)
        return known, place[known]

    def add(self, found: dict[bytes, list[int]]) -> None:
        """When so many are kept that nothing more may be, what is kept stays."""
        if len(self.codes) + len(self.newest) + len(found) > KEPT_WORDS:
            return
        self.newest.update(found)
        if len(self.newest) * 2 > max(100_000, len(self.codes)):
            words = pa.array(list(self.newest), pa.large_binary())
            lengths = np.fromiter(map(len, self.newest.values()), np.int64, len(words))
            codes = np.concatenate([self.codes, word_codes(words)])
            order = np.argsort(codes)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])[order]
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in self.newest.values() for i in ids), "<u4", int(lengths.sum()))])
            self.lengths, self.codes = np.concatenate([self.lengths, lengths])[order], codes[order]
            self.words = pa.concat_arrays([self.words, words]).take(pa.array(order))
            self.newest = {}


@lru_cache(1)
def kept_for(path: str) -> Kept:
    return Kept()


def encodings(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each word's begin, how many it has) for distinct words, special ones among them."""
    v, kept = vocabulary(path), kept_for(path)
    known, place = kept.find(words)
    others = words.filter(pa.array(~known)).to_pylist()
    special = {s.encode(): [i] for s, i in v.special.items()}
    new = sorted(w for w in others if w not in kept.newest and w not in special)
    found = dict(zip(new, v.encode_sorted(new)))
    ids = [special.get(w) or found.get(w) or kept.newest[w] for w in others]
    lengths = np.empty(len(words), np.int64)
    lengths[known], lengths[~known] = kept.lengths[place], np.fromiter(map(len, ids), np.int64, len(ids))
    old = laid_out(kept.flat, kept.starts[place], kept.lengths[place])
    flat = np.concatenate([old, np.fromiter((i for x in ids for i in x), "<u4", int(lengths[~known].sum()))])
    starts = np.empty(len(words), np.int64)
    starts[known] = np.cumsum(lengths[known]) - lengths[known]
    starts[~known] = len(old) + np.cumsum(lengths[~known]) - lengths[~known]
    kept.add(found)
    return flat, starts, lengths


def encoded_batches(path: str, batch: pa.RecordBatch, column: str = "words") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds of the rows in ids) for slices of a batch's rows."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        words = lists.values.slice(offsets[row], offsets[stop] - offsets[row]).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False)
        ids, ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if len(at):
            flat, starts, lengths = encodings(path, words.dictionary.cast(pa.large_binary()))
            ids, ends = laid_out(flat, starts[at], lengths[at]), np.concatenate([[0], np.cumsum(lengths[at])])
        yield row, ids, ends[offsets[row : stop + 1] - offsets[row]]
        row = stop


def words_of(text: Column, special: list[str]) -> Column:
    """The words of a text; each special string is a word of its own."""
    cut = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not special:
        return cut(text)
    quoted = "|".join(rf"\Q{s}\E" for s in sorted(special, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(quoted), F.lit(0))
    parts = F.split(text, quoted, -1)
    mixed = F.flatten(F.transform(parts, lambda p, i: F.concat(cut(p), F.when(i < F.size(found), F.array(F.get(found, i))).otherwise(F.array().cast("array<string>")))))
    some = F.lit(False)
    for s in special:
        some = some | F.contains(text, F.lit(s))
    return F.when(some, mixed).otherwise(cut(text))


def regrouped(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches joined to about so many rows: the more texts are encoded together, the more words they share."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_encoded(docs: DataFrame, path: str, schema: str, rows: Callable[[Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs rows over the encoded slices of each partition: (batch, first row, ids, bounds)."""
    ship_package(docs.sparkSession)
    special = list(vocabulary(path).special)
    cut = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col), special).alias("words"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows((b, *x) for b in regrouped(batches) for x in encoded_batches(path, b))

    return cut.mapInArrow(task, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs, in one narrow stage without a shuffle."""

    def rows(slices):
        for batch, row, ids, ends in slices:
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(out)), out], ["doc_id", "ids"])

    return map_encoded(docs, path, "doc_id long, ids array<int>", rows, id_col, text_col)


class Decoder:
    def __init__(self, path: str):
        tokens = vocabulary(path).bytes
        self.lengths = np.array([len(b) for b in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the bound of each id in them."""
        n = self.lengths[ids]
        return laid_out(self.flat, self.starts[ids], n), np.concatenate([[0], np.cumsum(n)])


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def as_text(raw: bytes) -> bytes:
    """UTF-8 of the decoded text; what isn't UTF-8 becomes U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give an empty text."""
    ship_package(encoded.sparkSession)

    def task(batches):
        for b in batches:
            lists = b.column("ids")
            raw, at = decoder(path)(lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()])
            bounds = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            raw = raw.tobytes()
            texts = [as_text(raw[x:y]).decode() for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).alias("doc_id"), ids.alias("ids")).mapInArrow(task, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text without keeping either."""

    def rows(slices):
        for batch, row, ids, ends in slices:
            raw, at = decoder(path)(ids)
            ids_raw, raw, cuts = ids.tobytes(), raw.tobytes(), at[ends]
            out = [
                (hashlib.sha256(ids_raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(as_text(raw[x:y])).hexdigest())
                for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, len(out)), pa.array(np.diff(ends), pa.int64()), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, id_col, text_col)
