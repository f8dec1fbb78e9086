"""Byte-pair encoding of a whole corpus with a public rank file.

Merging works on matrices: pieces of text not seen before are put, padded, into numpy matrices by length; in every round
each row merges its leftmost pair of least rank, found by one hashed lookup of pairs; rows without a pair left are taken
out and the matrix is compacted. Pieces are remembered, so a corpus costs little more than splitting and looking up.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.session import spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: How text is split before the merges (a fixed value of the rank file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text goes through in portions of so many characters, matrices of so many cells; so many pieces are remembered.
PORTION, CELLS, REMEMBERED = 1_000_000, 1_000_000, 300_000

_NONE = np.int32(2**31 - 1)


#: The same split with the classes of re, which is faster: exact for text that is ASCII throughout ...
_ASCII = re.compile(
    SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII
)
#: ... and for text without separators that re counts as white space and without numbers that aren't digits.
_PLAIN = re.compile(
    SPLIT.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
)
_ODD = np.array([0x1C <= c <= 0x1F or unicodedata.category(chr(c)) in ("Nl", "No") for c in range(0x110000)])
_EXACT = regex.compile(SPLIT)


def split(text: str) -> list[str]:
    """The pieces of a text that merges don't cross."""
    if text.isascii():
        return _ASCII.findall(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (_EXACT if _ODD[codes].any() else _PLAIN).findall(text)


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class PairTable:
    """Merged id of a pair of ids by open addressing in two flat arrays; looked up for whole arrays at once."""

    BITS = 19

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.mask = np.uint32((1 << self.BITS) - 1)
        self.keys = np.full(1 << self.BITS, 0xFFFFFFFF, np.uint32)
        self.values = np.full(1 << self.BITS, _NONE, np.int32)
        keys = (pairs[:, 0].astype(np.uint32) << np.uint32(16)) | pairs[:, 1].astype(np.uint32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 0xFFFFFFFF
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at], self.values[at] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint32(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids below 0 stand for padding and make no pair."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((found != keys) & (found != 0xFFFFFFFF))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint32(1)) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != 0xFFFFFFFF)]
        out[(left < 0) | (right < 0)] = _NONE
        return out.reshape(shape)


class Encoder:
    """Texts to ids. vocabulary: the bytes of a rank file, `base64 rank` a line."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.of_byte = np.full(256, -1, np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            if len(token) == 1:
                self.of_byte[token[0]] = rank
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left, right))
                    merged.append(rank)
        self.table = PairTable(np.array(pairs), np.array(merged, np.int32))
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Numbers()
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    # -- merging ----------------------------------------------------------------------------------------------------

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each piece: where they start in the last array, how many they are, and the array."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(lengths) - lengths
        out = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        counts = lengths.astype(np.int32)
        low = 1
        for width in (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            step = max(1, CELLS // width)
            for i in range(0, len(rows), step):
                self._merge_rows(rows[i : i + step], begins, lengths, width, out, counts)
            low = width
        for row in np.flatnonzero(lengths > low):
            ids = self._merge_long(out[begins[row] : begins[row] + lengths[row]])
            out[begins[row] : begins[row] + len(ids)], counts[row] = ids, len(ids)
        return begins, counts, out

    def _merge_rows(self, rows: np.ndarray, begins: np.ndarray, lengths: np.ndarray, width: int, out: np.ndarray, counts: np.ndarray) -> None:
        n = lengths[rows]
        at = np.arange(width)
        tokens = np.full((len(rows), width), -1, np.int32)
        inside = at < n[:, None]
        tokens[inside] = out[(begins[rows][:, None] + at)[inside]]
        ranks = self.table(tokens[:, :-1], tokens[:, 1:])
        while True:
            if ranks.shape[1]:
                best = ranks.argmin(1)  # the leftmost of the least
                least = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
            else:
                best, least = np.zeros(len(rows), np.int64), np.full(len(rows), _NONE)
            going = least < _NONE
            if not going.all():
                done = ~going
                inside = np.arange(tokens.shape[1]) < n[done][:, None]
                out[(begins[rows[done]][:, None] + np.arange(tokens.shape[1]))[inside]] = tokens[done][inside]
                counts[rows[done]] = n[done]
                if not going.any():
                    return
                rows, n, tokens, ranks, best, least = (x[going] for x in (rows, n, tokens, ranks, best, least))
            n = n - 1
            row = np.arange(len(rows))
            tokens[row, best] = least
            # Every row lost one token, so the matrix gets narrower by one column.
            at = np.arange(tokens.shape[1] - 1)
            tokens = np.take_along_axis(tokens, at + (at > best[:, None]), 1)
            ranks = np.take_along_axis(ranks, at[:-1] + (at[:-1] >= best[:, None]), 1)
            inner = best < tokens.shape[1] - 1
            r, b = row[inner], best[inner]
            ranks[r, b] = self.table(tokens[r, b], tokens[r, b + 1])
            inner = best > 0
            r, b = row[inner], best[inner]
            ranks[r, b - 1] = self.table(tokens[r, b - 1], tokens[r, b])

    def _merge_long(self, tokens: np.ndarray) -> np.ndarray:
        """One long row: a round merges all pairs of the least rank from left to right, which is the same as one after
        another unless a merge makes a pair of lower rank; then the round merges the leftmost alone."""
        while True:
            ranks = self.table(tokens[:-1], tokens[1:])
            least = ranks.min(initial=_NONE)
            if least == _NONE:
                return tokens
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:
                # Of pairs that overlap (at distance 1) every second one, from the left of each run.
                run = np.cumsum(np.diff(at, prepend=at[0] - 2) > 1)
                first = np.searchsorted(run, run)
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            merged = self._merged(tokens, at, least)
            if len(at) > 1:
                now = self.table(merged[:-1], merged[1:])
                if now.min(initial=_NONE) < least:
                    merged = self._merged(tokens, at[:1], least)
            tokens = merged

    @staticmethod
    def _merged(tokens: np.ndarray, at: np.ndarray, rank: int) -> np.ndarray:
        tokens = tokens.copy()
        tokens[at] = rank
        return np.delete(tokens, at + 1)

    # -- texts ------------------------------------------------------------------------------------------------------

    def _known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the texts by number, and how many each text has."""
        if len(self.pieces) > REMEMBERED:
            self._forget()
        parts = [split(t) for t in texts]
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        which = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64, int(per.sum()))
        new = list(islice(self.pieces, len(self.starts), None))
        if new:
            begins, counts, ids = self.merge([p.encode("utf-8", "surrogatepass") for p in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + begins])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        return which, per

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        which, per = self._known(texts)
        return _gather(self.ids, self.starts[which], self.counts[which]), self._sums(which, per)

    def count(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        return self._sums(*self._known(texts))

    def _sums(self, which: np.ndarray, per: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.counts[which])])
        ends = np.cumsum(per)
        return total[ends] - total[ends - per]


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, flat.dtype)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The process's encoder for a vocabulary; it keeps what it remembers from batch to batch."""
    import hashlib

    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def portions(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts, null as empty, in runs of about PORTION characters, with the number of each run's first."""
    bytes_up_to = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float)))
    at = 0
    while at < len(texts):
        goal = (bytes_up_to[at - 1] if at else 0) + PORTION
        end = max(at + 1, int(np.searchsorted(bytes_up_to, goal, "right")))
        yield at, [t or "" for t in texts.slice(at, end - at).to_pylist()]
        at = end


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size, under a megabyte


def token_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, ids (array<int>) of each row of documents (doc_id, text), without special tokens.

    A null and an empty text have an empty list. Repeated rows and ids come out as often as they go in; a null doc_id
    stays null. Texts of any length are encoded whole. Other columns play no part.
    """
    shared = _vocabulary(documents, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                ids, sizes = enc.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text"))).mapInArrow(encode, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """doc_id, n_tokens of each row of documents (doc_id, text); a null and an empty text have none."""
    shared = _vocabulary(documents, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = [enc.count(texts) for _, texts in portions(batch.column(1))]
            sizes = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("long"), F.col("text"))).mapInArrow(count, "doc_id long, n_tokens long")
