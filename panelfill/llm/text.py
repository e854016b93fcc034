"""Whole texts as byte arrays: words, chunks and window hashes without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes of text; a longer text comes alone and whole. Null texts become empty."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).combine_chunks()
        texts = pc.fill_null(table[column].cast(pa.large_string()), "")
        table = table.set_column(table.schema.get_field_index(column), column, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy()) if table.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < table.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield table.slice(at, to - at).combine_chunks()
            at = to


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a large_string or large_binary array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64, kept and grown by doubling."""
    have = _POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= SLICE_BYTES:
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the splitmix constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of many texts: maximal runs of bytes other than space, \\t, \\n, \\v, \\f, \\r.

    starts, ends: byte range of each word. first: of each text its first word; first[-1] is the number of words.
    """

    def __init__(self, texts, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        solid = ~SPACE[self.data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
        begin[heads], end[tails] = solid[heads], solid[tails]
        self.solid = solid
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _powers(_INVERSE, n)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def windows(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``size`` words by its first word, and whether it lies in one text."""
        n = len(h)
        out = np.zeros(n, np.uint64)
        if n >= size:
            part = np.zeros(n - size + 1, np.uint64)
            for j in range(size):
                part = part * np.uint64(_BASE) + h[j : n - size + 1 + j]
            out[: n - size + 1] = mix(part)
        last = np.repeat(self.first[1:], self.counts)
        return out, np.arange(n) + size <= last

    def kept_digests(self, kept: np.ndarray) -> list[str]:
        """SHA-256 of each text's kept words joined by one space."""
        mask = np.zeros(len(self.data), bool)
        mask[self.solid] = np.repeat(kept, self.ends - self.starts)
        data, at = self.data.copy(), np.flatnonzero(kept)
        if len(at):
            owner = np.searchsorted(self.first, at, side="right") - 1
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            gaps = self.ends[at[inner]]  # at least one byte of white space follows such a word
            data[gaps], mask[gaps] = 32, True
        count = np.concatenate([[0], np.cumsum(mask)])
        ranges, out = count[self.offsets], memoryview(np.ascontiguousarray(data[mask]))
        return [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist())]


def gap_pairs(gaps: bytes) -> np.ndarray:
    """Byte pairs between which texts may be cut when no token holds a gap after another character.

    No cut follows a character that may count as white space or as a gap mark beyond ASCII, so that a run
    of such characters stays together; other characters beyond ASCII are told apart in :class:`Chunks`.
    """
    pairs = np.zeros((256, 256), bool)
    for gap in gaps:
        pairs[:, gap] = True
        for other in gaps:
            pairs[other, gap] = False
    return pairs


def vocabulary_pairs(tokens: list[str]) -> np.ndarray:
    """ASCII byte pairs that no token holds side by side, and gaps after bytes beyond ASCII: no merge crosses them."""
    pairs = gap_pairs(b" ")
    pairs[:128, :128] = True
    for token in tokens:
        code = token.encode("latin-1", "replace") if token.isascii() else bytes(min(ord(c), 255) for c in token)
        for x, y in zip(code, code[1:]):
            pairs[x, y] = False
    return pairs


class Chunks:
    """Texts cut at given byte pairs, as a dictionary of distinct chunks, each of which a tokenizer can take alone."""

    def __init__(self, texts, pairs: np.ndarray):
        data, self.offsets = buffers(texts)
        n = len(data)
        cut = np.zeros(n, bool)
        cut[1:] = pairs[data[:-1], data[1:]]
        at = np.flatnonzero(cut)
        wide = data[at - 1] >= 128
        if wide.any():  # characters of U+0085, U+00A0 and from U+1000 to U+3FFF may be white space or gap marks
            back = at[wide]
            two, three = data[np.maximum(back - 2, 0)], data[np.maximum(back - 3, 0)]
            cut[back[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
        heads = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, n).astype(np.int64)
        if len(starts):
            chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
            coded = chunks.dictionary_encode()
            self.values, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        else:
            self.values, self.codes = [], np.zeros(0, np.int32)
        self.first = np.searchsorted(starts, self.offsets)

    def joined(self, by_value: list[bytes]) -> tuple[memoryview, list[int]]:
        """What the chunks of each text stand for, end to end, with the byte bounds of each text."""
        parts = pa.array(by_value, pa.large_binary()).take(pa.array(self.codes, pa.int64()))
        data, offsets = buffers(parts)
        return memoryview(np.ascontiguousarray(data)), offsets[self.first].tolist()
