"""Best-fit packing of documents into sequences, with a bounded number of open bins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.llm.text import Chunks, gap_pairs, slices
from panelfill.session import ship, stored

CAPACITY = 1024
OPEN_BINS = 512
END_ID = 2
LANE_TOKENS = 16_000_000
MEMO = 200_000
GAPS = gap_pairs(bytes([9, 10, 11, 12, 13, 32]))

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open bins of one lane. Bit f of ``free`` is set while some open bin has f tokens left."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.open, self.count = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.free &= ~(1 << free)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset for the next piece: the open bin that it fills best, or else a new one."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free, self.count = self.count, self.capacity, self.count + 1
            if length < self.capacity:
                if self.open == self.limit:  # the fullest closes first
                    self._take((self.free & -self.free).bit_length() - 1)
                else:
                    self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.free |= 1 << left
        elif free < self.capacity:
            self.open -= 1
        return bin_id, self.capacity - free


class Encoder:
    """Ids of chunks as little-endian bytes; chunks that come again are remembered, up to ``MEMO`` of them."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}

    def of(self, chunks: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, out = self.memo, []
        for chunk in chunks:
            ids = memo.get(chunk)
            if ids is None:
                ids = np.array(self.encode(chunk), "<u4").tobytes()
                if len(chunk) < 64:
                    memo[chunk] = ids
            out.append(ids)
        return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(i, capacity) for i in range(head, n, capacity)]


def added_tokens(path: str | None) -> dict[str, int]:
    """Ids of the tokens that a tokenizer file adds to its vocabulary: a text is split at them before anything else. No file, none."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in more than their own text are not handled")
    return {t["content"]: t["id"] for t in added if t["content"]}


def _ids(texts, encoder: Encoder) -> tuple[memoryview, list[int]]:
    chunks = Chunks(texts, GAPS)
    return chunks.joined(encoder.of(chunks.values))


def _split(text: str, added: dict[str, int], pattern, encoder: Encoder) -> bytes:
    """Ids of a text that holds added tokens."""
    parts = pattern.split(text)
    ids, bounds = _ids(pa.array([p if p not in added else "" for p in parts], pa.large_string()), encoder)
    return b"".join(np.array([added[p]], "<u4").tobytes() if p in added else ids[a:b] for p, a, b in zip(parts, bounds, bounds[1:]))


def _pieces(path: str, added: dict[str, int], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END_ID], "<u4").tobytes()
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        for table in slices(batches):
            texts = table["text"]
            ids, bounds = _ids(texts, encoder)
            holds = pc.match_substring_regex(texts, pattern.pattern).to_numpy() if pattern else np.zeros(len(texts), bool)
            rows: list[tuple] = []
            for row, (doc, a, b) in enumerate(zip(table["doc_id"].to_pylist(), bounds, bounds[1:])):
                own = _split(texts[row].as_py(), added, pattern, encoder) if holds[row] else ids[a:b]
                n = len(own) // 4 + 1
                for i, (start, length) in enumerate(cut(n, capacity)):
                    last = start + length == n
                    crc = zlib.crc32(own[4 * start : 4 * (start + length - last)])
                    rows.append((doc, i, start, length, zlib.crc32(end, crc) if last else crc))
            columns = zip(*rows) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, bins = None, Bins(capacity, open_bins)
        for batch in batches:
            at = []
            for own, length in zip(batch["lane"].to_pylist(), batch["length"].to_pylist()):
                if own != lane:
                    lane, bins = own, Bins(capacity, open_bins)
                bin_id, offset = bins.put(length)
                at.append((lane << 32 | bin_id, offset))
            ids, offsets = zip(*at) if at else ([], [])
            kept = batch.drop_columns(["lane"])
            yield pa.record_batch([*kept.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``path``: ranks of a byte-level BPE vocabulary; ``tokenizer``: the file that says which tokens are added to it. Pieces are dealt by a hash into lanes of about
    ``lane_tokens``; each lane is packed online by best fit with ``open_bins`` open bins, and a lane ends
    with at most that many sequences that are not full. A document of one token and more always gives a
    piece: its text's ids (none for a null or empty text) and the end id. Rows that repeat a doc_id are
    packed one by one. An empty table gives an empty table; further columns are ignored.

    The piece table is written once to the shared folder; the order inside a lane follows from the rows
    alone, so a task that runs again places its pieces alike.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pieces(path, added_tokens(tokenizer), capacity), PIECES), "pieces")
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    lanes = max(1, tokens // lane_tokens)
    return (
        pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)))
        .repartition(lanes, "lane")
        .sortWithinPartitions("lane", F.xxhash64("piece", "doc_id"), "doc_id", "piece", "length", "ids_crc32")
        .mapInArrow(_placed(capacity, open_bins), PIECES + ", sequence_id long, offset long")
    )
