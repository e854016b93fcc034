"""Substring dedup: windows of words are grouped in an index of reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.llm.keys import mark, twins
from panelfill.llm.text import Words, mix, slices
from panelfill.session import ship, stored

WINDOW = 20
GRAM = 5
BLOCKS_A_TASK = 4
NO_ID = -(1 << 63)
INDEX = "block int, anchors binary, docs binary, ties binary, starts binary, counts binary, hashes binary"
RANGES = "key long, tie long, start int, count int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _runs(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; each argument marks, for entries from the second on, where a run breaks."""
    n = len(breaks[0]) + 1
    cut = np.ones(n, bool)
    cut[1:] = np.logical_or.reduce(breaks)
    at = np.flatnonzero(cut)
    return at, np.diff(np.append(at, n))


def _anchors(h: np.ndarray, words: Words, window: int, gram: int) -> np.ndarray:
    """Of each window the smallest hash among its word runs of length ``gram``: equal windows have equal anchors."""
    low, span = words.windows(gram, h)[0], 1
    width = window - gram + 1
    while span * 2 <= width:
        low = np.minimum(low, np.append(low[span:], np.full(min(span, len(low)), ~np.uint64(0)))[: len(low)])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low, np.append(low[rest:], np.full(min(rest, len(low)), ~np.uint64(0)))[: len(low)])
    return low


def _blob(values: np.ndarray, bounds: np.ndarray, size: int) -> pa.Array:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(raw)])


def _index(blocks: int, window: int, gram: int):
    """Of each slice: the first place of every window, dealt to the blocks by anchor; places that come again are ranges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            table = table.sort_by([("key", "ascending"), ("tie", "ascending")]).combine_chunks()
            keys, ties = table["key"].to_numpy(), table["tie"].to_numpy()
            same = (keys[1:] == keys[:-1]) & (ties[1:] == ties[:-1])
            number = np.cumsum(np.append(0, ~same))[: len(keys)]  # equal for rows of one document
            words = Words(table["text"])
            h = words.hashes()
            full, inside = words.windows(window, h)
            anchor = _anchors(h, words, window, gram)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            full, anchor = full[at], anchor[at]
            doc = np.repeat(np.arange(len(keys)), words.counts)[at]
            place = at - words.first[doc]
            order = np.argsort(full, kind="stable")
            same = full[order][1:] == full[order][:-1]
            again = np.zeros(len(at), bool)
            head, size = _runs(~same)
            first = np.repeat(order[head], size)  # the first place in the slice of each window
            again[order] = (number[doc[order]] != number[doc[first]]) | (place[order] != place[first])
            # ranges that are known already
            seen = np.flatnonzero(again)
            none = pa.array([b""], pa.binary())
            if len(seen):
                head, size = _runs(doc[seen][1:] != doc[seen][:-1], np.diff(place[seen]) != 1)
                whole = np.array([0, len(head)])
                own = pa.array([int(mix(full[:1])[0] % np.uint64(blocks))], pa.int32())
                yield pa.record_batch(
                    [own, none, _blob(keys[doc[seen][head]], whole, 8), _blob(ties[doc[seen][head]], whole, 8), _blob(place[seen][head].astype(np.int32), whole, 4), _blob(size.astype(np.int32), whole, 4), none],
                    ["block", "anchors", "docs", "ties", "starts", "counts", "hashes"],
                )
            new = np.flatnonzero(~again)
            doc, place, anchor, full = doc[new], place[new], anchor[new], full[new]
            head, size = _runs(doc[1:] != doc[:-1], np.diff(place) != 1, anchor[1:] != anchor[:-1])
            block = (mix(anchor[head]) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            head, size, block = head[order], size[order], block[order]
            ends = np.cumsum(size)
            member = np.arange(ends[-1]) + np.repeat(head - np.append(0, ends[:-1]), size)
            short = full[member].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows, _ = _runs(block[1:] != block[:-1])
            bounds = np.append(rows, len(block))
            yield pa.record_batch(
                [
                    pa.array(block[rows], pa.int32()),
                    _blob(anchor[head], bounds, 8),
                    _blob(keys[doc[head]], bounds, 8),
                    _blob(ties[doc[head]], bounds, 8) if ties.any() else pa.array([b""] * len(rows), pa.binary()),
                    _blob(place[head].astype(np.int32), bounds, 4),
                    _blob(size.astype(np.int32), bounds, 4),
                    _blob(short, np.append(0, ends)[bounds], 6),
                ],
                ["block", "anchors", "docs", "ties", "starts", "counts", "hashes"],
            )

    return run


def _ties(row: dict) -> bytes:
    """Left out where all are 0."""
    return row["ties"] or bytes(len(row["docs"]))


def _repeated(parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, tie, start) of the windows of one reference block that also start earlier."""

    def column(name, kind):
        return np.frombuffer(b"".join(p[name] for p in parts), kind)

    anchor, doc, start, size = column("anchors", "<u8"), column("docs", "<i8"), column("starts", "<i4"), column("counts", "<i4").astype(np.int64)
    tie, number = np.frombuffer(b"".join(map(_ties, parts)), "<i8"), doc
    if tie.any():  # documents in their order
        order = np.lexsort((tie, doc))
        number = np.empty(len(doc), np.int64)
        number[order] = np.cumsum(np.append(0, (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1])))
    order = np.argsort(anchor, kind="stable")
    head, length = _runs(anchor[order][1:] != anchor[order][:-1])
    shared = np.zeros(len(anchor), bool)
    shared[order] = np.repeat(length > 1, length)
    ends = np.cumsum(size)
    keep = np.flatnonzero(shared)
    size, begin = size[keep], (ends - size)[keep]
    if not len(keep):
        return doc[:0], tie[:0], start[:0]
    total = np.cumsum(size)
    step = np.arange(total[-1]) - np.repeat(total - size, size)
    member = np.repeat(begin, size) + step
    raw = np.zeros((len(member), 8), np.uint8)
    raw[:, :6] = column("hashes", np.uint8).reshape(-1, 6)[member]
    window = mix(raw.view("<u8").reshape(-1) ^ np.repeat(anchor[keep], size) * np.uint64(0x9E3779B97F4A7C15))
    owner, place = np.repeat(number[keep], size), np.repeat(start[keep], size) + step
    order = np.lexsort((place, owner, window))
    head, length = _runs(window[order][1:] != window[order][:-1])
    first = np.repeat(order[head], length)
    later = order[(owner[order] != owner[first]) | (place[order] != place[first])]
    run = keep[np.searchsorted(total, later, side="right")]
    return doc[run], tie[run], place[later]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ranges(doc, tie, start, count):
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32())], ["key", "tie", "start", "count"])

    def resolved(parts):
        doc, tie, place = _repeated(parts)
        if len(doc):
            order = np.lexsort((place, tie, doc))
            doc, tie, place = doc[order], tie[order], place[order]
            head, size = _runs(doc[1:] != doc[:-1], tie[1:] != tie[:-1], np.diff(place) != 1)
            yield ranges(doc[head], tie[head], place[head], size)

    block, parts = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if not row["anchors"]:
                yield ranges(np.frombuffer(row["docs"], "<i8"), np.frombuffer(_ties(row), "<i8"), np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["counts"], "<i4"))
                continue
            if row["block"] != block:
                if parts:
                    yield from resolved(parts)
                block, parts = row["block"], []
            parts.append(row)
    if parts:
        yield from resolved(parts)


def _kept(window: int):
    """Factors, maximal runs of repeated windows, leave the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches):
            words = Words(table["text"])
            ranges = table["ranges"].combine_chunks()
            lists, row = ranges.flatten(), np.repeat(np.arange(len(ranges)), pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy())
            start = words.first[row] + lists.field("start").to_numpy()
            steps = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(steps, start, 1)
            np.add.at(steps, start + lists.field("count").to_numpy() + window - 1, -1)
            kept = np.cumsum(steps)[:-1] == 0
            gone = np.append(0, np.cumsum(~kept))
            yield pa.record_batch(
                [
                    table["doc_id"].combine_chunks().cast(pa.int64()),
                    pa.array(words.counts, pa.int64()),
                    pa.array(np.diff(gone[words.first]), pa.int64()),
                    pa.array(words.kept_digests(kept)),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and (key, tie), the place of a document in the input: by id, null first, then by text.

    tie is 0 where an id stands for one text; only texts of other ids are sorted.
    """
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), mark().alias("mark"))
    shared = twins(rows)
    if shared is None:
        return rows.select("doc_id", "text", "key", F.lit(0).cast("long").alias("tie"))
    once = rows.join(shared, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    order = once.orderBy("key", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    ties = stored(order.select("key", "mark", (F.monotonically_increasing_id() + 1).alias("tie")), "ties")
    return rows.join(ties, ["key", "mark"], "left").select("doc_id", "text", "key", F.coalesce("tie", F.lit(0).cast("long")).alias("tie"))


def repeated_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """Runs of repeated windows of :func:`placed` rows: (key, tie, start, count), where windows start .. start + count - 1 also start earlier.

    Every window of ``window`` words is indexed in one of ``blocks`` reference blocks, which its anchor
    names: the smallest hash among its runs of ``gram`` words. Equal windows so meet in one block. A task
    first settles what repeats inside its own slice, so a passage of a third of all documents reaches its
    block once a slice. A window is known by its anchor's 64 and its own 48 further hash bits.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = blocks or BLOCKS_A_TASK * tasks
    index = rows.select("key", "tie", "text").mapInArrow(_index(blocks, window, gram), INDEX)
    return index.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_resolve, RANGES)


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Every window of ``window`` words is looked up among all windows, dealt to reference blocks by its anchor. Windows that
    also start earlier are duplicate; runs of them are spans, and their words go. What counts as earlier is the place in
    the input (document id, then word), not what is left. Words stay byte for byte. This takes the place of a greedy
    Lempel-Ziv parse, whose factors may end inside such a window.

    Null text has no words; texts shorter than a window keep all theirs. A null doc_id counts as smaller than
    any other. Rows that repeat a doc_id and text are one document and get the same answer; rows that share an id,
    or a null one, with different texts are documents of their own, the smaller text first. An empty table gives
    an empty table; further columns are ignored.
    """
    rows = placed(docs)
    found = repeated_ranges(rows, window, gram)
    lists = found.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    return rows.join(lists, ["key", "tie"], "left").select("doc_id", "text", "ranges").mapInArrow(_kept(window), RESULT)
