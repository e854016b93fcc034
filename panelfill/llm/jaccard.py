"""N-gram Jaccard join with a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.llm.graph import components
from panelfill.llm.keys import mark, twins
from panelfill.llm.text import Words, mix, slices
from panelfill.session import ship, stored

SHINGLE = 4
PERCENT = 85
GROUPS = 128
LEAF = 64
POINTS_A_TREE = 8192
BLOCKS_A_TASK = 4
COUNTER_BITS = 18
COUNTER_PARTS = 256
FILTER_BITS = 25
SHINGLED_BYTES = 1 << 20  # text at once: arrays of a byte, a word or a shingle are some fifty times as large
NO_ID = 1 << 62
SIZE, EQUAL, CANDIDATE = 0, 1, 2
DEALT = "block int, keys binary, docs binary, kinds binary, left binary, right binary"
FOUND = "kind int, a long, b long"
SKETCHES = "doc long, n long, counts binary, bits binary"
SETS = "doc long, shingles binary"
NEAR = "root long, leaf long, role int, query boolean, doc long, component long, n long, counts binary, bits binary"


def required(n, percent: int):
    """Smallest intersection of two linked sets whose sizes sum to n."""
    return -(-percent * n // (100 + percent))


@dataclass(frozen=True)
class Classes:
    """Size classes of the smaller set of a pair, and into how many groups its shingles are dealt.

    Two linked sets differ in at most ``most`` shingles, so with more groups than that some group has the same
    shingles in both; there are twice as many, so that each set can leave out its most common ones. Groups that are empty in both say nothing; ``groups`` has room for nearly all sets'
    empty groups, and the rare sets with more share one bucket, since both of a lost pair must be such sets.
    Sets of up to ``PREFIX`` shingles meet by single shingles: the least seen, one more than may differ.
    """

    low: np.ndarray
    groups: np.ndarray
    most: np.ndarray

    PREFIX = 40

    @staticmethod
    def of(percent: int) -> Classes:
        low, groups, most = [1], [1], [0]
        at = Classes.PREFIX + 1
        while at < 1 << 40:
            top = at + at // 2
            pair = top + top * 100 // percent
            k = pair - 2 * required(pair, percent)
            m = 2 * (k + 1)
            while m < 4 * (k + 1):
                empty = m * (1 - 1 / m) ** at
                if m - 1 - k >= empty + 3 * empty**0.5:
                    break
                m += max(1, m // 100)
            low.append(at), groups.append(m), most.append(k)
            at = top + 1
        return Classes(np.array(low), np.array(groups), np.array(most))


class Shingles:
    """Distinct shingles of each text of a slice, sorted by text and hash."""

    def __init__(self, texts, size: int):
        words = Words(texts, lower=True)
        h = words.hashes()
        full, inside = words.windows(size, h)
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        parts, owners = [full[inside]], [doc[inside]]
        for k in range(1, size):  # fewer words: the whole sequence as one
            short = np.flatnonzero(words.counts == k)
            if len(short):
                parts.append(mix(words.windows(k, h)[0][words.first[short]] + np.uint64(k)))
                owners.append(short)
        value, doc = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        self.value, self.doc = value[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(words.counts))
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def _salted(value: np.ndarray, salt: int) -> np.ndarray:
    return mix(value ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))


def _lanes(s: Shingles, rows: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the texts ``rows``, their text, and how many of a text's keys may be missing in a linked one, plus one.

    Any two linked texts share a key of a lane, and hence one among the first so many of each in any common order.
    """
    classes = Classes.of(percent)
    home = np.searchsorted(classes.low, s.n, side="right") - 1
    least = -(-percent * s.n // 100)
    lower = (home > 0) & (least < classes.low[home])
    wanted = np.zeros(len(s.n), bool)
    wanted[rows] = True
    for level, at in ((home, wanted & (s.n > 0)), (home - 1, wanted & lower)):
        member = (at & (level == 0))[s.doc]
        yield _salted(s.value[member], 1), s.doc[member], s.n - least + 1
        many = at & (level > 0)
        if not many.any():
            continue
        most = classes.most[np.maximum(level, 0)]
        m = np.where(many, classes.groups[np.maximum(level, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        member = many[s.doc]
        value, doc = s.value[member], s.doc[member]
        slot = base[doc] + (_salted(value, 2) % m[doc].astype(np.uint64)).astype(np.int64)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, slot, _salted(value, 3))
        filled = np.zeros(base[-1], bool)
        filled[slot] = True
        owner = np.repeat(np.arange(len(m)), m)
        number = np.arange(base[-1]) - base[owner]
        label = (level[owner].astype(np.uint64) << np.uint64(48)) + number.astype(np.uint64)
        yield _salted(content + mix(label), 4)[filled], owner[filled], most + 1
        empty = np.bincount(owner[~filled], minlength=len(m))
        rare = np.flatnonzero(many & (empty > m - 1 - most))
        yield _salted(level[rare].astype(np.uint64), 5), rare, np.ones(len(m), np.int64)


def keys_of(s: Shingles, rows: np.ndarray, percent: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts ``rows`` and their text, the least seen of each lane: any two linked texts share a key."""
    keys, owners = [], []
    for key, owner, keep in _lanes(s, rows, percent):
        order = np.lexsort((key, seen[_counter(key)], owner))
        key, owner = key[order], owner[order]
        good = np.arange(len(owner)) - np.searchsorted(owner, owner) < keep[owner]
        keys.append(key[good])
        owners.append(owner[good])
    return np.concatenate(keys), np.concatenate(owners)


def _counter(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _distinct(s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of every set, the first text of each set, and each further text with its set's first."""
    whole = mix(s.sums(_salted(s.value, 6)) ^ mix(s.sums(_salted(s.value, 7)) + s.n.astype(np.uint64)))
    some = np.flatnonzero(s.n)
    _, first, back = np.unique(whole[some], return_index=True, return_inverse=True)
    rep = some[first]
    return whole, rep, some[rep[back] != some], rep[back][rep[back] != some]


def _counted(size: int, percent: int):
    """How often keys fall on each of the counters, by parts of the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNTER_BITS, "<i4")
        for table in slices(batches, size=SHINGLED_BYTES):
            s = Shingles(table["text"], size)
            for key, _, _ in _lanes(s, _distinct(s)[1], percent):
                np.add.at(seen, _counter(key), 1)
        if seen.any():
            yield _parts(enumerate(seen.reshape(COUNTER_PARTS, -1)))

    return run


def _parts(counts) -> pa.RecordBatch:
    part, values = zip(*counts)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array([x.tobytes() for x in values], pa.binary())], ["part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, "<i4").astype("<i8")
    if total:
        yield _parts(total.items())


def _seen(rows: DataFrame, size: int, percent: int) -> np.ndarray:
    """Counts of all documents' keys on 2 ** ``COUNTER_BITS`` counters (2 MB at any size of the input).

    They only order a document's keys; which links are found does not depend on them.
    """
    parts = rows.mapInArrow(_counted(size, percent), "part int, counts binary").repartition("part").mapInArrow(_summed, "part int, counts binary")
    seen = np.zeros((COUNTER_PARTS, (1 << COUNTER_BITS) // COUNTER_PARTS), np.int64)
    for row in parts.collect():
        seen[row["part"]] = np.frombuffer(row["counts"], "<i8")
    return seen.reshape(-1)


def _group_keys(rows: DataFrame, size: int, percent: int):
    seen = rows.sparkSession.sparkContext.broadcast(_seen(rows, size, percent))  # of fixed size
    return lambda s, texts: keys_of(s, texts, percent, seen.value)


def _binary(values: np.ndarray, bounds: np.ndarray, size: int) -> pa.Array:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(raw)])


def _stars(key: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each key its smallest document; and of the others (kind, document, smallest document), once each."""
    order = np.lexsort((doc, key))
    key, doc, kind = key[order], doc[order], kind[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    pivot = np.repeat(doc[head], np.diff(np.append(head, len(key))))
    rest = doc != pivot
    triples = np.unique(np.stack([kind[rest].astype(np.int64), doc[rest], pivot[rest]]), axis=1) if rest.any() else np.zeros((3, 0), np.int64)
    return order[head], *triples


def _dealt(blocks: int, size: int, keyed):
    """Of each slice the set sizes, the equal sets, and the keys of the others with one document each, dealt to blocks.

    ``keyed`` gives the keys of some texts of a slice and the text of each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "keys", "docs", "kinds", "left", "right"]
        for table in slices(batches, size=SHINGLED_BYTES):
            table = table.sort_by("key").combine_chunks()
            ids = table["key"].to_numpy()
            s = Shingles(table["text"], size)
            whole, rep, copy, same = _distinct(s)  # rep has the smallest ids, as rows are sorted
            keys, owner = keyed(s, rep)
            kind = np.full(len(keys), CANDIDATE, np.uint8)
            keys, owner = np.concatenate([keys, whole[rep]]), np.concatenate([owner, rep])
            kind = np.concatenate([kind, np.full(len(rep), EQUAL, np.uint8)])
            head, k, a, b = _stars(keys, ids[owner], kind)
            known = [
                np.concatenate([np.full(len(ids), SIZE), np.full(len(copy), EQUAL), k]).astype(np.uint8),
                np.concatenate([ids, ids[copy], a]).astype(np.int64),
                np.concatenate([s.n, ids[same], b]).astype(np.int64),
            ]
            one, none = np.array([0, len(known[0])]), pa.array([b""], pa.binary())
            yield pa.record_batch([pa.array([int(whole[0] % np.uint64(blocks))], pa.int32()), none, none, _binary(known[0], one, 1), _binary(known[1], one, 8), _binary(known[2], one, 8)], names)
            if not len(head):
                continue
            block = (keys[head] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            head, block = head[order], block[order]
            rows = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            bounds = np.append(rows, len(block))
            empty = pa.array([b""] * len(rows), pa.binary())
            yield pa.record_batch([pa.array(block[rows], pa.int32()), _binary(keys[head], bounds, 8), _binary(ids[owner[head]], bounds, 8), _binary(kind[head], bounds, 1), empty, empty], names)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(kind, a, b):
        return pa.record_batch([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def settled(parts):
        key, doc, kind = (np.frombuffer(b"".join(p[c] for p in parts), t) for c, t in (("keys", "<u8"), ("docs", "<i8"), ("kinds", np.uint8)))
        _, k, a, b = _stars(key, doc, kind)
        return out(k, a, b)

    block, parts = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if not row["keys"]:
                yield out(np.frombuffer(row["kinds"], np.uint8), np.frombuffer(row["left"], "<i8"), np.frombuffer(row["right"], "<i8"))
                continue
            if row["block"] != block and parts:
                yield settled(parts)
                parts = []
            block = row["block"]
            parts.append(row)
    if parts:
        yield settled(parts)


def _sketches(size: int):
    """Count vectors: the shingles of a text in each of ``GROUPS`` groups, twice as many from 1024 shingles on, and so on.

    ``bits`` says which counts are odd if there are at least as many groups as shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, size=SHINGLED_BYTES):
            s = Shingles(table["text"], size)
            groups = GROUPS << np.ceil(np.log2((s.n >> 10) + 1)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(groups)])
            group = (_salted(s.value, 8) % groups[s.doc].astype(np.uint64)).astype(np.int64)
            counts = np.bincount(first[s.doc] + group, minlength=first[-1]).astype("<i4")
            fine = GROUPS << np.ceil(np.log2(-(-np.maximum(s.n, 1) // GROUPS))).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(fine)])
            group = (_salted(s.value, 8) % fine[s.doc].astype(np.uint64)).astype(np.int64)
            odd = np.packbits(np.bincount(at[s.doc] + group, minlength=at[-1]).astype(np.uint8) & 1, bitorder="little")
            columns = [table["key"].combine_chunks(), pa.array(s.n, pa.int64()), _binary(counts, first, 4), _binary(odd, at // 8, 1)]
            yield pa.record_batch(columns, ["doc", "n", "counts", "bits"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slices(batches, size=SHINGLED_BYTES):
            s = Shingles(table["text"], size)
            yield pa.record_batch([table["key"].combine_chunks(), _binary(s.value, s.first, 8)], ["doc", "shingles"])

    return run


def _vectors(*columns) -> list[np.ndarray]:
    """Count vectors as matrices; longer ones are folded to the shortest, whose groups they split."""
    rows = [[np.frombuffer(x, "<i4") for x in column.to_pylist()] for column in columns]
    least = min((len(x) for column in rows for x in column), default=GROUPS)
    return [np.array([x if len(x) == least else x.reshape(-1, least).sum(axis=0) for x in column], np.int32).reshape(-1, least) for column in rows]


def _odd(column) -> np.ndarray:
    """Bits of odd counts as a matrix of words, folded as the counts are."""
    rows = [np.frombuffer(x, "<u8") for x in column.to_pylist()]
    least = min(map(len, rows), default=1)
    return np.array([x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least)) for x in rows], np.uint64).reshape(-1, least)


def _possible(percent: int):
    """Pairs whose summed coordinate minima reach the intersection they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            need = required(t["n_a"].to_numpy() + t["n_b"].to_numpy(), percent)
            wide = np.maximum(*(pc.binary_length(t[c]).to_numpy() for c in ("counts_a", "counts_b")))
            good = np.zeros(t.num_rows, bool)
            for length in np.unique(wide).tolist():  # a pair's vectors have lengths of their own
                at = np.flatnonzero(wide == length)
                x, y = _vectors(t["counts_a"].take(pa.array(at)), t["counts_b"].take(pa.array(at)))
                good[at] = np.minimum(x, y).sum(axis=1) >= need[at]
            yield t.select(["a", "b"]).filter(pa.array(good))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            good = []
            for x, y in zip(t["shingles_a"], t["shingles_b"]):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([p, q])
                both.sort()
                good.append(bool((both[1:] == both[:-1]).sum() >= required(len(p) + len(q), percent)))
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


class CountTree:
    """R-tree over count vectors: leaves of ``LEAF`` points, each node with its sizes and the largest count of every group.

    A query's intersection with any point below a node is at most the sum of the smaller of its own and the
    node's counts; nodes below the need, or with sizes that cannot link, are left out. Counts that are odd in one of
    two sets only differ by one at least, so too many of those rule a point out before its counts are summed.
    """

    def __init__(self, vectors: np.ndarray, odd: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        order = np.lexsort((component, sizes))
        self.order, self.vectors, self.sizes, self.component = order, vectors[order], sizes[order], component[order]
        self.odd = np.ascontiguousarray(odd[order].T)
        self.levels = []
        high, least, most = self.vectors, self.sizes, self.sizes
        while len(high) > LEAF or not self.levels:
            at = np.arange(0, len(high), LEAF)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most))

    def search(self, vector: np.ndarray, odd: np.ndarray, size: int, component: int, percent: int) -> np.ndarray:
        at = np.arange(len(self.levels[-1][0]))
        for i in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[i]
            at = at[(100 * most[at] >= percent * size) & (percent * least[at] <= 100 * size)]
            at = at[np.minimum(high[at], vector).sum(axis=1) >= required(least[at] + size, percent)]
            if i:
                at = (at[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
                at = at[at < len(self.levels[i - 1][0])]
        if not len(at):
            return at
        # points lie by size: those from the first node to the last, under the largest of their limits
        low, top = at[0] * LEAF, min((at[-1] + 1) * LEAF, len(self.sizes))
        differ = np.zeros(top - low, np.uint32)
        for word, own in zip(self.odd, odd):
            differ += np.bitwise_count(word[low:top] ^ own)
        total = self.sizes[top - 1] + size
        at = low + np.flatnonzero(differ <= total - 2 * required(total, percent) + 2)
        at = at[self.component[at] != component]
        good = np.minimum(self.vectors[at], vector).sum(axis=1) >= required(self.sizes[at] + size, percent)
        return self.order[at[good]]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal (root, leaf) from rows sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        root, leaf = table["root"].to_numpy(), table["leaf"].to_numpy()
        at = 0
        for to in (np.flatnonzero((root[1:] != root[:-1]) | (leaf[1:] != leaf[:-1])) + 1).tolist():
            yield table.slice(at, to - at).combine_chunks()
            at = to
        held = table.slice(at)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _near(percent: int):
    """The points and queries of a leaf whose count vectors allow a link to another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            (vectors,), odd, n, component = _vectors(table["counts"]), _odd(table["bits"]), table["n"].to_numpy(), table["component"].to_numpy()
            points = np.flatnonzero(table["role"].to_numpy() == 0)
            if not len(points):
                continue
            tree = CountTree(vectors[points], odd[points], n[points], component[points])
            near = np.zeros(len(n), bool)
            for x in np.flatnonzero(table["query"].to_numpy()).tolist():
                hits = points[tree.search(vectors[x], odd[x], n[x], component[x], percent)]
                near[hits] = True
                near[x] |= len(hits) > 0
            yield from table.filter(pa.array(near)).to_batches()

    return run


def _searched(percent: int):
    """Links between components among the points of a leaf (role 0) and from outside it (role 1).

    Sets near the median of the count vectors search first, as the likely origin of the others; a set is
    compared only with sets that no link found so far ties to its component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            (vectors,), odd, n, doc = _vectors(table["counts"]), _odd(table["bits"]), table["n"].to_numpy(), table["doc"].to_numpy()
            _, tied = np.unique(table["component"].to_numpy(), return_inverse=True)
            own = tied.copy()
            points = np.flatnonzero(table["role"].to_numpy() == 0)
            if not len(points):
                continue
            tree = CountTree(vectors[points], odd[points], n[points], own[points])
            shingles = table["shingles"].combine_chunks() if isinstance(table["shingles"], pa.ChunkedArray) else table["shingles"]
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in shingles]
            queries = np.flatnonzero(table["query"].to_numpy())
            queries = queries[np.argsort(np.abs(vectors[queries] - np.median(vectors[points], axis=0)).sum(axis=1), kind="stable")]
            a, b = [], []
            for x in queries.tolist():
                hits = points[tree.search(vectors[x], odd[x], n[x], own[x], percent)]
                while len(hits := hits[tied[hits] != tied[x]]):
                    y, hits = hits[0], hits[1:]
                    if len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= required(n[x] + n[y], percent):
                        a.append(doc[x]), b.append(doc[y])
                        tied[tied == tied[y]] = tied[x]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sided(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    return sets.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def _chosen(rows: DataFrame, ids: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of the texts whose keys are in the one column of ``ids``, one row a key, and perhaps of some more.

    Texts are chosen where they are read, by a filter of 2 ** ``FILTER_BITS`` bits (4 MB at any size of the input), so
    that they need no shuffle. The fuller the filter, the more others pass; a join with ``ids`` leaves them out.
    """
    spark = rows.sparkSession
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    at = ids.select(place(ids.columns[0]).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    bits = spark.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing():
            for batch in batches:
                at = batch["at"].to_numpy()
                good = bits.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
                yield batch.select(["key", "text"]).filter(pa.array(good.astype(bool)))

        yield from make(passing())

    return rows.select("key", "text", place("key").alias("at")).mapInArrow(run, schema).dropDuplicates(["doc"])


def _sets_of(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Shingles of the texts whose keys are in the stored column ``ids``."""
    return stored(_chosen(rows, ids, _sets(size), SETS), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that are links: bounded by count vectors first, then by their shingles, read for what the bound leaves."""
    bounded = pairs.join(_sided(sketches, "a", "n", "counts"), "a").join(_sided(sketches, "b", "n", "counts"), "b").mapInArrow(_possible(percent), "a long, b long")
    bounded = stored(bounded, "bounded")
    sets = _sets_of(rows, bounded.select("a").union(bounded.select("b")), size)
    full = bounded.join(_sided(sets, "a", "shingles"), "a").join(_sided(sets, "b", "shingles"), "b")
    return full.mapInArrow(_linked(percent), "a long, b long")


def _flat(equal: DataFrame) -> DataFrame:
    """Equal sets (a, b) with b the smallest of all: a copy names its slice's smallest, and that one the smallest of all."""
    one = equal.groupBy("a").agg(F.min("b").alias("b"))
    top = one.select(F.col("a").alias("b"), F.col("b").alias("top"))
    return one.join(top, "b", "left").select("a", F.coalesce("top", "b").alias("b"))


def _unmet(cand: DataFrame, rows: DataFrame, sketches: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components whose documents met, but whose linked documents were not paired with each other.

    A missed link joins two documents that met under one key with the same smallest document, so their
    components hang together through pairs of different components. Where some do, the documents of all but
    the largest component search count-vector R-trees over all of them, dealt by bands of set size, and by a
    hash where a band has more than ``POINTS_A_TREE`` sets. Queries of a leaf are dealt into parts of as many, each with all
    points of the leaf, so that no task has more than that of either however many sets hang together. The trees are searched twice: first on count vectors
    alone, then with the shingles of the sets that the bounds leave, so that hits are verified in the task.
    """

    def named(df, node, name):
        c = found.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(c, node, "left").withColumn(name, F.coalesce(name, node))

    across = stored(named(named(cand, "a", "ca"), "b", "cb").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "across")
    tops = components(across).select(F.col("node").alias("component"), F.col("component").alias("root"))
    tops = tops.union(tops.select(F.col("root").alias("component"), "root").distinct())
    # linked sets differ in size by less than one band
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    owned = named(sketches.select("doc", band.alias("band")), "doc", "component")
    sizes = owned.groupBy("component").agg(F.count("*").alias("size")).join(tops, "component")
    main = sizes.groupBy("root").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    tops = stored(tops.join(main, "root"), "tops")  # a row a component: a document finds root and main by its component
    members = stored(owned.join(tops, "component").withColumn("query", F.col("component") != F.col("main")), "members")
    # bands of so many sets or queries that they are cut: of each how many leaves, and parts of the queries
    bands = members.groupBy("root", "band").agg(F.count("*").alias("n"), F.count_if("query").alias("queries"))
    reach = bands.select("root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "queries")
    reach = reach.groupBy("root", "band").agg(F.sum("queries").alias("queries"))
    share = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / POINTS_A_TREE)).cast("long")
    cut = bands.drop("queries").join(reach, ["root", "band"]).select("root", "band", share("n").alias("leaves"), share("queries").alias("parts"))
    cut = stored(cut.filter("leaves > 1 OR parts > 1"), "leaves")

    def with_leaves(df):
        one = F.lit(1).cast("long")
        return df.join(cut, ["root", "band"], "left").withColumns({"leaves": F.coalesce("leaves", one), "parts": F.coalesce("parts", one)})

    own_part = F.pmod(F.xxhash64("doc", F.lit("part")), "parts")
    points = with_leaves(members).withColumn("leaf", F.pmod(F.xxhash64("doc"), "leaves"))
    asked = points.filter("query").select("root", "query", "doc", "component", F.col("band").alias("own"), F.col("leaf").alias("home"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    known = bands.select("root", "band")  # a band without sets has no leaf
    asked = with_leaves(asked.join(known, ["root", "band"], "left_semi")).withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("leaves") - 1)))
    asked = asked.filter("band <> own OR leaf <> home").withColumn("part", own_part)
    points = points.withColumn("own_part", own_part).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    points = points.withColumn("query", F.col("query") & (F.col("part") == F.col("own_part")))
    columns = ["root", "band", "leaf", "part", "role", "query", "doc", "component"]
    placed = points.withColumn("role", F.lit(0)).select(columns).union(asked.withColumn("role", F.lit(1)).select(columns))
    tasks = max(1, int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_leaf(df):
        return df.repartition(tasks, "root", "leaf").sortWithinPartitions("root", "leaf", "role", "doc")

    full = placed.withColumn("leaf", F.xxhash64("band", "leaf", "part")).join(sketches, "doc").select([c.split(" ")[0] for c in NEAR.split(", ")])
    near = stored(by_leaf(full).mapInArrow(_near(percent), NEAR), "near")
    sets = _sets_of(rows, near.select("doc"), size)
    return by_leaf(near.join(sets, "doc")).mapInArrow(_searched(percent), "a long, b long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (doc_id, text, row) with _node, a number for each document, and (node, id) of the documents that share an id, if there are any.

    The number is the id; above all ids, one for each text, if the id is null or stands for more than one text.
    """
    small = F.when(F.col("doc_id") >= NO_ID, F.raise_error(F.lit("ids must be below 2 ** 62"))).otherwise(F.col("doc_id"))
    docs = docs.withColumn("doc_id", small.cast("long"))
    above = lambda m: F.lit(NO_ID) + m.bitwiseAND(F.lit(NO_ID - 1))
    shared = twins(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), mark().alias("mark")))
    if shared is None:
        return docs.withColumn("_node", F.coalesce("doc_id", above(mark()))), None
    of = shared.select(F.col("key").alias("_id"), F.col("mark").alias("_mark"))
    rows = docs.join(of, (F.col("doc_id") == F.col("_id")) & (mark() == F.col("_mark")), "left")
    alone = F.when(F.col("_id").isNull(), F.col("doc_id"))
    return rows.withColumn("_node", F.coalesce(alone, above(mark()))).drop("_id", "_mark"), shared.select(above(F.col("mark")).alias("node"), F.col("key").alias("id"))


def joined(docs: DataFrame, size: int, percent: int, keys=None) -> tuple[DataFrame, DataFrame]:
    """(_node, row) with a struct of all columns of ``docs``, and by row (node, n_shingles, least, stays).

    ``keys(rows)`` gives the function by whose keys documents meet; without it they meet by shingle groups. least is the smallest id of the component, stays the document that has it; of several the one with the smallest
    number. A least or id from ``NO_ID`` on stands for null. Where ids are shared there is a column id as well.
    """
    spark = docs.sparkSession
    ship(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered, shared = _numbered(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    rows = numbered.select(F.col("_node").alias("key"), "text")
    numbered = numbered.select("_node", "row")
    keyed = keys(rows) if keys else _group_keys(rows, size, percent)
    dealt = rows.mapInArrow(_dealt(BLOCKS_A_TASK * tasks, size, keyed), DEALT).repartition(tasks, "block").sortWithinPartitions("block")
    met = stored(dealt.mapInArrow(_met, FOUND), "met")
    equal = stored(_flat(met.filter(F.col("kind") == EQUAL)), "equal")
    cand = met.filter(F.col("kind") == CANDIDATE).select("a", "b").distinct()
    for side in ("a", "b"):  # of equal sets only the smallest document goes on
        to = equal.select(F.col("a").alias(side), F.col("b").alias("same"))
        cand = cand.join(to, side, "left").withColumn(side, F.coalesce("same", side)).drop("same")
    cand = stored(cand.filter("a <> b").select("a", "b").distinct(), "pairs")
    sketches = stored(_chosen(rows, cand.select("a").union(cand.select("b")), _sketches(size), SKETCHES), "sketches")
    links = stored(equal.union(_verified(cand, rows, sketches, size, percent)), "verified")
    found = components(links)
    more = stored(_unmet(cand, rows, sketches, found, size, percent), "more")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    sizes = met.filter(F.col("kind") == SIZE).select(F.col("a").alias("node"), F.col("b").alias("n_shingles"))
    sets = sizes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if shared is None:
        return numbered, sets.select("node", "n_shingles", F.col("component").alias("least"), F.col("component").alias("stays"))
    sets = sets.join(shared, "node", "left").withColumn("id", F.coalesce("id", "node"))
    best = sets.groupBy("component").agg(F.min(F.struct("id", "node")).alias("best"))
    return numbered, sets.join(best, "component").select("node", "n_shingles", F.col("best.id").alias("least"), F.col("best.node").alias("stays"), "id")


def jaccard_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when their sets of ``size``-word shingles (A-Z lower-cased) have a Jaccard likeness of at
    least ``percent`` / 100; component_id is the smallest doc_id reachable. No link between different sets is lost:

    1. Shingles are hashed into groups, more of them than two linked sets may differ in shingles, so that two linked
       sets agree in some whole group; such documents meet under that group's key (:class:`Classes`). A document
       goes by its least seen keys only, one more than a linked document may lack: passages that many documents
       share seldom are among them, and linked documents still share one, as in any common order. Inside a slice and again inside a block each document is paired with the smallest of its key, never all with all.
    2. Pairs are bounded by the summed minima of their count vectors, and the rest verified on the shingles,
       which are taken from the texts again for these pairs only.
    3. Where paired documents still lie in several components, those outside the largest search count-vector
       R-trees over all of them, and what these give is verified as well (:func:`_unmet`).

    Equal sets are linked by a 64-bit digest of the set; shingles are compared by 64-bit hashes. Null, empty and
    blank texts have no shingles and link with nothing. A null doc_id counts as larger than any other (ids must
    be below 2 ** 62), and its component_id is null unless linked to another. Rows that repeat doc_id and text are one
    document and give a row each; rows that share an id, or a null one, with different texts are documents of their own.
    An empty table gives an empty table; further columns are ignored.
    """
    return classes(joined(docs, size, percent)[1]).drop("kept")


def classes(sets: DataFrame) -> DataFrame:
    """By row (doc_id, n_shingles, component_id, kept) of what :func:`joined` gives; kept is the one that stays."""
    own = "id" if "id" in sets.columns else "node"
    id_of = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return sets.select(id_of(own).alias("doc_id"), "n_shingles", id_of("least").alias("component_id"), (F.col("node") == F.col("stays")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; null ids are the largest. Columns of ``docs``.

    Rows that repeat doc_id and text are one document, and stay or go together.
    """
    return stay(*joined(docs, size, percent))


def stay(numbered: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows, of both results of :func:`joined`, whose documents stay."""
    gone = sets.filter("node <> stays").select(F.col("node").alias("_gone")).distinct()
    return numbered.join(gone, F.col("_node") == F.col("_gone"), "left_anti").select("row.*")
