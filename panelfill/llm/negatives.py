"""Hard negatives by slots between the positives' upper limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfill.session import ship, stored

SCALE = 256
ANCHORS = 100
POSITIVES = 5
NEGATIVES = 5
PERCENT = 80
PACK = 1024
BLOCK_ROWS = 1 << 18
LEAST_BLOCKS = 256
CHUNK = 4096
NO_ID = (1 << 63) - 1
NARROW = 1 << 15
ROWS = "vec_id long, label int, wide boolean, q binary"
TOPS = "label int, pack long, anchor binary, slot binary, score binary, id binary"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose components are all finite, as floor(256 x): two bytes each, or doubles if one does not fit. Equal rows of a batch once."""
    for batch in batches:
        lists = batch["embedding"].cast(pa.large_list(pa.float64()))
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
        with np.errstate(all="ignore"):
            q = np.floor(SCALE * values)
        count = lambda bad: np.concatenate([[0], np.cumsum(bad)])[offsets]
        good = np.diff(count(~np.isfinite(q))) == 0
        wide = np.diff(count(~(np.abs(q) < NARROW))) > 0
        ids, labels = batch["vec_id"].to_numpy(zero_copy_only=False), batch["label"].to_numpy()
        seen, keep, parts = set(), [], []
        for i in np.flatnonzero(good).tolist():
            own = q[offsets[i] : offsets[i + 1]]
            part = own.astype("<f8" if wide[i] else "<i2").tobytes()
            key = (ids[i], labels[i], part)
            if key not in seen:
                seen.add(key)
                keep.append(i)
                parts.append(part)
        yield pa.record_batch([pa.array(ids[keep], pa.int64()), pa.array(labels[keep], pa.int32()), pa.array(wide[keep]), _binary(parts)], ["vec_id", "label", "wide", "q"])


def quantise(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, wide, q) of the rows that take part, labels changed where vec_id is divisible by 7. A null vec_id becomes ``NO_ID``."""
    ship(embeddings.sparkSession)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.alias("label"), "embedding")
    return rows.filter("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_quantised, ROWS)


class Vectors:
    """Distinct vectors of one width and length, by label and then id."""

    def __init__(self, ids, labels, matrix: np.ndarray, wide: bool):
        whole = matrix.view(np.int64) if wide else matrix.astype(np.int64)
        sums = whole @ np.arange(1, 2 * matrix.shape[1], 2, dtype=np.int64)
        order = np.lexsort((sums, ids, labels))
        ids, labels, matrix = ids[order], labels[order], matrix[order]
        same = np.flatnonzero((ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1])) + 1
        new = np.ones(len(ids), bool)
        new[same] = (matrix[same] != matrix[same - 1]).any(axis=1)
        self.ids, self.labels, self.matrix, self.wide = ids[new], labels[new], matrix[new], wide
        self.most = np.abs(self.matrix.astype(np.float64)).max(initial=0.0)


def vectors(wide: np.ndarray, q: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places, matrix and width of the vectors of each width and length."""
    offsets = np.frombuffer(q.buffers()[1], np.int32 if q.type == pa.binary() else np.int64)[q.offset : q.offset + len(q) + 1].astype(np.int64)
    data = np.frombuffer(q.buffers()[2], np.uint8) if q.buffers()[2] is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets)
    for kind in np.unique(length * 2 + wide).tolist():
        at = np.flatnonzero(length * 2 + wide == kind)
        n = kind // 2
        matrix = data[offsets[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), np.uint8)
        yield at, np.ascontiguousarray(matrix).view("<f8" if kind % 2 else "<i2").reshape(len(at), -1), bool(kind % 2)


def scores(a: np.ndarray, wide_a: bool, most_a: float, b: np.ndarray, wide_b: bool, most_b: float) -> np.ndarray:
    """Exact inner products; components that one vector lacks are 0, and what no 64 bits hold is held at their ends."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if wide_a or wide_b:
        whole = np.frompyfunc(int, 1, 1)
        exact = np.zeros((len(a), len(b)), object)
        for k in range(d):
            exact += whole(a[:, k]).astype(object)[:, None] * whole(b[:, k]).astype(object)[None, :]
        return np.clip(exact, -NO_ID, NO_ID).astype(np.int64)
    kind = np.float32 if most_a * most_b * max(1, d) < 1 << 24 else np.float64  # all partial sums are whole numbers that fit
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def best(anchor, slot, score, ids, k: int) -> tuple[np.ndarray, ...]:
    """Of each anchor and slot the first k by score, highest first, and id."""
    order = np.lexsort((ids, -score, slot, anchor))
    anchor, slot, score, ids = anchor[order], slot[order], score[order], ids[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    start = np.flatnonzero(new)
    good = np.arange(len(anchor)) - np.repeat(start, np.diff(np.append(start, len(anchor)))) < k
    return anchor[good], slot[good], score[good], ids[good]


def lowest(limit: np.ndarray, percent: int) -> np.ndarray:
    """The least whole score n with 100 n >= percent * limit."""
    return limit // 100 * percent - (-(limit % 100) * percent) // 100


def slots_of(anchor: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
    """Of each anchor its positives' distinct scores, highest first; unused places hold the least number."""
    out = np.full((m, max(1, np.bincount(anchor, minlength=1).max(initial=0))), -NO_ID - 1, np.int64)
    used = np.zeros(m, np.int64)
    for a, s in zip(anchor.tolist(), score.tolist()):  # they come highest first
        if not used[a] or out[a, used[a] - 1] != s:
            out[a, used[a]] = s
            used[a] += 1
    return out


EMPTY = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))


class Block:
    """The rows of one block, searched by one pack of anchors of one label after the other."""

    def __init__(self, tables: list[pa.RecordBatch]):
        table = pa.Table.from_batches(tables).combine_chunks()
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        q = table["q"].combine_chunks() if table["q"].num_chunks != 1 else table["q"].chunk(0)
        self.groups = [Vectors(ids[at], labels[at], matrix, wide) for at, matrix, wide in vectors(table["wide"].to_numpy(), q)]

    def _chunks(self, label: int, same: bool):
        for g in self.groups:
            low, high = np.searchsorted(g.labels, [label, label + 1])
            for begin, end in [(low, high)] if same else [(0, low), (high, len(g.ids))]:
                for at in range(begin, end, CHUNK):
                    yield g, slice(at, min(end, at + CHUNK))

    def positives(self, label: int, ids: np.ndarray, packed, k: int):
        """The first k other rows of the same label."""
        top, floor = EMPTY, np.full(len(ids), -NO_ID, np.int64)
        for g, part in self._chunks(label, True):
            for at, matrix, wide in packed:
                s = scores(matrix, wide, _most(matrix), g.matrix[part], g.wide, g.most)
                own = ids[at]
                least = floor[at]
                if s.shape[1] > k + 1:  # of so many one may be the anchor itself
                    least = np.maximum(least, np.partition(s, -(k + 1), axis=1)[:, -(k + 1)])
                a, b = np.nonzero(s >= least[:, None])
                itself = np.flatnonzero(g.ids[part][b] == own[a])
                if len(itself) and g.wide == wide and g.matrix.shape[1] == matrix.shape[1]:
                    itself = itself[(g.matrix[part][b[itself]] == matrix[a[itself]]).all(axis=1)]
                    a, b = np.delete(a, itself), np.delete(b, itself)
                if len(a):
                    found = (at[a], np.zeros(len(a), np.int64), s[a, b], g.ids[part][b])
                    top = best(*map(np.concatenate, zip(top, found)), k)
                    full = np.flatnonzero(np.bincount(top[0], minlength=len(ids)) == k)
                    floor[full] = top[2][np.searchsorted(top[0], full, side="right") - 1]
        return top

    def negatives(self, label: int, packed, limits: np.ndarray, percent: int, k: int):
        """The first k rows of other labels in each slot: scores from one limit down to the next, and not below what the limit allows."""
        top, low = EMPTY, np.where(limits >= 0, lowest(limits, percent), NO_ID)
        for g, part in self._chunks(label, False):
            for at, matrix, wide in packed:
                s = scores(matrix, wide, _most(matrix), g.matrix[part], g.wide, g.most)
                a, b = np.nonzero((s <= limits[at, :1]) & (s >= low[at].min(axis=1)[:, None]))
                value, a = s[a, b], at[a]
                slot = (limits[a] >= value[:, None]).sum(axis=1) - 1
                good = value >= low[a, slot]
                if good.any():
                    found = (a[good], slot[good], value[good], g.ids[part][b[good]])
                    top = best(*map(np.concatenate, zip(top, found)), k)
        return top


def _most(matrix: np.ndarray) -> float:
    return np.abs(matrix.astype(np.float64)).max(initial=0.0)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], "<i8") for c in ("anchor", "slot", "score", "id"))


def _tops(label: int, pack: int, top) -> pa.RecordBatch:
    columns = [pa.array([label], pa.int32()), pa.array([pack], pa.int64()), *(_binary([np.ascontiguousarray(x, "<i8").tobytes()]) for x in top)]
    return pa.record_batch(columns, [c.split(" ")[0] for c in TOPS.split(", ")])


def _pack_of(anchors: pa.StructArray) -> tuple[np.ndarray, list]:
    """Ids of a pack's anchors, and their vectors by width and length."""
    return anchors.field("vec_id").to_numpy(), list(vectors(anchors.field("wide").to_numpy(zero_copy_only=False), anchors.field("q")))


def _searched(k: int, percent: int | None):
    """Positives, or negatives if there is a percentage, of every pack that comes after the rows of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            blocks, packs = batch["block"].to_numpy(), batch["pack"].is_valid().to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (packs[1:] != packs[:-1])) + 1).tolist(), len(blocks)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if blocks[a] != number:
                    number, held, block = blocks[a], [], None
                part = batch.slice(a, b - a)
                if not packs[a]:
                    held.append(part.select(["vec_id", "label", "wide", "q"]))
                    continue
                if block is None and held:
                    block, held = Block(held), []
                if block is None:
                    continue
                for i in range(part.num_rows):
                    label, pack = part["label"][i].as_py(), part["pack"][i].as_py()
                    ids, packed = _pack_of(part["anchors"][i].values)
                    if percent is None:
                        top = block.positives(label, ids, packed, k)
                    else:
                        known = _read({c: part[c][i].as_py() for c in ("anchor", "slot", "score", "id")})
                        top = block.negatives(label, packed, slots_of(known[0], known[2], len(ids)), percent, k)
                    if len(top[0]):
                        yield _tops(label, pack, top)

    return run


def _merged(k: int):
    """The first k of each anchor and slot over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top = None, EMPTY
        for batch in batches:
            for row in batch.to_pylist():
                if (row["label"], row["pack"]) != key:
                    if key is not None:
                        yield _tops(*key, top)
                    key, top = (row["label"], row["pack"]), EMPTY
                top = best(*map(np.concatenate, zip(top, _read(row))), k)
        if key is not None:
            yield _tops(*key, top)

    return run


def _answered(percent: int, k: int):
    """Slots merged from the last up: a positive's negatives are the first of its own slot and those after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors = [x["vec_id"] for x in row["anchors"]]
                known = _read(row)
                limits = slots_of(known[0], known[2], len(anchors))
                slots: dict = {}
                for a, slot, score, vec in zip(*(np.frombuffer(row[c], "<i8").tolist() for c in ("n_anchor", "n_slot", "n_score", "n_id"))):
                    slots.setdefault((a, slot), []).append((score, vec))
                suffix: dict = {}
                for a in {a for a, _ in slots}:
                    after: list = []
                    for slot in range(limits.shape[1] - 1, -1, -1):
                        suffix[a, int(limits[a, slot])] = after = (slots.get((a, slot), []) + after)[:k]
                out = []
                for a, score, positive in zip(known[0].tolist(), known[2].tolist(), known[3].tolist()):
                    fits = [x for x in suffix.get((a, score), []) if 100 * x[0] >= percent * score]
                    out += [(anchors[a], positive, rank, vec, score, low) for rank, (low, vec) in enumerate(fits, 1)]
                ids = lambda c: pa.array([None if x[c] == NO_ID else x[c] for x in out], pa.int64())  # noqa: E731, B023
                columns = [ids(0), ids(1), pa.array([x[2] for x in out], pa.int32()), ids(3), *(pa.array([x[c] for x in out], pa.int64()) for c in (4, 5))]
                yield pa.record_batch(columns, [c.split(" ")[0] for c in FOUND.split(", ")])

    return run


def _search(rows: DataFrame, packs: DataFrame, blocks: int, run, k: int) -> DataFrame:
    """Every pack meets every block; what the blocks give for a pack is merged.

    The rows of a block and then all packs come to one task; packs are the small side, a hundredth of the rows, so those are repeated.
    """
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))
    both = rows.withColumn("block", block).unionByName(packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), allowMissingColumns=True)
    both = both.repartition(blocks, "block").sortWithinPartitions("block", F.col("pack").asc_nulls_first(), "label")
    found = both.mapInArrow(run, TOPS)
    return found.repartition(tasks, "label", "pack").sortWithinPartitions("label", "pack").mapInArrow(_merged(k), TOPS)


def hard_negatives(
    embeddings: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, pack: int = PACK
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of floor(256 x) with the anchor's; higher scores come first, ties by smaller vec_id. Anchors
    are the rows whose vec_id is divisible by ``anchors``, their positives the first other rows of their label. Of each anchor
    and positive the first rows of other labels are given whose score is at most the positive's and at least ``percent`` / 100 of it.

    Anchors are packed by label, ``pack`` together; rows are dealt to blocks of at most about ``block_rows``, and every pack
    meets every block, first the rows of its label for the positives, then the others. The positives' scores cut the
    scores of an anchor into slots: a block keeps the first few of each slot, blocks are merged slot by slot, and a positive's
    negatives are the first of its slot and all lower ones, whatever other windows overlap its own. So no pair of rows leaves
    a task but the first few of an anchor and slot, and a task holds one block, one pack and ``CHUNK`` columns of scores.

    Rows with a null label, a null vector, or a null or non-finite component take no part; a vector of fewer components
    counts as one with zeros behind, and an empty one scores 0. Rows that repeat vec_id, label and vector are one; rows that share a
    vec_id otherwise are rows of their own. A null vec_id (a vec_id of 2 ** 63 - 1 counts as null) is no anchor and comes last of
    equal scores. Scores beyond 64 bits are held at +-(2 ** 63 - 1). A negative score of a positive leaves no room for negatives. An
    empty table gives an empty table; further columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = quantise(embeddings)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(-(-embeddings.count() // block_rows), min(tasks, LEAST_BLOCKS))
    chosen = stored(rows.filter((F.col("vec_id") % anchors == 0) & (F.col("vec_id") != NO_ID)).distinct(), "anchors")
    of_label = chosen.groupBy("label").agg(F.ceil(F.count("*") / pack).cast("long").alias("packs"))
    packs = chosen.join(of_label, "label").withColumn("pack", F.pmod(F.xxhash64("vec_id", "q"), "packs"))
    packs = stored(packs.groupBy("label", "pack").agg(F.sort_array(F.collect_list(F.struct("vec_id", "wide", "q"))).alias("anchors")), "packs")
    near = _search(rows, packs, blocks, _searched(positives, None), positives)
    near = stored(packs.join(near, ["label", "pack"]), "positives")
    far = _search(rows, near, blocks, _searched(negatives, percent), negatives)
    far = far.select("label", "pack", *(F.col(c).alias(f"n_{c}") for c in ("anchor", "slot", "score", "id")))
    return near.join(far, ["label", "pack"]).mapInArrow(_answered(percent, negatives), FOUND)
