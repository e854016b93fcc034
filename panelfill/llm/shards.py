"""Sharding of indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfill.session import ship, stored

CRATES_A_SHARD = 1024
LANE_GROUPS = 100_000
NODE = 512


class FreeTree:
    """Balanced two-level tree of (free space, bin): finds the smallest free space that still fits.

    Leaves are sorted runs of at most ``2 * NODE`` entries, split when full, so a step costs the
    logarithm of the number of bins and a short move inside one leaf.
    """

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, free: int, bin_id: int) -> None:
        entry = (free, bin_id)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        i = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        leaf = self.leaves[i]
        insort(leaf, entry)
        if len(leaf) > 2 * NODE:
            self.leaves[i : i + 1] = [leaf[:NODE], leaf[NODE:]]
            self.tops[i : i + 1] = [leaf[NODE - 1], leaf[-1]]
        else:
            self.tops[i] = leaf[-1]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest entry with at least ``size`` free."""
        i = bisect_left(self.tops, (size, -1))
        if i == len(self.tops):
            return None
        leaf = self.leaves[i]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return entry


class Packer:
    """Best fit into bins of one capacity; a larger group gets a bin of its own. Feed sizes in descending order."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.count = capacity, FreeTree(), 0

    def put(self, size: int) -> int:
        found = self.tree.take(size) if size <= self.capacity else None
        free, bin_id = found or (self.capacity, self.count)
        self.count += found is None
        if free > size:
            self.tree.add(free - size, bin_id)
        return bin_id


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size; ties keep their order."""
    packer, out = Packer(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = packer.put(sizes[i])
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size, with the smallest capacity (by bisection) at which best fit decreasing needs no more shards.

    A size above the fair share of what is left takes a shard alone, so that it does not widen the others.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, left, alone = [0] * len(sizes), sum(sizes), 0
    while alone < min(len(order), shards - 1) and sizes[order[alone]] * (shards - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest, bins = order[alone:], shards - alone
    low, high = max(-(-left // bins), 1), max(left, 1)
    best = [0] * len(rest)
    while low <= high:
        capacity = (low + high) // 2
        found = best_fit_decreasing([sizes[i] for i in rest], capacity)
        if max(found, default=0) < bins:
            best, high = found, capacity - 1
        else:
            low = capacity + 1
    for i, b in zip(rest, best):
        out[i] = alone + b
    return out


def _crated(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, packer = None, Packer(capacity)
        for batch in batches:
            out = []
            for own, size in zip(batch["lane"].to_pylist(), batch["bytes"].to_pylist()):
                if own != lane:
                    lane, packer = own, Packer(capacity)
                out.append(packer.put(size))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "crate"])

    return run


def crates(groups: DataFrame, capacity: int, lanes: int) -> DataFrame:
    """Groups (digest, bytes) with lane and crate: best fit decreasing inside each of ``lanes`` hash lanes."""
    ship(groups.sparkSession)
    return (
        groups.select("digest", "bytes")
        .withColumn("lane", F.pmod(F.xxhash64("digest"), F.lit(lanes)))
        .repartition(lanes, "lane")
        .sortWithinPartitions("lane", F.desc("bytes"), "digest")
        .mapInArrow(_crated(capacity), "digest binary, bytes long, lane long, crate long")
    )


def shard(docs: DataFrame, shards: int = 8, crates_a_shard: int = CRATES_A_SHARD, lane_groups: int = LANE_GROUPS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, by the law ``bytes``.

    Equal texts form a group that is never divided. Groups are dealt into hash lanes, and each lane packs its
    own into crates of a ``crates_a_shard``-th of a shard by best fit decreasing; a larger group is a crate of
    its own. The crates, at most ``2 * shards * crates_a_shard`` plus one a lane, are then packed into the
    shards at the smallest capacity that does. So no task holds more groups than a lane, and the driver only
    the crates. Shards differ by about one crate, unless a group alone is larger than a shard. Rows find the shard of
    their group by digest and salt, the salts a group has only, so the rows of one text are spread over as many
    tasks as there are shuffle partitions.

    Null text: size 1, crc of the empty text, in one group with empty texts. Rows that repeat a doc_id get a
    slot each. An empty table gives an empty table; further columns are ignored.
    """
    spark = docs.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).cast("int").alias("salt"),
    )
    rows = stored(rows, "shard-rows")
    salted = rows.groupBy("digest", "salt").agg(F.sum("size").alias("bytes"))
    groups = stored(salted.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.collect_set("salt").alias("salts")), "shard-groups")
    total, count = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity, lanes = max(1, total // (shards * crates_a_shard)), max(1, -(-count // lane_groups))
    placed = stored(crates(groups, capacity, lanes), "shard-crates")
    found = placed.groupBy("lane", "crate").agg(F.sum("bytes").alias("bytes")).orderBy("lane", "crate").collect()
    at = into_shards([r.bytes for r in found], shards)
    table = pa.table({"lane": pa.array([r.lane for r in found], pa.int64()), "crate": pa.array([r.crate for r in found], pa.int64()), "shard": pa.array(at, pa.int32())})
    where = placed.join(spark.createDataFrame(table), ["lane", "crate"]).join(groups, "digest").select("digest", F.explode("salts").alias("salt"), "shard")
    dealt = stored(rows.join(where, ["digest", "salt"]).select("doc_id", "size", "text_crc32", "shard"), "shard-dealt")
    # slots: rows are numbered inside (shard, chunk); a chunk starts where the chunks before it end
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(tasks)))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("row") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
