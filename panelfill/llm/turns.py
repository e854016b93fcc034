"""Conversation structure: faults, and the cheapest repair by an automaton of shared signature suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelfill.session import ship, stored

BLANK = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
MARKS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
TAIL = 256
SALTS = 16
MOST = (1 << 63) - 1

# the grammar (s?(ua)+)?: state after a role initial, states that may end, and the one role that a state can be given
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
GIVEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STEP = {state: NEXT[state, role[0]] for state, role in GIVEN.items()}
LEGAL = np.array([[(x + y) in ("su", "ua", "au") for y in "suao"] for x in "suao"])

# a row's symbol: its role initial (o: another), in capitals if truncated; x if it must go
SYMBOLS = np.frombuffer(b"suaoSUAOxxxx", np.uint8)
FINE, TRUNCATED, GONE, LOST = 0, 1, 2, 3

SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
AUDITED = "signature string, salts array<long>, cost long, audit string"
REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows spoilt by crc32 of conv_id:turn, modulo 20.

    0: lost, 1: text emptied, 2: its marks removed, 3: repeated, 4: role becomes user; a null counts as one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), MARKS, "")).otherwise(shown("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(copies).alias("copy"))
    return out.drop("copy")


def _rows(rows: DataFrame, lost: Column | None) -> DataFrame:
    """Rows with the keys that group and order them: none, conv, late, at, role, digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("late"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.coalesce(F.lit(False) if lost is None else lost, F.lit(False)).alias("lost"),
    )


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class _Signature:
    """What is known of a conversation while its rows pass."""

    def __init__(self, key: tuple):
        self.key, self.parts = key, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.initial = self.low = self.high = None

    def add(self, late, at, initial, fault, again) -> None:
        here = fault != LOST
        if not here.all():
            late, at, initial, fault, again = (x[here] for x in (late, at, initial, fault, again))
        if not len(fault):
            return
        blank = fault == GONE
        repeated = again & ~blank
        cut = (fault == TRUNCATED) & ~repeated
        self.blank += int(blank.sum())
        self.duplicate += int(repeated.sum())
        self.truncated += int(cut.sum())
        self.parts.append(SYMBOLS[np.where(blank | repeated, 8, initial + 4 * cut)].tobytes())
        path = initial if self.initial is None else np.append(self.initial, initial)
        self.illegal += int((~LEGAL[path[:-1], path[1:]]).sum())
        self.initial = initial[-1]
        at = at[late]
        if len(at):
            self.distinct += 1 + int((at[1:] != at[:-1]).sum()) - (self.high == at[0])
            self.low = int(at[0]) if self.low is None else self.low
            self.high = int(at[-1])

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        conv = None if self.key[0] else self.key[1]
        return conv, min(int(gaps), MOST), self.blank, self.duplicate, self.truncated, self.illegal, b"".join(self.parts).decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.strip().split(" ") for c in schema.split(",")))
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, types[k]) for c, k in zip(columns, kinds)], list(names))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        none, conv, *columns = (batch[c].to_numpy(zero_copy_only=False) for c in ("none", "conv", "late", "at", "initial", "fault", "again"))
        bounds = np.flatnonzero((none[1:] != none[:-1]) | (conv[1:] != conv[:-1])) + 1
        done = []
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(conv)]):
            if a == b:
                continue
            key = (bool(none[a]), int(conv[a]))
            if held is None or held.key != key:
                if held is not None:
                    done.append(held.row())
                held = _Signature(key)
            held.add(*(c[a:b] for c in columns))
        yield _batch(done, SIGNED)
    if held is not None:
        yield _batch([held.row()], SIGNED)


def signatures(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, signature (a symbol for each row in order)."""
    ship(rows.sparkSession)
    rows = _rows(rows, lost)
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ends = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).isin(*MARKS)
    fault = F.when(F.col("lost"), LOST).when(~F.rlike("text", F.lit(BLANK)), GONE).when(ends, FINE).otherwise(TRUNCATED)
    narrow = rows.select("none", "conv", "late", "at", "role", "digest", "lost", code.alias("initial"), fault.alias("fault"))
    narrow = narrow.repartition(_tasks(rows), "none", "conv")
    same = Window.partitionBy("none", "conv", "lost", "digest").orderBy("late", "at")
    narrow = narrow.withColumn("again", F.row_number().over(same) > 1)
    ordered = narrow.sortWithinPartitions("none", "conv", "late", "at", "role", "digest")
    return ordered.select("none", "conv", "late", "at", "initial", "fault", "again").mapInArrow(_signed, SIGNED)


class Automaton:
    """Nodes of the last signature's suffixes, each with cost-to-go and first edit by grammar state.

    Signatures come in the order of their reversals, so suffixes that signatures share come together: a signature keeps
    the nodes of the suffix it shares with the one before and adds one node for each further symbol. A node is
    computed once for all signatures that end alike, and nodes with the same symbol before alike cost-to-go share that
    result. The best audit from a node and state is its first edit and the best one from where that leads.
    """

    def __init__(self):
        end = {s: 0 for s in FINAL}
        rel, letters = self._settled([end.get(s) for s in range(4)], [""] * 4)
        self.base, self.rel, self.letters = [0], [rel], [letters]
        self.symbols, self.known, self.nodes = "", {}, 0

    @staticmethod
    def _settled(cost: list, letters: list) -> tuple[tuple, tuple]:
        """Add insertions, which lead to another state of the same node."""
        plain = list(cost)
        for _ in range(4):
            for s in range(4):
                after = cost[STEP[s]]
                if after is not None and (cost[s] is None or after + COST[INSERT] < cost[s]):
                    cost[s] = after + COST[INSERT]
        for s in range(4):
            options = [(letters[s], plain[s])] if plain[s] is not None else []
            options.append((INSERT, cost[STEP[s]] + COST[INSERT]))
            letters[s] = min(letter for letter, c in options if c == cost[s])
        return tuple(cost), tuple(letters)

    def _before(self, symbol: str, after: tuple) -> tuple:
        cost, letters = [None] * 4, [""] * 4
        for s in range(4):
            options = [(COST[DELETE] + after[s], DELETE)]
            if symbol != "x":
                late = TRUNCATED_COST * symbol.isupper()
                to = NEXT.get((s, symbol.lower()))
                if to is not None:
                    options.append((late + after[to], KEEP))
                options.append((COST[REROLE] + late + after[STEP[s]], REROLE))
            cost[s], letters[s] = min(options)
        rel, letters = self._settled(cost, letters)
        least = min(rel)
        return least, tuple(c - least for c in rel), letters

    def read(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature, given as its reversal."""
        shared, limit = 0, min(len(signature), len(self.symbols))
        if signature[:limit] == self.symbols[:limit]:
            shared = limit
        else:
            while signature[shared] == self.symbols[shared]:
                shared += 1
        for stack in (self.base, self.rel, self.letters):
            del stack[shared + 1 :]
        for symbol in signature[shared:]:
            found = self.known.get((symbol, self.rel[-1]))
            if found is None:
                found = self.known[symbol, self.rel[-1]] = self._before(symbol, self.rel[-1])
            self.base.append(self.base[-1] + found[0])
            self.rel.append(found[1])
            self.letters.append(found[2])
        self.nodes += len(signature) - shared
        self.symbols = signature
        return self.base[-1] + self.rel[-1][0], self._audit()

    def _audit(self) -> str:
        out, state, node = [], 0, len(self.symbols)
        while letter := self.letters[node][state]:
            out.append(letter)
            if letter == KEEP:
                state = NEXT[state, self.symbols[node - 1].lower()]
            elif letter != DELETE:
                state = STEP[state]
            node -= letter != INSERT
        return "".join(out)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        rows = []
        for back, salts in zip(batch["back"].to_pylist(), batch["salts"].to_pylist()):
            rows.append((back[::-1], salts, *automaton.read(back)))
        yield _batch(rows, AUDITED)


def report(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    The rows of a conversation follow by turn, nulls first, rows of one turn by role and then by a digest of role and
    text. The first fault of a row counts: blank, duplicate (role and text of an earlier row), truncated (last character but white
    space not one of ``MARKS``). audit is the cheapest sequence of edits, of several the ASCII-least, after which
    the role initials follow the grammar ``(s?(ua)+)?``: keep 0, rerole to user or assistant 2, delete 3 (the only one for blank and
    duplicate rows), insert an empty user or assistant row 2; a truncated row that is not deleted adds 1.

    Equal signatures become one row, are dealt by the range of their last ``TAIL`` symbols and sorted from the end; each task
    walks its part through one :class:`Automaton`, whose nodes are the suffixes, so a suffix is computed once (one of
    at most ``TAIL`` symbols once a task that holds it). A task holds one conversation's symbols at most, a byte a row. A
    signature that very many conversations have meets them through ``SALTS`` rows.

    A null role or text counts as one space; a null conv_id is a conversation of its own; rows with a true ``lost`` only say that
    their conversation exists. Without rows all numbers are 0 and the audit is empty. An empty table gives an empty table;
    further columns are ignored.
    """
    signed = stored(signatures(rows, lost), "signatures").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    distinct = signed.groupBy("signature").agg(F.collect_set("salt").alias("salts"))
    sorted_ = distinct.select(F.reverse("signature").alias("back"), "salts").repartitionByRange(_tasks(rows), F.left("back", F.lit(TAIL))).sortWithinPartitions("back")
    audits = sorted_.mapInArrow(_audited, AUDITED).withColumn("salt", F.explode("salts"))
    return signed.join(audits, ["signature", "salt"]).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, state, place = None, "", 0, 0, 0
    for batch in batches:
        out = []

        def inserted():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == INSERT:
                out.append((conv, place, None, GIVEN[state], "", INSERT))
                state, place, at = STEP[state], place + 1, at + 1

        for row in batch.to_pylist():
            if row["audit"] is not None:  # the conversation's first row
                conv, audit, at, state, place = None if row["none"] else row["conv"], row["audit"], 0, 0, 0
                inserted()
                continue
            edit, at = audit[at], at + 1
            if edit != DELETE:
                role = row["role"] if edit == KEEP else GIVEN[state]
                out.append((conv, place, row["at"] if row["late"] else None, role, row["text"], edit))
                state, place = NEXT[state, role[0]], place + 1
            inserted()
        yield _batch(out, REPAIRED)


def repaired(rows: DataFrame, audits: DataFrame, lost: Column | None = None) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the rows that the audits of :func:`report` leave or insert.

    A conversation's rows stand together in one partition, in order, so that what follows can read them as a stream; texts are
    shuffled once, and sorted with spilling, so a conversation of any length needs the memory of a batch and its audit.
    """
    rows = _rows(rows, lost)
    lines = rows.filter("NOT lost").select("none", "conv", F.lit(1).alias("step"), "late", "at", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.lit(0).alias("step"),
        F.lit(False).alias("late"),
        F.lit(0).cast("long").alias("at"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"),
        F.lit("").alias("text"),
        "audit",
    )
    both = lines.union(heads).repartition(_tasks(rows), "none", "conv")
    both = both.sortWithinPartitions("none", "conv", "step", "late", "at", "role", "digest")
    return both.select("none", "conv", "late", "at", "role", "text", "audit").mapInArrow(_edited, REPAIRED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None
    for batch in batches:
        out = []
        for own, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _batch(out, "conv_id long, repaired_sha256 string")
    if digest is not None:
        yield _batch([(conv, digest.hexdigest())], "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """:func:`report` of the damaged conversations, with repaired_sha256: of role:text of their repaired rows, joined by newlines."""
    rows = damage(conversations.select("conv_id", "turn", "role", "text"))
    found = stored(report(rows, F.col("lost")), "audits")
    digests = repaired(rows, found.select("conv_id", "audit"), F.col("lost")).mapInArrow(_digested, "conv_id long, repaired_sha256 string")
    digests = digests.withColumnRenamed("conv_id", "own")
    empty = F.lit(hashlib.sha256().hexdigest())
    return found.join(digests, found["conv_id"].eqNullSafe(digests["own"]), "left").select(found["*"], F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
