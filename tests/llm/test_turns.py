"""Conversation repair against an exhaustive search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from panelfill.llm import turns

WHITE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Cost, audit and repaired rows by trying every edit everywhere, the grammar as a pattern on the initials so far."""
    n = len(rows)

    @lru_cache(None)
    def best(i, state):
        options = []
        if i == n and state in "ea":
            options.append((0, "", ()))
        for x in "ua":
            to = _step(state, x)
            if to:
                options.append((2, "I", i, to, ("user" if x == "u" else "assistant", "")))
        if i < n:
            options.append((3, "D", i + 1, state, None))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                to = _step(state, rows[i][2][:1])
                if to:
                    options.append((late, "K", i + 1, to, rows[i][2:]))
                for role in ("user", "assistant"):
                    if _step(state, role[0]):
                        options.append((2 + late, "R", i + 1, _step(state, role[0]), (role, rows[i][3])))
        return options

    # least (cost, audit), cost by cost, so that insertions cannot go round for ever
    frontier, seen = [(0, "", 0, "e", ())], {}
    done = []
    while not done:
        frontier.sort(key=lambda x: (x[0], x[1]))
        cost, audit, i, state, kept = frontier.pop(0)
        if seen.get((i, state), (10**9,)) < (cost, audit):
            continue
        for o in best(i, state):
            if o[1] == "":
                done.append((cost, audit, kept))
            else:
                c, a = cost + o[0], audit + o[1]
                if (c, a) < seen.get((o[2], o[3]), (10**9,)):
                    seen[o[2], o[3]] = (c, a)
                    frontier.append((c, a, o[2], o[3], kept + ((o[4],) if o[4] else ())))
    return min(done)


def _step(state, initial):
    return {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def _wanted(rows):
    convs = {}
    for row in rows:
        convs.setdefault(row[0], [])
    for row in _damaged(rows):
        convs[row[0]].append(row)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        faults = _faults(own)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = _cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def _table(spark, rows, parts=5):
    schema = "conv_id long, turn long, role string, text string, lost boolean, audit string, none long"
    return spark.createDataFrame([(*r, True, "x", 7) for r in rows], schema).repartition(parts)


def _random_rows(seed, convs):
    r, rows = random.Random(seed), []
    for conv in range(convs):
        n = r.choice([1, 2, 3, 4, 5, 6, 8, 14])
        for turn in range(n):
            role = ("user", "assistant")[turn % 2] if r.random() < 0.7 else r.choice(["user", "assistant", "system", "tool", "", None, "user", "Assistant"])
            text = r.choice(["Yes.", "No!", "why?", "cut off", "cut. ", " \t", "", None, "end.\n", "end. ", f"own {r.randrange(99)}.", f"own {r.randrange(99)}"])
            rows.append((conv, r.choice([turn, turn, turn, turn, 3 * turn, None]), "system" if turn == 0 and r.random() < 0.3 else role, text))
    return rows


def test_repair_like_an_exhaustive_search(spark):
    rows = _random_rows(1, 250)
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "yes"), (None, None, None, None), (777, 0, "user", "same."), (777, 0, "user", "same.")]
    rows += [(-5, -(1 << 60), "user", "a."), (-5, 1 << 60, "assistant", "b."), (900, 1, "user", "long " * 50_000 + "."), (900, 2, "assistant", "x" * 100_000)]
    got = turns.repair_report(_table(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _wanted(rows)


def test_conversations_without_rows_and_no_conversations(spark):
    lost = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = turns.repair_report(_table(spark, [(c, 0, "user", "text.") for c in lost])).collect()
    assert sorted(map(tuple, got)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in lost]
    assert turns.repair_report(_table(spark, []).limit(0)).count() == 0


def test_repaired_rows_follow_the_grammar(spark):
    rows = _random_rows(2, 120)
    table = _table(spark, rows).select("conv_id", "turn", "role", "text")
    audits = turns.report(table)
    kept: dict = {}
    for x in sorted(turns.repaired(table, audits).collect(), key=lambda x: (x.conv_id, x.place)):
        assert x.place == len(kept.setdefault(x.conv_id, []))
        kept[x.conv_id].append(x)
    audit = {x.conv_id: x.audit for x in audits.collect()}
    assert set(audit) == {r[0] for r in rows}
    for conv, a in audit.items():
        own = kept.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))
        assert "".join(x.edit for x in own) == a.replace("D", "")
        assert all(x.text == "" and x.turn is None for x in own if x.edit == "I")


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_are_computed_once(seed):
    r = random.Random(seed)
    signed = {"".join(r.choice("suaUAxxo") for _ in range(r.randrange(9))) for _ in range(400)} | {"ua" * 300, "ua" * 301, "sua" + "ua" * 300}
    automaton, known = turns.Automaton(), {}
    for back in sorted(s[::-1] for s in signed):
        known[back[::-1]] = automaton.read(back)
    assert automaton.nodes == len({s[i:] for s in signed for i in range(len(s))})
    assert known["ua" * 300] == (0, "K" * 600) and known[""] == (0, "") if "" in known else True
    for s in sorted(signed, key=len)[:150]:
        rows = [(0, 0, {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "t") for c in s]
        cost, audit, _ = _cheapest(rows, ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in s])
        assert known[s] == (cost, audit), s


def test_a_conversation_across_batches(spark):
    n = 30_000  # more rows than a batch has
    rows = [(1, t, ("user", "assistant")[t % 2], f"row {t}.") for t in range(n)] + [(2, 0, "user", "b."), (2, 1, "assistant", "c.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in turns.report(table).collect()}
    assert got[1].audit == "K" * n and got[1].cost == 0 and got[1].gaps == 0 and got[2].audit == "KK"
    assert turns.repaired(table, turns.report(table)).agg(F.count("*"), F.max("place")).first() == (n + 2, n - 1)
