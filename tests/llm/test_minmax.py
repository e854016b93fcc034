"""Min-max hashing against brute force."""

import random
import re

import numpy as np
import pyarrow as pa

from panelfill.llm import jaccard, minmax

WORDS = r"[^\x20\x09-\x0D]+"


def _set(text, size=4):
    words = re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def _least(sets, percent):
    """Smallest id that each id reaches by links, all pairs tried."""
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _rows(seed):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One"), (5, "one\t two"), (6, "one two"), (7, "x" * 50_000)]
    shared = [f"p{i}" for i in range(60)]
    for _ in range(40):
        size = r.choice([1, 2, 5, 8, 9, 12, 30, 60, 90, 150, 500])
        first = now = [r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(9)) for _ in range(size)]
        if r.random() < 0.3:
            first = now = shared + first
        for _ in range(r.randrange(1, 20)):
            words = list(first if r.random() < 0.5 else now)
            for _ in range(r.randrange(max(2, size * 8 // 100))):
                words[r.randrange(len(words))] = "q" + str(r.randrange(1000))
            now = words
            rows.append((20 + len(rows) * 37, " ".join(words)))
    return rows + [(10**6 + i, "the very same copy of one text") for i in range(200)]


def test_near_copies_like_brute_force(spark, table):
    rows = _rows(5)
    sets = {i: _set(t) for i, t in rows}
    least = _least(sets, 80)
    want = sorted((i, len(sets[i]), least[i], least[i] == i) for i in sets)
    assert sorted(map(tuple, minmax.near_copies(table(rows, 4)).collect())) == want
    kept = minmax.drop_near_copies(table(rows, 4))
    assert kept.columns == ["doc_id", "text", "key", "n"] and sorted(x.doc_id for x in kept.collect()) == [w[0] for w in want if w[3]]


def test_no_link_is_lost_where_leaves_and_queries_are_cut(spark, table, monkeypatch):
    monkeypatch.setattr(jaccard, "POINTS_A_TREE", 4)
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):  # a crowd around one text, each with changes of its own
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(len(words))] = f"c{r.randrange(60)}"
        rows.append((i * 3 + 1, " ".join(words)))
    sets = {i: _set(t) for i, t in rows}
    least = _least(sets, 80)
    assert len(set(least.values())) > 5
    for got in (minmax.near_copies(table(rows)), jaccard.jaccard_join(table(rows), 4, 80)):
        assert {x.doc_id: x.component_id for x in got.collect()} == least


def test_near_copies_of_nulls_repeats_and_nothing(spark, table):
    assert minmax.near_copies(table([])).count() == 0
    a, b = ("".join(f" {x}{i}" for i in range(30)) for x in "ab")
    rows = [(None, a + " end"), (3, a), (None, "other"), (4, None), (4, None), (None, b), (None, b + " x"), (5, a + " y"), (5, "of its own")]
    got = sorted(map(tuple, minmax.near_copies(table(rows, 2)).collect()), key=repr)
    nulls = [x for x in got if x[0] is None and x[2] is None and x[1] > 1]
    assert len(nulls) == 2 and sum(x[3] for x in nulls) == 1
    rest = [(None, 28, 3, False), (3, 27, 3, True), (None, 1, None, True), (4, 0, 4, True), (4, 0, 4, True), (5, 28, 3, False), (5, 1, 5, True)]
    assert sorted((x for x in got if x not in nulls), key=repr) == sorted(rest, key=repr)


def test_names_that_clash_with_inner_ones(spark):
    inner = ["_id", "_mark", "_node", "_gone", "row", "node", "key", "kept"]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in inner]) for i, t in [(1, "a b c d e"), (2, "A b c d e"), (3, "else"), (3, "two texts")]], ["doc_id", "text", *inner])
    for drop in (minmax.drop_near_copies, jaccard.drop_near_copies):
        got = drop(docs)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.filter("doc_id <> 2").collect()))


def test_equal_values_estimate_the_likeness():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(600)]
    other = [w if r.random() < 0.97 else f"v{r.randrange(10**6)}" for w in words]
    s = jaccard.Shingles(pa.array([" ".join(words), "", " ".join(other)], pa.large_string()), 4)
    a, b = _set(" ".join(words)), _set(" ".join(other))
    sig = minmax.signatures(s, np.array([0, 2]), 512)
    v = minmax.multipliers(512)
    h = [s.value[s.doc == d][:, None] * v for d in (0, 2)]
    assert (sig == np.stack([np.concatenate([x.min(axis=0), x.max(axis=0)]) for x in h])).all()
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.06
