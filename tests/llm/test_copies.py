"""Exact dedup, sharding, substring dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from panelfill.llm import exact, jaccard, repeats, shards
from panelfill.llm.graph import components

WORDS = r"[^\x20\x09-\x0D]+"
EDGES = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One"), (5, "one\t two"), (6, "one two"), (None, "one  two"), (7, "x" * 50_000)]


def test_exact_dedup(spark, table):
    rows = EDGES + [(8, "one two"), (8, "one two"), (9, "a\x0bb"), (10, "a b")] + [(100 + i, "hot text") for i in range(300)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[norm(t)]
        low = min((x for x in ids if x is not None), default=None)
        want.append((i, low, len(ids), i == low, hashlib.sha256(norm(t).encode()).hexdigest()))
    for salts in (4, None):
        assert sorted(map(tuple, exact.exact_dedup(table(rows), salts).collect()), key=repr) == sorted(want, key=repr)
    assert exact.exact_dedup(table([])).count() == 0
    kept = exact.drop_copies(table(EDGES))
    assert kept.columns == ["doc_id", "text", "key", "n"] and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5, 7]


def test_one_row_of_each_text_stays(spark, table):
    rows = [(None, "only null"), (None, "only null"), (None, "only  null"), (None, "one"), (3, "one"), (3, "one"), (2, "one"), (2, "own of two"), (None, "x"), (4, None), (5, "")]
    got = exact.drop_copies(table(rows)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted([(None, "only  null"), (2, "one"), (2, "own of two"), (None, "x"), (4, None)], key=repr)


def test_the_row_that_stays_is_whole(spark):
    rows = [(2, "a  b", "z", {"k": 1}, 5), (1, "a b", "y", {"k": 2}, 6), (1, "a b", "x", {"k": 3}, 7), (None, "a\tb", "w", None, 8), (9, "own", None, {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, loose map<string,int>, `firm.norm` int")
    for some, want in (
        (docs, [(1, "a b", "x", {"k": 3}, 7), (9, "own", None, {}, None)]),
        (docs.select("loose", "text", "doc_id"), None),
        (docs.select("text", "doc_id"), [("a b", 1), ("own", 9)]),
    ):
        got = exact.drop_copies(some.repartition(3))
        assert got.schema.simpleString() == some.schema.simpleString()
        found = sorted(map(tuple, got.collect()), key=repr)
        assert found == sorted(want, key=repr) if want else len(found) == 2


def test_sharding(spark, table):
    r = random.Random(1)
    rows = EDGES + [(100 + i, "x" * r.randrange(300)) for i in range(700)] + [(1000 + i, "copy") for i in range(100)] + [(1000, "copy")]
    got = shards.shard(table(rows), crates_a_shard=64, lane_groups=50).collect()
    assert len(got) == len(rows)
    shard_of, total, slots = {}, [0] * 8, {}
    text = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    for x in got:
        t = text[x.doc_id, x.size, x.text_crc32]
        assert shard_of.setdefault(t, x.shard) == x.shard and x.law == "bytes" and x.grown_shard is None
        total[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    others = sorted(total)[:-1]  # one text is larger than a shard
    assert others[-1] - others[0] <= 600 and shards.shard(table([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_decreasing_like_a_plain_search(seed):
    r = random.Random(seed)
    sizes, capacity = [r.randrange(1, 120) for _ in range(2500)], 100
    bins, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(free, b) for b, free in enumerate(bins) if free >= sizes[i]]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(capacity)
        bins[b] -= sizes[i]
        want[i] = b
    got = shards.best_fit_decreasing(sizes, capacity)
    assert max(got) == max(want) and sorted(got.count(b) for b in set(got)) == sorted(want.count(b) for b in set(want))


def test_substring_dedup(spark, table):
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefg") + r.choice("xyé") for _ in range(200)) for _ in range(4)]
    rows = [e for e in EDGES if e[0] is not None]
    for i in range(20, 120):
        words = []
        for _ in range(r.randrange(1, 5)):
            at, own = r.randrange(150), r.choice(base).split(" ")
            words += own[at : at + r.randrange(10, 60)] + [r.choice("pqr") + str(r.randrange(9)) for _ in range(r.randrange(20))]
            words += ["and"] * r.randrange(40) if r.random() < 0.1 else []
        rows.append((i * 7, r.choice([" ", "\n", "  "]).join(words)))
    seen, want = set(), []
    for i, t in sorted(rows):
        words = re.findall(WORDS, t or "")
        kept = [True] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                kept[s : s + 20] = [False] * 20
            seen.add(window)
        text = " ".join(w for w, k in zip(words, kept) if k)
        want.append((i, len(words), kept.count(False), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, repeats.drop_repeats(table(rows, 5)).collect())) == want
    assert repeats.drop_repeats(table([])).count() == 0


def _without_repeats(rows):
    """What drop_repeats gives for distinct rows, by plain search: null ids first, texts of one id in their order."""
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        words = re.findall(WORDS, t or "")
        kept = [True] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                kept[s : s + 20] = [False] * 20
            seen.add(window)
        text = " ".join(w for w, k in zip(words, kept) if k)
        want.append((i, len(words), kept.count(False), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(want, key=repr)


def test_substring_dedup_of_long_templates(spark, table):
    r = random.Random(6)
    passages = [" ".join(f"{r.choice('abcdefg')}{r.randrange(1000)}" for _ in range(40)) for _ in range(30)]
    rows = [(i, "\n".join(f"{i} log entry of the day {n}" for n in range(300))) for i in range(4)]
    rows += [(10 + i, "\n".join(f"at {n} host {i} gave {n * i} to all of us" for n in range(300))) for i in range(4)]
    rows += [(20 + i, f"own{i} {r.choice(passages)} mid{i} {r.choice(passages)} end{i}") for i in range(200)]
    got = repeats.drop_repeats(table(rows, 4)).collect()
    assert sorted(map(tuple, got), key=repr) == _without_repeats(rows)


def test_substring_dedup_of_null_and_repeated_ids(spark, table):
    r = random.Random(8)
    passages = [" ".join(f"{r.choice('abcdefg')}{r.randrange(1000)}" for _ in range(40)) for _ in range(6)]
    words = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{p} {words(r.randrange(30))}") for p in passages for i in (None, 7, 7, None, -(1 << 63))]  # the same place in several texts
    rows += [(r.choice([None, 7, 8, 9]), f"{words(r.randrange(60))} {r.choice(passages)} {words(r.randrange(300))}") for _ in range(60)]
    rows += [(None, "short"), (None, None), (None, words(30)), (7, "short"), (7, "")]
    for parts in (1, 4):
        got = repeats.drop_repeats(table(rows, parts)).collect()
        assert sorted(map(tuple, got), key=repr) == _without_repeats(rows)
    both = [(None, passages[0]), (None, passages[0]), (3, "a b"), (3, "a b")]
    assert [x.n_removed for x in repeats.drop_repeats(table(both)).collect()] == [0] * 4


def _shingles(text, size=4):
    words = re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def test_jaccard_join_loses_no_link(spark, table):
    r = random.Random(5)
    rows = [e for e in EDGES if e[0] is not None]
    for _ in range(40):
        size = r.choice([1, 2, 5, 8, 12, 30, 40, 43, 60, 90, 150, 500])
        first = now = [r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(9)) for _ in range(size)]
        for _ in range(r.randrange(1, 20)):
            words = list(first if r.random() < 0.5 else now)
            for _ in range(r.randrange(max(2, size * 6 // 100))):
                words[r.randrange(len(words))] = "q" + str(r.randrange(1000))
            now = words
            rows.append((20 + len(rows) * 37, " ".join(words)))
    sets = {i: _shingles(t) for i, t in rows}
    ids, top = sorted(sets), {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    want = [(i, len(sets[i]), find(i)) for i in ids]
    assert sorted(map(tuple, jaccard.jaccard_join(table(rows, 4)).collect())) == want


def test_jaccard_join_of_nulls_and_nothing(spark, table):
    assert jaccard.jaccard_join(table([])).count() == 0
    got = jaccard.jaccard_join(table([(None, "a b c d e"), (3, "A b c d e"), (None, "other"), (4, None)], 1)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, 3), (3, 2, 3), (None, 1, None), (4, 0, 4)], key=repr)


def test_near_copies_of_null_and_repeated_ids(spark, table):
    a, b, c, d = ("".join(f" {x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a + " end"), (3, a), (None, "an own text"), (None, None), (None, "")]  # one linked to an id, others alone
    rows += [(5, a + " last"), (5, "another text of five"), (6, "a"), (6, "six b")]  # one of two texts goes
    rows += [(None, b), (None, b + " x"), (None, b + " y")]  # linked with each other only
    rows += [(8, c + " x"), (8, d), (7, c), (4, d + " y"), (9, c + " y"), (9, c + " z")]
    twice = [(2, "both rows"), (2, "both rows")]
    kept = [(x.doc_id, x.text) for x in jaccard.drop_near_copies(table(rows + twice, 4)).collect()]
    b_kept = [x for x in kept if x[1] and x[1].startswith(b)]
    want = [(3, a), (None, "an own text"), (None, None), (None, ""), (5, "another text of five"), (6, "a"), (6, "six b"), (7, c), (4, d + " y"), *twice]
    assert len(b_kept) == 1 and b_kept[0][0] is None
    assert sorted(x for x in map(repr, kept) if x != repr(b_kept[0])) == sorted(map(repr, want))
    got = sorted((x.doc_id or 0, x.component_id or 0, x.n_shingles) for x in jaccard.jaccard_join(table(rows, 4)).collect())
    assert got == sorted(
        [(0, 3, 28), (3, 3, 27), (0, 0, 1), (0, 0, 0), (0, 0, 0), (5, 3, 28), (5, 5, 1), (6, 6, 1), (6, 6, 1), (0, 0, 27), (0, 0, 28), (0, 0, 28)]
        + [(8, 7, 28), (8, 4, 27), (7, 7, 27), (4, 4, 28), (9, 7, 28), (9, 7, 28)]
    )
    assert jaccard.drop_near_copies(table([(1, "x")])).columns == ["doc_id", "text", "key", "n"]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_key_in_any_order(seed):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 30, 60, 150, 400]))]
        if rng.random() < 0.5:
            words += passage
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randrange(0, 3 + len(copy) // 60)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy[: len(copy) - rng.randrange(0, 1 + len(copy) // 20)]))
    s = jaccard.Shingles(pa.array(texts, pa.large_string()), 4)
    seen = np.random.default_rng(seed).integers(0, 5, 1 << jaccard.COUNTER_BITS)
    key, owner = jaccard.keys_of(s, np.arange(len(texts)), 85, seen)
    keys = [set(key[owner == i].tolist()) for i in range(len(texts))]
    sets = [set(s.value[s.doc == i].tolist()) for i in range(len(texts))]
    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                linked += 1
                assert keys[i] & keys[j]
    assert linked > 5
