"""Hard negatives against a plain search."""

import math
import random

import numpy as np

from panelfill.llm import negatives

INT = (1 << 63) - 1


def _wanted(rows):
    rows = sorted({(v, (x + 1) % 10 if v is not None and v % 7 == 0 else x, tuple(math.floor(256 * float(c)) for c in e)) for v, x, e in rows if x is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)}, key=repr)
    out = []
    for anchor in rows:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(max(-INT, min(INT, sum(a * b for a, b in zip(anchor[2], r[2])))), r) for r in rows if r != anchor]
        scored.sort(key=lambda x: (-x[0], x[1][0] is None, x[1][0] or 0))
        for p, positive in [x for x in scored if x[1][1] == anchor[1]][:5]:
            fits = [x for x in scored if x[1][1] != anchor[1] and 80 * p <= 100 * x[0] <= 100 * p][:5]
            out += [(anchor[0], positive[0], rank, r[0], p, n) for rank, (n, r) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def _table(spark, rows, parts=4, kind="float"):
    schema = f"vec_id long, label int, embedding array<{kind}>, q string, block long, pack string"
    return spark.createDataFrame([(v, x, e, "q", 5, "p") for v, x, e in rows], schema).repartition(parts)


def _near(r, center, spread):
    return [float(np.float32(c + r.gauss(0, spread))) for c in center]


def test_hard_negatives_like_a_plain_search(spark):
    r = random.Random(1)
    centers = [[r.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = [(i, r.randrange(3), _near(r, r.choice(centers), 0.05)) for i in range(1400)]
    hot = rows[0][2]
    rows += [(2000 + i, r.randrange(3), hot) for i in range(700)]  # a third of all rows, and ties
    rows += [(100, 1, hot), (100, 1, hot), (100, 2, rows[5][2]), (None, 1, hot), (None, 0, hot), (700, None, hot), (800, 1, None), (900, 1, [0.1, None]), (901, 1, [float("nan")] * 6), (902, 2, [float("inf")] * 6)]
    rows += [(3000, 1, []), (3100, 2, [0.5] * 3), (3101, 1, [0.25] * 9), (-200, 1, hot), (4000, 9, hot), (4200, 1, [-c for c in hot])]
    want = _wanted(rows)
    got = negatives.hard_negatives(_table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 200
    small = negatives.hard_negatives(_table(spark, rows, 7), block_rows=100, pack=2)
    assert sorted(map(tuple, small.collect()), key=repr) == want


def test_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(i * 20, i % 2, [r.uniform(-1, 1) * 10 ** r.choice([0, 3, 9, 30]) for _ in range(3)]) for i in range(60)]
    rows += [(5000 + i, i % 3, [r.uniform(50, 60), r.uniform(50, 120), 3.0]) for i in range(100)]
    got = negatives.hard_negatives(_table(spark, rows, kind="double"))
    assert sorted(map(tuple, got.collect()), key=repr) == _wanted(rows)


def test_no_rows_no_anchors_no_negatives(spark):
    assert negatives.hard_negatives(_table(spark, []).limit(0)).count() == 0
    assert negatives.hard_negatives(_table(spark, [(1, 1, [1.0]), (2, 2, [1.0])])).count() == 0
    assert negatives.hard_negatives(_table(spark, [(100, 1, [1.0]), (200, 1, [1.0])])).count() == 0


def test_lower_limits():
    p = np.array([0, 1, 4, 5, 99, 100, 101, 12345, INT - 7])
    assert negatives.lowest(p, 80).tolist() == [-(-80 * x // 100) for x in p.tolist()]
