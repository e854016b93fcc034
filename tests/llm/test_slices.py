"""How much text the near-copy operators take at once."""

import pyarrow as pa

from panelfill.llm import jaccard


def test_shingles_are_taken_from_a_megabyte_at_once(monkeypatch):
    sizes, real = [], jaccard.Shingles

    def taken(texts, size):
        sizes.append(sum(len(x) for x in texts.to_pylist()))
        return real(texts, size)

    monkeypatch.setattr(jaccard, "Shingles", taken)
    texts = [" ".join(f"w{(i * 7 + k) % 5000}" for k in range(200)) for i in range(4000)]  # 4.6 MB
    batch = pa.record_batch([pa.array(range(4000), pa.int64()), pa.array(texts)], ["key", "text"])
    for body in (jaccard._counted(4, 85), jaccard._sketches(4), jaccard._sets(4)):
        assert list(body(iter([batch])))
    dealt = jaccard._dealt(4, 4, lambda s, rows: jaccard.keys_of(s, rows, 85, jaccard.np.zeros(1 << jaccard.COUNTER_BITS, jaccard.np.int64)))
    assert list(dealt(iter([batch])))
    assert max(sizes) <= 1 << 20 and sum(sizes) == 4 * sum(map(len, texts))
    assert sum(len(x) for x in texts) > 1 << 22
