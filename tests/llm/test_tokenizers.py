"""Piece encoding against the library, and packing against the tokenizer's own ids."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelfill.llm import packing, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  a  b", "a\nb\tc", "é漢\x00x", " ⁇ <s> </s> <unk> <0x41>", "▁a ▁", "x▁ y ▁ ▁▁  z", "aaaa" * 300, "　  x   y", "日本語 です", "🙂🙂 x", "word, word. WORD",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts_encode_and_decode_like_the_library(library):
    model, r = pieces.PieceModel(MODEL), random.Random(1)
    parts = ["a", "b", "the", "in", " ", "  ", "\n", "é", "▁", "漢", "20", "ing ", "th", "🙂", "\x00", ".", ", "]
    for text in ODD[1:] + ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(500)]:
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids), text


def test_any_ids_decode_like_the_library(library):
    model, r = pieces.PieceModel(MODEL), random.Random(2)
    for _ in range(500):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), r.randrange(3)]) for _ in range(8)]
        assert model.decode(ids) == library.decode(ids), ids


def test_query_gives_the_library_digests(spark, table, library):
    rows = list(enumerate(ODD)) + [(5, ODD[5])]
    got = sorted(map(tuple, pieces.encode_documents(table(rows), MODEL).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows]
    assert got == sorted(want)
    assert pieces.encode_documents(table([]), MODEL).count() == 0


def test_encoding_of_null_and_repeated_ids_and_clashing_names(spark, library):
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, "one"), (3, "two"), (4, "long text " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, ids_sha256 string, n_tokens int, ids string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in rows]
    assert sorted(map(tuple, pieces.encode_documents(docs, MODEL).collect()), key=repr) == sorted(want, key=repr)


def test_pieces_hold_the_tokenizer_ids_and_fill_sequences(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json")]
    special = "<|endoftext|>"
    specials = [special, special + " x", f"a{special}{special} b\n{special}", f"  {special}  ", special[:-1], f"é {special}é", f"x{special}" * 2000]
    r = random.Random(3)
    rows = list(enumerate(ODD)) + list(enumerate(specials, 50)) + [(100 + i, " ".join(r.choice(["alpha", "béta", "x1", "\n", "  gamma"]) for _ in range(r.randrange(1500)))) for i in range(60)]
    got = packing.pack(table(rows), *files).collect()
    text = dict(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    assert set(by_doc) == set(text)
    for doc, own in by_doc.items():
        ids = tokenizer.encode(text[doc] or "", add_special_tokens=False).ids + [2]
        own.sort(key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own))) and sum(x.length for x in own) == len(ids)
        assert all(x.length == 1024 for x in own[1:])
        for x in own:
            assert x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.05 * -(-sum(x.length for x in got) // 1024) + 1
    assert packing.pack(table([]), *files).count() == 0


def test_packing_like_a_plain_search():
    """Each piece into the open bin with the least room that suffices, the newest of equal ones; the fullest closes first."""
    r = random.Random(4)
    for limit in (1, 3, 40):
        bins, free, count = packing.Bins(50, limit), [], 0  # (room, order of being put there, number)
        for step in range(3000):
            length = r.choice([r.randrange(1, 51), r.randrange(1, 20), 50])
            fits = [x for x in free if x[0] >= length]
            if fits:
                room = min(x[0] for x in fits)
                best = max(x for x in fits if x[0] == room)
                free.remove(best)
            else:
                best, count = (50, step, count), count + 1
                if length < 50 and len(free) == limit:
                    room = min(x[0] for x in free)
                    free.remove(max(x for x in free if x[0] == room))
            if best[0] > length:
                free.append((best[0] - length, step, best[2]))
            assert bins.put(length) == (best[2], 50 - best[0])


def test_packing_null_and_repeated_ids(spark, table):
    files = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json")]
    rows = [(None, "a"), (None, "b c"), (None, None), (7, "x " * 3000), (7, "y"), (7, "y")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, lane int, piece int, length int")
    got = packing.pack(docs, *files).collect()
    assert sum(x.doc_id is None for x in got) == 3 and sum(x.length == 2 and x.doc_id == 7 for x in got) == 2
    assert sorted(x.piece for x in got if x.doc_id == 7 and x.length > 2) == [0, 1, 2]


def test_the_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 5, 4, 3, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5), (3, 0)]
