"""SentencePiece merge-type encoding by backtracking, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelfill.llm.text import Chunks, slices, vocabulary_pairs
from panelfill.session import ship

MARK = "▁"
MEMO = 400_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A merge-type SentencePiece model with byte fallback, identity normalisation and a dummy prefix.

    An encoding is the merges' own result exactly if each two neighbours, joined and merged again, come
    apart into the same two. ``encode`` walks a text with the longest piece at each place and goes back to
    shorter ones where neighbours do not agree; places from where no way led on are marked and not tried twice.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if train.model_type != train.BPE or not train.byte_fallback or not plain or train.treat_whitespace_as_suffix:
            raise ValueError("needs a merge-type model with byte fallback, a dummy prefix and no normalisation")
        normal = model.SentencePiece.NORMAL
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == normal}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == normal}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == model.SentencePiece.BYTE}
        if any(MARK in p.strip(MARK) or p[0] != MARK and MARK in p for p in self.ids):
            raise ValueError("a piece holds a gap after another character")
        self.text_of: list[bytes | None] = [None] * len(model.pieces)
        for piece, i in self.ids.items():
            self.text_of[i] = piece.replace(MARK, " ").encode()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.trainer_spec.unk_surface.encode()
        self.unknown_id = model.trainer_spec.unk_id
        self.pairs = vocabulary_pairs([p.replace(MARK, " ") for p in self.ids])
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.names = [p.piece for p in model.pieces]
        self.lengths = list(map(len, self.names))
        self.numbers = dict(self.ids)
        self.agree: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[str, tuple[bytes, int, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first, leftmost among equals, until no two form a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, char: str) -> int:
        """Number of a character that is no piece; such characters are tokens of their own, written as bytes."""
        i = len(self.names)
        self.names.append(char)
        self.lengths.append(1)
        self.numbers[char] = i
        return i

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text gives the same two; ``left`` < 0: whether ``right`` gives itself."""
        if len(self.agree) > 4 * MEMO:
            self.agree.clear()
        pair = [self.names[left], self.names[right]] if left >= 0 else [self.names[right]]
        known = self.agree[left << 32 | right] = self.merged("".join(pair)) == pair
        return known

    def prefix(self, token: int) -> int | None:
        """The longest shorter piece, or else the single character, that begins ``token``."""
        name = self.names[token]
        if len(name) == 1:
            return None
        found = next((self.numbers[name[:n]] for n in range(len(name) - 1, 0, -1) if name[:n] in self.numbers), None)
        if found is None:
            found = self.number(name[0])
        self.shorter[token] = found
        return found

    def tokens(self, text: str) -> list[int]:
        """Numbers of the pieces of ``text`` (gaps as marks)."""
        n = len(text)
        if not n:
            return []
        lengths, numbers, agree, shorter = self.lengths, self.numbers, self.agree, self.shorter
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):
            longest[end - lengths[i] + 1] = i  # matches come by their end, so the last is the longest
        live = bytearray(b"\x01") * (n + 1)  # 0: no encoding leads from here to the end
        out: list[int] = []
        at, left, token = 0, -1, longest[0]
        while True:
            if token < 0:
                char = text[at]
                token = numbers.get(char)
                if token is None:
                    token = self.number(char)
            end = at + lengths[token]
            if live[end]:
                good = agree.get(left << 32 | token)
                if good is None:
                    good = self.compatible(left, token)
                if good:
                    out.append(token)
                    if end == n:
                        return out
                    at, left, token = end, token, longest[end]
                    continue
            token = shorter.get(token) or self.prefix(token)
            if token is None:  # back to the piece before, which now ends at a dead place
                live[at] = 0
                if not out:
                    raise ValueError("no encoding")
                token = out.pop()
                at -= lengths[token]
                left = out[-1] if out else -1

    def encode_chunk(self, chunk: str) -> list[int]:
        count = len(self.text_of)
        found = self.tokens(chunk.replace(" ", MARK))
        if max(found, default=0) < count:
            return found
        ids: list[int] = []
        for token in found:
            ids.extend([token] if token < count else [self.byte_ids[b] for b in self.names[token].encode()])
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The text of ids with its dummy prefix; byte runs that are not UTF-8 become replacement characters."""
        try:
            return b"".join([self.text_of[i] for i in ids])  # plain pieces only
        except TypeError:
            pass
        out, run = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(utf8(run))
                run = bytearray()
            piece = self.text_of[i]
            out.append(piece if piece is not None else self.unknown if i == self.unknown_id else b"")
        if run:
            out.append(utf8(run))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        chunks = Chunks(pa.array([" " + text], pa.large_string()), self.pairs)
        return [i for code in chunks.codes for i in self.encode_chunk(chunks.values[code])]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_bytes(ids).decode()
        head = next((i for i in ids if i in self.byte_of or i == self.unknown_id or self.text_of[i] is not None), self.unknown_id)
        return text[1:] if (self.text_of[head] or b"").startswith(b" ") else text

    def of(self, chunks: list[str]) -> tuple[list[bytes], list[int], list[bytes]]:
        """Of each chunk its decimal ids, each after a comma, their number, and the decoded text."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        found = []
        for chunk in chunks:
            entry = memo.get(chunk)
            if entry is None:
                ids = self.encode_chunk(chunk)
                entry = ("".join([f",{i}" for i in ids]).encode(), len(ids), self.decode_bytes(ids))
                if len(chunk) < 64:
                    memo[chunk] = entry
            found.append(entry)
        return tuple(map(list, zip(*found))) if found else ([], [], [])


def utf8(run: bytes) -> bytes:
    """Bytes as text: each byte that begins no valid character becomes one replacement character."""
    out, at = [], 0
    run = bytes(run)
    while at < len(run):
        size = next((k for k in (1, 2, 3, 4) if _valid(run[at : at + k], k)), 0)
        out.append(run[at : at + size] if size else "�".encode())
        at += size or 1
    return b"".join(out)


def _valid(part: bytes, k: int) -> bool:
    try:
        return len(part) == k and len(part.decode()) == 1
    except UnicodeDecodeError:
        return False


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for table in slices(batches):
            # the dummy prefix, for all but empty texts
            chunks = Chunks(pc.replace_substring_regex(table["text"], "(?s)\\A(.)", " \\1"), model.pairs)
            digits, counts, decoded = model.of(chunks.values)
            ids, a = chunks.joined(digits)
            plain, b = chunks.joined(decoded)
            sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[chunks.codes])]) if len(chunks.codes) else np.zeros(1, np.int64)
            n = np.diff(sums[chunks.first])
            # the first comma and the dummy prefix are left out; an empty text has neither
            ids_sha = [hashlib.sha256(ids[min(i + 1, j) : j]).hexdigest() for i, j in zip(a, a[1:])]
            text_sha = [hashlib.sha256(plain[min(i + 1, j) : j]).hexdigest() for i, j in zip(b, b[1:])]
            yield pa.record_batch([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of the whole text.

    Texts are cut before gaps, which no piece crosses; distinct chunks of a batch are encoded once. No shuffle:
    every row is its task's own. Null text counts as empty and gives no ids. Repeated rows give repeated rows,
    an empty table an empty one; further columns are ignored.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encoded(path), RESULT)
