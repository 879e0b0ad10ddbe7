"""Byte-level BPE through a sentencepiece model that is serialised from the rank file itself.

The rank file lists byte strings by merge rank. Each becomes one piece of a sentencepiece BPE model:
its bytes are mapped one to one to characters, its score is the negative rank, and the normaliser is
the identity, so that sentencepiece merges the same neighbours in the same order as the ranks ask.
Texts are cut into pre-tokens, each pre-token is encoded on its own, and ids are decoded through the
inverse map.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Byte b is the character of this code point plus b: no blank, control or word-boundary sign is among them.
FIRST_CHAR = 0x100
#: Pre-tokens whose ids a task remembers at most.
MEMORY = 200_000

_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def to_chars(data: bytes) -> str:
    return "".join([chr(FIRST_CHAR + b) for b in data])


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The model file's bytes, and the rank of each of its piece ids (-1: the unknown piece)."""
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [_block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, _UNKNOWN)]
    pieces += [_block(1, to_chars(t).encode()) + b"\x15" + struct.pack("<f", -float(ranks[t])) + _number(3, _NORMAL) for t in order]
    # trainer: model type, vocabulary size, no byte fallback, ids of the control pieces
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(35, 0) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    # normaliser: identity, without dummy prefix, blank removal or blank escape
    identity = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    model = b"".join(_block(1, p) for p in pieces) + _block(2, trainer) + _block(3, identity)
    return model, np.array([-1, *(ranks[t] for t in order)])


class Codec:
    """encode and decode for one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        model, self.rank_of = serialise(ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = regex.compile(pattern)
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.memory: dict[str, bytes] = {}

    def _packed(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)  # a pre-token that is in the vocabulary is its own id
        ids = [whole] if whole is not None else self.rank_of[self.model.encode(to_chars(data))]
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of text, as little-endian unsigned 32-bit integers."""
        memory, parts = self.memory, self.pieces.findall(text)
        fresh = set(parts).difference(memory)
        if len(memory) + len(fresh) > MEMORY:
            memory.clear()
            fresh = set(parts)
        for piece in fresh:
            memory[piece] = self._packed(piece)
        return b"".join(map(memory.__getitem__, parts))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<long>) for each row of docs (doc_id, text).

    Null and empty texts have no ids; long texts are encoded whole; equal rows give equal rows; an empty
    table gives none; other columns of docs are not read.
    """
    def make():
        c = codec(path, pattern)
        return lambda ids, texts: (ids, [np.frombuffer(c.encode(t), "<u4").tolist() for t in texts])

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, ids array<long>", make)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) for each row of encoded (doc_id, ids); bytes that are not UTF-8 become U+FFFD. Null and
    empty lists give empty texts; an empty table gives no rows; other columns are not read."""
    def make():
        c = codec(path, pattern)
        return lambda ids, lists: (ids, [c.decode(np.asarray(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in lists])

    return map_columns(encoded.select(F.col("doc_id").cast("long"), "ids"), "doc_id long, text string", make)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each row of docs (doc_id, text): (doc_id, n_tokens, ids_sha256,
    decoded_sha256, lossless). A null text counts as empty: no ids, both digests those of no bytes. Long
    texts are encoded whole; repeated rows give repeated rows; an empty table gives none; other
    columns are not read."""
    def make():
        c = codec(path, pattern)

        def run(ids: list, texts: list) -> tuple:
            out: tuple[list, ...] = ([], [], [], [])
            for text in texts:
                packed = c.encode(text)
                back = c.decode(packed)
                for column, value in zip(out, (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())):
                    column.append(value)
            return (ids, *out)

        return run

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), schema, make)
