"""Byte-level BPE encoding and decoding by a sentencepiece model built from ranks.

The model is serialised here, field by field, from a rank file: every byte of a
token becomes one printable character, a piece's score is its negative rank, and
the normaliser is the identity. Encoding splits a text into pre-tokens and gives
each to the model; decoding maps ids back to their bytes.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pre-tokens remembered by a task; longer ones and further ones are encoded anew.
REMEMBERED = 400_000
REMEMBERED_LENGTH = 64


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank) in rank order; ranks are 0 to n - 1."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(number: int) -> bytes:
    number &= (1 << 64) - 1
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece ``i`` is ``tokens[i]``, and an unknown piece after them."""
    letters = byte_letters()
    # Piece types, model type and field numbers of sentencepiece_model.proto.
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        body = _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, normal)
        out += _block(1, body)
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43))
    normaliser = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return bytes(out) + _block(2, trainer) + _block(3, normaliser)


class _Encoder(dict):
    """Pre-token to its ids, as little-endian 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.tokens = tokens
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.letters = dict(enumerate(byte_letters()))
        self.split = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        ids = self.model.encode(mapped, out_type=int)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = memoryview(packed).cast("I") if len(packed) else ()
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def encoder(path: str, pattern: str) -> _Encoder:
    """One encoder per worker process."""
    return _Encoder(path, pattern)


def _mapped(docs: DataFrame, path: str, pattern: str, keep, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows = [keep(bpe, text.as_py() or "") for text in batch.column(1)]
            columns = [pa.array(c) for c in zip(*rows)] or [pa.array([])] * (len(names) - 1)
            arrays = [batch.column(0), *columns]
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` per row: the token ids as 32-bit little-endian bytes and
    the text that they decode to.

    ``path`` is a rank file every executor can read, ``pattern`` splits texts into
    pre-tokens. A null text counts as empty (no ids); repeated rows and null ids
    are kept; other columns are not read; an empty table gives no rows.
    """

    def keep(bpe, text):
        ids = bpe.encode(text)
        return ids, bpe.decode(ids).decode()

    return _mapped(docs, path, pattern, keep, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, as :func:`encode` treats it."""

    def keep(bpe, text):
        ids = bpe.encode(text)
        decoded = bpe.decode(ids)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, pattern, keep, schema)
