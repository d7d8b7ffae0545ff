"""Byte-level BPE encoding and decoding with a sentencepiece model written straight from the merge ranks.

The rank file is turned into a sentencepiece BPE model: one piece per token, its bytes written as one printable
character each, score = -rank, identity normalisation. sentencepiece merges the pair with the best score, leftmost
first, which is the lowest rank first. Texts are split into pre-tokens, each pre-token is encoded on its own (through a
bounded cache), and ids are decoded by the inverse mapping from id to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
CACHE = 150_000  # chunks a worker keeps, and half as many pre-tokens; later ones are encoded anew
WORD = 32  # characters of the longest chunk or pre-token that is kept
PIECE = 1 << 20  # characters split at a time


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable and not blank, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must count from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one rank file, for one worker process."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.split = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.limit = cache
        space = regex.compile(r"\s")
        self.blank = functools.lru_cache(4096)(lambda c: c.isspace() or bool(space.match(c)))
        self.decimal = [str(i) for i in range(len(self.ranks) + 1)]
        by_id = sorted(self.ranks, key=self.ranks.__getitem__)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def entries(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as 32-bit integers."""
        out = list(map(self.cache.get, tokens))
        if None in out:
            new = list({t for t, known in zip(tokens, out) if known is None})
            made = dict(zip(new, self._learn(new)))
            out = [made[t] if known is None else known for t, known in zip(tokens, out)]
        return out

    def _learn(self, tokens: list[str]) -> list[bytes]:
        raws = [t.encode("utf-8", "surrogatepass") for t in tokens]
        ids = [(self.ranks[r],) if r in self.ranks else None for r in raws]
        hard = [i for i, known in enumerate(ids) if known is None]
        letters = self._letters()
        for i, found in zip(hard, self.model.encode([raws[i].decode("latin-1").translate(letters) for i in hard], num_threads=1) if hard else ()):
            ids[i] = found
        made = [np.array(x, np.int32).tobytes() for x in ids]
        self._keep(self.cache, zip(tokens, made), self.limit // 2)
        return made

    @staticmethod
    def _keep(known: dict[str, bytes], made: Iterable[tuple[str, bytes]], limit: int) -> None:
        """Adds short entries while there is room: what a worker keeps stays small, whatever the texts."""
        known.update(islice((x for x in made if len(x[0]) <= WORD), max(0, limit - len(known))))

    @functools.cache
    def _letters(self) -> dict[int, str]:
        return dict(enumerate(self.letters))

    def by_pattern(self, text: str) -> list[bytes]:
        """Entries of the pre-tokens of a text."""
        return self.entries(self.split.findall(text))

    def _split_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Entries of chunks, each with one blank before it."""
        tokens = [self.split.findall(" " + c) for c in chunks]
        flat = self.entries([t for own in tokens for t in own])
        made, at = {}, 0
        for chunk, own in zip(chunks, tokens):
            made[chunk] = b"".join(flat[at: at + len(own)])
            at += len(own)
        self._keep(self.chunks, made.items(), self.limit)
        return made

    def _piece(self, text: str) -> list[bytes]:
        """Entries of a text. A blank between characters that are no white space always begins a pre-token, so the
        chunks between such blanks are split on their own and cached whole; any other text is split by the pattern."""
        head, *chunks = text.split(" ")
        if head and self.blank(head[-1]):
            return self.by_pattern(text)
        out = list(map(self.chunks.get, chunks))
        if None in out:
            new = list({c for c, known in zip(chunks, out) if known is None})
            if any(not c or self.blank(c[0]) or self.blank(c[-1]) for c in new):
                return self.by_pattern(text)
            made = self._split_chunks(new)
            out = [made[c] if known is None else known for c, known in zip(chunks, out)]
        return self.by_pattern(head) + out if head else out

    def encode(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """Ids of a text, in decimal, joined by blanks, and as 32-bit integers; long texts are cut at blanks inside them."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            while 0 < end < len(text) - 1 and (self.blank(text[end - 1]) or self.blank(text[end + 1])):
                end = text.find(" ", end + 1)
            end = end if 0 < end < len(text) - 1 else len(text)
            raw = b"".join(self._piece(text[at:end]))
            yield [(" ".join(map(self.decimal.__getitem__, np.frombuffer(raw, np.int32).tolist())), raw)]
            at = end

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        length = self.lengths[ids]
        ends = np.cumsum(length)
        shift = np.repeat(self.starts[ids] - (ends - length), length)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _digests(path: str | None, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path or public_tokenizers.path(RANKS), pattern)
        for batch in batches:
            counts, ids_hex, decoded_hex = [], [], []
            for text in batch.column(1):
                seen, ids_sum, bytes_sum = 0, hashlib.sha256(), hashlib.sha256()
                for pieces in tool.encode(text.as_py() or ""):
                    ids = np.frombuffer(b"".join([p[1] for p in pieces]), np.int32)
                    if len(ids):
                        ids_sum.update(((" " if seen else "") + " ".join([p[0] for p in pieces])).encode())
                        bytes_sum.update(tool.decode(ids))
                        seen += len(ids)
                counts.append(seen)
                ids_hex.append(ids_sum.hexdigest())
                decoded_hex.append(bytes_sum.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], names=["id", "n", "a", "b"])

    return run


def _ids(path: str | None, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path or public_tokenizers.path(RANKS), pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = b"".join([p[1] for pieces in tool.encode(batch.column(1)[k].as_py() or "") for p in pieces])
                ids = pa.ListArray.from_arrays(pa.array([0, len(raw) // 4], pa.int32()), pa.array(np.frombuffer(raw, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), ids], names=["id", "ids"])

    return run


def _texts(path: str | None, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path or public_tokenizers.path(RANKS), pattern)
        for batch in batches:
            raw = [None if v is None else tool.decode(np.array(v, np.int64)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids array<int>) per row. A null text counts as empty and has no ids; null and repeated ids are kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_ids(path, pattern), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, raw binary) per row: the bytes of the ids. Null ids give null."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_texts(path, pattern), f"id {rows.schema['id'].dataType.simpleString()}, raw binary").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: (id, n_tokens long, ids_sha256 string, decoded_sha256 string), encoding and decoding whole texts.

    ids_sha256 is over the decimal ids joined by one blank, decoded_sha256 over the decoded bytes. A null text counts as
    empty. Null and repeated ids are kept, other columns are not read, an empty table gives an empty table.
    `path` names a rank file that exists on every executor; without it the installed vocabulary is used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_digests(path, pattern), schema).withColumnRenamed("id", id_col)
