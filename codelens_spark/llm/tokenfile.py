"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum per frame.

A file holds the ids of consecutive documents in ascending id order. Layout:

    frame ... frame | index frame | seek table (a skippable frame)

Every document starts a new frame; documents of more than FRAME_IDS ids go on in further frames. The index frame holds
one record per document: id (int64), number of ids (int64), number of its first frame (int64; -1 - number if the id is null). The seek table is that of
the public seekable format: per frame compressed size, decompressed size and checksum (the low 32 bits of xxHash64 of
the decompressed bytes), each 32 bits, then the number of frames, a descriptor byte and a magic number. A reader takes
the tail, the index frame and the frames of the documents it wants, and decompresses nothing else.
Ids are little-endian unsigned 16-bit integers if the vocabulary has at most 65,536 ids, else 32-bit.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import new_path, stage
from .small import staged_small
from .words import text_buffers

VOCABULARY = "word_bpe_49k.json"
END = 1
FRAME_IDS = 1 << 20
LEVEL = 3
CACHE = 800_000  # words
FILE_BYTES = 64 << 20  # text per file
# fixed values of the public seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("ids", "<i8"), ("frame", "<i8")])


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs ...) or a plain path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Writes one file; a document is given as its ids."""

    def __init__(self, path: str, width: int):
        where, name = open_fs(path)
        self.out = where.open_output_stream(name, compression=None)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        first = len(self.frames)
        self.docs.append((doc_id or 0, len(ids), first if doc_id is not None else -1 - first))
        for at in range(0, len(ids), FRAME_IDS):
            self._frame(ids[at: at + FRAME_IDS].astype(self.kind).tobytes())

    def close(self) -> None:
        self._frame(np.array([self.kind.itemsize, len(self.docs)], "<i8").tobytes() + np.array(self.docs, _DOC).tobytes())
        table = np.array(self.frames, _ENTRY).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        where, name = open_fs(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table")
        self.entries = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), _ENTRY)
        self.starts = np.concatenate(([0], np.cumsum(self.entries["packed"].astype(np.int64))))
        self.unpack = zstandard.ZstdDecompressor()
        index = self.frames(count - 1, count)
        width, docs = np.frombuffer(index[:16], "<i8")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.docs = np.frombuffer(index[16:], _DOC, int(docs)).copy()
        self.nameless = self.docs["frame"] < 0
        self.docs["frame"][self.nameless] = -1 - self.docs["frame"][self.nameless]

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frames(self, first: int, end: int) -> bytes:
        """Decompressed bytes of the frames from `first` up to `end`; a damaged frame raises."""
        packed = self._at(int(self.starts[first]), int(self.starts[end] - self.starts[first]))
        out = []
        for k in range(first, end):
            a, b = int(self.starts[k] - self.starts[first]), int(self.starts[k + 1] - self.starts[first])
            raw = self.unpack.decompress(packed[a:b], max_output_size=int(self.entries["raw"][k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["check"][k]:
                raise ValueError(f"frame {k}: checksum differs")
            out.append(raw)
        return b"".join(out)

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document of the file; reads only its frames."""
        first = int(self.docs["frame"][n])
        end = int(self.docs["frame"][n + 1]) if n + 1 < len(self.docs) else len(self.entries) - 1
        return np.frombuffer(self.frames(first, end), self.kind)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def _byte_letters() -> str:
    """The letter that stands for each byte: printable bytes for themselves, the others for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


# fixed values: the vocabulary file's own split pattern, for lower-case ASCII and Latin-1 letters
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_LETTERS = _byte_letters()


class WordEncoder:
    """The tokenizer, with a bounded cache over words.

    Its normalisation and splitting never join anything across ASCII white space, so words between such blanks are
    encoded on their own and the ids strung together. Words of printable ASCII and Latin-1 letters are in normal form;
    they are put in lower case, split by the file's pattern, and their pieces go straight to its merge model. Other
    words, and those that hold the text of a special token, go through the whole tokenizer. The cache has two
    generations: when the younger is full it becomes the older, so frequent words stay.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.special = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.half = max(1, cache // 2)
        self.width = 2 if self.tool.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        # the direct way is right for files of this kind only
        self.direct = self._follows_pattern(path)

    def _follows_pattern(self, path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        split = {"Split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
        normal = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            normal == ["NFC", "Replace", "Lowercase"]
            and [t.get("type") for t in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == split["Split"]
            and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        )

    def _word(self, word: bytes) -> bytes:
        if self.direct and word.isalpha():  # for bytes: ASCII letters alone
            return self._pack([token.id for token in self.model.tokenize(word.lower().decode())])
        text = word.decode()
        if not self.direct or not _SIMPLE.match(text) or any(s in word for s in self.special):
            return self._pack(self.tool.encode(text, add_special_tokens=False).ids)
        ids = []
        for piece in _PIECES.findall(text.lower()):
            if not piece.isascii():
                piece = "".join([_LETTERS[b] for b in piece.encode()])
            ids += [token.id for token in self.model.tokenize(piece)]
        return self._pack(ids)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()  # for bytes: blank, \t, \n, \v, \f, \r
        out = list(map(self.young.get, words))
        if None in out:
            for k in [k for k, found in enumerate(out) if found is None]:
                word = words[k]
                found = self.young.get(word) or self.old.get(word)
                if found is None:
                    found = self._word(word)
                if len(self.young) >= self.half:
                    self.young, self.old = {}, self.young
                self.young[word] = out[k] = found
        return np.frombuffer(b"".join(out), self.kind)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _write(folder: str, path: str | None, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path or public_tokenizers.path(VOCABULARY))
        out, name, docs, total = None, "", 0, 0
        first = None
        for batch in batches:
            if batch.num_rows and out is None:  # a name of its own per attempt: a task that is repeated harms nothing
                name = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                out, first = Writer(name, encode.width), batch.column(1)[0].as_py()
            data, at = text_buffers(batch.column(2))
            ids = batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                tokens = np.append(encode(data[at[k]: at[k + 1]].tobytes()), encode.kind.type(end))
                out.add(ids[k], tokens)
                docs, total = docs + 1, total + len(tokens)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["file", "first_id", "docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> DataFrame:
    """Encode every whole text, append `end`, and write the ids in ascending id order; returns the list of files.

    The list has (file, part, first_id, docs, n_ids), one row per file, in the order of part; only files that it
    names belong to the result, so files of failed attempts are ignored. Null texts are empty (the end id alone).
    Rows with a null id come last; repeated ids stand side by side, ordered by a hash of their text. An empty table writes no file. `folder` must be reachable by all executors (default: the checkpoint folder).
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    where, name = open_fs(folder)
    where.create_dir(name, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    by = F.col("id").asc_nulls_last()
    order = [by, F.xxhash64("text"), F.col("text")]
    ordered = rows.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "text")
    return stage(ordered.mapInArrow(_write_part(folder, path, end), "file string, first_id long, docs long, n_ids long, part int"), "token-files")


def _write_part(folder: str, path: str | None, end: int):
    write = _write(folder, path, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [0]

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part[0] = batch.column(0)[0].as_py()
                yield batch

        for row in write(noted()):
            yield row.append_column("part", pa.array([part[0]], pa.int32()))

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            with Reader(file) as reader:
                for lo in range(0, len(reader.docs), 1024):
                    part = reader.docs[lo: lo + 1024]
                    sums = [zlib.crc32(reader.document(n).astype("<u4")) for n in range(lo, lo + len(part))]
                    n_ids = part["ids"].astype(np.int64)
                    starts = start + np.cumsum(n_ids) - n_ids
                    start += int(n_ids.sum())
                    names = pa.array(part["id"].astype(np.int64), mask=reader.nameless[lo: lo + len(part)])
                    yield pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(n_ids), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the listed files: (id, start, n_tokens, ids_crc32), each file read frame by frame by one task.

    start counts the ids of all documents before; it needs only the per-file totals of the list."""
    before = Window.orderBy("part", "first_id", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    starts = stage(starts, "starts")
    dealt = starts.repartition(max(1, starts.count()), "file")
    return dealt.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def read_documents(spark: SparkSession, files: DataFrame, ids: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of the requested documents: decompresses only their frames."""
    wanted = np.array(sorted(set(ids)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with Reader(file) as reader:
                    for n in np.flatnonzero(np.isin(reader.docs["id"], wanted) & ~reader.nameless).tolist():
                        tokens = pa.array([reader.document(n).astype(np.int32)], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([int(reader.docs["id"][n])], pa.int64()), tokens], names=["id", "ids"])

    return files.select("file").mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents and read the files back; see write_tokens and read_digests."""
    return read_digests(write_tokens(docs, folder, id_col, text_col, path), id_col)
