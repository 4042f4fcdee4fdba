"""Token-id files with Elias-Fano document boundaries.

A file is a folder of blocks. A block holds the ids of some documents one after another (two bytes each while
the vocabulary allows it) and, Elias-Fano encoded, where each document begins and which doc_id it has. An
Elias-Fano list of n ascending numbers below u takes about n * (2 + log2(u / n)) bits. Its select structure, the
place of every 64th set bit, finds any entry in a bounded number of steps, so no table of 64-bit offsets is kept:
an offset in the corpus is the base of the part, plus that of the block in its part, plus a selected entry.

Blocks are binary values in Parquet files that Spark writes and commits, so they can lie in any store that Spark
writes to, and a lost executor costs its tasks only. A part is one range of doc_ids; parts, blocks and documents
ascend by doc_id, null ids first; rows with equal ids follow each other.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketspark.llm.common import shared_folder

BLOCK_IDS = 1 << 20
END_ID = 0
SELECT_STEP = 64
BLOCK_SCHEMA = "part int, block int, part_offset long, n_docs long, n_ids long, data binary"


class EliasFano:
    """An ascending list of non-negative numbers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, places: bytes):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        upper = int(values[-1]) + 1
        low_bits = max(0, (upper // n).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, low_bits, np.packbits(lows.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SELECT_STEP].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        chunk = int.from_bytes(self.low[bit // 8 : (bit + self.low_bits + 7) // 8], "little")
        return chunk >> bit % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Entry i: from the nearest noted set bit on, words of the upper bits are skipped by their counts."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = struct.unpack_from("<I", self.places, i // SELECT_STEP * 4)[0]
        left, at = i % SELECT_STEP, place // 8
        word = self.high[at] >> place % 8 << place % 8
        while word.bit_count() <= left:
            left -= word.bit_count()
            at += 1
            word = self.high[at]
        for _ in range(left):
            word &= word - 1
        one = at * 8 + (word & -word).bit_length() - 1
        return one - i << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All entries at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        lows = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return (ones - np.arange(self.n) << self.low_bits) + lows

    def to_bytes(self) -> bytes:
        return struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.places)) + self.low + self.high + self.places

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", data, at)
        at += struct.calcsize("<IBIII")
        ends = at + a, at + a + b, at + a + b + c
        return cls(n, low_bits, bytes(data[at : ends[0]]), bytes(data[ends[0] : ends[1]]), bytes(data[ends[1] : ends[2]])), ends[2]


class Block:
    """One block: boundaries, doc_ids and ids. `document(i)` reads one document by select, without the others."""

    MAGIC = b"EFB1"

    def __init__(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray):
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        self.nulls, self.first = len(doc_ids) - len(known), int(known[0]) if len(known) else 0
        self.bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
        self.names = EliasFano.of((known - self.first).view(np.uint64))
        self.ids = ids

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sBIq", self.MAGIC, self.ids.itemsize, self.nulls, self.first)
        return head + self.bounds.to_bytes() + self.names.to_bytes() + self.ids.tobytes()

    @classmethod
    def read(cls, data: bytes) -> Block:
        block, view = cls.__new__(cls), memoryview(data)
        magic, width, block.nulls, block.first = struct.unpack_from("<4sBIq", view)
        if magic != cls.MAGIC:
            raise ValueError("not a token block")
        block.bounds, at = EliasFano.read(view, struct.calcsize("<4sBIq"))
        block.names, at = EliasFano.read(view, at)
        block.ids = np.frombuffer(view[at:], f"<u{width}")
        return block

    def __len__(self) -> int:
        return self.bounds.n - 1

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) + self.first for x in self.names.all()]


# The pieces that a byte-level BPE splits a text into before its merges, as the tokenizers library does,
# with the letters, numbers and white space of Latin-1 spelled out.
_LETTERS, _NUMBERS, _GAPS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_GAPS}{_LETTERS}{_NUMBERS}]+|[{_GAPS}]+(?![^{_GAPS}])|[{_GAPS}]+")


def _byte_characters() -> dict[int, str]:
    """Characters that a byte-level vocabulary writes bytes as: printable ones as they are, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()


LONGEST = 40  # characters of a piece that is remembered beyond the texts at hand


class Encoder:
    """Ids of whole texts by the tokenizers library, of a byte-level BPE vocabulary.

    Merges never cross the pieces of a text, so each distinct piece is encoded once and remembered (a bounded number of
    them, of at most LONGEST characters, so that their bytes are bounded too). Texts beyond Latin-1 are encoded in one go by the library, whose classes of letters decide there, and so are
    texts that hold the name of an added token, which the library gives that token's id.
    """

    def __init__(self, path: str, end_id: int, remembered: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.model = Tokenizer.from_file(path)
        names = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.width = np.uint16 if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        self.code, self.bpe = "H" if self.width is np.uint16 else "I", self.model.model
        self.by_piece = isinstance(self.bpe, BPE) and str(self.model.pre_tokenizer) == _BYTE_LEVEL and self.model.normalizer is None
        self.end = np.array([end_id], self.width).tobytes()
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.width).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.bpe.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS))]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        latin = [self.by_piece and _latin(t) and not (self.added and self.added.search(t)) for t in texts]
        pieces = [_PIECES.findall(t) if ok else None for t, ok in zip(texts, latin)]
        known = self.known
        new = list({p for found in pieces if found for p in found if p not in known})
        known.update(zip(new, map(self._piece, new)))
        whole = iter(self._plain([t for t, ok in zip(texts, latin) if not ok]))
        coded = [next(whole) if found is None else b"".join(map(known.__getitem__, found)) for found in pieces]
        full = len(known) > self.remembered  # the first ones seen are the frequent ones; those of these texts go
        for piece in new:
            if full or len(piece) > LONGEST:
                del known[piece]
        return [np.frombuffer(x + self.end, self.width) for x in coded]


_BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=1)
def _known_encoder(path: str, end_id: int) -> Encoder:
    """Of a Python worker, which serves many tasks: the vocabulary is read and the pieces are learnt once."""
    return Encoder(path, end_id)


def _encoder(tokenizer: str, block_ids: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _known_encoder(tokenizer, end_id)
        part, block, offset, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, offset, held, docs, lengths, parts
            ids = np.concatenate(parts)
            row = [part, block, offset, len(docs), len(ids), Block(docs, lengths, ids).to_bytes()]
            block, offset, held, docs, lengths, parts = block + 1, offset + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names), 256):  # some documents at a time bound the memory
                some = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for name, ids in zip(names[at : at + 256], encoder.encode(some)):
                    docs.append(name)
                    lengths.append(len(ids))
                    parts.append(ids)
                    held += len(ids)
                    if held >= block_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> None:
    """Encodes the whole text of every row of documents (doc_id, text) and writes the token file to `path`.

    A null text is empty and holds the end id alone; an empty table gives an empty file. Rows with equal ids are
    ordered by a hash of their text. `tokenizer` is a path that every executor has.
    """
    # One shuffle: texts by ranges of doc_id; ids are made where they are written.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(_encoder(tokenizer, block_ids, end_id), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file with `start`, the number of ids before each.

    A part has one row in the table of bases, and parts are as many as tasks that wrote (at most
    spark.sql.shuffle.partitions), which bounds both the window and the broadcast.
    """
    found = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("part_offset"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            block = Block.read(data.as_py())
            bounds = block.bounds.all()
            wide = block.ids.astype("<u4")
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids(), pa.int64()), pa.array(bounds[:-1] + start), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers) of every document of a file."""
    return blocks(spark, path).select("start", "data").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            block = Block.read(data.as_py())
            bounds = block.bounds.all()
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(block.ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids(), pa.int64()), values], ["doc_id", "ids"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of every document of a file."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path).select("data").mapInArrow(_ids, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a token file to the shared folder and returns what reading it back gives for every document."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return offsets(spark, path)
