"""Best-fit packing of documents into sequences, planned over counts of lengths.

A document's ids and the end id form one piece; a longer document is cut into pieces of the sequence size, the first
of which may be shorter. How many pieces there are of each length is all that planning needs: longest lengths first,
every length goes to the open sequences with the least room that holds it, as many per sequence as fit, and to new
sequences when none is left. This is best-fit over falling lengths, but a step places all pieces of a length in all
sequences of equal room at once, so that a plan is a short list of runs: ranks [first, first + rows) of a length go to
sequences from `sequence` on, `per` in each, from `offset` on.

A step splits at most three groups of sequences off and leaves less than half of the room it used, so a plan has at most
3 * log2(size) runs per length, whatever the number of documents. Only the histogram (a row per length) and the plan
pass the driver.

Pieces then take the planned slots by their rank within their length. Ranks are row numbers inside buckets of a few
thousand pieces, plus the number of pieces in the buckets before, so that a length that very many documents share is
spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marketspark.llm.common import settled
from marketspark.llm.token_file import Encoder

SIZE = 1024
END_ID = 2
RANKS_PER_TASK = 4096
_CHARS_AT_ONCE = 1 << 21
_REMEMBERED = 300_000
_RANK_BITS = 40  # pieces of one length
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_SLOTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_places(n: int, size: int) -> list[int]:
    """Where the pieces of n ids begin, and n."""
    return [0, *range(n - (n - 1) // size * size, n, size), n] if n > size else [0, n]


@lru_cache(maxsize=1)
def _known_encoder(tokenizer: str, end_id: int) -> Encoder:
    return Encoder(tokenizer, end_id, _REMEMBERED)


def _some(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some millions of characters each, at least a row."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= _CHARS_AT_ONCE or i - first >= 255:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _cut(tokenizer: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _known_encoder(tokenizer, end_id)
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _some(texts):
                rows, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
                for i, found in enumerate(encoder.encode(texts[a:b]), a):
                    wide, places = found.astype("<u4"), cut_places(len(found), size)
                    for piece, (start, end) in enumerate(zip(places, places[1:])):
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(end - start)
                        sums.append(zlib.crc32(wide[start:end]))
                        if with_ids:
                            ids.append(wide[start:end].astype(np.int32))
                columns = [names.take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())]
                labels = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    labels.append("ids")
                yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of documents (doc_id, text), written once, with a number `row` that tells them apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_cut(tokenizer, size, end_id, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
    return settled(found.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")


def histogram(rows: DataFrame) -> dict[int, int]:
    """Number of pieces of each length; at most as many lengths as a sequence has tokens."""
    return {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def plan(counts: Mapping[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, rows, per sequence, first sequence, offset) of the best fit over falling lengths."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # rising, those of open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    least, made = min(counts, default=1), 0

    def leave(room: int, sequence: int, n: int) -> None:
        if room >= least:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, sequence, n = size, made, -(-left // (size // length))
                made += n
            per = room // length
            full, over = min(n, left // per), 0
            if full:
                runs.append((length, rank, full * per, per, sequence, size - room))
                leave(room - per * length, sequence, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer than a sequence takes
                runs.append((length, rank, left, left, sequence + full, size - room))
                leave(room - left * length, sequence + full, 1)
                rank, left, over = rank + left, 0, 1
            if full + over < n:
                leave(room, sequence + full + over, n - full - over)
    return runs


def ranked(rows: DataFrame, counts: Mapping[int, int], per_task: int = RANKS_PER_TASK) -> DataFrame:
    """Pieces with `rank`, from 0 on within their length. `counts` is the histogram; rows are told apart by `row`."""
    many = rows.sparkSession.createDataFrame([(k, -(-n // per_task)) for k, n in counts.items()], "length int, buckets long")
    dealt = rows.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    numbered = dealt.withColumn("in_bucket", F.row_number().over(inside))
    return numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("in_bucket") - 1).drop("bucket", "in_bucket", "base")


def _slots(shipped):
    """Rows (..., length, ..., rank) with the sequence and the place in it that the plan has for their rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, per, sequence, offset = shipped.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, (length << _RANK_BITS) + rank, "right") - 1
            inside = rank - first[at]
            where, place = sequence[at] + inside // per[at], offset[at] + inside % per[at] * length
            columns = [batch.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length), batch.column("ids_crc32"), pa.array(where), pa.array(place)]
            labels = [c.split()[0] for c in _SLOTS.split(", ")]
            if "row" in batch.schema.names:
                columns.append(batch.column("row"))
                labels.append("row")
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def placed(rows: DataFrame, size: int = SIZE, keep_row: bool = False) -> DataFrame:
    """The slot of every piece: sequence_id and offset next to what identifies it."""
    counts = histogram(rows)
    runs = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 6)
    length, first, _, per, sequence, offset = runs.T
    shipped = rows.sparkSession.sparkContext.broadcast(((length << _RANK_BITS) + first, first, per, sequence, offset))
    found = ranked(rows.select("doc_id", "piece", "start", "length", "ids_crc32", "row"), counts)
    return (found if keep_row else found.drop("row")).mapInArrow(_slots(shipped), _SLOTS + (", row long" if keep_row else ""))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of documents (doc_id, text).

    Null and empty texts give one piece, the end id alone. Repeated rows are packed each for itself, null ids as well.
    Other columns are not read. An empty table gives no rows. Sequence ids run from 0 on without gaps, and the pieces of
    a sequence fill it from offset 0 on without gaps. `tokenizer` is a path that every executor has.
    """
    return placed(pieces(docs, tokenizer, size, end_id), size)


def sequences(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most `size`), and the doc_id, start, offset and length of each piece in order.

    A sequence is gathered from at most `size` pieces, which bounds every row. Odd rows as in pack().
    """
    rows = pieces(docs, tokenizer, size, end_id, with_ids=True)
    slots = placed(rows, size, keep_row=True).join(rows.select("row", "ids"), "row")
    piece = F.struct("offset", "doc_id", "start", "length", "ids")
    gathered = slots.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    parts = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in ("doc_id", "start", "offset", "length")]))
    return gathered.select("sequence_id", F.flatten(F.col("pieces.ids")).alias("ids"), parts.alias("pieces"))
