"""Ranked lexical search of benchmark items in all documents, with deduplication of bags.

What a document scores for any item depends only on how often it holds each term of the items' vocabulary and on its
length class m. So documents are restricted to that vocabulary, and those with the same bag (terms, counts) and the
same m form a class: rows are dealt by a hash of these and compared in full, so that texts with equal hashes do not
mix. A class is scored once against all items, and only classes that reach an item's list are expanded to members, by
ascending doc_id. Copies, and the many texts that differ only in words no item has, cost one score.

Of a class no more than k members can enter a list of k, those of lowest doc_id; a row-number filter keeps them, before
the shuffle as well, so a class of any size is cheap. A task keeps the k best classes of each item and hands on no more,
which is exact: classes are ordered by falling score and rising first member, and each has a member.

Scores are whole numbers. A task adds them up per block of classes from the items that hold each term (the postings),
so a class meets only items that share a term with it.

The items are a query set: their terms go to all tasks in blocks of a bounded number of terms, one pass over the
documents for each block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import LOWER, UPPER, settled

TOP = 20
# Terms of items (with repeats) that go to the tasks at once: some 100 bytes each.
TERMS_PER_BLOCK = 1_000_000
# Fixed value: ASCII letters and digits, and everything beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans(UPPER, LOWER)
_CELLS = 1 << 20  # scores of (class, item) that a task holds at once
_EXACT = float(1 << 52)


def terms(text: str | None) -> list[str]:
    """All terms of a text in order."""
    return TERM.findall(text.lower() if text.isascii() else text.translate(_FOLD)) if text else []


def _bags(shipped):
    """Documents (doc_id, text) with at least one term: their number of terms, and the counted terms of the vocabulary by rising number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.get
        for batch in batches:
            rows, sizes, held, times = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    counted = Counter(map(number, found))
                    counted.pop(None, None)
                    bag = sorted(counted.items())
                    rows.append(i)
                    sizes.append(len(found))
                    held.append([t for t, _ in bag])
                    times.append([n for _, n in bag])
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "times"])

    return run


def bags(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n (all terms), terms and times of every document with a term, written once."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bags(shipped), "doc_id long, n long, terms array<int>, times array<int>")
    return settled(rows, "lexical-bags", compression="zstd")


def classes(rows: DataFrame, documents: int, all_terms: int, k: int = TOP) -> DataFrame:
    """m, terms, times and members (up to k lowest doc_ids, null last) of every class of documents that hold a term of the items."""
    m = F.expr(f"75 + (CAST(n AS DECIMAL(19,0)) * CAST('{25 * documents}' AS DECIMAL(19,0))) div CAST('{all_terms}' AS DECIMAL(19,0))").alias("m")
    known = rows.where(F.size("terms") > 0).select("doc_id", m, "terms", "times")
    known = known.withColumn("hash", F.xxhash64("m", "terms", "times"))
    same = ["hash", "m", "terms", "times"]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
    first = known.withColumn("place", place).where(F.col("place") <= k)
    # Lists leave nulls out and structs do not.
    ids = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    return first.groupBy(*same).agg(ids["doc_id"].alias("members")).select("m", "terms", "times", "members")


class Postings:
    """Which items hold a term, and how often; weights of the terms."""

    def __init__(self, items: list[Counter], weights: np.ndarray):
        self.n_items, self.weights = len(items), weights
        entries = sorted((t, i, n) for i, item in enumerate(items) for t, n in item.items())
        term, item, times = np.array(entries, np.int64).reshape(-1, 3).T
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))
        self.items, self.times = item, times
        # The largest score there can be; below 2^52 sums of whole numbers are exact in doubles.
        most = np.bincount(item, times * weights[term].astype(float), minlength=1).max(initial=0.0) * 1_000_000
        self.in_doubles = most < _EXACT

    def often(self, term: np.ndarray) -> np.ndarray:
        """How many items hold each term."""
        return self.starts[term + 1] - self.starts[term]

    def scores(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores (rows x items) of entries (row, term, gain)."""
        often = self.often(term)
        ends = np.cumsum(often)
        at = np.arange(ends[-1]) + np.repeat(self.starts[term] - (ends - often), often)
        cell = np.repeat(row * self.n_items, often) + self.items[at]
        worth = np.repeat(gain * self.weights[term], often) * self.times[at]
        if self.in_doubles:
            total = np.bincount(cell, worth, minlength=n_rows * self.n_items).astype(np.int64)
        else:
            total = np.zeros(n_rows * self.n_items, np.int64)
            np.add.at(total, cell, worth)
        return total.reshape(n_rows, self.n_items)


class Leaders:
    """The k best classes of each item so far, by falling score and rising first member."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)  # what a score must reach to matter
        self.item, self.score, self.first = (np.empty(0, np.int64) for _ in range(3))
        self.members: list[list[int | None]] = []

    def add(self, scores: np.ndarray, first: np.ndarray, members: pa.Array) -> None:
        n = len(scores)
        if n > self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, n - self.k, axis=0)[n - self.k])
        row, item = np.nonzero(scores >= self.floor)
        own = len(self.item)
        items, values, firsts = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.first, first[row])))
        order = np.lexsort((firsts, -values, items))
        sorted_items = items[order]
        stays = order[np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items) < self.k]
        self.members = [self.members[i] if i < own else members[int(row[i - own])].as_py() for i in stays]
        self.item, self.score, self.first = items[stays], values[stays], firsts[stays]
        full = np.bincount(self.item, minlength=len(self.floor)) == self.k
        least = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(least, self.item, self.score)
        self.floor[full] = np.maximum(self.floor, least)[full]


def _chunks(postings: Postings, sizes: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of classes with a bounded number of scores and of postings, at least a class."""
    upto = np.concatenate([[0], np.cumsum(postings.often(term))])[np.concatenate([[0], np.cumsum(sizes)])]
    rows, a = max(1, _CELLS // postings.n_items), 0
    while a < len(sizes):
        b = max(a + 1, min(a + rows, int(np.searchsorted(upto, upto[a] + _CELLS, "right")) - 1))
        yield a, b
        a = b


def _best(shipped, k: int):
    """Of classes (m, terms, times, members) the k best of each item: item, score, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings: Postings = shipped.value
        best = Leaders(postings.n_items, k)
        for batch in batches:
            m, members = batch.column(0).to_numpy(), batch.column(3)
            sizes = batch.column(1).value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            term, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (1, 2))
            starts = members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()
            first = members.flatten().fill_null(np.iinfo(np.int64).max).to_numpy()[starts]
            for a, b in _chunks(postings, sizes, term):
                inside = slice(ends[a], ends[b])
                row = np.repeat(np.arange(b - a), sizes[a:b])
                gain = 1_000_000_000 * times[inside] // (1000 * times[inside] + 12 * m[a:b][row])
                best.add(postings.scores(row, term[inside], gain, b - a), first[a:b], members.slice(a, b - a))
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.score), pa.array(best.members, pa.list_(pa.int64()))], ["item", "score", "members"])

    return run


def weights(held: np.ndarray, documents: int) -> np.ndarray:
    """Weights of terms that `held` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def _ranked_block(docs: DataFrame, items: list[tuple[int, int | None, Counter]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, _, c in items))))}
    rows = bags(docs, vocabulary)
    documents, all_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
        held[r.term] = r["count"]
    postings = Postings([Counter({vocabulary[t]: n for t, n in c.items()}) for _, _, c in items], weights(held, documents))
    shipped = spark.sparkContext.broadcast(postings)
    found = classes(rows, documents, all_terms or 1, k).mapInArrow(_best(shipped, k), "item long, score long, members array<long>")
    members = found.select("item", "score", F.explode("members").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    names = spark.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(items)], "item long, item_id long")
    best = members.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _blocks(benchmark: DataFrame, terms_per_block: int) -> Iterator[list[tuple[int, int | None, Counter]]]:
    """The items with a term, in blocks: (number, item_id, counted terms). A block has at least one item."""
    block, held = [], 0
    for i, r in enumerate(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()):
        counted = Counter(terms(r.text))
        if counted:
            block.append((i, r.item_id, counted))
            held += len(counted)
            if held >= terms_per_block:
                yield block
                block, held = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP, terms_per_block: int = TERMS_PER_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the k highest-scoring rows of documents (doc_id, text), equal scores by rising doc_id.

    Rows of the benchmark (item_id, text) are items of their own, also if they repeat an item_id. Repeated rows of
    documents have a rank each. A null doc_id comes after the others of the same score. Null texts and texts without a
    term match nothing and do not count as documents; items without a term, and items none of whose terms scores, have
    no rows, and so have all items of empty tables. Other columns are not read.
    """
    found = [_ranked_block(docs, block, k) for block in _blocks(benchmark, terms_per_block)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    return result
