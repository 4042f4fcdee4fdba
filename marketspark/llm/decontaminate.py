"""Benchmark decontamination with greedy string tiling.

Texts become lower-case tokens (runs of letters and digits). Seeds are runs as long as the least tile (4 tokens); an
item shorter than that has one seed, its whole run, and one tile. Seeds are joined by hash; before the join a filter
of fixed size (two bits of 2^24 per seed of the benchmark) drops the seeds of documents that cannot match.

Tiles of k tokens hold k - 3 places of seeds, and k - 3 is never less than k / 4. So a document that covers a share c
of an item of n tokens holds the seeds of at least c * n / 4 places of it. Places are counted per pair from seeds and
numbers alone, and only pairs that reach this get their tokens and are tiled; a phrase that many items and
documents share costs no tiling. Places whose seed would make very many pairs are left out of the count where
the item can spare them: each one left out lowers what the item asks for by one, so that no pair is lost.

Each candidate is tiled: the longest matches between unmarked tokens are found by running Karp-Rabin hashes and
extended, longest first they become tiles, and the search goes on with shorter windows down to 4 tokens. Tiles may
stand in any order, so a passage whose sentences changed places is still covered. The share of an item's tokens
that tiles cover is its coverage; from the threshold on the document counts as contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marketspark.llm.common import joined_spread, settled

LEAST_TILE = 4
COVERAGE = 0.6
HOT_PAIRS = 100_000  # pairs of one seed from which on its places are left out of the count where they can be spared
FILTER_BITS = 24
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


@lru_cache(maxsize=1 << 18)
def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


def hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_hash, found), np.uint64, len(found))


def seeds(found: np.ndarray, size: int = LEAST_TILE) -> np.ndarray:
    """Hashes of all windows of `size` tokens."""
    n = len(found) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(BASE) + found[j : j + n]
    return total ^ total >> np.uint64(29)  # the low bits of a sum of products alone are weak


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])


class Rolling:
    """Karp-Rabin hashes of windows of any size from one pass of prefix sums."""

    def __init__(self, found: np.ndarray):
        room = 1 << max(8, len(found).bit_length())
        self.up = _powers(room, BASE)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(found * _powers(room, INVERSE)[: len(found)], dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.up[:n] if n > 0 else np.empty(0, np.uint64)


def _free_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of `size` tokens from each place on has no marked token."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return marked[size:] == marked[:-size]


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token sequences: (place in item, place in text, length) of tiles that do not overlap in either."""
    if len(item) < least or len(text) < least:
        return []
    own, other = Rolling(item), Rolling(text)
    own_free, other_free = np.ones(len(item), bool), np.ones(len(text), bool)
    result, size = [], min(len(item), len(text))
    while True:
        matches = []
        here = own.windows(size)
        places: dict[int, list[int]] = {}
        for i in np.flatnonzero(_free_windows(own_free, size)):
            places.setdefault(int(here[i]), []).append(int(i))
        if places:
            there = other.windows(size)
            hit = _free_windows(other_free, size) & np.isin(there, np.fromiter(places, np.uint64, len(places)))
            reached: dict[int, int] = {}  # by diagonal, the end of the last match
            for j in np.flatnonzero(hit):
                j = int(j)
                for i in places[int(there[j])]:
                    if reached.get(j - i, 0) > j or not np.array_equal(item[i : i + size], text[j : j + size]):
                        continue
                    k = size
                    while i + k < len(item) and j + k < len(text) and own_free[i + k] and other_free[j + k] and item[i + k] == text[j + k]:
                        k += 1
                    reached[j - i] = j + k
                    matches.append((k, i, j))
        marked_any = False
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if own_free[i : i + k].all() and other_free[j : j + k].all():
                own_free[i : i + k] = False
                other_free[j : j + k] = False
                result.append((i, j, k))
                marked_any = True
        if own_free.sum() < least:
            return result
        # A match that lost tokens to a longer one may have a rest of this size: look again before going shorter.
        if not (marked_any and len(matches) > 1):
            if size == least:
                return result
            size = max(least, size // 2)


def _item_seeds(least: int, coverage: float):
    """Items (id, text) that have a token, with their tokens, seeds in order, the places asked for and the distinct seeds these take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, sizes, found, asked, distinct = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = tokens(text.as_py())
                if not words:
                    continue
                s = seeds(hashes(words), min(least, len(words)))
                need = max(1, ceil(coverage * len(words) / least - 1e-9))
                rows.append(i)
                texts.append(" ".join(words))
                sizes.append(min(least, len(words)))
                found.append(s.view(np.int64))
                asked.append(need)
                most = np.sort(np.unique(s, return_counts=True)[1])[::-1].cumsum()
                distinct.append(int(np.searchsorted(most, need)) + 1)
            columns = [pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(asked, pa.int64()), pa.array(distinct, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["item_id", "item", "size", "seeds", "asked", "distinct"])

    return run


def _seeded(bits: np.ndarray, sizes: list[int], distinct: int):
    """Documents (id, text) that hold at least `distinct` seeds passing the filter, with these seeds and the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, found = [], [], []
            for i, text in enumerate(batch.column(1)):
                words = tokens(text.as_py())
                h = hashes(words)
                s = np.concatenate([seeds(h, size) for size in sizes])
                s = np.unique(s[_has(bits, s & np.uint64((1 << FILTER_BITS) - 1)) & _has(bits, s >> np.uint64(64 - FILTER_BITS))])
                if len(s) >= distinct:
                    rows.append(i)
                    texts.append(" ".join(words))
                    found.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["id", "tokens", "seeds"]
            )

    return run


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _filter_bits(items: DataFrame) -> np.ndarray:
    """The filter as bytes: 2^24 bits (2 MB), of which the driver gets the words that are not 0."""
    low, high = F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    at = items.select(F.explode("seeds").alias("seed")).select(F.explode(F.array(low, high)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).collect()
    found = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for r in words:
        found[r.word] = r.bits
    return found.view(np.uint8)


def _tiled(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, np.empty(0, np.uint64)
        for batch in batches:
            rows, shares, counts, covered, sizes = [], [], [], [], []
            for i, (row, words, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4).to_pylist())):
                if row != last:
                    last, text = row, hashes(words.as_py().split(" "))
                item = hashes(item.split(" "))
                found = tiles(item, text, min(least, len(item)))
                n = sum(k for _, _, k in found)
                if n >= coverage * len(item):
                    rows.append(i)
                    shares.append(n / len(item))
                    counts.append(len(found))
                    covered.append(n)
                    sizes.append(len(item))
            picked = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(picked), batch.column(1).take(picked), batch.column(2).take(picked)]
            columns += [pa.array(shares, pa.float64()), pa.array(counts, pa.int32()), pa.array(covered, pa.int32()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "item_id", "coverage", "n_tiles", "covered_tokens", "item_tokens"])

    return run


def _candidates(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (row, item_row) that share as many places of seeds as the item asks for."""
    held = rows.select("row", F.explode("seeds").alias("seed"))
    places = items.select("item_row", "asked", F.explode("seeds").alias("seed")).groupBy("item_row", "asked", "seed").agg(F.count(F.lit(1)).alias("places"))
    # Pairs that a seed makes: its documents times its items.
    pairs = held.groupBy("seed").agg(F.count(F.lit(1)).alias("docs")).join(places.groupBy("seed").agg(F.count(F.lit(1)).alias("items")), "seed")
    hot = pairs.select("seed", (F.col("docs") * F.col("items")).alias("pairs")).where(F.col("pairs") > HOT_PAIRS)
    marked = places.join(hot, "seed", "left")
    # An item spares hot places, the hottest first, as long as it still asks for one.
    before = Window.partitionBy("item_row").orderBy(F.desc("pairs"), "seed")
    spared = F.col("pairs").isNotNull() & (F.col("spent") < F.col("asked"))
    marked = marked.withColumn("spent", F.sum("places").over(before)).withColumn("spared", spared)
    whole = Window.partitionBy("item_row")
    asked = F.col("asked") - F.coalesce(F.sum(F.when(F.col("spared"), F.col("places"))).over(whole), F.lit(0))
    marked = settled(marked.withColumn("asked", asked).where(~F.col("spared")).select("item_row", "asked", "seed", "places"), "tiling-places")
    shared = joined_spread(held, marked, ["seed"]).groupBy("row", "item_row", "asked").agg(F.sum("places").alias("places"))
    return shared.where(F.col("places") >= F.col("asked")).select("row", "item_row")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_tile: int = LEAST_TILE) -> DataFrame:
    """Pairs of a row of documents (id, text) and a benchmark item (item_id, text) whose coverage reaches the threshold.

    An item of fewer tokens than the least tile matches where its whole run stands. Null and empty texts, and those
    without a letter or digit, match nothing; repeated items and documents give a pair each.
    """
    schema = "item_id long, item string, size int, seeds array<long>, asked long, distinct long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_seeds(least_tile, coverage), schema)
    items = settled(items.withColumn("item_row", F.monotonically_increasing_id()), "tiling-items")
    facts = items.agg(F.collect_set("size").alias("sizes"), F.min("distinct").alias("distinct")).first()  # sizes: 1 to least_tile
    sizes, distinct = sorted(facts.sizes) or [least_tile], facts.distinct or 1
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(items))

    def seeded(batches):
        return _seeded(bits.value, sizes, distinct)(batches)

    rows = settled(docs.select("id", "text").mapInArrow(seeded, "id long, tokens string, seeds array<long>").withColumn("row", F.monotonically_increasing_id()), "tiling-seeds")
    pairs = _candidates(rows, items).join(items.select("item_row", "item_id", "item"), "item_row").join(rows.select("row", "id", "tokens"), "row")
    schema = "row long, id long, item_id long, coverage double, n_tiles int, covered_tokens int, item_tokens int"
    return pairs.select("row", "id", "item_id", "tokens", "item").mapInArrow(_tiled(least_tile, coverage), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, covered_tokens, item_tokens and contaminated (true) of every pair that reaches the threshold."""
    pairs = matches(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), benchmark, coverage)
    return pairs.select(F.col("id").alias("doc_id"), "item_id", "coverage", "n_tiles", "covered_tokens", "item_tokens", F.lit(True).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents without the rows that hold a benchmark item; all columns as they are. Equal texts are judged alike."""
    found = matches(docs.select(F.xxhash64("text").alias("id"), "text"), benchmark, coverage).select("id").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("id"))
    return rows.join(found, "id", "left_anti").select("doc.*")
