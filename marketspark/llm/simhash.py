"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of the perfect Hamming code of length 63 over the low 63 bits of a fingerprint: every
63-bit word is within distance 1 (the covering radius) of exactly one anchor. Two fingerprints that differ in at
most 2 bits have a midpoint within 1 bit of both, and the midpoint's anchor is within 1 of it, so both lie
within 1 + 2/2 = 2 bits of that anchor. Each fingerprint is therefore copied to every anchor within covering
radius plus threshold, the threshold being shared by the two sides: 32 copies, or 1 for a fingerprint that is an
anchor itself. No pair is lost, an anchor never holds more than 2 * (1 + 63 + 1953) fingerprints whatever the
data, and the 57-bit anchors make chance meetings rare at any size. Fingerprints are compared per anchor in full.

Equal fingerprints are one node, so copies are never expanded into pairs, and an anchor gives a spanning forest
of its links rather than all of them. Links become components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from marketspark.llm.common import settled

SHINGLE_WORDS = 3
SEED = 42
CODE_BITS = 63


def fingerprint_of(text: bytes | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = text.lower().split() if text else []  # on bytes: A-Z only, and the six ASCII white spaces only
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])), "<u8", len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        some = hashes[part : part + (1 << 16)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).astype(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprint of a text as a signed long; null and blank texts have fingerprint 0."""
    return _fingerprints(text.cast("binary"))


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def anchors(fingerprint: str) -> Column:
    """All anchors within 2 bits of the low 63 bits of a fingerprint.

    The syndrome is the exclusive or of the numbers (1 to 63) of the set bits. At 0 the word is an anchor and has
    no other within 2 bits; else flipping bit `syndrome`, or any two bits whose numbers give it, leads to one.
    """
    masks = [sum(1 << (i - 1) for i in range(1, CODE_BITS + 1) if i >> j & 1) for j in range(6)]
    syndrome = " + ".join(f"shiftleft(bit_count({fingerprint} & {m}L) % 2, {j})" for j, m in enumerate(masks))
    low = f"({fingerprint} & 9223372036854775807L)"
    return F.expr(
        f"""flatten(transform(array({syndrome}), s -> CASE WHEN s = 0 THEN array({low}) ELSE concat(
            array({low} ^ shiftleft(1L, s - 1)),
            transform(filter(sequence(1, {CODE_BITS}), i -> i < i ^ s), i -> {low} ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))) END))"""
    )


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of differing bits; unsigned, as bits of negative numbers are counted in their absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one anchor."""
    links, rest = [], members
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            near = frontier[0]
            close = _differing(rest, near) <= threshold
            links += [(int(near), int(x)) for x in rest[close]]
            frontier, rest = np.concatenate([frontier[1:], rest[close]]), rest[~close]
    return links


def _links_per_anchor(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def links(anchor: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(anchor)]])
            pair = starts[ends - starts == 2]
            close = pair[_differing(found[pair], found[pair + 1]) <= threshold]
            a, b = [found[close]], [found[close + 1]]
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                more = np.array(_forest(found[s:e], threshold), np.int64).reshape(-1, 2)
                a.append(more[:, 0])
                b.append(more[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            seen = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1])], ["a", "b"])

        for batch in batches:
            anchor = np.concatenate([held_a, batch.column(0).to_numpy()])
            found = np.concatenate([held_f, batch.column(1).to_numpy()])
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            held_a, held_f = anchor[last:], found[last:]
            if last:
                yield links(anchor[:last], found[:last])
        if len(held_a):
            yield links(held_a, held_f)

    return run


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that differ in at most `threshold` (0 to 2) bits.

    The links of an anchor are reduced to a spanning forest, so components are whole while rows stay linear.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover differences of up to 2 bits")
    copies = prints.select(F.explode(anchors("fp")).alias("anchor"), "fp").repartition("anchor").sortWithinPartitions("anchor", "fp")
    return copies.mapInArrow(_links_per_anchor(threshold), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of the component.

    Each step writes its edges to the shared folder. Minima combine before the shuffle, and a node with very many
    links joins as a skewed key that Spark splits.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = settled(edges.where("a <> b"), name)
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(lowest, "a").select(F.col("b").alias("a"), "m").union(lowest.select("a", "m"))
        edges = settled(small.where("a <> m").select("a", F.col("m").alias("b")).distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def classes(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, component) for rows (id, fp): the smallest id reachable over links. Null ids belong to a class but never name it
    unless the class has no other. Written once, so that a join with it can split a fingerprint that very many rows have."""
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    linked = components(links(reps.select("fp"), threshold), "simhash-links").withColumnRenamed("node", "fp")
    named = linked.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("component"))
    linked = linked.join(named, "root").select("fp", "component")
    return settled(reps.join(linked, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component")), "simhash-classes")


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id per row of documents (doc_id, text).

    Null and blank texts have fingerprint zero and link like any other. Repeated rows each return a row. A null
    doc_id takes the id of its class; a class of null ids only has a null id. Other columns are not read.
    """
    prints = settled(docs.select(F.col("doc_id").cast("long").alias("id"), fingerprints(F.col("text")).alias("fp")), "simhash")
    return prints.join(classes(prints, threshold), "fp").select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """Documents with one row of each class of near-duplicates: of its smallest doc_id, all columns as they are.

    Of repeated rows with that id one stays. A class whose ids are all null keeps one row too.
    """
    rows = settled(
        docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), fingerprints(F.col("text")).alias("fp")),
        "simhash-rows",
    )
    prints = rows.select("row", "id", "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    stays = prints.join(classes(prints, threshold), "fp").groupBy(F.coalesce("component", "fp"), F.col("component").isNull()).agg(first).select("first.row")
    return rows.join(stays, "row", "left_semi").select("doc.*")
