"""Line dedup with levelled sorted runs of line hashes.

A run is a table of line hashes that are in no other run. Batches of documents come in falling doc_id order. Each
batch merge-joins the runs: hashes found there, or held by a larger document of the batch, are candidates; the
hashes of no run (the anti-join) form a run of their own at level 0. When a level holds `fan_out` runs they are
compacted into one run of the next level, so a hash is rewritten only once per level and a batch reads few runs.

A hash's first holder, in this order, is the largest doc_id that holds it and keeps the line. It has one candidate
for every further document, so a line in at least `min_docs` documents has min_docs - 1 candidates or more, and
exactly these are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.llm.common import SPACES, hash_lists, is_listed, line_hash, lower_ascii, settled, shared_folder

HASH = ["h1", "h2"]
NO_ID = -(1 << 63)  # documents without an id stand below all others


class LineRuns:
    """The runs, levels and compaction; runs are Parquet folders in the shared folder, sorted by hash."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.folder = folder or f"{shared_folder(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def hashes(self) -> DataFrame | None:
        """All hashes of all runs; each stands in one run."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema("h1 long, h2 long").parquet(*paths) if paths else None

    def _write(self, hashes: DataFrame, level: int) -> None:
        path = f"{self.folder}/{level}-{uuid.uuid4().hex}"
        hashes.select(*HASH).sortWithinPartitions(*HASH).write.option("compression", "none").parquet(path)  # hashes don't compress
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of rows (h1, h2, holder), each once, and returns those whose hash is in a run or has a larger holder in the batch."""
        firsts = batch.groupBy(*HASH).agg(F.max("holder").alias("first"))
        runs = self.hashes()
        seen = firsts.join(runs.withColumn("known", F.lit(True)), HASH, "left") if runs is not None else firsts.withColumn("known", F.lit(None).cast("boolean"))
        seen = settled(seen.select(*HASH, "first", F.coalesce("known", F.lit(False)).alias("known")), "line-batch", compression="none")
        again = batch.join(seen, HASH).where(F.col("known") | (F.col("holder") < F.col("first"))).select(*HASH, "holder")
        again = settled(again, "line-candidates", compression="none")
        self._write(seen.where(~F.col("known")), 0)
        self.compact()
        return again

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_out:
                paths, self.levels[level] = self.levels[level], []
                self._write(self.spark.read.schema("h1 long, h2 long").parquet(*paths).repartition(*HASH), level + 1)
            level += 1


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """Rows (holder, h1, h2): the line hashes that a document loses."""
    holder = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("holder")
    lines = docs.select(holder, F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).withColumn("line", line_key(F.col("line")))
    held = settled(lines.where(F.char_length("line") >= min_chars).select("holder", *line_hash(F.col("line"))).distinct(), "line-hashes", compression="none")
    # Approximate quantiles set only the sizes of the batches; any edges give the same result.
    edges = sorted(set(held.approxQuantile("holder", [i / batches for i in range(1, batches)] or [0.0], 0.01)), reverse=True)
    runs, candidates, above = LineRuns(docs.sparkSession, fan_out=fan_out), [], None
    for low in [*edges, None]:
        batch = held if above is None else held.where(F.col("holder") < above)
        candidates.append(runs.add(batch if low is None else batch.where(F.col("holder") >= low)))
        above = low
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionAll(more)
    often = every.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs - 1).select(*HASH)
    return settled(every.join(often, HASH, "left_semi"), "line-lost", compression="none")


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the other lines, joined by a line feed) of every row of documents (doc_id, text).

    A null or empty text is one empty line, which always stays. Rows that share a doc_id are one document to the
    count and each lose the lines of its lost keys; a null id stands below all others. Keys shorter than
    `min_chars` code points never count.
    """
    dropped = dropped_lines(docs, min_chars, min_docs, batches, fan_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows without an id are one holder, which may have any number of lines: each of their texts gets only its own.
    own_text = F.when(F.col("holder") == NO_ID, F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("holder", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("own", own_text)
    without_id = rows.where((F.col("doc_id").isNull()) | (F.col("doc_id") == NO_ID)).select("holder", "own", F.explode(F.split("text", "\n")).alias("line"))
    without_id = without_id.select("holder", "own", *line_hash(line_key(F.col("line")))).distinct().join(dropped.where(F.col("holder") == NO_ID), ["holder", *HASH], "left_semi")
    found = dropped.where(F.col("holder") != NO_ID).select("holder", F.lit(0).cast("long").alias("own"), *HASH).unionByName(without_id)
    lost = hash_lists(found, ["holder", "own"]).withColumnRenamed("hashes", "lost")  # no more than the lines of a document
    rows = rows.join(lost, ["holder", "own"], "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.char_length(key) < min_chars) | ~is_listed(F.col("lost"), *line_hash(key))

    rows = rows.withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    rows = rows.withColumn("kept", kept)
    n = F.size("lines").cast("long")
    return rows.select("doc_id", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))
