"""Quality rules with cross-document line frequency, as DataFrame expressions only.

Lines are normalised (trimmed, A-Z in lower case), hashed, and counted in distinct documents per host (the source).
A line above the limits is boilerplate of its host and is removed; a document that is left with too little is
depleted and rejected. Counts combine before they are shuffled, so neither a hot host nor a line that stands in a
third of all documents gathers in one task; for that only hashes and counts are shuffled. Texts are shuffled once, to
meet the hashes of their removed lines, and only where the cleaned text is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.llm.common import SPACES, hash_lists, is_listed, joined_spread, line_hash, lower_ascii, settled, words

SYMBOLS = "[#*$%&|<>]"
LINE = ["host", "h1", "h2"]


@dataclass(frozen=True)
class Limits:
    """A line is above the limits if it stands in more than most_docs documents of its host, however large the host.

    A document is depleted if less than least_share of the characters of its lines are left.
    """

    most_docs: int = 10
    least_share: float = 0.3


# Places (0 on) of the windows in `grams` that are found more than once, in order. Hash and place share one long, so
# plain numbers are sorted and equal neighbours compared; where 40 bits of hash do not tell all windows of the text
# apart, or 24 bits do not hold its places, whole hashes are sorted with their places.
_PLACES = """
CASE WHEN size(array_distinct(grams)) = size(grams) THEN array()
WHEN size(grams) < 16777216 AND size(array_distinct(grams)) = size(array_distinct(transform(grams, h -> shiftright(h, 24))))
THEN sort_array(transform(transform(
  array(sort_array(transform(grams, (h, i) -> shiftleft(shiftright(h, 24), 24) | i))),
  p -> filter(p, (x, i) -> shiftright(x, 24) = shiftright(get(p, i - 1), 24) OR shiftright(x, 24) = shiftright(get(p, i + 1), 24)))[0],
  x -> CAST(x & 16777215 AS INT)))
ELSE sort_array(transform(transform(
  array(sort_array(transform(grams, (h, i) -> struct(h AS h, i AS i)))),
  p -> filter(p, (x, i) -> x.h = get(p, i - 1).h OR x.h = get(p, i + 1).h))[0], x -> x.i))
END"""

# Every repeated window covers its words up to the next repeated window, 3 at most.
_COVERED = "coalesce(aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), 0L, (s, x) -> s + x), 0L)"


def with_base_metrics(rows: DataFrame) -> DataFrame:
    """Adds w, lines, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with `text` (not null)."""
    gram = "CASE WHEN size(w) >= 4 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE array() END"
    n = F.size("w").cast("long")
    rows = rows.withColumns({"w": words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    rows = rows.withColumn("grams", F.expr(gram)).withColumn("places", F.expr(_PLACES))
    rows = rows.withColumns({
        "n_words": n,
        "word_chars": F.char_length(F.array_join("w", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.expr(_COVERED),
    })
    return rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")).drop("w", "grams", "places")


def _item(line: Column) -> Column:
    key = lower_ascii(F.btrim(line, F.lit(SPACES)))
    return F.struct(*line_hash(key), F.char_length(key).alias("chars"))


def frequent_lines(items: DataFrame, limits: Limits) -> DataFrame:
    """(host, h1, h2) of the lines above the limits; `items` has host, holder, h1 and h2."""
    found = items.select(*LINE, "holder").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("docs"))
    return found.where(F.col("docs") > limits.most_docs).select(*LINE)


def cleaned(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, base metrics, base_failed, removed_chars, line_chars, kept and cleaned of every row of documents (doc_id, text, source).

    Cleaned: the text without the lines above the limits, the others as they are and joined by a line feed; blank
    lines stay. Kept: the base rules pass (on the text as it came) and the document is not depleted, that is, enough
    of its lines' characters stand in the cleaned text. Null and blank texts have no words and fail the base rules.
    Null sources are one host. Rows that share a doc_id count as one document of a line but are judged each by itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_base_metrics(rows).withColumn("items", F.transform("lines", _item)).drop("lines")
    # Written once: the row numbers stay as they are, and texts are read again only where they are put out.
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "quality-rows", compression="zstd")
    items = rows.select("row", "host", F.col("doc_id").alias("holder"), F.inline("items"))
    above = settled(frequent_lines(items, limits), "quality-lines")
    found = joined_spread(items.select("row", *LINE), above, LINE).select("row", "h1", "h2").distinct()
    lost = hash_lists(found, ["row"]).withColumnRenamed("hashes", "lost")  # no more than the lines of a document
    rows = rows.drop("host").join(lost, "row", "left").drop("row")

    def stays(item: Column) -> Column:
        return ~is_listed(F.col("lost"), item["h1"], item["h2"])

    chars = "aggregate({}, 0L, (s, x) -> s + x.chars)"
    rows = rows.withColumn("left", F.when(F.col("lost").isNull(), F.col("items")).otherwise(F.filter("items", stays)))
    rows = rows.withColumn("line_chars", F.expr(chars.format("items"))).withColumn("left", F.expr(chars.format("left")))
    rows = rows.withColumn("removed_chars", F.col("line_chars") - F.col("left"))
    whole = F.col("left") >= F.col("line_chars") * limits.least_share
    lines = F.filter(F.split("text", "\n"), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | stays(_item(x)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & whole)
    rows = rows.withColumn("cleaned", F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    return rows.drop("text", "items", "lost", "left")


def judged(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What `cleaned` says of every row of documents, without the texts."""
    return cleaned(docs, limits).drop("cleaned")
