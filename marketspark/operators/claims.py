"""Numbers, names and phrases in published text, checked against facts. Whole texts, one row per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.config import SPECULATIVE_PHRASES
from marketspark.functions.expr import pct_change
from marketspark.functions.scale import join_on

# Patterns of the numbers looked for, with the number as group 1.
CURRENCY = r"(?i)AED\s*([\d,]+(?:\.\d+)?)"
COUNT = r"(?i)(\d{1,3}(?:,\d{3})*)\s*(?:transactions?|properties|units|sales)"
PERCENTAGE = r"([\d.]+)%"
FIGURE_PATTERNS = {
    "price": r"(?i)AED\s*([\d,]+(?:\.\d+)?)",
    "percentage": r"([\d.]+)\s*%",
    "count": r"(?i)([\d,]+)\s+(?:transactions?|units?|properties|sales)",
    "area": r"(?i)([\d,]+(?:\.\d+)?)\s*(?:sqm|sq\.?\s*m)",
    "large_number": r"(?<![.\d])([\d]{1,3}(?:,\d{3})+)(?![.\d%])",
}
YEAR = r"\b(20[12][0-9])\b"
SUBJECT_LINE = r"(?m)^area:[ \t]*([^\r\n]+)$"
SUBJECT_HEADING = r"(?m)^#[ \t]+([^\r\n]+?)[ \t]+Real Estate"
SUBJECT_FILE = r"area_guide_(.+?)(?:\.md)?$"


def numbers(text: Column | str, pattern: str) -> Column:
    """All numbers a pattern finds, in order, without thousands separators; unreadable ones are dropped."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(1))
    return F.array_compact(F.transform(found, lambda m: F.regexp_replace(m, ",", "").try_cast("double")))


def with_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumns(
        {
            "currency_values": numbers(text, CURRENCY),
            "count_values": numbers(text, COUNT),
            "percentage_values": numbers(text, PERCENTAGE),
        }
    )


def extracted_numbers(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per number found: document, kind, position among its kind, value."""
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_values").alias("values"))
            for kind in ("currency", "count", "percentage")
        ]
    )
    by_kind = with_numbers(docs, text).select(id_column, F.explode(kinds).alias("k"))
    return by_kind.select(id_column, "k.kind", F.posexplode("k.values").alias("position", "value"))


def figures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reach: int = 50) -> DataFrame:
    """Distinct figures of every document by kind, with the text around the first mention of each.

    The text is cut at the matches of a pattern; what surrounds a match is joined from the nearest
    pieces. A match has at least one character, so `reach` pieces on either side are enough, and the
    work grows with the number of matches only.
    """
    found = None
    for kind, pattern in FIGURE_PATTERNS.items():
        pieces = F.split(F.col(text), pattern)
        whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        raw = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        matched = docs.select(
            id_column, pieces.alias("pieces"), whole.alias("whole"), raw.alias("raw")
        ).where(F.size("raw") > 0)
        matched = matched.withColumn(
            "chunks", F.zip_with(F.slice("pieces", 1, F.size("whole")), "whole", lambda p, w: F.concat(p, w))
        )
        one = matched.select(
            id_column, "pieces", "chunks", F.posexplode(F.arrays_zip("whole", "raw")).alias("position", "m")
        )
        i = F.col("position")
        first = F.greatest(i + 1 - reach, F.lit(1))
        before = F.concat(F.array_join(F.slice("chunks", first, i + 1 - first), ""), F.element_at("pieces", i + 1))
        after = F.concat(
            F.array_join(F.slice("chunks", i + 2, F.lit(reach)), ""),
            F.when(F.size("chunks") - (i + 1) <= reach, F.element_at("pieces", -1)).otherwise(""),
        )
        # Characters count, so the pieces are cut by length and not by bytes.
        context = F.concat(F.right(before, F.lit(reach)), F.col("m.whole"), F.left(after, F.lit(reach)))
        part = one.select(
            id_column,
            F.lit(kind).alias("kind"),
            F.regexp_replace("m.raw", ",", "").try_cast("double").alias("value"),
            "position",
            F.struct(F.col("m.raw").alias("raw"), F.trim(F.regexp_replace(context, "\n", " ")).alias("context")).alias("shown"),
        ).where(F.col("value").isNotNull())
        found = part if found is None else found.unionByName(part)
    firsts = found.groupBy(id_column, "kind", "value").agg(F.min_by("shown", "position").alias("shown"))
    return firsts.select(id_column, "kind", "value", "shown.raw", "shown.context")


def subject(text: Column | str, file_name: Column | str) -> Column:
    """What a document is about: its metadata line, else its file name, else its heading."""
    text = F.col(text) if isinstance(text, str) else text
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    from_file = F.initcap(F.regexp_replace(F.regexp_extract(name, SUBJECT_FILE, 1), "_", " "))

    def present(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(
        present(F.regexp_extract(text, SUBJECT_LINE, 1)), present(from_file), present(F.regexp_extract(text, SUBJECT_HEADING, 1))
    )


def forbidden_phrases(text: Column | str, phrases: Sequence[str] = SPECULATIVE_PHRASES) -> Column:
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p.lower())), F.lit(p)) for p in phrases]))


def content_issues(docs: DataFrame, phrases: Sequence[str] = SPECULATIVE_PHRASES, text: str = "text", name: str = "subject") -> DataFrame:
    """Forbidden phrases present and subject absent."""
    found = forbidden_phrases(text, phrases)
    named = F.contains(F.lower(text), F.lower(name))
    return docs.withColumns({"phrases": found, "names_subject": F.coalesce(named, F.lit(False))}).withColumn(
        "is_valid", (F.size("phrases") == 0) & F.col("names_subject")
    )


NAMES_BYTES = 8 << 20  # names up to this size are broadcast


def words(text: Column | str) -> Column:
    """Lower-case words; the marks of names such as '_' and '#' belong to a word."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_#]+"), lambda w: w != "")


def mentions(docs: DataFrame, names: DataFrame, name: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Known names in each text, with how often: word runs of the text joined to the names by equality.

    Runs have the lengths that the names have, so a name of any number of words is found; names are compared word by word.
    A list of names of up to NAMES_BYTES meets the runs where the text is read, and only mentions are shuffled. A longer
    list is joined by a shuffle, of runs that are counted per text before.
    """
    keyed = names.select(F.col(name), words(name).alias("__w")).select(F.col(name), F.array_join("__w", " ").alias("gram"), F.size("__w").alias("__n"))
    keyed = keyed.where("gram <> ''").distinct()
    bytes_of = F.sum(F.octet_length("gram") + F.octet_length(F.col(name).cast("string")) + 32)
    lengths = {r["__n"]: r["bytes"] for r in keyed.groupBy("__n").agg(bytes_of.alias("bytes")).collect()}  # a few small numbers

    def runs(n: int) -> Column:
        starts = F.when(F.size("__w") >= n, F.sequence(F.lit(1), F.size("__w") - n + 1))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.array_join(F.slice("__w", i, n), " "))

    grams = docs.select(id_column, words(text).alias("__w")).select(
        id_column, F.explode(F.concat(F.array().cast("array<string>"), *[runs(n) for n in sorted(lengths)])).alias("gram")
    )
    keyed, times = keyed.select(name, "gram"), F.count(F.lit(1)).alias("mentions")
    if sum(lengths.values()) <= NAMES_BYTES:
        return grams.join(F.broadcast(keyed), "gram").groupBy(id_column, name).agg(times)
    # Counted per document before the join, so that a frequent word moves once per document.
    return grams.groupBy(id_column, "gram").agg(times).join(keyed, "gram").select(id_column, name, "mentions")


def stale_year(text: Column | str, reference_year: int) -> Column:
    """Oldest year from 2010 to 2029 in a text if it is more than a year before the reference, else NULL."""
    found = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(YEAR), F.lit(1))
    oldest = F.array_min(F.transform(found, lambda y: y.try_cast("int")))
    return F.when(oldest < reference_year - 1, oldest)


def area_facts(area_metrics: DataFrame, sales: DataFrame, room_metrics: DataFrame, changes: DataFrame, rooms: int = 5) -> DataFrame:
    """What may be said about each area: its metrics, its number of sales, its leading kinds of home and
    the newest monthly price change."""
    key = ["area_name_en"]
    counted = sales.groupBy(*key).agg(F.count(F.lit(1)).alias("actual_transaction_count"))
    order = Window.partitionBy("area_name_en").orderBy(F.desc("tx_count"), "property_type", "rooms_en")
    leading = (
        room_metrics.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rooms)
        .groupBy(*key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "avg_price"))), lambda s: s["avg_price"]).alias("room_prices"))
    )
    newest = changes.where(F.col("pct_change_mom").isNotNull()).groupBy(*key).agg(
        F.max_by("pct_change_mom", F.struct("transaction_year", "transaction_month", "property_type")).alias("recent_mom_change")
    )
    shown = area_metrics.select(
        *key, "total_transactions", "avg_price", "median_price", "min_price", "max_price", "avg_price_sqm", "avg_size_sqm", "luxury_count"
    )
    out = join_on(shown, counted, key)
    return join_on(join_on(out, leading, key), newest, key)


def _near(values: str, fact: Column, tolerance_pct: float) -> Column:
    """True where any extracted value is within a tolerance of the fact."""

    def close(v: Column) -> Column:
        relative = F.coalesce(F.abs(pct_change(v, fact)) <= tolerance_pct, F.lit(False))
        return F.when(fact == 0, v == 0).otherwise(relative)

    return F.coalesce(F.exists(values, close), F.lit(False))


def checked_claims(docs: DataFrame, facts: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Facts found in each document about its subject: OK, WARNING or ERROR per fact.

    Facts join by subject and are compared inside the row, so no number is paired with another document.
    """
    joined = with_numbers(docs, text).join(facts, F.col("subject") == F.col("area_name_en"))
    count = F.coalesce(F.col("actual_transaction_count"), F.col("total_transactions"))
    low, high = _near("currency_values", F.col("min_price"), 5.0), _near("currency_values", F.col("max_price"), 5.0)
    change = F.abs("recent_mom_change")
    has_change = F.exists("percentage_values", lambda v: F.abs(F.abs(v) - change) < 1.0)
    room = F.exists(F.slice("room_prices", 1, 3), lambda p: _near("currency_values", p, 5.0))

    def check(name: str, found: Column, otherwise: str | None) -> Column:
        status = F.when(found, "OK")
        return F.struct(F.lit(name).alias("check"), (status if otherwise is None else status.otherwise(otherwise)).alias("status"))

    checks = F.array(
        check("avg_price", _near("currency_values", F.col("avg_price"), 2.0), "ERROR"),
        check("median_price", _near("currency_values", F.col("median_price"), 2.0), "WARNING"),
        check("avg_price_sqm", _near("currency_values", F.col("avg_price_sqm"), 2.0), "ERROR"),
        check("transaction_count", _near("count_values", count, 5.0), "WARNING"),
        check("price_range", low & high, "WARNING"),
        F.struct(
            F.lit("luxury_count").alias("check"),
            F.when(F.col("luxury_count") > 0, F.when(_near("count_values", F.col("luxury_count"), 10.0), "OK").otherwise("WARNING")).alias("status"),
        ),
        check("room_prices", F.coalesce(room, F.lit(False)), None),
        check("price_change", F.coalesce(has_change, F.lit(False)), None),
    )
    exploded = joined.select(id_column, "subject", F.explode(checks).alias("c"))
    return exploded.select(id_column, "subject", "c.check", "c.status").where(F.col("status").isNotNull())


def document_verdicts(checked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A document is valid when none of its facts is an error."""
    return checked.groupBy(id_column, "subject").agg(
        F.count_if(F.col("status") == "OK").alias("checks_passed"),
        F.count_if(F.col("status") == "WARNING").alias("warnings"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
    ).withColumn("is_valid", F.col("errors") == 0)


def minimum_evidence(docs: DataFrame, facts: DataFrame, needed: int = 2, tolerance: float = 0.01, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """At least two of average, median and square-metre price stand in the text, each within 1%."""
    joined = docs.withColumn("currency_values", numbers(text, CURRENCY)).join(facts, F.col("subject") == F.col("area_name_en"))

    def present(fact: str) -> Column:
        whole = F.floor(F.col(fact))
        hit = F.exists("currency_values", lambda v: F.abs(whole - F.floor(v)) < whole * tolerance)
        return F.coalesce(hit, F.lit(False)).cast("int")

    found = present("avg_price") + present("median_price") + present("avg_price_sqm")
    return joined.select(id_column, "subject", found.alias("facts_found"), (found >= needed).alias("has_evidence"))
