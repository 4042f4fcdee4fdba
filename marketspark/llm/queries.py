"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketspark.llm import decontaminate, hmm, language, lexical, line_dedup, line_frequency, mixing, packing, preference, quality, simhash, token_file, whitening
from marketspark.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Word rule and white space in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(*preference.with_next_reply(table(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS e FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT c.conv_id, c.text FROM conversations c JOIN last ON c.conv_id = last.conv_id AND c.turn = last.e),
other AS (SELECT conv_id, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS text FROM reply),
t AS (SELECT c.conv_id AS pair_id, c.turn, c.role, c.text AS good, CASE WHEN c.turn = last.e THEN other.text ELSE c.text END AS bad
  FROM conversations c JOIN last USING (conv_id) JOIN other USING (conv_id)),
f AS (SELECT pair_id, min(turn) FILTER (WHERE good <> bad) AS first FROM t GROUP BY pair_id),
r AS (SELECT t.*, first IS NULL OR turn < first AS common, '<|' || role || '|>' || chr(10) AS head,
  good || '<|end|>' || chr(10) AS good_body, bad || '<|end|>' || chr(10) AS bad_body FROM t JOIN f USING (pair_id)),
s AS (SELECT *, coalesce(sum(length(head) + length(good_body)) OVER w, 0) AS good_at, coalesce(sum(length(head) + length(bad_body)) OVER w, 0) AS bad_at FROM r
  WINDOW w AS (PARTITION BY pair_id, common ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id, count(*) FILTER (WHERE common) AS n_common,
  coalesce(string_agg(head || good_body, '' ORDER BY turn) FILTER (WHERE common), '') AS prompt,
  coalesce(string_agg(head || good_body, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS chosen,
  coalesce(string_agg((good_at + length(head)) || '-' || (good_at + length(head) + length(good_body)), ',' ORDER BY turn) FILTER (WHERE NOT common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(head || bad_body, '' ORDER BY turn) FILTER (WHERE NOT common), '') AS rejected,
  coalesce(string_agg((bad_at + length(head)) || '-' || (bad_at + length(head) + length(bad_body)), ',' ORDER BY turn) FILTER (WHERE NOT common AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id"""


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return line_frequency.judged(table(spark, sf_dir, "documents")).select(*columns)


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
l AS (SELECT doc_id, source, line, lower_line FROM (SELECT doc_id, source, unnest(all_lines) AS line FROM d),
  LATERAL (SELECT {_LOWER.format("trim(line, " + _SPACES + ")")} AS lower_line) WHERE lower_line <> ''),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
often AS (SELECT source, lower_line FROM l GROUP BY source, lower_line HAVING count(DISTINCT doc_id) > 10),
chars AS (SELECT l.doc_id, sum(length(l.lower_line)) AS n, sum(CASE WHEN often.lower_line IS NULL THEN length(l.lower_line) ELSE 0 END) AS remaining
  FROM l LEFT JOIN often ON l.source IS NOT DISTINCT FROM often.source AND l.lower_line = often.lower_line GROUP BY l.doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, coalesce(chars.remaining >= chars.n * 0.3, true) AS whole
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN chars USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND whole AS kept
FROM m"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# Targets in closed form: sources in rising order of top / weight stop at their top until the level holds for the rest.
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || size), 1, 15) AS BIGINT) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS top FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY top / weight, source) AS i, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS budget FROM w),
c AS (SELECT *, coalesce(sum(top) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still FROM r),
level AS (SELECT min_by((budget - used) / still, i) AS level FROM c WHERE top / weight > (budget - used) / still),
t AS (SELECT source, source_size, round(CASE WHEN level IS NULL OR top <= level * weight THEN top ELSE level * weight END, 6) AS target FROM c LEFT JOIN level ON true),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t),
b AS (SELECT keyed.*, p.source_size, p.target, p.epochs, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed JOIN p ON keyed.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM b"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH l AS (SELECT doc_id, i, line, {_LOWER.format("trim(line, " + _SPACES + ")")} AS key FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, often.key IS NOT NULL AND l.doc_id < often.holder AS gone FROM l LEFT JOIN often ON l.key = often.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Items are told apart by their row, as repeated item_ids are items of their own.
_TERMS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
t AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), size),
m AS (SELECT doc, doc_id, 75 + (25 * CAST(len(terms) AS BIGINT) * n_docs) // n_terms AS m FROM d, size WHERE len(terms) > 0),
s AS (SELECT item, item_id, doc, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 20"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_string_tiling, op2_simhash_near_dedup, op3_preference_format, op4_token_file, op5_line_frequency_rules, op6_source_mixing,
    op7_language_id, op8_line_dedup, op9_quality_classifier, op10_hidden_markov_scores, op11_best_fit_packing, op12_chebyshev_whitening, op13_lexical_search, pipeline,
)
QUERIES = {q.__name__: q for q in _ALL}
SQL = {"op3_preference_format": OP3_SQL, "op5_line_frequency_rules": OP5_SQL, "op6_source_mixing": OP6_SQL, "op8_line_dedup": OP8_SQL, "op13_lexical_search": OP13_SQL}
