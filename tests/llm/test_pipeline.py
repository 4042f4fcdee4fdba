"""The corpus pipeline stage by stage against brute force, and the plans of the native operators."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from marketspark.llm import decontaminate, language, mixing, queries, simhash
from marketspark.llm.common import settled, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settled(stage(spark, docs, SF), f"test-{name}")
        out.append((before, docs))
    return out


def test_stages_are_in_order_and_keep_the_columns(stages):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["known_language", "near_dedup", "decontaminated", "mixed", "tokenised"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language_stage_keeps_documents_with_letters(stages):
    before, after = stages[0]
    assert before.where(F.col("text").rlike("\\p{L}")).count() == after.count()


def test_language_stage_drops_foreign_and_junk_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = np.random.default_rng(3)
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
    planted = [
        russian,
        russian * 40 + " See the hotel and the people of the world at example.com for more about it.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        *(" ".join("".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], rng.integers(2, 9))) for _ in range(n)) for n in (20, 200, 5000)),
    ]
    foreign = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    kept = {r.doc_id for r in language.keep_known(docs.unionByName(foreign, allowMissingColumns=True)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where(F.col("text").rlike("\\p{L}")).collect()}


def test_dedup_stage_keeps_the_first_of_each_class(stages):
    before, after = stages[1]
    found = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in found})


def test_decontamination_stage_drops_covered_items_only(stages, spark):
    before, after = stages[2]
    items = [decontaminate.hashes(decontaminate.tokens(r.text)) for r in table(spark, SF, "benchmark").collect()]
    leaks = set()
    for d in before.collect():
        found = decontaminate.hashes(decontaminate.tokens(d.text))
        if any(sum(k for *_, k in decontaminate.tiles(i, found, min(4, len(i)))) >= 0.6 * len(i) for i in items):
            leaks.add(d.doc_id)
    assert leaks and sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in leaks)


def test_mixing_stage_repeats_whole_documents(stages):
    before, after = stages[3]
    size = {r.doc_id: r.size for r in mixing.mix(before).collect()}
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(size)
    assert abs(sum(size[d] * n for d, n in copies.items()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())


def test_token_stage_covers_every_document(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    model = Tokenizer.from_file(queries.TOKENIZER)
    ids = lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    want = Counter((r.doc_id, zlib.crc32(ids(r.text))) for r in before.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in after.collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][1])
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op5_line_frequency_rules", "op8_line_dedup"])
def test_native_operators_run_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    want = Counter(str([v for _, v in sorted(zip(columns, row))]) for row in cursor.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert Counter(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want


def test_language_is_imported_for_the_stage():
    assert corpus_pipeline.language is language
