"""Packing, whitening and lexical search against brute force, and the odd cases their docstrings define."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketspark.llm import hmm, lexical, packing, queries, whitening
from marketspark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, rank int, row long, length int, piece int, item long, n long, m long, terms string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, non-ASCII and repeated texts; repeated and null ids; columns named as those used inside."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    texts = [None, "", " \t\n ", long, "ÀÉ Straße ÇA x", "one", "one", "a<|endoftext|>b", "日本語 テキスト", *(" ".join(words[: i % 7 + 1]) for i in range(400)), "one", "one two"]
    rows = [(i, t, "s", 1, 2, 3, 4, 5, 6, 7, "t") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "one", "s", 1, 2, 3, 4, 5, 6, 7, "t"), (None, None, None, 1, 2, 3, 4, 5, 6, 7, "t")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- packing


def plain_best_fit(lengths, size):
    """Best fit over falling lengths, one piece at a time: the number of sequences."""
    rooms = Counter()
    for length in sorted(lengths, reverse=True):
        fitting = [r for r, n in rooms.items() if n and r >= length]
        if fitting:
            room = min(fitting)
            rooms[room] -= 1
        else:
            room = size
        rooms[room - length] += 1
    return sum(rooms.values())


def plain_pieces(docs, size=1024):
    model, out = Tokenizer.from_file(queries.TOKENIZER), []
    for d, text in docs:
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // size * size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def check_packing(rows, want, size=1024):
    def key(r):
        return r[0] is None, r[0] or 0, *r[1:]

    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for placed in held.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_packing_is_whole_gapless_and_best_fit(spark):
    docs = table(spark, SF, "documents")
    want = plain_pieces([(r.doc_id, r.text) for r in docs.collect()])
    n = check_packing(queries.op11_best_fit_packing(spark, SF).collect(), want)
    assert n == plain_best_fit([w[3] for w in want], 1024)
    assert {w[3] for w in want if w[1] > 0} <= {1024}


def test_packing_of_odd_rows(spark, odd):
    want = plain_pieces([(r.doc_id, r.text) for r in odd.collect()], 64)
    rows = packing.pack(odd, queries.TOKENIZER, 64).collect()
    assert check_packing(rows, want, 64) == plain_best_fit([w[3] for w in want], 64)
    assert packing.pack(empty(spark), queries.TOKENIZER).count() == 0


def test_ranks_within_a_hot_length_go_over_many_buckets(spark):
    rows = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 5).otherwise(7).cast("int").alias("length"))
    counts = packing.histogram(rows)
    found = packing.ranked(rows, counts, per_task=50).collect()
    for length in (5, 7):
        assert sorted(r["rank"] for r in found if r["length"] == length) == list(range(counts[length]))


def test_packed_sequences_hold_the_ids(spark, odd):
    model = Tokenizer.from_file(queries.TOKENIZER)
    ids = defaultdict(list)
    for r in odd.collect():
        ids[r.doc_id].append(model.encode(r.text or "", add_special_tokens=False).ids + [2])
    total = 0
    for r in packing.sequences(odd, queries.TOKENIZER, 64).collect():
        assert len(r.ids) <= 64
        for p in r.pieces:
            part = r.ids[p.offset : p.offset + p.length]
            assert len(part) == p.length and any(part == x[p.start : p.start + p.length] for x in ids[p.doc_id])
            total += p.length
    assert total == sum(len(x) for found in ids.values() for x in found)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_of_single_pieces_and_stays_short(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 100, 1024])
    counts = {k: rng.choice([1, 2, 5, 40]) for k in rng.sample(range(1, size + 1), min(size, 60))}
    runs = packing.plan(counts, size)
    lengths = [k for k, n in counts.items() for _ in range(n)]
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, rows, per, sequence, offset in runs:
        for i in range(rows):
            used[sequence + i // per].append((offset + i % per * length, length))
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
    assert {k: set(range(n)) for k, n in counts.items()} == dict(ranks)
    assert len(used) == plain_best_fit(lengths, size) == max(used) + 1
    for placed in used.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= size
    assert len(runs) <= 3 * math.ceil(math.log2(size)) * len(counts)
    many = packing.plan({k: n * 1_000_000_007 for k, n in counts.items()}, size)
    assert len(many) <= 3 * math.ceil(math.log2(size)) * len(counts)


# ---------------------------------------------------------------- whitening


def plain_whitened(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    u = n * x - total
    z = u / n
    values, turned = np.linalg.eigh(z.T @ z / n)
    values, turned = values[::-1][:k], turned[:, ::-1][:, :k]
    return n, (u * u).sum(axis=1), z @ turned / np.sqrt(values), values / np.trace(z.T @ z / n)


def check_whitened(rows, ids, vectors, k=8):
    n, deviation, values, explained = plain_whitened(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(ids) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ values[:, c])
        np.testing.assert_allclose(mine, sign * values[:, c], atol=1e-8)
    for i, v in zip(ids, deviation):
        r = got[i, 1]
        assert r.deviation == v and r.n == n and r.identity_error < 1e-9
    assert [got[ids[0], c + 1].explained for c in range(k)] == pytest.approx(list(explained), rel=1e-10)


def test_whitening_of_the_table_matches_a_dense_eigensolver(spark):
    kept = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect() if r.embedding is not None and all(v is not None and math.isfinite(v) for v in r.embedding)]
    check_whitened(queries.op12_chebyshev_whitening(spark, SF).collect(), [i for i, _ in kept], [v for _, v in kept])


def test_filter_finds_close_eigenvalues_far_from_zero_mean(spark):
    rng = np.random.default_rng(4)
    scales = np.concatenate([[3.0, 2.9, 2.88, 2.0, 1.5, 1.49, 1.4, 1.3, 1.299], np.linspace(1.0, 0.2, 111)])
    turn, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    vectors = (rng.standard_normal((900, 120)) * scales) @ turn.T + 700.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    check_whitened(whitening.whitened(df).collect(), list(range(900)), vectors)
    rows = whitening.usable(df)
    fit = whitening.Fit(rows, 120)
    values, found = whitening.components(fit)
    assert fit.passes < 80  # each of them one scan
    np.testing.assert_allclose(found.T @ found, np.eye(8), atol=1e-13)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, component int, x long, n long"
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.standard_normal(3)], 1, 2, 3) for i in range(40)]
    good += [good[0], (None, [0.5, 0.25, 1.0], 1, 2, 3)]
    bad = [(90, None, 1, 2, 3), (91, [None, 1.0, 2.0], 1, 2, 3), (92, [float("nan"), 1.0, 2.0], 1, 2, 3), (93, [float("inf"), 1.0, 2.0], 1, 2, 3), (94, [], 1, 2, 3), (95, [1.0], 1, 2, 3), (96, [1e30, 0.0, 0.0], 1, 2, 3)]
    rows = whitening.whitened(spark.createDataFrame(good + bad, schema)).collect()
    n, deviation, values, explained = plain_whitened([g[1] for g in good], 3)
    assert Counter(r.vec_id for r in rows) == Counter({i: 3 * c for i, c in Counter(g[0] for g in good).items()})
    assert {(r.vec_id, r.deviation) for r in rows} == {(g[0], int(d)) for g, d in zip(good, deviation)} and {r.n for r in rows} == {n}
    constant = whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0, 3.0 + i % 2], 1, 2, 3) for i in range(6)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in constant} == {(1, False), (2, True), (3, True)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in constant if r.component == 1)
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 1, 2, 3)], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened) for r in one] == [(1, 1, 0, None), (2, 1, 0, None)]
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame(bad[:4], schema)).count() == 0


def test_deviations_beyond_machine_numbers_are_exact_or_null(spark):
    rows = spark.createDataFrame([(0, [2.0**20, 0.0]), (1, [0.0, 1.0]), (2, [2.0**41, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened(rows).collect()}
    x = [[2**30 + 100000, 100000], [100000, 101024], [2**51 + 100000, 100000]]
    total = [sum(c) for c in zip(*x)]
    want = [sum((3 * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


# ---------------------------------------------------------------- lexical search


def plain_ranked(docs, items, k=20):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n, total = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, i, d, s) for i, (_, _, d, s) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def same_ranks(found, docs, items, k=20):
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)
    assert got == plain_ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)


def test_ranked_search_matches_brute_force(spark):
    same_ranks(queries.op13_lexical_search(spark, SF), table(spark, SF, "documents"), table(spark, SF, "benchmark"))


def test_ranked_search_of_odd_rows_and_in_blocks(spark, odd):
    items = [(1, "One two THREE", 5), (2, None, 5), (3, "", 5), (4, "?!", 5), (5, "straße ÇA x 日本語", 5), (1, "One two THREE", 5), (None, "a b", 5), (6, "unknownword", 5), (7, "one one one " * 500, 5)]
    items = spark.createDataFrame(items, "item_id long, text string, item long")
    same_ranks(lexical.ranked(odd, items), odd, items)
    same_ranks(lexical.ranked(odd, items, k=3, terms_per_block=2), odd, items, 3)
    assert lexical.ranked(empty(spark), items).count() == 0
    assert lexical.ranked(odd, items.limit(0)).count() == 0


def test_one_class_per_bag_and_only_its_first_members(spark):
    docs = spark.createDataFrame([(i, "alpha beta beta " + ("x" if i % 2 else "y")) for i in range(500)] + [(900, "alpha"), (901, "gamma")], "doc_id long, text string")
    bags = lexical.bags(docs, {"alpha": 0, "beta": 1})
    found = lexical.classes(bags, 502, 2002, 20).collect()
    assert sorted((list(r.terms), list(r.times), len(r.members)) for r in found) == [([0], [1], 1), ([0, 1], [1, 2], 20)]
    assert next(r.members for r in found if len(r.members) == 20) == list(range(20))
    items = spark.createDataFrame([(1, "beta alpha"), (2, "gamma alpha")], "item_id long, text string")
    same_ranks(lexical.ranked(docs, items), docs, items)


def test_scores_beyond_doubles_are_exact():
    item = Counter({0: 3_000_000, 1: 1})
    postings = lexical.Postings([item], np.array([20_000, 7], np.int64))
    assert not postings.in_doubles
    got = postings.scores(np.array([0, 0]), np.array([0, 1]), np.array([999_999, 3]), 1)
    assert got[0, 0] == 3_000_000 * 20_000 * 999_999 + 21


# ---------------------------------------------------------------- stepwise training


def test_stepwise_training_matches_plain_steps_and_bounds_the_model(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a b c", "c d", "e f g h", "a a"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("text")).coalesce(1)
    settings = hmm.Settings(states=2, classes=4, class_size=1, most_classes=6, slices=3, first_steps=1, steps=1)
    corpus = hmm.count_corpus(docs, settings)
    assert len(corpus.class_counts) == 6 and corpus.class_counts.sum() == sum(len(t.split()) + 1 for t in texts)
    got = hmm.train_model(docs, corpus, settings)
    rows = docs.select("text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(3)).alias("slice")).collect()
    of, model, sums, step = hmm.WordClasses(6), hmm.Hmm.first(corpus.class_counts, 2), None, 0
    for _ in range(2):
        for i in range(3):
            mine = [np.array([*map(of.__getitem__, hmm.tokens(r.text)), 0], np.uint16) for r in rows if r.slice == i]
            found = hmm.expected(model, mine) * (60 / len(mine))
            share = (step + 1) ** -0.6
            sums = found if sums is None else (1 - share) * sums + share * found
            model, step = hmm.Hmm.of_sums(sums, 2, corpus.class_counts), step + 1
    assert np.allclose(got.move, model.move, rtol=1e-4) and np.allclose(got.emit, model.emit, rtol=1e-4) and np.allclose(got.start, model.start, rtol=1e-4)


def test_stepwise_model_scores_held_out_texts_as_well_as_whole_steps(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    mean = {}
    for name, settings in (("stepwise", hmm.STEPWISE), ("whole", hmm.Settings())):
        rows = [r for r in hmm.score(docs, settings).collect() if r.held_out]
        mean[name] = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    print(mean)
    assert mean["stepwise"] > mean["whole"] - 0.02


# ---------------------------------------------------------------- texts encoded once


def test_classes_and_rare_words_come_from_one_stored_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b w{i} x{i} W{i}" if i % 7 else None) for i in range(200)], "doc_id long, text string").repartition(3)
    settings = hmm.Settings(states=2, classes=8, slices=3, first_steps=1, steps=1, head=2)
    taken, trained = [], hmm.fitted
    monkeypatch.setattr(hmm, "fitted", lambda texts, *a: taken.append(texts) or trained(texts, *a))
    rows = hmm.score(docs, settings).collect()
    (texts,) = taken
    kinds = {r.slice: r.n for r in texts.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert sum(n for s, n in kinds.items() if s >= 0) == sum(not r.held_out for r in rows) and kinds[hmm.HELD_OUT] == sum(r.held_out for r in rows)
    tails = texts.where(F.col("slice") == hmm.TAIL)
    pairs = tails.select(F.inline("tail")).collect()
    with_text = [i for i in range(200) if i % 7]
    assert sorted((bytes(p.word), p.tf) for p in pairs) == sorted([(f"w{i}".encode(), 2) for i in with_text] + [(f"x{i}".encode(), 1) for i in with_text])
    for r in tails.collect():  # in the order of the words, so alike ones stand together in files and shuffles
        words = [bytes(t.word) for t in r.tail]
        assert words == sorted(words)


def test_sums_of_several_tasks_add_up_to_those_of_one(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))).encode(),) for _ in range(120)]
    docs = spark.createDataFrame(texts, "text binary").repartition(6)
    settings = hmm.Settings(states=2, classes=8, slices=2, first_steps=1, steps=1)
    corpus = hmm.count_corpus(docs, settings)
    stored = hmm.encoded(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), corpus, settings)
    one = hmm.fitted(stored, corpus, settings)
    monkeypatch.setattr(hmm, "TASK_TOKENS", 200)
    several = hmm.fitted(stored, corpus, settings)
    assert np.allclose(one.start, several.start) and np.allclose(one.move, several.move, rtol=1e-4) and np.allclose(one.emit, several.emit, rtol=1e-4)


def test_recursions_keep_within_doubles_where_emissions_are_tiny():
    model = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[1e-19, 1e-25], [1e-24, 1e-19], [0.7, 0.6]]))
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 2, n) for n in (400, 33, 8, 9, 1)]
    logs = []
    for s in sequences:
        a = np.log(model.start) + np.log(model.emit[s[0]])
        for c in s[1:]:
            a = np.logaddexp.reduce(a[:, None] + np.log(model.move), axis=0) + np.log(model.emit[c])
        logs.append(np.logaddexp.reduce(a) / np.log(10))
    assert np.allclose(hmm.forward(model, sequences), logs)
    for piece in (1 << 16, 7):
        sums = hmm.expected(model, sequences, piece)
        assert np.isclose(sums[:2].sum(), 5) and np.isclose(sums[2:6].sum(), 451 - 5) and np.allclose(sums[6:].reshape(-1, 2).sum(axis=1), np.bincount(np.concatenate(sequences), minlength=3))
