"""The corpus operators against brute force on small tables, and the odd cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketspark.llm import decontaminate, hmm, language, line_dedup, line_frequency, mixing, preference, quality, queries, simhash, token_file
from marketspark.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row long, key string, size int, doc string"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def words():
    random.seed(5)
    return ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(300)]


def rows_of(texts, source="s"):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return [(i, t, None, f"{source}{i % 3}" if i % 5 else None, None, "x", 1, "k", 2, "d") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark, words):
    """Null, empty, blank, very long, non-ASCII and repeated texts; repeated and null ids."""
    long = " ".join(random.choice(words) for _ in range(30_000))
    texts = [None, "", " \t\n ", long, "ÀÉ Straße ÇA \x1c x", "one", "one", "a\nb\n\na", " ".join(words[:60]), " ".join(words[:60]), "### $$$ 123", "日本語 テキスト"]
    rows = rows_of(texts)
    rows += [rows[8], (None, "one", None, None, None, "x", 1, "k", 2, "d"), (None, None, None, None, None, "x", 1, "k", 2, "d")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    parent = {f: f for f in set(prints)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    return {f: root(f) for f in parent}


def test_fingerprints_and_components_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    roots, members = plain_components(want.values()), defaultdict(list)
    for d, f in want.items():
        members[roots[f]].append(d)
    got = queries.op2_simhash_near_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", min(members[roots[f]])) for d, f in want.items())


def test_links_of_crowded_fingerprints_are_whole(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(4)]
    prints = {0, (1 << 64) - 1, 1 << 63, 3}
    for b in base:  # dense groups, chains and far ones
        for _ in range(150):
            x = b
            for _ in range(random.randint(0, 4)):
                x ^= 1 << random.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "id long, fp long")
    got = {r.fp: r.component for r in simhash.classes(df).collect()}
    roots = plain_components(prints)
    least = {}
    for i, x in enumerate(prints):
        least[roots[x]] = min(i, least.get(roots[x], i))
    assert got == {s: least[roots[x]] for s, x in zip(signed, prints)}
    with pytest.raises(ValueError):
        simhash.links(df.select("fp"), 3)


def test_each_pair_within_two_bits_shares_an_anchor(spark):
    random.seed(4)
    pairs = []
    for _ in range(300):
        x = random.getrandbits(64)
        y = x ^ sum({1 << random.randrange(64) for _ in range(2)})
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(pairs, "x long, y long").select(simhash.anchors("x").alias("a"), simhash.anchors("y").alias("b"))
    assert df.where(~F.arrays_overlap("a", "b")).count() == 0
    assert df.agg(F.max(F.size("a"))).first()[0] == 32


def test_near_dedup_of_odd_tables(spark, odd):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert got[(0, zero)] == got[(1, zero)] == got[(2, zero)] == got[(None, zero)] == 0
    assert {v for (d, _), v in got.items() if d in (8, 9)} == {8}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 7, 8, 10, 11]
    assert simhash.near_duplicates(empty(spark)).collect() == simhash.keep_one(empty(spark)).collect() == []


# ---------------------------------------------------------------- token files


def test_elias_fano_selects_every_entry():
    rng = np.random.default_rng(0)
    for values in ([0], [5], [0, 0, 0], [0, 1, 2, 3], np.sort(rng.integers(0, 10**9, 1000)), np.cumsum(rng.integers(0, 3, 5000)), [7] * 200, [0] * 100 + [1 << 40]):
        coded, end = token_file.EliasFano.read(memoryview(token_file.EliasFano.of(np.array(values)).to_bytes()), 0)
        assert coded.all().tolist() == list(values)
        assert [coded.select(i) for i in range(len(values))] == list(values)
    assert token_file.EliasFano.of(np.array([], int)).all().tolist() == []
    spread = np.sort(rng.integers(0, 10**7, 10_000))
    assert len(token_file.EliasFano.of(spread).to_bytes()) * 8 < 13 * len(spread)
    with pytest.raises(IndexError):
        coded.select(101)


def test_token_file_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.TOKENIZER)
    for name, docs in (("a", table(spark, SF, "documents")), ("b", odd)):
        token_file.write(docs, str(tmp_path / name), queries.TOKENIZER, block_ids=5000)
        want = Counter()
        for r in docs.collect():
            want[(r.doc_id, tuple([*model.encode(r.text or "", add_special_tokens=False).ids, 0]))] += 1
        got = token_file.documents(spark, str(tmp_path / name)).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        rows = sorted(token_file.offsets(spark, str(tmp_path / name)).collect(), key=lambda r: r.start)
        at = 0
        for r, before in zip(rows, [None, *rows]):
            assert r.start == at and (before is None or before.doc_id is None or before.doc_id <= r.doc_id)
            at += r.n_tokens
        crc = Counter((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want.elements())
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == crc
        one = spark.read.parquet(str(tmp_path / name)).first().data
        block = token_file.Block.read(one)
        assert [block.document(i).tolist()[-1] for i in range(len(block))] == [0] * len(block)
    assert token_file.round_trip(empty(spark), queries.TOKENIZER).collect() == []


def test_remembered_pieces_have_bounded_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_file.Encoder(path, 0), Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcÀé07-#", k=rng.choice([3, 8, 40, 41, 3000]))) for _ in range(30)) for _ in range(20)] + ["a" * 41, "a" * 40, "", " " * 500]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert encoder.known and max(map(len, encoder.known)) == token_file.LONGEST


def test_names_of_added_tokens_are_those_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.TOKENIZER)
    assert model.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    texts = ["a<|endoftext|>b", "a b", "<|endoftext|>", "日本<|endoftext|>語", "a <|endoftext|> <|endoftext", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_file.write(docs, str(tmp_path / "added"), queries.TOKENIZER)
    got = {r.doc_id: list(r.ids) for r in token_file.documents(spark, str(tmp_path / "added")).collect()}
    assert got == {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


# ---------------------------------------------------------------- rules on lines


def plain_repeats(w):
    windows = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_base_metrics_match_brute_force(spark, odd, words):
    random.seed(8)
    texts = [" ".join(random.choice(words[:n]) for _ in range(random.randint(0, 400))) for n in (1, 2, 3, 5, 20, 300) for _ in range(6)]
    docs = odd.unionByName(spark.createDataFrame(rows_of(["a b c a b c", "a a a a", "a a a", "x\nx\n x\n\n\nx", *texts]), SCHEMA))
    got = Counter(tuple(r)[:7] for r in line_frequency.judged(docs).select(*"doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()).collect())
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        rep = plain_repeats(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))] += 1
    assert got == want
    assert line_frequency.judged(empty(spark)).collect() == []


def test_depleted_documents_of_a_host_are_rejected(spark, words):
    random.seed(2)
    prose = lambda: " ".join(random.choice(words) for _ in range(80))
    line = prose()
    rows = [(i, f"{line}\n{prose() if i % 2 else 'Short end.'}", "h") for i in range(60)] + [(100 + i, prose(), "h") for i in range(60)]
    rows += [(200 + i, line, "other") for i in range(10)]
    got = {r.doc_id: r.kept for r in line_frequency.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(0, 60, 2))
    assert all(got[i] for i in range(1, 60, 2)) and all(got[i] for i in (*range(100, 160), *range(200, 210)))


def test_lines_above_the_limits_are_removed_from_the_text(spark, words):
    random.seed(6)
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    line = prose(70)
    rows = [(i, f"{prose(60)}\n\n  {line.upper()} \n{prose(9)}", "h") for i in range(40)] + [(50 + i, f"{line}\nend {i}", "h") for i in range(5)]
    rows += [(60, f"{line}\n{prose(60)}", None), (61, None, "h"), (62, " \n", "h"), (60, f"x\n{line}", "h")]
    got = line_frequency.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    gone = lambda t, source: "\n".join(x for x in t.split("\n") if source is None or x.strip(SPACES).lower() != line)
    assert Counter((r.doc_id, r.cleaned) for r in got) == Counter((d, gone(t or "", source)) for d, t, source in rows)
    chars = lambda t: sum(len(x.strip(SPACES)) for x in t.split("\n"))
    assert all(chars(r.cleaned) == r.line_chars - r.removed_chars and r.kept == (not r.base_failed and chars(r.cleaned) >= 0.3 * r.line_chars) for r in got)
    assert not any(r.kept for r in got if 50 <= r.doc_id < 55)


def plain_line_dedup(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-math.inf if d is None else d)
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= 20 and len(held[key(x)]) >= 3 and (-math.inf if d is None else d) < max(held[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out[(d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_matches_brute_force(spark, odd, batches, fan_out):
    random.seed(6)
    common = [f"Line {i} that many documents Share ÄÖ" for i in range(12)]
    texts = ["\n".join(random.choice([*common, "short", "", f"  own line of document number {i} \t", "\tLINE 3 that many documents share ÄÖ"]) for _ in range(random.randint(0, 8))) for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts), SCHEMA))
    got = line_dedup.dedup(docs, batches=batches, fan_out=fan_out).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert line_dedup.dedup(empty(spark)).collect() == []


def test_documents_of_very_many_lines_and_rows_without_id(spark):
    n = 60_000
    own = [f"line number {i} of a very long list" for i in range(n)]
    rows = [(i, "\n".join(own)) for i in range(3)] + [(None, "\n".join(own[k : k + 3])) for k in range(0, 30, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter({(2, n, 0): 1, (1, n, n): 1, (0, n, n): 1, (None, 3, 3): 10})
    every = [(i, "\n".join(own), "h") for i in range(11)]
    got = line_frequency.cleaned(spark.createDataFrame(every, "doc_id long, text string, source string")).select("cleaned", "removed_chars", "line_chars").collect()
    assert {(r.cleaned, r.removed_chars == r.line_chars) for r in got} == {("", True)}


def test_lists_of_hashes_hold_just_their_hashes(spark):
    from marketspark.llm.common import hash_lists, is_listed

    random.seed(3)
    held = {(k, random.randint(-50, 50), random.randint(0, 2)) for k in range(6) for _ in range(k * k * 8 + 1)}
    lists = hash_lists(spark.createDataFrame(list(held), "k int, h1 long, h2 long"), ["k"])
    asked = spark.range(6).selectExpr("CAST(id AS INT) AS k", "explode(sequence(-50L, 50L)) AS h1").selectExpr("*", "explode(array(0L, 1L, 2L)) AS h2")
    got = asked.join(lists, "k").where(is_listed(F.col("hashes"), F.col("h1"), F.col("h2"))).select("k", "h1", "h2").collect()
    assert {tuple(r) for r in got} == held and len(got) == len(held)


def test_runs_are_disjoint_and_compacted(spark):
    runs = line_dedup.LineRuns(spark, fan_out=2)
    for b in range(5):
        batch = spark.range(b * 50, b * 50 + 100).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(10 - b).alias("holder"))
        again = runs.add(batch)
        assert again.count() == (50 if b else 0)
    assert runs.hashes().count() == runs.hashes().distinct().count() == 300
    assert [len(level) for level in runs.levels] == [1, 0, 1]


# ---------------------------------------------------------------- mixing


def test_mixing_meets_its_targets(spark, odd):
    for docs in (table(spark, SF, "documents"), odd):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        total = sum(r.size for r in rows)
        named = {}
        for d, r in zip(sorted(docs.collect(), key=lambda r: str((r.doc_id, r.text))), sorted(rows, key=lambda r: str((r.doc_id,)))):
            assert r.taken <= 2 * r.size
        sums, targets = Counter(), {}
        by_id = {d.doc_id: d.source for d in docs.collect()}
        for r in rows:
            sums[by_id[r.doc_id]] += r.taken
            targets[by_id[r.doc_id]] = r.target
        assert abs(sum(targets.values()) - 1.5 * total) < 1e-3 * max(1, total)
        assert all(abs(sums[s] - t) <= 4 for s, t in targets.items()), named
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(spark)).collect() == mixing.mixed_documents(empty(spark)).collect() == []


def test_mixed_documents_are_whole_and_near_the_targets(spark):
    docs = table(spark, SF, "documents")
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.join(docs, docs.columns, "left_anti").count() == 0
    want = {r.source: r for r in mixing.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    got = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", "\\s+"), ""))).alias("n")).collect()}
    assert all(abs(got[s] - r.target) <= r.most for s, r in want.items())


# ---------------------------------------------------------------- language and quality


def test_language_of_held_out_documents(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    few = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, "bb"))
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(few).collect()}
    assert {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (10, "und", 0.0), (None, "und", 0.0)} <= got
    assert all(lang in ("aa", "bb") for d, lang, _ in got if d in (3, 4, 5, 8, 11))
    assert {r.lang_pred for r in language.identify(odd).collect()} == {"und"}  # nothing to learn from
    assert language.identify(empty(spark)).collect() == []
    kept = language.keep_known(few)
    assert kept.columns == odd.columns and {0, 1, 2, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def plain_grams(text):
    """Distinct letter n-grams of a text: each word between gaps, all gaps alike, as strings."""
    run = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
    return {run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1)} if run.strip() else set()


def plain_kernel(a, b):
    return len(a & b) / math.sqrt(len(a) * len(b))


def test_presence_kernel_ridge_against_kernels_and_a_plain_solution(spark):
    docs = table(spark, SF, "documents").where("text rlike '\\\\p{L}'")
    settings = language.Settings(landmarks=6, training=40)
    model = language.fit(docs, settings)
    rows = [(r.lang, r.text, r.hash) for r in docs.select("lang", "text", F.xxhash64("doc_id").alias("hash")).where("lang is not null").collect()]
    count = Counter(r[0] for r in rows)

    def lowest(n):
        return [r for r in rows if count[r[0]] <= n or r[2] <= int(n / count[r[0]] * 2.0**64 - 2.0**63)]

    marks, train = [[(r[0], plain_grams(r[1])) for r in lowest(n)] for n in (settings.landmarks, settings.training)]
    names = sorted({m[0] for m in marks})
    inner = np.array([[plain_kernel(a, b) for _, b in marks] for _, a in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.array([[plain_kernel(t, m) for _, m in marks] for _, t in train]) @ root
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang, _ in train])
    w = np.linalg.solve(x.T @ x + settings.ridge * len(train) * np.eye(x.shape[1]), x.T @ y)
    texts = [r[1] for r in rows[:60]] + ["Ab c", "αβγ"]
    want = np.array([[plain_kernel(plain_grams(t), m) for _, m in marks] for t in texts]) @ root @ w
    got, letters = model.products(texts)
    assert model.languages == names and letters.all() and np.abs(got - want).max() < 2e-3
    one, _ = model.products(texts[:1])
    many, _ = model.products([texts[0], "", "x", texts[0]])
    assert np.allclose(one[0], many[0]) and np.allclose(many[0], many[3])


def test_grams_tell_all_letters_apart():
    assert set(language.grams("Aab, a").tolist()) == set(language.grams("  aab\n\na!").tolist())
    assert language.grams("123 !") is None and language.grams("") is None and language.grams(None) is None and language.grams("\u0301 1") is None
    for text in ("Aab, a", "Straße über İzmir", "".join(map(chr, range(0x4E00, 0x4E00 + 500))), "한국어 텍스트", "𐐀𐐁 a"):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        run = re.sub(r"[\W\d_]+", " ", f" {low} ")
        want = Counter(run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1))
        codes, times = language.counted_grams(text)
        assert sorted(want.values()) == sorted(times.tolist()) and len(want) == len(codes) and (np.diff(codes) > 0).all()
    chinese, korean = ("".join(chr(first + i) for i in range(500)) for first in (0x4E00, 0xAC00))
    assert len(np.intersect1d(language.grams(chinese), language.grams(korean))) == 1  # the gap


PLANTED = {
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα είναι προικισμένοι με λογική και συνείδηση",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах вони наділені розумом і совістю і повинні діяти",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा",
    "th": "มนุษย์ ทั้งหลาย เกิดมา มีอิสระ และ เสมอภาค กัน ใน ศักดิ์ศรี และ สิทธิ ต่าง มี เหตุผล และ มโนธรรม",
    "zh": "人人 生而 自由 在 尊严 和 权利 上 一律 平等 他们 赋有 理性 和 良心 并应 以 兄弟 关系 的 精神 相对待",
    "ja": "すべての 人間は 生まれながらに して 自由で あり かつ 尊厳と 権利とに ついて 平等で ある 人間は 理性と 良心とを",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
    "vi": "tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền mọi con người đều được tạo hóa ban cho",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
}


def test_languages_of_any_script(spark):
    """Twelve languages in nine scripts, short texts of a language's words, next to the given documents."""
    rng = random.Random(4)
    rows = [(10_000 + i, " ".join(rng.choices(text.split(), k=rng.randint(8, 40))), lang) for i, (lang, text) in enumerate((x for _ in range(60) for x in PLANTED.items()))]
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.identify(docs, language.Settings(landmarks=12, training=40)).collect()}
    held = [(d, lang) for d, _, lang in rows if got[d].held_out]
    assert len(held) > 150 and sum(got[d].lang_pred == lang for d, lang in held) / len(held) > 0.97
    kept = {r.doc_id for r in language.keep_known(docs, settings=language.Settings(landmarks=12, training=40)).select("doc_id").collect()}
    assert sum(d in kept for d, _, _ in rows) / len(rows) > 0.97


def test_quality_of_held_out_documents(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (4, 7), (None, 1), (999, 1)], "doc_id long, quality int")
    assert len(quality.classify(odd, marks).collect()) == odd.count()
    assert {r.score for r in quality.classify(odd, marks.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(odd, marks.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(empty(spark), marks).collect() == []


def test_quality_scores_against_plain_densities(spark):
    """Means, covariances and normal densities written out over the labelled rows, without sums or Cholesky factors."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    x = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs.collect()}
    own = {k: np.array([x[d] for d in sorted(x) if truth.get(d) == k and zlib.crc32(str(d).encode()) % 5]) for k in (0, 1)}
    n, d = sum(map(len, own.values())), len(quality.FEATURES)
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in own.values()) / n
    density = {}
    for k, v in own.items():
        shrunk = 0.9 * np.cov(v.T, bias=True) + 0.1 * pooled
        shrunk = 0.98 * shrunk + 0.02 * np.trace(shrunk) / d * np.eye(d)
        away = np.array(list(x.values())) - v.mean(axis=0)
        density[k] = np.log(len(v) / n) - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(shrunk), away) - 0.5 * np.linalg.slogdet(shrunk)[1]
    want = dict(zip(x, 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


# ---------------------------------------------------------------- language model


def plain_log10(model, classes):
    """Forward recursion in logarithms, without scaling."""
    with np.errstate(divide="ignore"):
        a = np.log(model.start) + np.log(model.emit[classes[0]])
        for c in classes[1:]:
            a = np.logaddexp.reduce(a[:, None] + np.log(model.move), axis=0) + np.log(model.emit[c])
    return np.logaddexp.reduce(a) / math.log(10)


def test_forward_and_expectations_match_enumeration():
    rng = np.random.default_rng(0)
    model = hmm.Hmm.first(rng.integers(1, 9, 6).astype(float), 3)
    sequences = [rng.integers(0, 6, n) for n in (1, 5, 3, 5, 2)]
    assert np.allclose(hmm.forward(model, sequences), [plain_log10(model, s) for s in sequences])
    k, c = 3, 6
    want = np.zeros(k + k * k + c * k)
    for s in sequences:
        paths = np.stack(np.meshgrid(*[range(k)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        p = model.start[paths[:, 0]] * model.emit[s[0], paths[:, 0]]
        for t in range(1, len(s)):
            p = p * model.move[paths[:, t - 1], paths[:, t]] * model.emit[s[t], paths[:, t]]
        p /= p.sum()
        np.add.at(want, paths[:, 0], p)
        for t in range(len(s)):
            np.add.at(want, k + k * k + s[t] * k + paths[:, t], p)
            if t:
                np.add.at(want, k + paths[:, t - 1] * k + paths[:, t], p)
    assert np.allclose(hmm.expected(model, sequences), want)


def test_expectations_carry_over_pieces():
    rng = np.random.default_rng(4)
    model = hmm.Hmm.first(rng.integers(1, 9, 20).astype(float), 3)
    sequences = [rng.integers(0, 20, n) for n in (1, 7, 8, 9, 40, 23, 40)]
    whole = hmm.expected(model, sequences)
    for piece in (1, 4, 8, 39):
        assert np.allclose(hmm.expected(model, sequences, piece), whole)
    assert math.isclose(whole[:3].sum(), len(sequences)) and math.isclose(whole[3:12].sum(), sum(len(s) - 1 for s in sequences))


def test_classes_grow_and_every_step_sees_all_texts(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 3000}" for j in range(300)) for i in range(400)]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(5)
    settings = hmm.Settings(states=2, classes=8, class_size=4, steps=1, first_steps=2, sample=5)
    corpus = hmm.count_corpus(docs, settings)
    v = len({w for t in texts for w in t.split()})
    assert len(corpus.class_counts) == math.ceil(v / 4) > 600
    model, of = hmm.Hmm.first(corpus.class_counts, 2), hmm.WordClasses(len(corpus.class_counts))
    sequences = [np.array([*map(of.__getitem__, t.encode().split()), 0]) for t in texts]
    for _ in range(3):
        model = hmm.Hmm.of_sums(hmm.expected(model, sequences), 2, corpus.class_counts)
    got = hmm.train_model(docs, corpus, settings)
    assert np.allclose(got.start, model.start) and np.allclose(got.move, model.move) and np.allclose(got.emit, model.emit, rtol=1e-4)


def test_scores_match_plain_counts(spark, odd):
    small = hmm.Settings(states=3, classes=64, sample=50, first_steps=2, steps=1, head=200)
    for docs in (table(spark, SF, "documents"), odd):
        got = hmm.score(docs, small).collect()
        tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        counts = Counter(w for r in docs.collect() if not held(r.doc_id) for w in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want = sorted((str(r.doc_id), held(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n, round(base(r.text), 6)) for r in docs.collect())
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(empty(spark), small).collect() == []
    unseen = hmm.score(spark.createDataFrame([(11, "a b")], "doc_id long, text string").where("doc_id % 2 = 1"), small).first()
    assert unseen.n_tokens == 3


def test_words_of_a_class_and_the_unseen_one_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c d"), (2, "b d d e")], "doc_id long, text string")
    corpus = hmm.count_corpus(docs.withColumn("text", F.col("text").cast("binary")), hmm.Settings(classes=4))
    rows = {bytes(r.word): r.c for r in corpus.counts.collect()}
    for cls in range(1, 4):
        own = [c for w, c in rows.items() if zlib.crc32(w) % 3 + 1 == cls]
        norm = corpus.class_counts[cls] + 0.1 * (corpus.class_words[cls] + 1)
        assert math.isclose(sum((c + 0.1) / norm for c in own) + 0.1 / norm, 1)


def test_model_beats_word_frequencies_on_held_out_texts(spark):
    got = [r for r in hmm.score(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# ---------------------------------------------------------------- decontamination


def plain_tiles(p, t, least):
    """Greedy tiling by definition: the longest free common run again and again."""
    p_free, t_free, n = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p_free[i + k] and t_free[j + k] and p[i + k] == t[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return n
        k, i, j = best[0], -best[1], -best[2]
        p_free[i : i + k], t_free[j : j + k] = [False] * k, [False] * k
        n += k


def test_tiling_matches_the_plain_greedy_one():
    random.seed(1)
    for _ in range(120):
        p, t = [random.randrange(4) for _ in range(random.randint(0, 25))], [random.randrange(4) for _ in range(random.randint(0, 40))]
        if random.random() < 0.6 and p:
            cut = random.randrange(len(p))
            t[5:5] = p[cut:] + [9] + p[:cut]
        code = lambda x: np.array([v * 7919 + 13 for v in x], np.uint64)
        found = decontaminate.tiles(code(p), code(t))
        assert all(p[i : i + k] == t[j : j + k] and k >= 4 for i, j, k in found)
        assert len({i + x for i, _, k in found for x in range(k)}) == len({j + x for _, j, k in found for x in range(k)}) == sum(k for *_, k in found)
        assert abs(sum(k for *_, k in found) - plain_tiles(p, t, 4)) <= 4  # ties between equal runs may end in other rests


def test_leaks_are_found_and_clean_documents_left(spark, words, odd):
    random.seed(9)
    items = [" ".join(random.choice(words) for _ in range(n)) for n in (40, 60, 12, 3)]
    prose = lambda n: [random.choice(words) for _ in range(n)]
    w = items[0].split()
    texts = [
        " ".join(prose(50) + items[0].upper().split() + prose(70)),
        " ".join(prose(30) + w[25:] + prose(9) + w[10:25] + prose(9) + w[:10]),  # sentences in another order
        " ".join(prose(20) + items[1].split()[:20] + prose(40)),  # a third only
        "; ".join(prose(20) + items[2].split()),
        " ".join(prose(400)),
        items[3],
    ]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (2, items[2])], "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), (1, 0), (3, 2), (3, 2), (5, 3)]
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4]
    assert decontaminate.clean_documents(odd, benchmark).count() == odd.count()
    assert decontaminate.contaminated(empty(spark), benchmark).collect() == decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []


def test_seed_join_loses_no_pair(spark):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in queries.op1_string_tiling(spark, SF).collect()}
    items = [(r.item_id, decontaminate.tokens(r.text)) for r in benchmark.collect()]
    want = {}
    for d in docs.collect():
        found = decontaminate.tokens(d.text)
        for item_id, item in items:
            n = sum(k for *_, k in decontaminate.tiles(decontaminate.hashes(item), decontaminate.hashes(found), min(4, len(item))))
            if n >= 0.6 * len(item):
                want[(d.doc_id, item_id)] = round(n / len(item), 9)
    assert got == want and want


def test_candidates_lose_no_pair_with_hot_seeds_and_short_items(spark, words, monkeypatch):
    random.seed(12)
    monkeypatch.setattr(decontaminate, "HOT_PAIRS", 20)
    few = words[:30]
    phrase = "which of the following statements is".split()
    pick = lambda n, source=few: [random.choice(source) for _ in range(n)]
    items = [pick(n) for n in (1, 2, 3, 4, 4, 5, 6, 8, 9, 15, 20, 40)] + [[*phrase, *pick(n, words)] for n in (2, 4, 9, 14, 20, 40, 14, 20)] + [pick(1) * 12]
    texts = []
    for item in items * 2:
        cuts = [item[i : i + 4] for i in range(0, len(item), 4)]  # tiles of four tokens in another order
        random.shuffle(cuts)
        texts.append(pick(5) + item + pick(3))
        texts.append([x for c in cuts for x in (*c, random.choice(words))])
        texts.append(phrase + pick(20))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered_tokens for r in decontaminate.contaminated(docs, benchmark).collect()}
    code, want = decontaminate.hashes, {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = sum(k for *_, k in decontaminate.tiles(code(item), code(t), min(4, len(item))))
            if n >= 0.6 * len(item):
                want[(d, i)] = n
    assert got == want and len(want) > 60


def test_shared_phrases_are_not_tiled(spark, words, monkeypatch):
    random.seed(13)
    phrase = "which of the following statements is"
    rows = [(i, f"{phrase} " + " ".join(random.choice(words) for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string")
    items = spark.createDataFrame([(i, f"{phrase} " + " ".join(random.choice(words) for _ in range(30))) for i in range(300)], "item_id long, text string")
    seen = []
    candidates = decontaminate._candidates
    monkeypatch.setattr(decontaminate, "_candidates", lambda *a: seen.append(candidates(*a)) or seen[0])
    assert decontaminate.matches(docs, items).count() == 0 and seen[0].count() < 100


# ---------------------------------------------------------------- preferences


def test_preference_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, chosen string"
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (3, 0, "user", "x"), (4, None, None, None), (4, 1, "assistant", "é")]
    chosen += [(1, 1, "assistant", "good"), (None, 0, "user", "u")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (2, 0, "user", "same"), (4, None, "", ""), (5, 0, "user", "y"), (None, 0, "user", "u")]
    frame = lambda rows: spark.createDataFrame([(*r, "c") for r in rows], schema)
    got = {r.pair_id: r for r in preference.format_pairs(frame(chosen), frame(rejected)).collect()}
    assert sorted(got) == [1, 2, 4]
    r = got[1]
    assert (r.n_common, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\ngood<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "good<|end|>\n" and r.rejected_mask == "14-25"
    assert got[2].chosen == got[2].rejected == got[2].chosen_mask == "" and got[2].n_common == 1
    assert got[4].prompt == "<||>\n<|end|>\n" and got[4].rejected == ""
    assert preference.format_pairs(frame([]), frame(rejected)).collect() == []


def test_rejected_sides_are_replies_to_something_else(spark):
    long = "very long " * 50_000
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"), (7, 0, "user", None), (7, None, None, None), (7, 1, "assistant", long), (7, 1, "assistant", long)]
    rows += [(3, 0, "user", "q3"), (9, None, "assistant", "a9"), (None, 0, "assistant", "none")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, reply int")
    chosen, rejected = preference.with_next_reply(frame)

    def plain(df):
        return sorted(map(tuple, df.collect()), key=str)

    kept = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"), (7, None, "", ""), (7, 0, "user", ""), (7, 1, "assistant", long), (9, None, "assistant", "a9")]
    replies = {"a1": long, long: "a9", "a9": "a1"}
    assert plain(chosen) == sorted(kept, key=str)
    assert plain(rejected) == sorted(((p, t, role, replies.get(text, text)) for p, t, role, text in kept), key=str)
    one = preference.with_next_reply(frame.where("conv_id = 1"))
    assert plain(one[0]) == plain(one[1]) == sorted(kept[:3], key=str)
    assert plain(preference.with_next_reply(frame.limit(0))[1]) == []


def test_next_replies_follow_the_order_of_ids_over_parts(spark):
    ids = random.Random(6).sample(range(100_000), 700)
    last = spark.createDataFrame([(i, f"r{i}") for i in ids], "pair_id long, reply string").repartition(4)
    got = {r.pair_id: r.reply for r in preference._next_replies(last).collect()}
    ordered = sorted(ids)
    assert got == {i: f"r{ordered[(k + 1) % len(ordered)]}" for k, i in enumerate(ordered)}


def test_every_conversation_with_a_reply_forms_a_whole_pair(spark):
    rows = [r for r in table(spark, "/root/testdata/sf0.01", "conversations").collect()]
    replied = {r.conv_id for r in rows if r.role == "assistant"}
    chosen, rejected = preference.with_next_reply(table(spark, "/root/testdata/sf0.01", "conversations"))
    want = sorted((r.conv_id, r.turn) for r in rows if r.conv_id in replied)
    assert sorted((r.pair_id, r.turn) for r in chosen.collect()) == sorted((r.pair_id, r.turn) for r in rejected.collect()) == want

