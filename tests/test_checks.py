"""Verification, text claims and search on small frames."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from marketspark.operators import claims, search, verify
from tests.test_market import frame, sale


def test_deviation_and_tolerance(spark):
    rows = [(0, 100.0, 101.0), (1, 100.0, 102.0), (2, -100.0, -99.5), (3, 0.0, 0.0), (4, 0.0, 0.005), (5, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "i int, e double, a double").orderBy("i")
    got = [tuple(r) for r in df.select(verify.matches("e", "a", 0.01), verify.deviation_pct("e", "a")).collect()]
    assert [g[0] for g in got] == [True, False, True, True, True, False]
    assert [g[1] for g in got] == [1.0, 2.0, 0.5, 0.0, float("inf"), float("inf")]


CLAIM = """claim_id string, year int, period_type string, period_num int, area string, property_type string, transaction_count long, total_volume double,
avg_price double, offplan_count long, offplan_percentage double, luxury_count long, luxury_percentage double"""


def test_claims_are_checked_in_one_pass(spark):
    sales = frame(spark, [sale(i, date(2024, 1 + i % 12, 28), ("A", "B")[i // 12 % 2], price=100.0) for i in range(48)])
    rows = [
        ("exact", 2024, "annual", 1, None, None, 48, 4800.0, 100.0, 48, 100.0, 0, 0.0),
        ("near", 2024, "quarterly", 2, "A", None, 6, 604.0, 100.9, None, None, None, None),
        ("off", 2024, "monthly", 12, None, "Villa", 5, 420.0, 150.0, 1, 50.0, None, None),
        ("nothing", 2023, "monthly", 1, None, None, 0, 0.0, 0.0, 0, 0.0, None, None),
        ("zero", 2023, "monthly", 1, None, None, 0, None, None, 0, 5.0, None, None),
        ("invalid", 2024, "quarterly", 5, None, None, 1, None, None, None, None, None, None),
    ]
    checks = verify.run_checks(spark.createDataFrame(rows, CLAIM), sales)
    got = {}
    for r in checks.collect():
        got.setdefault(r["claim_id"], {})[r["test_name"]] = r["status"]
    assert set(got["exact"].values()) == {"PASS"} and "period_boundaries" not in got["exact"]
    assert got["near"] == {"period_boundaries": "PASS", "date_range": "PASS", "transaction_count": "PASS", "total_volume": "PASS", "avg_price": "PASS"}
    assert got["off"] == {"date_range": "PASS", "transaction_count": "FAIL", "total_volume": "FAIL", "avg_price": "FAIL", "offplan_pct": "FAIL"}
    assert set(got["nothing"].values()) == {"PASS"} and got["zero"]["offplan_pct"] == "FAIL"
    assert got["invalid"] == {"period_boundaries": "FAIL", "date_range": "ERROR", "transaction_count": "ERROR"}
    summary = verify.status_summary(checks).first()
    assert summary["total_tests"] == sum(len(v) for v in got.values()) and summary["error"] == 2
    assert verify.report_table(checks).first()["status"] == "FAIL"


TEXTS = [
    ("a", "area: Marina\nThe average is aed 1,234,567.50 over 1,234 transactions, up 12.5% or AED1,000 for 5 units."),
    ("b", "# Palm Real Estate\nNothing to count here, AED soon."),
    ("c", "Sales 7 properties and 1,000,000 people; 45 sqm; AED 10 AED 10 AED 20, 3.5 %"),
    ("d", ""),
    ("e", None),
]


def test_numbers_are_extracted(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string")
    got = {r["doc_id"]: (r["currency_values"], r["count_values"], r["percentage_values"]) for r in claims.with_numbers(docs).collect()}
    assert got["a"] == ([1234567.5, 1000.0], [1234.0, 5.0], [12.5])
    assert got["b"] == ([], [], []) and got["c"][0] == [10.0, 10.0, 20.0] and got["c"][1] == [7.0]


def test_figures_are_distinct_with_context(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string")
    got = {(r["doc_id"], r["kind"], r["value"]): r["context"] for r in claims.figures(docs).collect()}
    assert {k[1:] for k in got if k[0] == "c"} == {
        ("price", 10.0), ("price", 20.0), ("percentage", 3.5), ("count", 7.0), ("area", 45.0), ("large_number", 1000000.0)
    }
    assert got[("c", "price", 20.0)] == TEXTS[2][1].replace("\n", " ")[-(50 + 6 + 7):].strip()
    text = TEXTS[0][1]
    at = text.index("1,234 transactions")
    assert got[("a", "count", 1234.0)] == text[at - 50:at + len("1,234 transactions") + 50].replace("\n", " ").strip()


def test_subjects(spark):
    rows = [
        ("area: Marina Bay \n# Other Real Estate", "area_guide_palm.md", "Marina Bay"), ("# Palm Real Estate 2024", "page.md", "Palm"),
        ("# Palm Real Estate 2024", "area_guide_dubai_hills.md", "Dubai Hills"), ("nothing", "page.md", None),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(rows)], "i int, text string, file_name string").orderBy("i")
    assert [r[0] for r in df.select(claims.subject("text", "file_name")).collect()] == [r[2] for r in rows]


def test_phrases_mentions_and_years(spark):
    docs = spark.createDataFrame(
        [("a", "Prices Are EXPECTED TO rise in dubai marina. Dubai Marina!", "Dubai Marina"), ("b", "Marina dubai in 2011 and 2012", "Dubai Marina")],
        "doc_id string, text string, subject string",
    )
    issues = {r["doc_id"]: (r["phrases"], r["names_subject"], r["is_valid"]) for r in claims.content_issues(docs).collect()}
    assert issues == {"a": (["expected to"], True, False), "b": ([], False, False)}
    names = spark.createDataFrame([("Dubai Marina",), ("Marina",), ("Palm",), ("Rise in Dubai Marina Dubai Marina",)], "name string")
    got = {(r["doc_id"], r["name"]): r["mentions"] for r in claims.mentions(docs, names, "name").collect()}
    assert got == {("a", "Dubai Marina"): 2, ("a", "Marina"): 2, ("b", "Marina"): 1, ("a", "Rise in Dubai Marina Dubai Marina"): 1}
    years = {r["doc_id"]: r["y"] for r in docs.select("doc_id", claims.stale_year("text", 2013).alias("y")).collect()}
    assert years == {"a": None, "b": 2011}
    assert docs.select(claims.stale_year("text", 2012)).where("doc_id = 'b'").first()[0] is None


def test_mentions_meet_the_names_before_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7, f"palm jumeirah {i} marina palm {i % 3} creek harbour") for i in range(60)] + [(8, None), (9, "")], "doc_id int, text string")
    names = spark.createDataFrame([("Palm",), ("Palm Jumeirah",), ("PALM",), ("Creek Harbour",), ("None",), (None,)], "name string")
    near = claims.mentions(docs, names, "name")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(doc_id") < plan.index("BroadcastHashJoin") < plan.index("Generate explode")
    monkeypatch.setattr(claims, "NAMES_BYTES", 0)
    far = claims.mentions(docs, names, "name")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(near) == rows(far) and len(rows(near)) == 28 and claims.mentions(docs, names.limit(0), "name").count() == 0


def test_expected_ctr_and_scores(spark):
    places = [(0, 0.5), (1, 1.0), (2, 4.9), (3, 10.0), (4, 11.0), (5, 35.0)]
    df = spark.createDataFrame([(i, p, 0.0, 500) for i, p in places], "i int, position double, ctr double, impressions int").orderBy("i")
    got = df.select(search.expected_ctr("position"), search.opportunity_score()).collect()
    assert [r[0] for r in got] == [0.01, 0.28, 0.08, 0.02, 0.02, 0.02]
    assert [round(r[1], 4) for r in got] == [57.0, 57.0, 57.0, 85.0, pytest.approx(82.3333, abs=1e-3), pytest.approx((1 - 15 / 80) * 40 + 45, abs=1e-3)]


def _queries(spark, rows):
    df = spark.createDataFrame([("/p", q, c, i, c / i, float(p)) for q, c, i, p in rows], "page string, query string, clicks long, impressions long, ctr double, position double")
    return search.scored_queries(df)


def test_content_gaps(spark):
    scored = _queries(spark, [
        ("villa prices", 0, 60, 12), ("rare thing", 0, 4, 12), ("marina towers", 0, 30, 9), ("palm beach", 1, 6, 5), ("marina guide", 0, 30, 2), ("guide", 40, 50, 1)
    ])
    content = spark.createDataFrame([("/p", "Marina Guide", "", "Marina guide", "marina guide, towers on the palm beach")], "page string, title string, h1 string, h2 string, content string")
    covered = search.with_coverage(scored, content)
    gaps = {r["query"]: (r["gap_type"], r["priority"], r["potential_clicks"]) for r in search.content_gaps(covered).collect()}
    assert gaps == {
        "villa prices": ("missing_section", "high", 6), "marina towers": ("meta_mismatch", "high", 3), "palm beach": ("weak_coverage", "medium", 0), "marina guide": ("meta_mismatch", "high", 0)
    }
    order = [r["query"] for r in search.content_gaps(covered).orderBy("gap_rank").collect()]
    assert order == ["villa prices", "marina towers", "marina guide", "palm beach"]


def test_cohorts_and_study(spark):
    rows = [(date(2024, 1, d), "/p", q, 1, i, 0.0, float(p)) for d, q, i, p in ((1, "a", 10, 5), (1, "b", 10, 5), (20, "a", 20, 8), (20, "c", 5, 3), (21, "c", 5, 5))]
    df = spark.createDataFrame(rows, "date date, page string, query string, clicks long, impressions long, ctr double, position double")
    got = {r["query"]: r["cohort"] for r in search.query_cohorts(df, date(2024, 1, 16)).collect()}
    assert got == {"a": "worsened", "b": "lost", "c": "new"}
    study = {r["measure"]: (r["before"], r["after"]) for r in search.before_after(df, date(2024, 1, 16)).collect()}
    assert study["impressions"] == (20.0, 30.0) and study["clicks_per_day"] == (2.0, 1.5)
    assert study["position"] == (5.0, pytest.approx((8 * 20 + 3 * 5 + 5 * 5) / 30))


def test_long_query_lists_go_on_in_parts(spark):
    scored = _queries(spark, [(f"q{i}", i, 10 + i, 5) for i in range(6)])
    parts = {r["part"]: [q["query"] for q in r["query_list"]] for r in search.nested_queries(scored, limit=5).collect()}
    assert parts == {0: ["q5", "q4", "q3", "q2", "q1"], 1: ["q0"]}
    assert len(search.nested_queries(scored, limit=6).first()["query_list"]) == 6
    assert scored.select(F.max("opportunity_score")).first()[0] <= 100
