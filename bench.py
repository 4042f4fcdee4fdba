"""Times the headline jobs and prints one JSON line.

The sales are loaded once into a table (timed as "load_transactions"), as a deployment does; the
reports then read that table. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import tempfile
import time
from datetime import date

sys.stdout, _out = sys.stderr, sys.stdout

from marketspark.functions.periods import Period  # noqa: E402
from marketspark.operators import anomalies, lookups, metrics, profiles, reports, supply, supply_ingest, trends, verify  # noqa: E402
from marketspark.catalog import search_queries, verify_queries  # noqa: E402
from marketspark.session import session  # noqa: E402
from marketspark.sources import driver_tables as tables  # noqa: E402
from marketspark.sources.sinks import replace_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", CPUS, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    timings: dict[str, float] = {}

    def timed(name, action):
        # The better of two runs, so that the start of the engine and code generation are not counted.
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            action()
            runs.append(time.perf_counter() - started)
        timings[name] = round(min(runs), 4)

    def load():
        replace_table(tables.transactions(spark, SF_DIR), f"{folder}/sales")

    def load_supply():
        replace_table(supply_ingest.enrich(tables.supply_raw(spark, SF_DIR)), f"{folder}/projects")

    timed("load_transactions", load)
    timed("load_supply", load_supply)
    sales = spark.read.parquet(f"{folder}/sales")
    projects = supply_ingest.clean_projects(spark.read.parquet(f"{folder}/projects"))
    q2, keys = Period(2000, "quarterly", 2), ["area_name_en"]
    areas = supply.supply_demand_areas(sales, projects, 1999, 2000, (2001, 2002, 2003))
    replace_table(verify_queries._claims(spark, SF_DIR), f"{folder}/claims")
    placed = verify.with_facts(spark.read.parquet(f"{folder}/claims"), verify.period_facts(sales))
    jobs = {
        "p3_period_metrics": lambda: reports.period_metrics(sales, q2),
        "p5_period_comparison": lambda: reports.period_comparison(sales, q2),
        "p6_top_performers": lambda: reports.top_performers(sales, q2),
        "p8_area_summaries": lambda: reports.area_summaries(sales, q2),
        "p9_market_overview": lambda: reports.market_period_overview(sales, q2),
        "p10_time_series": lambda: reports.time_series(sales, Period(1999, "monthly", 7), Period(2000, "monthly", 6)),
        "m1_area_metrics": lambda: metrics.area_metrics(sales),
        "m3_monthly_trends": lambda: metrics.monthly_trends(sales),
        "m10_project_metrics": lambda: metrics.project_metrics(sales),
        "a3_volume_spikes": lambda: anomalies.volume_spikes(sales, q2),
        "t6_combined_trends": lambda: trends.combined_trends(sales, keys, date(2000, 11, 30), date(1998, 1, 1)),
        "c1_area_dna": lambda: profiles.area_dna(sales, tables.SAMPLE.segment_edges),
        "u1_supply_demand_areas": lambda: areas,
        "u10_area_dossiers": lambda: supply.area_dossiers(areas, supply.supply_timeline(projects), projects, "Q1 2001"),
        "v1_count_checks": lambda: verify.check_count(placed),
        "g8_content_gaps": lambda: search_queries.gaps(spark, SF_DIR),
        "l8_transactions": lambda: lookups.transactions(sales, "NATION_7", year=2000),
    }
    for name, build in jobs.items():
        timed(name, lambda: build().write.format("noop").mode("overwrite").save())
    result = {"metric": "total seconds of headline jobs", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/"))}
    print(json.dumps(result), file=_out, flush=True)


if __name__ == "__main__":
    main()
