"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores and ``BENCH_RUNS`` the runs per query, of
which the fastest counts. The session has the settings the library ships and no others that change plans. The raw
entities are landed once, untimed; ``refresh`` takes them from landing files to published gold, ``refresh_again`` adds
the files of one month, and the other queries read silver or gold as the refresh wrote them. ``table_*`` queries start
from the star-schema tables instead, mapping included. ``work`` holds tasks, stages and shuffled megabytes of each
query's last run, from Spark's event log, to tell a changed plan from a busy host.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections import defaultdict
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaline.operators import dashboard, forecast, gold, review, serving
from quotaline.plans import catalog, refresh
from quotaline.plans.scratch import discard, scratch_folder
from quotaline.session import configure
from quotaline.sources import star
from quotaline.sources.landing import add_files, land_parquet
from quotaline.sources.schemas import GOLD_LAYOUT

FROM_TABLES = ("gold_rep_monthly_summary", "gold_invoice_details", "category_summary_region", "profile_values")


class Timer:
    """Fastest time of each action, over rounds through all of them so that all run equally warm."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seconds = spark, {}

    def run(self, runs: int, actions: dict[str, Callable[[], object]]) -> None:
        for _ in range(runs):
            for name, action in actions.items():
                self.spark.sparkContext.setLocalProperty("quotaline.bench", name)
                start = time.perf_counter()
                action()
                self.seconds[name] = round(min(self.seconds.get(name, float("inf")), time.perf_counter() - start), 3)


def work_done(folder: str) -> dict[str, dict[str, float]]:
    """Tasks, stages and shuffled MB by query, over all its runs."""
    name_of: dict[int, str] = {}
    out: dict[str, dict[str, float]] = defaultdict(lambda: {"stages": 0, "tasks": 0, "shuffle_mb": 0.0})
    for path in Path(folder).rglob("*"):
        for line in path.open(errors="replace") if path.is_file() else ():
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if event.get("Event") == "SparkListenerStageSubmitted":
                name_of[event["Stage Info"]["Stage ID"]] = (event.get("Properties") or {}).get("quotaline.bench", "")
                out[name_of[event["Stage Info"]["Stage ID"]]]["stages"] += 1
            elif event.get("Event") == "SparkListenerTaskEnd":
                written = ((event.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                entry = out[name_of.get(event["Stage ID"], "")]
                entry["tasks"] += 1
                entry["shuffle_mb"] += written / 1e6
    return out


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    events = tempfile.mkdtemp(prefix="quotaline-events-")
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("quotaline-bench"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", f"file://{events}")
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timer = Timer(spark)

    root = scratch_folder(spark, "bench")
    landing, lake = f"{root}/landing", f"{root}/lake"
    raw = catalog.Lake(spark, folder).raw
    late = F.col("invoice_date").startswith("1998-06")
    land_parquet({n: df.where(~late) if n == "invoices" else df for n, df in raw.items()}, landing)
    timer.run(1, {"refresh": lambda: refresh.refresh(spark, landing, lake, f"{root}/serving")})
    add_files("invoices", raw["invoices"].where(late), landing)
    published: dict[str, DataFrame] = {}
    timer.run(1, {"refresh_again": lambda: published.update(refresh.refresh(spark, landing, lake, f"{root}/serving"))})

    cleaned = refresh.read_silver(spark, lake)
    deals, reps = gold.open_deals(cleaned["deals"]), cleaned["sales_reps"]
    feedback = star.sales_feedback(deals, reps)
    summary, invoices, categories = (published[f"gold_{n}"] for n in ("rep_monthly_summary", "invoice_details", "category_summary"))
    tables = catalog.queries()
    actions: dict[str, Callable[[], DataFrame]] = {
        **{name: lambda name=name: refresh.GOLD[name](cleaned) for name in GOLD_LAYOUT},
        "current_month_kpis": lambda: dashboard.current_month_kpis(summary),
        "monthly_trend": lambda: dashboard.monthly_trend(summary),
        "deals_by_stage": lambda: dashboard.pipeline_by_stage(deals),
        "category_share": lambda: dashboard.category_share(categories),
        "category_summary_region": lambda: serving.category_summary(categories, invoices, catalog.REGION),
        "monthly_summary_rep": lambda: serving.monthly_summary(summary, catalog.REP),
        "invoice_details_region": lambda: serving.invoice_details(invoices, region=catalog.REGION),
        "adjustment_sheet": lambda: forecast.adjustment_sheet(deals, reps=reps),
        "feedback_review": lambda: review.feedback_review(feedback),
        "rep_adjusted_forecast": lambda: forecast.rep_adjusted_forecast(summary, feedback),
        **{f"table_{name}": lambda name=name: tables[name](spark, folder) for name in FROM_TABLES},
    }
    timer.run(runs, {name: lambda read=read: _drain(read()) for name, read in actions.items()})

    discard(spark)
    spark.stop()
    per_run = {name: runs if name in actions else 1 for name in timer.seconds}
    work = {name: {k: round(v / per_run[name], 1) for k, v in work.items()} for name, work in work_done(events).items() if name in per_run}
    line = {
        "metric": "headline_query_seconds",
        "value": round(sum(timer.seconds.values()), 3),
        "unit": "sec",
        "queries": timer.seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "work": work,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
