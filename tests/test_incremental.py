"""Delta updates of gold and the serving copy: what is read, what is written, and that it equals a full recompute."""

from __future__ import annotations

import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quotaline.operators import dashboard, serving
from quotaline.plans import refresh as plan
from quotaline.plans.refresh import refresh
from quotaline.sinks import folders, manifest, snapshot
from quotaline.sinks.snapshot import read_gold
from quotaline.sources.landing import add_files
from tests.conftest import dec


def tables(frames, seed=0, reps=6, customers=5, facts=60):
    rng = random.Random(seed)
    rep = lambda: rng.choice([None, *(f"R{k}" for k in range(reps + 2))])  # noqa: E731  some are in no dimension
    customer = lambda: rng.choice([None, *(f"C{k}" for k in range(customers + 1))])
    day = lambda: f"2024-{rng.randrange(1, 5):02d}-{rng.randrange(1, 28):02d}"
    category = lambda: rng.choice([None, "Networking", "Cloud", "Other"])
    return {
        "sales_reps": frames.reps(*({"rep_id": f"R{k}", "rep_name": f"Rep {k}", "region": "EAST" if k % 2 else "WEST"} for k in range(reps))),
        "customers": frames.customers(*({"customer_id": f"C{k}", "customer_name": f"Customer {k}"} for k in range(customers))),
        "invoices": frames.invoices(*({"invoice_id": f"I{seed}-{k}", "rep_id": rep(), "customer_id": customer(), "invoice_date": day(), "invoice_amount": rng.randrange(1, 9999) / 100, "product_category": category()} for k in range(facts))),
        "orders": frames.orders(*({"order_id": f"O{seed}-{k}", "rep_id": rep(), "order_date": day(), "order_amount": rng.randrange(1, 9999) / 100} for k in range(facts))),
        "deals": frames.deals(*({"deal_id": f"D{seed}-{k}", "rep_id": rep(), "customer_id": customer(), "expected_close_date": day()} for k in range(facts))),
    }


class Lake:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.landing, self.out, self.serving = (str(folder / n) for n in ("landing", "lake", "serving"))

    def land(self, **more):
        for name, rows in more.items():
            add_files(name, rows.coalesce(1), self.landing)

    def refresh(self, **options):
        return refresh(self.spark, self.landing, self.out, self.serving, **options)

    def state(self):
        return folders.published(self.spark, self.out)

    def paths(self, table):
        return {e["path"] for e in manifest.entries(self.state()["tables"][table])}

    def equals_recompute(self, dedupe=False):
        cleaned = plan.read_silver(self.spark, self.out)
        if dedupe:
            cleaned = {n: plan.silver.newest_by_key(rows.drop(plan.BATCH), plan.ENTITIES[n].key) for n, rows in cleaned.items()}
        for name, build in plan.GOLD.items():
            want = build(cleaned)
            for root in (self.out, self.serving):
                got = read_gold(self.spark, root)[name]
                assert got.dtypes == want.dtypes, name
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (name, root)
        return True


@pytest.fixture(scope="module")
def lake(spark, frames, tmp_path_factory):
    """A lake that the tests go on with, one after another: each states what it adds to whatever is there."""
    lake = Lake(spark, tmp_path_factory.mktemp("lake"))
    lake.land(**tables(frames))
    lake.refresh()
    return lake


def test_new_facts_are_merged_into_states(lake, frames):
    more = tables(frames, 1, facts=7)
    lake.land(invoices=more["invoices"], deals=more["deals"], orders=more["orders"])
    lake.refresh()
    assert lake.equals_recompute()


def test_a_renamed_rep_rewrites_only_its_files(spark, frames, tmp_path):
    lake = Lake(spark, tmp_path)
    days = {"R0": "2024-01-10", "R1": "2024-02-10", "R2": "2024-03-10", "R9": "2024-03-12"}
    start = tables(frames) | {
        "invoices": frames.invoices(*({"invoice_id": f"I{r}", "rep_id": r, "invoice_date": d} for r, d in days.items())),
        "orders": frames.orders(*({"order_id": f"O{r}", "rep_id": r, "order_date": d} for r, d in days.items())),
        "deals": frames.deals(*({"deal_id": f"D{r}", "rep_id": r, "expected_close_date": d} for r, d in days.items())),
    }
    lake.land(**start)
    lake.refresh(dedupe=True)
    first, served = {t: lake.paths(t) for t in plan.GOLD}, folders.published(spark, lake.serving)["tables"]
    renamed = frames.reps(*({"rep_id": f"R{k}", "rep_name": "New name" if k == 1 else f"Rep {k}", "region": "EAST" if k % 2 else "WEST"} for k in range(6)))
    lake.land(sales_reps=renamed)  # all reps once more, one of them changed
    lake.refresh(dedupe=True)
    assert lake.equals_recompute(dedupe=True)
    for table in plan.GOLD:
        gone = {p.split("=")[1].split("/")[0] for p in first[table] - lake.paths(table)}
        assert gone == ({"2024-02"} if table != "gold_category_summary" else set()), table
        now = folders.published(spark, lake.serving)["tables"][table]
        assert {m for m in now if now[m] != served[table][m]} == gone
    assert {r.rep_name for r in read_gold(spark, lake.serving)["gold_invoice_details"].where("rep_id = 'R1'").collect()} == {"New name"}


def test_changed_dimensions_and_new_facts_at_once(lake, frames, monkeypatch):
    more = tables(frames, 3, facts=9)
    lake.land(invoices=more["invoices"], orders=more["orders"], deals=more["deals"])
    lake.land(sales_reps=frames.reps({"rep_id": "R6", "rep_name": "Came late"}, {"rep_id": "R2", "rep_name": "Twice now"}))
    lake.land(customers=frames.customers({"customer_id": "C5", "customer_name": "Came late"}))
    with monkeypatch.context() as m:
        m.setattr(plan, "FEW_KEYS", 0)  # keys are joined
        lake.refresh()
    lake.land(customers=frames.customers({"customer_id": "C1", "customer_name": "Again"}))
    before = lake.paths("gold_rep_monthly_summary")
    lake.refresh()
    assert lake.equals_recompute() and lake.paths("gold_rep_monthly_summary") == before


def test_changed_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "x"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "y"), (4, "x"), (None, "n")], "k int, v string")
    assert sorted(r.k for r in plan.changed_keys(old, new, "k").collect()) == [2, 3, 5]


def test_months_with_many_files_are_rewritten(lake, frames, monkeypatch):
    monkeypatch.setattr(plan, "MOST_FILES", 1)
    for k in range(2):
        lake.land(invoices=frames.invoices({"invoice_id": f"N{k}", "rep_id": "R1", "invoice_date": "2024-02-03"}))
        lake.refresh()
    files = lake.state()["tables"]["gold_invoice_details"]
    assert len(files["2024-02"]) == 1 and lake.equals_recompute()


def test_refreshes_that_change_nothing_publish_nothing(lake, spark):
    numbers = [folders.published(spark, r)["number"] for r in (lake.out, lake.serving)]
    lake.refresh()
    assert [folders.published(spark, r)["number"] for r in (lake.out, lake.serving)] == numbers


def test_change_feed(lake, frames, spark):
    old = lake.state()
    copies = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in read_gold(spark, lake.out).items()}
    more = tables(frames, 5, facts=6)
    lake.land(invoices=more["invoices"], deals=more["deals"], sales_reps=frames.reps({"rep_id": "R7", "rep_name": "Came late"}))
    lake.refresh()
    kinds = set()
    for table in plan.GOLD:
        feed = snapshot.changes(spark, lake.out, table, old, lake.state())
        kinds |= {r.change for r in feed.select("change").distinct().collect()}
        got = snapshot.applied(copies[table], feed)
        assert sorted(map(str, got.collect())) == sorted(map(str, read_gold(spark, lake.out)[table].collect())), table
        assert feed.count() <= 2 * copies[table].count() and snapshot.changes(spark, lake.out, table, old, old).count() == 0
    assert kinds >= {"insert", "update_before", "update_after"}
    back = snapshot.changes(spark, lake.out, "gold_invoice_details", lake.state(), old)
    assert {r.change for r in back.select("change").distinct().collect()} >= {"delete"}


def dated(spark, root, days, rows_a_file=5):
    """A published table of invoices, files of a few rows within each month."""
    files: dict = {}
    for month in sorted({d[:7] if d else manifest.NO_MONTH for d in days}):
        own = sorted((d or "", f"I{k:04d}", f"R{k % 4}") for k, d in enumerate(days) if (d[:7] if d else manifest.NO_MONTH) == month)
        for n in range(0, len(own), rows_a_file):
            folder = f"version-x/t-{n}"
            frame = spark.createDataFrame([(d or None, i, r) for d, i, r in own[n : n + rows_a_file]], "invoice_date string, invoice_id string, rep_id string")
            frame = frame.withColumn("invoice_date", F.col("invoice_date").cast("date")).withColumn(manifest.PART, F.lit(month))
            frame.coalesce(1).write.mode("append").partitionBy(manifest.PART).parquet(f"{root}/{folder}-{month}")
            for m, some in manifest.described(spark, root, f"{folder}-{month}", "invoice_date").items():
                files.setdefault(m, []).extend(some)
    folders.publish(spark, root, {"tables": {"gold_invoice_details": files}})
    return files


def newest(spark, root, rows, **options):
    return manifest.newest(spark, root, "gold_invoice_details", "invoice_date", "invoice_id", rows, **options)


def brute(days, rows, keep=lambda k: True):
    """Rows without a day first, then the latest."""
    some = [(d, k) for k, d in enumerate(days) if keep(k)]
    return [f"I{k:04d}" for d, k in sorted(some, key=lambda x: (x[0] is not None, -date.fromisoformat(x[0] or "0001-01-01").toordinal(), x[1]))][:rows]


def test_newest_rows_open_few_files(spark, tmp_path):
    rng = random.Random(8)
    days = [f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(150)]
    files = dated(spark, str(tmp_path), days)
    whole = len(manifest.entries(files))
    for rows in (1, 4, 12, 40, 150, 500):
        got = newest(spark, str(tmp_path), rows)
        assert [r.invoice_id for r in got.collect()] == brute(days, rows)
        opened = len(got.inputFiles())
        assert opened <= rows / 5 + 6 and (opened == whole) == (rows >= 150), (rows, opened, whole)


def test_newest_rows_with_ties_across_months_and_files(spark, tmp_path):
    days = ["2024-02-01"] * 9 + ["2024-01-31"] * 12 + ["2024-01-30"] * 3 + [None] * 3 + ["2023-05-05"] * 30
    dated(spark, str(tmp_path), days)
    for rows in (1, 3, 4, 11, 13, 22, 24, 26, 27, 60):
        got = newest(spark, str(tmp_path), rows)
        assert [r.invoice_id for r in got.collect()] == brute(days, rows), rows
        assert len(got.inputFiles()) < 13 or rows == 60


def test_newest_rows_under_a_filter(spark, tmp_path):
    rng = random.Random(2)
    days = [f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(120)]
    files = dated(spark, str(tmp_path), days)
    for rows in (1, 5, 20, 200):
        got = newest(spark, str(tmp_path), rows, rep_id="R1")
        assert [r.invoice_id for r in got.collect()] == brute(days, rows, lambda k: k % 4 == 1)
        got = newest(spark, str(tmp_path), rows, kept=F.col("invoice_id") < "I0030")
        assert [r.invoice_id for r in got.collect()] == brute(days, rows, lambda k: k < 30)
    assert len(newest(spark, str(tmp_path), 2, rep_id="R1").inputFiles()) < len(manifest.entries(files)) / 2
    assert newest(spark, str(tmp_path), 5, rep_id="none such").collect() == []
    assert newest(spark, str(tmp_path), 5, rep_id="R1", kept=F.lit(False)).collect() == []


def test_reads_of_published_gold(lake, spark):
    gold = read_gold(spark, lake.out)
    for rep, region in ((None, None), ("R1", None), (None, "EAST"), ("R1", "EAST"), ("R2", "EAST")):
        for root in (lake.out, lake.serving):
            got = serving.published_invoice_details(spark, root, rep, region, rows=9)
            want = serving.invoice_details(gold["gold_invoice_details"], rep, region, rows=9)
            shown = [[(r.invoice_date, r.invoice_id) for r in df.collect()] for df in (got, want)]  # a rep twice makes a row twice
            assert shown[0] == shown[1]
    for as_of in (None, date(2024, 3, 15), date(2024, 2, 1), date(2020, 1, 1)):
        month = manifest.latest_month(spark, lake.out, as_of=as_of)
        whole = dashboard.current_month_kpis(gold["gold_rep_monthly_summary"], as_of)
        assert dashboard.current_month_kpis(month).collect() == whole.collect()
        assert {f.split("month_part=")[1][:7] for f in month.inputFiles()} <= {"2024-04", "2024-03", "2024-02", "2024-01"} and len(month.inputFiles()) <= 1


def test_only_one_writer_publishes_a_number(spark, tmp_path):
    root = str(tmp_path)

    def write(k):
        try:
            return folders.publish(spark, root, {"tables": {}, "by": k}, after=None if k < 0 else 0)["by"]
        except FileExistsError:
            return None

    assert write(-1) == -1
    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(write, range(8)) if k is not None]
    assert len(won) == 1 and folders.published(spark, root) == {"tables": {}, "by": won[0], "number": 1}
    assert [f.name for f in (tmp_path / folders.VERSIONS).iterdir() if f.name.startswith("_draft")] == []


def test_sweep_leaves_what_another_refresh_writes(spark, tmp_path):
    for name in ("version-a", "version-b", "version-c", "version-writing", "version-abandoned"):
        (tmp_path / name).mkdir()
    for name in "abc":
        folders.publish(spark, str(tmp_path), {"tables": {"t": {"m": [{"path": f"version-{name}/t"}]}}})
    old = time.time() - folders.LEASE - 60
    os.utime(tmp_path / "version-abandoned", (old, old))
    folders.sweep(spark, str(tmp_path))
    assert {p.name for p in tmp_path.glob("version-*")} == {"version-b", "version-c", "version-writing"}


def test_a_refresh_that_lost_the_race_changes_nothing(lake, frames, spark, monkeypatch):
    lake.land(invoices=frames.invoices({"invoice_id": "X", "rep_id": "R1"}))
    publish = plan.Version.publish

    def late(self, **more):
        folders.publish(spark, lake.out, {k: v for k, v in lake.state().items() if k != "number"})  # another was faster
        publish(self, **more)

    monkeypatch.setattr(plan.Version, "publish", late)
    with pytest.raises(FileExistsError):
        lake.refresh()
    assert read_gold(spark, lake.out)["gold_invoice_details"].where("invoice_id = 'X'").count() == 0
    monkeypatch.undo()
    lake.refresh()
    assert lake.equals_recompute()


def test_rejected_rows_are_counted_while_silver_is_written(spark, frames, tmp_path, monkeypatch):
    lake = Lake(spark, tmp_path)
    odd = [{"invoice_id": "ok"}, {"invoice_id": None, "status": None}, {"invoice_id": "a", "invoice_amount": 0.0}, {"invoice_id": "b", "invoice_amount": None, "status": None}, {"invoice_id": "c", "status": None}, {"invoice_id": "d", "status": "Cancelled"}, {"invoice_id": "tiny", "invoice_amount": 0.004}]
    lake.land(**(tables(frames) | {"invoices": frames.invoices(*odd)}))
    lake.refresh()
    lake.land(invoices=frames.invoices({"invoice_id": None}, {"invoice_id": "e"}))
    monkeypatch.setattr(plan, "_store_counts", lambda *_: None)  # as if the run ended just before
    lake.refresh()
    monkeypatch.undo()
    for _ in range(2):
        found = {(r.entity, r.fate): r.n for r in plan.rejected_rows(spark, lake.out).collect()}
        assert {f: n for (e, f), n in found.items() if e == "invoices"} == {"kept": 3, "no id": 2, "no amount": 2, "no status": 1, "cancelled": 1}
        for name in plan.SILVER:
            assert sum(n for (e, _), n in found.items() if e == name) == plan.read_bronze(spark, name, f"{lake.out}/bronze_{name}").count()
            assert found[name, "kept"] == plan.read_silver(spark, lake.out)[name].count()


def test_a_late_row_reads_no_other_fact(lake, frames, spark):
    """The facts before are replaced by others behind the refresh's back; sums still come from the states."""
    before = {r.month_date: r.total_invoiced for r in read_gold(spark, lake.out)["gold_category_summary"].groupBy("month_date").agg(F.sum("total_invoiced").alias("total_invoiced")).collect()}
    silver = Path(lake.out) / "silver_invoices" / f"{plan.BATCH}=0"
    details = read_gold(spark, lake.out)["gold_invoice_details"].count()
    rows = spark.read.parquet(str(silver)).withColumn("invoice_amount", F.col("invoice_amount") * 0 + 1).withColumn("invoice_amount", F.col("invoice_amount").cast("decimal(18,2)"))
    held = rows.collect()
    for file in silver.iterdir():
        file.unlink()
    spark.createDataFrame(held, rows.schema).write.mode("append").parquet(str(silver))
    lake.land(invoices=frames.invoices({"invoice_id": "late", "rep_id": "R0", "customer_id": "C0", "invoice_date": "2024-02-03", "invoice_amount": 7.0}))
    lake.refresh()
    after = {r.month_date: r.total_invoiced for r in read_gold(spark, lake.out)["gold_category_summary"].groupBy("month_date").agg(F.sum("total_invoiced").alias("total_invoiced")).collect()}
    assert after == {m: v + (dec("7.00") if m == date(2024, 2, 1) else 0) for m, v in before.items()}
    now = read_gold(spark, lake.out)["gold_invoice_details"]
    assert now.where("invoice_id = 'late'").count() == 1 and now.count() == details + 1
