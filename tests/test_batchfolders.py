"""Batches merged level by level: few folders, every row once, whatever step a crash comes at."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quotaline.plans import refresh as plan
from quotaline.plans.refresh import refresh
from quotaline.sinks import batchfolders, folders
from quotaline.sinks.snapshot import read_gold
from quotaline.sources.landing import add_files, land_parquet
from quotaline.streaming import bronze
from tests.test_streaming import raw


def batch(table, n, rows=2, **more):
    """Written without Spark, as quickly as a thousand of them ask for."""
    folder = Path(table) / f"{batchfolders.BATCH}={n}"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"id": [n * 10 + k for k in range(rows)], **{c: [v] * rows for c, v in more.items()}}), folder / "part-0.parquet")


def held(spark, table, only=None):
    rows = batchfolders.read(spark, str(table), only)
    return sorted((r.id, r[batchfolders.BATCH]) for r in rows.collect()) if rows is not None else []


def want(numbers, rows=2):
    return sorted((n * 10 + k, n) for n in numbers for k in range(rows))


def live(spark, table):
    """Folders that a reader opens."""
    state = batchfolders._state(spark, str(table))
    return len(batchfolders._merged(state)) + len(batchfolders._alone(spark, str(table), state))


def test_a_thousand_batches_lie_in_few_folders(spark, tmp_path):
    """Batches come in lots, as a backlog does; a level has fewer than eight folders."""
    made = 0
    for lot in (1, 7, 1, 70, 9, 412, 100, 400):
        for n in range(made, made + lot):
            batch(tmp_path, n, rows=1)
        made += lot
        batchfolders.compact(spark, str(tmp_path))
        assert batchfolders.numbers(spark, str(tmp_path)) == list(range(made))
        assert live(spark, tmp_path) <= 8 * 4
    assert held(spark, tmp_path) == want(range(1000), 1)
    assert batchfolders.compact(spark, str(tmp_path)) == 0  # removes what the last one left for its readers
    assert len(list(tmp_path.glob(f"{batchfolders.BATCH}=*"))) <= 8
    assert len(list(tmp_path.glob("version-*"))) <= 8 * 3
    assert held(spark, tmp_path, [0, 511, 512, 999]) == want([0, 511, 512, 999], 1)


@pytest.mark.parametrize("step", ["write", "publish", "remove", "sweep"])
def test_a_crash_at_any_step(spark, tmp_path, monkeypatch, step):
    for n in range(13):
        batch(tmp_path, n)
    batchfolders.compact(spark, str(tmp_path), fanout=4)
    for n in range(13, 30):
        batch(tmp_path, n)

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step != "write":
            m.setattr(folders, step, lost)
        with pytest.raises(RuntimeError, match="lost"):
            batchfolders.compact(spark, str(tmp_path), lost if step == "write" else lambda rows: rows, fanout=4)
        assert held(spark, tmp_path) == want(range(30))
    assert held(spark, tmp_path) == want(range(30))
    assert batchfolders.compact(spark, str(tmp_path), fanout=4) > 0
    assert held(spark, tmp_path) == want(range(30)) and live(spark, tmp_path) <= 12


def test_a_reader_of_the_state_before_keeps_its_files(spark, tmp_path):
    for n in range(9):
        batch(tmp_path, n)
    reader = batchfolders.read(spark, str(tmp_path))
    assert batchfolders.compact(spark, str(tmp_path)) == 1
    assert sorted(r.id for r in reader.collect()) == [i for i, _ in want(range(9))]


def test_columns_that_came_later(spark, tmp_path):
    for n in range(5):
        batch(tmp_path, n)
    batch(tmp_path, 5, colour="red")
    batchfolders.compact(spark, str(tmp_path), fanout=2)
    batch(tmp_path, 6, colour="blue")
    rows = batchfolders.read(spark, str(tmp_path)).collect()
    assert {(r.id, r.colour) for r in rows} >= {(0, None), (50, "red"), (61, "blue")} and len(rows) == 14


def test_the_newest_batch_can_be_written_again(spark, tmp_path):
    for n in range(5):
        batch(tmp_path, n)
    batchfolders.compact(spark, str(tmp_path), fanout=2)
    assert batchfolders._alone(spark, str(tmp_path), batchfolders._state(spark, str(tmp_path))) == [4]
    folders.remove(spark, f"{tmp_path}/{batchfolders.BATCH}=4")
    batch(tmp_path, 4, rows=3)
    assert held(spark, tmp_path) == sorted(want(range(4)) + want([4], 3))


def test_refreshes_go_on_over_merged_batches(spark, frames, tmp_path):
    landing, lake = str(tmp_path / "landing"), str(tmp_path / "lake")
    land_parquet(raw(frames), landing)
    refresh(spark, landing, lake)
    for k in range(3):
        add_files("invoices", frames.invoices({"invoice_id": f"N{k}", "invoice_date": f"2024-0{k + 1}-03"}).coalesce(1), landing)
        refresh(spark, landing, lake)
        plan.compact(spark, lake, fanout=2)
    for layer in ("bronze", "silver"):
        assert live(spark, f"{lake}/{layer}_invoices") <= 4 and batchfolders.numbers(spark, f"{lake}/{layer}_invoices") == list(range(4))
    assert read_gold(spark, lake)["gold_invoice_details"].count() == 5
    assert bronze.read_bronze(spark, "invoices", f"{lake}/bronze_invoices").count() == 5
    whole = {n: sorted(map(str, df.collect())) for n, df in read_gold(spark, lake).items()}
    plan.refresh_gold(plan.read_silver(spark, lake), str(tmp_path / "again"))
    assert whole == {n: sorted(map(str, df.collect())) for n, df in read_gold(spark, str(tmp_path / "again")).items()}


def test_no_batches(spark, tmp_path):
    assert batchfolders.numbers(spark, str(tmp_path)) == [] and batchfolders.read(spark, str(tmp_path)) is None
    assert batchfolders.compact(spark, str(tmp_path)) == 0
