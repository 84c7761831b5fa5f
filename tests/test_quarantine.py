"""Odd files in the landing folder, and how often footers are read."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quotaline.plans.refresh import refresh
from quotaline.sinks import folders
from quotaline.sources.landing import add_files, land_parquet
from quotaline.streaming import bronze
from tests.test_streaming import ids, paths, raw, rows


def odd_files(folder: Path, good: pa.Table) -> dict[str, str]:
    """Files that cannot be taken in, and what their reasons must say."""
    (folder / "text.parquet").write_text("no parquet")
    (folder / "empty.parquet").write_bytes(b"")
    cut = folder / "cut.parquet"
    pq.write_table(good, cut)
    cut.write_bytes(cut.read_bytes()[:-20])
    typed = good.set_column(good.schema.get_field_index("order_amount"), "order_amount", pa.array(["x"] * len(good)))
    pq.write_table(typed.replace_schema_metadata(None), folder / "typed.parquet")
    return {"text.parquet": "Parquet", "empty.parquet": "Parquet", "cut.parquet": "Parquet", "typed.parquet": "order_amount is string, not double"}


def test_odd_files_are_set_aside_and_all_others_arrive(spark, frames, tmp_path):
    land_parquet({"orders": rows(frames, 0, 4).coalesce(1)}, str(tmp_path / "landing"))
    landing = tmp_path / "landing" / "orders"
    good = pq.read_table(next(landing.glob("*.parquet")))
    reasons = odd_files(landing, good)
    for first in range(4, 20, 4):
        add_files("orders", rows(frames, first, first + 4).coalesce(1), str(tmp_path / "landing"))
    with pytest.raises(ValueError, match="parquet"):
        bronze.ingest(spark, "orders", *paths(tmp_path))
    rejected = str(tmp_path / "rejected")
    bronze.ingest(spark, "orders", *paths(tmp_path), rejected=rejected)
    assert ids(spark, tmp_path) == list(range(20))
    found = {r.file: r for r in bronze.read_rejected(spark, rejected).collect()}
    assert set(found) == set(reasons) and all(part in found[f].reason and found[f].reason for f, part in reasons.items())
    assert all(r.entity == "orders" and r.rejected_at for r in found.values())
    assert {f.name for f in (tmp_path / "rejected" / "orders").glob("*.parquet")} == set(reasons)
    assert not set(reasons) & {f.name for f in landing.iterdir()}
    bronze.ingest(spark, "orders", *paths(tmp_path), rejected=rejected)
    assert ids(spark, tmp_path) == list(range(20)) and bronze.read_rejected(spark, rejected).count() == 4


def test_refresh_goes_on_past_an_odd_file(spark, frames, tmp_path):
    landing, lake = str(tmp_path / "landing"), str(tmp_path / "lake")
    land_parquet(raw(frames), landing)
    (tmp_path / "landing" / "sales_reps" / "bad.parquet").write_text("no parquet")
    gold = refresh(spark, landing, lake, rejected=str(tmp_path / "rejected"))
    assert gold["gold_invoice_details"].count() == 2
    assert [(r.entity, r.file) for r in bronze.read_rejected(spark, str(tmp_path / "rejected")).collect()] == [("sales_reps", "bad.parquet")]


def test_footers_are_read_once(spark, frames, tmp_path, monkeypatch):
    read, checked = [], bronze.checked

    def counting(spark, folder, files, known, reject):
        read.append(list(files))
        return checked(spark, folder, files, known, reject)

    monkeypatch.setattr(bronze, "checked", counting)
    land_parquet({"orders": rows(frames, 0, 3).coalesce(1)}, str(tmp_path / "landing"))
    for first in (3, 6, 9, 9):
        bronze.ingest(spark, "orders", *paths(tmp_path))
        if first < 9:
            add_files("orders", rows(frames, first, first + 3).coalesce(1), str(tmp_path / "landing"))
    assert [len(f) for f in read] == [1, 1, 1, 0] and len({f for some in read for f in some}) == 3
    assert ids(spark, tmp_path) == list(range(9))


def test_columns_that_came_before_stay_known(spark, frames, tmp_path):
    wide = rows(frames, 0, 2).selectExpr("*", "'web' AS channel")
    add_files("orders", wide.coalesce(1), str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path), archive=str(tmp_path / "archive"))
    for file in (tmp_path / "landing" / "orders").glob("*.parquet"):
        folders.move(spark, str(file), f"{tmp_path}/moved-{file.name}")  # its footer can't be read any more
    add_files("orders", rows(frames, 2, 4).coalesce(1), str(tmp_path / "landing"))
    assert bronze.landed_schema(spark, "orders", str(tmp_path / "landing" / "orders"), str(tmp_path / "checkpoint")).names[-1] == "channel"
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert ids(spark, tmp_path) == list(range(4))


def test_widened_types_fit(spark, frames, tmp_path):
    narrow = rows(frames, 0, 2).selectExpr("* EXCEPT (quantity)", "CAST(7 AS INT) AS quantity")
    add_files("orders", narrow.coalesce(1), str(tmp_path / "landing"))
    bronze.ingest(spark, "orders", *paths(tmp_path))
    assert {r.quantity for r in bronze.read_bronze(spark, "orders", str(tmp_path / "bronze")).collect()} == {7}
