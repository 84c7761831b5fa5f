"""Landing folders: one folder of parquet files per raw entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from quotaline.sinks.clustered import writer
from quotaline.sources.schemas import ENTITIES


def _declared_first(name: str, rows: DataFrame) -> DataFrame:
    """The entity's columns in order, then whatever else the rows bring."""
    declared = ENTITIES[name].schema.names
    return rows.select(*declared, *[c for c in rows.columns if c not in declared])


def land_parquet(raw: Mapping[str, DataFrame], landing: str) -> dict[str, str]:
    """Write raw entities to their landing folders, replacing what is there; returns the folders.

    The replaced files have new names, so an ingest that already read the folder reads all of it again. Land new
    rows with ``add_files`` instead, or refresh with ``dedupe=True``.
    """
    folders = {name: f"{landing}/{name}" for name in raw}
    for name, df in raw.items():
        writer(_declared_first(name, df)).mode("overwrite").parquet(folders[name])
    return folders


def add_files(name: str, rows: DataFrame, landing: str) -> None:
    """Add rows to a landing folder as new files."""
    writer(_declared_first(name, rows)).mode("append").parquet(f"{landing}/{name}")
