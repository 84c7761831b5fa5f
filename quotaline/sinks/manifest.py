"""What a published state says of every file: its rows and the bounds of its day and rep, and reads that use them.

A published state lists the files of each table by month, each as ``path`` (relative to the root), ``rows``, ``low`` and
``high`` (first and last day as ISO text, None if no row has one), ``undated`` (rows without a day) and ``low_rep`` and
``high_rep``. The bounds are read from the new files once, when they are published: two columns of what was just
written. Reads then open only files that can matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaline.sinks import folders

NO_MONTH = "none"
PART = "month_part"

Entry = dict
Files = dict[str, list[Entry]]


def file_bounds(rows: DataFrame, day: str, rep: str | None) -> DataFrame:
    """A row for each file that ``rows`` are read from: how many rows it holds and the bounds of their days and reps.

    The least and greatest of texts would be found by sorting all rows by file; with a list among the aggregates (of
    nothing) they are kept in a map by file instead, of which a task reads few.
    """
    bounds = [F.min(day).cast("string").alias("low"), F.max(day).cast("string").alias("high"), F.count(F.when(F.col(day).isNull(), 1)).alias("undated")]
    bounds += [F.min(rep).alias("low_rep"), F.max(rep).alias("high_rep")] if rep is not None else []
    nothing = F.size(F.collect_list(F.lit(None).cast("int")))
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") + nothing).alias("rows"), *bounds)


def described(spark: SparkSession, root: str, folder: str, day: str, rep: str | None = "rep_id") -> Files:
    """The entries, by month, of the files that were written to ``folder`` (relative to ``root``) with a folder a month."""
    months = [n for n in folders.names(spark, f"{root}/{folder}") if n.startswith(f"{PART}=")]
    if not months:
        return {}
    rows = spark.read.parquet(*[f"{root}/{folder}/{m}" for m in months])
    has_rep = rep is not None and rep in rows.columns
    found = file_bounds(rows, day, rep if has_rep else None).collect()  # a row for each new file
    out: Files = {}
    for r in sorted(found, key=lambda r: r["file"]):
        path = f"{folder}/" + "/".join(r["file"].split("/")[-2:])
        entry = {"path": path, "rows": r["rows"], "low": r["low"], "high": r["high"], "undated": r["undated"]}
        entry |= {"low_rep": r["low_rep"], "high_rep": r["high_rep"]} if has_rep else {}
        out.setdefault(path.split("/")[-2].split("=", 1)[1], []).append(entry)
    return out


def entries(files: Mapping[str, list[Entry]], months: Iterable[str] | None = None) -> list[Entry]:
    """All entries, or those of some months, in order of month."""
    return [e for m in sorted(files if months is None else set(months) & set(files)) for e in files[m]]


def read_entries(spark: SparkSession, root: str, some: Iterable[Entry]) -> DataFrame | None:
    """The rows of the files, None without files."""
    paths = [f"{root}/{e['path']}" for e in some]
    return spark.read.parquet(*paths) if paths else None


def _state(spark: SparkSession, root: str) -> dict:
    state = folders.published(spark, root)
    if state is None:
        raise FileNotFoundError(f"nothing was published in {root}")
    return state


def _chosen(spark: SparkSession, root: str, files: Files, some: list[Entry]) -> DataFrame:
    """The rows of the chosen files; without any, the table's columns and no rows."""
    rows = read_entries(spark, root, some)
    return rows if rows is not None else read_entries(spark, root, entries(files)[:1]).limit(0)


def may_hold(entry: Entry, rep_id: str | None) -> bool:
    """Whether a file's bounds allow rows of a rep."""
    return rep_id is None or "low_rep" not in entry or (entry["low_rep"] is not None and entry["low_rep"] <= rep_id <= entry["high_rep"])


def _floor(entry: Entry) -> str:
    """The first day of a file's rows; files that hold rows without a day only come before all days, as newest."""
    return entry["low"] if entry["low"] is not None else "~"


def newest_files(files: Files, rows: int, rep_id: str | None = None) -> list[Entry]:
    """The files that hold the newest ``rows`` rows for certain, ties included; rows without a day count as newest.

    Files are taken by their first day, latest first, until they hold enough rows. None of those rows is older than the
    earliest first day among the files taken, so no file whose last day is before it can matter.
    """
    able = sorted((e for e in entries(files) if may_hold(e, rep_id)), key=_floor, reverse=True)
    held, threshold = 0, ""
    for e in able:
        if held >= rows:
            break
        held += e["rows"]
        threshold = _floor(e)
    return [e for e in able if held < rows or e["undated"] or e["high"] is None or e["high"] >= threshold]


def newest(
    spark: SparkSession, root: str, table: str, day: str, row_key: str, rows: int, rep_id: str | None = None, kept: Column | None = None
) -> DataFrame:
    """The newest ``rows`` rows of a published table, of those that ``kept`` holds for: a threshold top-k over its files.

    Without a filter the statistics say which files suffice. A filter can leave fewer rows of a file than they count:
    then the files of twice as many rows are read, until enough rows stay or all files were read. Ties are broken by
    ``row_key``.
    """
    files = _state(spark, root)["tables"][table]
    whole = sum(e["rows"] for e in entries(files))
    wanted = rows
    while True:
        chosen = newest_files(files, wanted, rep_id)
        found = _chosen(spark, root, files, chosen)
        if kept is None and rep_id is None:
            break
        found = found.where(F.col("rep_id") == rep_id) if rep_id is not None else found
        found = found.where(kept) if kept is not None else found
        if wanted >= whole or found.limit(rows).count() >= rows and _certain(found, chosen, files, day, rows, rep_id):
            break
        wanted *= 2
    return found.orderBy(F.desc_nulls_first(day), row_key).limit(rows)


def _certain(found: DataFrame, chosen: list[Entry], files: Files, day: str, rows: int, rep_id: str | None) -> bool:
    """Whether no file left out can hold a row as new as the last of those found."""
    taken = {e["path"] for e in chosen}
    left = [e for e in entries(files) if e["path"] not in taken and may_hold(e, rep_id)]
    if not left:
        return True
    latest = max(e["high"] for e in left)  # files with rows without a day are always chosen
    return found.where(F.col(day).isNull() | (F.col(day) > F.lit(latest).cast("date"))).limit(rows).count() >= rows


def latest_day(files: Files, on_or_before: date | None = None) -> str | None:
    """The last day of a table's rows, from the statistics alone; with a limit, of the files that begin by it."""
    days = [min(e["high"], str(on_or_before)) if on_or_before else e["high"] for e in entries(files) if e["high"] is not None and (on_or_before is None or e["low"] <= str(on_or_before))]
    return max(days, default=None)


def between(spark: SparkSession, root: str, table: str, first: date | None = None, last: date | None = None, rep_id: str | None = None) -> DataFrame:
    """The rows of a published table from files whose bounds allow days in the span (rows outside it may be among them)."""
    files = _state(spark, root)["tables"][table]
    some = [
        e for e in entries(files)
        if may_hold(e, rep_id) and (first is None and last is None or e["high"] is not None and (first is None or e["high"] >= str(first)) and (last is None or e["low"] <= str(last)))
    ]
    return _chosen(spark, root, files, some)


def latest_month(spark: SparkSession, root: str, table: str = "gold_rep_monthly_summary", day: str = "month_date", as_of: date | None = None) -> DataFrame:
    """The rows of a published table's latest month (the latest by ``as_of``), from that month's files."""
    files = _state(spark, root)["tables"][table]
    latest = latest_day(files, as_of)
    if latest is None:
        return _chosen(spark, root, files, [])
    month = date.fromisoformat(latest).replace(day=1)
    rows = between(spark, root, table, month, date.fromisoformat(latest))
    return rows.where(F.trunc(day, "MM") == F.lit(month))
