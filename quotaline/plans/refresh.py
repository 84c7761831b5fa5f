"""The whole refresh: landing folders to bronze, silver, gold and the serving copy.

Every layer only takes in what is new. Bronze grows by batches of files; silver by the same batches. Gold keeps, beside
its tables, the rollups of the facts as states, and takes in new facts and changed dimensions as deltas:

- New facts are rolled up and merged into the states of their months. The monthly and the category summary of those
  months are made of the states, so no other fact of a month is read again.
- New detail rows are added to their months as files of their own. A month with ``MOST_FILES`` of them is rewritten.
- Reps and customers that came or changed are told by comparing hashes of the rows before and now. The files that hold
  one of their keys are found by their statistics and by reading that column alone, and only those are rewritten: rows of
  other keys are copied, theirs made again from the facts of those keys and months.

What is written becomes visible by publishing a version: readers see the former tables until all new ones are complete,
and a failed run leaves them as they were. From a shell: ``python -m quotaline.plans.refresh LANDING OUT [SERVING]``.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quotaline.functions.typed import month_of
from quotaline.operators import gold, silver
from quotaline.session import configure, freed_shuffles, in_turn, input_bytes, passes, sized_for
from quotaline.sinks import batchfolders, folders, manifest
from quotaline.sinks.clustered import by_month, clustered, set_aside, with_blooms, write_clustered, writer
from quotaline.sinks.manifest import NO_MONTH, PART, Files, described, entries, read_entries
from quotaline.sinks.snapshot import read_gold, sync_changes
from quotaline.sources.schemas import ENTITIES, GOLD_KEY, GOLD_LAYOUT
from quotaline.streaming.bronze import BATCH, BATCH_BYTES, batches, read_bronze, start_ingest


SILVER = {
    "sales_reps": silver.silver_sales_reps,
    "customers": silver.silver_customers,
    "invoices": silver.silver_invoices,
    "orders": silver.silver_orders,
    "deals": silver.silver_deals,
}

# Each gold table from the silver entities.
GOLD: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "gold_rep_monthly_summary": lambda s: gold.gold_rep_monthly_summary(
        s["invoices"], s["orders"], s["deals"], s["sales_reps"]
    ),
    "gold_active_deals": lambda s: gold.gold_active_deals(s["deals"], s["sales_reps"], s["customers"]),
    "gold_invoice_details": lambda s: gold.gold_invoice_details(s["invoices"], s["sales_reps"], s["customers"]),
    "gold_category_summary": lambda s: gold.gold_category_summary(s["invoices"]),
}

# The day that puts a fact into a month, and that of the gold tables' rows.
DAY = {"invoices": "invoice_date", "orders": "order_date", "deals": "expected_close_date"}
GOLD_DAY = {table: layout[0] for table, layout in GOLD_LAYOUT.items()}
# The tables with a row for each fact, and the states that each other table is made of.
COUNTS = "_counts"
DETAILS = {"gold_active_deals": "deals", "gold_invoice_details": "invoices"}
STATES = {"gold_rep_monthly_summary": ("invoices", "orders", "deals"), "gold_category_summary": ("categories",)}
STATE_FACT = {"invoices": "invoices", "orders": "orders", "deals": "deals", "categories": "invoices"}
#: Files of a month beyond which an addition rewrites the month.
MOST_FILES = 32
#: Changed keys up to which they are looked up as a list, by files' bounds and Parquet's filters; a join beyond.
FEW_KEYS = 1000


def _together(work: Callable, items: Iterable) -> list:
    """Run independent writes side by side; the cluster's scheduler shares the executors."""
    with ThreadPoolExecutor(len(SILVER)) as pool:
        return list(pool.map(work, items))


def refresh_silver(bronze: Mapping[str, DataFrame], out: str, strict: bool = True, dedupe: bool = False) -> None:
    """Recompute and replace whole silver tables. ``dedupe`` keeps the newest row of each key (off by default)."""

    def replace(name: str) -> None:
        rows = SILVER[name](bronze[name], strict)
        if dedupe:
            rows = silver.newest_by_key(rows, ENTITIES[name].key)
        write_clustered(rows, f"{out}/silver_{name}", ENTITIES[name].silver_layout)

    with freed_shuffles(bronze["invoices"].sparkSession):
        _together(replace, SILVER)


def update_silver(spark: SparkSession, out: str, strict: bool = True) -> None:
    """Clean the bronze batches that silver does not hold yet, each into a folder of its own.

    Cleaning is row by row, so the rows keep bronze's layout and are not shuffled. The batches become visible
    together when the write commits.
    """

    def update(name: str) -> None:
        source, target = f"{out}/bronze_{name}", f"{out}/silver_{name}"
        new = sorted(set(batches(spark, source)) - set(batches(spark, target)))
        if new:
            counts = Observation()
            rows = read_bronze(spark, name, source, only=new).observe(counts, *silver.counted(name))
            cleaned = writer(SILVER[name](rows, strict))
            cleaned.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(target)
            _store_counts(spark, target, new, counts.get)

    _together(update, SILVER)


def _store_counts(spark: SparkSession, table: str, numbers: list[int], counts: Mapping[str, int]) -> None:
    try:
        folders.write_once(spark, f"{table}/{COUNTS}/{numbers[0]}-{numbers[-1]}-{uuid.uuid4().hex}", json.dumps({"batches": numbers, "counts": dict(counts)}))
    except FileExistsError:
        pass


def rejected_rows(spark: SparkSession, out: str) -> DataFrame:
    """``entity``, ``fate`` and ``n``: how many ingested rows were kept, and how many left out for which reason.

    Counted while silver was written, without a pass of its own; only batches whose counts a crash kept from being
    stored are read again.
    """
    total = {(name, fate): 0 for name in SILVER for fate in (silver.KEPT, *silver.rejections(name))}

    def count(name: str) -> None:
        table, seen = f"{out}/silver_{name}", set()
        for file in folders.names(spark, f"{table}/{COUNTS}"):
            stored = json.loads(folders.read(spark, f"{table}/{COUNTS}/{file}"))
            if not seen & set(stored["batches"]):
                seen |= set(stored["batches"])
                for fate, n in stored["counts"].items():
                    total[name, fate] += n
        left = sorted(set(batches(spark, table)) - seen)
        if left:
            found = read_bronze(spark, name, f"{out}/bronze_{name}", only=left).agg(*silver.counted(name)).first().asDict()
            for fate, n in found.items():
                total[name, fate] += n
            _store_counts(spark, table, left, found)

    _together(count, SILVER)
    return spark.createDataFrame([(name, fate, n) for (name, fate), n in total.items()], "entity string, fate string, n long")


def read_silver(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The silver tables; without rows where nothing was ingested. Batch numbers are carried where there are any."""

    def read(name: str) -> DataFrame:
        table = f"{out}/silver_{name}"
        rows = batchfolders.read(spark, table)
        if rows is None and folders.names(spark, table):  # replaced as a whole by refresh_silver
            rows = spark.read.parquet(table)
        return rows if rows is not None else SILVER[name](read_bronze(spark, name, f"{out}/bronze_{name}").limit(0))

    return {name: read(name) for name in ENTITIES}


def compact(spark: SparkSession, out: str, fanout: int = batchfolders.FANOUT) -> None:
    """Merge small batches of the bronze and silver tables, their rows in the tables' layouts."""

    def merge(item) -> None:
        table, keys = item
        batchfolders.compact(spark, table, lambda rows: clustered(rows, keys), fanout)

    layouts = [(f"{out}/bronze_{n}", ENTITIES[n].bronze_layout) for n in ENTITIES] + [(f"{out}/silver_{n}", ENTITIES[n].silver_layout) for n in ENTITIES]
    _together(merge, layouts)


def _in_months(day: str, months: Iterable[date | None]) -> Column:
    """Whether a day lies in one of the months, as ranges that reach the files."""
    tests = [F.col(day).isNull() if m is None else F.col(day).between(F.lit(m), F.last_day(F.lit(m))) for m in months]
    return reduce(or_, tests, F.lit(False))


def _name(month: date | None) -> str:
    return NO_MONTH if month is None else f"{month:%Y-%m}"


def _month(name: str) -> date | None:
    return None if name == NO_MONTH else date.fromisoformat(f"{name}-01")


def _write_months(rows: DataFrame, table: str, path: str) -> None:
    """Write a table's rows with a folder per month, in the table's layout."""
    layout = (*GOLD_LAYOUT[table], GOLD_KEY[table]) if table in GOLD_LAYOUT else gold.ROLLUPS[table][0]
    day = layout[0] if table in GOLD_LAYOUT else "month_date"
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(NO_MONTH))
    with_blooms(by_month(rows.withColumn(PART, month), PART, list(dict.fromkeys(layout)))).partitionBy(PART).parquet(path)


def _in_turn(facts: DataFrame, day: str) -> list[DataFrame]:
    """Facts in parts of whole months, small enough to be looked up and laid out one after another."""
    turns = passes(input_bytes(facts))
    if turns == 1:
        return [facts]
    rows = {r[0]: r[1] for r in facts.groupBy(month_of(day)).count().collect()}  # one row a month
    return [facts.where(_in_months(day, some)) for some in in_turn(dict(sorted(rows.items(), key=lambda r: r[0] or date.min)), turns)]


class Version:
    """A version in the making: what is written for it, and the files it keeps of the one before."""

    def __init__(self, spark: SparkSession, out: str, state: dict | None):
        self.spark, self.out, self.folder = spark, out, f"version-{uuid.uuid4().hex}"
        self.before = state or {}
        self.files = {layer: {t: {m: list(f) for m, f in files.items()} for t, files in self.before.get(layer, {}).items()} for layer in ("tables", "states")}

    def write(self, layer: str, table: str, rows: DataFrame, label: str = "new") -> Files:
        """Write rows, and return their files by month; the version does not name them yet."""
        folder = f"{self.folder}/{layer}/{table}/{label}"
        _write_months(rows, table, f"{self.out}/{folder}")
        return described(self.spark, self.out, folder, GOLD_DAY[table] if layer == "tables" else "month_date")

    def kept_columns(self, layer: str, table: str, rows: DataFrame) -> None:
        """A table without rows still has columns."""
        if not entries(self.files[layer].setdefault(table, {})):
            folder = f"{self.folder}/{layer}/{table}/empty/{PART}={NO_MONTH}"
            rows.limit(0).write.mode("overwrite").parquet(f"{self.out}/{folder}")
            self.files[layer][table] = {NO_MONTH: [{"path": folder, "rows": 0, "low": None, "high": None, "undated": 0}]}

    def replace(self, layer: str, table: str, new: Files, months: Iterable[str]) -> None:
        """The new files instead of those of these months."""
        files = self.files[layer].setdefault(table, {})
        for m in set(months) | set(new):
            files.pop(m, None)
        files |= new

    def add(self, layer: str, table: str, new: Files) -> None:
        files = self.files[layer].setdefault(table, {})
        if any(e["rows"] == 0 for e in files.get(NO_MONTH, [])):  # the file of an empty table
            files.pop(NO_MONTH)
        for m, some in new.items():
            files[m] = files.get(m, []) + some

    def read(self, layer: str, table: str, months: Iterable[str] | None = None) -> DataFrame | None:
        return read_entries(self.spark, self.out, entries(self.files[layer].get(table, {}), months))

    def publish(self, **more) -> None:
        folders.publish(self.spark, self.out, {**self.files, **more}, after=self.before.get("number"))
        folders.sweep(self.spark, self.out)


def _summary(table: str, states: list[DataFrame], cleaned: Mapping[str, DataFrame]) -> DataFrame:
    """A table that is made of states."""
    return gold.summary_of_rollups(*states, cleaned["sales_reps"]) if table == "gold_rep_monthly_summary" else gold.category_summary_of_rollup(*states)


def _publish_whole(spark: SparkSession, out: str, cleaned: Mapping[str, DataFrame], seen: dict, dedupe: bool, before: dict | None) -> None:
    """Recompute all tables and states and publish them.

    Facts that may be costly to make and are many are made once and set aside. Details are written some months at a
    time, so that the shuffles of a part of the facts are on disk, not of all.
    """
    version = Version(spark, out, {"number": before["number"]} if before else None)
    aside = f"{out}/{version.folder}/facts"
    costly = {f: set_aside(cleaned[f], f"{aside}/{f}", DAY[f]) for f in DETAILS.values() if (dedupe or not seen) and passes(input_bytes(cleaned[f])) > 1}
    cleaned = {**cleaned, **costly}

    def write(item) -> None:
        layer, table, rows = item
        version.replace(layer, table, version.write(layer, table, rows), [])
        version.kept_columns(layer, table, rows)

    def details(table: str) -> None:
        fact = DETAILS[table]
        for k, some in enumerate(_in_turn(cleaned[fact], DAY[fact])):
            version.add("tables", table, version.write("tables", table, GOLD[table]({**cleaned, fact: some}), f"new-{k}"))
        version.kept_columns("tables", table, GOLD[table](cleaned))

    rollups = {name: make(cleaned[STATE_FACT[name]]) for name, (_, _, make) in gold.ROLLUPS.items()}
    held = f"{out}/{version.folder}/rollups"

    def roll_up(_) -> None:
        """Both rollups of the invoices, which may be costly to make, in one pass."""
        writer(gold.invoice_rollups(cleaned["invoices"])).parquet(held)

    work = [(write, ("states", n, rows)) for n, rows in rollups.items()] if seen else [(roll_up, None)]
    work += [(details, t) for t in DETAILS]
    _together(lambda task: task[0](task[1]), work)
    if seen:
        rollups = {name: version.read("states", name) for name in rollups}
    else:
        rollups |= {name: gold.rollup_of(spark.read.parquet(held), name) for name in ("invoices", "categories")}
    _together(write, [("tables", t, _summary(t, [rollups[n] for n in made_of], cleaned)) for t, made_of in STATES.items()])
    for done in (held, aside):
        folders.remove(spark, done)
    version.publish(silver=seen, dedupe=dedupe)


def refresh_gold(cleaned: Mapping[str, DataFrame], out: str) -> None:
    """Recompute and publish all gold tables."""
    spark = cleaned["invoices"].sparkSession
    with freed_shuffles(spark):
        _publish_whole(spark, out, cleaned, {}, False, folders.published(spark, out))


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys whose rows differ between two versions of a dimension, rows counted as often as they occur.

    Every row is hashed twice (with its audit columns left out); what a key's rows add up to tells whether they differ.
    """
    used = [c for c in new.columns if c not in ("_ingested_at", BATCH)]

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        marks = [F.xxhash64(*[F.lit(salt), *(F.col(c) for c in used)]).cast("decimal(38,0)") * sign for salt in (1, 2)]
        return rows.select(key, F.lit(sign).alias("n"), marks[0].alias("m1"), marks[1].alias("m2"))

    both = signed(old, -1).unionByName(signed(new, 1))
    sums = both.groupBy(key).agg(F.sum("n").alias("n"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    return sums.where("n <> 0 OR m1 <> 0 OR m2 <> 0").select(key)


class Changed:
    """The changed keys of a dimension: a list of them while they are few, else a table."""

    def __init__(self, key: str, keys: DataFrame):
        self.key = key
        few = [r[0] for r in keys.limit(FEW_KEYS + 1).collect()]
        self.few = sorted(few) if len(few) <= FEW_KEYS else None
        self.keys = keys

    def __bool__(self) -> bool:
        return self.few is None or bool(self.few)

    def among(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.key).isin(self.few)) if self.few is not None else rows.join(self.keys, self.key, "left_semi").select(*rows.columns)

    def other(self, rows: DataFrame) -> DataFrame:
        """Rows of other keys and without key."""
        if self.few is not None:
            return rows.where(F.col(self.key).isNull() | ~F.col(self.key).isin(self.few)) if self.few else rows
        return rows.join(self.keys, self.key, "left_anti").select(*rows.columns)

    def may_be_in(self, entry: dict) -> bool:
        if self.few is None or self.key != "rep_id" or "low_rep" not in entry:
            return True
        return entry["low_rep"] is not None and any(entry["low_rep"] <= k <= entry["high_rep"] for k in self.few)


def _holding(spark: SparkSession, out: str, files: Files, changed: list[Changed]) -> Files:
    """The files that hold a row with a changed key: those that their bounds allow are asked, by that column alone."""
    found: set[str] = set()
    for c in changed:
        rows = read_entries(spark, out, [e for e in entries(files) if e["rows"] and c.may_be_in(e)])
        if rows is not None and c.key in rows.columns:
            named = c.among(rows.select(c.key, F.col("_metadata.file_path").alias("file"))).select("file").distinct()
            found |= {"/".join(r["file"].split("/")[-2:]) for r in named.collect()}  # a row for each file
    kept = {m: [e for e in some if "/".join(e["path"].split("/")[-2:]) in found] for m, some in files.items()}
    return {m: some for m, some in kept.items() if some}


def _rewrite(version: Version, table: str, old: Files, changed: list[Changed], again: DataFrame, label: str = "changed") -> None:
    """Replace the files that hold changed keys: other rows as they are, those of changed keys made again."""
    rest = read_entries(version.spark, version.out, entries(old))
    for c in changed:
        rest = c.other(rest) if c.key in rest.columns else rest
    new = version.write("tables", table, rest.unionByName(again), label)
    gone = {e["path"] for e in entries(old)}
    files = version.files["tables"][table]
    for m in list(files):
        files[m] = [e for e in files[m] if e["path"] not in gone]
        if not files[m]:
            del files[m]
    version.add("tables", table, new)


def _of_changed(facts: DataFrame, changed: list[Changed]) -> DataFrame:
    """The facts with any changed key, each once."""
    parts, rest = [], facts
    for c in changed:
        if c.key in facts.columns:
            parts.append(c.among(rest))
            rest = c.other(rest)
    return reduce(DataFrame.unionByName, parts)


def update_gold(spark: SparkSession, out: str, dedupe: bool = False) -> list[date | None] | None:
    """Publish gold with the silver batches it has not seen; returns the months written, or None for all.

    With ``dedupe`` a new fact can replace one of any month, so new facts recompute everything; changed dimensions do not.
    """
    cleaned, state = read_silver(spark, out), folders.published(spark, out)
    now = {name: batches(spark, f"{out}/silver_{name}") for name in ENTITIES}
    before = (state or {}).get("silver", {})
    new = {name: sorted(set(now[name]) - set(before.get(name, []))) for name in ENTITIES}

    def seen(name: str, numbers: list[int] | None = None) -> DataFrame:
        rows = cleaned[name] if numbers is None else cleaned[name].where(F.col(BATCH).isin(numbers)) if numbers else cleaned[name].limit(0)
        return silver.newest_by_key(rows.drop(BATCH), ENTITIES[name].key) if dedupe else rows.drop(BATCH)

    whole = {name: seen(name) for name in ENTITIES}
    if not before or "states" not in state or state.get("dedupe", False) != dedupe or dedupe and any(new[f] for f in DAY):
        _publish_whole(spark, out, whole, now, dedupe, state)
        return None
    if now == before:
        return []
    changed = [
        Changed(ENTITIES[d].key, changed_keys(seen(d, before.get(d, [])), whole[d], ENTITIES[d].key))
        for d in ("sales_reps", "customers")
        if new[d]
    ]
    changed = [c for c in changed if c]
    version, touched = Version(spark, out, state), {}

    def merge(name: str) -> None:
        """New facts into a state."""
        fact = STATE_FACT[name]
        if new[fact]:
            fresh = gold.ROLLUPS[name][2](cleaned[fact].where(F.col(BATCH).isin(new[fact])))
            months = {_name(r[0]) for r in fresh.select("month_date").distinct().collect()}  # one row a month
            held = version.read("states", name, months)
            files = version.write("states", name, fresh if held is None else gold.merged([held, fresh], name))
            version.replace("states", name, files, months)
            touched[name] = months

    def details(table: str) -> None:
        """A table of details: files that hold changed keys, then the rows of new facts."""
        fact = DETAILS[table]
        old = _holding(spark, out, state["tables"][table], changed)
        if old:
            facts = cleaned[fact].where(F.col(BATCH).isin(before[fact])).drop(BATCH) if not dedupe else whole[fact]
            turns = 1 if dedupe else passes(input_bytes(read_entries(spark, out, entries(old))))
            for k, months in enumerate(in_turn({m: sum(e["rows"] for e in old[m]) for m in sorted(old)}, turns)):
                some = _of_changed(facts.where(_in_months(DAY[fact], [_month(m) for m in months])), changed)
                _rewrite(version, table, {m: old[m] for m in months}, changed, GOLD[table](whole | {fact: some}), f"changed-{k}")
        touched[table] = set(old)
        if new[fact]:
            files, found = version.files["tables"][table], {}
            for k, some in enumerate(_in_turn(cleaned[fact].where(F.col(BATCH).isin(new[fact])).drop(BATCH), DAY[fact])):
                found |= version.write("tables", table, GOLD[table](whole | {fact: some}), f"new-{k}")
            version.add("tables", table, found)
            full = [m for m in found if len(files.get(m, [])) > MOST_FILES]
            if full:
                version.replace("tables", table, version.write("tables", table, version.read("tables", table, full), "full"), full)
            touched[table] |= set(found)

    def summarize(table: str) -> None:
        """A table of states: the months that facts touched, and the files that hold changed reps."""
        months = set().union(*(touched.get(n, set()) for n in STATES[table]))
        if months:
            version.replace("tables", table, version.write("tables", table, made(table, months)), months)
        own = [c for c in changed if c.key == "rep_id" and table == "gold_rep_monthly_summary"]
        old = _holding(spark, out, {m: f for m, f in state["tables"][table].items() if m not in months}, own) if own else {}
        if old:
            _rewrite(version, table, old, own, made(table, set(old), own[0].among))
        touched[table] = months | set(old)

    def made(table: str, months: set[str], of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        states = []
        for name in STATES[table]:
            rows = version.read("states", name, months)
            if rows is None:
                rows = gold.ROLLUPS[name][2](whole[STATE_FACT[name]].limit(0))
            states.append(of(rows))
        return _summary(table, states, whole)

    _together(lambda task: task[0](task[1]), [*((merge, n) for n in gold.ROLLUPS), *((details, t) for t in DETAILS)])
    _together(summarize, STATES)
    for layer, named in (("tables", GOLD), ("states", gold.ROLLUPS)):
        for table in named:
            rows = version.read(layer, table)
            if rows is None:
                rows = GOLD[table](whole) if layer == "tables" else gold.ROLLUPS[table][2](whole[STATE_FACT[table]])
                version.kept_columns(layer, table, rows)
    version.publish(silver=now, dedupe=dedupe)
    return sorted({_month(m) for t in GOLD for m in touched.get(t, ())}, key=lambda m: m or date.min)


def refresh(
    spark: SparkSession,
    landing: str,
    out: str,
    serving: str | None = None,
    strict: bool = True,
    dedupe: bool = False,
    max_bytes_per_trigger: int = BATCH_BYTES,
    rejected: str | None = None,
    archive: str | None = None,
) -> dict[str, DataFrame]:
    """Take in what is new under ``landing``, bring silver and gold under ``out`` up to date, copy gold to ``serving``.

    If one entity's ingest fails, the others are stopped; what they had committed stays and is not read again. Files
    that do not fit are set aside in ``rejected``, if given, and fail the ingest otherwise. ``archive`` takes the landed
    files once they are in.
    Returns the gold tables as published.
    """
    with freed_shuffles(spark):
        running = []
        try:
            for n in ENTITIES:
                running.append(start_ingest(spark, n, f"{landing}/{n}", f"{out}/bronze_{n}", f"{out}/checkpoints/{n}", max_bytes_per_trigger, f"{archive}/{n}" if archive else None, rejected))
            for query in running:
                query.awaitTermination()
        finally:
            for query in running:
                query.stop()
        update_silver(spark, out, strict)
        with sized_for(spark, sum(folders.size(spark, f"{out}/silver_{n}") for n in ENTITIES)):
            update_gold(spark, out, dedupe)
            tables = read_gold(spark, out)
            if serving:
                sync_changes(spark, out, serving)
        compact(spark, out)
    return tables


def main(arguments: list[str]) -> None:
    session = configure(SparkSession.builder.appName("quotaline-refresh")).getOrCreate()
    refresh(session, *arguments)


if __name__ == "__main__":
    main(sys.argv[1:])
