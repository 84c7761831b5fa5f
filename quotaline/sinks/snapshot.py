"""Copies of the gold tables for serving, reading published tables, and what changed between two versions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotaline.session import freed_shuffles, in_turn, input_bytes, passes, small_reads
from quotaline.sinks import folders
from quotaline.sinks.clustered import ranged, set_aside, with_blooms
from quotaline.sinks.manifest import NO_MONTH, PART, described, entries, read_entries
from quotaline.sources.schemas import GOLD_KEY, GOLD_LAYOUT, SERVING_LAYOUT


#: Values of a copy's leading column up to which it is made some of them at a time.
MOST_VALUES = 1000


def serving_order(table: str) -> list[str]:
    """What a table's serving copy is ordered by: the filters of the reads, then the row's own key."""
    return list(dict.fromkeys((*SERVING_LAYOUT[table], GOLD_KEY[table])))


def _in_turn(rows: DataFrame, key: str) -> list[DataFrame]:
    """Rows in parts by their values of a key, in its order, small enough to be sorted one after another.

    A key with more than ``MOST_VALUES`` values does not part them.
    """
    turns = passes(input_bytes(rows))
    found = rows.groupBy(key).count().orderBy(key).limit(MOST_VALUES + 1).collect() if turns > 1 else []
    if not 1 < len(found) <= MOST_VALUES:
        return [rows]
    parts = in_turn({r[0]: r[1] for r in found}, turns)
    return [rows.where(F.col(key).isin([v for v in some if v is not None]) | (F.col(key).isNull() if None in some else F.lit(False))) for some in parts]


def snapshot_sync(gold: Mapping[str, DataFrame], serving: str) -> dict[str, str]:
    """Publish a new copy of all gold tables at once; returns the copies' paths.

    The copies go to a folder of their own. Readers see the former copies until the last table is written, and all
    four new ones from then on; a failed run changes nothing for them. Rows are ordered by region and rep, the
    filters of the reads. One copy is made after another, a large one some regions at a time, so that the shuffles of a
    part of the rows are on disk, not of all.
    """
    spark = next(iter(gold.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"

    def copy(name: str) -> None:
        rows, aside = gold[name], f"{serving}/{version}/aside/{name}"
        if passes(input_bytes(rows)) > 1:
            with small_reads(spark):
                rows = set_aside(rows, aside, SERVING_LAYOUT[name][0])
        for part in _in_turn(rows, SERVING_LAYOUT[name][0]):
            with_blooms(ranged(part, SERVING_LAYOUT[name], GOLD_KEY[name])).mode("append").parquet(f"{serving}/{version}/{name}")
        folders.remove(spark, aside)

    with freed_shuffles(spark):
        for name in GOLD_LAYOUT:
            copy(name)
    folders.publish(spark, serving, {"tables": {name: {"all": [{"path": f"{version}/{name}"}]} for name in GOLD_LAYOUT}})
    folders.sweep(spark, serving)
    return {name: f"{serving}/{version}/{name}" for name in GOLD_LAYOUT}


def laid_out(rows: DataFrame, table: str) -> DataFrame:
    """Rows read from gold's files, each of which holds a month: sorted for serving where they are, without a shuffle."""
    return rows.withColumn(PART, F.coalesce(F.date_format(GOLD_LAYOUT[table][0], "yyyy-MM"), F.lit(NO_MONTH))).sortWithinPartitions(PART, *serving_order(table))


def sync_changes(spark: SparkSession, root: str, serving: str) -> list[str]:
    """Bring the serving copies up to the published gold tables; returns the months written, over all tables.

    A month whose gold files are those that the copies were made of keeps its files; every other month is written anew,
    its rows ordered by region and rep. The new state of all tables is published in one step, and remembers of which
    gold files it was made.
    """
    gold, state = folders.published(spark, root), folders.published(spark, serving)
    if gold is None:
        raise FileNotFoundError(f"nothing was published in {root}")
    source = {t: {m: [e["path"] for e in some] for m, some in gold["tables"][t].items()} for t in GOLD_LAYOUT}
    before = (state or {}).get("source", {})
    version = f"version-{uuid.uuid4().hex}"

    def copy(table: str) -> tuple[str, dict, list[str]]:
        was, now = before.get(table, {}), source[table]
        months = [m for m in now if now[m] != was.get(m)]
        files = {m: some for m, some in (state or {}).get("tables", {}).get(table, {}).items() if m in now and m not in months}
        rows = read_entries(spark, root, entries(gold["tables"][table], months))
        if rows is not None:
            day = GOLD_LAYOUT[table][0]
            folder = f"{version}/{table}"
            with_blooms(laid_out(rows, table)).partitionBy(PART).parquet(f"{serving}/{folder}")
            files |= described(spark, serving, folder, day)
            if not entries(files):
                rows.limit(0).write.parquet(f"{serving}/{folder}/empty")
                files = {NO_MONTH: [{"path": f"{folder}/empty", "rows": 0, "low": None, "high": None, "undated": 0}]}
        return table, files, months

    with small_reads(spark), ThreadPoolExecutor(len(GOLD_LAYOUT)) as pool:
        done = list(pool.map(copy, GOLD_LAYOUT))
    if source != before:
        folders.publish(spark, serving, {"tables": {t: files for t, files, _ in done}, "source": source}, after=(state or {}).get("number"))
        folders.sweep(spark, serving)
    return sorted({m for _, _, months in done for m in months})


#: What tells the rows of a gold table apart.
KEYS = {
    "gold_rep_monthly_summary": ("rep_id", "month_date"),
    "gold_active_deals": ("deal_id",),
    "gold_invoice_details": ("invoice_id",),
    "gold_category_summary": ("month_date", "product_category"),
}
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_before", "update_after"


def changes(spark: SparkSession, root: str, table: str, old: dict, new: dict) -> DataFrame:
    """The rows of a table that differ between two published states of a root, with their ``change``.

    Only files that one state names and the other does not are read. A key on one side only is an insert or a delete;
    rows of a key on both sides come as they were and as they are. Equal rows count as often as they occur: removing
    the deletes and befores from the old table and adding the inserts and afters gives the new one.
    """
    paths = [{e["path"] for e in entries(state["tables"][table])} for state in (old, new)]
    sides = []
    for state, mine, other in ((old, *paths), (new, *reversed(paths))):
        rows = read_entries(spark, root, [e for e in entries(state["tables"][table]) if e["path"] in mine - other])
        sides.append(rows if rows is not None else read_entries(spark, root, entries(state["tables"][table])[:1]).limit(0))
    keys, columns = KEYS[table], sides[0].columns
    stacked = sides[0].withColumn("copies", F.lit(-1)).unionByName(sides[1].withColumn("copies", F.lit(1)))
    # Dealt by key once: rows alike are counted and the rows of a key compared where they then lie.
    counted = stacked.repartition(*keys).groupBy(*columns).agg(F.sum("copies").alias("copies")).where("copies <> 0")
    of_key = Window.partitionBy(*keys)
    tagged = counted.withColumns({"is_new": F.col("copies") > 0, "least": F.min("copies").over(of_key), "most": F.max("copies").over(of_key)})
    both = (F.col("least") < 0) & (F.col("most") > 0)
    kind = F.when(both, F.when(F.col("is_new"), AFTER).otherwise(BEFORE)).otherwise(F.when(F.col("is_new"), INSERT).otherwise(DELETE))
    return tagged.select(*columns, kind.alias("change"), F.explode(F.array_repeat(F.lit(0), F.abs("copies").cast("int"))).alias("copy")).drop("copy")


def applied(copy: DataFrame, feed: DataFrame) -> DataFrame:
    """A copy of the old table with a change feed applied: the new table."""
    rows = feed.where(F.col("change").isin(DELETE, BEFORE)).drop("change")
    return copy.exceptAll(rows).unionByName(feed.where(F.col("change").isin(INSERT, AFTER)).drop("change"))


def jdbc_options(url: str, table: str, connections: int, batch_rows: int = 10_000, **properties: str) -> dict[str, str]:
    """Options of a replacing JDBC write that keeps the table's definition.

    ``connections`` is how many tasks write at once: what the database takes, whatever the number of partitions.
    """
    return {
        "url": url,
        "dbtable": table,
        "truncate": "true",
        "numPartitions": str(connections),
        "batchsize": str(batch_rows),
        **properties,
    }


def snapshot_sync_jdbc(gold: Mapping[str, DataFrame], url: str, schema: str, connections: int, **properties: str) -> None:
    """The same copies into a database."""
    for name in GOLD_LAYOUT:
        options = jdbc_options(url, f"{schema}.{name}", connections, **properties)
        gold[name].write.format("jdbc").mode("overwrite").options(**options).save()


def read_gold(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The gold tables (or their serving copies) that were last published under a folder."""
    state = folders.published(spark, root)
    if state is None:
        raise FileNotFoundError(f"nothing was published in {root}")
    return {name: read_entries(spark, root, entries(state["tables"][name])) for name in GOLD_LAYOUT}
