"""Every operator as a query over the star-schema tables of a folder.

The operators keep exact decimals, dates and timestamps; ``presentable`` turns them into doubles and ISO text at the
very end, so that results read the same from any engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotaline.operators import dashboard, forecast, gold, profile, review, serving
from quotaline.plans import refresh, reports
from quotaline.plans.scratch import scratch_folder
from quotaline.session import freed_shuffles, input_bytes, passes
from quotaline.sinks import app_tables, batchfolders, folders, manifest
from quotaline.sinks.clustered import set_aside, write_clustered, write_interleaved
from quotaline.sinks.csv_report import CSV_OPTIONS
from quotaline.sinks.snapshot import changes, read_gold, serving_order, snapshot_sync
from quotaline.sources import star
from quotaline.sources.landing import add_files, land_parquet
from quotaline.sources.schemas import ENTITIES, GOLD_KEY, GOLD_LAYOUT
from quotaline.streaming import bronze

REGION = "ASIA"
REP = "REP-000003"
AS_OF = date(1999, 6, 30)
SPAN = (date(1998, 1, 1), date(1998, 12, 31))


class Layer(Mapping):
    """Named DataFrames, each defined when it is first asked for."""

    def __init__(self, names: Iterable[str], define: Callable[[str], DataFrame]):
        self._names, self._define, self._known = tuple(names), define, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._define(name)
        return self._known[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Lake:
    """The layers over one folder, each built lazily and only as far as a query needs it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        tables = star.StarTables(spark, folder)
        self.raw = Layer(ENTITIES, lambda name: star.RAW[name](tables))
        self.silver = Layer(ENTITIES, lambda name: refresh.SILVER[name](self.raw[name]))
        self.gold = Layer(GOLD_LAYOUT, lambda name: refresh.GOLD[name](self.silver))

    @property
    def summary(self) -> DataFrame:
        return self.gold["gold_rep_monthly_summary"]

    @property
    def deals(self) -> DataFrame:
        return self.gold["gold_active_deals"]

    @property
    def invoices(self) -> DataFrame:
        return self.gold["gold_invoice_details"]

    @property
    def categories(self) -> DataFrame:
        return self.gold["gold_category_summary"]

    @cached_property
    def open_deals(self) -> DataFrame:
        """Open deals without their rep and customer, for what needs neither."""
        return gold.open_deals(self.silver["deals"])

    @cached_property
    def feedback(self) -> DataFrame:
        return star.sales_feedback(self.open_deals, self.silver["sales_reps"])

    def sheet(self, rep_id: str | None = None) -> DataFrame:
        return forecast.adjustment_sheet(self.open_deals, rep_id, reps=self.silver["sales_reps"])

    @cached_property
    def forecast(self) -> DataFrame:
        return forecast.rep_adjusted_forecast(self.summary, self.feedback)

    def forecast_of(self, rep_id: str | None = None, region: str | None = None) -> DataFrame:
        """The forecast under the page's filter, which for feedback is the rep only."""
        months = serving.monthly_summary(self.summary, rep_id, region)
        return forecast.rep_adjusted_forecast(months, serving.read_feedback(self.feedback, rep_id))

    def ordered(self, name: str, order: Sequence[Column | str]) -> DataFrame:
        """A gold table of details for a read or a copy that sorts all of it."""
        facts, define = {"gold_invoice_details": ("invoices", gold.gold_invoice_details), "gold_active_deals": ("deals", gold.gold_active_deals)}[name]
        return define(self.silver[facts], self.silver["sales_reps"], self.silver["customers"], order)

    def newest(self, rep_id: str | None = None, region: str | None = None) -> DataFrame:
        """The invoice details of the newest facts under a filter: what the drill-down reads."""
        facts = serving.newest_invoices(self.silver["invoices"], self.silver["sales_reps"], rep_id, region)
        return refresh.GOLD["gold_invoice_details"]({**self.silver, "invoices": facts})

    @cached_property
    def published(self) -> str:
        """A folder where the gold tables are published."""
        folder = self.scratch("published")
        refresh.refresh_gold(self.silver, folder)
        return folder

    @cached_property
    def deltas(self) -> tuple[str, dict]:
        """A folder with a lake refreshed twice, and what its first refresh published.

        First come the facts of the first half of each month, without some of the reps and customers; then the rest.
        """
        folder = self.scratch("deltas")
        late = {
            "sales_reps": F.col("rep_id").endswith("7"),
            "customers": F.col("customer_id").endswith("3"),
            **{name: F.substring(day, 9, 2) > "15" for name, day in refresh.DAY.items()},
        }
        first = {}
        for part in (False, True):
            with freed_shuffles(self.spark):
                for name, rows in self.raw.items():
                    add_files(name, rows.where(F.coalesce(late[name], F.lit(False)) == part), f"{folder}/landing")
            refresh.refresh(self.spark, f"{folder}/landing", f"{folder}/lake", f"{folder}/serving")
            first = first or folders.published(self.spark, f"{folder}/lake")
        return folder, first

    def scratch(self, label: str) -> str:
        return scratch_folder(self.spark, label)


def presentable(df: DataFrame) -> DataFrame:
    def shown(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return value.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def _rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    """Round doubles and quotients, whose last digits depend on the order or the type they are computed in."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _flat(submissions: DataFrame) -> DataFrame:
    """Submissions with their adjustments side by side, one row per adjustment."""
    kept = [c for c in submissions.columns if c not in ("id", "adjustments")]
    return submissions.select(*kept, F.inline("adjustments"))


def _ingested(lake: Lake, entity: str) -> DataFrame:
    folder = lake.scratch(f"ingest-{entity}")
    landed = land_parquet({entity: lake.raw[entity]}, f"{folder}/landing")
    bronze.ingest(lake.spark, entity, landed[entity], f"{folder}/bronze", f"{folder}/checkpoint")
    rows = bronze.read_bronze(lake.spark, entity, f"{folder}/bronze")
    audited = F.col(bronze.INGESTED_AT).isNotNull() & F.col(bronze.SOURCE_FILE).endswith(".parquet")
    return rows.select(*ENTITIES[entity].schema.names, audited.alias("audited"))


def _stacked(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows and all columns of some tables in one, by column name."""
    named = [df.select(F.lit(name).alias("table_name"), *df.columns) for name, df in tables.items()]
    return reduce(lambda above, below: above.unionByName(below, allowMissingColumns=True), named)


def _landed(lake: Lake) -> DataFrame:
    paths = land_parquet(lake.raw, lake.scratch("landing"))
    return _stacked({name: lake.spark.read.parquet(path) for name, path in paths.items()})


def _clustered(lake: Lake) -> DataFrame:
    path = lake.scratch("clustered")
    write_clustered(lake.silver["invoices"], path, ENTITIES["invoices"].silver_layout)
    return lake.spark.read.parquet(path)


def _synced(lake: Lake) -> DataFrame:
    folder = lake.scratch("serving")
    details = {name: lake.ordered(name, serving_order(name)) for name in ("gold_invoice_details", "gold_active_deals")}
    aside = lake.scratch("facts")
    if passes(input_bytes(lake.silver["invoices"])) > 1:
        # made once, without what names and order shuffle beside it; the copy lays out what it reads
        with freed_shuffles(lake.spark):
            invoices = set_aside(lake.silver["invoices"], aside, "invoice_date")
        details = {name: define({**lake.silver, "invoices": invoices}) for name, define in refresh.GOLD.items()}
    snapshot_sync({**lake.gold, **details}, folder)
    folders.remove(lake.spark, aside)
    return _stacked(read_gold(lake.spark, folder))


def _refreshed(lake: Lake) -> DataFrame:
    folder = lake.scratch("refresh")
    with freed_shuffles(lake.spark):
        land_parquet(lake.raw, f"{folder}/landing")
    refresh.refresh(lake.spark, f"{folder}/landing", f"{folder}/lake", f"{folder}/serving")
    return read_gold(lake.spark, f"{folder}/serving")["gold_rep_monthly_summary"]


def _refreshed_silver(lake: Lake) -> DataFrame:
    folder = lake.scratch("silver")
    refresh.refresh_silver(lake.raw, folder)
    return _stacked(refresh.read_silver(lake.spark, folder))


def _refreshed_gold(lake: Lake) -> DataFrame:
    folder = lake.scratch("gold")
    refresh.refresh_gold(lake.silver, folder)
    return _stacked(read_gold(lake.spark, folder))


def _refreshed_in_deltas(lake: Lake) -> DataFrame:
    folder, _ = lake.deltas
    return _stacked(read_gold(lake.spark, f"{folder}/serving"))


def _change_feed(lake: Lake) -> DataFrame:
    """What the second refresh changed in the invoice details."""
    folder, first = lake.deltas
    now = folders.published(lake.spark, f"{folder}/lake")
    feed = changes(lake.spark, f"{folder}/lake", "gold_invoice_details", first, now)
    return feed.select("invoice_id", "rep_name", "customer_name", "change")


def _rejected_rows(lake: Lake) -> DataFrame:
    folder, _ = lake.deltas
    return refresh.rejected_rows(lake.spark, f"{folder}/lake")


def _interleaved(lake: Lake) -> DataFrame:
    path = lake.scratch("interleaved")
    write_interleaved(lake.summary, path, GOLD_LAYOUT["gold_rep_monthly_summary"], GOLD_KEY["gold_rep_monthly_summary"], files=16)
    return lake.spark.read.parquet(path)


def _compacted(lake: Lake, entity: str) -> DataFrame:
    """One batch a landing, of as many files as its tasks write, merged level by level."""
    folder = lake.scratch(f"compacted-{entity}")
    for part in range(5):
        rows = lake.raw[entity].where(F.pmod(F.xxhash64(ENTITIES[entity].key), F.lit(5)) == part)
        add_files(entity, rows, f"{folder}/landing")
        bronze.ingest(lake.spark, entity, f"{folder}/landing/{entity}", f"{folder}/bronze", f"{folder}/checkpoint")
    batchfolders.compact(lake.spark, f"{folder}/bronze", fanout=2)
    return bronze.read_bronze(lake.spark, entity, f"{folder}/bronze").select(*ENTITIES[entity].schema.names)


def _appended(lake: Lake, table: str, append: Callable[[DataFrame, str], None], rows: DataFrame) -> DataFrame:
    """Append to a table of a schema made for it; what comes back reads the files, and the schema goes again."""
    folder = lake.scratch("app")
    namespace = "app_" + folder.rsplit("-", 1)[-1]
    app_tables.ensure_namespace(lake.spark, namespace)
    try:
        app_tables.ensure_app_tables(lake.spark, namespace, folder)
        append(rows, namespace)
        return app_tables.read(lake.spark, table, f"{folder}/{table}")
    finally:
        lake.spark.sql(f"DROP SCHEMA {namespace} CASCADE")


def _appended_feedback(lake: Lake) -> DataFrame:
    rows = app_tables.adjustments_as_json(lake.feedback)
    return _flat(serving.read_feedback(_appended(lake, "sales_feedback", app_tables.append_feedback, rows)))


def _appended_once(lake: Lake) -> DataFrame:
    """An append that is tried twice."""

    def twice(rows: DataFrame, namespace: str) -> None:
        for _ in range(2):
            app_tables.append_feedback(rows, namespace, key="submissions")

    return _flat(serving.read_feedback(_appended(lake, "sales_feedback", twice, lake.feedback)))


def _appended_overrides(lake: Lake) -> DataFrame:
    rows = star.manager_overrides(lake.silver["sales_reps"])
    return review.override_summary(_appended(lake, "manager_overrides", app_tables.append_override, rows))


def _submitted(lake: Lake) -> DataFrame:
    sheet = lake.sheet()
    raised = (F.col("original_forecast") + 1000).alias("adjusted_forecast")
    edits = sheet.filter(F.col("stage") == "Negotiation").select("rep_id", "deal_id", raised)
    return _flat(forecast.feedback_submission(sheet, edits, confidence="High").drop("submitted_at"))


def _exported(lake: Lake) -> DataFrame:
    rows = reports.report(lake.gold, reports.MONTHLY)
    path = reports.write_report(rows, lake.scratch("csv"), reports.MONTHLY, AS_OF)
    return lake.spark.read.options(**CSV_OPTIONS).schema(rows.schema).csv(path)


_QUERIES: dict[str, Callable[[Lake], DataFrame]] = {
    # cleaned entities
    **{f"silver_{name}": (lambda lake, name=name: lake.silver[name]) for name in ENTITIES},
    # rollups and gold tables
    "invoice_month_rollup": lambda lake: gold.invoice_month_rollup(lake.silver["invoices"]),
    "order_month_rollup": lambda lake: gold.order_month_rollup(lake.silver["orders"]),
    "deal_month_rollup": lambda lake: gold.deal_month_rollup(lake.silver["deals"]),
    "gold_rep_monthly_summary": lambda lake: lake.summary,
    "gold_active_deals": lambda lake: lake.deals,
    "gold_invoice_details": lambda lake: lake.invoices,
    "gold_category_summary": lambda lake: lake.categories,
    # serving reads
    "list_sales_reps": lambda lake: serving.list_sales_reps(lake.summary),
    "list_regions": lambda lake: serving.list_regions(lake.summary),
    "rep_name_lookup": lambda lake: serving.rep_name_lookup(lake.summary),
    "monthly_summary_all": lambda lake: serving.monthly_summary(lake.summary),
    "monthly_summary_rep": lambda lake: serving.monthly_summary(lake.summary, rep_id=REP),
    "monthly_summary_region": lambda lake: serving.monthly_summary(lake.summary, region=REGION),
    "active_deals_all": lambda lake: serving.active_deals(lake.deals),
    "active_deals_rep": lambda lake: serving.active_deals(lake.deals, rep_id=REP),
    "active_deals_region": lambda lake: serving.active_deals(lake.deals, region=REGION),
    "invoice_details_all": lambda lake: serving.invoice_details(lake.newest()),
    "invoice_details_rep": lambda lake: serving.invoice_details(lake.newest(rep_id=REP), rep_id=REP),
    "invoice_details_region": lambda lake: serving.invoice_details(lake.newest(region=REGION), region=REGION),
    "category_summary_all": lambda lake: serving.category_summary(lake.categories),
    "category_summary_region": lambda lake: serving.category_summary(lake.categories, lake.invoices, REGION),
    "category_summary_within_region": lambda lake: serving.category_summary_within(lake.invoices, REGION),
    "feedback_all": lambda lake: _flat(serving.read_feedback(lake.feedback)),
    "feedback_rep": lambda lake: _flat(serving.read_feedback(lake.feedback, REP)),
    # dashboard
    "current_month_kpis": lambda lake: dashboard.current_month_kpis(lake.summary),
    "current_month_kpis_as_of": lambda lake: dashboard.current_month_kpis(lake.summary, AS_OF),
    "monthly_trend": lambda lake: dashboard.monthly_trend(lake.summary),
    "current_month_kpis_rep": lambda lake: dashboard.current_month_kpis(serving.monthly_summary(lake.summary, rep_id=REP)),
    "current_month_kpis_region": lambda lake: dashboard.current_month_kpis(
        serving.monthly_summary(lake.summary, region=REGION)
    ),
    "current_month_kpi_labels": lambda lake: dashboard.current_month_kpi_labels(dashboard.current_month_kpis(lake.summary)),
    "monthly_trend_rep": lambda lake: dashboard.monthly_trend(serving.monthly_summary(lake.summary, rep_id=REP)),
    "monthly_trend_region": lambda lake: dashboard.monthly_trend(serving.monthly_summary(lake.summary, region=REGION)),
    "deals_by_stage": lambda lake: dashboard.pipeline_by_stage(lake.open_deals),
    "deals_by_stage_rep": lambda lake: dashboard.pipeline_by_stage(lake.open_deals.where(serving.build_filter(REP))),
    "deals_by_stage_region": lambda lake: dashboard.pipeline_by_stage(serving.active_deals(lake.deals, region=REGION)),
    "revenue_by_category": lambda lake: dashboard.revenue_by_category(lake.categories),
    "category_share": lambda lake: _rounded(dashboard.category_share(lake.categories), "share", digits=9),
    # forecast and review
    "adjustment_sheet": lambda lake: lake.sheet(),
    "adjustment_sheet_rep": lambda lake: lake.sheet(REP),
    "feedback_submission": _submitted,
    "explode_adjustments": lambda lake: forecast.explode_adjustments(lake.feedback),
    "net_adjustment_total": lambda lake: forecast.net_adjustment_total(lake.feedback),
    "monthly_forecast": lambda lake: forecast.monthly_forecast(lake.summary),
    "rep_adjusted_forecast": lambda lake: _rounded(lake.forecast, "rep_adjusted_forecast"),
    "rep_adjusted_forecast_override": lambda lake: _rounded(
        forecast.rep_adjusted_forecast(lake.summary, lake.feedback, override_pct=5, latest_only=True),
        "rep_adjusted_forecast",
    ),
    # one rep's months with that rep's feedback; a region's months with everybody's
    "rep_adjusted_forecast_rep": lambda lake: _rounded(lake.forecast_of(rep_id=REP), "rep_adjusted_forecast"),
    "rep_adjusted_forecast_region": lambda lake: _rounded(lake.forecast_of(region=REGION), "rep_adjusted_forecast"),
    "forecast_totals_region": lambda lake: _rounded(
        forecast.forecast_totals(lake.forecast_of(region=REGION)), "rep_adjusted_forecast", "delta"
    ),
    "forecast_totals": lambda lake: _rounded(forecast.forecast_totals(lake.forecast), "rep_adjusted_forecast", "delta"),
    "forecast_total_labels": lambda lake: forecast.forecast_total_labels(forecast.forecast_totals(lake.forecast)),
    "forecast_display_table": lambda lake: forecast.forecast_display_table(lake.forecast),
    "feedback_review": lambda lake: review.feedback_review(lake.feedback),
    "nonzero_adjustments": lambda lake: review.nonzero_adjustments(lake.feedback),
    # reports
    "report_monthly": lambda lake: reports.report(lake.gold, reports.MONTHLY),
    "report_deals": lambda lake: reports.report(lake.gold, reports.DEALS, region=REGION),
    "report_invoices": lambda lake: reports.report(
        {"gold_invoice_details": lake.ordered("gold_invoice_details", serving.newest_first())}, reports.INVOICES
    ),
    "report_invoices_rep": lambda lake: reports.report(lake.gold, reports.INVOICES, rep_id=REP),
    "report_invoices_rows": lambda lake: reports.report(
        lake.gold, reports.INVOICES, rep_id=REP, rows=serving.DRILL_DOWN_ROWS
    ),
    "report_forecast": lambda lake: reports.report(lake.gold, reports.FORECAST, region=REGION),
    "report_monthly_span": lambda lake: reports.report(lake.gold, reports.MONTHLY, start=SPAN[0], end=SPAN[1]),
    "report_row_count": lambda lake: reports.report_row_count(lake.open_deals),  # lookups add no rows
    # raw profile
    "profile_counts": lambda lake: profile.profile_counts(lake.raw),
    "profile_values": lambda lake: profile.profile_values(lake.raw),
    "raw_total_invoiced": lambda lake: _rounded(profile.raw_total_invoiced(lake.raw["invoices"]), "total_invoiced"),
    "raw_total_recognized": lambda lake: _rounded(
        profile.raw_total_recognized(lake.raw["invoices"]), "total_recognized"
    ),
    "raw_total_open_deals": lambda lake: _rounded(profile.raw_total_pipeline(lake.raw["deals"]), "total_pipeline"),
    # ingest and sinks: write below the scratch folder and read back
    **{f"ingest_{name}": (lambda lake, name=name: _ingested(lake, name)) for name in ENTITIES},
    "land_parquet": _landed,
    "write_clustered": _clustered,
    "refresh_silver": _refreshed_silver,
    "refresh_gold": _refreshed_gold,
    "refresh_all": _refreshed,
    "snapshot_sync": _synced,
    "append_feedback": _appended_feedback,
    "append_override": _appended_overrides,
    "append_feedback_once": _appended_once,
    # incremental: two refreshes, merged batches, reads by the statistics of published files
    "refresh_in_deltas": _refreshed_in_deltas,
    "gold_change_feed": _change_feed,
    "rejected_rows": _rejected_rows,
    "compacted_batches": lambda lake: _compacted(lake, "invoices"),
    "write_interleaved": _interleaved,
    "published_invoice_details_all": lambda lake: serving.published_invoice_details(lake.spark, lake.published),
    "published_invoice_details_rep": lambda lake: serving.published_invoice_details(lake.spark, lake.published, rep_id=REP),
    "published_invoice_details_region": lambda lake: serving.published_invoice_details(lake.spark, lake.published, region=REGION),
    "published_month_kpis": lambda lake: dashboard.current_month_kpis(manifest.latest_month(lake.spark, lake.published)),
    "published_month_kpis_as_of": lambda lake: dashboard.current_month_kpis(manifest.latest_month(lake.spark, lake.published, as_of=AS_OF)),
    "export_csv": _exported,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name. They share the definitions, not the data, of the layers over a folder."""
    lakes: dict[tuple[SparkSession, str], Lake] = {}

    def query(build: Callable[[Lake], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            if (spark, folder) not in lakes:
                lakes[spark, folder] = Lake(spark, folder)
            return presentable(build(lakes[spark, folder]))

        return run

    return {name: query(build) for name, build in _QUERIES.items()}
