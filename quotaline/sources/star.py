"""The five raw entities, and rep feedback, derived from star-schema tables (supplier, customer, orders, lineitem).

Everything is lazy: a query that needs two columns of one entity reads two columns of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotaline.sources import schemas as S


# Values that only these fixtures use; no operator matches them.
CATEGORIES = tuple(f"Line {letter}" for letter in "ABCDEFGH")
ROLES = ("Field", "Key Account", "Principal")
TIERS = ("Large", "Middle", "Small")
DEAL_TYPES = ("First", "Upgrade", "Repeat")
TERMS = ("14 days", "28 days", "56 days")


class StarTables(dict):
    """The tables of a folder by name, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]


def _code(prefix: str, number: Column, width: int) -> Column:
    """``PREFIX-000042``; numbers wider than ``width`` keep all their digits, so ids never collide."""
    digits = number.cast("string")
    return F.concat(F.lit(f"{prefix}-"), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))


def _rep(number: Column) -> Column:
    return _code("REP", number, 6)


def _customer(number: Column) -> Column:
    return _code("CUST", number, 8)


def _category(number: Column, first: int) -> Column:
    names = F.array(*[F.lit(c) for c in CATEGORIES[:first]])
    return F.element_at(names, (number % first + 1).cast("int"))


def _ladder(number: Column, steps: dict[int, object], otherwise: object) -> Column:
    """The value of the first upper bound above ``number``."""
    out = None
    for bound, value in steps.items():
        out = F.when(number < bound, value) if out is None else out.when(number < bound, value)
    return out.otherwise(otherwise)


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def _day_after(start: Column, days: Column) -> Column:
    return F.date_add(start, days.cast("int"))


def _text(value: Column) -> Column:
    return value.cast("string")


def _moment(seconds: Column) -> Column:
    """So many seconds into 2001, by the wall clock of any session zone."""
    start = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(secs=seconds)).cast("timestamp")


def _rep_number() -> Column:
    return F.substring_index("rep_id", "-", -1).cast("bigint")


def _sign_flipped(amount: str, number: str, every: int) -> Column:
    return F.when(F.col(number) % every == 0, -F.col(amount)).otherwise(F.col(amount))


def _with_region(df: DataFrame, tables: StarTables, nation_key: str) -> DataFrame:
    """A row for each match of its nation, as an inner join gives them.

    The nations are looked up in a map: the planner takes a join's size for the product of its sides', and would then
    shuffle all facts to dimensions that it could broadcast.
    """
    places = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    named = places.where(F.col("n_nationkey").isNotNull()).groupBy("n_nationkey").agg(F.collect_list(F.struct("r_name")).alias("found"))
    known = named.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "found")))).scalar()
    return df.withColumn("place", F.explode(F.element_at(known, F.col(nation_key)))).withColumn("r_name", F.col("place.r_name")).drop("place")


def raw_sales_reps(tables: StarTables) -> DataFrame:
    key = F.col("s_suppkey")
    return _with_region(tables["supplier"], tables, "s_nationkey").select(
        _rep(key + 1).alias("rep_id"),
        F.when(key % 50 != 49, F.col("s_name")).alias("rep_name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.col("r_name").alias("region"),
        _ladder(key % 20, {10: ROLES[0], 17: ROLES[1]}, ROLES[2]).alias("role"),
        F.concat(F.lit("Manager "), F.col("r_name")).alias("manager_name"),
        _text(_day_after(F.lit("2015-01-01").cast("date"), key * 7 % 2000)).alias("hire_date"),
        (500000 + F.col("s_acctbal") * 100).alias("annual_quota"),
    )


def _rep_count(tables: StarTables) -> Column:
    """Number of reps, as a scalar subquery."""
    return tables["supplier"].agg(F.count("*")).scalar()


def raw_customers(tables: StarTables) -> DataFrame:
    key = F.col("c_custkey")
    return _with_region(tables["customer"], tables, "c_nationkey").select(
        _customer(key + 1).alias("customer_id"),
        F.when(key % 100 != 99, F.col("c_name")).alias("customer_name"),
        F.col("c_mktsegment").alias("vertical"),
        _ladder(key % 20, {3: TIERS[0], 10: TIERS[1]}, TIERS[2]).alias("tier"),
        F.col("r_name").alias("region"),
        _rep(key % _rep_count(tables) + 1).alias("assigned_rep_id"),
        _text(_day_after(F.lit("2018-01-01").cast("date"), key % 1500)).alias("created_date"),
    )


def raw_invoices(tables: StarTables) -> DataFrame:
    orders = tables["orders"].select("o_orderkey", "o_custkey")
    # Typed before the join, where days and whole numbers shuffle as fewer bytes than timestamps and doubles.
    lines = tables["lineitem"].withColumns({"l_shipdate": _day("l_shipdate"), "l_quantity": F.col("l_quantity").cast("int")})
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bucket = F.col("l_partkey") % 20
    id_parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return lines.select(
        F.concat_ws(
            "-",
            F.lit("INV"),
            *[_text(F.col(c)) for c in id_parts],
            _text(F.col("l_quantity")),
            _text(F.col("l_shipdate")),
        ).alias("invoice_id"),
        _customer(F.col("o_custkey") + 1).alias("customer_id"),
        _rep(F.col("l_suppkey") + 1).alias("rep_id"),
        _text(F.col("l_shipdate")).alias("invoice_date"),
        _sign_flipped("l_extendedprice", "l_partkey", 97).alias("invoice_amount"),
        _ladder(
            bucket, {6: "Invoiced", 13: "Shipped", 16: "Partially Shipped", 19: "Delivered"}, S.STATUS_CANCELLED
        ).alias("status"),
        _ladder(
            bucket,
            {
                6: (F.col("l_linenumber") % 3) * F.lit(0.25),
                13: F.lit(1.0),
                16: (25 + F.col("l_suppkey") % 51).cast("double") / 100,
                19: F.lit(1.0),
            },
            F.lit(0.0),
        ).alias("revenue_recognized_pct"),
        F.when(F.col("l_suppkey") == 0, CATEGORIES[7])
        .otherwise(_category(F.col("l_partkey"), 7))
        .alias("product_category"),
        F.concat(F.lit("PO-"), _text(100000 + F.col("l_orderkey") % 900000)).alias("po_number"),
        _ladder(F.col("l_linenumber") % 10, {4: TERMS[0], 7: TERMS[1]}, TERMS[2]).alias("payment_terms"),
    )


def raw_orders(tables: StarTables) -> DataFrame:
    key, status, day = F.col("o_orderkey"), F.col("o_orderstatus"), _day("o_orderdate")
    return tables["orders"].select(
        _code("ORD", key + 1, 9).alias("order_id"),
        _customer(F.col("o_custkey") + 1).alias("customer_id"),
        _rep(F.col("o_custkey") % _rep_count(tables) + 1).alias("rep_id"),
        _text(day).alias("order_date"),
        _sign_flipped("o_totalprice", "o_orderkey", 101).alias("order_amount"),
        F.when(status != "P", _text(_day_after(day, key % 11))).alias("ship_date"),
        F.when(status == "P", "Pending Shipment")
        .when(status == "F", "Delivered")
        .when(key % 3 == 0, "In Transit")
        .otherwise("Shipped")
        .alias("ship_status"),
        _category(key, 8).alias("product_category"),
        (1 + key % 20).alias("quantity"),
        F.when(key % 29 != 0, key % 10 != 0).alias("is_confirmed"),
    )


def raw_deals(tables: StarTables) -> DataFrame:
    key, day, step = F.col("o_orderkey"), _day("o_orderdate"), F.col("o_orderkey") % 60
    amount = _sign_flipped("o_totalprice", "o_orderkey", 101)
    probability = (5 + F.col("o_custkey") % 91).cast("double") / 100
    stages = dict(zip((9, 21, 33, 42, 48, 54, 57), (*S.OPEN_STAGES, S.STAGE_WON, S.STAGE_LOST)))
    # Multiplied as decimals: rounding a binary product to cents is not reproducible between engines.
    forecast = (amount.cast(S.MONEY) * probability.cast(S.RATIO)).cast(S.MONEY)
    return (
        tables["orders"].select(
            _code("OPP", key + 1, 9).alias("deal_id"),
            _customer(F.col("o_custkey") + 1).alias("customer_id"),
            _rep((F.col("o_custkey") + 3) % _rep_count(tables) + 1).alias("rep_id"),
            F.concat(F.lit("Deal "), _text(key), F.lit(" - "), F.col("o_orderpriority")).alias("deal_name"),
            _ladder(step, stages, F.lit(None)).alias("stage"),
            amount.alias("deal_amount"),
            forecast.cast("double").alias("forecasted_amount"),
            probability.alias("probability"),
            _category(key, 8).alias("product_category"),
            _text(day).alias("created_date"),
            _text(_day_after(day, 14 + key * 7 % 90)).alias("expected_close_date"),
            F.when(key % 9 == 0, DEAL_TYPES[0]).when(key % 9 == 3, DEAL_TYPES[1]).otherwise(DEAL_TYPES[2]).alias("deal_type"),
            F.when(key % 2 == 0, "First call").otherwise("Second call").alias("next_step"),
        )
    )


RAW = {
    "sales_reps": raw_sales_reps,
    "customers": raw_customers,
    "invoices": raw_invoices,
    "orders": raw_orders,
    "deals": raw_deals,
}


def sales_feedback(open_deals: DataFrame, reps: DataFrame, sheet_size: int = 15) -> DataFrame:
    """One submission per rep over its adjustment sheet (the first ``sheet_size`` deals by close date, as in the form).

    The rep's name is looked up once per submission. The row-number filter is pruned on the map side, so a rep with
    very many deals ships ``sheet_size`` of them per task, and the array is bounded by ``sheet_size``.
    """
    by_close = Window.partitionBy("rep_id").orderBy(F.asc_nulls_last("expected_close_date"), "deal_id")
    factor = (
        F.when(F.col("line") % 3 == 0, F.lit("0.90")).when(F.col("line") % 3 == 1, F.lit("1.10")).otherwise(F.lit("1.00"))
    )
    lines = (
        open_deals.filter(F.col("rep_id").isNotNull())
        .select("rep_id", "deal_id", "expected_close_date", "forecasted_amount")
        .withColumn("line", F.row_number().over(by_close))
        .filter(F.col("line") <= sheet_size)
        .withColumn("adjusted", (F.col("forecasted_amount") * factor.cast(S.RATIO)).cast(S.MONEY))
    )
    number = _rep_number()
    entry = F.struct(
        "line",
        "deal_id",
        F.col("forecasted_amount").alias("original_forecast"),
        F.col("adjusted").alias("adjusted_forecast"),
    )
    grouped = lines.groupBy("rep_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    grouped = grouped.join(reps.select("rep_id", "rep_name"), "rep_id", "left")
    return grouped.select(
        "rep_id",
        "rep_name",
        _moment(number % 100_000 * 3660).alias("submitted_at"),
        F.element_at(
            F.array(*[F.lit(c) for c in (*S.CONFIDENCE_LEVELS, "Undecided")]), (number % 6 + 1).cast("int")
        ).alias("confidence"),
        F.when(number % 3 == 0, "").otherwise(F.concat(F.lit("Risk, \""), _text(number), F.lit("\""))).alias("risks"),
        F.when(number % 4 != 0, F.concat(F.lit("Upside "), _text(number))).alias("upside"),
        F.lit("").alias("notes"),
        F.transform(
            "entries",
            lambda e: F.struct(*[e[c].alias(c) for c in ("deal_id", "original_forecast", "adjusted_forecast")]),
        ).alias("adjustments"),
    )


def manager_overrides(reps: DataFrame) -> DataFrame:
    """One override per rep, between -30 and 30 percent."""
    number = _rep_number()
    return reps.select(
        (number % 61 - 30).cast("int").alias("manager_override_pct"),
        F.concat(F.lit("Review of "), F.col("rep_id")).alias("manager_notes"),
        _moment(number % 100_000 * 60).alias("approved_at"),
        F.col("manager_name").alias("approved_by"),
    )
