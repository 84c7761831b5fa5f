"""Declared schemas of the raw entities and application tables, and their fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Must equal the data they are matched against.
OPEN_STAGES = ("Prospecting", "Discovery", "Proposal Sent", "Negotiation", "Verbal Commit")  # funnel order
STAGE_WON = "Closed Won"
STAGE_LOST = "Closed Lost"
STATUS_CANCELLED = "Cancelled"
SHIPPED_STATUSES = ("Shipped", "Delivered")
CONFIDENCE_LEVELS = ("Very Low", "Low", "Medium", "High", "Very High")  # ascending
ALL = "All"  # the selector entry that means "no filter"

MONEY = T.DecimalType(18, 2)
RATIO = T.DecimalType(5, 2)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_TEXT, _REAL, _WHOLE, _FLAG = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

SALES_REPS = _schema(
    rep_id=_TEXT, rep_name=_TEXT, email=_TEXT, region=_TEXT, role=_TEXT, manager_name=_TEXT,
    hire_date=_TEXT, annual_quota=_REAL,
)
CUSTOMERS = _schema(
    customer_id=_TEXT, customer_name=_TEXT, vertical=_TEXT, tier=_TEXT, region=_TEXT,
    assigned_rep_id=_TEXT, created_date=_TEXT,
)
INVOICES = _schema(
    invoice_id=_TEXT, customer_id=_TEXT, rep_id=_TEXT, invoice_date=_TEXT, invoice_amount=_REAL, status=_TEXT,
    revenue_recognized_pct=_REAL, product_category=_TEXT, po_number=_TEXT, payment_terms=_TEXT,
)
ORDERS = _schema(
    order_id=_TEXT, customer_id=_TEXT, rep_id=_TEXT, order_date=_TEXT, order_amount=_REAL, ship_date=_TEXT,
    ship_status=_TEXT, product_category=_TEXT, quantity=_WHOLE, is_confirmed=_FLAG,
)
DEALS = _schema(
    deal_id=_TEXT, customer_id=_TEXT, rep_id=_TEXT, deal_name=_TEXT, stage=_TEXT, deal_amount=_REAL,
    forecasted_amount=_REAL, probability=_REAL, product_category=_TEXT, created_date=_TEXT,
    expected_close_date=_TEXT, deal_type=_TEXT, next_step=_TEXT,
)

ADJUSTMENTS = T.ArrayType(_schema(deal_id=_TEXT, original_forecast=MONEY, adjusted_forecast=MONEY))
SALES_FEEDBACK = _schema(
    id=_TEXT, rep_id=_TEXT, rep_name=_TEXT, submitted_at=T.TimestampType(), confidence=_TEXT, risks=_TEXT,
    upside=_TEXT, notes=_TEXT, adjustments=ADJUSTMENTS,
)
MANAGER_OVERRIDES = _schema(
    id=_TEXT, manager_override_pct=T.IntegerType(), manager_notes=_TEXT, approved_at=T.TimestampType(),
    approved_by=_TEXT,
)


@dataclass(frozen=True)
class Entity:
    """A raw entity: its schema, its logical key and the columns its tables are laid out by."""

    name: str
    schema: T.StructType
    key: str
    bronze_layout: tuple[str, ...]
    silver_layout: tuple[str, ...]


ENTITIES = {
    e.name: e
    for e in (
        Entity("sales_reps", SALES_REPS, "rep_id", ("region",), ("region",)),
        Entity("customers", CUSTOMERS, "customer_id", ("region", "tier"), ("region", "tier")),
        Entity("invoices", INVOICES, "invoice_id", ("invoice_date",), ("invoice_date",)),
        Entity("orders", ORDERS, "order_id", ("order_date",), ("order_date",)),
        Entity("deals", DEALS, "deal_id", ("created_date",), ("created_date", "stage")),
    )
}

GOLD_LAYOUT = {
    "gold_rep_monthly_summary": ("month_date", "rep_id"),
    "gold_active_deals": ("expected_close_date", "stage"),
    "gold_invoice_details": ("invoice_date", "rep_id"),
    "gold_category_summary": ("month_date", "product_category"),
}
# The column that tells a gold table's rows apart within its layout.
GOLD_KEY = {
    "gold_rep_monthly_summary": "rep_id",
    "gold_active_deals": "deal_id",
    "gold_invoice_details": "invoice_id",
    "gold_category_summary": "product_category",
}
# The serving copies are ordered by what the reads filter on.
SERVING_LAYOUT = {
    "gold_rep_monthly_summary": ("region", "rep_id", "month_date"),
    "gold_active_deals": ("rep_region", "rep_id", "expected_close_date"),
    "gold_invoice_details": ("rep_region", "rep_id", "invoice_date"),
    "gold_category_summary": ("month_date", "product_category"),
}
