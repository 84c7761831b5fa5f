"""One SQL statement per query, over the same star-schema tables, for an independent engine.

Statements share named relations (raw entities, cleaned entities, gold tables); ``_statement`` puts in front of a
final SELECT the ones it needs. Output columns are doubles for money and ISO text for dates, as the queries return.
"""

from __future__ import annotations

import re

REGION = "ASIA"
REP = "REP-000003"

# Fixture categories; fixed values: funnel stages and confidence levels in order.
CATEGORIES = [f"Line {letter}" for letter in "ABCDEFGH"]
STAGES = ["Prospecting", "Discovery", "Proposal Sent", "Negotiation", "Verbal Commit"]
CONFIDENCE = ["Very Low", "Low", "Medium", "High", "Very High"]
ICONS = ["🔴", "🟠", "🟡", "🟢", "🟣"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _code(prefix: str, number: str, width: int) -> str:
    digits = f"CAST({number} AS VARCHAR)"
    return f"'{prefix}-' || lpad({digits}, CAST(greatest({width}, length({digits})) AS INT), '0')"


def _rep(number: str) -> str:
    return _code("REP", number, 6)


def _cust(number: str) -> str:
    return _code("CUST", number, 8)


def _category(number: str, first: int) -> str:
    return f"{_list(CATEGORIES[:first])}[CAST({number} % {first} + 1 AS INT)]"


def _dollars(value: str) -> str:
    return f"format('${{:,.0f}}', CAST({value} AS DOUBLE))"


def _compact(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 1000000 THEN format('${{:,.1f}}M', CAST({value} AS DOUBLE) / 1000000) "
        f"WHEN {value} >= 1000 THEN format('${{:,.0f}}K', CAST({value} AS DOUBLE) / 1000) ELSE {_dollars(value)} END"
    )


_REPS = "(SELECT count(*) FROM supplier)"
_EPOCH = "TIMESTAMP '2001-01-01 00:00:00'"
_DEAL_AMOUNT = "CASE WHEN o_orderkey % 101 = 0 THEN -o_totalprice ELSE o_totalprice END"
_PROBABILITY = "CAST(5 + o_custkey % 91 AS DOUBLE) / 100"
_CLOSE = "CAST(o_orderdate AS DATE) + CAST(14 + o_orderkey * 7 % 90 AS INT)"
# To six decimals, half up, in whole numbers; a double average may round the last digit the other way.
_AVERAGE = (
    "CAST((CAST(sum(invoice_amount) * 100 AS HUGEINT) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000"
)

RELATIONS = {
    "place": "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "raw_sales_reps": f"""
        SELECT {_rep('s_suppkey + 1')} AS rep_id,
               CASE WHEN s_suppkey % 50 <> 49 THEN s_name END AS rep_name,
               lower(s_name) || '@example.com' AS email, r_name AS region,
               CASE WHEN s_suppkey % 20 < 10 THEN 'Field'
                    WHEN s_suppkey % 20 < 17 THEN 'Key Account'
                    ELSE 'Principal' END AS role,
               'Manager ' || r_name AS manager_name,
               CAST(DATE '2015-01-01' + CAST(s_suppkey * 7 % 2000 AS INT) AS VARCHAR) AS hire_date,
               500000 + s_acctbal * 100 AS annual_quota
        FROM supplier JOIN place ON s_nationkey = n_nationkey""",
    "raw_customers": f"""
        SELECT {_cust('c_custkey + 1')} AS customer_id,
               CASE WHEN c_custkey % 100 <> 99 THEN c_name END AS customer_name, c_mktsegment AS vertical,
               CASE WHEN c_custkey % 20 < 3 THEN 'Large' WHEN c_custkey % 20 < 10 THEN 'Middle'
                    ELSE 'Small' END AS tier,
               r_name AS region, {_rep(f'c_custkey % {_REPS} + 1')} AS assigned_rep_id,
               CAST(DATE '2018-01-01' + CAST(c_custkey % 1500 AS INT) AS VARCHAR) AS created_date
        FROM customer JOIN place ON c_nationkey = n_nationkey""",
    "raw_invoices": f"""
        SELECT 'INV-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
                 || CAST(l_quantity AS INT) || '-' || CAST(l_shipdate AS DATE) AS invoice_id,
               {_cust('o_custkey + 1')} AS customer_id, {_rep('l_suppkey + 1')} AS rep_id,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS invoice_date,
               CASE WHEN l_partkey % 97 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS invoice_amount,
               CASE WHEN l_partkey % 20 < 6 THEN 'Invoiced' WHEN l_partkey % 20 < 13 THEN 'Shipped'
                    WHEN l_partkey % 20 < 16 THEN 'Partially Shipped' WHEN l_partkey % 20 < 19 THEN 'Delivered'
                    ELSE 'Cancelled' END AS status,
               CASE WHEN l_partkey % 20 < 6 THEN (l_linenumber % 3) * CAST(0.25 AS DOUBLE)
                    WHEN l_partkey % 20 < 13 THEN CAST(1 AS DOUBLE)
                    WHEN l_partkey % 20 < 16 THEN CAST(25 + l_suppkey % 51 AS DOUBLE) / 100
                    WHEN l_partkey % 20 < 19 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)
               END AS revenue_recognized_pct,
               CASE WHEN l_suppkey = 0 THEN 'Line H' ELSE {_category('l_partkey', 7)} END AS product_category,
               'PO-' || (100000 + l_orderkey % 900000) AS po_number,
               CASE WHEN l_linenumber % 10 < 4 THEN '14 days' WHEN l_linenumber % 10 < 7 THEN '28 days'
                    ELSE '56 days' END AS payment_terms
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_orders": f"""
        SELECT {_code('ORD', 'o_orderkey + 1', 9)} AS order_id, {_cust('o_custkey + 1')} AS customer_id,
               {_rep(f'o_custkey % {_REPS} + 1')} AS rep_id,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
               {_DEAL_AMOUNT} AS order_amount,
               CASE WHEN o_orderstatus <> 'P'
                    THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 AS INT) AS VARCHAR) END AS ship_date,
               CASE WHEN o_orderstatus = 'P' THEN 'Pending Shipment' WHEN o_orderstatus = 'F' THEN 'Delivered'
                    WHEN o_orderkey % 3 = 0 THEN 'In Transit' ELSE 'Shipped' END AS ship_status,
               {_category('o_orderkey', 8)} AS product_category, 1 + o_orderkey % 20 AS quantity,
               CASE WHEN o_orderkey % 29 <> 0 THEN o_orderkey % 10 <> 0 END AS is_confirmed
        FROM orders""",
    "raw_deals": f"""
        SELECT {_code('OPP', 'o_orderkey + 1', 9)} AS deal_id, {_cust('o_custkey + 1')} AS customer_id,
               {_rep(f'(o_custkey + 3) % {_REPS} + 1')} AS rep_id,
               'Deal ' || o_orderkey || ' - ' || o_orderpriority AS deal_name,
               CASE WHEN o_orderkey % 60 < 9 THEN 'Prospecting' WHEN o_orderkey % 60 < 21 THEN 'Discovery'
                    WHEN o_orderkey % 60 < 33 THEN 'Proposal Sent' WHEN o_orderkey % 60 < 42 THEN 'Negotiation'
                    WHEN o_orderkey % 60 < 48 THEN 'Verbal Commit' WHEN o_orderkey % 60 < 54 THEN 'Closed Won'
                    WHEN o_orderkey % 60 < 57 THEN 'Closed Lost' END AS stage,
               {_DEAL_AMOUNT} AS deal_amount,
               CAST(CAST(CAST({_DEAL_AMOUNT} AS DECIMAL(18,2)) * CAST({_PROBABILITY} AS DECIMAL(5,2))
                    AS DECIMAL(18,2)) AS DOUBLE) AS forecasted_amount,
               {_PROBABILITY} AS probability, {_category('o_orderkey', 8)} AS product_category,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_date,
               CAST({_CLOSE} AS VARCHAR) AS expected_close_date,
               CASE o_orderkey % 9 WHEN 0 THEN 'First' WHEN 3 THEN 'Upgrade' ELSE 'Repeat' END AS deal_type,
               CASE WHEN o_orderkey % 2 = 0 THEN 'First call' ELSE 'Second call' END AS next_step
        FROM orders""",
    "silver_sales_reps": """
        SELECT * REPLACE (CAST(hire_date AS DATE) AS hire_date, CAST(annual_quota AS DECIMAL(18,2)) AS annual_quota)
        FROM raw_sales_reps WHERE rep_id IS NOT NULL AND rep_name IS NOT NULL""",
    "silver_customers": """
        SELECT * REPLACE (CAST(created_date AS DATE) AS created_date)
        FROM raw_customers WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL""",
    "typed_invoices": """
        SELECT * REPLACE (CAST(invoice_date AS DATE) AS invoice_date,
                          CAST(invoice_amount AS DECIMAL(18,2)) AS invoice_amount,
                          CAST(revenue_recognized_pct AS DECIMAL(5,2)) AS revenue_recognized_pct)
        FROM raw_invoices WHERE invoice_id IS NOT NULL AND invoice_amount > 0 AND status <> 'Cancelled'""",
    "silver_invoices": """
        SELECT *, round(invoice_amount * revenue_recognized_pct, 2) AS recognized_revenue FROM typed_invoices""",
    "silver_orders": """
        SELECT * REPLACE (CAST(order_date AS DATE) AS order_date, CAST(order_amount AS DECIMAL(18,2)) AS order_amount,
                          CAST(ship_date AS DATE) AS ship_date, CAST(quantity AS INT) AS quantity)
        FROM raw_orders WHERE order_id IS NOT NULL AND order_amount > 0""",
    "silver_deals": """
        SELECT * REPLACE (CAST(deal_amount AS DECIMAL(18,2)) AS deal_amount,
                          CAST(forecasted_amount AS DECIMAL(18,2)) AS forecasted_amount,
                          CAST(probability AS DECIMAL(5,2)) AS probability,
                          CAST(created_date AS DATE) AS created_date,
                          CAST(expected_close_date AS DATE) AS expected_close_date)
        FROM raw_deals WHERE deal_id IS NOT NULL AND deal_amount > 0 AND stage <> 'Closed Lost'""",
    "open_deals": "SELECT * FROM silver_deals WHERE stage <> 'Closed Won'",
    "invoice_month": """
        SELECT rep_id, CAST(date_trunc('month', invoice_date) AS DATE) AS month_date,
               sum(invoice_amount) AS total_invoiced, sum(recognized_revenue) AS total_recognized,
               count(*) AS invoice_count
        FROM silver_invoices GROUP BY ALL""",
    "order_month": """
        SELECT rep_id, CAST(date_trunc('month', order_date) AS DATE) AS month_date,
               sum(order_amount) AS total_confirmed_orders, count(*) AS confirmed_order_count,
               coalesce(sum(order_amount) FILTER (ship_status IN ('Shipped', 'Delivered')), 0) AS shipped_revenue
        FROM silver_orders WHERE is_confirmed GROUP BY ALL""",
    "deal_month": """
        SELECT rep_id, CAST(date_trunc('month', expected_close_date) AS DATE) AS month_date,
               sum(deal_amount) AS total_pipeline_value, sum(forecasted_amount) AS total_weighted_pipeline,
               count(*) AS active_deal_count
        FROM open_deals GROUP BY ALL""",
    "rep_month": """
        SELECT * FROM invoice_month FULL JOIN order_month USING (rep_id, month_date)
                           FULL JOIN deal_month USING (rep_id, month_date)""",
    "rep_month_filled": """
        SELECT rep_id, month_date, coalesce(COLUMNS(* EXCLUDE (rep_id, month_date)), 0) FROM rep_month""",
    "summary": """
        SELECT m.*, rep_name, region, role, annual_quota, total_invoiced + total_weighted_pipeline AS blended_forecast
        FROM rep_month_filled m LEFT JOIN silver_sales_reps USING (rep_id)""",
    "rep": "SELECT rep_id, rep_name, region AS rep_region FROM silver_sales_reps",
    "cust": """
        SELECT customer_id, customer_name, vertical AS customer_vertical, tier AS customer_tier
        FROM silver_customers""",
    "active": "SELECT * FROM open_deals LEFT JOIN rep USING (rep_id) LEFT JOIN cust USING (customer_id)",
    "details": "SELECT * FROM silver_invoices LEFT JOIN rep USING (rep_id) LEFT JOIN cust USING (customer_id)",
    "category_month": f"""
        SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month_date, product_category,
               sum(invoice_amount) AS total_invoiced, sum(recognized_revenue) AS total_recognized,
               count(*) AS invoice_count, {_AVERAGE} AS avg_invoice_amount
        FROM silver_invoices GROUP BY ALL""",
    "region_categories": f"""
        SELECT * FROM category_month
        WHERE product_category IN (SELECT product_category FROM details WHERE rep_region = '{REGION}')""",
    "region_category_month": f"""
        SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month_date, product_category,
               sum(invoice_amount) AS total_invoiced, sum(recognized_revenue) AS total_recognized,
               count(*) AS invoice_count, {_AVERAGE} AS avg_invoice_amount
        FROM details WHERE rep_region = '{REGION}' GROUP BY ALL""",
    "sheet": """
        SELECT * FROM active
        QUALIFY row_number() OVER (PARTITION BY rep_id ORDER BY expected_close_date NULLS LAST, deal_id) <= 15""",
    "adjustment": f"""
        SELECT rep_id, rep_name, deal_id, forecasted_amount AS original_forecast,
               CAST(forecasted_amount * CASE line % 3 WHEN 0 THEN 0.90 WHEN 1 THEN 1.10 ELSE 1.00 END
                    AS DECIMAL(18,2)) AS adjusted_forecast,
               adjusted_forecast - original_forecast AS delta,
               {_EPOCH} + to_seconds(num % 100000 * 3660) AS submitted_at,
               {_list([*CONFIDENCE, 'Undecided'])}[CAST(num % 6 + 1 AS INT)] AS confidence,
               CASE WHEN num % 3 = 0 THEN '' ELSE 'Risk, "' || num || '"' END AS risks,
               CASE WHEN num % 4 <> 0 THEN 'Upside ' || num END AS upside, '' AS notes
        FROM (SELECT *, CAST(substr(rep_id, 5) AS BIGINT) AS num,
                     row_number() OVER (PARTITION BY rep_id ORDER BY expected_close_date NULLS LAST, deal_id) AS line
              FROM sheet)""",
    "submission": """
        SELECT rep_id, max(rep_name) AS rep_name, submitted_at, confidence, risks, upside, notes, sum(delta) AS net
        FROM adjustment GROUP BY ALL""",
    "net": "SELECT coalesce(sum(delta), 0) AS net_adjustment FROM adjustment",
    "month_total": """
        SELECT month_date, sum(total_invoiced) AS total_invoiced, sum(total_recognized) AS total_recognized,
               sum(total_confirmed_orders) AS total_confirmed_orders, sum(total_pipeline_value) AS total_pipeline_value,
               sum(total_weighted_pipeline) AS total_weighted_pipeline, sum(blended_forecast) AS blended_forecast
        FROM summary WHERE month_date IS NOT NULL GROUP BY ALL""",
    "forecast": """
        SELECT *, CAST(blended_forecast AS DOUBLE)
                    + CAST((SELECT net_adjustment FROM net) AS DOUBLE) / (SELECT count(*) FROM month_total)
                  AS rep_adjusted_forecast
        FROM month_total""",
    "forecast_total": """
        SELECT sum(total_invoiced) AS total_invoiced, sum(blended_forecast) AS system_forecast,
               sum(blended_forecast) + (SELECT net_adjustment FROM net) AS rep_adjusted_forecast,
               (SELECT net_adjustment FROM net) AS delta
        FROM month_total""",
    "category_revenue": """
        SELECT product_category, sum(total_invoiced) AS total_invoiced FROM category_month
        WHERE product_category IS NOT NULL GROUP BY ALL""",
    "override": """
        SELECT CAST(CAST(substr(rep_id, 5) AS BIGINT) % 61 - 30 AS INT) AS pct, rep_id, manager_name
        FROM silver_sales_reps""",
}

_NEEDS = {
    name: [other for other in RELATIONS if other != name and re.search(rf"\b{other}\b", sql)]
    for name, sql in RELATIONS.items()
}


def _statement(final: str) -> str:
    """The final SELECT with the relations it needs, each after those it builds on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in RELATIONS:
        if re.search(rf"\b{name}\b", final):
            add(name)
    return "WITH " + ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in ordered) + "\n" + final if ordered else final


def _rows(source: str, columns: str, rest: str = "") -> str:
    """SELECT the columns: ``name`` as is, ``name:m`` money as double, ``name:d`` date and ``name:t`` time as text."""
    shown = []
    for column in columns.split():
        name, _, kind = column.partition(":")
        value = {
            "": name,
            "m": f"CAST({name} AS DOUBLE) AS {name}",
            "d": f"CAST({name} AS VARCHAR) AS {name}",
            "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}",
            "r": f"round(CAST({name} AS DOUBLE), 2) AS {name}",
        }[kind]
        shown.append(value)
    return _statement(f"SELECT {', '.join(shown)} FROM {source} {rest}")


_REP_COLUMNS = "rep_id rep_name email region role manager_name"
_CUSTOMER_COLUMNS = "customer_id customer_name vertical tier region assigned_rep_id"
_INVOICE_HEAD = "invoice_id customer_id rep_id"
_INVOICE_TAIL = "product_category po_number payment_terms"
_SILVER_INVOICE = (
    f"{_INVOICE_HEAD} invoice_date:d invoice_amount:m status revenue_recognized_pct:m recognized_revenue:m "
    f"{_INVOICE_TAIL}"
)
_ORDER_COLUMNS = "order_id customer_id rep_id order_date:d ship_date:d ship_status product_category quantity is_confirmed"
_DEAL_COLUMNS = (
    "deal_id customer_id rep_id deal_name stage deal_amount:m forecasted_amount:m probability:m product_category "
    "created_date:d expected_close_date:d deal_type next_step"
)
_CONTEXT = "rep_name rep_region customer_name customer_vertical customer_tier"
_ACTIVE = f"{_DEAL_COLUMNS} {_CONTEXT}"
_DETAILS = f"{_SILVER_INVOICE} {_CONTEXT}"
_INVOICE_MONTH = "total_invoiced:m total_recognized:m invoice_count"
_ORDER_MONTH = "total_confirmed_orders:m confirmed_order_count shipped_revenue:m"
_DEAL_MONTH = "total_pipeline_value:m total_weighted_pipeline:m active_deal_count"
_SUMMARY = (
    f"rep_id rep_name region role annual_quota:m month_date:d {_INVOICE_MONTH} {_ORDER_MONTH} {_DEAL_MONTH} "
    "blended_forecast:m"
)
_MONTHLY = (
    "rep_id rep_name region month_date:d total_invoiced:m total_recognized:m total_confirmed_orders:m "
    "shipped_revenue:m total_pipeline_value:m total_weighted_pipeline:m blended_forecast:m annual_quota:m"
)
_CATEGORY = "month_date:d product_category total_invoiced:m total_recognized:m invoice_count avg_invoice_amount"
_FEEDBACK = (
    "rep_id rep_name submitted_at:t confidence risks upside notes deal_id original_forecast:m adjusted_forecast:m"
)
_ADJUSTMENT = "rep_id rep_name submitted_at:t deal_id original_forecast:m adjusted_forecast:m delta:m"
_KPIS = (
    "month_date:d total_invoiced:m total_recognized:m total_confirmed_orders:m total_pipeline_value:m "
    "total_weighted_pipeline:m"
)
_FORECAST = "month_date:d total_invoiced:m total_recognized:m total_weighted_pipeline:m blended_forecast:m"
_SHEET = f"""
    SELECT rep_id, rep_name, deal_id, substr(deal_name, 1, 50) AS deal_name, stage,
           CAST(expected_close_date AS VARCHAR) AS expected_close_date, CAST(deal_amount AS DOUBLE) AS deal_amount,
           {_compact('deal_amount')} AS deal_amount_label, CAST(forecasted_amount AS DOUBLE) AS original_forecast,
           CAST(forecasted_amount AS DOUBLE) AS adjusted_forecast
    FROM sheet"""
_OF_REP, _OF_REGION, _IN_REGION = f"WHERE rep_id = '{REP}'", f"WHERE region = '{REGION}'", f"WHERE rep_region = '{REGION}'"
_NEWEST = "ORDER BY CAST(invoice_date AS DATE) DESC NULLS FIRST, invoice_id LIMIT 500"
_REJECTED = " UNION ALL ".join(
    f"SELECT '{entity}' AS entity, f.fate, count(r.fate) AS n FROM (VALUES {', '.join(f'({x})' for x in (chr(39) + 'kept' + chr(39), *(chr(39) + name + chr(39) for name in reasons)))}) AS f (fate) "
    f"LEFT JOIN (SELECT CASE {' '.join(f'WHEN {test} THEN {chr(39)}{name}{chr(39)}' for name, test in reasons.items())} ELSE 'kept' END AS fate FROM raw_{entity}) r ON r.fate = f.fate GROUP BY f.fate"
    for entity, reasons in {
        "sales_reps": {"no id": "rep_id IS NULL", "no name": "rep_name IS NULL"},
        "customers": {"no id": "customer_id IS NULL", "no name": "customer_name IS NULL"},
        "invoices": {"no id": "invoice_id IS NULL", "no amount": "NOT coalesce(invoice_amount > 0, FALSE)", "no status": "status IS NULL", "cancelled": "status = 'Cancelled'"},
        "orders": {"no id": "order_id IS NULL", "no amount": "NOT coalesce(order_amount > 0, FALSE)"},
        "deals": {"no id": "deal_id IS NULL", "no amount": "NOT coalesce(deal_amount > 0, FALSE)", "no stage": "stage IS NULL", "lost": "stage = 'Closed Lost'"},
    }.items()
)
# Invoices of the second half of a month come with a second refresh, as do some reps and customers of those before.
_CHANGES = """
SELECT d.invoice_id, CASE WHEN NOT (k.change = 'update_before' AND late_rep) THEN d.rep_name END AS rep_name,
  CASE WHEN NOT (k.change = 'update_before' AND late_customer) THEN d.customer_name END AS customer_name, k.change
FROM (
  SELECT invoice_id, rep_name, customer_name, day(CAST(invoice_date AS DATE)) > 15 AS is_late,
    coalesce(rep_id LIKE '%7', FALSE) AND rep_name IS NOT NULL AS late_rep,
    coalesce(customer_id LIKE '%3', FALSE) AND customer_name IS NOT NULL AS late_customer
  FROM details
) d JOIN (VALUES ('insert'), ('update_before'), ('update_after')) AS k (change)
ON (k.change = 'insert') = d.is_late AND (d.is_late OR late_rep OR late_customer)
"""
_LAST_MONTH = "ORDER BY CAST(month_date AS DATE) DESC LIMIT 1"


def _shown_text(name: str) -> str:
    return f"nullif({name}, '') AS {name}"


def _profile(relations: dict[str, str]) -> str:
    return _statement(
        " UNION ALL ".join(f"SELECT '{entity}' AS entity, count(*) AS n FROM {r}" for entity, r in relations.items())
    )


_ENTITIES = ("sales_reps", "customers", "invoices", "orders", "deals")
_RAW_COUNTS = {e: f"raw_{e}" for e in _ENTITIES}
_PROFILED = {"sales_reps": "region", "customers": "tier", "invoices": "status", "orders": "ship_status", "deals": "stage"}


def _selected(columns: str) -> str:
    """The SELECT list of ``_rows`` alone."""
    return _rows("nothing_here", columns).split(" FROM nothing_here")[0]


def _stacked(tables: dict[str, tuple[str, str]]) -> str:
    """All rows and columns of some relations, by column name: table name to (relation, columns)."""
    parts = [f"{_selected(columns)}, '{name}' AS table_name FROM {source}" for name, (source, columns) in tables.items()]
    return _statement(" UNION ALL BY NAME ".join(parts))


def _under(where: str) -> str:
    """Monthly totals of the summary under the page's filter."""
    sums = ", ".join(
        f"sum({c}) AS {c}"
        for c in (
            "total_invoiced", "total_recognized", "total_confirmed_orders", "total_pipeline_value",
            "total_weighted_pipeline", "blended_forecast",
        )
    )
    return f"(SELECT month_date, {sums} FROM summary {where} AND month_date IS NOT NULL GROUP BY month_date) m"


def _forecast_under(where: str, feedback: str) -> str:
    """The forecast under the page's filter, with the feedback that passes its own."""
    net = f"CAST((SELECT coalesce(sum(delta), 0) FROM adjustment {feedback}) AS DOUBLE)"
    return (
        f"(SELECT *, {net} AS net_adjustment, CAST(blended_forecast AS DOUBLE) + {net} / (SELECT count(*) FROM {_under(where)}) "
        f"AS rep_adjusted_forecast FROM {_under(where)}) f"
    )


def statements() -> dict[str, str]:
    """Oracle SQL by query name."""
    gold_tables = _stacked({
        "gold_rep_monthly_summary": ("summary", _SUMMARY),
        "gold_active_deals": ("active", _ACTIVE),
        "gold_invoice_details": ("details", _DETAILS),
        "gold_category_summary": ("category_month", _CATEGORY),
    })
    silver_columns = {
        "sales_reps": f"{_REP_COLUMNS} hire_date:d annual_quota:m",
        "customers": f"{_CUSTOMER_COLUMNS} created_date:d",
        "invoices": _SILVER_INVOICE,
        "orders": f"{_ORDER_COLUMNS} order_amount:m",
        "deals": _DEAL_COLUMNS,
    }
    return {
        "silver_sales_reps": _rows("silver_sales_reps", f"{_REP_COLUMNS} hire_date:d annual_quota:m"),
        "silver_customers": _rows("silver_customers", f"{_CUSTOMER_COLUMNS} created_date:d"),
        "silver_invoices": _rows("silver_invoices", _SILVER_INVOICE),
        "silver_orders": _rows("silver_orders", f"{_ORDER_COLUMNS} order_amount:m"),
        "silver_deals": _rows("silver_deals", _DEAL_COLUMNS),
        "invoice_month_rollup": _rows("invoice_month", f"rep_id month_date:d {_INVOICE_MONTH}"),
        "order_month_rollup": _rows("order_month", f"rep_id month_date:d {_ORDER_MONTH}"),
        "deal_month_rollup": _rows("deal_month", f"rep_id month_date:d {_DEAL_MONTH}"),
        "gold_rep_monthly_summary": _rows("summary", _SUMMARY),
        "gold_active_deals": _rows("active", _ACTIVE),
        "gold_invoice_details": _rows("details", _DETAILS),
        "gold_category_summary": _rows("category_month", _CATEGORY),
        "list_sales_reps": _statement(
            "SELECT DISTINCT rep_id, rep_name, region, role, CAST(annual_quota AS DOUBLE) AS annual_quota FROM summary"
        ),
        "list_regions": _statement(
            "SELECT 'All' AS region UNION ALL SELECT DISTINCT region FROM summary WHERE region IS NOT NULL"
        ),
        "rep_name_lookup": _statement(
            "SELECT rep_name, max(rep_id) AS rep_id FROM summary WHERE rep_name IS NOT NULL GROUP BY rep_name"
        ),
        "monthly_summary_all": _rows("summary", _MONTHLY),
        "monthly_summary_rep": _rows("summary", _MONTHLY, _OF_REP),
        "monthly_summary_region": _rows("summary", _MONTHLY, _OF_REGION),
        "active_deals_all": _rows("active", _ACTIVE),
        "active_deals_rep": _rows("active", _ACTIVE, _OF_REP),
        "active_deals_region": _rows("active", _ACTIVE, _IN_REGION),
        "invoice_details_all": _rows("details", _DETAILS, _NEWEST),
        "invoice_details_rep": _rows("details", _DETAILS, f"{_OF_REP} {_NEWEST}"),
        "invoice_details_region": _rows("details", _DETAILS, f"{_IN_REGION} {_NEWEST}"),
        "category_summary_all": _rows("category_month", _CATEGORY),
        "category_summary_region": _rows("region_categories", _CATEGORY),
        "category_summary_within_region": _rows("region_category_month", _CATEGORY),
        "feedback_all": _rows("adjustment", _FEEDBACK),
        "feedback_rep": _rows("adjustment", _FEEDBACK, _OF_REP),
        "current_month_kpis": _rows("month_total", _KPIS, _LAST_MONTH),
        "current_month_kpis_as_of": _rows("month_total", _KPIS, f"WHERE month_date <= '1999-06-30' {_LAST_MONTH}"),
        "monthly_trend": _rows(
            "month_total", "month_date:d total_invoiced:m total_recognized:m total_confirmed_orders:m"
        ),
        "current_month_kpis_rep": _rows(_under(_OF_REP), _KPIS, _LAST_MONTH),
        "current_month_kpis_region": _rows(_under(_OF_REGION), _KPIS, _LAST_MONTH),
        "current_month_kpi_labels": _statement(
            "SELECT CAST(month_date AS VARCHAR) AS month_date, "
            + ", ".join(f"{_compact(c.split(':')[0])} AS {c.split(':')[0]}" for c in _KPIS.split()[1:])
            + f" FROM month_total {_LAST_MONTH}"
        ),
        **{
            f"monthly_trend_{which}": _rows(
                _under(where), "month_date:d total_invoiced:m total_recognized:m total_confirmed_orders:m"
            )
            for which, where in (("rep", _OF_REP), ("region", _OF_REGION))
        },
        **{
            f"deals_by_stage_{which}": _statement(
                'SELECT stage, CAST(sum(deal_amount) AS DOUBLE) AS total, count(deal_id) AS "count" '
                f"FROM active {where} GROUP BY stage"
            )
            for which, where in (("rep", _OF_REP), ("region", _IN_REGION))
        },
        "deals_by_stage": _statement(
            'SELECT stage, CAST(sum(deal_amount) AS DOUBLE) AS total, count(deal_id) AS "count" FROM active GROUP BY stage'
        ),
        "revenue_by_category": _rows("category_revenue", "product_category total_invoiced:m"),
        "category_share": _statement(
            "SELECT product_category, CAST(total_invoiced AS DOUBLE) AS total_invoiced, "
            "round(CAST(total_invoiced AS DOUBLE) / (SELECT CAST(sum(total_invoiced) AS DOUBLE) FROM category_revenue), 9) "
            "AS share FROM category_revenue"
        ),
        "adjustment_sheet": _statement(_SHEET),
        "adjustment_sheet_rep": _statement(f"{_SHEET} {_OF_REP}"),
        "feedback_submission": _statement(
            """SELECT rep_id, rep_name, 'High' AS confidence, '' AS risks, '' AS upside, '' AS notes, deal_id,
               CAST(forecasted_amount AS DOUBLE) AS original_forecast,
               CAST(CASE WHEN stage = 'Negotiation' THEN forecasted_amount + 1000 ELSE forecasted_amount END AS DOUBLE)
                 AS adjusted_forecast
               FROM sheet"""
        ),
        "explode_adjustments": _rows("adjustment", _ADJUSTMENT),
        "net_adjustment_total": _rows("net", "net_adjustment:m"),
        "monthly_forecast": _rows("month_total", _FORECAST),
        "rep_adjusted_forecast": _rows("forecast", f"{_FORECAST} rep_adjusted_forecast:r"),
        "rep_adjusted_forecast_override": _statement(
            "SELECT CAST(month_date AS VARCHAR) AS month_date, "
            + ", ".join(
                f"CAST({c} AS DOUBLE) AS {c}"
                for c in ("total_invoiced", "total_recognized", "total_weighted_pipeline", "blended_forecast")
            )
            + ", round(rep_adjusted_forecast * 1.05, 2) AS rep_adjusted_forecast FROM forecast"
        ),
        "rep_adjusted_forecast_rep": _rows(_forecast_under(_OF_REP, _OF_REP), f"{_FORECAST} rep_adjusted_forecast:r"),
        "rep_adjusted_forecast_region": _rows(_forecast_under(_OF_REGION, ""), f"{_FORECAST} rep_adjusted_forecast:r"),
        "forecast_totals_region": _statement(
            "SELECT CAST(sum(total_invoiced) AS DOUBLE) AS total_invoiced, CAST(sum(blended_forecast) AS DOUBLE) AS system_forecast, "
            "round(CAST(sum(blended_forecast) AS DOUBLE) + max(net_adjustment), 2) AS rep_adjusted_forecast, "
            f"round(max(net_adjustment), 2) AS delta FROM {_forecast_under(_OF_REGION, '')}"
        ),
        "forecast_totals": _rows(
            "forecast_total", "total_invoiced:m system_forecast:m rep_adjusted_forecast:r delta:r"
        ),
        "forecast_total_labels": _statement(
            "SELECT "
            + ", ".join(
                f"{_compact(c)} AS {c}" for c in ("total_invoiced", "system_forecast", "rep_adjusted_forecast", "delta")
            )
            + " FROM forecast_total"
        ),
        "forecast_display_table": _statement(
            f"""SELECT strftime(month_date, '%b %Y') AS "Month", {_dollars('total_invoiced')} AS "Invoiced",
                {_dollars('total_recognized')} AS "Recognized", {_dollars('total_weighted_pipeline')} AS "Weighted Pipeline",
                {_dollars('blended_forecast')} AS "System Forecast", {_dollars('rep_adjusted_forecast')} AS "Rep Forecast"
                FROM forecast"""
        ),
        "feedback_review": _statement(
            f"""SELECT rep_id, rep_name, strftime(submitted_at, '%Y-%m-%d') AS submitted_on,
                strftime(submitted_at, '%Y-%m-%dT%H:%M') AS submitted_stamp,
                coalesce({_list(ICONS)}[list_position({_list(CONFIDENCE)}, confidence)], '⚪') AS confidence_icon,
                confidence, CAST(net AS DOUBLE) AS net_adjustment,
                CASE WHEN net >= 0 THEN '↑' ELSE '↓' END AS direction,
                {_compact('abs(net)')} AS net_adjustment_label,
                {_shown_text('risks')}, {_shown_text('upside')}, {_shown_text('notes')}
                FROM submission"""
        ),
        "nonzero_adjustments": _rows("adjustment", _ADJUSTMENT, "WHERE original_forecast <> adjusted_forecast"),
        "report_monthly": _rows("summary", _MONTHLY),
        "report_deals": _rows("active", _ACTIVE, _IN_REGION),
        "report_invoices": _rows("details", _DETAILS),
        "report_invoices_rep": _rows("details", _DETAILS, _OF_REP),
        "report_invoices_rows": _rows("details", _DETAILS, f"{_OF_REP} {_NEWEST}"),
        "report_forecast": _rows("summary", _MONTHLY, _OF_REGION),
        "report_monthly_span": _rows("summary", _MONTHLY, "WHERE month_date BETWEEN '1998-01-01' AND '1998-12-31'"),
        "report_row_count": _statement("SELECT count(*) AS n FROM active"),
        "profile_counts": _profile(_RAW_COUNTS),
        "profile_values": _statement(
            " UNION ALL ".join(
                f"SELECT '{e}' AS entity, '{c}' AS field, {c} AS value, count(*) AS n FROM raw_{e} "
                f"WHERE {c} IS NOT NULL GROUP BY {c}"
                for e, c in _PROFILED.items()
            )
        ),
        "raw_total_invoiced": _statement("SELECT round(sum(invoice_amount), 2) AS total_invoiced FROM raw_invoices"),
        "raw_total_recognized": _statement(
            "SELECT round(sum(invoice_amount * revenue_recognized_pct), 2) AS total_recognized FROM raw_invoices"
        ),
        "raw_total_open_deals": _statement(
            "SELECT round(sum(deal_amount), 2) AS total_pipeline FROM raw_deals "
            "WHERE stage IS NULL OR stage NOT IN ('Closed Won', 'Closed Lost')"
        ),
        **{f"ingest_{e}": _statement(f"SELECT *, TRUE AS audited FROM raw_{e}") for e in _ENTITIES},
        "land_parquet": _statement(
            " UNION ALL BY NAME ".join(f"SELECT *, '{e}' AS table_name FROM raw_{e}" for e in _ENTITIES)
        ),
        "write_clustered": _rows("silver_invoices", _SILVER_INVOICE),
        "refresh_silver": _stacked({e: (f"silver_{e}", silver_columns[e]) for e in _ENTITIES}),
        "refresh_gold": gold_tables,
        "refresh_all": _rows("summary", _SUMMARY),
        "snapshot_sync": gold_tables,
        "append_feedback": _rows("adjustment", _FEEDBACK),
        "append_override": _statement(
            f"""SELECT pct AS manager_override_pct, format('{{:+d}}%', pct) AS override_label,
                'Review of ' || rep_id AS manager_notes,
                strftime({_EPOCH} + to_seconds(CAST(substr(rep_id, 5) AS BIGINT) % 100000 * 60), '%Y-%m-%d %H:%M:%S') AS approved_at,
                manager_name AS approved_by FROM override"""
        ),
        "export_csv": _rows("summary", _MONTHLY),
        "append_feedback_once": _rows("adjustment", _FEEDBACK),
        "refresh_in_deltas": gold_tables,
        "gold_change_feed": _statement(_CHANGES),
        "rejected_rows": _statement(_REJECTED),
        "compacted_batches": _statement("SELECT * FROM raw_invoices"),
        "write_interleaved": _rows("summary", _SUMMARY),
        "published_invoice_details_all": _rows("details", _DETAILS, _NEWEST),
        "published_invoice_details_rep": _rows("details", _DETAILS, f"{_OF_REP} {_NEWEST}"),
        "published_invoice_details_region": _rows("details", _DETAILS, f"{_IN_REGION} {_NEWEST}"),
        "published_month_kpis": _rows("month_total", _KPIS, _LAST_MONTH),
        "published_month_kpis_as_of": _rows("month_total", _KPIS, f"WHERE month_date <= '1999-06-30' {_LAST_MONTH}"),
    }
