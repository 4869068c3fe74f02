"""Declared data model: column types, enum domains and integrity rules.

Everything here is data, not code: the loaders cast to these types and the
audit engine (operators/audit.py) turns the rule lists into Spark jobs.
Money is DECIMAL(20,4), quantities DECIMAL(20,6), FX rates DECIMAL(20,8) --
never floating point. Surrogate keys that come from large fact tables are
BIGINT so that they do not overflow at cluster scale.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MONEY = "DECIMAL(20,4)"
QTY = "DECIMAL(20,6)"
RATE = "DECIMAL(20,8)"
PCT = "DECIMAL(6,4)"

# --- fixed values: enum domains of the data model (must match exactly) -------
ENUMS = {
    "account_category": ["asset", "liability", "equity", "revenue", "expense"],
    "normal_balance": ["debit", "credit"],
    "entry_status": ["draft", "posted", "voided"],
    "contact_type": ["customer", "vendor", "both", "employee", "other"],
    "invoice_type": ["sale", "purchase", "credit_note_sale", "credit_note_purchase"],
    "invoice_status": ["draft", "sent", "partial", "paid", "voided", "overdue"],
    "payment_method": ["cash", "bank_transfer", "check", "credit_card", "other"],
    "payment_direction": ["inbound", "outbound"],
    "stock_move_type": ["purchase_receipt", "sale_delivery", "transfer", "adjustment", "return",
                        "opening", "scrap", "production_in", "production_out"],
    "valuation_method": ["fifo", "average_cost", "standard_cost"],
    "po_status": ["draft", "confirmed", "received", "invoiced", "cancelled"],
    "so_status": ["draft", "confirmed", "shipped", "invoiced", "cancelled"],
    "period_status": ["open", "closed", "locked"],
    "tax_type": ["sales", "purchase", "both"],
}

# --- fixed values: aging bucket labels (en dash, not hyphen) and the largest
# number of days overdue each bucket takes; a missing due date is "over 90 days"
AGING_BUCKETS = ["current", "1–30 days", "31–60 days", "61–90 days", "over 90 days"]
AGING_UPPER_DAYS = [0, 30, 60, 90]

# --- fixed values: the declared columns of the 33 tables (types as Spark has
# them; VARCHAR(n) / CHAR(n) are strings with a length limit) ------------------
TABLE_DDL = {
    "currencies": "id INT NOT NULL, code CHAR(3) NOT NULL, name VARCHAR(100) NOT NULL, symbol VARCHAR(10), "
                  "decimal_places SMALLINT NOT NULL, is_base BOOLEAN NOT NULL, is_active BOOLEAN NOT NULL, "
                  "created_at TIMESTAMP NOT NULL",
    "exchange_rates": f"id INT NOT NULL, from_currency CHAR(3) NOT NULL, to_currency CHAR(3) NOT NULL, "
                      f"rate {RATE} NOT NULL, effective_date DATE NOT NULL, created_at TIMESTAMP NOT NULL",
    "companies": "id INT NOT NULL, name VARCHAR(200) NOT NULL, tax_id VARCHAR(50), base_currency CHAR(3) NOT NULL, "
                 "address_line1 VARCHAR(200), address_line2 VARCHAR(200), city VARCHAR(100), state VARCHAR(100), "
                 "postal_code VARCHAR(20), country CHAR(2), phone VARCHAR(50), email VARCHAR(200), "
                 "website VARCHAR(200), logo_url VARCHAR(500), created_at TIMESTAMP NOT NULL, "
                 "updated_at TIMESTAMP NOT NULL",
    "fiscal_years": "id INT NOT NULL, company_id INT NOT NULL, name VARCHAR(100) NOT NULL, start_date DATE NOT NULL, "
                    "end_date DATE NOT NULL, is_current BOOLEAN NOT NULL, is_closed BOOLEAN NOT NULL, "
                    "created_at TIMESTAMP NOT NULL",
    # company_id is an addition here: the company of the period's fiscal year
    "accounting_periods": "id INT NOT NULL, fiscal_year_id INT NOT NULL, company_id INT, name VARCHAR(100) NOT NULL, "
                          "start_date DATE NOT NULL, end_date DATE NOT NULL, period_number SMALLINT NOT NULL, "
                          "status STRING NOT NULL, created_at TIMESTAMP NOT NULL",
    "account_groups": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, "
                      "name VARCHAR(200) NOT NULL, category STRING NOT NULL, parent_id INT, level SMALLINT NOT NULL, "
                      "sort_order INT NOT NULL, created_at TIMESTAMP NOT NULL",
    "accounts": f"id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, name VARCHAR(200) NOT NULL, "
                f"description STRING, category STRING NOT NULL, normal_balance STRING NOT NULL, group_id INT, "
                f"currency CHAR(3), is_active BOOLEAN NOT NULL, is_reconcilable BOOLEAN NOT NULL, "
                f"is_control BOOLEAN NOT NULL, opening_balance {MONEY} NOT NULL, created_at TIMESTAMP NOT NULL, "
                f"updated_at TIMESTAMP NOT NULL",
    "tax_codes": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, name VARCHAR(100) NOT NULL, "
                 "rate DECIMAL(8,4) NOT NULL, tax_type STRING NOT NULL, account_id INT NOT NULL, "
                 "is_active BOOLEAN NOT NULL",
    "journals": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, name VARCHAR(100) NOT NULL, "
                "type VARCHAR(20) NOT NULL, default_account INT, sequence_prefix VARCHAR(10), "
                "is_active BOOLEAN NOT NULL",
    "journal_entries": f"id BIGINT NOT NULL, company_id INT NOT NULL, journal_id INT NOT NULL, period_id INT NOT NULL, "
                       f"entry_number VARCHAR(50) NOT NULL, entry_date DATE NOT NULL, reference VARCHAR(200), "
                       f"description STRING, currency CHAR(3) NOT NULL, exchange_rate {RATE} NOT NULL, "
                       f"status STRING NOT NULL, is_reversal BOOLEAN NOT NULL, reversed_by BIGINT, "
                       f"source_type VARCHAR(50), source_id BIGINT, posted_at TIMESTAMP, posted_by INT, "
                       f"created_by INT, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "journal_entry_lines": f"id BIGINT NOT NULL, journal_entry_id BIGINT NOT NULL, line_number SMALLINT NOT NULL, "
                           f"account_id INT NOT NULL, description STRING, debit_amount {MONEY} NOT NULL, "
                           f"credit_amount {MONEY} NOT NULL, debit_base {MONEY} NOT NULL, "
                           f"credit_base {MONEY} NOT NULL, tax_code_id INT, tax_amount {MONEY}, "
                           f"is_reconciled BOOLEAN NOT NULL, reconciled_at TIMESTAMP, reconciliation_id INT, "
                           f"contact_id BIGINT, cost_center_id INT, project_id INT, created_at TIMESTAMP NOT NULL",
    "cost_centers": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, "
                    "name VARCHAR(100) NOT NULL, parent_id INT, is_active BOOLEAN NOT NULL",
    "projects": f"id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, name VARCHAR(200) NOT NULL, "
                f"start_date DATE, end_date DATE, budget {MONEY}, is_active BOOLEAN NOT NULL",
    "contacts": f"id BIGINT NOT NULL, company_id INT NOT NULL, reference VARCHAR(50), name VARCHAR(200) NOT NULL, "
                f"type STRING NOT NULL, tax_id VARCHAR(50), email VARCHAR(200), phone VARCHAR(50), "
                f"website VARCHAR(200), address_line1 VARCHAR(200), address_line2 VARCHAR(200), city VARCHAR(100), "
                f"state VARCHAR(100), postal_code VARCHAR(20), country CHAR(2), currency CHAR(3), "
                f"payment_terms SMALLINT, credit_limit {MONEY}, ar_account_id INT, ap_account_id INT, "
                f"tax_code_id INT, is_active BOOLEAN NOT NULL, notes STRING, created_at TIMESTAMP NOT NULL, "
                f"updated_at TIMESTAMP NOT NULL",
    "invoices": f"id BIGINT NOT NULL, company_id INT NOT NULL, invoice_number VARCHAR(50) NOT NULL, "
                f"type STRING NOT NULL, status STRING NOT NULL, contact_id BIGINT NOT NULL, "
                f"invoice_date DATE NOT NULL, due_date DATE, reference VARCHAR(200), currency CHAR(3) NOT NULL, "
                f"exchange_rate {RATE} NOT NULL, subtotal {MONEY} NOT NULL, tax_amount {MONEY} NOT NULL, "
                f"total_amount {MONEY} NOT NULL, amount_paid {MONEY} NOT NULL, amount_due {MONEY}, notes STRING, "
                f"journal_entry_id BIGINT, created_by INT, created_at TIMESTAMP NOT NULL, "
                f"updated_at TIMESTAMP NOT NULL",
    "invoice_lines": f"id BIGINT NOT NULL, invoice_id BIGINT NOT NULL, line_number SMALLINT NOT NULL, "
                     f"description STRING NOT NULL, account_id INT NOT NULL, quantity {QTY} NOT NULL, "
                     f"unit_price {MONEY} NOT NULL, discount_pct {PCT} NOT NULL, line_amount {MONEY} NOT NULL, "
                     f"tax_code_id INT, tax_amount {MONEY} NOT NULL, product_id BIGINT, cost_center_id INT, "
                     f"project_id INT",
    "payments": f"id BIGINT NOT NULL, company_id INT NOT NULL, payment_number VARCHAR(50) NOT NULL, "
                f"direction STRING NOT NULL, contact_id BIGINT, payment_date DATE NOT NULL, method STRING NOT NULL, "
                f"currency CHAR(3) NOT NULL, exchange_rate {RATE} NOT NULL, amount {MONEY} NOT NULL, "
                f"bank_account_id INT, reference VARCHAR(200), notes STRING, journal_entry_id BIGINT, "
                f"created_at TIMESTAMP NOT NULL",
    "payment_allocations": f"id BIGINT NOT NULL, payment_id BIGINT NOT NULL, invoice_id BIGINT NOT NULL, "
                           f"allocated_amount {MONEY} NOT NULL, created_at TIMESTAMP NOT NULL",
    "bank_accounts": f"id INT NOT NULL, company_id INT NOT NULL, gl_account_id INT NOT NULL, "
                     f"name VARCHAR(200) NOT NULL, bank_name VARCHAR(200), account_number VARCHAR(100), "
                     f"routing_number VARCHAR(50), swift_code VARCHAR(20), iban VARCHAR(50), "
                     f"currency CHAR(3) NOT NULL, opening_balance {MONEY} NOT NULL, current_balance {MONEY} NOT NULL, "
                     f"is_active BOOLEAN NOT NULL, created_at TIMESTAMP NOT NULL",
    "bank_transactions": f"id BIGINT NOT NULL, bank_account_id INT NOT NULL, transaction_date DATE NOT NULL, "
                         f"description STRING, reference VARCHAR(200), amount {MONEY} NOT NULL, "
                         f"running_balance {MONEY}, is_reconciled BOOLEAN NOT NULL, reconciliation_id INT, "
                         f"payment_id BIGINT, journal_entry_id BIGINT, created_at TIMESTAMP NOT NULL",
    "bank_reconciliations": f"id INT NOT NULL, bank_account_id INT NOT NULL, period_end_date DATE NOT NULL, "
                            f"statement_balance {MONEY} NOT NULL, book_balance {MONEY} NOT NULL, difference {MONEY}, "
                            f"is_completed BOOLEAN NOT NULL, completed_at TIMESTAMP, created_at TIMESTAMP NOT NULL",
    "units_of_measure": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, "
                        "name VARCHAR(100) NOT NULL, category VARCHAR(50)",
    "product_categories": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, "
                          "name VARCHAR(200) NOT NULL, parent_id INT, inventory_account_id INT, cogs_account_id INT, "
                          "revenue_account_id INT, purchase_price_variance_id INT",
    "products": f"id BIGINT NOT NULL, company_id INT NOT NULL, sku VARCHAR(100) NOT NULL, name VARCHAR(200) NOT NULL, "
                f"description STRING, category_id INT, uom_id INT NOT NULL, purchase_uom_id INT, "
                f"uom_conversion {QTY} NOT NULL, valuation_method STRING NOT NULL, standard_cost {MONEY} NOT NULL, "
                f"last_purchase_price {MONEY} NOT NULL, average_cost {MONEY} NOT NULL, sale_price {MONEY} NOT NULL, "
                f"reorder_point {MONEY} NOT NULL, reorder_qty {MONEY} NOT NULL, min_stock {MONEY} NOT NULL, "
                f"max_stock {MONEY}, is_tracked BOOLEAN NOT NULL, is_purchasable BOOLEAN NOT NULL, "
                f"is_sellable BOOLEAN NOT NULL, is_active BOOLEAN NOT NULL, inventory_account_id INT, "
                f"cogs_account_id INT, revenue_account_id INT, tax_code_purchase_id INT, tax_code_sale_id INT, "
                f"weight DECIMAL(10,4), weight_uom VARCHAR(10), barcode VARCHAR(100), created_at TIMESTAMP NOT NULL, "
                f"updated_at TIMESTAMP NOT NULL",
    "warehouses": "id INT NOT NULL, company_id INT NOT NULL, code VARCHAR(20) NOT NULL, name VARCHAR(200) NOT NULL, "
                  "address_line1 VARCHAR(200), city VARCHAR(100), country CHAR(2), is_active BOOLEAN NOT NULL",
    "warehouse_locations": "id INT NOT NULL, warehouse_id INT NOT NULL, code VARCHAR(50) NOT NULL, "
                           "name VARCHAR(200) NOT NULL, parent_id INT, location_type VARCHAR(20) NOT NULL, "
                           "is_active BOOLEAN NOT NULL",
    "stock_quantities": f"id BIGINT NOT NULL, product_id BIGINT NOT NULL, location_id INT NOT NULL, "
                        f"quantity {QTY} NOT NULL, reserved_qty {QTY} NOT NULL, available_qty {QTY}, "
                        f"updated_at TIMESTAMP NOT NULL",
    "stock_moves": f"id BIGINT NOT NULL, company_id INT NOT NULL, move_number VARCHAR(50) NOT NULL, "
                   f"move_type STRING NOT NULL, move_date DATE NOT NULL, product_id BIGINT NOT NULL, "
                   f"uom_id INT NOT NULL, from_location_id INT, to_location_id INT, quantity {QTY} NOT NULL, "
                   f"unit_cost {MONEY} NOT NULL, total_cost {MONEY}, reference VARCHAR(200), description STRING, "
                   f"purchase_order_id BIGINT, purchase_order_line_id BIGINT, sales_order_id BIGINT, "
                   f"sales_order_line_id BIGINT, invoice_id BIGINT, journal_entry_id BIGINT, "
                   f"is_posted BOOLEAN NOT NULL, posted_at TIMESTAMP, created_by INT, created_at TIMESTAMP NOT NULL",
    "inventory_cost_layers": f"id BIGINT NOT NULL, product_id BIGINT NOT NULL, location_id INT NOT NULL, "
                             f"stock_move_id BIGINT NOT NULL, received_date DATE NOT NULL, "
                             f"original_qty {QTY} NOT NULL, remaining_qty {QTY} NOT NULL, unit_cost {MONEY} NOT NULL, "
                             f"total_cost {MONEY}, created_at TIMESTAMP NOT NULL",
    "purchase_orders": f"id BIGINT NOT NULL, company_id INT NOT NULL, po_number VARCHAR(50) NOT NULL, "
                       f"status STRING NOT NULL, vendor_id BIGINT NOT NULL, order_date DATE NOT NULL, "
                       f"expected_date DATE, currency CHAR(3) NOT NULL, exchange_rate {RATE} NOT NULL, "
                       f"warehouse_id INT, subtotal {MONEY} NOT NULL, tax_amount {MONEY} NOT NULL, "
                       f"total_amount {MONEY} NOT NULL, amount_billed {MONEY} NOT NULL, "
                       f"amount_received_pct DECIMAL(6,2), notes STRING, reference VARCHAR(200), created_by INT, "
                       f"created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "purchase_order_lines": f"id BIGINT NOT NULL, po_id BIGINT NOT NULL, line_number SMALLINT NOT NULL, "
                            f"product_id BIGINT, description STRING NOT NULL, quantity {QTY} NOT NULL, "
                            f"qty_received {QTY} NOT NULL, qty_billed {QTY} NOT NULL, uom_id INT, "
                            f"unit_price {MONEY} NOT NULL, discount_pct {PCT} NOT NULL, line_amount {MONEY} NOT NULL, "
                            f"tax_code_id INT, tax_amount {MONEY} NOT NULL, account_id INT",
    "sales_orders": f"id BIGINT NOT NULL, company_id INT NOT NULL, so_number VARCHAR(50) NOT NULL, "
                    f"status STRING NOT NULL, customer_id BIGINT NOT NULL, order_date DATE NOT NULL, "
                    f"expected_date DATE, currency CHAR(3) NOT NULL, exchange_rate {RATE} NOT NULL, warehouse_id INT, "
                    f"subtotal {MONEY} NOT NULL, tax_amount {MONEY} NOT NULL, total_amount {MONEY} NOT NULL, "
                    f"amount_invoiced {MONEY} NOT NULL, notes STRING, reference VARCHAR(200), created_by INT, "
                    f"created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL",
    "sales_order_lines": f"id BIGINT NOT NULL, so_id BIGINT NOT NULL, line_number SMALLINT NOT NULL, "
                         f"product_id BIGINT, description STRING NOT NULL, quantity {QTY} NOT NULL, "
                         f"qty_delivered {QTY} NOT NULL, qty_invoiced {QTY} NOT NULL, uom_id INT, "
                         f"unit_price {MONEY} NOT NULL, discount_pct {PCT} NOT NULL, line_amount {MONEY} NOT NULL, "
                         f"tax_code_id INT, tax_amount {MONEY} NOT NULL, account_id INT",
}


class Column(NamedTuple):
    """One declared column: Spark type, character limit or None, and whether it must not be NULL."""
    name: str
    type: str
    length: int | None
    required: bool


def columns(table: str) -> list[Column]:
    """The declared columns of a table, in order."""
    out = []
    for part in TABLE_DDL[table].split(", "):
        name, declared = part.removesuffix(" NOT NULL").split(" ", 1)
        limit = re.fullmatch(r"(?:VAR)?CHAR\((\d+)\)", declared)
        out.append(Column(name, "STRING" if limit else declared, int(limit[1]) if limit else None,
                          part.endswith(" NOT NULL")))
    return out


COLUMNS = {t: columns(t) for t in TABLE_DDL}

# --- integrity rules (declared keys and checks of the data model) -------------
PRIMARY_KEYS = {t: ["id"] for t in TABLE_DDL}

UNIQUE_KEYS = {
    "currencies": [["code"]],
    "exchange_rates": [["from_currency", "to_currency", "effective_date"]],
    "fiscal_years": [["company_id", "name"]],
    "accounting_periods": [["fiscal_year_id", "period_number"]],
    "account_groups": [["company_id", "code"]],
    "accounts": [["company_id", "code"]],
    "tax_codes": [["company_id", "code"]],
    "journals": [["company_id", "code"]],
    "journal_entries": [["company_id", "entry_number"]],
    "journal_entry_lines": [["journal_entry_id", "line_number"]],
    "cost_centers": [["company_id", "code"]],
    "projects": [["company_id", "code"]],
    "invoices": [["company_id", "invoice_number"]],
    "invoice_lines": [["invoice_id", "line_number"]],
    "payments": [["company_id", "payment_number"]],
    "payment_allocations": [["payment_id", "invoice_id"]],
    "units_of_measure": [["company_id", "code"]],
    "product_categories": [["company_id", "code"]],
    "products": [["company_id", "sku"]],
    "warehouses": [["company_id", "code"]],
    "warehouse_locations": [["warehouse_id", "code"]],
    "stock_quantities": [["product_id", "location_id"]],
    "stock_moves": [["company_id", "move_number"]],
    "purchase_orders": [["company_id", "po_number"]],
    "purchase_order_lines": [["po_id", "line_number"]],
    "sales_orders": [["company_id", "so_number"]],
    "sales_order_lines": [["so_id", "line_number"]],
}

# (table, column, referenced table, referenced column)
FOREIGN_KEYS = [
    ("exchange_rates", "from_currency", "currencies", "code"),
    ("exchange_rates", "to_currency", "currencies", "code"),
    ("companies", "base_currency", "currencies", "code"),
    ("fiscal_years", "company_id", "companies", "id"),
    ("accounting_periods", "fiscal_year_id", "fiscal_years", "id"),
    ("account_groups", "company_id", "companies", "id"),
    ("account_groups", "parent_id", "account_groups", "id"),
    ("accounts", "company_id", "companies", "id"),
    ("accounts", "group_id", "account_groups", "id"),
    ("accounts", "currency", "currencies", "code"),
    ("tax_codes", "company_id", "companies", "id"),
    ("tax_codes", "account_id", "accounts", "id"),
    ("journals", "company_id", "companies", "id"),
    ("journals", "default_account", "accounts", "id"),
    ("journal_entries", "company_id", "companies", "id"),
    ("journal_entries", "journal_id", "journals", "id"),
    ("journal_entries", "period_id", "accounting_periods", "id"),
    ("journal_entries", "currency", "currencies", "code"),
    ("journal_entries", "reversed_by", "journal_entries", "id"),
    ("journal_entry_lines", "journal_entry_id", "journal_entries", "id"),
    ("journal_entry_lines", "account_id", "accounts", "id"),
    ("journal_entry_lines", "tax_code_id", "tax_codes", "id"),
    ("journal_entry_lines", "cost_center_id", "cost_centers", "id"),
    ("journal_entry_lines", "project_id", "projects", "id"),
    ("journal_entry_lines", "contact_id", "contacts", "id"),
    ("cost_centers", "company_id", "companies", "id"),
    ("cost_centers", "parent_id", "cost_centers", "id"),
    ("projects", "company_id", "companies", "id"),
    ("contacts", "company_id", "companies", "id"),
    ("contacts", "currency", "currencies", "code"),
    ("contacts", "ar_account_id", "accounts", "id"),
    ("contacts", "ap_account_id", "accounts", "id"),
    ("contacts", "tax_code_id", "tax_codes", "id"),
    ("invoices", "company_id", "companies", "id"),
    ("invoices", "contact_id", "contacts", "id"),
    ("invoices", "currency", "currencies", "code"),
    ("invoices", "journal_entry_id", "journal_entries", "id"),
    ("invoice_lines", "invoice_id", "invoices", "id"),
    ("invoice_lines", "account_id", "accounts", "id"),
    ("invoice_lines", "tax_code_id", "tax_codes", "id"),
    ("invoice_lines", "cost_center_id", "cost_centers", "id"),
    ("invoice_lines", "project_id", "projects", "id"),
    ("invoice_lines", "product_id", "products", "id"),
    ("payments", "company_id", "companies", "id"),
    ("payments", "contact_id", "contacts", "id"),
    ("payments", "currency", "currencies", "code"),
    ("payments", "journal_entry_id", "journal_entries", "id"),
    ("payments", "bank_account_id", "bank_accounts", "id"),
    ("payment_allocations", "payment_id", "payments", "id"),
    ("payment_allocations", "invoice_id", "invoices", "id"),
    ("bank_accounts", "company_id", "companies", "id"),
    ("bank_accounts", "gl_account_id", "accounts", "id"),
    ("bank_accounts", "currency", "currencies", "code"),
    ("bank_transactions", "bank_account_id", "bank_accounts", "id"),
    ("bank_transactions", "reconciliation_id", "bank_reconciliations", "id"),
    ("bank_transactions", "payment_id", "payments", "id"),
    ("bank_transactions", "journal_entry_id", "journal_entries", "id"),
    ("bank_reconciliations", "bank_account_id", "bank_accounts", "id"),
    ("units_of_measure", "company_id", "companies", "id"),
    ("product_categories", "company_id", "companies", "id"),
    ("product_categories", "parent_id", "product_categories", "id"),
    ("product_categories", "inventory_account_id", "accounts", "id"),
    ("product_categories", "cogs_account_id", "accounts", "id"),
    ("product_categories", "revenue_account_id", "accounts", "id"),
    ("product_categories", "purchase_price_variance_id", "accounts", "id"),
    ("products", "company_id", "companies", "id"),
    ("products", "category_id", "product_categories", "id"),
    ("products", "uom_id", "units_of_measure", "id"),
    ("products", "purchase_uom_id", "units_of_measure", "id"),
    ("products", "inventory_account_id", "accounts", "id"),
    ("products", "cogs_account_id", "accounts", "id"),
    ("products", "revenue_account_id", "accounts", "id"),
    ("products", "tax_code_purchase_id", "tax_codes", "id"),
    ("products", "tax_code_sale_id", "tax_codes", "id"),
    ("warehouses", "company_id", "companies", "id"),
    ("warehouse_locations", "warehouse_id", "warehouses", "id"),
    ("warehouse_locations", "parent_id", "warehouse_locations", "id"),
    ("stock_quantities", "product_id", "products", "id"),
    ("stock_quantities", "location_id", "warehouse_locations", "id"),
    ("stock_moves", "company_id", "companies", "id"),
    ("stock_moves", "product_id", "products", "id"),
    ("stock_moves", "uom_id", "units_of_measure", "id"),
    ("stock_moves", "from_location_id", "warehouse_locations", "id"),
    ("stock_moves", "to_location_id", "warehouse_locations", "id"),
    ("stock_moves", "invoice_id", "invoices", "id"),
    ("stock_moves", "journal_entry_id", "journal_entries", "id"),
    ("stock_moves", "sales_order_id", "sales_orders", "id"),
    ("stock_moves", "purchase_order_id", "purchase_orders", "id"),
    ("stock_moves", "sales_order_line_id", "sales_order_lines", "id"),
    ("stock_moves", "purchase_order_line_id", "purchase_order_lines", "id"),
    ("inventory_cost_layers", "product_id", "products", "id"),
    ("inventory_cost_layers", "location_id", "warehouse_locations", "id"),
    ("inventory_cost_layers", "stock_move_id", "stock_moves", "id"),
    ("purchase_orders", "company_id", "companies", "id"),
    ("purchase_orders", "vendor_id", "contacts", "id"),
    ("purchase_orders", "currency", "currencies", "code"),
    ("purchase_orders", "warehouse_id", "warehouses", "id"),
    ("purchase_order_lines", "po_id", "purchase_orders", "id"),
    ("purchase_order_lines", "product_id", "products", "id"),
    ("purchase_order_lines", "tax_code_id", "tax_codes", "id"),
    ("purchase_order_lines", "uom_id", "units_of_measure", "id"),
    ("purchase_order_lines", "account_id", "accounts", "id"),
    ("sales_orders", "company_id", "companies", "id"),
    ("sales_orders", "customer_id", "contacts", "id"),
    ("sales_orders", "currency", "currencies", "code"),
    ("sales_orders", "warehouse_id", "warehouses", "id"),
    ("sales_order_lines", "so_id", "sales_orders", "id"),
    ("sales_order_lines", "product_id", "products", "id"),
    ("sales_order_lines", "tax_code_id", "tax_codes", "id"),
    ("sales_order_lines", "uom_id", "units_of_measure", "id"),
    ("sales_order_lines", "account_id", "accounts", "id"),
]

# (rule id, table, SQL boolean that must not be FALSE; NULL passes like a CHECK)
CHECKS = [
    ("rate_positive", "exchange_rates", "rate > 0"),
    ("fy_date_order", "fiscal_years", "end_date > start_date"),
    ("period_date_order", "accounting_periods", "end_date > start_date"),
    ("tax_rate_nonneg", "tax_codes", "rate >= 0"),
    ("debit_nonneg", "journal_entry_lines", "debit_amount >= 0"),
    ("credit_nonneg", "journal_entry_lines", "credit_amount >= 0"),
    ("jel_one_side_only", "journal_entry_lines", "NOT (debit_amount > 0 AND credit_amount > 0)"),
    ("payment_positive", "payments", "amount > 0"),
    ("allocation_positive", "payment_allocations", "allocated_amount > 0"),
    ("move_qty_positive", "stock_moves", "quantity > 0"),
    ("sm_must_have_location", "stock_moves", "from_location_id IS NOT NULL OR to_location_id IS NOT NULL"),
    ("layer_original_positive", "inventory_cost_layers", "original_qty > 0"),
    ("layer_remaining_nonneg", "inventory_cost_layers", "remaining_qty >= 0"),
    ("layer_cost_nonneg", "inventory_cost_layers", "unit_cost >= 0"),
    ("po_qty_positive", "purchase_order_lines", "quantity > 0"),
    ("so_qty_positive", "sales_order_lines", "quantity > 0"),
]

# (table, column, enum domain)
ENUM_COLUMNS = [
    ("accounts", "category", "account_category"),
    ("accounts", "normal_balance", "normal_balance"),
    ("account_groups", "category", "account_category"),
    ("journal_entries", "status", "entry_status"),
    ("contacts", "type", "contact_type"),
    ("invoices", "type", "invoice_type"),
    ("invoices", "status", "invoice_status"),
    ("payments", "method", "payment_method"),
    ("payments", "direction", "payment_direction"),
    ("stock_moves", "move_type", "stock_move_type"),
    ("products", "valuation_method", "valuation_method"),
    ("purchase_orders", "status", "po_status"),
    ("sales_orders", "status", "so_status"),
    ("accounting_periods", "status", "period_status"),
    ("tax_codes", "tax_type", "tax_type"),
]

# (table, column, max length) -- VARCHAR(n) / CHAR(n) limits of the data model
LENGTH_LIMITS = [(t, c.name, c.length) for t, cols in COLUMNS.items() for c in cols if c.length]

# Primary keys are left out: the key audit counts their NULLs.
NOT_NULL = {t: [c.name for c in cols if c.required and c.name not in PRIMARY_KEYS[t]] for t, cols in COLUMNS.items()}
