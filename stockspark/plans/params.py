"""Fixed parameters the registered queries run with (same in the oracle)."""

DATE_START = "1997-01-01"
DATE_END = "1997-01-31"
AS_OF_DAILY = "2001-10-15"
AS_OF_BUDGET = "2024-01-15"
TREND_YEAR = 1997
FILLED_YEAR = 2001
SEARCH_TERM = "WIDGET"
SEARCH_WILDCARD = "SKU-1_"
CUSTOMER_TERM = "00012"
ITEM_ID = 5
CATEGORY_ID = 3
SALE_ID = 1000
STAFF_ID = 1
DEPARTMENT = "NATION_3"
PAYMENT_METHOD = "1-URGENT"
BUDGET_ID = 1002
BUDGET_CATEGORY = "MEDIUM"
BUDGET_MONTH = "2024-01"
TRANSACTION_TYPE = "expense"
TRANSACTION_CATEGORY = "PROMO"
