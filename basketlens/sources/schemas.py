"""Columns of every file: (header in the file, column name here, type)."""

CUSTOMERS = (
    ("Customer id", "customer_id", "string"),
    ("Gender", "gender", "string"),
    ("Age", "age", "int"),
    ("Payment method", "payment_method", "string"),
)
PRODUCTS = (
    ("Product id", "product_id", "string"),
    ("Category", "category", "string"),
    ("Price", "price", "decimal(12,2)"),
)
SALES = (
    ("Invoice no", "invoice_no", "string"),
    ("Customer id", "customer_id", "string"),
    ("Product id list", "product_id_list", "string"),
    ("Invoice date", "invoice_date", "string"),
    ("Shopping mall", "shopping_mall", "string"),
)
SEGMENTATION = (
    ("Customer id", "customer_id", "string"),
    ("Recency", "recency", "int"),
    ("Frequency", "frequency", "bigint"),
    ("Monetary", "monetary", "double"),
    ("Cluster", "cluster", "int"),
    ("Segment", "segment", "string"),
)
LTV_PREDICTIONS = (
    ("Customer id", "customer_id", "string"),
    ("Predicted_LTV", "predicted_ltv", "double"),
    ("Predicted_Value_Class", "predicted_value_class", "string"),
    ("Actual_LTV", "actual_ltv", "double"),
    ("Actual_Value_Class", "actual_value_class", "string"),
)
FEATURE_IMPORTANCE = (
    ("feature", "feature", "string"),
    ("importance", "importance", "double"),
)
CATEGORY_PERFORMANCE = (
    ("Category", "category", "string"),
    ("Products_Sold", "products_sold", "bigint"),
    ("Total_Revenue", "total_revenue", "double"),
    ("Avg_Price", "avg_price", "double"),
    ("Transactions", "transactions", "bigint"),
    ("Unique_Customers", "unique_customers", "bigint"),
    ("Revenue_Per_Transaction", "revenue_per_transaction", "double"),
)
SEGMENT_PREFERENCES = (
    ("Segment", "segment", "string"),
    ("Category", "category", "string"),
    ("Revenue", "revenue", "double"),
    ("Products_Sold", "products_sold", "bigint"),
    ("Unique_Customers", "unique_customers", "bigint"),
)
SALES_TRENDS = (
    ("YearMonth", "year_month", "string"),
    ("Monthly_Revenue", "monthly_revenue", "double"),
    ("Transactions", "transactions", "bigint"),
    ("Products_Sold", "products_sold", "bigint"),
    ("Unique_Customers", "unique_customers", "bigint"),
    ("YearMonth_str", "year_month_str", "string"),
)
