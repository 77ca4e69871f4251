"""Common table expressions for the reference SQL: the star and its derived relations in plain ANSI-style SQL.

They follow the textbook definition (one wide table of order lines), not the pre-aggregated plans of the operators, so
that the two sides check each other.
"""

BASE = """
customers AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CAST(18 + c_custkey % 60 AS BIGINT) AS age, c_mktsegment AS payment_method
  FROM customer),
banded_customers AS (
  SELECT *, CASE WHEN age < 30 THEN '18-29' WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49'
                 WHEN age < 60 THEN '50-59' ELSE '60+' END AS age_band
  FROM customers),
products AS (
  SELECT p_partkey AS product_id, p_type AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part),
banded_products AS (
  SELECT *, CASE WHEN price < 920 THEN '0-920' WHEN price < 940 THEN '920-940' WHEN price < 960 THEN '940-960'
                 WHEN price < 980 THEN '960-980' ELSE '980+' END AS price_band
  FROM products),
invoices AS (
  SELECT o_orderkey AS invoice_no, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS invoice_date,
         o_orderpriority AS shopping_mall, strftime(o_orderdate, '%Y-%m') AS year_month
  FROM orders),
lines AS (SELECT l_orderkey AS invoice_no, l_partkey AS product_id FROM lineitem),
priced AS (
  SELECT l.invoice_no, l.product_id, p.category, p.price FROM lines l LEFT JOIN products p ON l.product_id = p.product_id),
order_lines AS (
  SELECT i.invoice_no, i.customer_id, i.invoice_date, i.shopping_mall, i.year_month, p.product_id, p.category, p.price
  FROM invoices i LEFT JOIN priced p ON i.invoice_no = p.invoice_no),
sizes AS (
  SELECT invoice_no, customer_id, invoice_date, shopping_mall, count(product_id) AS product_count,
         CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue
  FROM order_lines GROUP BY invoice_no, customer_id, invoice_date, shopping_mall),
snapshot AS (SELECT max(invoice_date) AS day FROM invoices),
rfm AS (
  SELECT customer_id, date_diff('day', max(invoice_date), (SELECT day FROM snapshot)) AS recency,
         count(DISTINCT invoice_no) AS frequency, CAST(coalesce(sum(price), 0) AS DOUBLE) AS monetary
  FROM order_lines GROUP BY customer_id),
rfm_long AS (
  SELECT 'recency' AS metric, CAST(recency AS DOUBLE) AS value FROM rfm
  UNION ALL SELECT 'frequency', CAST(frequency AS DOUBLE) FROM rfm
  UNION ALL SELECT 'monetary', monetary FROM rfm),
quartile_cuts AS (
  SELECT quantile_cont(monetary, 0.25) AS q25, quantile_cont(monetary, 0.5) AS q50, quantile_cont(monetary, 0.75) AS q75
  FROM rfm),
clustered AS (
  SELECT r.*, CAST(CASE WHEN monetary <= q25 THEN 0 WHEN monetary <= q50 THEN 1 WHEN monetary <= q75 THEN 2 ELSE 3 END
         AS BIGINT) AS cluster
  FROM rfm r CROSS JOIN quartile_cuts),
cluster_means AS (
  SELECT cluster, avg(recency) AS r, avg(frequency) AS f, avg(monetary) AS m FROM clustered GROUP BY cluster),
rule_cuts AS (
  SELECT quantile_cont(r, 0.75) AS r75, quantile_cont(f, 0.75) AS f75, quantile_cont(f, 0.5) AS f50,
         quantile_cont(m, 0.75) AS m75, quantile_cont(m, 0.5) AS m50
  FROM cluster_means),
cluster_names AS (
  SELECT cluster, CASE WHEN m > m75 AND f > f75 THEN 'High Value' WHEN r > r75 THEN 'At Risk'
                       WHEN f > f50 AND m > m50 THEN 'Regular' ELSE 'New/Low Activity' END AS segment
  FROM cluster_means CROSS JOIN rule_cuts),
segmented AS (SELECT c.*, n.segment FROM clustered c JOIN cluster_names n ON c.cluster = n.cluster),
segment_lines AS (
  SELECT o.*, s.segment FROM order_lines o LEFT JOIN segmented s ON o.customer_id = s.customer_id),
spending AS (
  SELECT customer_id, date_diff('day', max(invoice_date), (SELECT day FROM snapshot)) AS recency,
         count(DISTINCT invoice_no) AS frequency, CAST(coalesce(sum(price), 0) AS DOUBLE) AS monetary,
         date_diff('day', min(invoice_date), max(invoice_date)) AS tenure_days,
         count(DISTINCT product_id) AS unique_products, count(DISTINCT category) AS product_categories,
         count(*) AS n_rows, count(DISTINCT shopping_mall) AS unique_malls
  FROM order_lines GROUP BY customer_id),
monthly_spending AS (
  SELECT customer_id, year_month, CAST(coalesce(sum(price), 0) AS DOUBLE) AS revenue
  FROM order_lines GROUP BY customer_id, year_month),
consistency AS (
  SELECT customer_id, coalesce(stddev_samp(revenue), 0) AS purchase_consistency FROM monthly_spending GROUP BY customer_id),
target AS (
  SELECT customer_id, CAST(coalesce(sum(price), 0) AS DOUBLE) AS future_ltv FROM order_lines
  WHERE invoice_date > CAST((SELECT day FROM snapshot) - INTERVAL 6 MONTH AS DATE) GROUP BY customer_id),
features AS (
  SELECT s.customer_id, s.recency, s.frequency, s.monetary, s.monetary / s.frequency AS avg_order_value, s.tenure_days,
         CASE WHEN s.frequency > 1 THEN s.tenure_days / (s.frequency - 1) ELSE 0 END AS avg_days_between_orders,
         s.unique_products, s.product_categories, s.n_rows / s.frequency AS avg_products_per_order, s.unique_malls,
         c.purchase_consistency, d.age, d.gender, d.payment_method, g.segment, coalesce(t.future_ltv, 0) AS future_ltv
  FROM spending s JOIN consistency c ON s.customer_id = c.customer_id
  LEFT JOIN customers d ON s.customer_id = d.customer_id
  LEFT JOIN segmented g ON s.customer_id = g.customer_id
  LEFT JOIN target t ON s.customer_id = t.customer_id),
labelled AS (
  SELECT *, CASE WHEN future_ltv > (SELECT quantile_cont(future_ltv, 0.5) FROM features) THEN 'High' ELSE 'Low' END AS ltv_class,
         CASE WHEN monetary > (SELECT quantile_cont(monetary, 0.5) FROM features) THEN 'High' ELSE 'Low' END AS spend_class
  FROM features),
class_lines AS (
  SELECT o.*, l.ltv_class FROM order_lines o LEFT JOIN labelled l ON o.customer_id = l.customer_id)
"""
