"""The registered queries as SQL for DuckDB, written independently of the Spark code.

Differences on purpose: promotions are matched by a range join instead of a calendar, churn labels by an anti-join
instead of one grouping, quartiles by sorting, means by whole-number division.
"""

from __future__ import annotations

import re

FEATURE_NAMES = (
    "customer_total_revenue customer_average_order_value customer_total_profit customer_profit_margin "
    "customer_purchase_count customer_total_quantity customer_average_discount customer_promo_purchase_rate "
    "customer_weekend_purchase_rate customer_recency_days"
).split()
CENTRES = [[1.0] * 10, [2.0] * 10, [3.0] * 5 + [1.0] * 5]


def _distance(centre: list[float]) -> str:
    return " + ".join(f"power({c} - {x}, 2)" for c, x in zip(FEATURE_NAMES, centre))


DESCRIPTIONS = [f"description_{x}" for x in ("pt", "de", "fr", "es", "en", "zh")]
TEXT_VALUE = "CASE WHEN upper(trim({0})) NOT IN ('', 'NAN', 'NONE', 'NULL') THEN trim({0}) END"
TEXT = TEXT_VALUE + " AS {0}"

# One raw table per block, all columns text, as in the landed messages.
CTES = {
    "raw_transactions": """
        SELECT 'INV-' || l_orderkey AS invoice_id,
               CAST(l_linenumber AS VARCHAR) AS line,
               CAST(o_custkey AS VARCHAR) AS customer_id,
               CAST(l_partkey AS VARCHAR) || CASE WHEN l_orderkey % 5 = 0 THEN '.0' ELSE '' END AS product_id,
               CASE l_linenumber % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS size,
               'NONE' AS color,
               CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(16,0))
                    * CAST(0.01 AS DECIMAL(2,2)) AS VARCHAR) AS unit_price,
               CASE WHEN l_orderkey % 97 = 0 THEN 'NULL' WHEN l_orderkey % 89 = 0 THEN '-1'
                    ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS quantity,
               CASE WHEN l_orderkey % 79 = 0 THEN 'some day'
                    ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00' END AS date,
               CASE WHEN l_orderkey % 83 = 0 THEN '1.5'
                    ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) END AS discount,
               CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS VARCHAR) AS line_total,
               CASE WHEN l_orderkey % 71 = 0 THEN 'none' ELSE CAST(l_suppkey AS VARCHAR) END AS store_id,
               CASE WHEN l_orderkey % 73 = 0 THEN '' WHEN l_orderkey % 67 = 0 THEN '999999999999'
                    ELSE CAST(l_suppkey * 10 + l_orderkey % 10 AS VARCHAR) END AS employee_id,
               CASE s_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CNY'
                    ELSE 'JPY' END AS currency,
               CASE s_nationkey % 5 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '£' ELSE '¥' END AS currency_symbol,
               'SKU-' || l_partkey AS sku,
               CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Sale' END AS transaction_type,
               CASE WHEN l_orderkey % 7 = 0 THEN ' none ' ELSE o_orderpriority END AS payment_method,
               CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS invoice_total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "made_customers": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name,
               CASE WHEN c_custkey % 13 = 0 THEN 'null' ELSE ' USER' || c_custkey || '@Example.COM ' END AS email,
               CASE WHEN c_custkey % 17 = 0 THEN 'NaN' ELSE '+1 555 ' || c_custkey END AS telephone,
               n_name AS city, r_name AS country,
               CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN 'F'
                    WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 'M' ELSE 'D' END AS gender,
               CASE WHEN c_custkey % 101 = 0 THEN '2031-05-05' WHEN c_custkey % 11 <> 0
                    THEN CAST(DATE '1940-01-01' + CAST((c_custkey * 7919) % 20000 AS INTEGER) AS VARCHAR)
               END AS date_of_birth,
               CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE 'Job ' || c_custkey % 9 END AS job_title
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "raw_customers": """
        SELECT * FROM made_customers
        UNION ALL SELECT * REPLACE ('zz ' || name AS name) FROM made_customers WHERE CAST(customer_id AS BIGINT) % 50 = 0
        UNION ALL SELECT * REPLACE ('n/a' AS customer_id) FROM made_customers WHERE CAST(customer_id AS BIGINT) % 60 = 0""",
    "made_products": """
        SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS category, p_brand AS sub_category,
               'PT ' || p_name AS description_pt, 'DE ' || p_name AS description_de, 'FR ' || p_name AS description_fr,
               'ES ' || p_name AS description_es, p_name AS description_en, 'ZH ' || p_name AS description_zh,
               CASE WHEN p_partkey % 23 = 0 THEN 'none' ELSE 'Color ' || p_partkey % 7 END AS color, 'S|M|L' AS sizes,
               CASE WHEN p_partkey % 211 = 0 THEN '999999.99' WHEN p_partkey % 307 = 0 THEN 'NaN'
                    WHEN p_partkey % 401 = 0 THEN '-5'
                    ELSE CAST(round(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) AS VARCHAR)
               END AS production_cost
        FROM part""",
    "raw_products": """
        SELECT * FROM made_products
        UNION ALL SELECT * REPLACE ('zz ' || category AS category) FROM made_products
        WHERE CAST(product_id AS BIGINT) % 97 = 0
        UNION ALL SELECT * REPLACE ('' AS product_id) FROM made_products WHERE CAST(product_id AS BIGINT) % 103 = 0""",
    "made_stores": """
        SELECT CAST(s_suppkey AS VARCHAR) AS store_id, n_name AS country, 'City_' || s_nationkey AS city,
               s_name AS store_name, '10' AS number_of_employees,
               CASE WHEN s_suppkey % 7 = 0 THEN 'null' ELSE 'Z' || s_suppkey END AS zip_code,
               CASE WHEN s_suppkey % 33 = 0 THEN '95' ELSE CAST(s_nationkey * 3 - 40 AS VARCHAR) END AS latitude,
               CAST(s_nationkey * 10 - 120 AS VARCHAR) AS longitude
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "raw_stores": """
        SELECT * FROM made_stores
        UNION ALL SELECT * REPLACE ('zz ' || store_name AS store_name) FROM made_stores
        WHERE CAST(store_id AS BIGINT) % 5 = 0
        UNION ALL SELECT * REPLACE ('none' AS store_id) FROM made_stores WHERE CAST(store_id AS BIGINT) % 10 = 0""",
    "made_employees": """
        SELECT CAST(s_suppkey * 10 + k AS VARCHAR) AS employee_id,
               CASE WHEN (s_suppkey * 10 + k) % 41 = 0 THEN '?' ELSE CAST(s_suppkey AS VARCHAR) END AS store_id,
               'Emp_' || (s_suppkey * 10 + k) AS name, CASE WHEN k = 0 THEN 'Manager' ELSE 'Seller' END AS position
        FROM supplier, unnest(range(10)) AS u(k)""",
    "raw_employees": """
        SELECT * FROM made_employees
        UNION ALL SELECT * REPLACE ('zz ' || name AS name) FROM made_employees WHERE CAST(employee_id AS BIGINT) % 53 = 0
        UNION ALL SELECT * REPLACE ('nan' AS employee_id) FROM made_employees WHERE CAST(employee_id AS BIGINT) % 59 = 0""",
    "made_discounts": """
        SELECT CAST(make_date(1995 + k, 1 + m, 1) AS VARCHAR) AS "start",
               CAST(make_date(1995 + k, 2 + m, 15) AS VARCHAR) AS "end",
               CAST(CAST((k + m) % 6 * 5 + 10 AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(2,2)) AS VARCHAR) AS discount,
               'Offer ' || k || '/' || m AS description, p_type AS category, p_brand AS sub_category
        FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand LIKE '%1%') AS brands,
             unnest([0, 2, 4]) AS a(k), unnest([0, 1, 5, 6]) AS b(m)""",
    "raw_discounts": """
        SELECT * FROM made_discounts
        UNION ALL SELECT * FROM made_discounts WHERE description = 'Offer 0/1'
        UNION ALL SELECT * REPLACE ('1990-01-01' AS "end") FROM made_discounts WHERE description = 'Offer 2/0'
        UNION ALL SELECT * REPLACE ('1.00004' AS discount) FROM made_discounts WHERE description = 'Offer 4/5'
        UNION ALL SELECT * REPLACE ('NULL' AS "start") FROM made_discounts WHERE description = 'Offer 4/6'""",
    "typed_transactions": """
        SELECT invoice_id, TRY_CAST(line AS INTEGER) AS line, TRY_CAST(customer_id AS BIGINT) AS customer_id,
               CAST(trunc(TRY_CAST(product_id AS DECIMAL(38,6))) AS BIGINT) AS product_id, size,
               CASE WHEN upper(trim(color)) NOT IN ('', 'NAN', 'NONE', 'NULL') THEN trim(color) END AS color,
               TRY_CAST(unit_price AS DECIMAL(18,4)) AS unit_price, TRY_CAST(quantity AS INTEGER) AS quantity,
               try_strptime(date, '%Y-%m-%d %H:%M:%S') AS date, TRY_CAST(discount AS DECIMAL(18,4)) AS discount,
               TRY_CAST(line_total AS DECIMAL(18,4)) AS line_total, TRY_CAST(store_id AS BIGINT) AS store_id,
               TRY_CAST(employee_id AS BIGINT) AS employee_id, currency, currency_symbol, sku, transaction_type,
               CASE WHEN upper(trim(payment_method)) NOT IN ('', 'NAN', 'NONE', 'NULL') THEN trim(payment_method) END
                   AS payment_method,
               TRY_CAST(invoice_total AS DECIMAL(18,4)) AS invoice_total
        FROM raw_transactions""",
    "transactions": """
        SELECT * FROM typed_transactions
        WHERE invoice_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL
          AND discount BETWEEN 0 AND 1 AND quantity > 0 AND unit_price >= 0 AND line_total >= 0
        QUALIFY row_number() OVER (
            PARTITION BY invoice_id, line
            ORDER BY product_id NULLS FIRST, store_id NULLS FIRST, line_total NULLS FIRST, unit_price NULLS FIRST) = 1""",
    "typed_customers": f"""
        SELECT TRY_CAST(customer_id AS BIGINT) AS customer_id,
               {', '.join(TEXT.format(c) for c in ('name', 'telephone', 'city', 'country', 'gender', 'job_title'))},
               lower({TEXT_VALUE.format('email')}) AS email,
               CAST(try_strptime(date_of_birth, '%Y-%m-%d') AS DATE) AS date_of_birth
        FROM raw_customers""",
    "customers": """
        SELECT * FROM typed_customers WHERE customer_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY name) = 1""",
    "typed_products": f"""
        SELECT TRY_CAST(product_id AS BIGINT) AS product_id,
               {', '.join(TEXT.format(c) for c in ('category', 'sub_category', 'color', 'sizes', *DESCRIPTIONS))},
               TRY_CAST(production_cost AS DECIMAL(38,10)) AS production_cost
        FROM raw_products""",
    "unfiltered_products": """
        SELECT * FROM typed_products WHERE product_id IS NOT NULL AND production_cost >= 0
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY category, sub_category, description_en) = 1""",
    "cost_quartiles": """
        SELECT CAST(quantile_disc(production_cost, 0.25) AS DOUBLE) AS q1,
               CAST(quantile_disc(production_cost, 0.75) AS DOUBLE) AS q3
        FROM unfiltered_products""",
    "products": """
        SELECT p.* FROM unfiltered_products p, cost_quartiles
        WHERE CAST(production_cost AS DOUBLE) BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)""",
    "typed_stores": f"""
        SELECT TRY_CAST(store_id AS BIGINT) AS store_id,
               {', '.join(TEXT.format(c) for c in ('country', 'city', 'store_name', 'zip_code'))},
               TRY_CAST(number_of_employees AS INTEGER) AS number_of_employees,
               TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude
        FROM raw_stores""",
    "stores": """
        SELECT * FROM typed_stores
        WHERE store_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
        QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY country, city, store_name) = 1""",
    "typed_employees": f"""
        SELECT TRY_CAST(employee_id AS BIGINT) AS employee_id, TRY_CAST(store_id AS BIGINT) AS store_id,
               {', '.join(TEXT.format(c) for c in ('name', 'position'))}
        FROM raw_employees""",
    "employees": """
        SELECT * FROM typed_employees WHERE employee_id IS NOT NULL AND store_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY store_id, name) = 1""",
    "typed_discounts": f"""
        SELECT CAST(try_strptime("start", '%Y-%m-%d') AS DATE) AS "start",
               CAST(try_strptime("end", '%Y-%m-%d') AS DATE) AS "end",
               TRY_CAST(discount AS DECIMAL(38,10)) AS discount,
               {', '.join(TEXT.format(c) for c in ('description', 'category', 'sub_category'))}
        FROM raw_discounts""",
    "discounts": """
        SELECT DISTINCT * FROM typed_discounts WHERE "end" >= "start" AND discount BETWEEN 0 AND 1""",
    "promos": """
        SELECT t.invoice_id, t.line, max(d.discount) AS promo_discount_pct
        FROM transactions t JOIN products p USING (product_id)
        JOIN discounts d ON d.category = p.category AND d.sub_category = p.sub_category
                        AND CAST(t.date AS DATE) BETWEEN d."start" AND d."end"
        GROUP BY ALL""",
    "rates": """
        SELECT * FROM (VALUES ('USD', CAST(1.00 AS DECIMAL(3,2))), ('EUR', 1.08), ('GBP', 1.27), ('CNY', 0.14))
            AS r(currency, fx_rate_to_usd)""",
    "dollars": """
        SELECT t.*, fx_rate_to_usd,
               CAST(round(unit_price * fx_rate_to_usd, 2) AS DECIMAL(18,2)) AS unit_price_usd,
               CAST(round(line_total * fx_rate_to_usd, 2) AS DECIMAL(18,2)) AS line_total_usd,
               CAST(round(invoice_total * fx_rate_to_usd, 2) AS DECIMAL(18,2)) AS invoice_total_usd
        FROM transactions t LEFT JOIN rates USING (currency)""",
    "fact": """
        SELECT t.*, c.name AS customer_name, c.email AS customer_email, c.city AS customer_city,
               c.country AS customer_country, c.gender AS customer_gender, c.date_of_birth,
               c.job_title AS customer_job_title, p.category AS product_category,
               p.sub_category AS product_sub_category, p.description_en AS product_description, p.production_cost,
               s.store_name, s.city AS store_city, s.country AS store_country, s.latitude AS store_latitude,
               s.longitude AS store_longitude, e.name AS employee_name, e.position AS employee_position,
               m.promo_discount_pct, m.promo_discount_pct IS NOT NULL AS promo_active,
               CAST(floor(date_diff('day', c.date_of_birth, CAST(t.date AS DATE)) / 365.25) AS INTEGER)
                   AS customer_age_at_purchase,
               CAST(round(line_total_usd - p.production_cost * t.quantity, 2) AS DECIMAL(18,2)) AS profit_usd,
               CAST(dayofweek(t.date) + 1 AS INTEGER) AS purchase_day_of_week,
               CAST(month(t.date) AS INTEGER) AS purchase_month, CAST(year(t.date) AS INTEGER) AS purchase_year,
               dayofweek(t.date) IN (0, 6) AS is_weekend
        FROM dollars t LEFT JOIN customers c USING (customer_id) LEFT JOIN products p USING (product_id)
        LEFT JOIN stores s USING (store_id) LEFT JOIN employees e USING (employee_id)
        LEFT JOIN promos m USING (invoice_id, line)""",
    "last_day": "SELECT max(CAST(date AS DATE)) AS d FROM fact",
    "measures": """
        SELECT customer_id, sum(line_total_usd) AS revenue, count(DISTINCT invoice_id) AS customer_purchase_count,
               sum(quantity) AS customer_total_quantity, sum(profit_usd) AS profit,
               CAST(sum(profit_usd) AS DOUBLE) / nullif(count(profit_usd), 0) AS average_profit,
               CAST(sum(discount) AS DOUBLE) / nullif(count(discount), 0) AS average_discount,
               CAST(count(*) FILTER (promo_active) AS DOUBLE) / count(*) AS customer_promo_purchase_rate,
               CAST(count(*) FILTER (is_weekend) AS DOUBLE) / count(*) AS customer_weekend_purchase_rate,
               max(CAST(date AS DATE)) AS customer_last_purchase_date,
               min(customer_country) AS customer_country, min(customer_gender) AS customer_gender,
               CAST(sum(customer_age_at_purchase) AS DOUBLE) / nullif(count(customer_age_at_purchase), 0) AS age
        FROM fact GROUP BY customer_id""",
    "features": """
        SELECT customer_id, CAST(coalesce(revenue, 0) AS DOUBLE) AS customer_total_revenue, customer_purchase_count,
               CAST(customer_total_quantity AS BIGINT) AS customer_total_quantity,
               coalesce(CAST(revenue AS DOUBLE) / customer_purchase_count, 0) AS customer_average_order_value,
               CAST(coalesce(profit, 0) AS DOUBLE) AS customer_total_profit,
               coalesce(average_profit, 0) AS customer_average_profit,
               coalesce(average_discount, 0) AS customer_average_discount,
               customer_promo_purchase_rate, customer_weekend_purchase_rate,
               CAST(customer_last_purchase_date AS VARCHAR) AS customer_last_purchase_date,
               customer_country, customer_gender, coalesce(age, 0) AS customer_age,
               CAST(date_diff('day', customer_last_purchase_date, (SELECT d FROM last_day)) AS INTEGER)
                   AS customer_recency_days,
               CASE WHEN revenue > 0 THEN coalesce(CAST(profit AS DOUBLE) / CAST(revenue AS DOUBLE), 0) ELSE 0 END
                   AS customer_profit_margin,
               CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
                    WHEN age < 55 THEN '45-54' ELSE '55+' END AS age_group
        FROM measures""",
    "codes": """
        SELECT column_name, value, count(*) AS customers,
               row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) - 1 AS index
        FROM (SELECT 'customer_country' AS column_name, customer_country AS value FROM features
              UNION ALL SELECT 'customer_gender', customer_gender FROM features
              UNION ALL SELECT 'age_group', age_group FROM features) AS v
        WHERE value IS NOT NULL GROUP BY column_name, value""",
    "past": "SELECT * FROM fact WHERE CAST(date AS DATE) <= (SELECT d - 90 FROM last_day)",
    "churn": """
        SELECT customer_id, CAST(coalesce(sum(line_total_usd), 0) AS DOUBLE) AS customer_total_revenue,
               count(DISTINCT invoice_id) AS customer_purchase_count,
               CAST(sum(quantity) AS BIGINT) AS customer_total_quantity,
               coalesce(CAST(sum(line_total_usd) AS DOUBLE) / count(DISTINCT invoice_id), 0)
                   AS customer_average_order_value,
               CAST(coalesce(sum(profit_usd), 0) AS DOUBLE) AS customer_total_profit,
               coalesce(CAST(sum(profit_usd) AS DOUBLE) / nullif(count(profit_usd), 0), 0) AS customer_average_profit,
               coalesce(CAST(sum(discount) AS DOUBLE) / nullif(count(discount), 0), 0) AS customer_average_discount,
               CAST(count(*) FILTER (promo_active) AS DOUBLE) / count(*) AS customer_promo_purchase_rate,
               CAST(count(*) FILTER (is_weekend) AS DOUBLE) / count(*) AS customer_weekend_purchase_rate,
               CAST(date_diff('day', max(CAST(date AS DATE)), (SELECT d - 90 FROM last_day)) AS INTEGER)
                   AS customer_recency_days,
               CASE WHEN sum(line_total_usd) > 0
                    THEN coalesce(CAST(sum(profit_usd) AS DOUBLE) / CAST(sum(line_total_usd) AS DOUBLE), 0)
                    ELSE 0 END AS customer_profit_margin,
               CAST(max(CAST(date AS DATE)) AS VARCHAR) AS customer_last_purchase_date,
               CASE WHEN customer_id IN (SELECT customer_id FROM fact
                                         WHERE CAST(date AS DATE) > (SELECT d - 90 FROM last_day))
                    THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS churn_label
        FROM past GROUP BY customer_id""",
    # Segments and scores of models that are given instead of fitted.
    "deviations": "SELECT " + ", ".join(f"stddev_samp({c}) AS {c}" for c in FEATURE_NAMES) + " FROM features",
    "units": "SELECT f.customer_id, " + ", ".join(f"f.{c} / s.{c} AS {c}" for c in FEATURE_NAMES)
             + " FROM features f, deviations s",
    "given_segments": f"""
        SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster
        FROM (SELECT *, {_distance(CENTRES[0])} AS d0, {_distance(CENTRES[1])} AS d1, {_distance(CENTRES[2])} AS d2
              FROM units) AS u""",
    # every customer with every other one
    "given_distances": f"""
        SELECT a.customer_id, a.cluster, b.cluster AS other, count(*) AS n,
               sum({' + '.join(f'power(a.{c} - b.{c}, 2)' for c in FEATURE_NAMES)}) AS total
        FROM given_segments a, given_segments b GROUP BY ALL""",
    "given_silhouettes": """
        SELECT customer_id, cluster, max(n) FILTER (other = cluster) AS n,
               max(total / greatest(n - 1, 1)) FILTER (other = cluster) AS a, min(total / n) FILTER (other <> cluster) AS b
        FROM given_distances GROUP BY ALL""",
    "given_scores": """
        SELECT customer_id, churn_label, 1 / (1 + exp(-z)) AS probability
        FROM (SELECT *, 0.25 + 0.004 * customer_recency_days - 0.05 * customer_purchase_count
                        + 0.5 * customer_promo_purchase_rate - 0.75 * customer_profit_margin AS z FROM churn) AS s""",
    # Scores by a fixed rule (long absence is risky), so that everything downstream of a score can be compared.
    "scores": """
        SELECT customer_id, churn_label, probability AS churn_probability,
               CASE WHEN probability >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS predicted_churn,
               CASE WHEN probability >= 0.80 THEN 'HIGH' WHEN probability >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END
                   AS risk_level
        FROM (SELECT *, CAST(least(customer_recency_days, 1000) AS DOUBLE) / 1000 AS probability FROM churn) AS s""",
}


def _needs(text: str) -> list[str]:
    """Blocks that a text uses, each after the ones it uses itself."""
    found: list[str] = []
    for name in CTES:
        if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
            found += [n for n in (*_needs(CTES[name]), name) if n not in found]
    return found


def sql(text: str) -> str:
    """The text with the blocks it uses in front."""
    blocks = ",\n".join(f"{name} AS ({CTES[name]})" for name in _needs(text))
    return f"WITH {blocks}\n{text}" if blocks else text


def total(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE)"


def mean(x: str) -> str:
    """Mean rounded half away from zero to 2 digits, in whole cents."""
    cents, n = f"sum(CAST({x} * 100 AS HUGEINT))", f"nullif(count({x}), 0)"
    return (
        f"CAST(CASE WHEN {cents} >= 0 THEN (2 * {cents} + {n}) // (2 * {n}) "
        f"ELSE -((2 * -{cents} + {n}) // (2 * {n})) END AS DOUBLE) / 100"
    )


def whole(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def quotient(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def grouped(keys: str, measures: str, order: str = "", source: str = "fact") -> str:
    return sql(f"SELECT {keys}, {measures} FROM {source} GROUP BY ALL {order}")


def top(measure: str, keys: str, n: int) -> str:
    ties = ", ".join(f"{k.strip()} ASC NULLS LAST" for k in keys.split(","))
    return f"ORDER BY {measure} DESC NULLS LAST, {ties} LIMIT {n}"


REVENUE = f"{total('line_total_usd')} AS revenue_usd"
PROFIT = f"{total('profit_usd')} AS profit_usd"
UNITS = f"{whole('quantity')} AS units_sold"
LINES = "count(*) AS transactions"
CUSTOMERS = "count(DISTINCT customer_id) AS customers"
EXP_REVENUE = f"{total('line_total_usd')} AS total_revenue_usd"
EXP_PROFIT = f"{total('profit_usd')} AS total_profit_usd"
EXP_AVERAGE = f"{mean('line_total_usd')} AS avg_line_value_usd"
MARGIN = f"round(({quotient('sum(profit_usd)', 'sum(line_total_usd)')}) * 100, 1) AS margin_pct"

FACT_COLUMNS = (
    "invoice_id line customer_id product_id size color unit_price quantity date discount line_total store_id "
    "employee_id currency currency_symbol sku transaction_type payment_method invoice_total fx_rate_to_usd "
    "unit_price_usd line_total_usd invoice_total_usd customer_name customer_email customer_city customer_country "
    "customer_gender date_of_birth customer_job_title product_category product_sub_category product_description "
    "production_cost store_name store_city store_country store_latitude store_longitude employee_name "
    "employee_position promo_discount_pct promo_active customer_age_at_purchase profit_usd purchase_day_of_week "
    "purchase_month purchase_year is_weekend"
).split()
DECIMALS = {
    "unit_price", "discount", "line_total", "invoice_total", "fx_rate_to_usd", "unit_price_usd", "line_total_usd",
    "invoice_total_usd", "production_cost", "promo_discount_pct", "profit_usd",
}
DATES = {"date", "date_of_birth"}


def plain(columns: str | list[str]) -> str:
    """Columns with decimals as double and dates as text."""
    names = columns.split() if isinstance(columns, str) else columns

    def one(c: str) -> str:
        if c in DECIMALS:
            return f"CAST({c} AS DOUBLE) AS {c}"
        return f"CAST({c} AS VARCHAR) AS {c}" if c in DATES else c

    return ", ".join(one(c) for c in names)


KEY = "invoice_id line"


def _json(pairs: dict[str, str]) -> str:
    return "to_json({" + ", ".join(f"'{title}': {column}" for title, column in pairs.items()) + "})"


TRANSACTION_JSON = _json(
    {
        "Invoice ID": "invoice_id", "Line": "line", "Customer ID": "customer_id", "Product ID": "product_id",
        "Size": "size", "Color": "color", "Unit Price": "unit_price", "Quantity": "quantity", "Date": "date",
        "Discount": "discount", "Line Total": "line_total", "Store ID": "store_id", "Employee ID": "employee_id",
        "Currency": "currency", "Currency Symbol": "currency_symbol", "SKU": "sku",
        "Transaction Type": "transaction_type", "Payment Method": "payment_method", "Invoice Total": "invoice_total",
    }
)
RAW_TRANSACTION = (
    "invoice_id, line, customer_id, product_id, size, color, unit_price, quantity, date, discount, line_total, "
    "store_id, employee_id, currency, currency_symbol, sku, transaction_type, payment_method, invoice_total"
)
TABLES = ("customers", "products", "stores", "employees", "discounts", "transactions")
TOPIC_COUNTS = sql(
    " UNION ALL ".join(f"SELECT '{t}' AS topic, count(*) AS messages FROM raw_{t}" for t in TABLES)
)


RAW_ORDER = {
    "customers": "customer_id name email telephone city country gender date_of_birth job_title",
    "products": "product_id category sub_category description_pt description_de description_fr description_es "
                "description_en description_zh color sizes production_cost",
    "stores": "store_id country city store_name number_of_employees zip_code latitude longitude",
    "employees": "employee_id store_id name position",
    "discounts": '"start" "end" discount description category sub_category',
    "transactions": RAW_TRANSACTION.replace(",", ""),
}
LANDED_ROWS = sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS topic, {' || chr(124) || '.join(f'coalesce({c}, chr(126))' for c in RAW_ORDER[t].split())} AS row "
        f"FROM raw_{t}"
        for t in TABLES
    )
)


def _quality(table: str, before: str, after: str, no_id: str, rule: str, duplicates: str, outliers: str = "0") -> str:
    return (
        f"SELECT '{table}' AS table_name, ({before}) AS rows_before, ({after}) AS rows_after, "
        f"({before}) - ({after}) AS rows_dropped, CAST(({no_id}) AS BIGINT) AS null_id_rows, "
        f"CAST(({rule}) AS BIGINT) AS rule_rows, CAST(({duplicates}) AS BIGINT) AS duplicate_rows, "
        f"CAST(({outliers}) AS BIGINT) AS outlier_rows"
    )


def _quality_report() -> str:
    count = "SELECT count(*) FROM "
    rules = {
        "customers": ("customer_id IS NOT NULL", "true"),
        "products": ("product_id IS NOT NULL", "production_cost >= 0"),
        "stores": ("store_id IS NOT NULL", "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"),
        "employees": ("employee_id IS NOT NULL AND store_id IS NOT NULL", "true"),
        "discounts": ("true", '"end" >= "start" AND discount BETWEEN 0 AND 1'),
        "transactions": (
            "invoice_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL",
            "discount BETWEEN 0 AND 1 AND quantity > 0 AND unit_price >= 0 AND line_total >= 0",
        ),
    }
    parts = []
    for t, (ids, rule) in rules.items():
        unique = "unfiltered_products" if t == "products" else t
        parts.append(
            _quality(
                t, f"{count} raw_{t}", f"{count} {t}", f"{count} typed_{t} WHERE NOT ({ids})",
                f"{count} typed_{t} WHERE {ids} AND NOT coalesce({rule}, false)",
                f"({count} typed_{t} WHERE {ids} AND coalesce({rule}, false)) - ({count} {unique})",
                f"({count} {unique}) - ({count} {t})",
            )
        )
    return sql(" UNION ALL ".join(parts))


RAW_NULLABLE = "color payment_method currency"
PLACEHOLDER = "CASE WHEN upper(trim({0})) NOT IN ('', 'NAN', 'NONE', 'NULL') THEN trim({0}) END AS {0}"
SPLIT = "CAST('0x' || substr(md5(CAST(customer_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"

ORACLE = {
    # ingest
    "ingest_csv_rows": sql(
        "SELECT " + ", ".join(f"coalesce({c.strip()}, '') AS {c.strip()}" for c in RAW_TRANSACTION.split(","))
        + " FROM raw_transactions"
    ),
    "ingest_to_json": sql(f"SELECT 'transactions' AS topic, CAST({TRANSACTION_JSON} AS VARCHAR) AS value "
                          "FROM raw_transactions"),
    "ingest_from_json": sql(f"SELECT {RAW_TRANSACTION} FROM raw_transactions"),
    "ingest_topic_counts": TOPIC_COUNTS,
    "stream_land_raw": LANDED_ROWS,
    "raw_landed_rejects": """SELECT 'customers' AS topic, replace(w, '%s', n_name) AS value FROM nation, unnest([
        '%s', '["%s"]', '{"Name":"%s"', '{"Name":"%s"} {"Name":"b"}', '{"Name":"%s"}, {"Name":"b"}', '{"Name":"%s"}xx'
        ]) AS u(w)""",
    # cleaning
    "null_placeholders": sql(
        "SELECT invoice_id, line, product_id, store_id, line_total, "
        + ", ".join(PLACEHOLDER.format(c) for c in RAW_NULLABLE.split())
        + " FROM raw_transactions"
    ),
    "clean_customers": sql(f"SELECT {plain('customer_id name email telephone city country gender date_of_birth job_title')}"
                           " FROM customers"),
    "clean_products": sql(f"SELECT {plain('product_id category sub_category color production_cost sizes')}, "
                          f"{', '.join(DESCRIPTIONS)}, 3 AS size_count FROM products"),
    "clean_stores": sql("SELECT store_id, country, city, store_name, number_of_employees, zip_code, latitude, longitude "
                        "FROM stores"),
    "clean_employees": sql("SELECT employee_id, store_id, name, position FROM employees"),
    "clean_discounts": sql('SELECT CAST("start" AS VARCHAR) AS "start", CAST("end" AS VARCHAR) AS "end", description, '
                           "CAST(discount AS DOUBLE) AS discount, category, sub_category FROM discounts"),
    "clean_transactions": sql(f"SELECT {plain(FACT_COLUMNS[:19])} FROM transactions"),
    "clean_quality_report": _quality_report(),
    "unconverted_currencies": sql("SELECT currency, count(*) AS lines FROM fact WHERE fx_rate_to_usd IS NULL GROUP BY ALL"),
    "dedup_keyed": sql(
        """SELECT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem
           QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
                        l_extendedprice NULLS FIRST) = 1"""
    ),
    "dedup_full_row": sql("""SELECT DISTINCT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem"""),
    "iqr_filter": sql("""SELECT product_id, CAST(production_cost AS DOUBLE) AS production_cost
        FROM unfiltered_products, cost_quartiles
        WHERE CAST(production_cost AS DOUBLE) BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""),
    # fact
    "fx_convert": sql(f"SELECT {plain(KEY + ' currency fx_rate_to_usd unit_price_usd line_total_usd invoice_total_usd')}"
                      " FROM dollars"),
    "fact_join_customers": sql(f"""SELECT {plain(KEY)}, t.customer_id, c.name AS customer_name, c.email AS customer_email,
        c.city AS customer_city, c.country AS customer_country, c.gender AS customer_gender,
        CAST(c.date_of_birth AS VARCHAR) AS date_of_birth, c.job_title AS customer_job_title
        FROM transactions t LEFT JOIN customers c USING (customer_id)"""),
    "fact_join_products": sql(f"""SELECT {plain(KEY)}, t.product_id, p.category AS product_category,
        p.sub_category AS product_sub_category, p.description_en AS product_description,
        CAST(p.production_cost AS DOUBLE) AS production_cost
        FROM transactions t LEFT JOIN products p USING (product_id)"""),
    "fact_join_stores": sql(f"""SELECT {plain(KEY)}, t.store_id, s.store_name, s.city AS store_city,
        s.country AS store_country, s.latitude AS store_latitude, s.longitude AS store_longitude
        FROM transactions t LEFT JOIN stores s USING (store_id)"""),
    "fact_join_employees": sql(f"""SELECT {plain(KEY)}, t.employee_id, e.name AS employee_name,
        e.position AS employee_position FROM transactions t LEFT JOIN employees e USING (employee_id)"""),
    "promo_calendar": sql("""SELECT category AS product_category, sub_category AS product_sub_category,
        CAST(CAST(day AS DATE) AS VARCHAR) AS day, CAST(max(discount) AS DOUBLE) AS promo_discount_pct
        FROM discounts, unnest(generate_series(CAST("start" AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY))
            AS u(day)
        WHERE CAST(day AS DATE) BETWEEN (SELECT min(CAST(date AS DATE)) FROM typed_transactions)
                                    AND (SELECT max(CAST(date AS DATE)) FROM typed_transactions)
        GROUP BY ALL"""),
    "fact_promo_join": sql(f"SELECT {plain(KEY + ' promo_discount_pct promo_active')} FROM fact"),
    "top1_per_line": sql(f"SELECT {plain(KEY + ' promo_discount_pct promo_active')} FROM fact"),
    "customer_age": sql(f"SELECT {plain(KEY + ' customer_id customer_age_at_purchase')} FROM fact"),
    "profit_usd": sql(f"SELECT {plain(KEY + ' line_total_usd production_cost quantity profit_usd')} FROM fact"),
    "date_parts": sql(
        f"SELECT {plain(KEY + ' date purchase_day_of_week purchase_month purchase_year is_weekend')} FROM fact"
    ),
    "fact_transactions": sql(f"SELECT {plain(FACT_COLUMNS)} FROM fact"),
    "fact_incremental": sql(f"SELECT {plain(FACT_COLUMNS)} FROM fact"),
    "rollup_sales_profit": sql(f"""SELECT {total('line_total_usd')} AS total_revenue_usd,
        {total('profit_usd')} AS total_profit_usd, {mean('line_total_usd')} AS average_transaction_value_usd FROM fact"""),
    "rollup_by_year": grouped("purchase_year", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rollup_by_month": grouped("purchase_year, purchase_month", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rollup_by_category": grouped("product_category", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rollup_totals": sql(f"""SELECT count(*) AS total_transactions, {total('line_total_usd')} AS total_revenue,
        {total('profit_usd')} AS total_profit, {quotient('sum(profit_usd)', 'sum(line_total_usd)')} AS profit_margin FROM fact"""),
    "distinct_sketches": grouped("purchase_year", """count(DISTINCT customer_id) AS customers,
        count(DISTINCT invoice_id) AS invoices, count(DISTINCT product_id) AS products, true AS customers_close,
        true AS invoices_close, true AS products_close"""),
    "report_filtered": sql(f"""SELECT store_country, {REVENUE}, {PROFIT}, count(DISTINCT store_id) AS stores FROM fact
        WHERE purchase_year = 1997 AND product_sub_category = 'Brand#11' GROUP BY ALL"""),
    "fact_partition_counts": grouped("purchase_year, purchase_month", "count(*) AS lines"),
    "fact_view_sql": grouped("product_category, purchase_year", f"{REVENUE}, {UNITS}"),
    # sales reports
    "rpt_overview": sql("""SELECT count(*) AS total_transactions, count(DISTINCT invoice_id) AS total_invoices,
        count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_id) AS total_products FROM fact"""),
    "rpt_sales_profit": sql(f"""SELECT {total('line_total_usd')} AS total_revenue_usd,
        {total('profit_usd')} AS total_profit_usd, {mean('line_total_usd')} AS average_transaction_value_usd FROM fact"""),
    "rpt_by_year": grouped("purchase_year", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rpt_by_month": grouped("purchase_year, purchase_month", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rpt_by_category": grouped("product_category", f"{REVENUE}, {PROFIT}, {UNITS}"),
    "rpt_by_subcategory": grouped("product_sub_category", f"{REVENUE}, {PROFIT}, {UNITS}",
                                  top("revenue_usd", "product_sub_category", 20)),
    "rpt_top_products": grouped("product_id, product_description", f"{REVENUE}, {UNITS}, {PROFIT}",
                                top("revenue_usd", "product_id, product_description", 10)),
    "rpt_by_customer_country": grouped("customer_country", f"{REVENUE}, {PROFIT}, {CUSTOMERS}",
                                       top("revenue_usd", "customer_country", 20)),
    "rpt_by_store_country": grouped("store_country", f"{REVENUE}, {PROFIT}, count(DISTINCT store_id) AS stores"),
    "rpt_payment_method": grouped("payment_method",
                                  f"{LINES}, {REVENUE}, {mean('line_total_usd')} AS average_transaction_usd"),
    "rpt_gender": grouped("customer_gender", f"{CUSTOMERS}, {REVENUE}, {PROFIT}"),
    "rpt_weekday_weekend": grouped("CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS day_type",
                                   f"{LINES}, {REVENUE}, {PROFIT}"),
    "rpt_discount": grouped(
        """CASE WHEN coalesce(promo_discount_pct, 0) = 0 THEN 'No Discount' WHEN promo_discount_pct <= 0.10 THEN '1-10%'
           WHEN promo_discount_pct <= 0.20 THEN '11-20%' WHEN promo_discount_pct <= 0.30 THEN '21-30%'
           ELSE '30%+' END AS discount_range""", f"{LINES}, {REVENUE}, {PROFIT}"),
    "rpt_discount_literal": grouped(
        """CASE WHEN promo_discount_pct = 0 THEN 'No Discount' WHEN promo_discount_pct <= 10 THEN '1-10%'
           WHEN promo_discount_pct <= 20 THEN '11-20%' WHEN promo_discount_pct <= 30 THEN '21-30%'
           ELSE '30%+' END AS discount_range""", f"{LINES}, {REVENUE}, {PROFIT}"),
    "rpt_top_customers": grouped("customer_id, customer_name, customer_country", f"{REVENUE}, {PROFIT}",
                                 top("revenue_usd", "customer_id, customer_name, customer_country", 10)),
    "rpt_top_stores": grouped("store_id, store_name, store_country", f"{REVENUE}, {PROFIT}",
                              top("revenue_usd", "store_id, store_name, store_country", 10)),
    # exploration
    "exp_null_counts": sql(
        " UNION ALL ".join(
            f"SELECT (SELECT count(*) FROM fact) AS total_rows, '{c}' AS column_name, "
            f"(SELECT count(*) - count({c}) FROM fact) AS null_count"
            for c in FACT_COLUMNS
        )
    ),
    "exp_negative_profit": sql(f"""SELECT count(*) FILTER (profit_usd < 0) AS lines,
        {quotient('count(*) FILTER (profit_usd < 0)', 'count(*)')} AS share FROM fact"""),
    "exp_negative_profit_lines": sql(f"""SELECT {plain(KEY + ' product_category promo_active unit_price_usd '
        'production_cost profit_usd')} FROM (SELECT * FROM fact WHERE profit_usd < 0
        ORDER BY profit_usd, invoice_id, line) AS f"""),
    "exp_promo_no_discount": sql(f"""SELECT {plain(KEY + ' product_category promo_discount_pct discount '
        'line_total_usd')} FROM (SELECT * FROM fact WHERE promo_active AND discount = 0
        ORDER BY invoice_id, line) AS f"""),
    "exp_overall": sql(f"""SELECT {total('line_total_usd')} AS total_revenue, {total('profit_usd')} AS total_profit,
        {mean('line_total_usd')} AS avg_line_value, count(*) AS line_items, count(DISTINCT invoice_id) AS invoices
        FROM fact"""),
    "exp_store_country": grouped("store_country", f"{EXP_REVENUE}, {EXP_PROFIT}, {LINES}"),
    "exp_payment_method": grouped("payment_method", f"{EXP_REVENUE}, {LINES}"),
    "exp_by_month": grouped("purchase_year, purchase_month", f"{EXP_REVENUE}, {LINES}"),
    "exp_weekend": grouped("is_weekend", f"{EXP_REVENUE}, {EXP_AVERAGE}, {LINES}"),
    "exp_categories": sql("SELECT DISTINCT product_category FROM fact"),
    "exp_top_subcategories": grouped("product_category, product_sub_category", f"{EXP_REVENUE}, count(*) AS units_sold",
                                     top("total_revenue_usd", "product_category, product_sub_category", 10)),
    "exp_margin_by_category": grouped("product_category", f"{EXP_PROFIT}, {EXP_REVENUE}, {MARGIN}"),
    "exp_gender": grouped("customer_gender", f"{EXP_REVENUE}, count(DISTINCT customer_id) AS distinct_customers"),
    "exp_age_stats": sql("""SELECT min(customer_age_at_purchase) AS min_age,
        round(CAST(sum(customer_age_at_purchase) AS DOUBLE) / count(customer_age_at_purchase), 1) AS avg_age,
        max(customer_age_at_purchase) AS max_age FROM fact"""),
    "exp_bad_ages": sql(f"""SELECT {plain('customer_id date_of_birth date customer_age_at_purchase ' + KEY)}
        FROM (SELECT * FROM fact WHERE customer_age_at_purchase < 0 OR customer_age_at_purchase > 100
        ORDER BY customer_id, date, invoice_id, line) AS f"""),
    "exp_top_customers": grouped("customer_id, customer_name",
                                 f"{total('line_total_usd')} AS total_spend_usd, count(DISTINCT invoice_id) AS invoices",
                                 top("total_spend_usd", "customer_id, customer_name", 10)),
    "exp_top_stores": grouped("store_name, store_city, store_country", f"{EXP_REVENUE}, {LINES}",
                              top("total_revenue_usd", "store_name, store_city, store_country", 20)),
    "exp_top_employees": grouped("employee_name, employee_position, store_name", f"{EXP_REVENUE}, {LINES}",
                                 top("total_revenue_usd", "employee_name, employee_position, store_name", 10)),
    "exp_promo_vs_non": grouped("promo_active", f"{EXP_REVENUE}, {EXP_AVERAGE}, {MARGIN}, {LINES}"),
    "exp_promo_distribution": sql("""SELECT CAST(promo_discount_pct AS DOUBLE) AS promo_discount_pct, count(*) AS lines
        FROM fact WHERE promo_active GROUP BY ALL"""),
    # dashboard measures
    "kpi_executive": sql(f"""SELECT {REVENUE}, {PROFIT},
        {quotient('sum(profit_usd)', 'sum(line_total_usd)')} AS profit_margin, {LINES},
        {whole('quantity')} AS units, {mean('line_total_usd')} AS avg_transaction_value FROM fact"""),
    "kpi_repeat_customers": sql(f"""SELECT count(*) AS customers, count(*) FILTER (orders > 1) AS repeat_customers,
        {quotient('count(*) FILTER (orders > 1)', 'count(*)')} AS repeat_rate
        FROM (SELECT customer_id, count(DISTINCT invoice_id) AS orders FROM fact GROUP BY ALL) AS o"""),
    "kpi_stores": sql("""SELECT count(DISTINCT store_id) AS stores, count(DISTINCT store_country) AS countries,
        (SELECT store_name FROM fact GROUP BY store_id, store_name
         ORDER BY sum(line_total_usd) DESC NULLS LAST, store_name LIMIT 1) AS top_store,
        (SELECT CAST(max(r) AS DOUBLE) FROM (SELECT sum(line_total_usd) AS r FROM fact GROUP BY store_id, store_name))
            AS top_store_revenue_usd FROM fact"""),
    "kpi_product": sql(f"""SELECT {mean('unit_price_usd')} AS avg_unit_price_usd, {whole('quantity')} AS units,
        {REVENUE}, {LINES} FROM fact"""),
    "kpi_category_year": grouped("purchase_year, product_category", REVENUE),
    "kpi_year_store": grouped("purchase_year, store_name", REVENUE),
    "kpi_country": grouped("store_country", f"{LINES}, {REVENUE}"),
    "kpi_age_group": grouped("""CASE WHEN customer_age_at_purchase < 25 THEN '18-24'
        WHEN customer_age_at_purchase < 35 THEN '25-34' WHEN customer_age_at_purchase < 45 THEN '35-44'
        WHEN customer_age_at_purchase < 55 THEN '45-54' ELSE '55+' END AS age_group""", f"{REVENUE}, {LINES}"),
    "kpi_filtered": sql(f"""SELECT product_category, {REVENUE}, {PROFIT}, {LINES} FROM fact
        WHERE purchase_year = 1997 AND store_country = 'NATION_10' GROUP BY ALL"""),
    "kpi_drilldown": sql(f"""SELECT purchase_year, store_country, product_category, {REVENUE}, {LINES},
        CAST(grouping_id(purchase_year, store_country, product_category) AS INTEGER) AS level
        FROM fact GROUP BY ROLLUP (purchase_year, store_country, product_category)"""),
    # features and models
    "customer_features": sql("SELECT * FROM features"),
    "customer_features_coded": sql("""SELECT customer_id,
        CAST(coalesce(a.index, (SELECT count(*) FROM codes WHERE column_name = 'customer_country')) AS DOUBLE)
            AS customer_country_index,
        CAST(coalesce(b.index, (SELECT count(*) FROM codes WHERE column_name = 'customer_gender')) AS DOUBLE)
            AS customer_gender_index,
        CAST(c.index AS DOUBLE) AS age_group_index
        FROM features
        LEFT JOIN codes a ON a.column_name = 'customer_country' AND a.value = customer_country
        LEFT JOIN codes b ON b.column_name = 'customer_gender' AND b.value = customer_gender
        LEFT JOIN codes c ON c.column_name = 'age_group' AND c.value = age_group"""),
    "validate_duplicates": sql("""SELECT count(*) AS duplicated_customers
        FROM (SELECT customer_id FROM features GROUP BY customer_id HAVING count(*) > 1) AS d"""),
    "category_index": sql("SELECT * FROM codes"),
    "scaled_features": sql("SELECT customer_id, " + ", ".join(
        f"round({c} / (SELECT stddev_samp({c}) FROM features), 6) AS {c}" for c in FEATURE_NAMES) + " FROM features"),
    "churn_dataset": sql("SELECT * FROM churn"),
    "train_test_split": sql(f"SELECT customer_id, {SPLIT} < 80 AS is_train FROM churn"),
    "risk_band": sql("SELECT * FROM scores"),
    "confusion_metrics": sql("""SELECT tp, fp, fn, tn, p AS churn_precision, r AS churn_recall,
        CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS churn_f1
        FROM (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p,
                     CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r
              FROM (SELECT count(*) FILTER (churn_label = 1 AND predicted_churn = 1) AS tp,
                           count(*) FILTER (churn_label = 0 AND predicted_churn = 1) AS fp,
                           count(*) FILTER (churn_label = 1 AND predicted_churn = 0) AS fn,
                           count(*) FILTER (churn_label = 0 AND predicted_churn = 0) AS tn FROM scores) AS c) AS m"""),
    # results for clients
    "segment_profile_fixed": sql(
        "SELECT CAST(customer_purchase_count % 3 AS INTEGER) AS cluster, count(*) AS customers, "
        + ", ".join(
            f"round(avg({column}), 6) AS {name}"
            for name, column in {
                "avg_revenue": "customer_total_revenue", "avg_purchase_count": "customer_purchase_count",
                "avg_quantity": "customer_total_quantity", "avg_order_value": "customer_average_order_value",
                "avg_profit": "customer_total_profit", "avg_discount": "customer_average_discount",
                "avg_promo_rate": "customer_promo_purchase_rate", "avg_weekend_rate": "customer_weekend_purchase_rate",
                "avg_recency_days": "customer_recency_days",
            }.items()
        )
        + " FROM features GROUP BY 1"
    ),
    "segment_assign": sql("SELECT customer_id, CAST(cluster AS INTEGER) AS cluster FROM given_segments"),
    "silhouette_fixed": sql("""SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS customers,
        round(avg(CASE WHEN n = 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
        FROM given_silhouettes GROUP BY 1"""),
    "score_fixed": sql("""SELECT customer_id, churn_label, round(probability, 9) AS churn_probability,
        CASE WHEN probability > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS predicted_churn,
        CASE WHEN probability >= 0.80 THEN 'HIGH' WHEN probability >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
        FROM given_scores"""),
    "roc_auc_fixed": sql("""SELECT round((sum(place) FILTER (churn_label = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS roc_auc
        FROM (SELECT churn_label, rank() OVER (ORDER BY churn_probability)
                     + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0 AS place FROM scores) AS r,
             (SELECT count(*) FILTER (churn_label = 1) AS n1, count(*) FILTER (churn_label = 0) AS n0 FROM scores) AS c
        GROUP BY n1, n0"""),
    "evaluation_metrics": sql("""
        SELECT round(sum(share * coalesce(2 * p * r / nullif(p + r, 0), 0)), 9) AS f1,
               round(sum(share * p), 9) AS weighted_precision, round(sum(share * r), 9) AS weighted_recall,
               round(coalesce(max(CASE WHEN class = 1 THEN 2 * p * r / nullif(p + r, 0) END), 0), 9) AS churn_f1
        FROM (SELECT class, CAST(count(*) FILTER (churn_label = class) AS DOUBLE) / count(*) AS share,
                     coalesce(CAST(count(*) FILTER (churn_label = class AND predicted_churn = class) AS DOUBLE)
                              / nullif(count(*) FILTER (predicted_churn = class), 0), 0) AS p,
                     coalesce(CAST(count(*) FILTER (churn_label = class AND predicted_churn = class) AS DOUBLE)
                              / nullif(count(*) FILTER (churn_label = class), 0), 0) AS r
              FROM scores, unnest([0, 1]) AS c(class) GROUP BY class) AS by_class"""),
    "serve_summary": sql(f"""SELECT count(*) AS total_transactions, {total('line_total_usd')} AS total_revenue,
        {total('profit_usd')} AS total_profit, {quotient('sum(profit_usd)', 'sum(line_total_usd)')} AS profit_margin,
        count(DISTINCT customer_id) AS unique_customers, count(DISTINCT invoice_id) AS unique_orders,
        {quotient('sum(line_total_usd)', 'count(DISTINCT invoice_id)')} AS average_order_value FROM fact"""),
    "serve_customer_analytics": sql("""
        SELECT 'risk_level' AS kind, 'HIGH' AS name, count(*) AS customers FROM scores WHERE risk_level = 'HIGH'
        UNION ALL SELECT 'risk_level', 'MEDIUM', count(*) FROM scores WHERE risk_level = 'MEDIUM'
        UNION ALL SELECT 'risk_level', 'LOW', count(*) FROM scores WHERE risk_level = 'LOW'
        UNION ALL SELECT 'churn_label', 'Churned', count(*) FROM scores WHERE churn_label = 1
        UNION ALL SELECT 'churn_label', 'Not Churned', count(*) FROM scores WHERE churn_label = 0"""),
    "serve_churn_summary": sql("""SELECT count(*) AS total_customers,
        count(*) FILTER (predicted_churn = 1) AS predicted_churn_customers,
        round(avg(churn_probability), 9) AS average_churn_probability,
        CAST(count(*) FILTER (predicted_churn = 1) AS DOUBLE) / count(*) AS predicted_churn_rate,
        count(*) FILTER (risk_level = 'HIGH') AS high_risk_customers,
        count(*) FILTER (risk_level = 'MEDIUM') AS medium_risk_customers,
        count(*) FILTER (risk_level = 'LOW') AS low_risk_customers FROM scores"""),
    "serve_high_risk": sql("""SELECT customer_id, churn_probability, risk_level, predicted_churn FROM scores
        WHERE risk_level = 'HIGH' ORDER BY churn_probability DESC, customer_id LIMIT 100"""),
    "serve_churn_distribution": sql("""SELECT customer_id, churn_probability, risk_level FROM scores
        ORDER BY churn_probability DESC, customer_id LIMIT 2000"""),
    "sanitize_numeric": sql(f"""SELECT {plain(KEY)}, CAST(line_total_usd AS DOUBLE) AS line_total_usd,
        CASE WHEN profit_usd >= 0 THEN sqrt(CAST(profit_usd AS DOUBLE)) END AS root_profit,
        CASE WHEN profit_usd >= 0 THEN CAST(profit_usd AS DOUBLE) END AS bounded_profit FROM fact"""),
}
