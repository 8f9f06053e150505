"""Queries as SQL that both engines run; ids are those of the survey's inventory."""

from __future__ import annotations

LINES = """lines AS (
  SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS po_id, CAST(l_shipdate AS DATE) AS order_date,
    CAST(DAYNO(CAST(l_shipdate AS DATE)) AS BIGINT) AS day, p_brand AS item, l_suppkey AS supplier_id, l_returnflag AS unit, p_type AS category,
    CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS line_total, l_extendedprice / l_quantity AS unit_price, l_partkey AS part_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

NUMBERED = LINES + """,
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY po_id ORDER BY order_date, item, supplier_id, part_id, quantity, line_total) AS BIGINT) AS occurrence FROM lines)"""

_W = "PARTITION BY {} ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING"
FEATURES = NUMBERED + f""",
windows AS (
  SELECT *, count(*) OVER ({_W.format('item')}) AS n_item, count(*) OVER ({_W.format('item, supplier_id')}) AS n_pair,
    count(*) OVER ({_W.format('supplier_id')}) AS n_supplier, count(*) OVER ({_W.format('unit')}) AS n_unit,
    PCTL(unit_price, 0.25) OVER ({_W.format('item')}) AS q1, PCTL(unit_price, 0.5) OVER ({_W.format('item')}) AS median_price,
    PCTL(unit_price, 0.75) OVER ({_W.format('item')}) AS q3, PCTL(quantity, 0.5) OVER ({_W.format('item')}) AS median_quantity,
    PCTL(line_total, 0.5) OVER ({_W.format('item')}) AS median_total, PCTL(unit_price, 0.5) OVER ({_W.format('item, supplier_id')}) AS pair_median
  FROM numbered),
features AS (
  SELECT *, CASE WHEN n_item >= 20 THEN unit_price / nullif(median_price, 0) END AS price_ratio,
    CASE WHEN n_item >= 20 THEN (unit_price - median_price) / nullif(q3 - q1, 0) END AS price_iqr_distance,
    CASE WHEN n_item >= 20 THEN (q3 - q1) / nullif(median_price, 0) END AS relative_iqr,
    CASE WHEN n_item >= 20 THEN quantity / nullif(median_quantity, 0) END AS quantity_ratio,
    CASE WHEN n_item >= 20 THEN line_total / nullif(median_total, 0) END AS total_ratio,
    CASE WHEN n_pair >= 20 THEN unit_price / nullif(pair_median, 0) END AS pair_price_ratio FROM windows)"""

PERIOD = """CASE WHEN order_date >= DATE '1992-01-01' AND order_date < DATE '1992-07-01' THEN 'warmup' WHEN order_date >= DATE '1992-07-01' AND order_date < DATE '1996-01-01' THEN 'development'
  WHEN order_date >= DATE '1996-01-01' AND order_date < DATE '1998-01-01' THEN 'validation' WHEN order_date >= DATE '1998-01-01' AND order_date < DATE '2003-01-01' THEN 'retrospective' END"""

INVOICES = """inv AS (
  SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS invoice_id,
    l_suppkey AS supplier_id, o_orderpriority AS department_id, n_name AS country, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS invoice_date,
    mod(l_linenumber * 5, 24) AS submission_hour, 'NET' || CAST(30 * (1 + mod(l_linenumber, 3)) AS STRING) AS payment_terms, l_linestatus AS invoice_type,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_fraud, l_returnflag AS fraud_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
hashed AS (SELECT *, HEX256(invoice_id) AS h FROM inv),
invoices AS (SELECT *, CASE WHEN h < 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
  WHEN h < 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'val' ELSE 'test' END AS split FROM hashed)"""

TRAINED = INVOICES + """,
train AS (SELECT * FROM invoices WHERE split = 'train'),
sup AS (SELECT supplier_id, count(*) AS n, avg(amount) AS mean, stddev_samp(amount) AS std FROM train GROUP BY supplier_id),
dep AS (SELECT department_id, count(*) AS n, avg(amount) AS mean FROM train GROUP BY department_id),
pair AS (SELECT supplier_id, department_id, count(*) AS n FROM train GROUP BY supplier_id, department_id),
cty AS (SELECT country, count(*) AS n FROM train WHERE country IS NOT NULL GROUP BY country),
overall AS (SELECT avg(amount) AS mean, stddev_samp(amount) AS std FROM train)"""

FEATURED = TRAINED + """,
featured AS (
  SELECT i.invoice_id, i.split, i.is_fraud, i.fraud_type, i.amount, ln(1 + i.amount) AS log_amount, coalesce(s.n, 0) AS supplier_frequency, coalesce(c.n, 0) AS country_frequency,
    i.amount / coalesce(s.mean, g.mean) AS amount_vs_supplier_mean, (i.amount - coalesce(s.mean, g.mean)) / coalesce(nullif(s.std, 0), g.std) AS supplier_amount_zscore,
    coalesce(d.n, 0) AS department_frequency, i.amount / coalesce(d.mean, g.mean) AS amount_vs_department_mean, coalesce(p.n, 0) AS supplier_department_frequency,
    CAST(regexp_extract(i.payment_terms, '([0-9]+)', 1) AS INT) AS payment_terms_days, CASE i.invoice_type WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS invoice_type_encoded,
    sin(2 * pi() * i.submission_hour / 24) AS hour_sin, cos(2 * pi() * i.submission_hour / 24) AS hour_cos,
    sin(2 * pi() * (ISODAY(i.invoice_date) - 1) / 7) AS dow_sin, cos(2 * pi() * (ISODAY(i.invoice_date) - 1) / 7) AS dow_cos,
    sin(2 * pi() * (month(i.invoice_date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(i.invoice_date) - 1) / 12) AS month_cos,
    CASE WHEN ISODAY(i.invoice_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, i.invoice_date, i.supplier_id, i.department_id
  FROM invoices i LEFT JOIN sup s ON i.supplier_id = s.supplier_id LEFT JOIN dep d ON i.department_id = d.department_id
    LEFT JOIN pair p ON i.supplier_id = p.supplier_id AND i.department_id = p.department_id LEFT JOIN cty c ON i.country = c.country CROSS JOIN overall g)"""

EVALUATED = """evaluated AS (SELECT l.doc_id, toxic AS y, quality, n_chars AS score, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS p, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

SUPPLIERS = """raw AS (
  SELECT user_id, event_type, nullif(round(value, 0), 3) AS metric, CASE WHEN mod(user_id, 7) = 0 THEN 1 ELSE 0 END AS target FROM events
  UNION ALL SELECT user_id, event_type, nullif(round(value, 0), 3), CASE WHEN mod(user_id, 7) = 0 THEN 1 ELSE 0 END FROM events WHERE mod(event_id, 10) = 0),
dedup AS (SELECT DISTINCT * FROM raw),
base AS (SELECT user_id, PCTL(metric, 0.5) AS metric, count(*) AS record_count, max(target) AS target FROM dedup GROUP BY user_id),
split AS (SELECT *, CASE WHEN HEX256(CAST(user_id AS STRING)) < 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
  WHEN HEX256(CAST(user_id AS STRING)) < 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'validation' ELSE 'test' END AS part FROM base)"""

VERSIONS = """versions AS (
  SELECT o_orderkey AS version_id, o_custkey AS owner, CAST(o_orderdate AS DATE) AS recorded, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS revision_no, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders)"""

_N = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)"


def n(condition: str) -> str:
    return _N.format(condition)


CATALOG = {
    # scans
    "s02_projected_scan": "SELECT o_orderkey, o_orderstatus FROM orders",
    "s03_in_scan": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "s04_semi_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49)",
    "s05_equal_scan": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A'",
    "s15_values_catalog": "SELECT n_name, k.label FROM nation JOIN (VALUES (0, 'south'), (1, 'west'), (2, 'east')) AS k(code, label) ON n_regionkey = k.code",
    # projections and predicates
    "p04_rename": "SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer",
    "p06_period": f"WITH {LINES} SELECT period, count(*) AS n FROM (SELECT {PERIOD} AS period FROM lines) x GROUP BY period",
    "p08_null_label": "SELECT coalesce(nullif(o_orderstatus, 'P'), '__missing__') AS status, count(*) AS n FROM orders GROUP BY coalesce(nullif(o_orderstatus, 'P'), '__missing__')",
    "p12_not_in_train": f"WITH {INVOICES}, months AS (SELECT DISTINCT CAST(date_trunc('month', invoice_date) AS DATE) AS m FROM invoices WHERE split = 'train' AND month(invoice_date) <> 5) SELECT invoice_id FROM invoices i WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM months WHERE m = CAST(date_trunc('month', i.invoice_date) AS DATE))",
    "p13_ambiguous_labels": f"WITH {INVOICES} SELECT split, {n('(is_fraud = 1 AND fraud_type = ' + chr(39) + 'N' + chr(39) + ') OR (is_fraud = 0 AND fraud_type IS NOT NULL AND fraud_type <> ' + chr(39) + 'N' + chr(39) + ')')} AS ambiguous FROM invoices GROUP BY split",
    "p14_null_safe": "SELECT count(*) AS n FROM events a WHERE nullif(event_type, 'click') IS DISTINCT FROM nullif(event_type, 'view')",
    "p15_exactly_one": "SELECT count(*) AS n FROM orders WHERE (CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN 0 ELSE 1 END + CASE WHEN nullif(o_orderstatus, 'O') IS NULL THEN 0 ELSE 1 END) = 1",
    "p16_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "p22_outcome": f"WITH {EVALUATED} SELECT doc_id, CASE WHEN y = 1 AND p = 1 THEN 'TP' WHEN y = 0 AND p = 1 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM evaluated",
    "p24_min_support": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 30",
    # joins
    "j01_left_attributes": "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0",
    "j08_reconcile": "SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'unexpected' ELSE 'missing' END AS finding FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE mod(c_custkey, 5) <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL",
    "j09_split_overlap": f"WITH {INVOICES} SELECT count(*) AS n FROM (SELECT supplier_id FROM invoices WHERE split = 'train' INTERSECT SELECT supplier_id FROM invoices WHERE split = 'test') x",
    "j10_range_join": f"WITH {LINES}, daily AS (SELECT item, day, count(*) AS c, count(DISTINCT supplier_id) AS s FROM lines GROUP BY item, day) SELECT a.item, a.day, CAST(sum(b.c) AS BIGINT) AS n FROM daily a JOIN daily b ON a.item = b.item AND b.day >= a.day - 90 AND b.day < a.day GROUP BY a.item, a.day",
    "d21_near_pairs": f"WITH {LINES} SELECT a.po_id AS first_id, b.po_id AS second_id, b.day - a.day AS gap, a.line_total = b.line_total AS same_total FROM lines a JOIN lines b ON a.part_id = b.part_id AND a.supplier_id = b.supplier_id AND a.unit = b.unit AND a.quantity = b.quantity AND b.day - a.day <= 3 AND (a.day < b.day OR (a.day = b.day AND a.po_id < b.po_id))",
    "j16_group_share": f"WITH {LINES}, g AS (SELECT item, unit, sum(quantity) AS q FROM lines GROUP BY item, unit) SELECT item, unit, round(CAST(q AS DOUBLE) / CAST(sum(q) OVER (PARTITION BY item) AS DOUBLE), 9) AS share FROM g",
    "j17_first_last_quarter": f"WITH {LINES}, q AS (SELECT item, CAST(date_trunc('quarter', order_date) AS DATE) AS quarter, count(*) AS n FROM lines GROUP BY item, CAST(date_trunc('quarter', order_date) AS DATE)), e AS (SELECT min(quarter) AS a, max(quarter) AS b FROM q) SELECT x.item, x.n AS n_first, y.n AS n_last FROM q x JOIN q y ON x.item = y.item JOIN e ON x.quarter = e.a AND y.quarter = e.b",
    "j21_entity_read": "SELECT c_custkey, n_name, r_name, o.o_orderkey AS head FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey",
    # aggregates
    "a01_supplier_train": f"WITH {TRAINED} SELECT supplier_id, n, round(mean, 4) AS mean, round(std, 4) AS std FROM sup",
    "a02_department_train": f"WITH {TRAINED} SELECT department_id, n, round(mean, 4) AS mean FROM dep",
    "a03_pair_size": f"WITH {TRAINED} SELECT supplier_id, department_id, n FROM pair",
    "a04_country_frequency": f"WITH {TRAINED} SELECT country, n FROM cty",
    "a05_global": f"WITH {TRAINED} SELECT round(mean, 4) AS mean, round(std, 4) AS std FROM overall",
    "a06_null_census": f"WITH {FEATURED} SELECT {n('supplier_amount_zscore IS NULL')} AS z_nulls, {n('invoice_type_encoded IS NULL')} AS type_nulls, {n('amount <= 0')} AS bad_amounts, count(*) AS n FROM featured",
    "a07_dedup": f"WITH {SUPPLIERS} SELECT (SELECT count(*) FROM raw) AS n_raw, (SELECT count(*) FROM dedup) AS n_dedup",
    "a08_group_median": f"WITH {SUPPLIERS} SELECT user_id, metric, record_count FROM base",
    "a10_distinct_counts": "SELECT event_type, count(DISTINCT nullif(round(value, 0), 3)) AS present, count(DISTINCT nullif(round(value, 0), 3)) + max(CASE WHEN round(value, 0) = 3 THEN 1 ELSE 0 END) AS with_null FROM events GROUP BY event_type",
    "a11_histogram": f"WITH {SUPPLIERS} SELECT record_count, count(*) AS suppliers FROM base GROUP BY record_count",
    "a12_quality_profile": f"WITH {SUPPLIERS} SELECT 'metric' AS feature, count(metric) AS present, count(*) - count(metric) AS missing, round(100.0E0 * count(metric) / count(*), 6) AS coverage, min(metric) + 0 AS low, max(metric) AS high, {n('metric = 0')} AS zeros, {n('metric < 0')} AS negatives, {n('metric > 100')} AS above FROM base",
    "a13_target_audit": f"WITH {SUPPLIERS}, t AS (SELECT event_type, count(DISTINCT target) AS kinds, min(target) AS low, max(target) AS high FROM dedup GROUP BY event_type) SELECT event_type, kinds, CASE WHEN low = 0 AND high = 1 THEN 1 ELSE 0 END AS both_classes FROM t WHERE kinds > 1",
    "a15_class_distribution": f"WITH {SUPPLIERS} SELECT part, count(*) AS n, {n('target = 1')} AS positives, round(100.0E0 * sum(target) / count(*), 6) AS pct FROM split GROUP BY part",
    "a16_impute": f"WITH {SUPPLIERS}, m AS (SELECT PCTL(metric, 0.5) AS med FROM split WHERE part = 'train') SELECT user_id, part, coalesce(metric, med) AS metric FROM split CROSS JOIN m",
    "a17_scale": f"WITH {SUPPLIERS}, m AS (SELECT avg(metric) AS mean, stddev_pop(metric) AS std FROM split WHERE part = 'train') SELECT user_id, round((metric - mean) / nullif(std, 0), 6) + 0 AS z FROM split CROSS JOIN m WHERE metric IS NOT NULL",
    "a19_confusion": f"WITH {EVALUATED}, c AS (SELECT {n('y = 1 AND p = 1')} AS tp, {n('y = 0 AND p = 1')} AS fp, {n('y = 1 AND p = 0')} AS fn, {n('y = 0 AND p = 0')} AS tn FROM evaluated) SELECT tp, fp, fn, tn, round(coalesce(tp * 1.0E0 / nullif(tp + fp, 0), 0.0E0), 9) AS precision_1, round(coalesce(tp * 1.0E0 / nullif(tp + fn, 0), 0.0E0), 9) AS recall_1 FROM c",
    "a22_metrics_by_group": f"WITH {EVALUATED} SELECT lang, quality, count(*) AS n, {n('y = 1 AND p = 1')} AS tp, {n('p = 1')} AS alerts FROM evaluated GROUP BY GROUPING SETS ((lang), (quality))",
    "a23_selection_profile": f"WITH {INVOICES}, t AS (SELECT fraud_type, count(*) AS c FROM invoices WHERE amount > 50000 GROUP BY fraud_type), r AS (SELECT *, rank() OVER (ORDER BY c DESC) AS k, sum(c) OVER () AS total FROM t) SELECT fraud_type, c, round(c * 1.0E0 / CAST(total AS DOUBLE), 9) AS share FROM r WHERE k = 1",
    "a27_score_summary": "SELECT count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(PCTL(l_extendedprice, 0.01), 6) AS p01, round(PCTL(l_extendedprice, 0.5), 6) AS p50, round(PCTL(l_extendedprice, 0.99), 6) AS p99 FROM lineitem",
    "a28_upper_tail": f"WITH {LINES}, q AS (SELECT PCTL(line_total, 0.95) AS p95, PCTL(line_total, 0.99) AS p99 FROM lines WHERE order_date < DATE '1996-01-01') SELECT unit, {n('line_total >= p95')} AS above_p95, {n('line_total >= p99')} AS above_p99 FROM lines CROSS JOIN q WHERE order_date >= DATE '1996-01-01' GROUP BY unit",
    "a29_group_counts": f"WITH {LINES} SELECT category, item, unit, CAST(month(order_date) AS INT) AS m, count(*) AS n, {n('quantity >= 45')} AS chosen FROM lines GROUP BY GROUPING SETS ((category), (item), (unit), (CAST(month(order_date) AS INT)))",
    "a33_cents_median": "SELECT o_orderpriority, CAST(2 * PCTL(CAST(round(o_totalprice * 100) AS BIGINT), 0.5) AS BIGINT) AS twice_median_cents, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "a34_distinct_support": f"WITH {LINES} SELECT item, count(DISTINCT order_date) AS dates, count(DISTINCT supplier_id) AS suppliers FROM lines GROUP BY item",
    "a36_cardinality": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "a37_every": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_large FROM orders GROUP BY o_custkey",
    "a38_monthly": f"WITH {LINES} SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, count(*) AS n, count(DISTINCT supplier_id) AS suppliers, CAST(sum(quantity) AS BIGINT) AS quantity, PCTL(quantity, 0.5) AS median_quantity FROM lines GROUP BY CAST(date_trunc('month', order_date) AS DATE)",
    "a40_rates": f"WITH {LINES} SELECT supplier_id, count(*) AS n, round(avg(CASE WHEN unit = 'R' THEN 1.0E0 ELSE 0.0E0 END), 9) AS rate FROM lines GROUP BY supplier_id",
    "a41_concentration": f"WITH {LINES}, s AS (SELECT supplier_id, CAST(sum(CAST(round(line_total) AS BIGINT)) AS BIGINT) AS spend FROM lines GROUP BY supplier_id), r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, supplier_id) AS k, CAST(sum(spend) OVER (ORDER BY spend DESC, supplier_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(spend) OVER () AS DOUBLE) AS cum FROM s) SELECT round(max(CASE WHEN k = 1 THEN cum END), 9) AS top1, round(max(CASE WHEN k = 5 THEN cum END), 9) AS top5, CAST(min(CASE WHEN cum >= 0.8 THEN k END) AS BIGINT) AS to_80 FROM r",
    "a42_variation": f"WITH {LINES} SELECT item, round(stddev_samp(quantity) / avg(quantity), 9) AS cv FROM lines GROUP BY item",
    "a43_correlation": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem",
    "a44_pair_support": f"WITH {SUPPLIERS} SELECT {n('metric IS NOT NULL AND target = 1')} AS both_present FROM base",
    "a46_by_class": f"WITH {EVALUATED} SELECT y, count(*) AS n, PCTL(score, 0.5) AS median, round(avg(score), 4) AS mean, round(stddev_samp(score), 3) AS std FROM evaluated GROUP BY y",
    "a47_crosstab": "SELECT o_orderpriority, " + ", ".join(f"{n('o_orderstatus = ' + chr(39) + s + chr(39))} AS status_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority",
    "a49_missing_by_class": f"WITH {SUPPLIERS} SELECT target, count(*) AS n, {n('metric IS NULL')} AS missing FROM base GROUP BY target",
    "a50_subgroup_rates": f"WITH {EVALUATED} SELECT lang, round({n('y = 0 AND p = 1')} * 1.0E0 / nullif({n('y = 0')}, 0), 9) AS fpr, round({n('y = 1 AND p = 0')} * 1.0E0 / nullif({n('y = 1')}, 0), 9) AS fnr FROM evaluated GROUP BY lang",
    "a52_ks": f"WITH {INVOICES}, v AS (SELECT amount, {n('split = ' + chr(39) + 'train' + chr(39))} AS a, {n('split = ' + chr(39) + 'val' + chr(39))} AS b FROM invoices WHERE split <> 'test' GROUP BY amount), c AS (SELECT CAST(sum(a) OVER (ORDER BY amount ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(a) OVER () AS DOUBLE) AS f, CAST(sum(b) OVER (ORDER BY amount ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(b) OVER () AS DOUBLE) AS g FROM v) SELECT round(max(abs(f - g)), 9) AS distance FROM c",
    "a54_split_dates": f"WITH {INVOICES} SELECT split, min(invoice_date) AS first_day, max(invoice_date) AS last_day, count(*) AS n FROM invoices GROUP BY split",
    "a56_pooled": f"WITH {TRAINED}, p AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n * mean) / CAST(sum(n) AS DOUBLE) AS m FROM sup) SELECT CASE WHEN abs(max(p.m) / max(g.mean) - 1) < 1e-9 THEN 1 ELSE 0 END AS mean_agrees, CASE WHEN abs(sqrt(sum(CASE WHEN s.n > 1 THEN (s.n - 1) * s.std * s.std ELSE 0 END + s.n * (s.mean - p.m) * (s.mean - p.m)) / (max(p.n) - 1)) / max(g.std) - 1) < 1e-6 THEN 1 ELSE 0 END AS std_agrees FROM sup s CROSS JOIN p CROSS JOIN overall g",
    # windows and order
    "w04_occurrence": f"WITH {NUMBERED} SELECT occurrence, count(*) AS n FROM numbered GROUP BY occurrence",
    "w08_deciles": "WITH e AS (SELECT " + ", ".join(f"PCTL(c_acctbal, 0.{k}) AS e{k}" for k in range(1, 10)) + " FROM customer) SELECT 1 " + " ".join(f"+ CASE WHEN c_acctbal > e{k} THEN 1 ELSE 0 END" for k in range(1, 10)) + " AS decile, count(*) AS n FROM customer CROSS JOIN e GROUP BY 1",
    "w12_average_rank": f"WITH {EVALUATED} SELECT doc_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0E0 AS avg_rank FROM evaluated",
    "t04_abs_order": "SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier ORDER BY abs(s_acctbal) DESC NULLS LAST, s_suppkey LIMIT 20",
    "t06_keyset_page": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-06-01' OR (CAST(o_orderdate AS DATE) = DATE '1996-06-01' AND o_orderkey < 1000) ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC LIMIT 21",
    "t07_keyed_sample": "SELECT o_orderpriority, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY HEX256('seed-7:' || CAST(o_orderkey AS STRING))) AS k FROM orders) x WHERE k <= 25",
    "t11_folds": f"WITH {EVALUATED} SELECT fold, y, count(*) AS n FROM (SELECT y, mod(CAST(row_number() OVER (PARTITION BY y ORDER BY HEX256('42:' || CAST(doc_id AS STRING)), doc_id) AS BIGINT), 5) AS fold FROM evaluated) x GROUP BY fold, y",
    # sets
    "u02_complement": "SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "u05_grid": "SELECT l_quantity AS x FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R'",
    "u07_multiset_equal": "SELECT (SELECT count(*) FROM (SELECT l_partkey, l_quantity FROM lineitem EXCEPT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_discount < 0.1) x) AS missing",
    # scalar functions
    "f01_cyclic": f"WITH {INVOICES} SELECT DISTINCT submission_hour, round(sin(2 * pi() * submission_hour / 24), 9) + 0 AS s, round(cos(2 * pi() * submission_hour / 24), 9) + 0 AS c FROM invoices",
    "f07_half_up": "SELECT DISTINCT l_quantity, greatest(1, CAST(round(CAST(l_quantity AS DECIMAL(18,1)) * CAST(0.1 AS DECIMAL(2,1)), 0) AS BIGINT)) AS tenth FROM lineitem",
    "f09_extract": "SELECT conv_id, turn, regexp_extract(text, '([0-9]+)', 1) AS digits FROM conversations",
    "f10_text_checks": "SELECT count(*) AS n FROM documents WHERE trim(lang) = lang AND length(lang) > 0",
    "f11_dictionary": "SELECT r_name, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 END AS code FROM region",
    "f12_escape": "SELECT item_id, replace(replace(replace(text, '|', '/'), '*', '+'), chr(10), ' ') AS plain FROM benchmark",
    "f15_dates": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(month(CAST(o_orderdate AS DATE)) AS INT) AS m, CAST(quarter(CAST(o_orderdate AS DATE)) AS INT) AS q, CAST(ISODAY(CAST(o_orderdate AS DATE)) - 1 AS INT) AS weekday FROM orders",
    "f20_spine": "WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY CAST(ts AS DATE)), b AS (SELECT min(CAST(ts AS DATE)) AS a, max(DAYNO(CAST(ts AS DATE))) - min(DAYNO(CAST(ts AS DATE))) AS k FROM events), s AS (SELECT explode_days FROM (SELECT {SPINE} AS explode_days FROM b) y) SELECT CAST(explode_days AS DATE) AS d, coalesce(n, 0) AS n FROM s LEFT JOIN d ON d.d = CAST(explode_days AS DATE)",
    "f22_hash_split": f"WITH {SUPPLIERS} SELECT user_id, part FROM split",
    "f24_arrays": "SELECT o_custkey, CAST(SIZE(LIST(o_orderkey)) AS BIGINT) AS n FROM orders GROUP BY o_custkey",
    "f28_json": "SELECT event_type, JSONTEXT(props, '$.k') AS k, count(*) AS n FROM events GROUP BY event_type, JSONTEXT(props, '$.k')",
    "f30_exact_decimal": "SELECT count(*) AS n FROM conversations WHERE regexp_extract(text, '^[0-9]{1,14}([.][0-9]{1,6})?$', 0) <> ''",
    # domains
    "d01_features": f"WITH {FEATURED} SELECT invoice_id, split, is_fraud, round(log_amount, 6) AS log_amount, supplier_frequency, country_frequency, round(amount_vs_supplier_mean, 6) AS amount_vs_supplier_mean, round(supplier_amount_zscore, 5) + 0 AS supplier_amount_zscore, department_frequency, round(amount_vs_department_mean, 6) AS amount_vs_department_mean, supplier_department_frequency, payment_terms_days, invoice_type_encoded, round(dow_sin, 6) + 0 AS dow_sin, round(month_cos, 6) + 0 AS month_cos, is_weekend FROM featured",
    "d06_global_share": f"WITH {INVOICES}, r AS (SELECT country, row_number() OVER (ORDER BY amount DESC, invoice_id, invoice_date) AS k, count(*) OVER () AS total FROM inv), s AS (SELECT country, count(*) AS n, {n('k <= (total * 5 + 99) / 100')} AS chosen FROM r GROUP BY country) SELECT country, n, chosen, round(chosen * 1.0E0 / n, 9) AS share FROM s",
    "d07_selection_types": f"WITH {INVOICES}, r AS (SELECT fraud_type, is_fraud, row_number() OVER (ORDER BY amount DESC, invoice_id, invoice_date) AS k FROM invoices WHERE split = 'test') SELECT fraud_type, count(*) AS n, {n('k <= 100')} AS chosen, {n('k <= 100 AND is_fraud = 1')} AS hits FROM r GROUP BY GROUPING SETS ((fraud_type), ())",
    "d16_supplier_base": f"WITH {SUPPLIERS} SELECT user_id, metric, record_count, target, part FROM split",
    # versions
    "v04_chain_audit": f"WITH {VERSIONS} SELECT count(*) AS broken FROM versions a LEFT JOIN versions b ON a.supersedes = b.version_id WHERE a.revision_no > 1 AND (b.revision_no IS NULL OR b.revision_no <> a.revision_no - 1 OR b.owner <> a.owner)",
    "v05_head_diff": f"WITH {VERSIONS}, head AS (SELECT owner, max(revision_no) AS r FROM versions GROUP BY owner) SELECT v.owner, v.status FROM versions v JOIN head h ON v.owner = h.owner AND v.revision_no = h.r JOIN customer ON c_custkey = v.owner WHERE v.status IS DISTINCT FROM CASE WHEN c_acctbal < 0 THEN 'P' ELSE 'O' END",
    "v06_one_audit": "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY o_orderkey HAVING count(l_orderkey) <> 1",
    "v09_snapshot": f"WITH {VERSIONS} SELECT owner, version_id, revision_no FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY revision_no DESC) AS k FROM versions WHERE recorded <= DATE '1996-01-01') x WHERE k = 1",
    "v10_snapshot_check": f"WITH {VERSIONS} SELECT owner, count(*) AS late FROM versions WHERE recorded > DATE '1998-01-01' GROUP BY owner",
    "v14_latest": f"WITH {VERSIONS} SELECT owner, version_id, status, cents FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY revision_no DESC) AS k FROM versions) x WHERE k = 1",
    "v18_idempotency": "WITH seen AS (SELECT o_custkey AS k, o_orderpriority AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT b.k, CASE WHEN a.h = b.h THEN 'replay' ELSE 'conflict' END AS answer, count(*) AS n FROM seen a JOIN seen b ON a.k = b.k AND a.r = 1 AND b.r > 1 GROUP BY b.k, CASE WHEN a.h = b.h THEN 'replay' ELSE 'conflict' END",
    "v17_history_page": f"WITH {VERSIONS} SELECT version_id, owner, revision_no, recorded FROM versions ORDER BY recorded DESC, version_id DESC LIMIT 21",
    "v20_create_or_verify": "SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'create' ELSE 'verify' END AS action FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey",
    # more of the inventory
    "p17_row_comparison": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (CAST(50 AS BIGINT), CAST(1000 AS BIGINT))",
    "p21_subgroup_state": f"WITH {SUPPLIERS} SELECT state, count(*) AS n FROM (SELECT CASE WHEN metric IS NULL THEN 'unknown' WHEN metric > 50 THEN 'present' ELSE 'reference' END AS state FROM base) x GROUP BY state",
    "p23_tukey_flags": f"WITH {SUPPLIERS}, q AS (SELECT PCTL(metric, 0.25) AS q1, PCTL(metric, 0.75) AS q3 FROM base) SELECT user_id, CASE WHEN record_count >= 3 THEN metric > q3 + 1.5 * (q3 - q1) END AS high FROM base CROSS JOIN q",
    "j20_missing_by_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "j05_one_to_one": "SELECT count(*) AS violations FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) x",
    "j07_aligned_lookup": "SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "w06_running_share": "WITH s AS (SELECT c_mktsegment, c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer WHERE c_acctbal > 0) SELECT c_custkey, round(CAST(sum(v) OVER (PARTITION BY c_mktsegment ORDER BY v DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY c_mktsegment) AS DOUBLE), 9) AS share FROM s",
    "w11_lag_chain": f"WITH {VERSIONS} SELECT owner, version_id, supersedes FROM versions WHERE revision_no > 1",
    "a32_paired_effects": f"WITH {LINES} SELECT category, count(*) AS n, {n('greatest(1, floor(quantity / 10)) < quantity')} AS decreased, CASE WHEN count(*) >= 10 THEN {n('quantity * 3 > 100')} END AS large_after FROM lines GROUP BY GROUPING SETS ((category), ())",
    "a48_skewness": "WITH m AS (SELECT avg(c_acctbal) AS m, count(*) AS n, stddev_pop(c_acctbal) AS s FROM customer) SELECT round(sum(power((c_acctbal - m) / s, 3)) / max(n) * sqrt(CAST(max(n) AS DOUBLE) * (max(n) - 1)) / (max(n) - 2), 6) + 0 AS skew FROM customer CROSS JOIN m",
    "a51_fold_deltas": f"WITH {EVALUATED}, f AS (SELECT mod(doc_id, 5) AS fold, avg(CASE WHEN y = p THEN 1.0E0 ELSE 0.0E0 END) AS a, avg(CASE WHEN y = 0 THEN 1.0E0 ELSE 0.0E0 END) AS b FROM evaluated GROUP BY mod(doc_id, 5)) SELECT round(avg(a - b), 9) AS mean_delta, round(stddev_samp(a - b), 9) AS std_delta, round(min(a - b), 9) AS low, round(max(a - b), 9) AS high FROM f",
    "a53_nine_points": "SELECT " + ", ".join(f"round(PCTL(o_totalprice, {q}), 4) AS q{k}" for k, q in enumerate((0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1))) + " FROM orders",
    "a55_boundary_ties": f"WITH {EVALUATED}, r AS (SELECT quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS k FROM evaluated), b AS (SELECT min(quality) AS q FROM r WHERE k <= 30) SELECT {n('quality = q')} AS tied, {n('quality = q AND k <= 30')} AS tied_selected FROM r CROSS JOIN b",
    "t08_stratified_sample": f"WITH {LINES} SELECT item, po_id, part_id FROM (SELECT item, po_id, part_id, row_number() OVER (PARTITION BY item ORDER BY HEX256('9:' || po_id || ':' || CAST(part_id AS STRING)), supplier_id, day) AS k FROM lines) x WHERE k <= 5",
    "t09_bootstrap": f"WITH {EVALUATED}, b AS (SELECT explode_b AS b FROM (SELECT {{BOOT}} AS explode_b) y), w AS (SELECT b, y, p, CASE WHEN u < 3679 THEN 0 WHEN u < 7358 THEN 1 WHEN u < 9197 THEN 2 WHEN u < 9810 THEN 3 ELSE 4 END AS k FROM (SELECT b.b, y, p, mod(doc_id * 7919 + b.b * 104729 + doc_id * b.b * 31, 10007) AS u FROM evaluated CROSS JOIN b) z), s AS (SELECT b, sum(CASE WHEN y = p THEN k ELSE 0 END) * 1.0E0 / sum(k) AS acc FROM w GROUP BY b) SELECT count(*) AS draws, round(PCTL(acc, 0.025), 9) AS low, round(PCTL(acc, 0.975), 9) AS high FROM s",
    "t10_permutation": f"WITH {EVALUATED}, a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM evaluated), b AS (SELECT y, row_number() OVER (ORDER BY HEX256('p:' || CAST(doc_id AS STRING)), doc_id) AS i FROM evaluated) SELECT a.doc_id, b.y FROM a JOIN b ON a.i = b.i",
    "u03_union_all": "SELECT side, count(*) AS n FROM (SELECT 'customer' AS side, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) x GROUP BY side",
    "f13_strings": "SELECT s_suppkey, lower(s_name) AS name, lpad(CAST(s_suppkey AS STRING), 6, '0') AS padded FROM supplier",
    "f36_price_text": "SELECT DISTINCT CAST(regexp_extract(t, '^([0-9]+)', 1) AS BIGINT) * 100 + CAST(rpad(regexp_extract(t, '[.]([0-9]+)$', 1), 2, '0') AS BIGINT) AS cents FROM (SELECT CAST(CAST(l_quantity AS DECIMAL(9,2)) AS STRING) AS t FROM lineitem) x",
    # streaming twins in batch form
    "x_tumbling_day": "SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY CAST(ts AS DATE), event_type",
}
#: The one expression that has no common form: a row per day.
SPINE = ("explode(sequence(a, date_add(a, CAST(k AS INT)), interval 1 day))", "unnest(generate_series(a, a + CAST(k AS INT), interval 1 day))")
BOOT = ("explode(sequence(CAST(1 AS BIGINT), CAST(200 AS BIGINT)))", "unnest(generate_series(CAST(1 AS BIGINT), CAST(200 AS BIGINT)))")
