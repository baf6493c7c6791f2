"""Oracle SQL: metrics, verdicts, distributions, summaries."""

from oracle.sql_traces import MASTER

A, P = "actual_wh", "predicted_wh"


def metric_aggs(a: str = A, p: str = P) -> str:
    return (f"count(*) AS n, sum(({a} - {p}) * ({a} - {p})) AS _sse, var_pop({a}) * count({a}) AS _sst, "
            f"avg(abs({a} - {p})) AS mae, sqrt(avg(({a} - {p}) * ({a} - {p}))) AS rmse, "
            f"avg(abs({a} - {p}) / greatest({a}, 1e-9)) * 100.0e0 AS mape, "
            f"avg(greatest(0.0e0, 100.0e0 - abs({a} - {p}) / greatest({a}, 1e-9) * 100.0e0)) AS accuracy")


def metric_finish(digits: int = 9) -> str:
    n = "coalesce(n, 0)"
    r2 = (f"CASE WHEN {n} < 2 THEN 0.0e0 WHEN _sst = 0 THEN CASE WHEN _sse = 0 THEN 1.0e0 ELSE 0.0e0 END "
          f"ELSE 1.0e0 - _sse / _sst END")
    return (f"round(coalesce({r2}, 0.0e0), {digits}) AS r2, round(coalesce(mae, 0.0e0), {digits}) AS mae, "
            f"round(coalesce(rmse, 0.0e0), {digits}) AS rmse, round(coalesce(mape, 0.0e0), {digits}) AS mape, "
            f"round(coalesce(accuracy, 0.0e0), {digits}) AS accuracy, CAST({n} AS BIGINT) AS n")


def overall(src: str) -> str:
    return f"SELECT {metric_finish()} FROM (SELECT {metric_aggs()} FROM {src})"


def by_category(src: str, key_expr: str, cats: list, name: str, others: bool = True, keep_empty: bool = True) -> str:
    lits = ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in cats)
    key = f"CASE WHEN {key_expr} IN ({lits}) THEN {key_expr} ELSE 'others' END" if others else key_expr
    where = f"WHERE {name} IS NOT NULL" + ("" if others else f" AND {name} IN ({lits})")
    allc = list(cats) + (["others"] if others else [])
    values = ", ".join(f"('{c}')" if isinstance(c, str) else f"({c})" for c in allc)
    agg = f"(SELECT {name}, {metric_aggs()} FROM (SELECT {key} AS {name}, {A}, {P} FROM {src}) r {where} GROUP BY {name})"
    if keep_empty:
        return f"SELECT d.{name} AS {name}, {metric_finish()} FROM (VALUES {values}) d({name}) LEFT JOIN {agg} g ON d.{name} = g.{name}"
    return f"SELECT {name}, {metric_finish()} FROM {agg} g"


RUNTIME_CAT = """CASE WHEN lower(trim(runtime)) LIKE '%python%' THEN 'python' WHEN lower(trim(runtime)) LIKE '%node%' THEN 'nodejs'
  WHEN lower(trim(runtime)) LIKE '%java%' THEN 'java' WHEN lower(trim(runtime)) LIKE '%php%' THEN 'php' ELSE 'others' END"""

BUCKET = """CASE WHEN latency_ms * quantity / 1000.0e0 >= 0 AND latency_ms * quantity / 1000.0e0 < 1 THEN '<1s'
  WHEN latency_ms * quantity / 1000.0e0 >= 1 AND latency_ms * quantity / 1000.0e0 < 10 THEN '1-10s'
  WHEN latency_ms * quantity / 1000.0e0 >= 10 AND latency_ms * quantity / 1000.0e0 < 30 THEN '10-30s'
  WHEN latency_ms * quantity / 1000.0e0 >= 30 AND latency_ms * quantity / 1000.0e0 < 67 THEN '30-67s'
  WHEN latency_ms * quantity / 1000.0e0 >= 67 THEN '>67s' END"""

AZURE = f"""{MASTER},
azure AS (SELECT hash_function, trigger_type, (10.0e0 + 0.2e0 * memory_allocated_mb) * avg_duration_ms / 3600000.0e0 AS actual_wh,
  (10.0e0 + 0.2e0 * memory_allocated_mb) * p50_duration_ms / 3600000.0e0 AS predicted_wh FROM master)"""

ALIBABA = """alibaba_f AS (SELECT function_name, avg(latency_ms) AS avg_duration_ms, median(latency_ms) AS p50_duration_ms,
  avg(memory_mb) AS memory_allocated_mb, count(*) AS invocation_count FROM v_inv WHERE latency_ms > 0 AND memory_mb > 0
  GROUP BY function_name HAVING count(*) >= 10 AND avg(memory_mb) <= 3072 AND avg(latency_ms) <= 300000),
alibaba AS (SELECT function_name, (10.0e0 + 0.2e0 * memory_allocated_mb) * avg_duration_ms / 3600000.0e0 AS actual_wh,
  (10.0e0 + 0.2e0 * memory_allocated_mb) * p50_duration_ms / 3600000.0e0 AS predicted_wh FROM alibaba_f)"""

APE = "abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0"

SQL = {
    "agg_regression_metrics": overall("v_pred"),
    "agg_metrics_by_trigger": by_category("v_pred", "trigger_type", ["http", "timer", "queue", "storage"], "trigger_type"),
    "agg_metrics_by_runtime": by_category("v_pred", RUNTIME_CAT, ["python", "nodejs", "java", "php"], "runtime_category"),
    "agg_metrics_by_tier": by_category("v_pred", "memory_mb", [128, 256, 512, 1024, 2048, 3000], "memory_tier", others=False),
    "agg_metrics_by_bucket": by_category("v_pred", BUCKET, ["<1s", "1-10s", "10-30s", "30-67s", ">67s"], "duration_bucket",
                                         others=False, keep_empty=False),
    "agg_transfer_verdict": f"""WITH {AZURE}, m AS ({overall('azure')})
SELECT *, CASE WHEN r2 >= 0.95 THEN 'STRONG' WHEN r2 >= 0.85 THEN 'MODERATE' WHEN r2 >= 0.70 THEN 'LIMITED' ELSE 'WEAK' END AS verdict FROM m""",
    "agg_platform_compare": f"""WITH {AZURE}, {ALIBABA},
u AS (SELECT 'aws' AS platform, * FROM ({overall('v_pred')}) UNION ALL SELECT 'azure', * FROM ({overall('azure')})
  UNION ALL SELECT 'alibaba', * FROM ({overall('alibaba')})),
l AS (UNPIVOT (SELECT platform, r2, mae, rmse, mape, accuracy FROM u) ON r2, mae, rmse, mape, accuracy INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (WHERE platform = 'aws') AS aws, max(value) FILTER (WHERE platform = 'azure') AS azure,
  max(value) FILTER (WHERE platform = 'alibaba') AS alibaba FROM l GROUP BY metric""",
    "agg_ape_distribution": f"""SELECT round(avg(CASE WHEN {APE} <= 5 THEN 1.0 ELSE 0.0 END) * 100.0e0, 9) AS pct_le_5,
  round(avg(CASE WHEN {APE} <= 15 THEN 1.0 ELSE 0.0 END) * 100.0e0, 9) AS pct_le_15,
  round(avg(CASE WHEN {APE} <= 30 THEN 1.0 ELSE 0.0 END) * 100.0e0, 9) AS pct_le_30,
  round(avg(CASE WHEN {APE} > 30 THEN 1.0 ELSE 0.0 END) * 100.0e0, 9) AS pct_gt_30 FROM v_pred""",
    "agg_histogram": f"""SELECT CAST(least(floor((greatest({APE}, 0.0e0) - 0.0e0) / 1.0e0), 49) AS INT) AS bin, count(*) AS n
FROM v_pred GROUP BY 1""",
    "agg_histogram_equal": """WITH b AS (SELECT min(actual_wh) AS lo, max(actual_wh) AS hi FROM v_pred)
SELECT CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0 ELSE least(floor((actual_wh - lo) / ((hi - lo) / 10)), 9) END AS INT) AS bin,
  count(*) AS n, first(lo) AS lo, first(hi) AS hi FROM v_pred, b GROUP BY 1""",
    "agg_box_stats": """WITH q AS (SELECT memory_mb, cold_start, quantile_cont(actual_wh, 0.25) AS q1, median(actual_wh) AS median,
  quantile_cont(actual_wh, 0.75) AS q3 FROM v_pred GROUP BY memory_mb, cold_start),
j AS (SELECT v.memory_mb, v.cold_start, v.actual_wh AS x, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr FROM v_pred v JOIN q USING (memory_mb, cold_start))
SELECT memory_mb, cold_start, round(first(q1), 9) AS q1, round(first(median), 9) AS median, round(first(q3), 9) AS q3,
  min(x) FILTER (WHERE x >= q1 - 1.5 * iqr AND x <= q3 + 1.5 * iqr) AS whisker_low,
  max(x) FILTER (WHERE x >= q1 - 1.5 * iqr AND x <= q3 + 1.5 * iqr) AS whisker_high,
  count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * iqr AND x <= q3 + 1.5 * iqr)) AS outliers, count(*) AS n
FROM j GROUP BY memory_mb, cold_start""",
    "agg_correlation": """WITH c AS (UNPIVOT (SELECT corr(memory_mb, actual_wh) AS memory_mb, corr(latency_ms, actual_wh) AS latency_ms,
  corr(cold_start, actual_wh) AS cold_start, corr(quantity, actual_wh) AS quantity, corr(discount, actual_wh) AS discount,
  corr(tax, actual_wh) AS tax FROM v_pred) ON memory_mb, latency_ms, cold_start, quantity, discount, tax INTO NAME feature VALUE corr)
SELECT feature, round(corr, 9) AS corr, CAST(row_number() OVER (ORDER BY corr DESC, feature) AS INTEGER) AS rank_desc,
  CAST(row_number() OVER (ORDER BY corr ASC, feature) AS INTEGER) AS rank_asc FROM c""",
    "agg_describe": """WITH v AS (SELECT CASE WHEN day <= 1995 THEN 'old' ELSE 'new' END AS dataset, latency_ms, CAST(memory_mb AS DOUBLE) AS memory_mb, actual_wh FROM v_pred),
l AS (UNPIVOT v ON latency_ms, memory_mb, actual_wh INTO NAME "column" VALUE value)
SELECT dataset, "column", count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean,
  round(stddev_samp(value), 9) AS std, round(median(value), 9) AS median FROM l GROUP BY dataset, "column\"""",
    "agg_flag_share": """SELECT runtime, round(avg(cold_start) * 100.0e0, 9) AS cold_start_pct, count(*) AS n FROM v_inv GROUP BY runtime""",
    "agg_cost_total": """WITH t AS (SELECT runtime, sum((memory_mb / 1024) * (latency_ms / 1000)) AS gb, count(*) AS requests FROM v_inv GROUP BY runtime)
SELECT runtime, requests, round(gb, 6) AS gb_seconds, round(gb * 0.0000166667e0, 6) AS compute_usd,
  round(requests * (0.20e0 / 1000000), 6) AS request_usd, round(gb * 0.0000166667e0 + requests * (0.20e0 / 1000000), 6) AS total_usd FROM t""",
    "agg_pivot_distinct": """SELECT trigger_type, """ + ", ".join(
        f"count(DISTINCT function_name) FILTER (WHERE memory_mb = {t}) AS \"{t}\"" for t in (128, 256, 512, 1024, 2048, 3000))
    + " FROM v_inv GROUP BY trigger_type",
    "agg_argmax_row": """SELECT inv_id, function_name, predicted_wh FROM v_pred ORDER BY predicted_wh DESC, inv_id DESC LIMIT 1""",
    "agg_scatter_points": """WITH pts AS (SELECT inv_id, actual_wh, predicted_wh FROM v_pred ORDER BY md5(CAST(inv_id AS VARCHAR) || '|42'), inv_id LIMIT 60),
m AS (SELECT count(*) AS n, sum((actual_wh - predicted_wh) ^ 2) AS sse, var_pop(actual_wh) * count(*) AS sst,
  avg(abs(actual_wh - predicted_wh)) AS mae FROM pts)
SELECT pts.*, round(CASE WHEN n < 2 THEN 0.0 WHEN sst = 0 THEN 0.0 ELSE 1 - sse / sst END, 4) AS r2, round(mae, 4) AS mae FROM pts, m""",
    "agg_correlation_matrix": 'WITH c AS (SELECT corr(memory_mb, latency_ms) AS "memory_mb__latency_ms", corr(memory_mb, cold_start) AS "memory_mb__cold_start", corr(memory_mb, quantity) AS "memory_mb__quantity", corr(memory_mb, discount) AS "memory_mb__discount", corr(memory_mb, tax) AS "memory_mb__tax", corr(memory_mb, actual_wh) AS "memory_mb__actual_wh", corr(latency_ms, cold_start) AS "latency_ms__cold_start", corr(latency_ms, quantity) AS "latency_ms__quantity", corr(latency_ms, discount) AS "latency_ms__discount", corr(latency_ms, tax) AS "latency_ms__tax", corr(latency_ms, actual_wh) AS "latency_ms__actual_wh", corr(cold_start, quantity) AS "cold_start__quantity", corr(cold_start, discount) AS "cold_start__discount", corr(cold_start, tax) AS "cold_start__tax", corr(cold_start, actual_wh) AS "cold_start__actual_wh", corr(quantity, discount) AS "quantity__discount", corr(quantity, tax) AS "quantity__tax", corr(quantity, actual_wh) AS "quantity__actual_wh", corr(discount, tax) AS "discount__tax", corr(discount, actual_wh) AS "discount__actual_wh", corr(tax, actual_wh) AS "tax__actual_wh" FROM v_pred) SELECT \'memory_mb\' AS a, \'latency_ms\' AS b, round("memory_mb__latency_ms", 9) AS corr FROM c UNION ALL SELECT \'latency_ms\', \'memory_mb\', round("memory_mb__latency_ms", 9) FROM c UNION ALL SELECT \'memory_mb\' AS a, \'cold_start\' AS b, round("memory_mb__cold_start", 9) AS corr FROM c UNION ALL SELECT \'cold_start\', \'memory_mb\', round("memory_mb__cold_start", 9) FROM c UNION ALL SELECT \'memory_mb\' AS a, \'quantity\' AS b, round("memory_mb__quantity", 9) AS corr FROM c UNION ALL SELECT \'quantity\', \'memory_mb\', round("memory_mb__quantity", 9) FROM c UNION ALL SELECT \'memory_mb\' AS a, \'discount\' AS b, round("memory_mb__discount", 9) AS corr FROM c UNION ALL SELECT \'discount\', \'memory_mb\', round("memory_mb__discount", 9) FROM c UNION ALL SELECT \'memory_mb\' AS a, \'tax\' AS b, round("memory_mb__tax", 9) AS corr FROM c UNION ALL SELECT \'tax\', \'memory_mb\', round("memory_mb__tax", 9) FROM c UNION ALL SELECT \'memory_mb\' AS a, \'actual_wh\' AS b, round("memory_mb__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'memory_mb\', round("memory_mb__actual_wh", 9) FROM c UNION ALL SELECT \'latency_ms\' AS a, \'cold_start\' AS b, round("latency_ms__cold_start", 9) AS corr FROM c UNION ALL SELECT \'cold_start\', \'latency_ms\', round("latency_ms__cold_start", 9) FROM c UNION ALL SELECT \'latency_ms\' AS a, \'quantity\' AS b, round("latency_ms__quantity", 9) AS corr FROM c UNION ALL SELECT \'quantity\', \'latency_ms\', round("latency_ms__quantity", 9) FROM c UNION ALL SELECT \'latency_ms\' AS a, \'discount\' AS b, round("latency_ms__discount", 9) AS corr FROM c UNION ALL SELECT \'discount\', \'latency_ms\', round("latency_ms__discount", 9) FROM c UNION ALL SELECT \'latency_ms\' AS a, \'tax\' AS b, round("latency_ms__tax", 9) AS corr FROM c UNION ALL SELECT \'tax\', \'latency_ms\', round("latency_ms__tax", 9) FROM c UNION ALL SELECT \'latency_ms\' AS a, \'actual_wh\' AS b, round("latency_ms__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'latency_ms\', round("latency_ms__actual_wh", 9) FROM c UNION ALL SELECT \'cold_start\' AS a, \'quantity\' AS b, round("cold_start__quantity", 9) AS corr FROM c UNION ALL SELECT \'quantity\', \'cold_start\', round("cold_start__quantity", 9) FROM c UNION ALL SELECT \'cold_start\' AS a, \'discount\' AS b, round("cold_start__discount", 9) AS corr FROM c UNION ALL SELECT \'discount\', \'cold_start\', round("cold_start__discount", 9) FROM c UNION ALL SELECT \'cold_start\' AS a, \'tax\' AS b, round("cold_start__tax", 9) AS corr FROM c UNION ALL SELECT \'tax\', \'cold_start\', round("cold_start__tax", 9) FROM c UNION ALL SELECT \'cold_start\' AS a, \'actual_wh\' AS b, round("cold_start__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'cold_start\', round("cold_start__actual_wh", 9) FROM c UNION ALL SELECT \'quantity\' AS a, \'discount\' AS b, round("quantity__discount", 9) AS corr FROM c UNION ALL SELECT \'discount\', \'quantity\', round("quantity__discount", 9) FROM c UNION ALL SELECT \'quantity\' AS a, \'tax\' AS b, round("quantity__tax", 9) AS corr FROM c UNION ALL SELECT \'tax\', \'quantity\', round("quantity__tax", 9) FROM c UNION ALL SELECT \'quantity\' AS a, \'actual_wh\' AS b, round("quantity__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'quantity\', round("quantity__actual_wh", 9) FROM c UNION ALL SELECT \'discount\' AS a, \'tax\' AS b, round("discount__tax", 9) AS corr FROM c UNION ALL SELECT \'tax\', \'discount\', round("discount__tax", 9) FROM c UNION ALL SELECT \'discount\' AS a, \'actual_wh\' AS b, round("discount__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'discount\', round("discount__actual_wh", 9) FROM c UNION ALL SELECT \'tax\' AS a, \'actual_wh\' AS b, round("tax__actual_wh", 9) AS corr FROM c UNION ALL SELECT \'actual_wh\', \'tax\', round("tax__actual_wh", 9) FROM c UNION ALL SELECT \'memory_mb\', \'memory_mb\', 1.0e0 FROM c UNION ALL SELECT \'latency_ms\', \'latency_ms\', 1.0e0 FROM c UNION ALL SELECT \'cold_start\', \'cold_start\', 1.0e0 FROM c UNION ALL SELECT \'quantity\', \'quantity\', 1.0e0 FROM c UNION ALL SELECT \'discount\', \'discount\', 1.0e0 FROM c UNION ALL SELECT \'tax\', \'tax\', 1.0e0 FROM c UNION ALL SELECT \'actual_wh\', \'actual_wh\', 1.0e0 FROM c',
    "sink_detail_csv": f"""WITH {AZURE.replace("FROM master)", "FROM master), az AS (SELECT m.hash_function, m.trigger_type, m.avg_duration_ms, m.memory_allocated_mb, m.invocation_count, a.actual_wh, a.predicted_wh FROM master m JOIN azure a USING (hash_function))")}
SELECT hash_function, trigger_type, round(avg_duration_ms, 9) AS avg_duration_ms, round(memory_allocated_mb, 9) AS memory_allocated_mb,
  invocation_count, round(actual_wh, 9) AS actual_wh, round(predicted_wh, 9) AS predicted_wh,
  round(abs(actual_wh - predicted_wh), 9) AS absolute_error_wh,
  round(abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0, 9) AS percentage_error,
  round(greatest(0.0e0, 100.0e0 - abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0), 9) AS accuracy_pct FROM az""",
    "sink_summary_json": f"""WITH {AZURE}, o AS ({overall('azure')})
SELECT round(r2, 6) AS r2_score, round(mae, 6) AS mae_wh, round(rmse, 6) AS rmse_wh, round(mape, 6) AS mape_pct, round(accuracy, 6) AS mean_accuracy_pct,
  n AS sample_size, CASE WHEN r2 >= 0.95 THEN 'STRONG' WHEN r2 >= 0.85 THEN 'MODERATE' WHEN r2 >= 0.70 THEN 'LIMITED' ELSE 'WEAK' END AS generalizability_verdict FROM o""",
    "src_json_summary": f"""WITH {AZURE}, o AS ({overall('azure')}),
b AS ({by_category('azure', 'trigger_type', ['http', 'timer', 'queue', 'storage'], 'trigger_type')})
SELECT CASE WHEN o.r2 >= 0.95 THEN 'STRONG' WHEN o.r2 >= 0.85 THEN 'MODERATE' WHEN o.r2 >= 0.70 THEN 'LIMITED' ELSE 'WEAK' END
  AS generalizability_verdict, b.trigger_type, b.r2, b.mae, b.rmse, b.mape, b.accuracy, b.n FROM b, o""",
}
