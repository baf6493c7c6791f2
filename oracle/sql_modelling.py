"""Oracle SQL: feature engineering (one-hot, scaling, split, cross-platform
features, broadcast means)."""

from oracle.sql_profiles import SOURCE_METRICS, TELEMETRY
from oracle.sql_traces import MASTER
from wattline.functions.labels import FEATURE_ORDER

_MEANS = ("cold_start", "lines_of_code", "num_loops", "num_conditionals", "num_function_calls",
          "cyclomatic_complexity", "max_nesting_depth", "local_cpu_percent", "memory_efficiency")
_SCALE = ["memory_config_mb", "aws_duration_ms", "local_cpu_percent", "lines_of_code"]

_MEANS_CTE = ("means AS (SELECT " + ", ".join(f"avg({c}) AS mean_{c}" for c in _MEANS)
              + ", avg(CASE WHEN function_type = 'io' THEN 1.0e0 ELSE 0.0e0 END) AS share_io"
              + ", avg(CASE WHEN function_type = 'memory' THEN 1.0e0 ELSE 0.0e0 END) AS share_memory FROM telemetry)")

_U = "CAST(('0x' || substr(md5(CAST(inv_id AS VARCHAR) || '|42'), 1, 12)) AS BIGINT) / 281474976710656.0e0"

_XP = {"memory_config_mb": "memory_allocated_mb", "local_duration_ms": "avg_duration_ms",
       "local_memory_mb": "memory_allocated_mb", "aws_duration_ms": "avg_duration_ms",
       "aws_memory_used_mb": "memory_allocated_mb", "duration_ratio": "1.0e0",
       "function_type_io": "CAST(lower(trigger_type) IN ('queue', 'event') AS DOUBLE)",
       "function_type_memory": "CAST(lower(trigger_type) = 'storage' AS DOUBLE)"}
_XP.update({c: f"mean_{c}" for c in _MEANS})

SQL = {
    "src_code_bundle": "SELECT source AS bundle, length(text) AS n_chars, md5(text) AS content_md5 FROM documents",
    "ml_code_metrics": f"""SELECT bundle, path, loc, num_loops, num_conditionals, num_function_calls, max_nesting_depth, CAST(cc_sum AS BIGINT) AS cc_sum,
  CAST(cc_blocks AS BIGINT) AS cc_blocks, parsed FROM ({SOURCE_METRICS})""",
    "agg_code_bundle": f"""SELECT bundle, CAST(greatest(1, sum(loc)) AS BIGINT) AS lines_of_code, CAST(sum(num_loops) AS BIGINT) AS num_loops,
  CAST(sum(num_conditionals) AS BIGINT) AS num_conditionals, CAST(sum(num_function_calls) AS BIGINT) AS num_function_calls, max(max_nesting_depth) AS max_nesting_depth,
  CASE WHEN sum(cc_blocks) > 0 THEN CAST(sum(cc_sum) AS DOUBLE) / CAST(sum(cc_blocks) AS DOUBLE) ELSE 1.0e0 END AS cyclomatic_complexity,
  count(*) AS files FROM ({SOURCE_METRICS}) GROUP BY bundle""",
    "ml_one_hot": f"""WITH {TELEMETRY}
SELECT inv_id, CASE WHEN function_type = 'io' THEN 1.0e0 ELSE 0.0e0 END AS function_type_io,
  CASE WHEN function_type = 'memory' THEN 1.0e0 ELSE 0.0e0 END AS function_type_memory,
  CASE WHEN input_size = 'Medium' THEN 1.0e0 ELSE 0.0e0 END AS "input_size_Medium",
  CASE WHEN input_size = 'Small' THEN 1.0e0 ELSE 0.0e0 END AS "input_size_Small" FROM telemetry""",
    "ml_scale": f"WITH {TELEMETRY} SELECT inv_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END, 6) AS {c}_scaled"
        for c in _SCALE) + " FROM telemetry",
    "ml_split": f"""WITH {TELEMETRY}, u AS (SELECT inv_id, {_U} AS u FROM telemetry)
SELECT inv_id, CASE WHEN u < 0.64 THEN 'train' WHEN u < 0.8 THEN 'validation' WHEN u < 1.0 THEN 'test' ELSE 'test' END AS split FROM u""",
    "join_broadcast_means": f"""WITH {TELEMETRY}, {MASTER}, {_MEANS_CTE}
SELECT hash_function, trigger_type, """ + ", ".join(f"round(mean_{c}, 9) AS mean_{c}" for c in _MEANS)
    + ", round(share_io, 9) AS share_io, round(share_memory, 9) AS share_memory FROM master, means",
    "ml_cross_platform_features": f"""WITH {TELEMETRY}, {MASTER}, {_MEANS_CTE}
SELECT hash_function, """ + ", ".join(f"round(CAST({_XP.get(f, '0.0e0')} AS DOUBLE), 9) AS \"{f}\"" for f in FEATURE_ORDER)
    + " FROM master, means",
    "join_predictions_back": f"""WITH p AS (SELECT inv_id, predicted_wh, {_U} AS u FROM v_pred)
SELECT p.inv_id, p.predicted_wh, i.function_name, i.trigger_type, i.memory_mb, i.latency_ms
FROM p JOIN v_inv i ON p.inv_id = i.inv_id WHERE p.u >= 0.8""",
    "ml_split_stratified": f"""WITH {TELEMETRY}, u AS (SELECT inv_id, function_type, {_U} AS u FROM telemetry),
t AS (SELECT function_type, quantile_cont(u, 0.64) AS t0, quantile_cont(u, 0.8) AS t1 FROM u WHERE function_type IS NOT NULL GROUP BY function_type)
SELECT inv_id, u.function_type, CASE WHEN u <= coalesce(t0, 0.64) THEN 'train' WHEN u <= coalesce(t1, 0.8) THEN 'validation'
  ELSE 'test' END AS split FROM u LEFT JOIN t ON u.function_type = t.function_type""",
}
