"""Oracle SQL: telemetry, profiles, lookups, overrides, roll-ups."""

from wattline.operators.profiles import TELEMETRY_NUMERIC

# The metrics of the source that is written from a document's row (v_source):
# one loop and more, nested, so as many levels deep; a call per loop, one of the
# data's length and some more; a block per function, with its decisions.  What
# does not parse has only its lines.
SOURCE_METRICS = """SELECT doc_id, source AS bundle, CAST(doc_id AS VARCHAR) AS path,
  CAST(6 + l + 2 * i + c + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS loc,
  CASE WHEN ok THEN l ELSE 0 END AS num_loops, CASE WHEN ok THEN i ELSE 0 END AS num_conditionals, CASE WHEN ok THEN 1 + l + c ELSE 0 END AS num_function_calls,
  CASE WHEN ok THEN l ELSE 0 END AS max_nesting_depth, CASE WHEN ok THEN 1 + l + i + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END ELSE 0 END AS cc_sum,
  CASE WHEN ok THEN 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END AS cc_blocks, ok AS parsed
  FROM (SELECT *, CAST(1 + doc_id % 4 AS BIGINT) AS l, CAST(length(coalesce(text, '')) % 5 AS BIGINT) AS i, CAST(doc_id % 7 AS BIGINT) AS c, doc_id % 11 <> 0 AS ok FROM documents)"""

TELEMETRY = f"""code AS (SELECT 'fn-' || path AS function_name, CAST(loc AS DOUBLE) AS lines_of_code,
  CAST(num_loops AS DOUBLE) AS num_loops, CAST(num_conditionals AS DOUBLE) AS num_conditionals, CAST(num_function_calls AS DOUBLE) AS num_function_calls,
  CASE WHEN cc_blocks > 0 THEN CAST(cc_sum AS DOUBLE) / cc_blocks ELSE 1.0e0 END AS cyclomatic_complexity, CAST(max_nesting_depth AS DOUBLE) AS max_nesting_depth
  FROM ({SOURCE_METRICS})),
tj AS (SELECT i.inv_id, i.function_name, i.trigger_type, i.quantity, i.tax, i.discount, i.cold_start, i.latency_ms,
  CAST(i.memory_mb AS DOUBLE) AS mem, greatest(i.latency_ms, 1.0e0) AS dur,
  coalesce(c.lines_of_code, 20.0e0) AS lines_of_code, coalesce(c.num_loops, 2.0e0) AS num_loops,
  coalesce(c.num_conditionals, 1.0e0) AS num_conditionals, coalesce(c.num_function_calls, 5.0e0) AS num_function_calls,
  coalesce(c.cyclomatic_complexity, 2.0e0) AS cyclomatic_complexity, coalesce(c.max_nesting_depth, 2.0e0) AS max_nesting_depth
  FROM v_inv i LEFT JOIN code c ON i.function_name = c.function_name),
tk AS (SELECT *, greatest(1.0e0, dur * 0.9e0) AS ld, greatest(30.0e0, mem * 0.8e0) AS lm FROM tj),
telemetry AS (SELECT inv_id, function_name,
  CASE WHEN lower(trigger_type) IN ('queue', 'event') THEN 'io' WHEN lower(trigger_type) = 'storage' THEN 'memory' ELSE 'cpu' END AS function_type,
  CASE WHEN quantity < 17 THEN 'Small' WHEN quantity < 34 THEN 'Medium' ELSE 'Large' END AS input_size,
  mem AS memory_config_mb, CAST(cold_start AS INT) AS cold_start, lines_of_code, num_loops, num_conditionals,
  num_function_calls, cyclomatic_complexity, max_nesting_depth, ld AS local_duration_ms,
  15.0e0 + (tax - 0.04e0) * 50.0e0 AS local_cpu_percent, lm AS local_memory_mb,
  (10.0e0 + 0.2e0 * lm) * (ld / 3600000.0e0) AS local_energy_wh, latency_ms AS aws_duration_ms,
  mem * (0.5e0 + discount * 5.0e0) AS aws_memory_used_mb, CAST(cold_start AS DOUBLE) AS aws_cold_start,
  (10.0e0 + 0.2e0 * mem) * latency_ms / 3600000.0e0 AS aws_energy_estimate_wh,
  dur / ld AS duration_ratio, lm / mem AS memory_efficiency,
  (10.0e0 + 0.2e0 * mem) * (dur / 3600000.0e0) AS energy_target_wh,
  ((10.0e0 + 0.2e0 * mem) * (dur / 3600000.0e0)) / ((10.0e0 + 0.2e0 * lm) * (ld / 3600000.0e0)) AS calibration_ratio
  FROM tk)"""


def _mode(src: str, col: str, key: str | None = "function_name") -> str:
    if key:
        return (f"(SELECT {key}, min(v) AS {col} FROM (SELECT {key}, v, rank() OVER (PARTITION BY {key} ORDER BY n DESC) AS rk "
                f"FROM (SELECT {key}, {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {key}, {col})) "
                f"WHERE rk = 1 GROUP BY {key})")
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


FB_NUM = ["memory_config_mb", "aws_duration_ms", "lines_of_code", "cyclomatic_complexity", "local_cpu_percent"]

PROFILE = f"""{TELEMETRY},
pmeans AS (SELECT function_name, {", ".join(f"avg({c}) AS {c}" for c in TELEMETRY_NUMERIC)} FROM telemetry GROUP BY function_name),
prof AS (SELECT * FROM pmeans JOIN {_mode('telemetry', 'function_type')} USING (function_name)
  JOIN {_mode('telemetry', 'input_size')} USING (function_name)),
fb AS (SELECT {", ".join(f"median({c}) AS {c}" for c in FB_NUM)},
  (SELECT function_type FROM {_mode('prof', 'function_type', None)}) AS function_type,
  (SELECT input_size FROM {_mode('prof', 'input_size', None)}) AS input_size FROM prof)"""

_R9 = lambda c: f"round({c}, 9) AS {c}"

LIVE_POINTS = """live AS (SELECT l.function_name, l.ts, l.duration_ms, l.user_id, CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS is_error
  FROM v_live l JOIN events e ON l.event_id = e.event_id),
g AS (SELECT function_name, date_trunc('hour', ts) AS ts, avg(duration_ms) AS _dur, max(user_id * 10.0e0) AS _mem,
  CAST(count(*) AS DOUBLE) AS _inv, CAST(sum(is_error) AS DOUBLE) AS _err FROM live GROUP BY function_name, date_trunc('hour', ts)),
pts AS (SELECT function_name, ts, 'Duration' AS metric, _dur AS average, _dur AS maximum, _dur AS sum FROM g
  UNION ALL SELECT function_name, ts, 'MaxMemoryUsed', _mem, _mem, _mem FROM g
  UNION ALL SELECT function_name, ts, 'Invocations', _inv, _inv, _inv FROM g
  UNION ALL SELECT function_name, ts, 'Errors', _err, _err, _err FROM g)"""


def _stat(metric: str, stat: str, fn: str) -> str:
    return (f"{fn}(CASE WHEN metric = '{metric}' AND age_h <= 24 THEN {stat} END) AS {metric}_24, "
            f"{fn}(CASE WHEN metric = '{metric}' THEN {stat} END) AS {metric}_14")


SQL = {
    "ml_compile_dataset": f"""WITH {TELEMETRY}
SELECT inv_id, function_name, function_type, input_size, cold_start, """ + ", ".join(
        _R9(c) for c in TELEMETRY_NUMERIC if c != "cold_start") + " FROM telemetry",
    "src_function_inventory": """WITH pn AS (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 THEN 'hello' ELSE
  (['etl-transform','image-proc','rest-api','ml-inference','fibonacci'])[CAST(p_size % 5 + 1 AS INT)] || '-' || CAST(p_partkey AS VARCHAR) END AS name FROM part),
raw AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN name END AS "FunctionName",
  CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN name END AS function_name,
  CASE WHEN p_size % 4 <> 0 THEN (['python3.9','nodejs14','java11','php7','go1'])[CAST(p_partkey % 5 + 1 AS INT)] END AS "Runtime",
  CASE WHEN p_size % 5 <> 0 THEN p_size * 64 END AS "MemorySize" FROM pn)
SELECT p_partkey, coalesce("FunctionName", function_name) AS function_name, coalesce("Runtime", 'python3.9') AS runtime,
  coalesce("MemorySize", 128) AS memory_mb FROM raw WHERE coalesce("FunctionName", function_name) IS NOT NULL
  AND coalesce("FunctionName", function_name) <> ''""",
    "src_metric_points": f"""WITH {LIVE_POINTS}
SELECT function_name, metric, ts, round(average, 9) AS average, round(maximum, 9) AS maximum, round(sum, 9) AS sum FROM pts
WHERE metric = 'Duration' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    "agg_metric_rollup": f"""WITH {LIVE_POINTS},
nw AS (SELECT max(ts) + INTERVAL 12 HOUR AS now FROM events),
p AS (SELECT pts.*, (floor(epoch(now)) - epoch(ts)) / 3600.0e0 AS age_h FROM pts, nw),
s AS (SELECT function_name, {_stat('Duration', 'average', 'avg')}, {_stat('MaxMemoryUsed', 'maximum', 'max')},
  {_stat('Invocations', 'sum', 'sum')}, {_stat('Errors', 'sum', 'sum')} FROM p WHERE age_h >= 0 AND age_h <= 336 GROUP BY function_name),
r AS (SELECT DISTINCT function_name FROM (SELECT function_name FROM v_live UNION ALL SELECT 'fn-' || lower(r_name) FROM region))
SELECT r.function_name, round(coalesce(Duration_24, Duration_14, 0.0e0), 9) AS avg_duration_ms,
  coalesce(MaxMemoryUsed_24, MaxMemoryUsed_14, 128.0e0) AS max_memory_mb, coalesce(Invocations_24, Invocations_14, 0.0e0) AS invocations,
  coalesce(Errors_24, Errors_14, 0.0e0) AS errors,
  CASE WHEN coalesce(Duration_24, Duration_14) IS NOT NULL OR coalesce(Invocations_24, Invocations_14) IS NOT NULL
    OR coalesce(MaxMemoryUsed_24, MaxMemoryUsed_14) IS NOT NULL THEN 'live_aws' ELSE 'live_aws_no_data' END AS data_source
FROM r LEFT JOIN s ON r.function_name = s.function_name""",
    "agg_function_profile": f"""WITH {TELEMETRY}
SELECT function_name, {", ".join(f"round(avg({c}), 9) AS {c}" for c in TELEMETRY_NUMERIC)} FROM telemetry GROUP BY function_name""",
    "agg_mode": f"WITH {TELEMETRY} SELECT * FROM {_mode('telemetry', 'input_size')}",
    "join_profile_modes": f"WITH {PROFILE} SELECT function_name, function_type, input_size, " + ", ".join(_R9(c) for c in FB_NUM) + " FROM prof",
    "agg_median_fallback": f"WITH {PROFILE} SELECT " + ", ".join(_R9(c) for c in FB_NUM) + ", function_type, input_size FROM fb",
    "join_lookup_fallback": f"""WITH {PROFILE},
req AS (SELECT DISTINCT function_name FROM (SELECT 'fn-' || CAST(c_custkey AS VARCHAR) AS function_name FROM customer
  UNION ALL SELECT function_name FROM v_live))
SELECT req.function_name, """ + ", ".join(f"round(coalesce(prof.{c}, fb.{c}), 9) AS {c}" for c in FB_NUM)
    + """, coalesce(prof.function_type, fb.function_type) AS function_type, coalesce(prof.input_size, fb.input_size) AS input_size,
  prof.function_name IS NULL AS is_fallback
FROM req LEFT JOIN prof ON req.function_name = prof.function_name CROSS JOIN fb""",
    "join_live_override": f"""WITH {PROFILE},
lv AS (SELECT 'fn-' || CAST(user_id AS VARCHAR) AS function_name, avg(duration_ms) * 100 AS ld, max(user_id) * 10.0e0 AS lm
  FROM v_live GROUP BY 'fn-' || CAST(user_id AS VARCHAR))
SELECT prof.function_name, round(CASE WHEN ld IS NOT NULL AND ld > 0 THEN ld ELSE aws_duration_ms END, 9) AS aws_duration_ms,
  round(CASE WHEN lm IS NOT NULL AND lm > 0 THEN lm ELSE memory_config_mb END, 9) AS memory_config_mb,
  round(CASE WHEN lm IS NOT NULL AND lm > 0 THEN lm ELSE aws_memory_used_mb END, 9) AS aws_memory_used_mb
FROM prof LEFT JOIN lv ON prof.function_name = lv.function_name""",
    "prj_monthly_projection_profile": f"""WITH {PROFILE}
SELECT function_name, round_even(energy_target_wh, 4) AS energy_wh_per_invocation, 10000.0e0 * 24 * 30 AS monthly_invocations,
  round_even(10000.0e0 * 24 * 30 * energy_target_wh / 1000.0e0 * 0.708e0, 4) AS monthly_carbon_kg,
  round_even(10000.0e0 * 24 * 30 * ((memory_config_mb / 1024) * (aws_duration_ms / 1000) * 0.001392e0 + 16.70e0 / 1000000), 2) AS monthly_cost_inr
FROM prof""",
    "src_telemetry_csv": f"WITH {TELEMETRY} SELECT function_name, function_type, input_size, " + ", ".join(
        c for c in TELEMETRY_NUMERIC) + " FROM telemetry",
}
