"""Oracle SQL: projections, filters, checks."""

from wattline.config import DEFAULT_CODE_METRICS
from wattline.functions.labels import FEATURE_LABELS, FEATURE_ORDER
from wattline.functions.text import sql_loc_count

_PROFILE = """fprof AS (SELECT function_name, avg(actual_wh) AS energy_wh, avg(predicted_wh) AS predicted_wh,
  avg(memory_mb) AS memory_mb, avg(latency_ms) AS duration_ms, count(*) AS invocations
  FROM v_pred GROUP BY function_name)"""

_PART_NAMES = """pnames AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'hello' ELSE
  (['etl-transform','image-proc','rest-api','ml-inference','fibonacci'])[CAST(p_size % 5 + 1 AS INT)] || '-' || CAST(p_partkey AS VARCHAR) END AS name
  FROM part)"""


def _label_sql(raw: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    fallback = (f"array_to_string(list_transform(string_split(regexp_replace({raw}, '[_-]', ' ', 'g'), ' '), "
                f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
    return f"coalesce(CASE {raw} {cases} END, {fallback})"


_FEATURES_ARR = "[" + ", ".join(f"'{f}'" for f in FEATURE_ORDER) + "]"

_ALIGN_COLS = {"memory_config_mb": "CAST(memory_mb AS DOUBLE)", "cold_start": "CAST(cold_start AS DOUBLE)",
               "aws_duration_ms": "latency_ms",
               "function_type_io": "CAST(lower(trigger_type) IN ('queue','event') AS DOUBLE)",
               "function_type_memory": "CAST(lower(trigger_type) = 'storage' AS DOUBLE)"}

_MONTHS = [f"m{i}" for i in range(1, 13)]

# The 12 inputs of the range check.
_CHECKED = ("memory_config_mb", "lines_of_code", "num_loops", "num_conditionals", "num_function_calls", "cyclomatic_complexity",
            "max_nesting_depth", "local_duration_ms", "local_cpu_percent", "local_memory_mb", "aws_duration_ms", "aws_memory_used_mb")


def _out_of_range() -> str:
    from oracle.sql_profiles import PROFILE
    live = {"aws_duration_ms": "ld", "memory_config_mb": "lm", "aws_memory_used_mb": "lm"}
    cols = ", ".join(f"CASE WHEN {live[c]} IS NOT NULL AND {live[c]} > 0 THEN {live[c]} ELSE {c} END AS {c}" if c in live else c for c in _CHECKED)
    buf = {c: f"(CASE WHEN mx_{c} > mn_{c} THEN (mx_{c} - mn_{c}) * 0.5e0 ELSE 1.0e0 END)" for c in _CHECKED}
    flags = ", ".join(f"CASE WHEN {c} < mn_{c} - {b} OR {c} > mx_{c} + {b} THEN printf('{c} (%.1f) is out of typical range [%.1f, %.1f]', {c}, mn_{c} - {b}, mx_{c} + {b}) END"
                      for c, b in buf.items())
    return f"""WITH {PROFILE},
lv AS (SELECT 'fn-' || CAST(user_id AS VARCHAR) AS function_name, avg(duration_ms) * 100 AS ld, max(user_id) * 10.0e0 AS lm
  FROM v_live GROUP BY 'fn-' || CAST(user_id AS VARCHAR)),
q AS (SELECT prof.function_name, {cols} FROM prof LEFT JOIN lv ON prof.function_name = lv.function_name),
p AS (SELECT *, (10.0e0 + 0.2e0 * memory_config_mb) * aws_duration_ms / 3600000.0e0 * 3 - 0.2e0 AS prediction FROM q),
b AS (SELECT {", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in _CHECKED)}, max(energy_target_wh) AS target_max FROM telemetry),
f AS (SELECT function_name, list_filter([{flags},
  CASE WHEN prediction <= 0 OR prediction > target_max * 2.0e0 THEN printf('Predicted energy (%.4f Wh) is out of typical target bounds.', prediction) END],
  lambda x: x IS NOT NULL) AS r FROM p, b)
SELECT function_name, len(r) > 0 AS is_low_confidence, array_to_string(r, '; ') AS reasons,
  CASE WHEN len(r) > 0 THEN 0.5e0 ELSE 0.9998e0 END AS confidence, CASE WHEN len(r) > 0 THEN 'low' ELSE 'high' END AS confidence_status,
  CASE WHEN len(r) > 0 THEN 'this function''s profile differs significantly from the training data; prediction may be less reliable. Reasons: '
    || array_to_string(r, '; ') ELSE 'Prediction is reliable based on training distribution similarity.' END AS confidence_message FROM f"""


SQL = {
    "prj_energy": """SELECT inv_id, function_name, memory_mb, latency_ms, 10.0e0 + 0.2e0 * memory_mb AS power_w,
  (10.0e0 + 0.2e0 * memory_mb) * latency_ms / 3600000.0e0 AS energy_wh,
  (10.0e0 + 0.2e0 * memory_mb) * latency_ms / 3600000.0e0 * 1000.0e0 AS energy_mwh FROM v_inv""",
    "prj_carbon": """SELECT inv_id, actual_wh, actual_wh / 1000.0e0 AS energy_kwh, actual_wh / 1000.0e0 * 0.708e0 AS carbon_kg,
  actual_wh / 1000.0e0 * 0.708e0 * 1000.0e0 AS carbon_g, actual_wh / 1000.0e0 * 708000.0e0 AS carbon_g_ref FROM v_pred""",
    "prj_cost": """SELECT inv_id, (memory_mb / 1024) * (latency_ms / 1000) AS gb_seconds,
  (memory_mb / 1024) * (latency_ms / 1000) * 0.001392e0 + 16.70e0 / 1000000 AS cost_inr,
  (memory_mb / 1024) * (latency_ms / 1000) * 0.0000166667e0 + 0.20e0 / 1000000 AS cost_usd FROM v_inv""",
    "prj_monthly_projection": f"""WITH {_PROFILE}
SELECT function_name, round_even(energy_wh, 4) AS energy_wh_per_invocation, 10000.0e0 * 24 * 30 AS monthly_invocations,
  round_even(10000.0e0 * 24 * 30 * energy_wh / 1000.0e0 * 0.708e0, 4) AS monthly_carbon_kg,
  round_even(10000.0e0 * 24 * 30 * ((memory_mb / 1024) * (duration_ms / 1000) * 0.001392e0 + 16.70e0 / 1000000), 2) AS monthly_cost_inr
FROM fprof""",
    "prj_flat_spike": f"""WITH {_PROFILE}
SELECT function_name, 14400000.0e0 AS spike_requests, round(energy_wh * 14400000.0e0 / 1000.0e0, 6) AS spike_energy_kwh,
  round(energy_wh * 14400000.0e0 / 1000.0e0 * 0.708e0, 6) AS spike_carbon_kg FROM fprof""",
    "prj_formula_gap": """SELECT inv_id, (10.0e0 + 0.2e0 * memory_mb) * (latency_ms / 3600000.0e0) AS theoretical_wh,
  abs((10.0e0 + 0.2e0 * memory_mb) * (latency_ms / 3600000.0e0) - predicted_wh) AS formula_gap_wh FROM v_pred""",
    "prj_derived_ratios": """WITH b AS (SELECT inv_id, memory_mb, greatest(latency_ms, 1.0e0) AS dur FROM v_inv),
c AS (SELECT *, greatest(1.0e0, dur * 0.9e0) AS ld, greatest(30.0e0, memory_mb * 0.8e0) AS lm FROM b)
SELECT inv_id, ld AS local_duration_ms, lm AS local_memory_mb,
  (10.0e0 + 0.2e0 * memory_mb) * (dur / 3600000.0e0) AS energy_target_wh,
  (10.0e0 + 0.2e0 * lm) * (ld / 3600000.0e0) AS local_energy_wh,
  dur / ld AS duration_ratio, lm / memory_mb AS memory_efficiency,
  ((10.0e0 + 0.2e0 * memory_mb) * (dur / 3600000.0e0)) / ((10.0e0 + 0.2e0 * lm) * (ld / 3600000.0e0)) AS calibration_ratio
FROM c""",
    "prj_default_metrics": f"""WITH f AS (SELECT function_name, avg(latency_ms) AS aws_duration_ms FROM v_inv GROUP BY function_name),
d AS (SELECT 'fn-' || CAST(doc_id AS VARCHAR) AS function_name, CAST({sql_loc_count('text')} AS DOUBLE) AS lines_of_code FROM documents)
SELECT f.function_name, coalesce(d.lines_of_code, {DEFAULT_CODE_METRICS['lines_of_code']}e0) AS lines_of_code,
  {DEFAULT_CODE_METRICS['num_loops']}e0 AS num_loops, {DEFAULT_CODE_METRICS['num_conditionals']}e0 AS num_conditionals,
  {DEFAULT_CODE_METRICS['num_function_calls']}e0 AS num_function_calls,
  {DEFAULT_CODE_METRICS['cyclomatic_complexity']}e0 AS cyclomatic_complexity,
  {DEFAULT_CODE_METRICS['max_nesting_depth']}e0 AS max_nesting_depth, 50.0e0 AS local_duration_ms,
  round(coalesce(f.aws_duration_ms, 60.0e0), 6) AS aws_duration_ms
FROM f LEFT JOIN d ON f.function_name = d.function_name""",
    "prj_error_columns": """SELECT inv_id, abs(actual_wh - predicted_wh) AS absolute_error_wh,
  abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0 AS percentage_error,
  greatest(0.0e0, 100.0e0 - abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0) AS accuracy_pct FROM v_pred""",
    "prj_gap_verdict": """WITH a AS (SELECT inv_id, 100.0e0 - abs(predicted_wh - actual_wh) / greatest(actual_wh, 0.0001e0) * 100.0e0 AS acc FROM v_pred)
SELECT inv_id, acc AS gap_accuracy_pct, CASE WHEN acc >= 90 THEN 'Excellent' WHEN acc >= 75 THEN 'Good' ELSE 'Needs Review' END AS gap_verdict FROM a""",
    "prj_floor_prediction": """SELECT inv_id, predicted_wh - 0.002e0 AS raw_pred_wh, greatest(0.0001e0, predicted_wh - 0.002e0) AS online_pred_wh,
  greatest(0.0e0, predicted_wh - 0.002e0) AS batch_pred_wh FROM v_pred""",
    "prj_confidence": """WITH m AS (SELECT inv_id, coalesce(CASE runtime WHEN 'python3.9' THEN 'xgboost' WHEN 'nodejs14' THEN 'rf'
  WHEN 'java11' THEN 'nn' WHEN 'php7' THEN 'neural_net' END, 'random_forest') AS a, memory_mb = 3000 AS is_fallback FROM v_inv),
n AS (SELECT inv_id, CASE WHEN a IN ('neural_net', 'nn') THEN 'neural_network' WHEN a = 'rf' THEN 'random_forest' ELSE a END AS model, is_fallback FROM m)
SELECT inv_id, model, is_fallback, CASE WHEN is_fallback THEN 0.5e0 WHEN model = 'xgboost' THEN 0.96e0
  WHEN model = 'random_forest' THEN 0.94e0 ELSE 0.92e0 END AS confidence FROM n""",
    "prj_badges": """WITH p AS (SELECT function_name,
  avg(greatest(0.0e0, 100.0e0 - abs(actual_wh - predicted_wh) / greatest(actual_wh, 1e-9) * 100.0e0)) AS efficiency,
  avg(actual_wh) AS energy_wh FROM v_pred GROUP BY function_name)
SELECT function_name, CASE WHEN efficiency >= 80 THEN 'high' WHEN efficiency >= 60 THEN 'medium' ELSE 'low' END AS efficiency_badge,
  CASE WHEN energy_wh > 0.05 THEN 'high' WHEN energy_wh > 0.02 THEN 'medium' ELSE 'low' END AS energy_badge FROM p""",
    "prj_runtime_category": """SELECT inv_id, runtime, CASE WHEN lower(trim(runtime)) LIKE '%python%' THEN 'python'
  WHEN lower(trim(runtime)) LIKE '%node%' THEN 'nodejs' WHEN lower(trim(runtime)) LIKE '%java%' THEN 'java'
  WHEN lower(trim(runtime)) LIKE '%php%' THEN 'php' ELSE 'others' END AS runtime_category FROM v_inv""",
    "prj_trigger_flags": """SELECT inv_id, CAST(lower(trigger_type) IN ('queue', 'event') AS DOUBLE) AS function_type_io,
  CAST(lower(trigger_type) = 'storage' AS DOUBLE) AS function_type_memory FROM v_inv""",
    "prj_name_category": f"""WITH {_PART_NAMES}
SELECT p_partkey, name, CASE WHEN name LIKE '%-%' THEN regexp_replace(name, '-[^-]*$', '') ELSE '' END AS category,
  CASE WHEN name LIKE '%etl-transform%' OR name LIKE '%rest-api%' THEN 'io'
       WHEN name LIKE '%image-proc%' OR name LIKE '%ml-inference%' THEN 'memory' ELSE 'cpu' END AS function_type FROM pnames""",
    "prj_duration_bucket": """WITH d AS (SELECT inv_id, latency_ms * quantity AS duration_ms FROM v_inv)
SELECT inv_id, duration_ms,
  CASE WHEN duration_ms / 1000.0e0 >= 0 AND duration_ms / 1000.0e0 < 1 THEN '<1s' WHEN duration_ms / 1000.0e0 >= 1 AND duration_ms / 1000.0e0 < 10 THEN '1-10s'
       WHEN duration_ms / 1000.0e0 >= 10 AND duration_ms / 1000.0e0 < 30 THEN '10-30s' WHEN duration_ms / 1000.0e0 >= 30 AND duration_ms / 1000.0e0 < 67 THEN '30-67s'
       WHEN duration_ms / 1000.0e0 >= 67 THEN '>67s' END AS duration_bucket,
  CASE WHEN duration_ms / 1000.0e0 >= 0 AND duration_ms / 1000.0e0 < 1 THEN 0 WHEN duration_ms / 1000.0e0 >= 1 AND duration_ms / 1000.0e0 < 10 THEN 1
       WHEN duration_ms / 1000.0e0 >= 10 AND duration_ms / 1000.0e0 < 30 THEN 2 WHEN duration_ms / 1000.0e0 >= 30 AND duration_ms / 1000.0e0 < 67 THEN 3
       WHEN duration_ms / 1000.0e0 >= 67 THEN 4 END AS bucket_order FROM d""",
    "prj_feature_label": f"""WITH f AS (SELECT DISTINCT feature FROM v_attr),
r AS (SELECT feature, CASE WHEN regexp_matches(feature, '^f\\d+$') AND CAST(substr(feature, 2) AS INT) < {len(FEATURE_ORDER)}
  THEN {_FEATURES_ARR}[CAST(substr(feature, 2) AS INT) + 1] END AS raw_name FROM f)
SELECT feature, raw_name, {_label_sql('raw_name')} AS label, {_label_sql('feature')} AS short_label FROM r""",
    "prj_align_features": "SELECT inv_id, " + ", ".join(
        f"{_ALIGN_COLS[f]} AS \"{f}\"" if f in _ALIGN_COLS else f"0.0e0 AS \"{f}\"" for f in FEATURE_ORDER) + " FROM v_inv",
    "prj_numeric_coerce": """SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '"k":\\s*([0-9.]+)', 1) AS DOUBLE), 0.0e0) AS k_num,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0.0e0) AS type_num, coalesce(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE), 0.0e0) AS value_num FROM events""",
    "prj_drop_leakage": """WITH b AS (SELECT inv_id, memory_mb, latency_ms, greatest(latency_ms, 1.0e0) AS dur FROM v_inv),
c AS (SELECT *, greatest(1.0e0, dur * 0.9e0) AS ld, greatest(30.0e0, memory_mb * 0.8e0) AS lm FROM b)
SELECT inv_id, memory_mb, latency_ms, ld AS local_duration_ms, lm AS local_memory_mb, dur / ld AS duration_ratio,
  lm / memory_mb AS memory_efficiency FROM c""",
    "prj_rename_order": """SELECT hash_app AS "HashApp", hash_function AS "HashFunction", day, round(average, 6) AS avg_duration_ms,
  cnt AS invocation_count, minimum AS min_duration_ms, maximum AS max_duration_ms, round(p50, 6) AS p50_duration_ms,
  round(p99, 6) AS p99_duration_ms FROM v_fn_day""",
    "flt_valid_caps": """WITH v AS (SELECT inv_id, memory_mb / 2 AS memory_allocated_mb, latency_ms * quantity * 3 AS avg_duration_ms FROM v_inv)
SELECT * FROM v WHERE memory_allocated_mb IS NOT NULL AND avg_duration_ms IS NOT NULL AND avg_duration_ms > 0
  AND memory_allocated_mb > 0 AND memory_allocated_mb <= 1500 AND avg_duration_ms <= 300000""",
    "flt_min_count": """SELECT function_name, count(*) AS invocation_count FROM v_inv GROUP BY function_name HAVING count(*) >= 10""",
    "flt_name_search": f"""WITH {_PART_NAMES} SELECT p_partkey, name FROM pnames WHERE lower(name) LIKE '%etl-transform-1%'""",
    "flt_negative_pred": f"""WITH {_PROFILE}
SELECT function_name, round(predicted_wh * 2 - 0.15e0, 9) AS prediction FROM fprof WHERE round(predicted_wh * 2 - 0.15e0, 9) < 0""",
    "flt_out_of_range": _out_of_range(),
    "flt_energy_gate": f"""WITH d AS (SELECT doc_id, CAST({sql_loc_count('text')} AS DOUBLE) AS loc,
  1.0e0 + (length(text) - length(replace(text, ',', ''))) / 10.0e0 AS cc FROM documents)
SELECT doc_id, round(0.5e0 + cc * 0.15e0 + loc * 0.002e0, 6) AS gate_energy_wh,
  CASE WHEN 0.5e0 + cc * 0.15e0 + loc * 0.002e0 > 5.0 THEN 'FAIL' ELSE 'PASS' END AS gate_status FROM d""",
    "chk_missing_values": "SELECT column_name, missing_count FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count FROM v_fn_minutes"
        for c in ["hash_function", "trigger_type", "day", *_MONTHS]) + ") WHERE missing_count > 0",
    # the raw inputs that a request lacks, in their order
    "chk_missing_inputs": """WITH raw AS (SELECT ['function_name', 'function_type', 'input_size', 'memory_config_mb', 'cold_start', 'lines_of_code', 'num_loops',
  'num_conditionals', 'num_function_calls', 'cyclomatic_complexity', 'max_nesting_depth', 'local_duration_ms', 'local_cpu_percent', 'local_memory_mb',
  'aws_duration_ms', 'aws_memory_used_mb', 'duration_ratio', 'memory_efficiency'] AS names),
lack AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN [names[c_custkey % 18 + 1]]
  WHEN c_custkey % 4 = 3 THEN list_transform(list_filter(range(18), lambda i: i % 3 = c_custkey % 3), lambda i: names[i + 1]) ELSE [] END AS m FROM customer, raw)
SELECT c_custkey, 'Missing required features: ' || array_to_string(m, ', ') AS message, CAST(len(m) AS INT) AS n_missing FROM lack WHERE len(m) > 0""",
    "chk_required_features": """WITH a AS (SELECT hash_function, trigger_type, day, list_filter([""" + ", ".join(
        f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in _MONTHS) + """], lambda x: x IS NOT NULL) AS mm FROM v_fn_minutes)
SELECT hash_function, trigger_type, day, array_to_string(mm, ',') AS missing, CAST(len(mm) AS INTEGER) AS n_missing FROM a WHERE len(mm) > 0""",
    "sink_append_result": f"""WITH {_PROFILE},
m AS (SELECT function_name, round_even(energy_wh, 4) AS energy_wh_per_invocation, 10000.0e0 * 24 * 30 AS monthly_invocations,
  round_even(10000.0e0 * 24 * 30 * energy_wh / 1000.0e0 * 0.708e0, 4) AS monthly_carbon_kg,
  round_even(10000.0e0 * 24 * 30 * ((memory_mb / 1024) * (duration_ms / 1000) * 0.001392e0 + 16.70e0 / 1000000), 2) AS monthly_cost_inr
  FROM fprof)
SELECT *, 'run-1' AS run FROM m UNION ALL SELECT *, 'run-2' AS run FROM m""",
}
