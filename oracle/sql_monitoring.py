"""Oracle SQL: batch twins of the streaming monitors."""

_ALL = """all_hours AS (SELECT 'fn-' || event_type AS function_name, date_trunc('hour', ts) AS window_start,
  date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS requests FROM events GROUP BY 1, 2, 3)"""

_HOURLY = _ALL + """,
cut AS (SELECT date_trunc('hour', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) AS c FROM events),
hourly AS (SELECT all_hours.* FROM all_hours, cut WHERE window_start >= c),
old AS (SELECT events.* FROM events, cut WHERE ts < c),
fc AS (SELECT 'fn-' || event_type AS function_name, count(*) / (SELECT count(DISTINCT date_trunc('hour', ts)) FROM old) AS predicted_rph
  FROM old GROUP BY 1),
st AS (SELECT h.function_name, h.window_start, h.requests AS actual_rph, fc.predicted_rph,
  (h.requests - fc.predicted_rph) / greatest(fc.predicted_rph, 1.0e0) * 100.0e0 AS deviation_pct FROM hourly h JOIN fc USING (function_name)),
al AS (SELECT *, abs(deviation_pct) AS a, actual_rph > predicted_rph AS over,
  CASE WHEN over AND a > 20 AND a <= 40 THEN CAST(round(a / 100.0e0 * 2400.0e0, 0) AS BIGINT)
       WHEN over AND a > 40 THEN CAST(round(a / 100.0e0 * 6000.0e0, 0) AS BIGINT) END AS cost,
  CASE WHEN NOT over AND a > 20 AND a <= 40 THEN CAST(round(a / 100.0e0 * 1200.0e0, 0) AS BIGINT) END AS saving FROM st)"""

SQL = {
    "str_hourly_traffic": "WITH " + _ALL + " SELECT function_name, window_start, window_end, requests FROM all_hours",
    "str_drift_status": "WITH " + _HOURLY + """ SELECT function_name, window_start, actual_rph, round(predicted_rph, 9) AS predicted_rph,
  round(deviation_pct, 9) AS deviation_pct, CASE WHEN abs(deviation_pct) <= 8 THEN 'On Track' ELSE 'Drifting' END AS status FROM st""",
    "str_drift_alerts": "WITH " + _HOURLY + """ SELECT function_name, window_start, round(deviation_pct, 9) AS deviation_pct,
  CASE WHEN a <= 8 THEN 'ok' WHEN a <= 20 THEN 'warning' ELSE 'critical' END AS severity,
  CASE WHEN a <= 8 THEN 'System Healthy' WHEN a <= 20 THEN 'Mild Drift Detected' WHEN a <= 40 THEN 'Significant Anomaly'
    ELSE 'Critical Deviation' END AS title, CASE WHEN a <= 8 THEN title ELSE title || ' (' || format('{:.1f}', deviation_pct) || '%)' END AS headline,
  CASE WHEN over THEN 'over' ELSE 'under' END AS direction, cost AS cost_estimate_inr, saving AS saving_estimate_inr,
  CASE WHEN a <= 8 THEN 'Actual traffic (' || actual_rph || ' req/hr) is within ' || format('{:.1f}', a) || '% of forecast.'
    WHEN a <= 20 AND over THEN 'Actual live traffic slightly exceeds ML forecasting.'
    WHEN a <= 20 THEN 'Traffic volume is idling below ML forecast.'
    WHEN a <= 40 AND over THEN 'Traffic dramatically exceeds baseline forecasting constraints.'
    WHEN a <= 40 THEN 'Traffic severely under-utilizing baseline compute.'
    ELSE 'Serverless telemetry has completely detached from predictive forecasting models.' END AS detail,
  CASE WHEN a <= 8 THEN 'No networking adjustment needed.'
    WHEN a <= 20 AND over THEN 'Consider provisioned concurrency on ' || function_name || '.'
    WHEN a <= 20 THEN 'Scale down the reserved memory.'
    WHEN a <= 40 AND over THEN 'Estimated cost hike: INR ' || cost || '. Alarm on throttles.'
    WHEN a <= 40 THEN 'Over-provisioned: less memory could save INR ' || saving || ' a month.'
    WHEN over THEN 'The burst may cost INR ' || cost || ' or more. Shield the endpoint.'
    ELSE 'Check that the trigger is configured and active.' END AS advice
FROM al""",
    "str_live_history": """SELECT function_name, event_id, ts, duration_ms, rank FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY function_name ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM v_live) WHERE rank <= 12""",
    # hours that a watermark of one hour has closed
    "str_alert_stream": "WITH " + _HOURLY + """,
closed AS (SELECT st.*, CASE WHEN abs(deviation_pct) <= 8 THEN 0 WHEN abs(deviation_pct) <= 20 THEN 1 WHEN abs(deviation_pct) <= 40 THEN 2 ELSE 3 END AS tier
  FROM st WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
seen AS (SELECT *, coalesce(lag(tier) OVER (PARTITION BY function_name ORDER BY window_start), 0) AS last_tier FROM closed)
SELECT function_name, window_start, actual_rph, round(predicted_rph, 9) AS predicted_rph, round(deviation_pct, 9) AS deviation_pct, tier, last_tier
FROM seen WHERE tier <> last_tier""",
    "str_gap_stream": """WITH cut AS (SELECT date_trunc('hour', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) AS c FROM events),
e AS (SELECT event_id, ts, 'fn-' || event_type AS function_name,
  (10.0e0 + 0.2e0 * (user_id * 10.0e0)) * value / 3600000.0e0 AS actual_wh FROM events),
r AS (SELECT function_name, avg(actual_wh) AS predicted_wh FROM e, cut WHERE ts < c GROUP BY function_name),
g AS (SELECT e.*, r.predicted_wh, 100.0e0 - abs(r.predicted_wh - e.actual_wh) / greatest(e.actual_wh, 0.0001e0) * 100.0e0 AS acc
  FROM e JOIN r USING (function_name), cut WHERE e.ts >= c)
SELECT event_id, function_name, actual_wh, round(predicted_wh, 9) AS predicted_wh, round(acc, 9) AS gap_accuracy_pct,
  CASE WHEN acc >= 90 THEN 'Excellent' WHEN acc >= 75 THEN 'Good' ELSE 'Needs Review' END AS gap_verdict FROM g""",
    "join_forecast_actual": "WITH " + _HOURLY + """ SELECT function_name, window_start, actual_rph, round(predicted_rph, 9) AS predicted_rph FROM st""",
}
