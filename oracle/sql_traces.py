"""Oracle SQL: trace aggregation, joins, trace master."""

_ROWSUM = "0.0e0 + " + " + ".join(f"coalesce(CAST(m{i} AS DOUBLE), 0.0e0)" for i in range(1, 13))

DUR = """dday AS (SELECT hash_function, hash_app, day, avg(average) AS a, CAST(sum(cnt) AS BIGINT) AS c, avg(minimum) AS mi,
  avg(maximum) AS ma, avg(p50) AS p5, avg(p99) AS p9 FROM v_fn_day GROUP BY hash_function, hash_app, day),
dur_all AS (SELECT hash_function, hash_app, avg(a) AS avg_duration_ms, CAST(sum(c) AS BIGINT) AS invocation_count,
  avg(mi) AS min_duration_ms, avg(ma) AS max_duration_ms, avg(p5) AS p50_duration_ms, avg(p9) AS p99_duration_ms
  FROM dday GROUP BY hash_function, hash_app),
dur AS (SELECT * FROM dur_all WHERE invocation_count >= 10)"""

INV = f"""invd AS (SELECT hash_function, trigger_type, day, {_ROWSUM} AS daily_invocations FROM v_fn_minutes),
inv AS (SELECT hash_function, avg(daily_invocations) AS daily_invocations, arg_min(trigger_type, day) AS trigger_type
  FROM invd GROUP BY hash_function)"""

MEM = """mday AS (SELECT hash_app, day, avg(avg_mb) AS d, avg(p50_mb) AS d50, avg(p99_mb) AS d99 FROM v_app_day GROUP BY hash_app, day),
mem AS (SELECT hash_app, avg(d) AS memory_allocated_mb, avg(d50) AS memory_p50_mb, avg(d99) AS memory_p99_mb FROM mday GROUP BY hash_app)"""

MASTER = f"""{DUR}, {INV}, {MEM},
master AS (SELECT * FROM dur JOIN inv USING (hash_function) JOIN mem USING (hash_app)
  WHERE memory_allocated_mb IS NOT NULL AND avg_duration_ms IS NOT NULL AND avg_duration_ms > 0
    AND memory_allocated_mb > 0 AND memory_allocated_mb <= 1500 AND avg_duration_ms <= 300000)"""

_R9 = lambda c: f"round({c}, 9) AS {c}"
_DUR_OUT = ["avg_duration_ms", "min_duration_ms", "max_duration_ms", "p50_duration_ms", "p99_duration_ms"]

SQL = {
    "src_minute_wide": "SELECT hash_function, trigger_type, day, " + ", ".join(f"m{i}" for i in range(1, 13)) + " FROM v_fn_minutes",
    "agg_row_sum_minutes": f"SELECT hash_function, trigger_type, day, {_ROWSUM} AS daily_invocations FROM v_fn_minutes",
    "agg_invocations": f"WITH {INV} SELECT hash_function, round(daily_invocations, 9) AS daily_invocations, trigger_type FROM inv",
    "agg_two_level_duration": f"WITH {DUR} SELECT hash_function, hash_app, invocation_count, "
                              + ", ".join(_R9(c) for c in _DUR_OUT) + " FROM dur_all",
    "agg_two_level_memory": f"WITH {MEM} SELECT hash_app, round(memory_allocated_mb, 9) AS memory_allocated_mb, round(memory_p50_mb, 9) AS memory_p50_mb, round(memory_p99_mb, 9) AS memory_p99_mb FROM mem",
    "agg_distinct_counts": """SELECT (SELECT count(DISTINCT hash_function) FROM v_fn_day) AS distinct_functions,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT day, count(DISTINCT hash_function) AS n FROM v_fn_day GROUP BY day)) AS raw_unique_sum""",
    "agg_day_sketches": """SELECT app_id, count(*) AS n, count(DISTINCT function_name) AS functions, true AS functions_kept, true AS p50_kept, true AS p99_kept
FROM v_inv GROUP BY app_id""",
    "join_duration_invocations": f"""WITH {DUR}, {INV}
SELECT hash_function, hash_app, invocation_count, round(avg_duration_ms, 9) AS avg_duration_ms,
  round(daily_invocations, 9) AS daily_invocations, trigger_type FROM dur JOIN inv USING (hash_function)""",
    "join_function_memory": f"""WITH {DUR}, {MEM}
SELECT hash_function, hash_app, round(avg_duration_ms, 9) AS avg_duration_ms, round(memory_allocated_mb, 9) AS memory_allocated_mb
FROM dur JOIN mem USING (hash_app)""",
    "trace_master": f"""WITH {MASTER}
SELECT hash_function, hash_app, invocation_count, trigger_type, """ + ", ".join(_R9(c) for c in _DUR_OUT)
    + ", round(daily_invocations, 9) AS daily_invocations, round(memory_allocated_mb, 9) AS memory_allocated_mb, round(memory_p50_mb, 9) AS memory_p50_mb, round(memory_p99_mb, 9) AS memory_p99_mb FROM master",
    "trace_energy_top_functions": f"""WITH {MASTER},
e AS (SELECT *, (10.0e0 + 0.2e0 * memory_allocated_mb) * avg_duration_ms / 3600000.0e0 AS energy_wh FROM master)
SELECT hash_function, hash_app, trigger_type, round(avg_duration_ms, 9) AS avg_duration_ms,
  round(memory_allocated_mb, 9) AS memory_allocated_mb, round(energy_wh, 9) AS energy_wh, round(energy_wh * 1000.0e0, 6) AS energy_mwh
FROM e ORDER BY energy_wh DESC, hash_function, hash_app LIMIT 20""",
    "agg_trace_functions": """SELECT function_name, count(*) AS invocation_count, arg_min(runtime, ts) AS runtime,
  min(latency_ms) AS min_duration_ms, max(latency_ms) AS max_duration_ms, round(avg(latency_ms), 9) AS avg_duration_ms,
  round(median(latency_ms), 9) AS p50_duration_ms, round(quantile_cont(latency_ms, 0.99), 9) AS p99_duration_ms,
  round(avg(memory_mb), 9) AS memory_allocated_mb
FROM v_inv WHERE latency_ms > 0 AND memory_mb > 0 GROUP BY function_name
HAVING count(*) >= 10 AND avg(memory_mb) <= 3072 AND avg(latency_ms) <= 300000""",
    "agg_value_share": f"""WITH {MASTER}
SELECT trigger_type, count(*) AS n, round(count(*) * 100.0e0 / (SELECT count(*) FROM master), 9) AS pct FROM master WHERE trigger_type IS NOT NULL GROUP BY trigger_type""",
    "agg_value_share_top": """SELECT runtime, count(*) AS n, round(count(*) * 100.0e0 / (SELECT count(*) FROM v_inv), 9) AS pct
FROM v_inv GROUP BY runtime ORDER BY n DESC, runtime LIMIT 3""",
    "src_trace_glob": """SELECT hash_app AS "HashApp", hash_function AS "HashFunction", round(average, 9) AS "Average",
  cnt AS "Count", day FROM v_fn_day""",
}
