"""Domain views as SQL text (the same definitions the Spark views build),
prepended as CTEs to every oracle query that names them."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_inv": """
SELECT concat('fn-', CAST(l.l_partkey AS STRING)) AS function_name,
       concat('app-', CAST(l.l_partkey % 10 AS STRING)) AS app_id,
       concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING), CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING)) AS inv_id,
       l.l_shipdate AS ts, CAST(year(l.l_shipdate) AS INT) AS day,
       CASE l.l_partkey % 5 WHEN 0 THEN 'python3.9' WHEN 1 THEN 'nodejs14' WHEN 2 THEN 'java11' WHEN 3 THEN 'php7' ELSE 'go1' END AS runtime,
       CASE l.l_partkey % 6 WHEN 0 THEN 'http' WHEN 1 THEN 'timer' WHEN 2 THEN 'queue' WHEN 3 THEN 'storage' WHEN 4 THEN 'event' ELSE 'orchestration' END AS trigger_type,
       CASE p.p_size % 6 WHEN 0 THEN 128 WHEN 1 THEN 256 WHEN 2 THEN 512 WHEN 3 THEN 1024 WHEN 4 THEN 2048 ELSE 3000 END AS memory_mb,
       l.l_extendedprice / 10 AS latency_ms,
       CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END AS cold_start,
       l.l_quantity AS quantity, l.l_discount AS discount, l.l_tax AS tax
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_pred": """
SELECT *, (10 + 0.2e0 * memory_mb) * latency_ms / 3600000 AS actual_wh,
       (10 + 0.2e0 * memory_mb) * latency_ms / 3600000 * (1 + (discount - 0.05e0) * 4) AS predicted_wh
FROM v_inv""",
    "v_fn_day": """
SELECT function_name AS hash_function, app_id AS hash_app, day, avg(latency_ms) AS average, count(*) AS cnt,
       min(latency_ms) AS minimum, max(latency_ms) AS maximum, median(latency_ms) AS p50,
       percentile_cont(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99
FROM v_inv GROUP BY function_name, app_id, day""",
    "v_app_day": """
SELECT concat('app-', CAST(s_suppkey % 10 AS STRING)) AS hash_app, CAST(floor(s_suppkey / 10) AS BIGINT) AS day,
       64 + abs(s_acctbal) / 6 AS avg_mb, (64 + abs(s_acctbal) / 6) * 0.9e0 AS p50_mb, (64 + abs(s_acctbal) / 6) * 1.5e0 AS p99_mb
FROM supplier""",
    "v_fn_minutes": """
SELECT function_name AS hash_function, trigger_type, day,
       sum(CASE WHEN month(ts) = 1 THEN quantity END) AS m1, sum(CASE WHEN month(ts) = 2 THEN quantity END) AS m2,
       sum(CASE WHEN month(ts) = 3 THEN quantity END) AS m3, sum(CASE WHEN month(ts) = 4 THEN quantity END) AS m4,
       sum(CASE WHEN month(ts) = 5 THEN quantity END) AS m5, sum(CASE WHEN month(ts) = 6 THEN quantity END) AS m6,
       sum(CASE WHEN month(ts) = 7 THEN quantity END) AS m7, sum(CASE WHEN month(ts) = 8 THEN quantity END) AS m8,
       sum(CASE WHEN month(ts) = 9 THEN quantity END) AS m9, sum(CASE WHEN month(ts) = 10 THEN quantity END) AS m10,
       sum(CASE WHEN month(ts) = 11 THEN quantity END) AS m11, sum(CASE WHEN month(ts) = 12 THEN quantity END) AS m12
FROM v_inv GROUP BY function_name, trigger_type, day""",
    "v_live": """
SELECT event_id, concat('fn-', event_type) AS function_name, ts, value AS duration_ms, user_id FROM events""",
    "v_attr": """
SELECT CAST(l_orderkey % 10 AS INT) AS row_id, concat('f', CAST(l_partkey % 33 AS STRING)) AS feature,
       avg(l_discount) - 0.05e0 AS shap_value, avg(l_tax) - 0.04e0 AS lime_weight
FROM lineitem GROUP BY l_orderkey % 10, l_partkey % 33""",
}

_ORDER = ["v_inv", "v_pred", "v_fn_day", "v_app_day", "v_fn_minutes", "v_live", "v_attr"]


def _needed(sql: str) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(VIEWS[name])
    return found


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the views it names (directly or not).
    A query that starts with its own ``WITH`` keeps its CTEs after the views."""
    need = [v for v in _ORDER if v in _needed(sql)]
    if not need:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]}\n)" for v in need)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
