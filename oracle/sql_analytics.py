"""Oracle SQL: windows, top-k, sets, attributions."""

from oracle.sql_traces import MASTER
from wattline.functions.labels import FEATURE_LABELS

_FPROF = """fprof AS (SELECT function_name, avg(actual_wh) AS energy_wh,
  (avg(memory_mb) / 1024) * (avg(latency_ms) / 1000) * 0.001392e0 + 16.70e0 / 1000000 AS cost_per_call
  FROM v_pred GROUP BY function_name)"""

_STRAT = f"""{MASTER},
rows_ AS (SELECT hash_function, hash_app, trigger_type, hash_function || '|' || hash_app AS id,
  md5(hash_function || '|' || hash_app || '|42') AS h FROM master),
tot AS (SELECT count(*) AS total FROM rows_),
cnt AS (SELECT trigger_type, count(*) AS c FROM rows_ WHERE trigger_type IS NOT NULL GROUP BY trigger_type),
q AS (SELECT trigger_type, least(greatest(1, CAST(round_even(c / total * 5000, 0) AS BIGINT)), c) AS quota FROM cnt, tot),
rk AS (SELECT r.*, row_number() OVER (PARTITION BY trigger_type ORDER BY h, id) AS rk FROM rows_ r WHERE trigger_type IS NOT NULL),
drawn AS (SELECT rk.* FROM rk JOIN q USING (trigger_type) WHERE rk <= quota),
nd AS (SELECT count(*) AS nd FROM drawn),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS g FROM drawn) WHERE g <= 5000),
rest AS (SELECT * FROM rows_ WHERE id NOT IN (SELECT id FROM drawn)),
fill AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS g FROM rest), nd WHERE g <= 5000 - nd),
strat AS (SELECT hash_function, hash_app, trigger_type FROM kept UNION ALL SELECT hash_function, hash_app, trigger_type FROM fill)"""

_IMP = """simp AS (SELECT feature, avg(abs(shap_value)) AS importance FROM v_attr GROUP BY feature),
srank AS (SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
  importance / max(importance) OVER () * 100.0e0 AS relative_pct FROM simp),
limp AS (SELECT feature, avg(abs(lime_weight)) AS importance FROM v_attr GROUP BY feature),
lrank AS (SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM limp)"""

_ALIGNED = """aligned AS (SELECT a.row_id, a.feature, a.shap_value, coalesce(b.lime_weight, 0.0e0) AS lime_weight FROM v_attr a
  LEFT JOIN v_attr b ON a.row_id = b.row_id AND a.feature = b.feature)"""

_BASE = """base AS (SELECT avg(actual_wh) AS base_wh FROM v_pred),
attr AS (SELECT v.*, base_wh FROM v_attr v, base),
pr AS (SELECT row_id, first(base_wh) + sum(shap_value) AS predicted_wh FROM attr GROUP BY row_id)"""

_CODE = "('lines_of_code', 'num_loops', 'num_conditionals', 'cyclomatic_complexity', 'max_nesting_depth')"


def _label(raw: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    fallback = (f"array_to_string(list_transform(string_split(regexp_replace({raw}, '[_-]', ' ', 'g'), ' '), "
                f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
    return f"coalesce(CASE {raw} {cases} END, {fallback})"


_GRID = """grid AS (SELECT CAST(l_orderkey % 60 AS INT) AS r, CAST(l_partkey % 60 AS INT) AS c, sum(l_quantity) % 256 AS v
  FROM lineitem GROUP BY 1, 2)"""

_FLAGSETS = """sa AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IS NOT NULL),
sn AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_partkey IS NOT NULL),
sr AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)"""

_MEMBERS = """m AS (SELECT DISTINCT l_returnflag || l_linestatus AS set_id, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)"""

_SPIKE = f"""{_FPROF},
hh AS (SELECT function_name, energy_wh, cost_per_call, unnest(range(1, 73)) AS hour FROM fprof),
s1 AS (SELECT *, hour / 72.0e0 AS p FROM hh),
s2 AS (SELECT *, CASE WHEN p < 0.1 THEN 0.6e0 + (p / 0.1e0) * 0.4e0 WHEN p < 0.85 THEN 1.0e0 ELSE 1.0e0 - (p - 0.85e0) * 1.5e0 END AS shape FROM s1),
sp AS (SELECT function_name, CAST(hour AS INT) AS hour, energy_wh, cost_per_call, CAST(trunc(200000.0e0 * shape * 1.0e0) AS BIGINT) AS req FROM s2)"""

SQL = {
    "win_stratified_sample": f"WITH {_STRAT} SELECT hash_function, hash_app, trigger_type FROM strat",
    "join_anti_remaining": f"""WITH {_STRAT} SELECT hash_function, hash_app, trigger_type FROM master
WHERE hash_function || '|' || hash_app NOT IN (SELECT hash_function || '|' || hash_app FROM strat)""",
    "win_seeded_sample": """SELECT inv_id, actual_wh, predicted_wh FROM v_pred ORDER BY md5(CAST(inv_id AS VARCHAR) || '|42'), inv_id LIMIT 100""",
    "win_last_n": """SELECT function_name, event_id, ts, duration_ms, rank FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY function_name ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM v_live) WHERE rank <= 12""",
    "win_rank_features": f"WITH {_IMP} SELECT feature, round(importance, 9) AS importance, rank, round(relative_pct, 9) AS relative_pct FROM srank",
    "topk_importance": f"WITH {_IMP} SELECT feature, round(importance, 9) AS importance FROM srank ORDER BY importance DESC, feature LIMIT 15",
    "topk_attributions": """SELECT row_id, rank, feature, shap_value, CASE WHEN shap_value >= 0 THEN 'increases' ELSE 'decreases' END AS direction
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) AS INTEGER) AS rank FROM v_attr) WHERE rank <= 5""",
    "join_attributions": f"WITH {_ALIGNED} SELECT * FROM aligned",
    "agg_global_importance": f"""WITH {_IMP} SELECT s.feature, round(s.importance, 9) AS shap_importance, round(l.importance, 9) AS lime_importance,
  s.rank AS shap_rank, l.rank AS lime_rank FROM srank s JOIN lrank l ON s.feature = l.feature""",
    "agg_importance_normalised": f"""WITH {_IMP},
t AS (SELECT feature, importance AS si FROM simp ORDER BY importance DESC, feature LIMIT 10),
j AS (SELECT t.feature, si, coalesce(limp.importance, 0.0e0) AS li FROM t LEFT JOIN limp ON t.feature = limp.feature),
mx AS (SELECT max(si) AS ms, max(li) AS ml FROM j)
SELECT feature, round(si / CASE WHEN ms <> 0 THEN ms ELSE 1.0 END, 9) AS shap_norm,
  round(li / CASE WHEN ml <> 0 THEN ml ELSE 1.0 END, 9) AS lime_norm FROM j, mx""",
    "agg_attribution_agreement": f"""WITH {_ALIGNED},
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) AS rk FROM aligned) WHERE rk <= 10),
g AS (SELECT row_id, sum(CASE WHEN (shap_value >= 0) = (lime_weight >= 0) THEN 1 ELSE 0 END) AS agreements, count(*) AS compared FROM t GROUP BY row_id)
SELECT row_id, CAST(agreements AS BIGINT) AS agreements, compared, CASE WHEN agreements >= 8 THEN 'Strong Agreement'
  WHEN agreements >= 5 THEN 'Moderate Agreement' ELSE 'Low Agreement' END AS agreement FROM g""",
    "agg_attribution_flow": f"""WITH {_BASE},
t AS (SELECT * FROM (SELECT row_id, feature, shap_value, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature) AS rank FROM v_attr) WHERE rank <= 5),
j AS (SELECT t.*, base_wh, predicted_wh FROM t JOIN pr USING (row_id), base),
g AS (SELECT row_id, sum(CASE WHEN shap_value * 1000.0e0 >= 0 THEN shap_value * 1000.0e0 ELSE 0.0e0 END) AS total_pos_mwh,
  sum(CASE WHEN shap_value * 1000.0e0 < 0 THEN abs(shap_value * 1000.0e0) ELSE 0.0e0 END) AS total_neg_mwh,
  first(base_wh * 1000.0e0) AS base_mwh, first(predicted_wh * 1000.0e0) AS predicted_mwh, arg_min(feature, rank) AS top_driver,
  arg_min(CASE WHEN feature IN {_CODE} THEN feature END, CASE WHEN feature IN {_CODE} THEN rank END) AS top_code_driver FROM j GROUP BY row_id),
h AS (SELECT *, base_mwh + total_pos_mwh + total_neg_mwh AS tot, (predicted_mwh - base_mwh) / greatest(base_mwh, 0.001e0) * 100.0e0 AS diff FROM g)
SELECT row_id, round(base_mwh, 9) AS base_mwh, round(predicted_mwh, 9) AS predicted_mwh, round(total_pos_mwh, 9) AS total_pos_mwh,
  round(total_neg_mwh, 9) AS total_neg_mwh, round(CASE WHEN tot > 0 THEN base_mwh / tot * 100.0e0 ELSE 33.3e0 END, 9) AS base_pct,
  round(CASE WHEN tot > 0 THEN total_pos_mwh / tot * 100.0e0 ELSE 33.3e0 END, 9) AS pos_pct,
  round(CASE WHEN tot > 0 THEN total_neg_mwh / tot * 100.0e0 ELSE 33.3e0 END, 9) AS neg_pct, round(diff, 9) AS diff_pct,
  CASE WHEN diff >= 0 THEN 'higher' ELSE 'lower' END AS relationship, {_label('top_driver')} AS top_driver,
  {_label('top_code_driver')} AS top_code_driver FROM h""",
    "win_waterfall": f"""WITH {_BASE}
SELECT row_id, feature, CAST(row_number() OVER w AS INTEGER) AS step, 0.0e0 + round(shap_value * 1000.0e0, 6) AS value_mwh,
  round((base_wh + sum(shap_value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * 1000.0e0, 6) AS cumulative_mwh
FROM attr WINDOW w AS (PARTITION BY row_id ORDER BY abs(shap_value) DESC, feature)""",
    "topk_per_group_avg": """WITH li AS (SELECT l_returnflag || l_linestatus AS category, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem)
SELECT category, round(avg(score), 6) AS avg_top_score, count(*) AS n FROM li WHERE rk <= 100 GROUP BY category""",
    "topk_correlated": """WITH c AS (UNPIVOT (SELECT corr(memory_mb, actual_wh) AS memory_mb, corr(latency_ms, actual_wh) AS latency_ms,
  corr(cold_start, actual_wh) AS cold_start, corr(quantity, actual_wh) AS quantity, corr(discount, actual_wh) AS discount,
  corr(tax, actual_wh) AS tax FROM v_pred) ON memory_mb, latency_ms, cold_start, quantity, discount, tax INTO NAME feature VALUE corr),
r AS (SELECT feature, corr, row_number() OVER (ORDER BY corr DESC, feature) AS rd, row_number() OVER (ORDER BY corr ASC, feature) AS ra FROM c)
SELECT 'top' AS kind, feature, round(corr, 9) AS corr FROM r WHERE rd <= 10
UNION ALL SELECT 'bottom', feature, round(corr, 9) FROM r WHERE ra <= 10""",
    "sort_table": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "win_spike_projection": f"""WITH {_SPIKE}
SELECT function_name, hour, req AS predicted_req_per_hour, round_even(req * energy_wh / 1000.0e0, 4) AS predicted_energy_kwh FROM sp""",
    "win_spike_totals": f"""WITH {_SPIKE},
t AS (SELECT function_name, CAST(sum(req) AS BIGINT) AS total_requests, first(energy_wh) AS e, first(cost_per_call) AS c FROM sp GROUP BY function_name)
SELECT function_name, total_requests, 200000.0e0 AS peak_req_per_hour, round_even(total_requests * e / 1000.0e0, 3) AS energy_kwh,
  round_even(total_requests * e / 1000.0e0 * 0.708e0, 3) AS carbon_kg, round_even(total_requests * c, 2) AS cost_inr FROM t""",
    "win_adjacent_pairs": """WITH d AS (SELECT DISTINCT CAST(o_custkey AS BIGINT) AS a FROM orders WHERE o_custkey IS NOT NULL)
SELECT count(*) AS pairs, CAST(sum(x.a + y.a) AS BIGINT) AS pair_sum FROM d x JOIN d y ON y.a = x.a + 2
WHERE NOT EXISTS (SELECT 1 FROM d z WHERE z.a = x.a + 1)""",
    "win_date_deltas": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(date_diff('day', lag(d) OVER (ORDER BY d), d) AS INTEGER) AS days_since_previous FROM d""",
    "fn_date_series": """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
s AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 5 DAY)) AS DATE) AS d FROM b)
SELECT strftime(d, '%Y-%m-%d') AS date, CAST(dayofweek(d) + 1 AS INTEGER) AS weekday FROM s""",
    "win_trapezoid": """WITH f AS (SELECT CAST(min(ts) AS DATE) AS d0 FROM events),
daily AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS y FROM events GROUP BY 1),
xy AS (SELECT CAST(date_diff('day', d0, d) AS INTEGER) AS x, y FROM daily, f),
seg AS (SELECT (y + lag(y) OVER (ORDER BY x)) / 2.0e0 * (x - lag(x) OVER (ORDER BY x)) AS a FROM xy)
SELECT round(sum(a), 9) AS area, count(a) AS segments FROM seg""",
    "win_grid_blur": f"""WITH {_GRID},
sp AS (SELECT g.r + o.dr AS r, g.c + o.dc AS c, v FROM grid g,
  (SELECT unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS dr, unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS dc) o),
b AS (SELECT r, c, sum(v) / 9.0e0 AS blurred FROM sp WHERE r >= 1 AND r <= 58 AND c >= 1 AND c <= 58 GROUP BY r, c),
t AS (SELECT sum(blurred) AS pixel_sum FROM b)
SELECT r, c, round(blurred, 9) AS blurred, round(pixel_sum, 9) AS pixel_sum FROM b, t WHERE r % 2 = 0 AND c % 2 = 0""",
    "agg_grid_sums": f"""WITH {_GRID}
SELECT 'row' AS dim, r AS idx, sum(v) AS total, NULL::DOUBLE AS min_v, NULL::DOUBLE AS max_v FROM grid GROUP BY r
UNION ALL SELECT 'col', c, sum(v), NULL, NULL FROM grid GROUP BY c
UNION ALL SELECT 'all', -1, sum(v), min(v), max(v) FROM grid""",
    "set_union_all": """SELECT c_name AS name, c_acctbal AS balance, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source FROM customer
UNION ALL SELECT s_name, s_acctbal, s_nationkey, NULL, 'supplier' FROM supplier""",
    "set_intersect3": f"WITH {_FLAGSETS} SELECT * FROM sa INTERSECT SELECT * FROM sn INTERSECT SELECT * FROM sr",
    "set_union_distinct": f"WITH {_FLAGSETS} SELECT * FROM sa UNION SELECT * FROM sn UNION SELECT * FROM sr",
    "set_except": f"WITH {_FLAGSETS} SELECT * FROM sa EXCEPT SELECT * FROM sn",
    "set_except_customers": "SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    "set_pairwise_overlap": f"""WITH {_MEMBERS},
ids AS (SELECT DISTINCT set_id FROM m),
pl AS (SELECT a.set_id AS set_a, b.set_id AS set_b FROM ids a JOIN ids b ON a.set_id < b.set_id),
ov AS (SELECT a.set_id AS set_a, b.set_id AS set_b, count(*) AS overlap FROM m a JOIN m b ON a.l_partkey = b.l_partkey AND a.set_id < b.set_id GROUP BY 1, 2),
r AS (SELECT pl.set_a, pl.set_b, coalesce(ov.overlap, 0) AS overlap FROM pl LEFT JOIN ov ON pl.set_a = ov.set_a AND pl.set_b = ov.set_b)
SELECT set_a, set_b, CAST(overlap AS BIGINT) AS overlap, round(avg(overlap) OVER (), 9) AS avg_overlap FROM r""",
    "agg_in_exactly_k": f"WITH {_MEMBERS} SELECT l_partkey FROM m GROUP BY l_partkey HAVING count(*) = 3",
    "agg_inverted_index": f"""WITH {_FLAGSETS}, common AS (SELECT * FROM sa INTERSECT SELECT * FROM sn INTERSECT SELECT * FROM sr),
pairs AS (SELECT DISTINCT p.p_brand, c.l_partkey FROM common c JOIN part p ON c.l_partkey = p.p_partkey WHERE p.p_brand IS NOT NULL)
SELECT p_brand, l_partkey, count(*) OVER (PARTITION BY p_brand) AS n_keys FROM pairs""",
}
