"""Oracle SQL: workload-profile queries and scalar functions."""

import math

from wattline.functions.text import sql_loc_count

_ANGLE = f"(l_linenumber * {2.0 * math.pi!r} / 7.0e0)"

_RULE = """CASE WHEN x > 0.5 THEN
  CASE WHEN y < 0.3 THEN
    CASE WHEN z > 0.7 THEN CASE WHEN w = 'A' THEN CASE WHEN v % 2 = 0 THEN 1 ELSE 2 END ELSE 3 END
         ELSE CASE WHEN w = 'B' THEN 4 ELSE 5 END END
  ELSE CASE WHEN z < 0.4 THEN CASE WHEN w = 'A' THEN 6 ELSE 7 END ELSE 8 END END
ELSE
  CASE WHEN y > 0.6 THEN
    CASE WHEN z < 0.2 THEN CASE WHEN w = 'C' THEN 9 ELSE 10 END ELSE CASE WHEN w = 'A' THEN 11 ELSE 12 END END
  ELSE CASE WHEN z > 0.5 THEN CASE WHEN v % 3 = 0 THEN 13 ELSE 14 END ELSE 15 END END
END"""

SQL = {
    "agg_etl_category_totals": """WITH a AS (SELECT o_orderpriority AS category, o_totalprice * 1.12e0 / 0.95e0 AS new_val FROM orders WHERE o_orderstatus = 'O'),
t AS (SELECT category, count(*) AS transformed_rows, round(sum(new_val), 2) AS total FROM a GROUP BY category)
SELECT category, upper(category) AS category_upper, transformed_rows, total, (SELECT count(*) FROM orders) AS processed_rows FROM t""",
    "agg_frequency_stats": """WITH f AS (SELECT l_quantity AS x, count(*) AS freq FROM lineitem GROUP BY l_quantity),
t AS (SELECT x, freq, CAST(row_number() OVER (ORDER BY freq DESC, x) AS INTEGER) AS rank FROM f)
SELECT x, freq, rank, (SELECT round(avg(l_quantity), 9) FROM lineitem) AS mean,
  (SELECT round(var_pop(l_quantity), 9) FROM lineitem) AS variance FROM t WHERE rank <= 10""",
    "agg_count_if": """SELECT CAST(count_if(length(p_name) > 20) AS BIGINT) AS long_names, CAST(count_if(starts_with(p_type, 'ECONOMY')) AS BIGINT) AS economy_types,
  CAST(sum(p_size) AS BIGINT) AS size_sum FROM part""",
    "agg_rule_class_counts": f"""WITH b AS (SELECT l_discount * 10 AS x, l_tax / 0.08e0 AS y, (l_quantity - 1) / 49 AS z,
  CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'B' ELSE 'C' END AS w, l_linenumber AS v FROM lineitem)
SELECT {_RULE} AS class, count(*) AS n FROM b GROUP BY 1""",
    "fn_string_basic": """SELECT doc_id, substring(upper(replace(text, 'ß', 'SS')), 1, 10) AS upper10, substring(lower(text), 1, 10) AS lower10,
  substring(replace(replace(text, 'e', '3'), 'a', '4'), 1, 10) AS replaced10, substring(text, 11, 90) AS sub_10_100,
  CAST(len(string_split(text, 'a')) AS INTEGER) AS split_len FROM documents""",
    "fn_reverse_palindrome": """WITH w AS (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND word = reverse(word) GROUP BY word""",
    "fn_charclass_score": """SELECT conv_id, turn, (CASE WHEN regexp_matches(text, '\\p{Lu}') THEN 25 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 25 ELSE 0 END) AS score FROM conversations""",
    "fn_loc": f"""SELECT doc_id, CAST({sql_loc_count('text')} AS INTEGER) AS loc, CAST({sql_loc_count('text', False)} AS INTEGER) AS loc_gate FROM documents""",
    "fn_math": f"""SELECT l_returnflag, round(sum(sqrt(l_quantity) * ln(l_quantity)), 6) AS sqrt_log_sum, round(sum(sin({_ANGLE})), 6) AS sin_sum,
  round(sum(cos({_ANGLE})), 6) AS cos_sum, round(sum(CASE WHEN abs(cos({_ANGLE})) > 1e-5 THEN tan({_ANGLE}) END), 6) AS tan_sum
FROM lineitem GROUP BY l_returnflag""",
    "fn_array_hof": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, CAST(len(list_filter(e, lambda x: x > 0)) AS INTEGER) AS n_pos,
  round(list_reduce(list_prepend(0.0e0, list_transform(e, lambda x: x * 2.0e0)), lambda a, b: a + b), 6) AS sum_doubled,
  CAST(len(flatten([e, list_filter(e, lambda x: x > 0)])) AS INTEGER) AS flat_size FROM e""",
    "fn_json_roundtrip": """SELECT event_id, event_id >= 0 AS valid, CASE WHEN event_id >= 0 THEN value + 10.0e0 ELSE value END AS score,
  CASE WHEN event_id >= 0 THEN 'staging' ELSE 'production' END AS env, 4 AS n_tags, 'ap-south-1' AS region FROM events""",
    "fn_json_leaves": """WITH l AS (SELECT user_id, value AS leaf FROM events UNION ALL
  SELECT user_id, CAST(json_extract(props, '$.k') AS DOUBLE) FROM events)
SELECT user_id, count(leaf) AS leaves, round(sum(leaf), 6) AS leaf_sum, round(avg(leaf), 9) AS leaf_avg FROM l GROUP BY user_id""",
    "fn_hash_token": "SELECT conv_id, turn, sha256(text) AS token_hash FROM conversations",
    "fn_rounding": """SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 2) AS round_half_even,
  round(l_extendedprice / 7, 2) AS round_half_up, CAST(trunc(l_extendedprice / 7) AS BIGINT) AS truncated FROM lineitem""",
    "ml_naive_bayes_score": f"""WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS idx FROM embeddings),
p AS (SELECT label AS cls, idx, avg(x) AS mu, var_pop(x) + 1.0e0 AS var FROM e GROUP BY label, idx),
s AS (SELECT vec_id, cls, {math.log(0.33)!r} + sum(ln(greatest(1e-9, (1.0e0 / sqrt({2.0 * math.pi!r} * var)) * exp(-((x - mu) ^ 2) / (2.0e0 * var))))) AS score
  FROM e JOIN p USING (idx) GROUP BY vec_id, cls),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rk FROM s)
SELECT vec_id, cls AS predicted, round(score, 6) AS best_score FROM r WHERE rk = 1""",
}
