"""DuckDB SQL of the search, manifest and extraction queries."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL = f"""
with d as (select doc_id, {WORDS} ws from documents),
tot as (select count(*) filter (len(ws) > 0) nd, sum(len(ws))::BIGINT nl from d),
q as (select item_id, unnest({WORDS}) t from benchmark),
hits as (select doc_id, n, t, count(*) tf from (select doc_id, len(ws) n, unnest(ws) t from d) where t in (select t from q) group by all),
df as (select t, count(*) df from hits group by t),
part as (
  select doc_id, t, (floor(1000 * ln((2 * nd + 2) / (2 * df + 1)::DOUBLE)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))) s
  from hits join df using (t), tot),
score as (select item_id, doc_id, sum(s)::BIGINT score from q join part using (t) group by all having sum(s) > 0),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score)
select item_id, rank::INT as rank, doc_id, score from ranked where rank <= 20
"""

#: Levels of runs that the SQL has; 16**LEVELS leaves in a source, and sources.
LEVELS = 4


def _tree(name: str, nodes: str) -> str:
    """CTEs ``name``0.. of (tree, pos, d) and ``name``_r0.. of runs (tree, pos, ds)."""
    parts = [f"{name}0 as materialized (select tree, pos, d, count(*) over (partition by tree) c from ({nodes}))"]
    for k in range(LEVELS):
        parts.append(f"{name}_r{k} as materialized (select tree, pos // 16 pos, list(d order by pos) ds from {name}{k} where c > 1 group by all)")
        parts.append(f"""{name}{k + 1} as materialized (select *, count(*) over (partition by tree) c from (
  select tree, pos, sha256(array_to_string(ds, '')) d from {name}_r{k} union all select tree, pos, d from {name}{k} where c = 1))""")
    return ",\n".join(parts)


def _climb(name: str, start: str) -> str:
    """CTE of rows (..., tree, pos, sib, f) with siblings and folded digest taken up the levels."""
    parts = [f"{name}_up0 as ({start})"]
    for k in range(LEVELS):
        left, right = "array_to_string(ds[:u.pos % 16], '')", "array_to_string(ds[u.pos % 16 + 2:], '')"
        parts.append(f"""{name}_up{k + 1} as materialized (select u.* replace (u.pos // 16 as pos,
    case when ds is null then sib else sib || {left} || {right} end as sib,
    case when ds is null then f else sha256({left} || f || {right}) end as f)
  from {name}_up{k} u left join {name}_r{k} r on r.tree = u.tree and r.pos = u.pos // 16)""")
    return ",\n".join(parts)


def _leaf(text: str) -> str:
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
      lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384::UBIGINT else 0::UBIGINT end))))"""

MERKLE = f"""
with low as (select *, case when {CRC32} % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end lowered from documents),
leaves as materialized (
  select doc_id, dense_rank() over (order by source nulls first) - 1 tree, row_number() over (partition by source order by doc_id) - 1 pos,
    {_leaf("text")} leaf, {_leaf("lowered")} other from low),
{_tree("s", "select tree, pos, leaf d from leaves")},
{_tree("t", f"select 0 tree, tree pos, d from s{LEVELS}")},
{_climb("s", "select doc_id, leaf, tree, tree source, pos, '' sib, other f from leaves")},
{_climb("t", f"select doc_id, leaf, source, 0 tree, source pos, sib, f from s_up{LEVELS}")}
select doc_id, leaf, s.d subroot, r.d root, sha256(sib) proof_sha256, f folded_root, f = r.d verified
from t_up{LEVELS} u join s{LEVELS} s on s.tree = u.source, t{LEVELS} r
"""

#: For the given pages, whose article is one element.
HTML = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) body from pages),
-- lines: those of the article, the links of the menu, the advert and the footer
n as (select page_id, url, len(regexp_extract_all(html, '<li>')) + 2 +
    len(list_filter(string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)), lambda x: trim(x) != '')) as lines from pages),
b as (select page_id, url, unnest(string_split(regexp_replace(body, '</?(?:p|h1)>', chr(1), 'g'), chr(1))) line, generate_subscripts(string_split(regexp_replace(body, '</?(?:p|h1)>', chr(1), 'g'), chr(1)), 1) pos from a),
t as (select page_id, url, pos, trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g'), ' ') line from b)
select page_id, url, coalesce(string_agg(line, chr(10) order by pos) filter (line != ''), '') as text,
  length(coalesce(string_agg(line, chr(10) order by pos) filter (line != ''), ''))::BIGINT n_chars,
  any_value(lines)::BIGINT n_lines, 0::BIGINT n_shared
from t join n using (page_id, url) group by page_id, url
"""

ORACLES = {"op11_lexical_search": LEXICAL, "op12_merkle_manifest": MERKLE, "op13_html_extraction": HTML}
