"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

URL_FILTER = r"""WITH h AS (SELECT page_id, nullif(lower(regexp_replace(url_decode(regexp_extract(regexp_replace(regexp_extract(replace(regexp_replace(url, '^[\x00-\x20]+|[\t\r\n]', '', 'g'), '\', '/'),
    '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//+([^/?#]*)', 1), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1)), '\.+$', '')), '') AS host,
  CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS fetch_date FROM pages),
listed AS (SELECT DISTINCT host, CAST(DATE '2024-01-01' + CAST((7 * length(host)) % 365 AS INTEGER) AS DATE) AS day FROM h WHERE host IS NOT NULL AND length(host) % 3 = 0),
entries AS (SELECT host AS domain, day AS since, true AS active, 'host' AS category FROM listed UNION SELECT host, CAST(day + 120 AS DATE), false, 'host' FROM listed
  UNION SELECT regexp_replace(host, '^[^.]*\.', ''), CAST(day + 200 AS DATE), true, 'parent' FROM listed WHERE len(string_split(host, '.')) >= 3),
daily AS (SELECT domain, category, since, min(active) AS active FROM entries GROUP BY ALL),
held AS (SELECT *, lead(since) OVER (PARTITION BY domain, category ORDER BY since) AS until FROM daily),
asked AS (SELECT DISTINCT host, fetch_date FROM h WHERE host IS NOT NULL),
parts AS (SELECT host, fetch_date, string_split(host, '.') AS l, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM asked),
hits AS (SELECT p.host, p.fetch_date, domain, category, since FROM parts p JOIN held ON domain = array_to_string(l[i:], '.') WHERE active AND p.fetch_date >= since AND (until IS NULL OR p.fetch_date < until)),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY host, fetch_date ORDER BY length(domain) DESC, since DESC, category NULLS FIRST) = 1)
SELECT page_id, h.host, h.fetch_date, domain IS NOT NULL AS blocked, domain AS matched_domain, category, since AS listed_since FROM h LEFT JOIN best ON h.host = best.host AND h.fetch_date = best.fetch_date"""


def _rendered(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda turn_: '<|' || turn_.r || '|>' || chr(10) || turn_.t || chr(10)), '')"


def _mask(turns: str) -> str:
    start = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda turn_: 6 + length(turn_.r) + length(turn_.t))), 0)::BIGINT + 5 + length({turns}[i].r)"
    return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].r = 'assistant'), lambda i: ({start}) || ':' || ({start} + length({turns}[i].t))), ',')"


CHAT = f"""WITH t AS (SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
l AS (SELECT conv_id, max(turn) AS last, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM t GROUP BY 1),
ends AS (SELECT a.conv_id, a.last, b.role, b.text FROM l a JOIN l b ON b.conv_id = a.conv_id + 1),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn) AS c FROM t GROUP BY 1),
j AS (SELECT t.conv_id, turn, t.role, t.text FROM t JOIN ends ON t.conv_id = ends.conv_id WHERE turn < last UNION ALL SELECT conv_id, last, role, text FROM ends),
s AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn) AS s FROM j GROUP BY 1),
r AS (SELECT conv_id, list_transform(s, lambda x, i: {{'r': x.r, 't': CASE WHEN conv_id % 3 = 1 AND i - 1 = conv_id % len(s) THEN x.t || '?' ELSE x.t END}}) AS r FROM s),
b AS (SELECT c.conv_id AS pair_id, c, r, CAST(coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1, least(len(c), len(r))) AS INTEGER) AS k FROM c JOIN r ON c.conv_id = r.conv_id),
cut AS (SELECT pair_id, k, c[1:k] AS p, c[k + 1:] AS c, r[k + 1:] AS r FROM b)
SELECT pair_id, k AS prompt_turns, {_rendered("p")} AS prompt, {_rendered("c")} AS chosen, {_mask("c")} AS chosen_mask, {_rendered("r")} AS rejected, {_mask("r")} AS rejected_mask FROM cut"""


def _matches(kind: int, pattern: str, least: int, group: int = 0, keep: str = "true") -> str:
    """Spans of a pattern as rows (row, kind, a, b, v): places from the pieces between matches."""
    lists = f"SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{pattern}')"
    sizes = "CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"SELECT row, {kind} AS kind, {sizes} AS a, {sizes} + length(m[i]) AS b, v[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({lists})) WHERE length(v[i]) >= {least} AND {keep}"


def _secrets() -> str:
    assign = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    listed = lambda what: f"coalesce(string_agg({what}, ',' ORDER BY a, kind), '')"
    name = "['assign', 'access', 'hex', 'value'][kind + 1] || ':' || a || ':' || b"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS text FROM documents),
s AS ({_matches(0, assign, 8, 2)} UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 16)} UNION ALL {_matches(2, "[0-9a-f]+", 32)}
  UNION ALL {_matches(3, "[A-Za-z0-9+/_-]+", 8, 0, "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')")}),
t AS (SELECT *, trim(v, '.=+/_-') AS bare FROM s), u AS (SELECT DISTINCT bare FROM t),
w AS (SELECT bare, list_sum([-p * log2(p) for p in list_transform(list_distinct(string_split(bare, '')), lambda c: (length(bare) - length(replace(bare, c, ''))) / length(bare))]) AS bits FROM u WHERE bare <> ''),
x AS (SELECT bare, NOT regexp_matches(lower(bare), 'example|changeme|change_me|placeholder|dummy|sample|your|xxxx|1234567|abcdef|password|secret') AND bits >= 2.5 AS random,
  regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[a-z]') AND regexp_matches(bare, '[A-Z]') AND length(bare) >= 20 AND bits >= 3.5 AS mixed FROM w),
held AS (SELECT bare, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories, max(kind < 3) AS known FROM t JOIN d USING (row) GROUP BY 1),
ruled AS (SELECT bare, CASE WHEN owners >= 3 OR repositories >= 5 THEN 'example' WHEN coalesce(random, false) AND (mixed OR known) THEN 'live' ELSE 'weak' END AS verdict FROM held LEFT JOIN x USING (bare)),
every AS (SELECT t.row, kind, a, b, verdict FROM t JOIN ruled USING (bare) WHERE kind < 3 OR verdict = 'live' AND NOT EXISTS (SELECT 1 FROM t o WHERE o.row = t.row AND o.kind < 3 AND o.a < t.b AND t.a < o.b))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, sha256(coalesce(string_agg({name}, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
  {listed(name)} AS spans, {listed("verdict")} AS verdicts, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM d LEFT JOIN every USING (row) GROUP BY d.row, doc_id"""


_DRAW = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
MIDDLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS l FROM d),
n AS (SELECT doc_id, t, l, len(l) AS n, {_DRAW.format(1)} % (len(l) + 1) AS a, {_DRAW.format(9)} % (len(l) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= 50 THEN 'plain' WHEN {_DRAW.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
c AS (SELECT doc_id, t, n, form, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""


def _terms(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_terms("text")} AS l FROM documents),
held AS (SELECT row, doc_id, l, len(l) AS n FROM d WHERE len(l) > 0), c AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM held),
asked AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(l) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
s AS (SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term), c WHERE doc_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLE = {"op2_topk": TOP_K, "op3_url_filter": URL_FILTER, "op10_chat": CHAT, "op11_secrets": _secrets(), "op12_middle": MIDDLE, "op13_lexical": LEXICAL}
