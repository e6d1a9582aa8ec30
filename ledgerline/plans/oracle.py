"""DuckDB SQL for the queries of ledgerline.plans.registry."""

from __future__ import annotations

BARS = """
bars AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS dt, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
wide AS (SELECT *, close / lag(close) OVER w - 1 AS ret, max(close) OVER (w ROWS UNBOUNDED PRECEDING) AS run_max,
  CASE WHEN count(*) OVER (w ROWS 49 PRECEDING) >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma_50,
  CASE WHEN count(*) OVER (w ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma_200,
  CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) + 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS upper_20,
  CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) - 2 * stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS lower_20,
  row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
newest AS (SELECT * FROM wide WHERE rn = 1)"""
MARKET = """
market AS (SELECT symbol, dt, close AS price, sma_50, sma_200,
  CASE WHEN sma_50 <> 0 AND sma_200 <> 0 AND close > sma_50 AND sma_50 > sma_200 THEN 'Bullish'
       WHEN sma_50 <> 0 AND sma_200 <> 0 AND close < sma_50 AND sma_50 < sma_200 THEN 'Bearish' ELSE 'Neutral' END AS ma_signal,
  CASE WHEN close > upper_20 THEN 'Overbought' WHEN close < lower_20 THEN 'Oversold' END AS band_signal FROM newest)"""
TREND = """
ends AS (SELECT symbol, arg_min(close, dt) AS a, arg_max(close, dt) AS b, count(*) AS n FROM wide WHERE rn <= 126 GROUP BY 1),
trend AS (SELECT symbol, (b - a) / a * 100 AS change_pct, CASE WHEN n < 2 THEN 'Insufficient data' WHEN (b - a) / a * 100 > 5 THEN 'Upward (6M)'
  WHEN (b - a) / a * 100 < -5 THEN 'Downward (6M)' ELSE 'Sideways (6M)' END AS trend FROM ends)"""
RISK = """
bench AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS b FROM orders GROUP BY 1),
pairs AS (SELECT symbol, bars.dt, close / lag(close) OVER w - 1 AS sr, b / lag(b) OVER w - 1 AS br FROM bars JOIN bench ON bars.dt = bench.dt WINDOW w AS (PARTITION BY symbol ORDER BY bars.dt)),
betas AS (SELECT symbol, covar_samp(sr, br) / var_pop(br) AS beta FROM pairs WHERE sr IS NOT NULL AND br IS NOT NULL GROUP BY 1),
falls AS (SELECT symbol, stddev_samp(ret) * sqrt(252) AS volatility, abs(min((close - run_max) / run_max)) * 100 AS max_drawdown_pct FROM wide GROUP BY 1),
risks AS (SELECT falls.*, beta, CASE WHEN max_drawdown_pct IS NULL THEN 'Unknown' WHEN max_drawdown_pct < 10 THEN 'Low' WHEN max_drawdown_pct < 20 THEN 'Medium' WHEN max_drawdown_pct < 30 THEN 'High' ELSE 'Very High' END AS severity
  FROM falls LEFT JOIN betas USING (symbol))"""
MACRO = """
months AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_tax) AS rate, avg(l_extendedprice / l_quantity) AS price_index FROM lineitem GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY dt DESC) AS rn, count(*) OVER () AS n FROM months),
rates AS (SELECT max(rate) FILTER (rn = 1) AS last, CASE WHEN max(n) > 6 THEN arg_min(rate, dt) ELSE max(rate) FILTER (rn = 1) END AS reference, max(n) AS n FROM placed),
rate_row AS (SELECT last, reference, CASE WHEN n <= 1 THEN 'Unknown' WHEN last > reference * 1.01 THEN 'Rising' WHEN last < reference * 0.99 THEN 'Falling' ELSE 'Stable' END AS trend FROM rates),
inflation AS (SELECT max(price_index) FILTER (rn = 1) AS last, coalesce(max(price_index) FILTER (rn = 12), arg_min(price_index, dt)) AS ref, max(n) AS n FROM placed),
inflation_row AS (SELECT (last - ref) / ref * 100 AS change_pct, CASE WHEN n <= 1 THEN 'Unknown' WHEN (last - ref) / ref * 100 > 3 THEN 'Elevated' WHEN (last - ref) / ref * 100 < 2 THEN 'Cooling' ELSE 'Moderate' END AS trend FROM inflation),
sector_months AS (SELECT p_type AS sector, CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, avg(l_extendedprice) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
sector_rows AS (SELECT sector, round((arg_max(close, dt) - arg_min(close, dt)) / arg_min(close, dt) * 100, 2) AS return_pct FROM sector_months GROUP BY 1 HAVING count(*) >= 2),
market_row AS (SELECT m AS mean_return_pct, CASE WHEN m IS NULL THEN 'Unknown' WHEN m > 5 THEN 'Strong' WHEN m > 0 THEN 'Positive' WHEN m > -5 THEN 'Weak' ELSE 'Negative' END AS market_trend FROM (SELECT avg(return_pct) AS m FROM sector_rows))"""
SCENARIOS = """
named AS (SELECT symbol, CASE WHEN ret > 0.5 THEN 'bull' WHEN ret < -0.3 THEN 'bear' ELSE 'base' END AS name, ret FROM wide WHERE ret IS NOT NULL),
raw AS (SELECT symbol, name, avg(ret) * CASE WHEN name = 'base' THEN 0.1 ELSE 0.2 END AS ret, CAST(count(*) AS DOUBLE) AS prob FROM named GROUP BY 1, 2),
scen AS (SELECT symbol, name, ret, prob / sum(prob) OVER (PARTITION BY symbol) AS prob FROM raw),
expected AS (SELECT symbol, sum(ret * prob) AS expected_return FROM scen GROUP BY 1)"""
MACD = f"""
h AS (SELECT symbol, list({{'f': close, 's': close, 'g': CAST(0 AS DOUBLE)}} ORDER BY dt) AS c FROM bars GROUP BY 1),
m AS (SELECT symbol, list_reduce(c, lambda a, b: {{'f': a.f + (b.f - a.f) * (2.0::DOUBLE / 13), 's': a.s + (b.f - a.s) * (2.0::DOUBLE / 27),
  'g': a.g + ((a.f + (b.f - a.f) * (2.0::DOUBLE / 13)) - (a.s + (b.f - a.s) * (2.0::DOUBLE / 27)) - a.g) * (2.0::DOUBLE / 10)}}) AS x FROM h),
macd_rows AS (SELECT symbol, round(x.f - x.s, 4) AS macd_line, round(x.g, 4) AS macd_smooth, CASE WHEN x.f - x.s > x.g THEN 'Bullish' ELSE 'Bearish' END AS macd_signal FROM m)"""
RSI = f"""
rd AS (SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS x, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS k FROM bars),
rs AS (SELECT symbol, avg(greatest(x, 0)) AS u, avg(greatest(-x, 0)) AS w FROM rd WHERE k BETWEEN 1 AND 14 GROUP BY 1),
rl AS (SELECT symbol, list({{'u': greatest(x, 0), 'w': greatest(-x, 0)}} ORDER BY k) AS c FROM rd WHERE k > 14 GROUP BY 1),
rr AS (SELECT symbol, list_reduce(list_concat([{{'u': u, 'w': w}}], c), lambda a, b: {{'u': (a.u * 13 + b.u) / 14, 'w': (a.w * 13 + b.w) / 14}}) AS x FROM rs JOIN rl USING (symbol)),
rsi_rows AS (SELECT symbol, round(CASE WHEN x.u + x.w = 0 THEN 50.0 ELSE 100 * x.u / (x.u + x.w) END, 6) AS rsi_14 FROM rr)"""
RANGE = f"""
v AS (SELECT symbol, arg_max(close, dt) AS price, max(close) AS high, min(close) AS low FROM wide WHERE rn <= 252 GROUP BY 1),
p AS (SELECT *, CASE WHEN price <> 0 AND high <> 0 AND low <> 0 AND high <> low THEN (price - low) / (high - low) END AS x FROM v),
range_rows AS (SELECT symbol, price, high, low, round(x, 6) AS position, CASE WHEN x > 0.7 THEN 'Near high' WHEN x < 0.3 THEN 'Near low' WHEN x IS NOT NULL THEN 'Mid range' END AS range_label FROM p)"""
REPORT = f"""WITH {BARS}, {MARKET}, {TREND}, {RISK}, {MACRO}, {SCENARIOS},
full_report AS (SELECT market.*, volatility, beta, max_drawdown_pct, severity, trend.trend, expected_return, rate_row.trend AS interest_rate_trend, inflation_row.trend AS inflation_trend, market_trend,
  round(least(1.0, greatest(0.0, 0.3 * (1.0 - CASE WHEN market_trend <> 'Unknown' THEN 0.0 ELSE 0.2 END - CASE WHEN volatility IS NULL THEN 0.2 ELSE 0.0 END - CASE WHEN expected_return IS NULL THEN 0.3 ELSE 0.0 END)
    + 0.28 + 0.3 * greatest(0.0, 1 - coalesce(volatility, 0.3)))), 2) AS confidence,
  CASE WHEN expected_return IS NULL THEN 'Hold' WHEN expected_return > 0.10 AND coalesce(volatility, 0.3) < 0.4 THEN 'Buy' WHEN expected_return < -0.05 OR coalesce(volatility, 0.3) > 0.5 THEN 'Sell' ELSE 'Hold' END AS recommendation
  FROM market LEFT JOIN risks USING (symbol) LEFT JOIN trend USING (symbol) LEFT JOIN expected USING (symbol), rate_row, inflation_row, market_row)"""
CALLS = """
calls AS (SELECT conv_id AS analysis_id, turn AS ts, ['gemini-2.5-flash', 'gemini-2.0-flash', 'gemini-2.5-pro', 'gemini-1.5-flash', 'gemini-pro', 'mistralai/Mistral-7B-Instruct-v0.2', 'unlisted-model'][conv_id % 7 + 1] AS model,
  CASE WHEN role = 'assistant' THEN 0 ELSE greatest(1, length(text) // 4) END AS prompt_tokens, CASE WHEN role = 'assistant' THEN greatest(1, length(text) // 4) ELSE 0 END AS completion_tokens, CAST(length(text) AS DOUBLE) AS latency_ms FROM conversations),
prices(model, p_in, p_out) AS (VALUES ('gemini-2.5-flash', 0.15::DOUBLE, 0.60::DOUBLE), ('gemini-2.0-flash', 0.10, 0.40), ('gemini-2.5-pro', 1.25, 5.00), ('gemini-1.5-flash', 0.075, 0.30), ('gemini-pro', 0.50, 1.50), ('mistralai/Mistral-7B-Instruct-v0.2', 0.10, 0.10)),
costs AS (SELECT calls.*, prompt_tokens + completion_tokens AS total_tokens, prompt_tokens / 1e6 * coalesce(p_in, 0.50) + completion_tokens / 1e6 * coalesce(p_out, 1.50) AS cost_usd FROM calls LEFT JOIN prices USING (model))"""
REGISTRY = """
registry AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'sec_filing' ELSE 'user_pdf' END AS source_type, upper(source) AS symbol, doc_id % 97 AS analysis_id,
  CASE WHEN doc_id % 3 = 0 THEN upper(source) || ' report ' || doc_id END AS title, lang || '_' || doc_id || '.pdf' AS filename, CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS DATE) AS updated_at, n_chars AS chunks FROM documents)"""
CHUNKS = """
chunks AS (SELECT doc_id, source, lang, CAST(i AS INTEGER) AS chunk_index, n AS total_chunks, substring(text, i * 1800 + 1, 2000) AS chunk FROM
  (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(1, CAST(ceil((length(text) - 200) / 1800.0) AS INTEGER)) AS n FROM documents WHERE length(text) > 0)))"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def section_ctes(texts: str = "documents") -> str:
    """filings and cut (doc_id, section, body) over a table with text and lang."""
    heads = {
        "risk_factors": (r"item\s+1a[\.\s\-—]+risk\s+factors(.*?)(?:item\s+1b|item\s+2)", r"risk\s+factors\s*\n(.*?)(?:item\s+1b|item\s+2|quantitative\s+and\s+qualitative)"),
        "mda": (r"item\s+7[\.\s\-—]+management.?s?\s+discussion\s+and\s+analysis(.*?)(?:item\s+7a|item\s+8)", r"management.?s?\s+discussion\s+and\s+analysis(.*?)(?:item\s+7a|item\s+8|financial\s+statements)"),
        "business": (r"item\s+1[\.\s\-—]+business(.*?)(?:item\s+1a|item\s+2)", r"(?:^|\n)business\s*\n(.*?)(?:item\s+1a|risk\s+factors)"),
    }
    parts = []
    for name, patterns in heads.items():
        tries = " ".join(f"WHEN regexp_matches(text, '(?is){p}') THEN regexp_extract(text, '(?is){p}', 1)" for p in patterns)
        parts.append(f"SELECT doc_id, '{name}' AS section, {STRIP.format(f'CASE {tries} END')} AS body FROM filings")
    return f"""filings AS (SELECT doc_id, 'Item 1. Business ' || lang || ' Item 1A. Risk Factors ' || text || ' Item 2. Properties Item 7. Management''s Discussion and Analysis ' || text || ' Item 8.' AS text FROM {texts}),
bodies AS ({" UNION ALL ".join(parts)}), cut AS (SELECT doc_id, section, CASE WHEN length(body) > 5000 THEN left(body, 5000) || chr(10) || '...[truncated]' ELSE body END AS body FROM bodies WHERE body <> '')"""


def html_sql() -> str:
    """Markup by a pattern without look-around: of a page's tags, raw elements and comments, the first that begins is cut out."""
    from ledgerline.functions.html import NAMED
    from ledgerline.functions.text import BLANKS

    attributes = r"""[^>=]*(?:=[\s=]*(?:"[^"]*"|''[^'']*'')?[^>=]*)*"""
    raw = "|".join(rf"<{n}(?:[\s/]{attributes})?>.*?(?:</{n}(?:[\s/][^>]*)?>|\z)" for n in ("script", "style"))
    markup = rf"<!--(?:-?>|.*?(?:--!?>|\z))|<!\[CDATA\[(.*?)\]\]>|(<[a-z/!?][^>]*\z)|{raw}|<[!?/][^>]*>|<[a-z]{attributes}>"
    reference = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][-.a-zA-Z0-9]*);?"
    listed = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
    known = f"MAP({listed(NAMED)}, {listed(NAMED.values())})"
    name = "CASE WHEN starts_with(lower(n), '#x') THEN chr(CAST('0x' || substring(n, 3) AS INTEGER)) WHEN starts_with(n, '#') THEN chr(CAST(substring(n, 2) AS INTEGER)) ELSE coalesce(map_extract(known, n)[1], '&' || n) END"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return rf"""WITH bare AS (SELECT page_id, url, regexp_replace(html, '{markup}', chr(10) || '\1\2' || chr(10), 'gsi') AS t FROM pages),
cut AS (SELECT page_id, url, string_split_regex(t, '{reference}') AS b, regexp_extract_all(t, '{reference}', 1) AS n, {known} AS known FROM bare),
joined AS (SELECT page_id, url, b[1] || array_to_string(list_transform(range(1, len(n) + 1), lambda i: list_transform([n[i]], lambda n: {name})[1] || b[i + 1]), '') AS t FROM cut)
SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, {blanks})), lambda x: x <> ''), chr(10)) AS text FROM joined"""


def chunk_ctes(texts: str, keys: str) -> str:
    """k (keys, a, chunk) over texts (keys, text), by recursion: a row a chunk, the next one beginning 200 characters before its end."""
    last = lambda mark: f"length(w) - nullif(instr(reverse(w), {mark}), 0) + 1"
    ends = f"coalesce({last(chr(39) + ' .' + chr(39))}, {last('chr(10) || chr(46)')}, {last('chr(10) || chr(10)')}, {last('chr(10)')})"
    cut = f"CASE WHEN a + 2000 < n THEN coalesce(a + 1000 + {ends}, a + 2000) ELSE a + 2000 END"
    window = "substring(text, {} + 1001, 1200)"
    return rf"""d AS (SELECT {keys}, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM {texts}),
s AS (SELECT {keys}, text, n, 0 AS a, {window.format(0)} AS w FROM d WHERE n > 2000),
c AS (SELECT {keys}, text, n, a, {cut} AS b FROM s UNION ALL
  SELECT {keys}, text, n, a, {cut} AS b FROM (SELECT {keys}, text, n, b - 200 AS a, {window.format("(b - 200)")} AS w FROM c WHERE b - 200 < n)),
p AS (SELECT {keys}, a, trim(substring(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) AS chunk FROM c),
k AS (SELECT {keys}, a, chunk FROM p WHERE chunk <> '' UNION ALL SELECT {keys}, 0, text FROM d WHERE n <= 2000)"""


#: Names, symbols and order of the company list.
def aliases_sql() -> str:
    from ledgerline.operators.resolve import COMPANIES

    return "aliases(ord, name, code) AS (VALUES " + ", ".join(f"({k}, '{n}', '{c}')" for k, (n, c) in enumerate(COMPANIES.items())) + ")"


def top_k_sql() -> str:
    return """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_dot_product(q.e, d.e) / (q.n * d.n) AS score FROM u q JOIN u d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 5) AS score FROM r WHERE rank <= 3"""


ORACLE: dict[str, str] = {
    "price_bars": f"WITH {BARS} SELECT * FROM bars",
    "simple_returns": f"WITH {BARS} SELECT symbol, dt, round(ret, 8) AS ret FROM wide WHERE ret IS NOT NULL",
    "sma_50_200": f"WITH {BARS} SELECT symbol, dt, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200 FROM wide",
    "ma_signal": f"WITH {BARS}, {MARKET} SELECT symbol, price, round(sma_50, 6) AS sma_50, round(sma_200, 6) AS sma_200, ma_signal FROM market",
    "price_trend": f"WITH {BARS}, {TREND} SELECT symbol, round(change_pct, 6) AS change_pct, trend FROM trend",
    "bollinger_signal": f"WITH {BARS}, {MARKET} SELECT symbol, dt, round(upper_20, 4) AS upper_20, round(lower_20, 4) AS lower_20, band_signal FROM newest JOIN market USING (symbol, dt)",
    "macd_signal": f"WITH {BARS}, {MACD} SELECT * FROM macd_rows",
    "rsi_14": f"WITH {BARS}, {RSI} SELECT * FROM rsi_rows",
    "range_position_52w": f"WITH {BARS}, {RANGE} SELECT * FROM range_rows",
    "volatility": f"WITH {BARS}, {RISK} SELECT symbol, round(volatility, 4) AS volatility FROM risks",
    "beta": f"WITH {BARS}, {RISK} SELECT symbol, round(beta, 6) AS beta FROM betas",
    "max_drawdown": f"WITH {BARS}, {RISK} SELECT symbol, round(max_drawdown_pct, 4) AS max_drawdown_pct, severity FROM risks",
    "risk_metrics": f"WITH {BARS}, {RISK} SELECT symbol, round(volatility, 4) AS volatility, round(beta, 6) AS beta, round(max_drawdown_pct, 4) AS max_drawdown_pct, severity FROM risks",
    "market_data": f"""WITH {BARS}, {MARKET}, {TREND}, {MACD}, {RSI}, {RANGE} SELECT symbol, dt, price, ma_signal, band_signal, rsi_14 AS rsi, macd_line, macd_signal, high AS high_52w, low AS low_52w, position, range_label, round(change_pct, 6) AS change_pct, trend
FROM market JOIN macd_rows USING (symbol) JOIN range_rows USING (symbol, price) JOIN trend USING (symbol) LEFT JOIN rsi_rows USING (symbol)""",
    "bars_since": f"WITH {BARS} SELECT * FROM bars WHERE dt >= DATE '1997-06-30' - INTERVAL 6 MONTH",
    "rate_trend_since": f"WITH {MACRO.replace('FROM lineitem GROUP BY 1)', "FROM lineitem WHERE l_shipdate >= DATE '1996-03-01' GROUP BY 1)", 1)} SELECT 'rate' AS series_id, round(last, 8) AS last, round(reference, 8) AS reference, trend FROM rate_row",
    "memo_prompt": f"""{REPORT} SELECT symbol, 'Memo on ' || symbol || ': ' || recommendation || ' at ' || printf('%.0f%%', round(confidence * 100)) || ', ' || trend || ', ' || interest_rate_trend || ', ' || market_trend || ', bull ' || printf('%+.0f%%', coalesce(round(bull_r * 100), 0)) || ' at ' || printf('%.0f%%', coalesce(round(bull_p * 100), 0)) AS prompt
FROM full_report LEFT JOIN (SELECT symbol, max(ret) FILTER (name = 'bull') AS bull_r, max(prob) FILTER (name = 'bull') AS bull_p FROM scen GROUP BY 1) USING (symbol)""",
    "chunk_count": f"WITH {CHUNKS} SELECT count(*) AS n FROM chunks WHERE source = 'src0'",
    "rate_trend": f"WITH {MACRO} SELECT 'rate' AS series_id, round(last, 8) AS last, round(reference, 8) AS reference, trend FROM rate_row",
    "inflation_trend": f"WITH {MACRO} SELECT 'price_index' AS series_id, round(change_pct, 6) AS change_pct, trend FROM inflation_row",
    "sector_performance": f"WITH {MACRO} SELECT * FROM sector_rows",
    "market_trend": f"WITH {MACRO} SELECT round(mean_return_pct, 6) AS mean_return_pct, market_trend FROM market_row",
    "scenario_normalize": f"WITH {BARS}, {SCENARIOS} SELECT symbol, name, round(ret, 6) AS ret, round(prob, 6) AS prob FROM scen",
    "expected_return": f"WITH {BARS}, {SCENARIOS} SELECT symbol, round(expected_return, 6) AS expected_return FROM expected",
    "confidence_score": f"{REPORT} SELECT symbol, confidence FROM full_report",
    "recommendation": f"{REPORT} SELECT symbol, round(expected_return, 6) AS expected_return, recommendation FROM full_report",
    "research_report": f"""{REPORT} SELECT symbol, dt, price, ma_signal, band_signal, round(volatility, 4) AS volatility, round(beta, 6) AS beta, round(max_drawdown_pct, 4) AS max_drawdown_pct, severity, trend,
round(expected_return, 6) AS expected_return, interest_rate_trend, inflation_trend, market_trend, confidence, recommendation FROM full_report""",
    "token_estimate": "SELECT role, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1",
    "call_cost": f"WITH {CALLS} SELECT analysis_id, ts, model, total_tokens, round(cost_usd, 9) AS cost_usd FROM costs",
    "telemetry_summary": f"""WITH {CALLS} SELECT analysis_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
round(sum(cost_usd), 6) AS total_cost_usd, round(sum(latency_ms), 1) AS total_latency_ms, count(*) AS num_calls FROM costs GROUP BY 1""",
    "eval_summary": """SELECT source AS agent, round(avg(quality * 5), 6) AS avg_relevance, round(avg(5 - toxic * 4), 6) AS avg_accuracy, round(avg(n_chars), 6) AS avg_latency_ms, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "resolver_accuracy": """SELECT lang AS intent, count(*) FILTER (quality = 1 AND toxic <> 1) AS correct, count(*) FILTER (toxic <> 1) AS total,
round(coalesce(100.0::DOUBLE * count(*) FILTER (quality = 1 AND toxic <> 1) / nullif(count(*) FILTER (toxic <> 1), 0), 0), 6) AS accuracy_pct FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "html_to_text": html_sql(),
    "extract_sections": f"WITH {section_ctes()} SELECT doc_id, section, length(body) AS chars, md5(body) AS digest FROM cut",
    "chunk_fixed": f"WITH {CHUNKS} SELECT doc_id, chunk_index, total_chunks, length(chunk) AS chars, md5(chunk) AS digest FROM chunks",
    "chunk_sentence": f"""WITH RECURSIVE {chunk_ctes("documents", "doc_id")}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, length(chunk) AS chars, md5(chunk) AS digest FROM k""",
    "chunk_ids": f"WITH {CHUNKS} SELECT doc_id, chunk_index, md5(upper(source) || '_' || lang || '_' || doc_id || '_' || chunk_index) AS chunk_id FROM chunks",
    "upsert_latest": """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus FROM r WHERE rn = 1""",
    "vector_topk": top_k_sql(),
    "vector_topk_approx": top_k_sql(),
    "context_build": """WITH r AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
c AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS t FROM r WHERE rank <= 3 GROUP BY 1), cut AS (SELECT source, CASE WHEN length(t) > 3000 THEN left(t, 3000) || chr(10) || '...[truncated]' ELSE t END AS t FROM c)
SELECT source, length(t) AS chars, md5(t) AS digest FROM cut""",
    "document_preview": rf"""WITH r AS (SELECT source, lang <> 'en' AS part, text, row_number() OVER (PARTITION BY source, lang <> 'en' ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
t AS (SELECT source, {STRIP.format("text")} AS text, min((part, rank)) AS place FROM r WHERE rank <= 4 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place) AS k FROM t WHERE text <> '')
SELECT source, CAST(count(*) AS INTEGER) AS preview_chunks, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k)) AS digest FROM n WHERE k <= 6 GROUP BY 1""",
    "freshness_check": f"""WITH {REGISTRY}, c AS (SELECT symbol || '-' || (id % 50) AS symbol, CASE WHEN analysis_id % 11 = 0 THEN NULL ELSE updated_at END AS dt FROM registry)
SELECT symbol, max(dt) AS newest, coalesce(max(dt) >= DATE '2025-04-25' - 90, false) AS recent FROM c GROUP BY 1""",
    "catalog_list": f"WITH {REGISTRY} SELECT id, symbol, updated_at, filename FROM registry WHERE symbol = 'SRC0' AND source_type = 'sec_filing' ORDER BY updated_at DESC, id LIMIT 200",
    "catalog_search": f"""WITH {REGISTRY} SELECT id, coalesce(nullif(title, ''), nullif(filename, ''), 'Untitled document') AS display_title, CASE WHEN source_type = 'sec_filing' THEN 'sec' ELSE 'other' END AS kind
FROM registry WHERE contains(lower(symbol || ' ' || coalesce(nullif(title, ''), nullif(filename, ''), '')), 'report 1')""",
    "history_page": "SELECT o_orderkey AS id, o_orderpriority AS symbol, o_orderdate AS created_at, o_totalprice AS score FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "delete_cascade": """SELECT 'analyses' AS part, c_custkey AS key FROM customer WHERE NOT c_acctbal < 0 UNION ALL
SELECT 'telemetry', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "ticker_shape": """WITH w AS (SELECT p_partkey, unnest([p_type, p_brand, upper(split_part(p_name, ' ', 1)), upper(split_part(p_name, ' ', -1)) || '-B']) AS word FROM part)
SELECT p_partkey, word, regexp_matches(word, '^[A-Z]{1,5}(-[A-Z]{1,2})?$') AS is_symbol, CASE WHEN regexp_matches(word, '^[A-Za-z0-9-]*$') THEN upper(word) ELSE word END AS typed FROM w""",
    "resolve_company": rf"""WITH {aliases_sql()}, q AS (SELECT p_partkey AS id, ['Apple stock outlook', 'coca-cola risk', 'aapl', 'brk-b', 'what about tesla and nvidia', 'some unknown firm', '  ', 'pineapple farms and intel'][p_partkey % 8 + 1] || CASE WHEN p_partkey % 16 < 8 THEN '' ELSE ' ' || p_name END AS query FROM part),
t AS (SELECT id, query, {STRIP.format("query")} AS s FROM q),
m AS (SELECT t.*, (SELECT arg_min(code, ord) FROM aliases WHERE name = lower(s)) AS same, (SELECT arg_min(code, ord) FROM aliases WHERE contains(lower(s), name)) AS part FROM t),
r AS (SELECT *, coalesce(same, part) AS code, CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(upper(s), '^[A-Z]{{1,5}}(-[A-Z]{{1,2}})?$') THEN 'symbol' WHEN coalesce(same, part) IS NOT NULL THEN 'company' ELSE 'model' END AS route FROM m)
SELECT id, query, CASE route WHEN 'symbol' THEN upper(s) WHEN 'company' THEN code END AS symbol, route, CAST(CASE route WHEN 'symbol' THEN 1.0 WHEN 'company' THEN 0.95 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN route = 'empty' THEN 'Empty query' END AS error FROM r""",
    "sentiment_label": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Neutral-positive' WHEN 'error' THEN 'Neutral-negative' WHEN 'click' THEN 'Neutral-positive' WHEN 'view' THEN 'Neutral-negative' ELSE 'Neutral' END AS sentiment FROM events",
    "json_fence_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "prompt_render": "SELECT c_custkey, 'Report on ' || CASE WHEN c_custkey % 5 = 0 THEN '{ticker} }}{{' ELSE c_name END || ' (' || c_mktsegment || '): confidence ' || c_nationkey || '%, {missing} and {braces}' AS prompt FROM customer",
    "prompt_latest_version": "SELECT p_name AS name, max(p_partkey) AS version, arg_max(p_brand, p_partkey) AS template FROM part GROUP BY 1",
    "filing_zip": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rank FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey AS symbol, CAST(rank AS INTEGER) AS rank, 'https://www.sec.gov/Archives/edgar/data/' || ltrim(lpad(CAST(l_orderkey AS VARCHAR), 10, '0'), '0') || '/' || l_partkey || l_suppkey || l_linenumber || '/' || l_linenumber || '.htm' AS url,
strftime(l_shipdate, '%Y-%m-%d') AS filing_date, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS accession_number FROM r WHERE rank <= 2""",
    "progress_events": "SELECT user_id AS run_id, ts, CASE WHEN event_type = 'view' THEN 'system' ELSE event_type END AS step, CASE WHEN event_type = 'view' THEN 'plain ' || event_id ELSE '[' || event_type || '] step ' || event_id || ' [x]' END AS message FROM events",
    "stale_gaps": """WITH g AS (SELECT user_id AS run_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_ts, ts AS to_ts FROM events)
SELECT run_id, from_ts, to_ts, (epoch_us(to_ts) - epoch_us(from_ts)) / 1e6 AS gap_seconds FROM g WHERE from_ts IS NOT NULL AND (epoch_us(to_ts) - epoch_us(from_ts)) / 1e6 > 600""",
    "terminal_events": "SELECT user_id AS run_id, arg_max(ts, (ts, event_type)) AS ts, arg_max(event_type, (ts, event_type)) AS step FROM events GROUP BY 1",
}
