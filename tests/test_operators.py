"""Hand-made frames: thresholds at their bounds, nulls, ties, empty tables."""

import datetime as dt
import random
import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import formats, html
from ledgerline.functions import text as X
from ledgerline.operators import catalog, decision, documents, evaluation, macro, model_steps, prices, progress, prompts, recursive, resolve, risk, telemetry, vectors
from ledgerline.sources import schemas, sinks, tables


def bars(spark, closes, symbol="A"):
    rows = [(symbol, dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, dt date, close double")


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(("change", "label"), [(5.0, "Sideways (6M)"), (5.01, "Upward (6M)"), (-5.0, "Sideways (6M)"), (-5.01, "Downward (6M)")])
def test_trend_bounds(spark, change, label):
    assert spark.range(1).select(prices.trend_label(F.lit(change), 6).alias("x")).first()["x"] == label


def test_short_histories(spark):
    assert one(prices.price_trend(bars(spark, [1.0])))["trend"] == "Insufficient data"
    wide = prices.enriched(bars(spark, [float(i) for i in range(1, 51)])).orderBy("dt").collect()
    assert wide[48]["sma_50"] is None and wide[49]["sma_50"] == 25.5 and wide[49]["sma_200"] is None
    assert wide[0]["ret"] is None and wide[1]["ret"] == 1.0
    assert prices.enriched(bars(spark, [0.0, 1.0])).orderBy("dt").collect()[1]["ret"] is None
    assert prices.enriched(bars(spark, [])).count() == 0


@pytest.mark.parametrize(("pct", "name"), [(None, "Unknown"), (9.99, "Low"), (10.0, "Medium"), (20.0, "High"), (30.0, "Very High")])
def test_severity_bounds(spark, pct, name):
    assert spark.range(1).select(risk.severity(F.lit(pct).cast("double")).alias("x")).first()["x"] == name


def test_risk_against_pandas(spark):
    closes = [10.0, 11.0, 9.0, 12.0, 12.0, 8.0]
    base = [5.0, 6.0, 5.5, 7.0, 6.0, 6.5]
    b = bars(spark, closes)
    m = bars(spark, base).select("dt", "close").where(F.col("dt") != dt.date(2024, 1, 3))
    got = one(risk.risk_metrics(b, m))
    s = pd.Series(closes)
    assert got["volatility"] == pytest.approx(s.pct_change().std() * 252**0.5)
    assert got["max_drawdown_pct"] == pytest.approx(100 * (1 - 8 / 12))
    both = pd.DataFrame({"s": closes, "b": base}).drop(2).pct_change().dropna()
    assert got["beta"] == pytest.approx(both.s.cov(both.b) / both.b.var(ddof=0))
    assert one(risk.beta(b, m))["beta"] == pytest.approx(got["beta"])
    flat = bars(spark, [5.0] * 6).select("dt", "close")
    assert one(risk.risk_metrics(b, flat))["beta"] is None


def plain_indicators(closes):
    """(line, signal, index) by running through the closes."""
    s = pd.Series(closes)
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    change = s.diff().dropna()
    up, down = change.clip(lower=0), (-change).clip(lower=0)
    u, d = up[:14].mean(), down[:14].mean()
    for x, y in zip(up[14:], down[14:], strict=True):
        u, d = (u * 13 + x) / 14, (d * 13 + y) / 14
    return line.iloc[-1], line.ewm(span=9, adjust=False).mean().iloc[-1], None if len(closes) < 15 else 50.0 if u + d == 0 else 100 * u / (u + d)


@pytest.mark.parametrize("size", [1, 2, 7, 14, 15, 16, 512])
def test_recursive_against_pandas(spark, size):
    """Blocks of every size around the first average give the plain run, over several symbols at once."""
    histories = {"long": [float(50 + (i * 37) % 23 - i % 7) for i in range(180)], "short": [5.0, 6.5] * 7, "one": [3.0], "flat": [2.0] * 40, "rise": [float(i) for i in range(1, 30)], "edge": [1.0, 2.0, 1.5] * 5}
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), c) for s, closes in histories.items() for i, c in enumerate(closes)]
    rows += [("long", dt.date(2023, 1, 1), None), ("long", dt.date(2025, 1, 1), float("nan")), ("none", dt.date(2024, 1, 1), None)]
    frame = spark.createDataFrame(rows, "symbol string, dt date, close double")
    got = {r["symbol"]: r for r in recursive.indicators(frame, F.floor(F.unix_date("dt") / size)).collect()}
    assert set(got) == set(histories)
    for symbol, closes in histories.items():
        line, signal, index = plain_indicators(closes)
        assert got[symbol]["macd"]["line"] == pytest.approx(line, abs=1e-9) and got[symbol]["macd"]["signal"] == pytest.approx(signal, abs=1e-9)
        assert got[symbol]["rsi"] == (None if index is None else pytest.approx(index))


def test_ten_million_bars_of_one_symbol(spark):
    """No task holds the history: the largest array is a block, and the plain run over the last bars alone gives the same numbers."""
    n, close = 10_000_000, lambda i: 100.0 + (i * 7919) % 1009 / 100 + (i // 1000) % 50
    i = F.col("id")
    bars = spark.range(n).select(F.lit("X").alias("symbol"), i.alias("dt"), (F.lit(100.0) + (i * 7919) % 1009 / 100 + F.floor(i / 1000) % 50).alias("close"))
    assert recursive.blocks(bars, F.floor(F.col("dt") / 512)).agg(F.max("n")).first()[0] == 512
    got = one(recursive.indicators(bars, F.floor(F.col("dt") / 512)))
    line, signal, index = plain_indicators([close(k) for k in range(n - 4000, n)])
    assert got["macd"]["line"] == pytest.approx(line) and got["macd"]["signal"] == pytest.approx(signal) and got["rsi"] == pytest.approx(index)


def series(spark, name, values):
    return spark.createDataFrame([(name, dt.date(2023, 1, 1) + dt.timedelta(days=31 * i), v) for i, v in enumerate(values)], "series_id string, dt date, value double")


@pytest.mark.parametrize(("values", "trend"), [([1.0], "Unknown"), ([1.0] * 5 + [9.0], "Stable"), ([1.0] * 6 + [1.02], "Rising"), ([1.0] * 6 + [1.01], "Stable"), ([1.0] * 6 + [0.98], "Falling")])
def test_rate_trend(spark, values, trend):
    assert one(macro.rate_trend(series(spark, "rate", values)))["trend"] == trend


def test_inflation_uses_eleven_steps(spark):
    got = one(macro.inflation_trend(series(spark, "price_index", [50.0] + [100.0] + [1.0] * 10 + [103.5])))
    assert got["change_pct"] == pytest.approx(3.5) and got["trend"] == "Elevated"
    assert one(macro.inflation_trend(series(spark, "price_index", [100.0, 102.0])))["trend"] == "Moderate"
    assert one(macro.inflation_trend(series(spark, "price_index", [100.0, 101.9])))["trend"] == "Cooling"


@pytest.mark.parametrize(("mean", "label"), [(None, "Unknown"), (5.01, "Strong"), (5.0, "Positive"), (0.0, "Weak"), (-5.0, "Negative")])
def test_market_trend(spark, mean, label):
    rows = spark.createDataFrame([] if mean is None else [("x", mean)], "sector string, return_pct double")
    assert one(macro.market_trend(rows))["market_trend"] == label


def scen(spark, rows):
    return spark.createDataFrame(rows, "symbol string, name string, ret double, prob double")


def test_scenarios(spark):
    got = {(r["symbol"], r["name"]): r["prob"] for r in decision.normalized(scen(spark, [("A", "bull", 0.1, 1.0), ("A", "base", 0.0, 3.0), ("B", "bull", 0.1, 0.0), ("C", "bull", 0.1, None), ("C", "bear", 0.1, 1.0)])).collect()}
    assert got["A", "bull"] == 0.25 and got["B", "base"] == 0.5 and got["C", "bear"] == 0.2 and len(got) == 8
    assert one(decision.expected_return(scen(spark, [("A", "bull", None, 1.0), ("A", "base", 0.2, 0.5)])))["expected_return"] == 0.1


@pytest.mark.parametrize(("er", "vol", "want"), [(0.11, 0.3, "Buy"), (0.10, 0.3, "Hold"), (0.11, 0.4, "Hold"), (-0.05, 0.5, "Hold"), (-0.051, 0.1, "Sell"), (0.2, 0.51, "Sell"), (None, 0.9, "Hold"), (0.2, None, "Buy")])
def test_recommendation(spark, er, vol, want):
    assert spark.range(1).select(decision.recommendation(F.lit(er).cast("double"), F.lit(vol).cast("double")).alias("x")).first()["x"] == want


def test_confidence(spark):
    row = spark.range(1).select(decision.confidence(decision.completeness(F.lit(True), F.lit(True), F.lit(None).cast("boolean"), F.lit(True)), F.lit(None).cast("double")).alias("x")).first()
    assert row["x"] == pytest.approx(0.73)


def boundary_ends(text):
    """For each mark, the places behind its occurrences."""
    return [[m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)] for mark in (". ", ".\n", "\n\n", "\n")]


def check_chunks(text, chunks):
    """Holds chunks against the rule: each ends behind the last mark of its window, of the best kind there, and overlaps the next."""
    if len(text) <= 2000:
        assert chunks == [text]
        return
    ends, a, left = boundary_ends(text), 0, list(chunks)
    while a < len(text):
        inside = [[e for e in places if e - len(mark) >= a + 1000 and e <= a + 2200] for mark, places in zip((". ", ".\n", "\n\n", "\n"), ends, strict=True)]
        best = next((max(places) for places in inside if places), a + 2000)
        b = best if a + 2000 < len(text) else a + 2000
        if piece := text[a:b].strip():
            assert left.pop(0) == piece
        a = b - 200
    assert not left


def test_sentence_chunks_by_the_rule(spark):
    rng = random.Random(2)
    texts = ["", "x", "y" * 2000, "y" * 2001, " " * 5000, ("Sentence one is here. " * 3000).strip(), "\xe9\U0001f600. " * 2500]
    texts += ["".join(rng.choices(letters, weights, k=rng.randrange(1900, 9000))) for letters, weights in (("ab. \n", (200, 200, 3, 30, 3)), ("ab\n", (500, 500, 1)), ("a. ", (9, 1, 2)), ("a \n\x1f", (1, 1, 1, 1))) for _ in range(12)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string").withColumns({c: F.lit("clash") for c in ("chunk_index", "chunk", "tiles", "chars")})
    chunks = documents.sentence_chunk_rows(frame)
    assert chunks.columns == ["id", "tiles", "chars", "total_chunks", "chunk_index", "chunk"]
    got = {}
    for r in chunks.orderBy("id", "chunk_index").collect():
        assert r["tiles"] == "clash" and r["chunk_index"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["chunk"])
    for i, t in enumerate(texts):
        check_chunks(t, got.get(i, []))
    assert got[len(texts)] == [""]


#: Sections as patterns over the whole text: the heading, the body, the nearest end.
SECTION_PATTERNS = {
    "risk_factors": (r"item\s+1a[.\s\-\u2014]+risk\s+factors(.*?)(?=item\s+1b|item\s+2)", r"risk\s+factors\s*\n(.*?)(?=item\s+1b|item\s+2|quantitative\s+and\s+qualitative)"),
    "mda": (r"item\s+7[.\s\-\u2014]+management.?s?\s+discussion\s+and\s+analysis(.*?)(?=item\s+7a|item\s+8)", r"management.?s?\s+discussion\s+and\s+analysis(.*?)(?=item\s+7a|item\s+8|financial\s+statements)"),
    "business": (r"item\s+1[.\s\-\u2014]+business(.*?)(?=item\s+1a|item\s+2)", r"(?:^|\n)business\s*\n(.*?)(?=item\s+1a|risk\s+factors)"),
}


def plain_sections(text):
    out = {}
    for name, patterns in SECTION_PATTERNS.items():
        found = next((m for m in (re.search(p, text, re.DOTALL | re.IGNORECASE) for p in patterns) if m), None)
        body = found[1].strip() if found else ""
        if body:
            out[name] = body if len(body) <= 5000 else body[:5000] + X.TRUNCATED
    return out


def test_sections_as_patterns(spark):
    """Texts of shuffled headings and marks, with all that stands between them."""
    rng = random.Random(5)
    words = ["Item 1", "item\xa01A", "ITEM  1b", "Item 2", "item 20", "Item 7", "item 7a", "Item 8", "Risk Factors", "risk\n factors", "Management's Discussion and Analysis", "management discussion\nand analysis", "MANAGEMENT\u2019S DISCUSSION AND ANALYSIS"]
    words += ["Quantitative and Qualitative", "financial  statements", "business", "Business", "\nbusiness", "rI\u017fk factors", "item", "1a", "body text", "x" * 30, "\x01", "\x02", "$0 \\"]
    joints = [" ", "\n", ". ", " - ", "\u2014", "", "\n\n", " \n ", ".\n", "\x1c", " and "]
    texts = ["".join(w for _ in range(rng.randrange(3, 40)) for w in (rng.choice(words), rng.choice(joints))) for _ in range(1500)] + ["", "business\nx item 1a", "Item 1. Business item 2"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in documents.sections(frame).collect():
        got.setdefault(r["id"], {})[r["section"]] = r["section_text"]
    wrong = [(t, got.get(i, {}), plain_sections(t)) for i, t in enumerate(texts) if got.get(i, {}) != plain_sections(t)]
    assert not wrong, (len(wrong), wrong[0])
    assert sum(map(len, got.values())) > 800


def test_fallback_calls_each_model_once(spark, tmp_path):
    def model(name, keep, status=None):
        def ask(prompts):
            with open(tmp_path / name, "a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            answers = prompts.map(lambda p: name if keep(int(p)) else None)
            return answers if status is None else pd.DataFrame({"answer": answers, "status": prompts.map(lambda p: status(int(p)))})

        return ask

    models = [model("a", lambda p: p % 10 < 5, lambda p: 403 if p % 10 == 9 else 429), model("b", lambda p: p % 10 < 8), model("c", lambda p: False)]
    rows = spark.range(100).select(F.col("id").cast("string").alias("prompt"))
    got = {int(r["prompt"]): (r["answer"], r["answer_outcome"]) for r in model_steps.with_fallback(rows, "prompt", models).where("latency_ms >= 0").collect()}
    want = lambda p: ("a", "done") if p < 5 else ("b", "done") if p < 8 else (None, "failed") if p < 9 else (None, "stopped")
    assert got == {p: want(p % 10) for p in range(100)}
    assert [len((tmp_path / n).read_text().split()) for n in "abc"] == [100, 40, 10]


def test_fixed_chunks(spark):
    rows = spark.createDataFrame([("",), (None,), ("x" * 2000,), ("y" * 2001,)], "text string").select(F.length("text").alias("n"), documents.fixed_chunks(F.col("text")).alias("c")).collect()
    assert [len(r["c"]) for r in rows] == [0, 0, 1, 2]


class PlainPage(HTMLParser):
    """Texts of a page as the parser of the standard library finds them, one an element and stretch."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.texts, self.now, self.silent = [], [], 0
        self.feed(page)
        self.close()
        self.part()

    def part(self, *_):
        self.texts += ["".join(self.now)] if self.now and not self.silent else []
        self.now = []

    handle_comment = handle_decl = handle_pi = handle_startendtag = part

    def handle_starttag(self, tag, attrs):
        self.part()
        self.silent += tag in html.SILENT

    def handle_endtag(self, tag):
        self.part()
        self.silent = max(0, self.silent - (tag in html.SILENT))

    def handle_data(self, data):
        self.now.append(data)

    def handle_charref(self, name):
        n = int(name[1:], 16) if name[0] in "xX" else int(name)
        old = bytes([n]).decode("cp1252", "ignore") if n < 256 else ""
        self.now.append(old or (chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"))

    def handle_entityref(self, name):
        self.now.append(html.NAMED.get(name, "&" + name))

    @property
    def text(self):
        return "\n".join(x for x in (line.strip() for line in "\n".join(self.texts).split("\n")) if x)


PAGES = [
    '<p title="a>b">x</p> it&#8217;s &eacute; 5 < 6 and 7 > 2 <b>bold</b>', "a<!-- <b> x --> b<!---->c", '<script>if (a<b) "</p>"</script>t<STYLE a=b>p{}</Style >u<script src="x"/>v', "x &#x110000; &#128; &#129; &#xD800; &bogus; &copy 2020 &amp;lt; &nbsp;end&nbsp;",
    "<p it's>q</p>", "<a href='x>y' b=\"u'v>\" c=d>z</a>", "<!DOCTYPE html><?xml v?>k</p >l", "a<br/>b<br />c &#0038;&#x26;", "1 <2 <3> 4", "a&lt;b&gt;c &notin; &ApplyFunction;", '<p class="x"">y', "", "no markup", " \x1c \u2003 x \r\n\xa0 y\x85",
    "<html><SCRIPT>x<y</SCRIPT ><style>p{}</style><!-- c --><p> a &amp;lt; b</p>\n\n<br>c&nbsp;</html>",
]


def test_html(spark):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(PAGES)] + [(99, None)], "k int, h string")
    got = dict(map(tuple, rows.select("k", html.html_to_text(F.col("h"))).collect()))
    assert got[0] == "x\nit\u2019s \xe9 5 < 6 and 7 > 2\nbold"
    for k, page in enumerate(PAGES):
        assert got[k] == PlainPage(page).text, page
    assert got[99] is None


def test_html_as_the_standard_parser_reads_it(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", html.html_to_text(F.col("html"))).collect()
    assert all(text == PlainPage(page).text for page, text in rows)


def test_html_that_never_ends(spark):
    pages = ["a <b c" + " <d" * 50_000, "a <!-- " + "<!-- " * 50_000, "<script>" * 50_000, "<p a=" * 50_000, "&amp" * 50_000, "<![CDATA[ <x>&gt;]]>y", "one <p two"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, h string").select("k", html.html_to_text(F.col("h")).alias("t"))
    began = time.time()
    got = [r["t"] for r in rows.orderBy("k").collect()]
    assert time.time() - began < 60
    assert got[0] == "a\n<b c" + " <d" * 50_000 and got[1:3] == ["a", ""] and got[4] == "&" * 50_000 and got[5:] == ["<x>>\ny", "one\n<p two"]


def test_sections(spark):
    text = "Item 1A. Risk Factors  " + "r" * 5001 + " Item 2. Item 7 - Management’s Discussion and Analysis ok Item 8"
    got = {r["section"]: r["section_text"] for r in documents.sections(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, text string")).collect()}
    assert got == {"risk_factors": "r" * 5000 + X.TRUNCATED, "mda": "ok"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, t long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, t long")
    once = documents.upsert(old, new, ["id"], ["t"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, documents.upsert(once, new, ["id"], ["t"]).collect())) == sorted(map(tuple, once.collect()))


def test_registry_merge_and_ids(spark):
    old = spark.createDataFrame([("x", dt.datetime(2024, 1, 1), "t", None)], "id string, created_at timestamp, title string, chunks long")
    new = spark.createDataFrame([("x", dt.datetime(2025, 1, 1), None, 4)], "id string, created_at timestamp, title string, chunks long")
    assert tuple(documents.merge_registry(old, new).select("id", "title", "chunks").first()) == ("x", "t", 4)
    ids = spark.range(1).select(documents.registry_id(F.lit("sec"), F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("a"), F.md5(F.lit("sec:A:unknown")).alias("b")).first()
    assert ids["a"] == ids["b"]


def test_freshness(spark):
    rows = spark.createDataFrame([("A", "2024-01-01"), ("A", "bad"), ("B", None), ("C", "2024-03-31")], "symbol string, filing_date string")
    assert {r["symbol"]: r["recent"] for r in documents.has_recent(rows, "2024-03-31").collect()} == {"A": True, "B": False, "C": True}


def test_preview_and_context(spark):
    rows = spark.createDataFrame([("k", 0, 1, " a "), ("k", 0, 2, "b"), ("k", 1, 1, "a"), ("k", 1, 2, "  ")], "key string, part int, rank int, text string")
    assert one(documents.preview(rows, "key")) == {"key": "k", "preview_text": "a\n\n---\n\nb", "preview_chunks": 2}
    assert one(documents.context(rows.select("key", F.lit(1).alias("rank"), F.lit("").alias("text")).limit(1), ["key"]))["context"] == "Not available"


def test_vectors_brute_force(spark):
    rows = spark.createDataFrame([(i, [float((i * k) % 7 - 3) for k in range(1, 5)], i % 2) for i in range(60)] + [(99, [0.0] * 4, 0), (100, None, 0)], "id long, vector array<double>, section int")
    got = {}
    for r in vectors.cosine_top_k(rows.where("id % 20 = 0"), rows, 3, block_rows=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], round(r["score"], 9))
    data = {r["id"]: (r["vector"], r["section"]) for r in rows.collect() if r["vector"]}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in (0, 20, 40):
        score = lambda v: sum(a * b for a, b in zip(data[q][0], v, strict=True)) / (norm(v) * norm(data[q][0])) if norm(v) * norm(data[q][0]) else 0.0
        want = sorted(((-round(score(v), 9), i) for i, (v, s) in data.items() if s == data[q][1] and i != q))[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [(i, -s) for s, i in want]
    assert vectors.cosine_top_k(rows.where("false"), rows, 3).count() == 0


def test_embedder(spark):
    v = vectors.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t").collect()
    assert len(v[0]["embedding"]) == 384 and sum(v[1]["embedding"]) == 0


def test_resolve(spark):
    rows = spark.createDataFrame([(1, " apple "), (2, "Tell me about Coca-Cola and Tesla"), (3, ""), (4, "zzzzzz corp"), (5, "brk-b"), (6, None)], "id long, query string")
    got = {r["id"]: (r["symbol"], r["confidence"], r["route"]) for r in resolve.resolve(rows).collect()}
    assert got == {1: ("APPLE", 1.0, "symbol"), 2: ("TSLA", 0.95, "company"), 3: (None, 0.0, "empty"), 4: (None, 0.0, "model"), 5: ("BRK-B", 1.0, "symbol"), 6: (None, 0.0, "empty")}
    model = spark.createDataFrame([(4, "zz", None), (1, "bad!", 1.0)], "id long, symbol string, confidence double")
    assert {r["id"]: (r["symbol"], r["confidence"]) for r in resolve.resolve(rows, model).collect()}[4] == ("ZZ", 0.5)
    bad = spark.createDataFrame([("A", "short", "moderate"), ("", "short", "moderate"), ("A", "x", "moderate"), ("A", "long", None)], "symbol string, horizon string, risk_profile string")
    assert [r["error"] for r in resolve.validated(bad).collect()] == [None, "Missing required fields", "Invalid horizon", "Missing required fields"]


def test_telemetry(spark):
    rows = spark.createDataFrame([(1, 2, "a", "gemini-pro", 1000, None, 1.0), (1, 1, "b", "other", 0, 1000, 2.0), (None, 1, "c", "x", 1, 1, 1.0)], "analysis_id long, ts long, agent_name string, model string, prompt_tokens long, completion_tokens long, latency_ms double")
    got = one(telemetry.summary(rows))
    assert got["total_cost_usd"] == pytest.approx(0.002) and got["num_calls"] == 2 and got["total_tokens"] == 2000
    assert [c["agent_name"] for c in one(telemetry.calls_in_order(rows))["calls"]] == ["b", "a"]
    assert spark.range(1).select(telemetry.estimated_tokens(F.lit("")).alias("x")).first()["x"] == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([("i", True, False), ("i", False, False), ("j", True, True), ("j", None, None)], "intent string, correct boolean, skipped boolean")
    assert {r["intent"]: r["accuracy_pct"] for r in evaluation.accuracy(rows, ["intent"]).collect()} == {"i": 50.0, "j": 0.0}
    assert one(evaluation.accuracy(rows.where("intent = 'j' and skipped")))["accuracy_pct"] == 0.0


def test_text_answers(spark):
    answers = [('```json\n{"sentiment": "positive"}\n```', "Neutral-positive"), ('{"sentiment": "odd"}', "Neutral"), ("BULLISH but bearish", "Neutral-positive"), ("bearish", "Neutral-negative"), (None, "Neutral"), ("```\nnot json negative\n```", "Neutral-negative")]
    rows = spark.createDataFrame(answers, "a string, want string").select(X.sentiment(F.col("a")).alias("x"), "want").collect()
    assert [r["x"] for r in rows] == [r["want"] for r in rows]
    assert spark.range(1).select(X.step_tag(F.lit("no tag")).alias("a"), X.step_tag(F.lit("x [Risk Agent] y [z]")).alias("b")).first()[1] == "Risk Agent"
    t = spark.range(1).select(X.rendered(F.lit("{a} {b} {{c}}"), {"a": F.lit("{b}"), "d": F.lit("x")}).alias("x")).first()["x"]
    assert t == "{b} {b} {c}"
    t = spark.range(1).select(X.rendered(F.lit("Report {name} for {t} {{{t}}} } {"), {"name": F.lit("{t} {{x}}"), "t": F.lit("T"), "n": F.lit(None).cast("string")}).alias("x")).first()["x"]
    assert t == "Report {t} {{x}} for T {T} } {"
    row = spark.createDataFrame([("log\n===S===\n{\"a\": 1}\n===E===\n",), ("x {\"b\": 2} y",), ("none",)], "o string").select(X.marked_json(F.col("o"), "===S===", "===E===").alias("j")).collect()
    assert [r["j"] for r in row] == ['{"a": 1}', '{"b": 2}', None] or row[0]["j"].strip() == '{"a": 1}'


def test_model_steps(spark):
    down = lambda s: s.map(lambda x: None)
    up = lambda s: s.map(lambda x: f'{{"risks": ["{x}", "2", "3", "4", "5", "6"]}}')
    rows = model_steps.with_fallback(spark.createDataFrame([("p",)], "prompt string"), "prompt", [down, up])
    assert rows.select(model_steps.key_risks(F.col("answer")).alias("r")).first()["r"] == ["p", "2", "3", "4", "5"]
    none = spark.createDataFrame([(None,), ("junk",)], "a string")
    assert [r["r"] for r in none.select(model_steps.key_risks(F.col("a")).alias("r")).collect()] == [["Unable to identify risks"]] * 2
    assert tuple(none.select(model_steps.judged(F.col("a")).alias("r")).first()["r"]) == (0, 0, "")
    assert tuple(spark.range(1).select(model_steps.intent(F.lit('{"intent": "odd", "confidence": 0.9}')).alias("r")).first()["r"]) == ("stock_analysis", 0.5)
    drafts = spark.createDataFrame([("comparison", '```json\n[{"query": "a vs b"}, {"query": "c"}]\n```')], "category string, answer string")
    assert [(r["id"], r["query"]) for r in model_steps.generated_queries(drafts).orderBy("id").collect()] == [(100, "a vs b"), (101, "c")]
    three = model_steps.scenario_rows(spark.createDataFrame([("A", '{"bull": {"return": 0.2, "prob": 1}, "base": {"return": 0, "prob": 1}, "bear": {"return": -0.2, "prob": 2}}'), ("B", "x")], "symbol string, answer string"))
    assert {(r["symbol"], r["name"]): r["prob"] for r in three.collect()}["A", "bear"] == 0.5 and three.count() == 6


def test_catalog(spark):
    rows = spark.createDataFrame([("1", "sec_filing", "ABC", "", "f.pdf", 2), ("2", "user_pdf", "ABD", "Annual", None, 1)], "id string, source_type string, symbol string, title string, filename string, updated_at long")
    assert [r["id"] for r in catalog.list_documents(rows, symbol="abc").collect()] == ["1"]
    assert [r["id"] for r in catalog.search_documents(rows, "F.PDF").collect()] == ["1"]
    assert catalog.by_any_id(rows.withColumn("object_id", F.lit("7")), "7").count() == 2


def test_progress(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, at(0), " [A] x"), (1, at(10), "  "), (1, at(21), "done")], "run_id long, ts timestamp_ntz, line string")
    assert [(r["step"], r["message"]) for r in progress.events(rows).orderBy("ts").collect()] == [("A", "[A] x"), ("system", "done")]
    assert [(r["from_ts"], r["to_ts"]) for r in progress.gaps(rows.unionByName(rows.withColumn("ts", F.lit(dt.datetime(2024, 1, 1, 3)).cast("timestamp_ntz")))).orderBy("from_ts").collect()] == [(at(10), at(21)), (at(21), dt.datetime(2024, 1, 1, 3))]


def test_stream(spark, tmp_path):
    from ledgerline.streaming.progress_stream import progress_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"run_id": 1, "ts": "2024-01-01T00:00:00", "line": "[A] x"}\n')
    q = progress_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT run_id, step FROM lines").collect()] == [(1, "A")]


def test_prompts_and_sinks(spark, tmp_path):
    for n in (1, 2, 10):
        (tmp_path / f"memo_v{n}.yaml").write_text(f"template: 'v{n} {{x}}'\nmodel_target: m\n")
    rows = prompts.load_prompts(spark, str(tmp_path))
    assert one(prompts.latest(rows))["version"] == 10
    assert prompts.render(spark.range(1), rows, "memo", {"x": F.lit("y")}, version=2).first()["prompt"] == "v2 y"
    path = str(tmp_path / "t")
    sinks.append(spark.range(3).toDF("id"), path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.json_column(spark.range(1)).first()["json"] == '{"id":0}'


def test_sources(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [r["file_name"] for r in tables.binary_files(spark, str(tmp_path)).collect()] in ([ "a_b.pdf"], ["a_20b.pdf"])
    (tmp_path / "e.json").write_text('[{"id": 1, "query": "q"}]')
    assert tables.json_rows(spark, str(tmp_path / "e.json"), schemas.ANNOTATIONS).first()["query"] == "q"


def test_formats(spark):
    row = spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate((formats.magnitude(F.lit(2.5e12)), formats.magnitude(F.lit(None).cast("double")), formats.signed_percent(F.lit(0.2)), formats.duration(F.lit(61.5)), formats.variant(F.lit("Buy"), formats.RECOMMENDATION_KINDS, "x"))))).first()
    assert list(row) == ["$2.50T", "N/A", "+20%", "1m 1.5s", "success"]


def test_formats_round_a_double_as_it_is(spark):
    """As Python's own formatting does; halves of whole percents leave zero, as in the memo's SQL."""
    one = lambda *columns: list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())
    values = [2.985, 1.125, 1.375, 0.15, -0.15, 0.25, 7.05, -2.675, 0.0, -0.001, 1234567.125]
    for decimals in (1, 2):
        for sign in ("", "+"):
            assert one(*(formats.fixed(F.lit(v), decimals, sign) for v in values)) == [f"{v:{sign}.{decimals}f}" for v in values]
    assert one(*(formats.fixed(F.lit(v), 0) for v in (0.5, 62.5, -62.5))) == ["1", "63", "-63"]
    assert one(formats.duration(F.lit(0.15)), formats.duration(F.lit(60.25)), formats.signed_percent(F.lit(0.0015), 1)) == ["0.1s", "1m 0.2s", "+0.1%"]
    nothing = F.lit(None).cast("double")
    assert one(formats.ratio_percent(nothing), formats.ratio_percent(nothing, 0), formats.signed_percent(nothing), formats.duration(nothing)) == ["N/A", "N/A", "+0%", None]
    assert one(formats.fixed(F.lit(float("nan")), 2), formats.magnitude(F.lit(float("inf")))) == ["NaN", "$InfinityT"]


def test_stream_windows_and_sink(spark, tmp_path):
    from ledgerline.streaming import progress_stream as P

    (tmp_path / "in").mkdir()
    lines = [(1, "00:00:00", "[A] x"), (1, "00:04:00", "y"), (1, "00:30:00", "[A] z"), (2, "00:01:00", "[B] x")]
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"run_id": {r}, "ts": "2024-01-01T{t}", "line": "{x}"}}\n' for r, t, x in lines))
    got = {}

    def keep(name):
        def write(batch, _):
            got.setdefault(name, []).extend(tuple(r) for r in batch.collect())

        return write

    for name, frame in (("windows", P.windowed_counts(P.progress_stream(spark, str(tmp_path / "in")))), ("runs", P.silent_runs(P.progress_stream(spark, str(tmp_path / "in")).select("run_id", "ts")))):
        q = frame.writeStream.outputMode("complete").foreachBatch(keep(name)).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((str(a)[11:16], step, n) for a, step, n in got["windows"]) == [("00:00", "A", 1), ("00:00", "B", 1), ("00:00", "system", 1), ("00:30", "A", 1)]
    assert sorted((run, n) for run, _, _, n in got["runs"]) == [(1, 1), (1, 2), (2, 1)]
    sink = P.upsert_sink(P.progress_stream(spark, str(tmp_path / "in")), keep("sink"), str(tmp_path / "sink"))
    sink.processAllAvailable()
    sink.stop()
    assert len(got["sink"]) == 4


def test_names_of_a_table(spark):
    """Names from an inverted index give what looking for every name in every text gives."""
    rng = random.Random(4)
    names = ["".join(rng.choices("abc \xe9", k=rng.randrange(1, 7))) for _ in range(300)] + ["ab", "q", "  ", "", None, "Apple Inc", "apple inc", "\u0130x"]
    companies = [(rng.randrange(1000) if k % 3 else k, n, f"S{k}") for k, n in enumerate(names)]
    texts = ["".join(rng.choices("abc \xe9Q", k=rng.randrange(0, 14))) for _ in range(400)] + ["buy APPLE INC now", "apple inc", " Apple Inc ", None, "", "  ", "zzzzzzzz", "buy APPLE INC now", "AB", "zz-b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, query string")
    table = spark.createDataFrame(companies, "ord long, name string, symbol string")
    got = {r["id"]: (r["route"], r["symbol"]) for r in resolve.resolve(frame, companies=table).collect()}
    known = {}
    for ord_, name, symbol in companies:
        key = (name or "").strip().lower()
        if key:
            known[key] = min(known.get(key, (ord_, symbol)), (ord_, symbol))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        s = (text or "").strip()
        hits = [(s.lower() != n, o, c) for n, (o, c) in known.items() if n in s.lower()]
        want = ("empty", None) if not s else ("symbol", s.upper()) if re.fullmatch(resolve.SYMBOL_SHAPE.strip("^$"), s.upper()) else ("company", min(hits)[2]) if hits else ("model", None)
        assert got[i] == want, (text, hits)
    assert resolve.resolve(frame, companies=table.where("false")).where("route = 'company'").count() == 0


def test_more_names_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BROADCAST_NAMES", 2)
    table = spark.createDataFrame([(k, f"name{k}x", f"S{k}") for k in range(50)], "ord long, name string, symbol string")
    frame = spark.createDataFrame([(k, f"about name{k}x and name{49 - k}x") for k in range(50)], "id long, query string")
    assert {r["id"]: r["symbol"] for r in resolve.resolve(frame, companies=table).collect()} == {k: f"S{min(k, 49 - k)}" for k in range(50)}
