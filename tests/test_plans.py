"""Composite plans and filing sources on small frames."""

from pyspark.sql import functions as F

from ledgerline.plans import evaluation_run, report, retrieval
from ledgerline.sources import filings, schemas


def test_company_numbers(spark):
    symbols = spark.createDataFrame([("aapl",), ("zz",), (None,)], "symbol string")
    companies = spark.createDataFrame([("AAPL", 320193), ("AAPL", 400000), (None, 1)], "ticker string, cik_str long")
    got = {r["symbol"]: r["cik"] for r in filings.company_numbers(symbols, companies).collect()}
    assert got == {"aapl": "0000320193", "zz": None, None: None}
    assert spark.range(1).select(filings.cik_of_feed(F.lit("x CIK=789 y")).alias("c")).first()["c"] == "0000000789"


def test_search_results(spark):
    body = '{"hits": {"hits": [{"_id": "1", "_source": {"file_date": "2024-01-01", "file_num": "n", "file_url": "/a"}}, {"_source": {"file_url": "https://b"}}, {"_source": {"file_url": "c"}}]}}'
    got = filings.search_results(spark.createDataFrame([("A", body), ("B", "junk"), ("C", None)], "symbol string, body string")).orderBy("rank").collect()
    assert [r["url"] for r in got] == ["https://www.sec.gov/a", "https://b"]


def test_pdf_texts(spark):
    files = spark.createDataFrame([("a", bytearray(b"x|  |y")), ("b", None)], "path string, content binary")
    got = filings.pdf_texts(files, lambda content: content.decode().split("|")).orderBy("path").collect()
    assert [r["text"] for r in got] == ["x\n\ny", None]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("categories:\n  - name: a\n    examples: [x]\n")
    assert filings.taxonomy(spark, str(tmp_path / "t.yaml")).first()["examples"] == ["x"]


def test_retrieval(spark):
    text = "Item 1A. Risk Factors war and supply trouble. Item 2. Item 7. Management's Discussion and Analysis sales grew. Item 8."
    chunks = retrieval.filing_chunks(spark.createDataFrame([("abc", "2024-01-01", text), ("xyz", "2024-01-01", text)], "symbol string, filing_date string, text string"))
    assert chunks.count() == 4 and chunks.select("id").distinct().count() == 4
    asked = spark.createDataFrame([("ABC", "risk_factors", "supply risk"), ("ABC", "none", "x")], "symbol string, part string, question string")
    got = retrieval.contexts(chunks, asked).collect()
    assert [(r["symbol"], r["part"], r["context"]) for r in got] == [("ABC", "risk_factors", "war and supply trouble.")]
    up = retrieval.user_chunks(spark.createDataFrame([("1", "d", "abc", "f", "hello")], "analysis_id string, doc_id string, symbol string, filename string, text string"))
    assert up.first()["collection"] == "user_pdf"


def test_retrieve(spark):
    """Requests with filings, with an upload, with both and with neither; a source counts once it has chunks."""
    text = "Item 1A. Risk Factors war and supply trouble. Item 2. Item 7. Management's Discussion and Analysis sales grew. Item 8."
    filed = retrieval.filing_chunks(spark.createDataFrame([("abc", "2024-01-01", text), ("abc", "2023-01-01", text.replace("war", "rain " * 1200)), ("own", "2022-02-02", "Item 7 - Management discussion and analysis x Item 8")], "symbol string, filing_date string, text string"))
    uploaded = retrieval.user_chunks(spark.createDataFrame([("1", "d", "abc", "f", "hello"), ("2", "e", "abc", "g", "other " * 900), ("9", "z", "zzz", "h", "unasked")], "analysis_id string, doc_id string, symbol string, filename string, text string"))
    requests = spark.createDataFrame([("1", "abc"), ("2", "ABC"), ("2", "abc"), ("3", "abc"), ("4", "none"), ("5", "own")], "analysis_id string, symbol string")
    got = {r["analysis_id"]: r for r in retrieval.retrieve(requests, filed, uploaded, k=2).collect()}
    assert set(got) == {"1", "2", "3", "4", "5"} and {r["symbol"] for r in got.values()} == {"ABC", "NONE", "OWN"}
    assert got["1"]["uploaded_context"] == "hello" and got["1"]["num_uploaded_chunks"] == 1 and got["3"]["uploaded_context"] == retrieval.MISSING
    assert got["2"]["uploaded_context"].endswith("...[truncated]") and got["1"]["risk_context"] == got["2"]["risk_context"]
    assert got["1"]["num_risk_chunks"] == 2 and got["1"]["num_mda_chunks"] == 2 and got["1"]["filing_date"] in ("2024-01-01", "2023-01-01")
    assert [tuple(x) for x in got["1"]["document_sources"]] == [("sec_filing", filed.where("symbol = 'ABC'").count()), ("user_pdf", 1)]
    assert got["4"]["available"] is False and got["4"]["document_sources"] == [] and got["4"]["filing_date"] == "" and got["4"]["risk_context"] == retrieval.MISSING
    assert got["5"]["mda_context"] == "x" and got["5"]["num_risk_chunks"] == 0 and got["5"]["filing_date"] == "2022-02-02" and got["5"]["available"]


def test_judge_run(spark):
    examples = spark.createDataFrame([(1, "risk", ("up", 1.5), ["a", "b"]), (2, "risk", (None, None), []), (3, "other", ("x", 0.0), ["c"])], "id long, agent string, input_context struct<trend: string, pe: double>, expected_output_contains array<string>")
    templates = spark.createDataFrame([("risk", 1, "old"), ("risk", 2, "{trend} {pe} {odd}")], "name string, version int, template string")
    answer = lambda s: s
    judge = lambda s: s.map(lambda p: '{"relevance_score": 4, "accuracy_score": 2, "reasoning": "ok"}' if "up 1.5 {odd}" in p else None)
    rows, means = evaluation_run.judge_run(examples, templates, answer, judge, "risk")
    assert {r["id"]: r["relevance_score"] for r in rows.collect()} == {1: 4, 2: 0}
    assert means.first()["avg_accuracy"] == 1.0


def test_resolver_run(spark):
    rows = [(1, "How is Tesla doing", "stock_analysis", "TSLA", True), (2, "AAPL", "stock_analysis", "AAPL", True), (3, "the market", "market_outlook", None, True), (4, "netflix", "comparison", "X", True), (5, "apple", "x", "AAPL", False)]
    frame = spark.createDataFrame(rows, "id long, query string, intent string, expected_symbol string, human_verified boolean")
    out, overall, by_intent = evaluation_run.resolver_run(frame)
    assert out.count() == 4 and overall.first()["correct"] == 2 and overall.first()["total"] == 3
    assert [r["accuracy_pct"] for r in by_intent.collect()] == [0.0, 100.0, 100.0]


def test_analyze(spark):
    asked = spark.createDataFrame([("a", "short", "moderate"), ("b", "never", "moderate")], "symbol string, horizon string, risk_profile string")
    reports = spark.createDataFrame([("A", "Buy"), ("B", "Sell")], "symbol string, recommendation string")
    got = {r["symbol"]: (r["recommendation"], r["error"]) for r in report.analyze(asked, reports).collect()}
    assert got == {"A": ("Buy", None), "B": (None, "Invalid horizon")}


def test_schemas_are_ddl(spark):
    for name, ddl in vars(schemas).items():
        if name.isupper():
            assert spark.createDataFrame([], ddl).columns
