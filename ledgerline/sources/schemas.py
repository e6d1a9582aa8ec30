"""Schemas of the engine's logical tables. Columns are nullable unless they are a key."""

from __future__ import annotations


def table(keys: str, columns: str) -> str:
    """A schema as DDL text: keys are not null, columns may be. Readers take such text without a session."""
    required = ", ".join(f"{key.strip()} NOT NULL" for key in keys.split(","))
    return f"{required}, {columns}"


BARS = table("symbol string, dt date", "open double, high double, low double, close double, volume long")
BENCHMARK = table("dt date", "close double")
SECTORS = table("sector string, dt date", "close double")
MACRO = table("series_id string, dt date", "value double")
VALUATION = table("symbol string", "price double, pe_ratio double, forward_pe double, peg_ratio double, price_to_book double, market_cap double, dividend_yield double, eps double, high_52w double, low_52w double, beta double")
SCENARIOS = table("symbol string, name string", "ret double, prob double")
LLM_CALLS = table("analysis_id long, ts long", "agent_name string, model string, prompt_tokens long, completion_tokens long, latency_ms double, error string")
CHUNKS = table("id string", "text string, embedding array<float>, collection string, symbol string, section string, filing_date string, chunk_index int, total_chunks int, analysis_id string, doc_id string, filename string, source_type string, uploaded_at string")
REGISTRY = table("id string", "source_type string, symbol string, analysis_id string, title string, source_url string, filename string, file_id string, file_path string, filing_date string, chunks long, status string, created_at timestamp, updated_at timestamp")
ANALYSES = table("id string", "symbol string, horizon string, risk_profile string, recommendation string, confidence_score double, scenarios array<struct<name: string, ret: double, prob: double>>, memo string, created_at timestamp")
EVAL_EXAMPLES = table("id long", "symbol string, horizon string, risk_profile string, agent string, input_context struct<price_trend: string, pe_ratio: double, rsi: double, interest_rate_trend: string, inflation_trend: string, market_trend: string, volatility: double, beta: double, drawdown: string, key_risks: string>, expected_output_contains array<string>, expected_sentiment string, human_score int")
ANNOTATIONS = table("id long", "query string, intent string, expected_symbol string, complexity string, source string, human_verified boolean, notes string")
PROMPTS = table("name string, version int", "template string, model_target string, temperature double, description string, variables array<string>")
TAXONOMY = table("name string", "description string, examples array<string>, default_agents array<string>")
PROGRESS = table("run_id long, ts timestamp_ntz", "line string")
