"""Free-text query resolution: symbol shape, company names, then a model for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Company names and their symbols, in the order in which they are tried (fixed values).
COMPANIES = {
    "apple": "AAPL", "microsoft": "MSFT", "google": "GOOGL", "alphabet": "GOOGL", "amazon": "AMZN", "tesla": "TSLA", "meta": "META",
    "facebook": "META", "nvidia": "NVDA", "netflix": "NFLX", "amd": "AMD", "intel": "INTC", "disney": "DIS", "walmart": "WMT",
    "jpmorgan": "JPM", "goldman sachs": "GS", "bank of america": "BAC", "coca cola": "KO", "coca-cola": "KO", "pepsi": "PEP",
    "pepsico": "PEP", "boeing": "BA", "palantir": "PLTR", "uber": "UBER", "airbnb": "ABNB", "spotify": "SPOT", "snowflake": "SNOW",
    "salesforce": "CRM", "oracle": "ORCL", "ibm": "IBM", "adobe": "ADBE", "paypal": "PYPL", "shopify": "SHOP", "coinbase": "COIN",
    "robinhood": "HOOD", "berkshire hathaway": "BRK-B", "johnson & johnson": "JNJ", "procter & gamble": "PG", "exxon": "XOM", "chevron": "CVX",
}
SYMBOL_SHAPE = r"^[A-Z]{1,5}(-[A-Z]{1,2})?$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_symbol(text: Column) -> Column:
    return stripped(text).rlike(SYMBOL_SHAPE)


def typed_symbol(text: Column) -> Column:
    """Letters, digits and dashes go to upper case as they are typed; other input stays."""
    return F.when(text.rlike("^[A-Za-z0-9-]*$"), F.upper(text)).otherwise(text)


def company_symbol(query: Column, aliases: dict[str, str] = COMPANIES) -> Column:
    """Symbol of the whole query as a name, else of the first name, in the list's order, that it contains.

    The list is code, some dozens of entries, so it is a literal map and a literal array and no join.
    """
    lower = F.lower(stripped(query))
    pairs = [F.struct(F.lit(name).alias("name"), F.lit(symbol).alias("symbol")) for name, symbol in aliases.items()]
    same = F.try_element_at(F.map_from_entries(F.array(*pairs)), lower)
    contained = F.try_element_at(F.filter(F.array(*pairs), lambda x: lower.contains(x["name"])), F.lit(1))["symbol"]
    return F.coalesce(same, contained)


#: Letters of the grams that names are found by, and anchors that are broadcast at most.
GRAM, BROADCAST_NAMES = 3, 200_000


def grams(text: Column, n: int) -> Column:
    """All stretches of n characters of a text; none of a shorter one."""
    all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, all_of).otherwise(F.array().cast("array<string>"))


def anchors(companies: DataFrame) -> DataFrame:
    """(gram, name, ord, symbol): each name once, under the gram of it that the fewest names share.

    companies: (ord, name, symbol); of a name that comes again the least ord counts. A name shorter
    than a gram is its own. Names that are null or blank are left out.
    """
    name = F.lower(stripped(F.col("name")))
    names = companies.where(name != "").groupBy(name.alias("name")).agg(F.min(F.struct("ord", "symbol")).alias("first")).select("name", "first.*")
    parts = names.select("name", F.explode(F.when(F.length("name") < GRAM, F.array("name")).otherwise(F.array_distinct(grams(F.col("name"), GRAM)))).alias("gram"))
    shared = parts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(shared, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("best"))
    return names.join(rarest, "name").select("best.gram", "name", "ord", "symbol")


def contained_names(texts: DataFrame, companies: DataFrame) -> DataFrame:
    """(text, name_symbol): for each distinct text that is a company's name, its symbol, else that of the first name in it.

    texts: (text) in lower case. An inverted index proposes names: each stands under one of its grams,
    and texts meet them by their own grams. Only keys and grams are joined; the texts come back, once
    for each name proposed, to see whether it is there. Up to BROADCAST_NAMES names are broadcast.
    """
    distinct = texts.where(F.col("text") != "").distinct().withColumn("key", F.unhex(F.md5("text")))
    index = anchors(companies)
    index = F.broadcast(index) if index.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else index
    short = [grams(F.col("text"), n) for n in range(1, GRAM)]
    asked = distinct.select("key", F.explode(F.array_distinct(F.concat(grams(F.col("text"), GRAM), *short))).alias("gram"))
    proposed = asked.join(index, "gram").select("key", "name", "ord", "symbol")
    held = distinct.join(proposed, "key").where(F.col("text").contains(F.col("name")))
    first = F.min(F.struct(F.col("text") != F.col("name"), "ord", "symbol")).alias("first")
    return held.groupBy("text").agg(first).select("text", F.col("first.symbol").alias("name_symbol"))


def resolve(queries: DataFrame, model: DataFrame | None = None, companies: DataFrame | None = None) -> DataFrame:
    """queries (id, query) with symbol, resolved, confidence, error and route.

    Names are those of COMPANIES, or of a table `companies` (ord, name, symbol) of any length.

    Empty queries are errors. Any text that is a symbol in upper case is one (confidence 1.0); then
    company names (0.95). What is left has route model; where `model` gives (id, symbol, confidence)
    for such rows, shaped like symbols, those count (0.5 where it gives no confidence).
    """
    query = stripped(F.coalesce("query", F.lit("")))
    if companies is None:
        queries = queries.withColumn("_named", company_symbol(query))
    else:
        known = contained_names(queries.select(F.lower(query).alias("text")), companies).select(F.col("text").alias("_text"), F.col("name_symbol").alias("_named"))
        queries = queries.join(known, F.lower(query) == F.col("_text"), "left").drop("_text")
    upper, named = F.upper(query), F.col("_named")
    route = F.when(query == "", "empty").when(upper.rlike(SYMBOL_SHAPE), "symbol").when(named.isNotNull(), "company").otherwise("model")
    routed = queries.withColumns({"route": route, "symbol": F.when(route == "symbol", upper).when(route == "company", named)}).drop("_named")
    confidence = F.when(F.col("route") == "symbol", 1.0).when(F.col("route") == "company", 0.95).otherwise(0.0)
    out = routed.withColumns({"confidence": confidence, "resolved": F.col("route") == "company", "error": F.when(F.col("route") == "empty", "Empty query")})
    if model is None:
        return out
    answers = model.select("id", F.upper("symbol").alias("m_symbol"), F.coalesce("confidence", F.lit(0.5)).alias("m_confidence")).where(F.col("m_symbol").rlike(SYMBOL_SHAPE))
    joined = out.join(answers, "id", "left")
    use = (F.col("route") == "model") & F.col("m_symbol").isNotNull()
    return joined.withColumns({
        "symbol": F.when(use, F.col("m_symbol")).otherwise(F.col("symbol")), "confidence": F.when(use, F.col("m_confidence")).otherwise(F.col("confidence")),
        "resolved": F.col("resolved") | use, "error": F.when((F.col("route") == "model") & ~use, "Could not resolve query").otherwise(F.col("error")),
    }).drop("m_symbol", "m_confidence")


def validated(requests: DataFrame) -> DataFrame:
    """requests with error: required fields and the allowed horizons and risk profiles."""
    missing = (F.coalesce("symbol", F.lit("")) == "") | (F.coalesce("horizon", F.lit("")) == "") | (F.coalesce("risk_profile", F.lit("")) == "")
    error = F.when(missing, "Missing required fields").when(~F.col("horizon").isin("short", "medium", "long"), "Invalid horizon").when(~F.col("risk_profile").isin("conservative", "moderate", "aggressive"), "Invalid risk profile")
    return requests.withColumn("error", error)
