"""Secret scans: patterns, then how widely a value is owned over the whole corpus.

Patterns give base spans. Their values, and other runs of letters and digits that could be
credentials, are candidates. A candidate's hash is counted over the whole corpus by distinct
repositories and owners: a value that several owners hold is a copied example, one that a single owner
holds and that looks random is taken as live. Live values are then found wherever they stand, also
without a name before them. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import bound, places
from ledgerline.llm.common import written

KINDS = ("assign", "access", "hex", "value")
#: Patterns of the base kinds (fixed values), and of runs with a letter and a digit from one end to the other.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
VALUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{8,}+"
LEAST_ASSIGNED = 8
#: Signs that don't count at the ends of a value.
ENDS = ".=+/_-"
#: A value of so many owners or repositories is an example.
OWNERS, REPOSITORIES = 3, 5
#: Words of made-up values; letters and digits, and bits a character, of values that look random where
#: a name stands before them and where none does.
MADE_UP = "example|changeme|change_me|placeholder|dummy|sample|your|xxxx|1234567|abcdef|password|secret"
NAMED_BITS, BARE_BITS, BARE_CHARS = 2.5, 3.5, 20
CANDIDATE = "struct<start: bigint, kind: int, end: bigint, hash: binary, random: boolean, strong: boolean>"
LIVE, EXAMPLE, WEAK = "live", "example", "weak"


def bits(value: Column) -> Column:
    """Entropy of a text's characters, in bits a character."""
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def candidate(span: Column, kind: int, value: Column) -> Column:
    """struct of a span: place, kind, hash of its value, and whether that looks random with a name before it and without."""

    def told(x: Column) -> Column:
        bare, own = x["bare"], x["bits"]
        random = ~F.lower(bare).rlike(MADE_UP) & (own >= NAMED_BITS)
        mixed = bare.rlike("[0-9]") & bare.rlike("[a-z]") & bare.rlike("[A-Z]") & (F.length(bare) >= BARE_CHARS)
        return F.struct(
            span["start"].alias("start"), F.lit(kind).alias("kind"), span["end"].alias("end"), F.unhex(F.md5(bare)).alias("hash"),
            random.alias("random"), (random & mixed & (own >= BARE_BITS)).alias("strong"),
        )

    return bound(F.btrim(value, F.lit(ENDS)), lambda b: bound(F.struct(b.alias("bare"), bits(b).alias("bits")), told))


def candidates(text: Column, kind: int) -> Column:
    """All spans of a kind as structs of candidate."""
    pattern = (ASSIGN, ACCESS, HEX, VALUE)[kind]
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    found = F.zip_with(places(text, pattern), values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    if kind == 0:
        found = F.filter(found, lambda x: F.length(x["v"]) >= LEAST_ASSIGNED)
    some = F.transform(found, lambda x: candidate(x["s"], kind, x["v"]))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """A row for each of docs without its text: row number, doc_id, owner, repository, base spans and other candidates."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        *(candidates(text, k).alias(name) for k, name in enumerate(KINDS)),
    )
    base = F.sort_array(F.concat(*KINDS[:3]))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), F.col("value").alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, known, strong, random) of each candidate value over all rows of scanned.

    Occurrences become one row for each value, owner and repository before the first shuffle, and one
    for each value and owner before the next, so neither a value nor an owner is a hot key.
    """
    one = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("c"))
    flags = [F.max(c).alias(c) for c in ("known", "strong", "random")]
    held = one.groupBy("c.hash", "owner", "repository").agg(F.max(F.col("c.kind") < 3).alias("known"), F.max("c.strong").alias("strong"), F.max("c.random").alias("random"))
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), *flags)
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), *flags)


def verdict(owners: int, repositories: int) -> Column:
    shared = (F.col("owners") >= owners) | (F.col("repositories") >= repositories)
    return F.when(shared, EXAMPLE).when(F.col("strong") | F.col("known") & F.col("random"), LIVE).otherwise(WEAK)


def find_secrets(docs: DataFrame, owner: Column, repository: Column, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans, SHA-256 of their list, all spans and their verdicts.

    A span is kind:start:end in code points, by start and kind. Base spans always stay. Runs of letters
    and digits are added as value where their value is live and they touch no base span: because it
    looks random by itself, or because it is a live base value elsewhere. verdicts has live, example or
    weak for each span in the same order; n_live and n_example count them. A value is an example if so
    many `owners`, or so many `repositories` of any owners, hold it.

    A null text is empty and has no spans; a null owner or repository is one of its own. Rows pass one
    by one, so null and repeated ids and repeated rows each give a row; repeated rows count once
    towards ownership. Other columns are left out. The texts are read once; what is found is written
    without them, and only rows with candidates meet the values' verdicts, by hash.
    """
    found = written(scanned(docs, owner, repository), "secrets")
    values = written(ownership(found).select("hash", verdict(owners, repositories).alias("verdict")), "values")
    some = F.size("base") + F.size("more") > 0
    judged = found.where(some).select("row", F.explode(F.concat("base", "more")).alias("c")).select("row", "c.hash", "c.start", "c.kind", "c.end").join(values, "hash")
    # A value touches no base span if those that start before it have ended and those that start later do so behind it.
    is_base, near = F.col("kind") < 3, Window.partitionBy("row").orderBy("start")
    ended = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(near), F.lit(0)) <= F.col("start")
    later = F.coalesce(F.min(F.when(is_base, F.col("start"))).over(near.rangeBetween(0, Window.unboundedFollowing)) >= F.col("end"), F.lit(True))
    judged = judged.where(is_base | (F.col("verdict") == LIVE)).withColumn("free", ended & later).where(is_base | F.col("free"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("all"))
    own = ["row", "doc_id", "n_assign", "n_access", "n_hex", "base"]
    both = found.where(some).select(own).join(spans, "row", "left").unionByName(found.where(~some).select(own), allowMissingColumns=True)
    every = F.coalesce("all", F.array().cast(spans.schema["all"].dataType))
    counted = lambda v: F.size(F.filter(every, lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    return both.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"),
        F.array_join(F.transform(every, lambda s: s["verdict"]), ",").alias("verdicts"), counted(LIVE), counted(EXAMPLE),
    )
