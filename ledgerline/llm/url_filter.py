"""URL filters with history: dated list entries as validity intervals, joined as of the fetch time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written


def host_of(url):
    """Host in lower case without user, port and final dots; null if the URL has none.

    Reads a URL as browsers do: blanks before it don't count, a backslash is a slash, the scheme may
    be left out before two slashes, the user ends at the last @, percent codes are decoded, and an
    IPv6 address keeps its brackets.
    """
    plain = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", ""), "\\", "/")
    authority = F.regexp_replace(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//+([^/?#]*)", 1), r"^.*@", "")
    found = F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found)
    return F.nullif(F.lower(F.regexp_replace(decoded, r"\.+$", "")), F.lit(""))


def suffixes(host):
    """The host and its parent domains of two labels at least (the host itself even with one)."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, size), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, since, until, active) of dated entries (domain, entry_date, action, category).

    Each category is a list of its own: an entry holds from its date until the next date of its domain
    and category, exclusive; the last is open. Of such entries of one date "remove" comes before "add".
    A null category is one, too. Rows without domain, date or a known action don't count. Repeated
    rows do no harm.
    """
    good = entries.select(F.lower("domain").alias("domain"), F.col("entry_date").cast("date").alias("since"), "action", "category")
    good = good.where(F.col("domain").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
    # One row a domain, category and date is left before the window, so it holds their dates only.
    daily = good.groupBy("domain", "category", "since").agg(F.min(F.col("action") != "remove").alias("active"))
    order = Window.partitionBy("domain", "category").orderBy("since")
    return daily.select("domain", "category", "since", F.lead("since").over(order).alias("until"), "active")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetch_date, blocked, matched_domain, category, listed_since) for each capture.

    captures: (page_id, url, fetch_date). A capture is judged by the entries in force on its fetch
    date, of every category, for its host and its parent domains; any active "add" blocks it. Of
    several the longest domain is named, then the latest entry, then the least category. A null date
    or a URL without host is never blocked. Repeated captures each give a row; other columns are left
    out.

    Captures of one host and date are judged once: they are counted down to (host, date) pairs with
    partial aggregation before any join, so a host with a third of all captures is a few pairs. The
    verdicts go back to the captures by host and date.
    """
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetch_date").cast("date").alias("fetch_date"))
    pairs = seen.where(F.col("host").isNotNull() & F.col("fetch_date").isNotNull()).select("host", "fetch_date").distinct()
    asked = pairs.withColumn("domain", F.explode(suffixes(F.col("host"))))
    lists = written(validity_intervals(entries).where("active"), "intervals")
    held = (F.col("fetch_date") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetch_date") < F.col("until")))
    hits = asked.join(lists, "domain").where(held)
    first = F.min(F.struct((-F.length("domain")).alias("n"), (-F.unix_date("since")).alias("day"), "category", "domain", "since")).alias("hit")
    verdicts = written(hits.groupBy("host", "fetch_date").agg(first).select("host", "fetch_date", "hit.domain", "hit.category", "hit.since"), "verdicts")
    out = seen.join(verdicts, ["host", "fetch_date"], "left")
    return out.select("page_id", "host", "fetch_date", F.col("domain").isNotNull().alias("blocked"), F.col("domain").alias("matched_domain"), "category", F.col("since").alias("listed_since"))
