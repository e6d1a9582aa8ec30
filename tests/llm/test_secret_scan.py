"""Secret scans against plain patterns and counts, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ["assign", "access", "hex", "value"]
LIVE_KEY = "kQ7vT2mZp9Xw4LsR8bNc"
SHARED = "hT5yU8iK3oL6pM9nB2vC"
HEX = hashlib.md5(b"a value").hexdigest()


def plain_spans(text):
    """(start, kind, end, value) of base spans and other candidates."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out + [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 8 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def looks(value):
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    random = bool(value) and not re.search(secret_scan.MADE_UP, value.lower()) and bits >= 2.5
    return random, random and all(re.search(c, value) for c in ("[0-9]", "[a-z]", "[A-Z]")) and len(value) >= 20 and bits >= 3.5


def plain(rows):
    """What find_secrets gives for rows (doc_id, text, owner, repository), by definition."""
    spans = [[(a, k, b, v.strip(".=+/_-")) for a, k, b, v in plain_spans(t or "")] for _, t, _, _ in rows]
    owners, repositories, known = defaultdict(set), defaultdict(set), set()
    for (_, _, owner, repository), found in zip(rows, spans, strict=True):
        for _, k, _, v in found:
            owners[v].add(owner or "")
            repositories[v].add((owner or "", repository or ""))
            known |= {v} if k < 3 else set()

    def verdict(v):
        random, strong = looks(v)
        return "example" if len(owners[v]) >= 3 or len(repositories[v]) >= 5 else "live" if strong or v in known and random else "weak"

    out = []
    for (doc_id, _, _, _), found in zip(rows, spans, strict=True):
        base = [s for s in found if s[1] < 3]
        kept = sorted(base + [s for s in found if s[1] == 3 and verdict(s[3]) == "live" and not any(b[0] < s[2] and s[0] < b[2] for b in base)])
        text = lambda some: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in some)
        verdicts = [verdict(v) for *_, v in kept]
        counts = [sum(k == kind for _, k, _, _ in base) for kind in range(3)]
        out.append((doc_id, *counts, hashlib.sha256(text(sorted(base)).encode()).hexdigest(), text(kept), ",".join(verdicts), verdicts.count("live"), verdicts.count("example")))
    return sorted(out, key=str)


def corpus():
    texts = [
        None, "", "  ", "no keys here", f'token = "{LIVE_KEY}" and more', f"seen again: {LIVE_KEY}, bare", "password:hunter2hunter9 x hunter2hunter9", "passwd=short token=secret=abcdefgh9",
        "API_KEY: 'example-key-12345678'", "secretİ=abcdefgh", f"é\U0001f600 {HEX}{HEX} {HEX[:31]} AKIAABCDEFGHIJKL AKIASHORT AKIAAKIAAKIAABCD01", "Token=token:abcdefghij", "=secret = = x" + "9" * 40,
        "a" * 40_000 + " " + "f" * 40_000, ("token=abcdefgh1 " + LIVE_KEY + " ") * 1500, "token" + " " * 20_000 + "=" + " " * 20_000 + "value12345",
        "path/to-some_file-2024-01-02/Part7 and Zx81Zx81Zx81Zx81Zx81", f"{LIVE_KEY}.", f"x{LIVE_KEY}", "PASSWD = 'aaaaaaaaaaaa' secret=\"11111111\"",
    ]
    rows = [(k, t, f"owner{k % 2}", "repo") for k, t in enumerate(texts)]
    rows += [(100 + k, f"api_key={SHARED} and again {SHARED}", f"owner{k % 4}", None) for k in range(8)]
    rows += [(200 + k, f"apikey={SHARED[::-1]}", "owner0", f"repo{k}") for k in range(6)]
    return rows + [(None, f"token={HEX}", None, None), (4, f"token={LIVE_KEY[::-1]}", "owner0", "repo"), (4, f"token={LIVE_KEY[::-1]}", "owner0", "repo")]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, owner string, repository string, spans string, row int")
    return secret_scan.find_secrets(docs, F.col("owner"), F.col("repository"))


def test_as_plain(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "verdicts", "n_live", "n_example"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain(rows)
    for a, b in zip(got, want, strict=True):
        assert a == b
    by_id = {r[0]: r for r in got}
    assert by_id[5][5] == f"value:12:{12 + len(LIVE_KEY)}" and by_id[5][6] == "live"  # without a name, found by its twin
    assert by_id[6][5].count("value") == 1 and by_id[100][6] == "example" and by_id[200][6] == "example"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, owner string")
    assert secret_scan.find_secrets(docs, F.col("owner"), F.lit("x")).count() == 0


def test_native(spark):
    plan = run(spark, corpus()[:6])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
