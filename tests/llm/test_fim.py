"""Fill in the middle against a plain version with regular expressions, and its edge cases."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = "ab \t\n\r\x0b\x1c\x85 <PSM>é\U0001f600"
TEXTS = [None, "", "   ", "one", " two words ", "a <P> mark", "x" * 50_000, "word, and more\n" * 40_000, "été \U0001f600 end\t", "<P <S M> <M", "one"]


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the stated rule."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40), st.integers(0, 2000))
def test_cut_as_plain(text, doc_id):
    got = fim.cut(doc_id, text, fim.RATE, fim.SPM_SHARE, fim.SEED)
    assert got == plain(doc_id, text)
    assert fim.rebuilt(got[4], got[1]) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_boundaries_are_token_ends(text):
    ends = np.cumsum([0, *(len(t) for t in TOKEN.findall(text))])
    assert fim.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist() == ends.tolist()


def rows(spark, texts, ids):
    return spark.createDataFrame([(i, t, "clash", 2.5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fim_form string, score double")


def test_all_forms_over_a_table(spark):
    ids = [k % 7 if k else None for k in range(len(TEXTS) * 20)]
    texts = [TEXTS[k % len(TEXTS)] for k in range(len(ids))]
    cuts = fim.fill_in_middle(rows(spark, texts, ids))
    assert cuts.columns == ["doc_id", "text", "score", "fim_tokens", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    got = fim.restore_middle(cuts).collect()
    assert len(got) == len(ids)
    want = sorted([(i, *plain(i, t), t or "") for i, t in zip(ids, texts, strict=True)], key=str)
    assert sorted([(r["doc_id"], *r[3:8], r["restored"]) for r in got], key=str) == want
    assert {r["fim_form"] for r in got} == {"plain", "spm", "psm"}
    digests = fim.digests(cuts).collect()
    assert all(r["restored_sha256"] in {hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS} for r in digests)
    assert all(r["prefix_chars"] is None and r["output_sha256"] == r["restored_sha256"] for r in digests if r["form"] == "plain")


def test_rates_and_an_empty_table(spark):
    docs = rows(spark, ["a b c d"] * 300, range(300))
    forms = lambda **x: {r[0] for r in fim.fill_in_middle(docs, **x).select("fim_form").distinct().collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, spm_share=0) == {"psm"} and forms(rate=100, spm_share=100) == {"spm"}
    assert fim.digests(fim.fill_in_middle(docs.where("false"))).count() == 0
