"""Brute force, round trips and edge cases for the operators of ledgerline.llm."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from ledgerline.llm import bpe, chat, common, components, media, minhash, packing, pii, quality, search, toxicity, url_filter  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = "word, and more words " * 20000
TEXTS = [None, "", "   ", "a", "Hello  World's 123 été <|endoftext|>x ΑΣ İ é", "x" * 30000, LONG, "tab\tnew\nline\x1cend", "a"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, class double")


def empty(spark):
    return docs(spark, ["x"]).where("false")


# --- encoding


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=60))
def test_bpe_as_library(text):
    t = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_bpe_as_library, "t") else test_bpe_as_library.t
    test_bpe_as_library.t = t
    own = bpe.loaded(PATH)
    want = t.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == t.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in bpe.bpe_encode(docs(spark), PATH, digest=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(empty(spark), PATH).count() == 0
    full = bpe.bpe_encode(docs(spark, [None, "a b"], [None, None]), PATH).collect()
    assert sorted(r["decoded"] for r in full) == ["", "a</w> b</w>"]


# --- packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing(lengths):
    place, offset, filled = packing.best_fit_decreasing(lengths, 64)
    bins: list[int] = []  # brute force: the tightest open bin, the latest of equals
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        fits = [b for b in bins if b >= lengths[i]]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - lengths[i])
        else:
            bins.append(64 - lengths[i])
    assert sorted(filled) == sorted(64 - b for b in bins)
    for w, total in enumerate(filled):
        own = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if place[i] == w)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == total <= 64


def test_packing(spark, library):
    rows = packing.pack_documents(docs(spark), PATH, group_rows=4, keep_ids=True).collect()
    by_doc: dict = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= 4096
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        own = sorted(by_doc[i], key=lambda r: r["start"])
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r["ids"]] == want and all(r["doc_tokens"] == len(want) for r in own)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    for own in by_sequence.values():
        own.sort()
        assert all(o == sum(n for _, n, _ in own[:k]) for k, (o, _, _) in enumerate(own)) and sum(n for _, n, _ in own) == own[0][2] <= 4096
    assert packing.pack_documents(empty(spark), PATH).count() == 0
    assert packing.pack_documents(docs(spark, ["a", "a"], [None, None]), PATH).count() == 2


# --- search


@pytest.mark.parametrize("near_blocks", [64, 1])
def test_top_k_brute_force(spark, monkeypatch, near_blocks):
    monkeypatch.setattr(search, "NEAR_BLOCKS", near_blocks)  # one block: floors come from a part of a cell
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(120)]
    frame = spark.createDataFrame(rows + [(None, [0.0] * 8), (2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2050, [1.0] * 3), (2051, [1.0] * 3)], "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got: dict = {}
    for r in search.top_k(frame, query_rows=4, block_rows=64, run_blocks=3, cell_rows=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x = {i: np.floor(256 * np.array(np.array(v, "f4"), "f8")).astype(int) for i, v in rows}
    for q in [i for i in x if i % 50 == 0]:
        want = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    assert got[2050] == {1: (2051, 3 * 256 * 256)}
    assert search.top_k(frame.where("false")).count() == 0
    assert search.top_k(frame.where("vec_id = 50")).count() == 0


def test_top_k_scores_no_pair_twice(spark):
    """Where nothing can be skipped, as with even directions, each pair is scored once."""
    x = np.random.default_rng(6).normal(size=(2000, 64))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate((x / np.sqrt((x * x).sum(1, keepdims=True))).tolist())], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    assert search.top_k(frame, scored=scored).count() == 40 * 5
    assert scored.value <= 40 * 2000


def test_top_k_skips_most_of_clustered_data(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(50, 64))
    x = middle[rng.integers(0, 50, 8000)] / np.sqrt(64) + rng.normal(size=(8000, 64)) * 0.08
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    scored = spark.sparkContext.accumulator(0)
    got: dict = {}
    for r in search.top_k(frame, cell_rows=64, scored=scored).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    y = np.floor(256 * x).astype(int)
    for q in range(0, 8000, 50):
        scores = y @ y[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    assert scored.value < 0.3 * 160 * 8000


def test_cover_tree_holds_all_points():
    points = np.random.default_rng(1).normal(size=(500, 6))
    seen = []

    def walk(node):
        away = np.sqrt(((points[node.at] - node.centre) ** 2).sum(1))
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.at for c in node.children])) == sorted(node.at)
            for c in node.children:
                walk(c)
        else:
            seen.extend(node.at)

    walk(search.cover_tree(points))
    assert sorted(seen) == list(range(500))


# --- near duplicates


def shingles(text):
    w = (text or "").encode("utf-8").lower().split()
    return set() if not w else {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(100)]
    out = ["", None, " \t", "one two", "One  two", "one two three four five", "é É", "É é"]
    for edits in [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 8] * 12:
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(20):
        w = [word() for _ in range(rng.randrange(3, 60))]
        out += [" ".join(w), " ".join([*w, word()]), " ".join(w).upper()]
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_brute_force(spark, percent):
    texts = near_texts()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), percent).collect()}
    want = brute_components(texts, percent)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    texts = near_texts()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), 85).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 85)


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [rng.choice(3000, rng.integers(0, 400), replace=False) for _ in range(90)] + [np.arange(500)] * 30
    values, owner = np.concatenate(sets), np.repeat(np.arange(120, dtype="i4"), [len(s) for s in sets])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.shared_counts(values, owner, 120)
    assert all(got[i, j] == want[i][j] for i in range(120) for j in range(120) if i != j)


def test_many_equal_rows_and_a_very_long_text(spark):
    base = " ".join(f"w{i % 211}x{i % 17}" for i in range(300))
    huge = " ".join(f"h{i}" for i in range(1_300_000))
    n = 30000
    rows = spark.range(2 * n).select(F.when(F.col("id") < n, 77).cast("long").alias("doc_id"), F.lit(base).alias("text"))
    more = spark.createDataFrame([(5, base + " end"), (900, huge), (901, huge + " end")], "doc_id long, text string")
    got = minhash.near_duplicates(rows.unionByName(more)).groupBy("doc_id", "component_id", "kept").count().collect()
    want = [(None, 5, False, n), (77, 5, False, n), (5, 5, True, 1), (900, 900, True, 1), (901, 900, False, 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    rows = minhash.near_duplicates(docs(spark, ["a b c", "a b c", "x", LONG, LONG], [None, 7, None, 9, 9])).collect()
    assert sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in rows) == sorted(map(str, [(None, 7, False), (7, 7, True), (None, None, False), (9, 9, True), (9, 9, True)]))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    root = list(range(400))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_min_max_estimates():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 2**63, 400, "u8")
    a, b = whole[:300], whole[100:]  # 200 of 400 are shared
    hashing = minhash.MinMax(200)
    same = (hashing.signature(a) == hashing.signature(b)).mean()
    assert abs(same - 0.5) < 0.08


# --- quality and toxicity


def labelled(spark, n=600):
    rng = random.Random(4)
    plain = "the quick brown fox went over a small hill and saw water there today".split()
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.randrange(5, 60))
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w]
        if rude:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwits"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(rude)))
    labels += [(None, 1, 1), (3, None, None), (10**6, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    d, labels = labelled(spark)
    rows = quality.classify_quality(d, quality.train_quality(d, labels)).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    held = quality.classify_quality(d, quality.train_quality(d, labels)).select("held_out", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("want")).collect()
    assert all(r["held_out"] == r["want"] for r in held)


def test_dual_coordinate_descent_against_projected_gradient():
    rng = np.random.default_rng(9)
    label = (rng.random(60) < 0.4).astype("int64")
    rows = [np.unique(np.r_[rng.integers(0, 40, 8), rng.integers(0, 12, 5) + 20 * y]).astype("int32") for y in label]
    r = quality.ratios(rows, label, 1.0)
    counts = np.array([np.bincount(np.concatenate([x for x, y in zip(rows, label, strict=True) if y == k]), minlength=1 << quality.BITS) + 1 for k in (0, 1)])
    assert np.allclose(r, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()))
    w, bias = quality.dual_coordinate_descent(rows, r, label, 1.0, 3000)
    x = np.array([[r[b] if b in set(row.tolist()) else 0.0 for b in range(60)] + [1.0] for row in rows])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    sign, limit = 2.0 * label - 1, np.where(label == 1, 1 / label.sum(), 1 / (1 - label).sum()) * 30
    gram, alpha = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(60)
    for _ in range(60000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, limit)
    want = (alpha * sign) @ x
    assert np.allclose(w[:60], want[:60] * r[:60], atol=2e-3) and abs(bias - want[-1]) < 2e-3


def test_quality_ignores_held_out_labels(spark):
    d, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: [r["score"] for r in quality.classify_quality(d, quality.train_quality(d, l)).orderBy("doc_id").collect()]
    assert score(labels) == score(flipped)


def test_scores_of_edge_cases(spark):
    d, labels = labelled(spark, 200)
    for classify, train in ((quality.classify_quality, quality.train_quality), (toxicity.classify_toxicity, toxicity.train_toxicity)):
        rows = classify(docs(spark), train(d, labels)).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (0, 1)}) == 1
        assert classify(empty(spark), train(d.where("false"), labels)).count() == 0
        assert all(0 <= r["score"] <= 1 for r in classify(d, train(d, labels.where("false"))).collect())


def test_toxicity_held_out_and_misspelled(spark):
    d, labels = labelled(spark)
    lexicon = toxicity.train_toxicity(d, labels)
    rows = toxicity.classify_toxicity(d, lexicon).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert len(rows) > 100 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    texts = ["you are a blokhead blokhead", "a nice day", 'he said the word "blockhead" in a quote', "you blockhead you are a blockhead"]
    got = [r["score"] for r in toxicity.classify_toxicity(docs(spark, texts), lexicon).orderBy("doc_id").collect()]
    assert got[0] > got[1] and got[3] > got[2] > got[1]


def test_toxicity_of_quoted_insults(spark):
    rng = random.Random(7)
    plain = "the quick brown fox went over a small hill and saw water there today".split()
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(plain, k=rng.randrange(20, 60))
        rude = i % 3 == 0
        if rude:
            w[3:3] = ["you", "blokhead" if i % 9 == 0 else "blockhead"]
        elif i % 3 == 1:
            w[9:9] = ["she", "wrote", '"blockhead"', "then"]
        elif i % 30 == 2:
            w[9:9] = ["he", "said", '"blokhead"', "then"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(rude)))
    labels[1] = (1, None)
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon = toxicity.train_toxicity(d, labels)
    assert "blockhead" in lexicon.terms and "blokhead" not in lexicon.clean
    got = toxicity.classify_toxicity(d, lexicon).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert len(got) > 200 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97


def test_toxicity_keeps_doubtful_terms(spark):
    rows = [(i, f"w{i} you lout and x{i}" if i % 4 == 0 or i % 8 == 1 else f"w{i} and x{i}", int(i % 4 == 0)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train_toxicity(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert "lout" in lexicon.doubtful
    got = [r["score"] for r in toxicity.classify_toxicity(docs(spark, ["you lout", "a nice day"]), lexicon).orderBy("doc_id").collect()]
    assert got[0] > got[1]


def edits(a, b):
    row = list(range(len(b) + 1))
    before = row
    for i, x in enumerate(a, 1):
        old, row, before = before, [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], old[j - 2] + 1)
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7), st.integers(0, 2))
def test_levenshtein_automaton(word, other, most):
    machine = toxicity.LevenshteinAutomaton(word, most)
    state = machine.start()
    for c in other:
        state = machine.step(state, c)
    assert machine.accepts(state) == (edits(word, other) <= most)


def test_trie_brute_force():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choices("abcd", k=rng.randrange(3, 11))) for _ in range(60)})
    trie = toxicity.Trie.of(terms)
    for _ in range(800):
        word = "".join(rng.choices("abcd", k=rng.randrange(1, 12)))
        want = [(edits(t, word), t) for t in terms if toxicity.allowed(t) and edits(t, word) <= toxicity.allowed(t)]
        assert trie.near(word) == (min(want)[1] if want else None)


def test_trie_brute_force_of_long_terms():
    """Words some edits and swaps away from terms of twelve letters and more, near the bound of two."""
    rng = random.Random(7)
    terms = sorted({"".join(rng.choices("abcdefgh", k=rng.randrange(11, 16))) for _ in range(40)})
    trie, found = toxicity.Trie.of(terms), 0
    for _ in range(1500):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) - 1)
            kind = rng.randrange(4)
            if kind == 0:
                word[i], word[i + 1] = word[i + 1], word[i]
            else:
                word[i : i + (kind > 1)] = [] if kind == 2 else [rng.choice("abcdefgh")]
        word = "".join(word)
        want = [(edits(t, word), t) for t in terms if toxicity.allowed(t) and edits(t, word) <= toxicity.allowed(t)]
        assert trie.near(word) == (min(want)[1] if want else None)
        found += bool(want)
    assert found > 700


# --- personal data

PRIVATE = ["mail x.y@a-b.example.com_z@d.com, ip 1.2.3.4.5.6.7.8 999.1.1.1 card 4111 1111-1111 1111 tel +1 (988) 555-2485 ok", "@a.b a@ a@b a@b.c@d.e", "+" * 50 + "1" * 40, "4111111111111111 4111111111111112", "0001.002.3.4 1.2.3", "1" * 5000 + ".2.3.4", "", None]


def plain_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 12 <= len(d) <= 19 and sum(v if k % 2 == 0 else v * 2 // 10 + v * 2 % 10 for k, v in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ (4)_é", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii(spark):
    d = docs(spark, PRIVATE)
    field = pii.train_pii(d)
    got = {r["doc_id"]: r for r in pii.find_pii(d, field).collect()}
    for i, t in enumerate(PRIVATE):
        want = plain_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(filter(None, pii.joined(want).split(","))) <= set(filter(None, got[i]["spans"].split(",")))
    red = {r["doc_id"]: r for r in pii.redact_pii(d, field).collect()}
    assert red[7]["text"] is None and "[EMAIL]" in red[0]["text"] and red[0]["score"] == "clash"
    assert pii.find_pii(empty(spark), pii.train_pii(empty(spark))).count() == 0


def test_field_is_exact_on_chains():
    rng = np.random.default_rng(8)
    field = pii.Field(rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    text = "w1 plain plain x2 y plain w3"
    t = pii.Tokens(text, [])
    t.skips = {}
    words = text.split()
    at = dict(zip(t.place, t.mask, strict=True))
    weight = [np.exp(((at.get(i, pii.PLAIN) >> np.arange(pii.N_FEATURES)) & 1) @ field.unary) for i in range(len(words))]
    forward = [weight[0]]
    for w in weight[1:]:
        forward.append((forward[-1] @ field.step) * w)
    back = [np.ones(5)]
    for w in weight[:0:-1]:
        back.append(field.step @ (w * back[-1]))
    want = np.array([forward[i] * back[len(words) - 1 - i] for i in t.place])
    assert np.allclose(field.marginals(t), want / want.sum(1, keepdims=True), atol=1e-5)


def test_skips_carry_labels():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), 3 * np.eye(5))
    text = "mail 4111111111111111 and more words, 4111-1111x1111-1111 end"
    t = pii.Tokens(text, pii.base_spans(text))
    assert t.skips == {(0, 1): 0} and field.marginals(t)[1].argmax() == 1 + pii.KINDS.index("card")


def test_skips_reach_all_occurrences():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), 8 * np.eye(5))
    card, other = 1 + pii.KINDS.index("card"), "4111-1111x1111-1111"
    for gap in (", ", " and "):
        text = gap.join(["4111111111111111", *[other] * 59])
        t = pii.Tokens(text, pii.base_spans(text))
        got = field.marginals(t)
        assert sum(t.label) == card and (got[:, card] > 0.9).all() and {(0, k) for k in range(1, 60)} <= set(t.skips)


def test_field_is_exact_on_long_chains():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), 6 * np.eye(5), np.zeros((5, 5)))
    text = " ".join(["4111111111111111", *(f"x{i}y" for i in range(80))])
    hop = field.step / field.step.sum(1, keepdims=True)
    want = [np.linalg.matrix_power(hop, k)[1 + pii.KINDS.index("card")] for k in range(81)]
    assert np.allclose(field.marginals(pii.Tokens(text, pii.base_spans(text))), want, atol=1e-5)


def test_fields_that_do_not_settle_end():
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["a1", "b2", "c3", "d4"], 60))
    for scale in (1, 5, 20):
        field = pii.Field(rng.normal(size=(pii.N_FEATURES, 5)), scale * rng.normal(size=(5, 5)), -scale * np.eye(5))
        t = pii.Tokens(text, [])
        p = field.marginals(t)
        assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)
    q = pii.mean_field(np.full((2, 5), 0.2), {(0, 1): np.ones((5, 5))}, 1e-6)
    assert np.allclose(q, 0.2)


# --- media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media_round_trip(spark):
    texts = [None, "", "x" * 576, "é" * 300, LONG, "BM RIFF PK\x03\x04 GIF89a %PDF- \x00"]
    got = {r["doc_id"]: r for r in media.inspect_media(media.encode_media(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert got[i]["payload_bytes"] == len(want) and got[i]["payload_sha256"] == hashlib.sha256(want).hexdigest() and got[i]["n_bytes"] == len(raw)
        assert got[i]["tail_crc32"] == zlib.crc32(want[-32:]) and got[i]["detected"] == "audio/wav" and got[i]["corrected"] and got[i]["media_bytes"] == len(want) + 44
    assert media.inspect_media(media.encode_media(empty(spark))).count() == 0


def test_sniffing_and_carving(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02L\x01\0;"
    bmp = b"BM" + struct.pack("<IIII", 30, 0, 26, 12) + b"\0" * 12
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 2) + b"xx\xff\0y\xff\xd9"
    pdf, zip_ = b"%PDF-1.4\nxref\n0 0\ntrailer <<>>\nstartxref\n9\n%%EOF", b"PK\x03\x04" + b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", 0, 4, 0)
    kinds = [(png(), "image/png"), (gif, "image/gif"), (bmp, "image/bmp"), (jpeg, "image/jpeg"), (pdf, "application/pdf"), (zip_, "application/zip"), (media.wav_bytes(b"abc"), "audio/wav")]
    magic = media.automaton()
    for data, kind in kinds:
        assert media.sniffed(data, magic)[:2] == (kind, len(data))
        assert media.sniffed(data[:-3], magic)[0] is None or kind == "application/pdf" and False
        assert media.sniffed(b"junk" + data + b"tail", magic)[2] == [(kind, 4, len(data))]
    frame = spark.createDataFrame([(1, bytearray(b"zz" + png() + gif)), (2, None)], "doc_id long, media binary")
    assert [(r["type"], bytes(r["bytes"])) for r in media.carve_media(frame).orderBy("offset").collect()] == [("image/png", png()), ("image/gif", gif)]


def test_ends_of_pdf_and_zip():
    magic = media.automaton()
    pdf = b"%PDF-1.4\nxref\n0 0\ntrailer <<>>\nstartxref\n9\n%%EOF"
    longer = pdf + b"\n7 0 obj <<>>\nxref\n" + b"trailer <<>>\nstartxref\n%d\n%%%%EOF" % (len(pdf) + 14)
    linear = b"%PDF-1.5\nxref\nstartxref\n0\n%%EOF\n12 0 obj\nstartxref\n32\n%%EOF"
    stream = b"x" + longer + b"\n" + linear + b"%PDF-1.7 no end"
    assert media.sniffed(stream, magic)[2] == [("application/pdf", 1, len(longer)), ("application/pdf", 2 + len(longer), len(linear))]
    end = lambda size, start: b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", size, start, 0)
    inner = b"PK\x03\x04" + b"a" * 9 + end(0, 13)
    outer = b"PK\x03\x04head" + inner + b"tail" + end(4, 8 + len(inner))
    assert media.sniffed(b"z" + outer, magic)[2] == [("application/zip", 1, len(outer))]


@pytest.mark.parametrize("piece", [b"%PDF-", b"%PDF-%%EOF", b"PK\x03\x04", b"PK\x05\x06" + b"\0" * 3, b"RIFF\x10\0\0\0WAVE", b"RIFF\0\0\0\0", b"GIF89a\x01", b"GIF87a" + b"!" * 9, b"\xff\xd8\xff\xda\0\2", b"\xff\xd8\xff\xe0\0\4", b"BM", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"xref 1 0 obj startxref 5 %%EOF%PDF-"])
def test_sniffing_is_linear(piece):
    magic, took = media.automaton(), []
    for size in (200_000, 800_000):
        data = piece * (size // len(piece))
        began = time.process_time()
        media.sniffed(data, magic)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.3


# --- URL filters


def test_hosts(spark):
    urls = {"http://a@b@bad.com/": "bad.com", "http://bad%2ecom/": "bad.com", "http://[::1]:80/x": "[::1]", "  http://bad.com": "bad.com", "http:\\\\bad.com\\x": "bad.com", "//bad.com/x": "bad.com", "http://BAD.com..": "bad.com", "http://a%zz/": "a%zz", "http://u:p@h:1?x@y": "h", "http:///": None, "mailto:a@b": None, "": None, "http://a+b/": "a+b"}
    rows = spark.createDataFrame(list(urls.items()), "url string, want string").select(url_filter.host_of(F.col("url")).alias("got"), "want", "url").collect()
    assert [(r["url"], r["got"]) for r in rows] == [(r["url"], r["want"]) for r in rows]


def test_url_filter(spark):
    entries = spark.createDataFrame([("a.com", "2024-01-01", "add", "x"), ("a.com", "2024-02-01", "remove", "x"), ("s.b.com", "2024-01-01", "remove", "y"), ("b.com", "2024-01-01", "add", "y"), ("a.com", "2024-03-01", "add", "z"), ("a.com", "2024-03-01", "remove", "z"), (None, "2024-01-01", "add", "n"), ("c.com", None, "add", "n"), ("b.com", "2024-01-01", "add", "y")], "domain string, entry_date string, action string, category string")
    rows = [(1, "http://A.com/x", "2024-01-31"), (2, "https://u@www.a.com:80", "2024-02-01"), (3, "http://s.b.com.", "2024-05-01"), (4, "http://b.com", "2023-12-31"), (5, None, "2024-01-01"), (6, "nonsense", "2024-01-01"), (7, "http://a.com", None), (8, "http://a.com", "2024-03-05"), (1, "http://A.com/x", "2024-01-31")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_date string").withColumn("category", F.lit("clash"))
    got = [(r["page_id"], r["blocked"], r["matched_domain"]) for r in url_filter.filter_urls(captures, entries).orderBy("page_id").collect()]
    assert got == [(1, True, "a.com"), (1, True, "a.com"), (2, False, None), (3, True, "b.com"), (4, False, None), (5, False, None), (6, False, None), (7, False, None), (8, False, None)]
    assert url_filter.filter_urls(captures.where("false"), entries.where("false")).count() == 0


def test_url_filter_of_several_categories(spark):
    dated = [("01-01", "add", "x"), ("02-01", "remove", "y"), ("03-01", "add", "y"), ("03-01", "remove", "z"), ("03-01", "add", "a"), ("04-01", "remove", "y"), ("04-01", "remove", "a"), ("05-01", "remove", "x"), ("06-01", "add", None), ("06-02", "remove", "x")]
    entries = spark.createDataFrame([("a.com", f"2024-{d}", a, c) for d, a, c in dated], "domain string, entry_date string, action string, category string")
    days = ["2023-12-31", "2024-01-01", "2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01", "2024-06-03"]
    captures = spark.createDataFrame([(i, "http://a.com", d) for i, d in enumerate(days)], "page_id long, url string, fetch_date string")
    got = [(r["blocked"], r["category"], str(r["listed_since"])[5:]) for r in url_filter.filter_urls(captures, entries).orderBy("page_id").collect()]
    x = (True, "x", "01-01")
    assert got == [(False, None, ""), x, x, (True, "a", "03-01"), x, (False, None, ""), (True, None, "06-01")]


def test_url_filter_sql_of_several_categories(spark):
    """The SQL makes intervals as the operator does, where a host is its own domain and another's parent."""
    import duckdb

    from ledgerline.llm import queries

    hosts = ["aa.bb.cc", "x.aa.bb.cc", "bb.cc", "y.x.aa.bb.cc", "zz.bb.cc", "a.b"]
    pages = [(k, f"http://{h}/p{k}") for k in range(360) for h in [hosts[k % len(hosts)]]] + [(1000, None), (1001, "no host")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    ours = url_filter.filter_urls(*queries.captures_and_lists(frame))
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    theirs = con.execute(queries.ORACLE["op3_url_filter"])
    columns = [c[0] for c in theirs.description]
    got = sorted(map(tuple, ours.select(*columns).collect()), key=str)
    assert got == sorted(theirs.fetchall(), key=str)
    categories = {r[columns.index("category")] for r in got}
    assert categories == {"host", "parent", None}


# --- chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))


def test_chat(spark):
    chosen = turns(spark, [(1, 1, "assistant", "hé"), (1, 0, "user", "q"), (2, 0, "user", None), (None, 0, "user", "x"), (3, 0, "user", "a"), (4, 0, None, None)])
    rejected = turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", ""), (3, 0, "user", "b"), (4, 0, "user", "x")])
    got = {r["pair_id"]: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one["prompt"] == "<|user|>\nq\n" and one["chosen"] == "<|assistant|>\nhé\n" and one["prompt_turns"] == 1
    a, b = map(int, one["rejected_mask"].split(":"))
    assert one["rejected"][a:b] == "no" and one["rejected"].endswith("<|user|>\nwhy\n")
    assert got[2]["chosen"] == got[2]["rejected"] == got[2]["chosen_mask"] == "" and got[2]["prompt_turns"] == 1
    assert got[3]["prompt"] == "" and got[3]["prompt_turns"] == 0
    assert chat.format_preferences(chosen.where("false"), rejected).count() == 0


def test_chat_of_many_turns_and_marks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i} <|assistant|>" + "é" * (i % 5)) for i in range(1500)]
    got = chat.format_preferences(turns(spark, rows), turns(spark, rows[:3])).first()
    spans = [tuple(map(int, x.split(":"))) for x in got["chosen_mask"].split(",")]
    assert [got["chosen"][a:b] for a, b in spans] == [r[3].replace("<|", "< |") for r in rows[3:] if r[2] == "assistant"]
    assert got["chosen"].count("<|") == 1497 and got["rejected_mask"] == ""


# --- SQL of this subpackage's queries


@pytest.mark.parametrize("name", ["op2_topk", "op3_url_filter", "op10_chat", "op11_secrets", "op12_middle", "op13_lexical"])
def test_same_as_sql(spark, name):
    import duckdb

    from ledgerline.llm import queries

    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.01"), con.execute(queries.ORACLE[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(tuple, ours.select(*columns).collect()), key=str) == sorted(theirs.fetchall(), key=str)


# --- shared


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.scratch_dir(Session())


def test_offsets_of_a_very_long_conversation(spark):
    """Each turn's size is taken once, however many turns there are."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("pair_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("said").alias("text")).withColumnRenamed("id", "turn")
    began = time.time()
    got = chat.format_preferences(rows, rows.where("turn < 10")).first()
    assert time.time() - began < 60
    spans = [tuple(map(int, s.split(":"))) for s in got["chosen_mask"].split(",")]
    assert got["prompt_turns"] == 10 and len(spans) == 19_995 and all(got["chosen"][a:b] == "said" for a, b in spans)


# --- added spans on held-out texts


def mention(text, a, kind, b):
    """A later mention of a base span that the patterns don't see."""
    own = text[a:b]
    digits = pii.digits_of(own)
    return [own.partition("@")[0], "-".join(own.split(".")), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits[-10:-7] + "-" + digits[-7:-4] + "-" + digits[-4:]][kind]


def added_on_mentions(texts, field):
    """Mentions, how many of them are found with their kind, and how many spans are added elsewhere."""
    asked = found = wrong = 0
    for text in texts:
        wanted = {}
        base = pii.base_spans(text)
        for a, kind, b in base:
            again = mention(text, a, kind, b)
            if kind == 0 and len(again) < 4 or kind == 1 and len(pii.digits_of(again)) < 4:
                continue
            text += " plain words stand here"
            wanted[len(text) + 1, kind, len(text) + 1 + len(again)] = True
            text += " " + again
        if pii.base_spans(text) != base:
            continue  # the mention is a span of its own
        got = pii.added_spans(text, base, field, 0.9)
        asked, found, wrong = asked + len(wanted), found + sum(s in wanted for s in got), wrong + sum(s not in wanted for s in got)
    return asked, found, wrong


def test_skips_find_mentions(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2))
    field = pii.train_pii(d.where(fold == 0))
    texts = [r["text"] for r in d.where((fold == 1) & F.col("text").rlike("[0-9@]")).orderBy("doc_id").collect()]
    asked, found, wrong = added_on_mentions(texts, field)
    assert asked > 20 and found >= 0.9 * asked and wrong <= 0.05 * found
    alone = pii.Field(field.weights[0], field.weights[1], np.zeros((5, 5)), np.zeros((5, 5)), field.weights[4])
    assert added_on_mentions(texts, alone)[1] < 0.3 * asked


def test_addresses_with_many_zeros():
    for zeros in (4301, 10_000):
        assert pii.base_spans("0" * zeros + "1.2.3.4") == [(0, 1, zeros + 7)]
        assert pii.base_spans("x 1.2.3." + "0" * zeros) == [(2, 1, zeros + 8)]
        assert pii.base_spans("1" + "0" * zeros + ".2.3.4") == []


def test_tokens_of_many_addresses():
    text = "host 10.20.30.40 up " * 20_000
    base = pii.base_spans(text)
    began = time.time()
    assert len(base) == 20_000 and len(pii.Tokens(text, base).label) == 20_000
    assert time.time() - began < 10


@pytest.mark.parametrize("mentions", [500, 20_000])
def test_an_address_and_many_mentions(mentions):
    """The messages of so many mentions multiply to less than a double holds; each mention still gets its label."""
    text = "write to john.miller@site.org today " + "and john.miller said so " * mentions
    began = time.time()
    field = pii.Field(np.zeros((pii.N_FEATURES, pii.N_LABELS)), np.zeros((pii.N_LABELS, pii.N_LABELS)), 7 * np.eye(pii.N_LABELS))
    p = field.marginals(pii.Tokens(text, pii.base_spans(text)))
    assert p.shape == (mentions + 1, pii.N_LABELS) and (p[:, 1] > 0.99).all()
    assert time.time() - began < 30


def test_skips_to_similar_tokens():
    t = pii.Tokens("write to jane.roe@x.example.com or ask jane.roe (Jane.Roe) at 4111111111111111 not 4111111111111112 nor 4111111111119912", [])
    names = [t.spans[i] for i in range(len(t.spans))]
    assert len(names) == 6 and t.skips == {(0, 1): 1, (1, 2): 0, (3, 4): 1}
    text = "+1 (988) 555-2485 then 988-555-2485"
    t = pii.Tokens(text, pii.base_spans(text))
    assert t.label == [4, 4, 4, 0] and (2, 3) in t.skips
