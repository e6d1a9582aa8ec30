"""Each stage of the pipeline against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerline.llm import pii

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Stage name to the rows it got and gave."""
    out, docs = {}, spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = docs, after
        docs = after
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns_and_names(kept):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "pii", "packing"]
    for name in ("toxicity", "quality", "near_duplicates", "pii"):
        before, after = kept[name]
        assert after.columns == before.columns and set(ids(after)) <= set(ids(before))


def test_filters_follow_labels(spark, kept):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, bad in (("toxicity", "toxic = 1"), ("quality", "quality = 0")):
        before, after = kept[name]
        gone = set(ids(before)) - set(ids(after))
        clean = set(ids(before.join(labels.where(f"NOT ({bad})"), "doc_id")))
        assert len(gone & clean) <= 0.03 * len(clean)


def test_near_duplicates(kept):
    before, after = kept["near_duplicates"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(ids(after)) == [rows[i][0] for i in range(len(rows)) if find(i) == i]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, DATA)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "a b c"), ("3", None), ("None", "x")]


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rows = [(1, "one lone text"), (1, "one lone text"), (5, "zz the only one of its kind"), (5, "One  lone text"), (5, "another text of this id"), (6, "another text of this id"), (7, None), (7, " "), (7, None), (7, "seven"), (8, "One Lone Text"), (8, "one lone text"), (9, "b NINE"), (9, "B nine"), (9, "b  nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = pipeline.drop_near_duplicates(spark, docs, DATA).collect()
    assert all(r["n_chars"] == (r["text"] and len(r["text"])) for r in got)
    want = [(1, "one lone text"), (5, "another text of this id"), (5, "zz the only one of its kind"), (7, None), (7, " "), (7, "seven"), (9, "B nine")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_near_duplicates_of_rows_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda prefix, k: " ".join([prefix + w for w in words[:-1]] + [f"end{k}"])
    rows = [(None, near("a", 0)), (None, near("a", 1)), (None, near("b", 0)), (7, near("b", 1)), (None, "x  y"), (None, "X y"), (None, None), (None, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
    assert len([t for _, t in got if t and t.startswith("aw0")]) == 1
    rest = [(7, near("b", 1)), (None, "X y"), (None, None), (None, " ")]
    assert sorted((r for r in got if not (r[1] or "").startswith("aw0")), key=str) == sorted(rest, key=str)


def test_personal_data_is_gone(kept):
    before, after = kept["pii"]
    assert before.count() == after.count()
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in after.where(F.col("text").isNotNull()).collect())


def test_packing_holds_all(kept):
    before, after = kept["packing"]
    total = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert total.count() == before.count() and total.where("n <> t").count() == 0


def test_run(spark, kept):
    assert pipeline.run(spark, DATA).count() == kept["packing"][1].count()
