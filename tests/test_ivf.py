"""Approximate search against the exact one: recall, pairs met, sections, ties, nulls and empty tables."""

import numpy as np
import pytest

from ledgerline.operators import ivf, vectors
from ledgerline.plans import stores

SCHEMA = "id long, vector array<double>, section string"


def clustered(spark, n=8000, clusters=80, width=32):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(clusters, width))
    which = np.where(rng.random(n) < 0.33, 0, rng.integers(0, clusters, n))  # one cluster holds a third of the rows
    x = centres[which] + 0.25 * rng.normal(size=(n, width))
    return spark.createDataFrame([(i, v.tolist(), f"s{i % 2}") for i, v in enumerate(x)], SCHEMA).repartition(4)


def found(df):
    return {(r["query_id"], r["id"]): r["score"] for r in df.collect()}


def test_recall_and_pairs_on_clustered_rows(spark):
    rows = clustered(spark)
    queries = rows.where("id % 20 = 0")
    index = ivf.fit(rows, 10)
    exact, got = found(vectors.cosine_top_k(queries, rows, 10)), found(ivf.approximate_top_k(queries, rows, 10, index=index))
    assert len(set(exact) & set(got)) >= 0.95 * len(exact)
    assert all(got[pair] == pytest.approx(exact[pair]) for pair in set(exact) & set(got))
    met = ivf.probes(queries, index).groupBy("section", "cell").count().withColumnRenamed("count", "asked").join(ivf.indexed(rows, index).groupBy("section", "cell").count(), ["section", "cell"])
    share = met.selectExpr("sum(asked * count)").first()[0] / (queries.count() * rows.count() / 2)
    assert share < 0.2  # a third of all rows are one cluster; without it the share is a fiftieth


def test_few_pairs_on_even_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 32))[rng.integers(0, 80, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    rows = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], SCHEMA)
    index = ivf.fit(rows, 10)
    sizes = dict(map(tuple, ivf.indexed(rows, index).groupBy("cell").count().collect()))
    assert sum(sizes.values()) == 6000
    asked = ivf.probes(rows.where("id % 20 = 0"), index).groupBy("cell").count().collect()
    assert sum(n * sizes.get(cell, 0) for cell, n in asked) < 0.1 * 300 * 6000


def test_recall_on_the_table(spark):
    row = stores.ivf_recall(spark, "/root/testdata/sf0.01").first()
    assert row["recalled"] and row["wanted"] == 250


def test_a_fitted_index_takes_other_rows(spark):
    """The index is fitted on a part; rows that it hasn't seen are indexed, too."""
    rows = clustered(spark, 4000)
    index = ivf.fit(rows, 5, sample_rows=1500)
    queries = rows.where("id % 20 = 0")
    exact, got = found(vectors.cosine_top_k(queries, rows, 5)), found(ivf.approximate_top_k(queries, rows, 5, index=index))
    assert len(set(exact) & set(got)) >= 0.9 * len(exact)


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0], "a"), (2, [2.0, 0.0, 0.0, 0.0, 0.0], "a"), (3, [1.0, 0.0, 0.0, 0.0, 0.0], "a"), (4, [0.0] * 5, "a"), (5, [1.0, 1.0, 0.0, 0.0, 0.0], "b"), (None, [1.0] * 5, "a"), (7, None, "a"), (8, [1.0] * 5, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, ivf.approximate_top_k(frame.where("id <= 5"), frame, 2).collect()))
    assert [r[:3] for r in got if r[0] <= 3] == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert [r[3] for r in got if r[0] == 4] == [0.0, 0.0] and not [r for r in got if r[0] == 5]
    assert ivf.approximate_top_k(frame, frame.where("false"), 2).count() == 0
    assert ivf.approximate_top_k(frame.where("false"), frame, 2).count() == 0
