"""Every query with SQL gives what DuckDB gives on the same tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans import registry, stores

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_numbers_that_double_precision_puts_beside_a_half(spark, tmp_path):
    values = [2985.0, 8495.0, 1005.0, 1125.0, 1375.0, 1234.565, 1.005, 2.125, 12.3449, 999.9996, 999.995, 1.0, 0.5, 0.0, -0.005, -999.99]
    rows = ", ".join(f"({k}, {k % 25}, {v}::DOUBLE)" for k, v in enumerate(values))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(c_custkey, c_nationkey, c_acctbal)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    ours, theirs = registry.QUERIES["number_formats"](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE["number_formats"]).df()
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_has_an_oracle_or_a_test():
    assert set(registry.QUERIES) == set(registry.ORACLE) | set(stores.WITHOUT_SQL)


@pytest.mark.parametrize("hidden", ["ahocorasick", "tokenizers", "ledgerline.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_operators(hidden):
    code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True)
    assert int(done.stdout) >= len(registry.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
