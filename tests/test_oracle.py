"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from rillflow.plans import catalog, registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if Path(p).is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def test_each_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_jobs_answer_to_their_names():
    assert set(registry.JOBS.values()) <= set(catalog.QUERIES)
    assert registry.query("nexmark_query5") is catalog.QUERIES["q5_hot_items"] and registry.query() is catalog.QUERIES["counter"]
    with pytest.raises(KeyError):
        registry.query("no such job")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
