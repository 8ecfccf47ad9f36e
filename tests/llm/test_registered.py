"""The registered queries against their SQL, over tables with nulls, copies, near copies, shared passages and linked vectors."""

import duckdb
import numpy as np
import pytest

from folioscope.llm.oracles import ORACLES
from folioscope.llm.queries import QUERIES

from test_llm import SCHEMA, make_texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", 1, 2, 3, True, 4) for i, t in enumerate(make_texts())]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 16))
    near = base[rng.integers(0, 20, 120)] + rng.normal(size=(120, 16)) * 0.03
    chain = [np.cos(a) * base[0] / np.linalg.norm(base[0]) + np.sin(a) * np.eye(16)[0] for a in np.arange(8) * 0.2]
    vectors = [v.tolist() for v in [*base, *near, *chain, base[5], base[5] * 4]]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    return sf


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    expected = con.sql(ORACLES[name]).select(*names).fetchall()
    same = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert same(tuple(r[c] for c in names) for r in got.collect()) == same(expected)
