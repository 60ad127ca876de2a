"""The registered projection holds all rows of lineitem."""

import duckdb
import numpy as np

from sinoflow.operators import transforms as T
from sinoflow.queries import QUERIES


def test_project_takes_all_rows(spark, small):
    v = np.zeros((7, 17, 17))
    for s, r, c, q in duckdb.sql(f"SELECT l_linenumber - 1, l_partkey % 16, l_orderkey % 15, sum(l_quantity) FROM '{small}/lineitem.parquet' GROUP BY ALL").fetchall():
        v[s, r, c + 1] = q
    got = np.zeros((7, 12, 17))
    for x in QUERIES["project"](spark, small).collect():
        got[x["slice_id"], x["row_id"], x["col_id"]] = x["value"]
    assert np.allclose(got, [T.project_slice(m, T.even_angles(12)) for m in v], atol=1e-4)
