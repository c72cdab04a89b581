"""The pN_ queries over the smallest tables, against SQL where there is some."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
from lodestone.llm import oracle, queries  # noqa: E402

COLUMNS = {"p1_found": ["row_id"], "p3_found": ["pair_id", "defect"], "p4_found": ["plan_id", "source"], "p5_ids": ["doc_id", "ids"], "p6_found": ["doc_id", "item_id"], "p7_found": ["doc_id", "level"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = df.toPandas()
    assert len(got)
    if name in oracle.SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = c.sql(oracle.SQL[name]).df()[list(got.columns)]
        assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
