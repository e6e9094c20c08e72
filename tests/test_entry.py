import os

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["compress_fe_cluster", "demean_2fe", "mundlak_2fe", "bins_qs", "binscatter_11", "predict_confidence"])
def test_queries_match_their_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert got.astype(want.dtypes.to_dict()).equals(want)
