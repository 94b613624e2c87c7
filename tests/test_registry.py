import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 80


@pytest.mark.parametrize("name", ["label_window", "rank_metrics", "hotspots", "threshold_sweep"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    from tools.check_oracles import compare

    assert compare(entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()) == "ok"
