import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_flagship_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from gleanery.plans import queries
    from tools.compare import rows

    db = duckdb.connect()
    for p in os.listdir(SMALL):
        db.execute(f"create view {p.removesuffix('.parquet')} as select * from '{SMALL}/{p}'")
    for name in ("s5_tokens", "r1_closure", "j11_classified_calls", "a17_collisions", "j22_a19_resolve", "w6_innermost_ranges"):
        df = queries.QUERIES[name](spark, SMALL)
        ref = db.execute(queries.SQL[name])
        names = [c[0] for c in ref.description]
        assert rows(df.columns, df.collect()) == rows(names, ref.fetchall()), name
