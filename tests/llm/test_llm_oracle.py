"""The SQL of the training-data queries, run by DuckDB, gives the queries' rows."""

import pytest

from latebound.llm.queries import ORACLE_SQL, QUERIES
from scripts.check_oracle import compare, duck

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF001)
    con = duck(SF001)
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    rel = con.execute(ORACLE_SQL[name])
    got = compare([tuple(r) for r in df.collect()], df.columns, rel.fetchall(), [d[0] for d in rel.description])
    assert got == [], got
