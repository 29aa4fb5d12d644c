"""Queries on the smallest tables; top-k, line dedup and URL rules against SQL."""

import duckdb
import pytest

from taxoloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in got) == sorted(tuple(map(str, r)) for r in cur.fetchall())


def test_top_k_sql_on_repeated_ids(spark, tmp_path):
    """Rows of one vec_id are candidates of each other."""
    vectors = [(i % 3 * 100, [float(i % 5), 1.0 - i % 2]) for i in range(14)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["op1_top_k"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    want = con.execute(ORACLES["op1_top_k"]).fetchall()
    assert len(want) == 140 and sorted(map(tuple, got)) == sorted(want)
