"""Numbers in names that outgrow their zeros."""

import duckdb

from vistalog.plans import ingestion
from vistalog.plans.adapters import table

SMALL = "/root/testdata/sf0.001"


def test_prediction_records_of_over_ten_thousand_detections_a_sample(spark, tmp_path):
    orders = table(spark, SMALL, "orders").limit(40)
    orders.union(orders.selectExpr("o_orderkey + 9700000 as o_orderkey", *[c for c in orders.columns[1:]])).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    table(spark, SMALL, "embeddings").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    for t in ("orders", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    query, sql = ingestion.QUERIES["d6_prediction_records"]
    got = sorted(tuple(r)[:5] for r in query(spark, str(tmp_path)).collect())
    assert len(got) == 80 and any(r[0].rpartition("-")[2] >= "100000" and len(r[0].rpartition("-")[2]) == 6 for r in got)
    assert got == sorted(r[:5] for r in c.sql(sql).fetchall())
