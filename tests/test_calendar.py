"""Claim numbers on days with more claims than three digits can number."""

import datetime

import duckdb

from loredeck import registry


def test_claim_numbers_beyond_three_digits_equal_the_sql(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(seconds=i // 2), "error" if i % 50 else "view", i % 7) for i in range(1100)]
    rows += [(2000 + i, begin + datetime.timedelta(days=1, seconds=i), "error", i) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry.queries()["claim_numbers"](spark, str(tmp_path)).select("event_id", "claim").collect()))
    with duckdb.connect() as duck:
        duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        want = sorted(duck.execute(registry.oracles()["claim_numbers"]).fetchall())
    assert got == want and len(got) > 1000
