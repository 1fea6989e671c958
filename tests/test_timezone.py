"""Time-sensitive keys give the same values whatever the session time zone."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import _rows  # noqa: E402
from crowdtally.sources.tables import DRIVER_TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = ["timeline", "timeline_events", "stream_timeline", "read_posts_json", "page_post_counts", "history"]


@pytest.mark.parametrize("tz", ["America/New_York", "Asia/Kolkata"])
def test_time_keys_under_other_session_time_zones(spark, tz):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        for k in KEYS:
            df = E.queries()[k](spark, SF)
            res = con.execute(E.oracle_sql()[k])
            cols = [d[0] for d in res.description]
            assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(cols, res.fetchall()), k
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
