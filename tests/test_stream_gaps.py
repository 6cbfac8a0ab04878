"""The filled daily stream over several micro-batches equals the batch resample."""

import datetime as dt

import pytest

from trendlake.operators import series
from trendlake.streaming.daily import daily_sum_filled_stream

SCHEMA = "k string, ts timestamp, v double"


@pytest.mark.parametrize("by", [["k"], []])
def test_days_without_rows_are_zero_and_come_once(spark, tmp_path, by):
    batches = [
        [("a", "2020-01-01T10:00", 1.0), ("a", "2020-01-04T10:00", 2.0), ("b", "2020-01-02T01:00", 5.0), (None, "2020-01-03T00:00", 4.0)],
        [("a", "2020-01-04T12:00", 3.0), ("a", "2020-01-09T10:00", 7.0), ("b", "2020-01-08T01:00", None)],  # the 4th once more, still open
        [("a", "2020-01-02T12:00", 100.0), ("a", "2020-02-20T10:00", 7.0), ("b", "2020-02-21T01:00", 6.0)],  # the 2nd is too late
        [("b", "2020-03-20T10:00", 1.0)],
    ]
    seen = []
    for part in batches:
        rows = [(k, dt.datetime.fromisoformat(t), v) for k, t, v in part]
        seen += [r for r in rows if r[2] != 100.0]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = (
            daily_sum_filled_stream(stream, "ts", "v", by=by).writeStream.outputMode("append").format("parquet")
            .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    finished = [r for r in seen if r[1] < dt.datetime(2020, 3, 19)]
    want = [tuple(r) for r in series.daily_sum(spark.createDataFrame(finished, SCHEMA), "ts", "v", by=["k"] if by else []).collect()]
    if by:  # the batch form joins its spine on the key, so a series without a key is compared by hand
        want = [r for r in want if r[0] is not None] + [(None, dt.date(2020, 1, 3), 4.0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
