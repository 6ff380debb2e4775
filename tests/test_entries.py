import datetime as dt

import pytest
from pyspark.sql import functions as F

from keystride.operators import expiry
from keystride.streaming.entries import refills_in_state

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def requests(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=40 * i + 7 * (i % 9 == 0)), f"k{i % 4}" if i < 150 else f"n{i}") for i in range(300)]
    rows += [(1000 + i, START + dt.timedelta(seconds=40 * i), "k1") for i in range(0, 300, 50)]
    frame = spark.createDataFrame(rows, "req_id bigint, t timestamp_ntz, prefix string")
    frame = frame.select("req_id", F.col("t").cast("timestamp").alias("ts"), "prefix")
    for part in range(5):
        low, high = (START + dt.timedelta(seconds=2400 * n) for n in (part, part + 1))
        frame.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.parquet(f"{tmp_path}/log/part={part}")
    return frame, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/part=*")


def test_refills_equal_the_batch_and_state_holds_live_keys_only(spark, requests, tmp_path):
    frame, stream = requests
    ttl = 600_000
    out = refills_in_state(stream, "prefix", ttl, "1 second")
    query = out.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(
        str(tmp_path / "filled"))
    query.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "filled"))
    want = expiry.refills(frame, "prefix", ttl).select("prefix", "filled_ms", "req_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # 154 keys were asked for; a file spans four lifetimes, so few of its keys outlive it by another.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert want.select("prefix").distinct().count() == 154 and held[-1] <= 80
