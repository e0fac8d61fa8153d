"""Expiry of stored tiers, cold reads by a kept schema."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.sources import files

LAST = datetime(2024, 3, 10, 12)
LAYOUTS = {"hot": files.write_hot, "warm": files.write_warm, "cold": files.write_cold}


def logs(spark, hours):
    rows = [(f"m{h}", LAST - timedelta(hours=h), "a", "INFO") for h in hours]
    return spark.createDataFrame(rows, "message STRING, timestamp TIMESTAMP, service STRING, level STRING")


def read(spark, tier, path):
    return files.read_cold(spark, path) if tier == "cold" else spark.read.parquet(path)


@pytest.mark.parametrize("tier", sorted(LAYOUTS))
def test_expiry_drops_whole_partitions_and_rewrites_the_cut_one(spark, tmp_path, tier):
    path = str(tmp_path / tier)
    hours = range(0, 24 * 45, 7)
    LAYOUTS[tier](logs(spark, hours), path)
    before = datetime(2024, 2, 20, 9, 30)
    first = files.partitions(spark, path)[0]
    done = files.expire(spark, path, before)
    assert done["rewritten"] == [{"hot": "event_date=2024-02-20", "warm": "event_month=2024-02", "cold": "year=2024/month=02/day=20"}[tier]]
    assert first[0] in done["dropped"] and len(done["dropped"]) == {"hot": 26, "warm": 1, "cold": 26}[tier]
    kept = sorted(r.message for r in read(spark, tier, path).collect())
    assert kept == sorted(f"m{h}" for h in hours if LAST - timedelta(hours=h) > before)
    assert files.expire(spark, path, before) == {"dropped": [], "rewritten": done["rewritten"]}
    assert sorted(r.message for r in read(spark, tier, path).collect()) == kept


@pytest.mark.parametrize("tier", sorted(LAYOUTS))
def test_a_cut_partition_without_later_rows_goes(spark, tmp_path, tier):
    path = str(tmp_path / tier)
    LAYOUTS[tier](logs(spark, [0, 24 * 60]), path)
    done = files.expire(spark, path, LAST - timedelta(days=60) + timedelta(minutes=1))
    assert len(done["dropped"]) == 1 and done["rewritten"] == []
    assert [r.message for r in read(spark, tier, path).collect()] == ["m0"]


def test_partitions_of_all_layouts(spark, tmp_path):
    for tier, write in LAYOUTS.items():
        write(logs(spark, [0, 24 * 40]), str(tmp_path / tier))
    found = {t: files.partitions(spark, str(tmp_path / t)) for t in LAYOUTS}
    assert [p[1:] for p in found["hot"]] == [p[1:] for p in found["cold"]] == [(date(2024, 1, 30), date(2024, 1, 31)), (date(2024, 3, 10), date(2024, 3, 11))]
    assert found["warm"] == [("event_month=2024-01", date(2024, 1, 1), date(2024, 2, 1)), ("event_month=2024-03", date(2024, 3, 1), date(2024, 4, 1))]
    assert files.partitions(spark, str(tmp_path / "nothing")) == []
    assert files.drop_days_before(spark, str(tmp_path / "warm"), date(2024, 2, 1)) == ["event_month=2024-01"]


def test_cold_files_outside_the_range_are_not_opened(spark, tmp_path):
    """The other days hold files that can't be read."""
    path = tmp_path / "cold"
    files.write_cold(logs(spark, range(0, 24 * 5, 3)).withColumn("n", F.lit(1)), str(path))
    files.write_cold(logs(spark, [1]).withColumn("more", F.lit("x")), str(path))
    for file in path.glob("year=2024/month=03/day=0[6-8]/*.json"):
        file.with_suffix(".json.gz").write_bytes(b"not gzip")
    got = files.read_range(spark, {"cold": str(path)}, datetime(2024, 3, 9), datetime(2024, 3, 9, 23, 59), LAST + timedelta(days=90))
    assert sorted(r.timestamp for r in got.collect()) == [datetime(2024, 3, 9, h) for h in range(0, 24, 3)]
    assert {"n", "more"} <= set(got.columns)
    with pytest.raises(Exception):
        files.read_range(spark, {"cold": str(path)}, datetime(2024, 3, 7), datetime(2024, 3, 9), LAST + timedelta(days=90)).collect()
