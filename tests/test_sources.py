"""Files in and out, tier tables, and streams against their batch forms."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from logspark.operators import alerts, multiline, topology
from logspark.plans.adapters import Tables
from logspark.sources import files, intake
from logspark.streaming import jobs

SF = "/root/testdata/sf0.001"
AT = datetime(2024, 1, 1)


def test_land_read_and_list(spark, tmp_path):
    path = str(tmp_path / "logs")
    files.land_lines(spark.createDataFrame([("a",), ("b",)], "value STRING").coalesce(1), path)
    files.land_lines(spark.createDataFrame([("c",)], "value STRING").coalesce(1), path)
    lines = files.read_lines(spark, path)
    assert sorted(r["value"] for r in lines.collect()) == ["a", "b", "c"]
    names = [r for r in files.catalogue(spark, path).collect() if r["filename"].endswith(".txt")]
    assert sum(r["size_bytes"] for r in names) == 6 and names[0]["modified_at"] >= names[-1]["modified_at"]


def test_numbered_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "x.log").write_text("\n".join(f"line {i}" for i in range(500)))
    rows = files.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["value"] for r in rows] == [f"line {i}" for i in range(500)]


def test_csv_export_escapes_quotes(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([('say "hi", now', 1)], "message STRING, n INT")
    files.export_csv(df, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert back["message"] == 'say "hi", now'


def test_tier_tables_round_trip(spark, tmp_path):
    logs = Tables(spark, SF).logs
    for name, write, read in (("hot", files.write_hot, "parquet"), ("warm", files.write_warm, "parquet"), ("cold", files.write_cold, "json")):
        path = str(tmp_path / name)
        write(logs, path)
        assert spark.read.format(read).load(path).count() == logs.count()
    warm = spark.read.parquet(str(tmp_path / "warm")).where("event_month = '2024-01'")
    assert "PartitionFilters: [isnotnull(event_month" in warm._jdf.queryExecution().executedPlan().toString()


def test_day_repair_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "hot")
    files.write_hot(Tables(spark, SF).logs, path)
    table = spark.read.parquet(path)
    days = table.select("event_date").distinct().count()
    one_day = spark.createDataFrame([("new", AT + timedelta(hours=1))], "id STRING, timestamp TIMESTAMP_NTZ").withColumn("event_date", F.to_date("timestamp"))
    files.overwrite_days(one_day, path)
    after = spark.read.parquet(path)
    assert after.where(F.col("event_date") == F.lit(AT.date())).count() == 1
    assert after.select("event_date").distinct().count() == days


def test_topology_export(spark, tmp_path):
    t = Tables(spark, SF)
    files.export_topology(topology.service_rollup(t.spans), topology.dependencies(t.spans), t.deployments, str(tmp_path))
    assert all((tmp_path / n).is_dir() for n in ("services", "dependencies", "deployments"))


def test_bad_json_goes_to_quarantine(spark):
    df = spark.createDataFrame([("logs", '{"a":1}', AT), ("logs", "{a", AT)], "topic STRING, value STRING, timestamp TIMESTAMP")
    parts = intake.split_signals(intake.envelopes(df))
    assert (parts["log"].count(), parts["quarantine"].count()) == (1, 1)


def stream_of(spark, tmp_path, df, pieces):
    """Write rows as several files and read them back as a stream, one file per batch."""
    folder = str(tmp_path / "in")
    for part in pieces:
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
    return jobs.file_stream(spark, folder, df.schema, files_per_trigger=1)


def test_stream_multiline_over_several_batches(spark, tmp_path):
    lines = ["Exception one", "  at a.b", "  at c.d", "fine", "Error two", "  more", "fine", "last"]
    rows = [("s", i, AT + timedelta(seconds=i * 0.5 + (60 if i > 5 else 0)), x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "source STRING, line_no BIGINT, timestamp TIMESTAMP, value STRING")
    stream = stream_of(spark, tmp_path, df, ["line_no < 2", "line_no >= 2 AND line_no < 5", "line_no >= 5"])
    got = jobs.run_available(jobs.multiline_entries(stream), "test-multiline").orderBy("line_no").collect()
    want = multiline.join_lines(df.drop("timestamp")).orderBy("line_no").collect()
    assert [(r["line_no"], r["value"], r["lines"]) for r in got] == [(r["line_no"], r["value"], r["lines"]) for r in want]


def test_stream_first_alerts_and_groups(spark, tmp_path):
    rows = [("r", "s", AT + timedelta(seconds=20 * i), "critical") for i in range(6)] + [("r", "t", AT + timedelta(hours=2), "info")]
    df = spark.createDataFrame(rows, "rule_name STRING, service STRING, ts TIMESTAMP, severity STRING")
    stream = stream_of(spark, tmp_path, df, ["true"])
    assert jobs.run_available(jobs.first_alerts(stream), "test-first").count() == 2
    groups = jobs.run_available(jobs.alert_groups(stream), "test-groups").collect()
    assert {g["alerts"] for g in groups} == {2} and len(groups) == 2  # at 0 and 20 s, at 60 and 80 s


def test_fan_out_batch_that_runs_twice_leaves_rows_once(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(10)], "n INT")
    stream = stream_of(spark, tmp_path, df, ["true"])
    for attempt in ("c1", "c2"):
        jobs.fan_out(stream, {"all": lambda b: b}, str(tmp_path / "out"), str(tmp_path / attempt)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "all")).count() == 10


def test_payload_is_json(spark):
    df = spark.createDataFrame([("t", "critical", 'a "b"', 3, "5m", "q", "m")], "title STRING, level STRING, service STRING, count INT, time_range STRING, query STRING, message STRING")
    payloads = [json.loads(r["payload"]) for r in alerts.ticket_outbox(df).collect()]
    assert payloads[0]["urgency"] == "1" and payloads[1]["fields"]["priority"]["name"] == "Highest"


def test_range_reads_only_its_tiers_and_days(spark, tmp_path):
    from datetime import datetime

    from logspark.operators import search
    from logspark.sources import files

    now = datetime(2024, 3, 1)
    rows = [(datetime(2024, 2, 28, 5), "svc", "INFO", "a"), (datetime(2024, 2, 10), "svc", "INFO", "b"), (datetime(2024, 1, 5), "svc", "INFO", "c"), (datetime(2024, 2, 27), "svc", "INFO", "d")]
    logs = spark.createDataFrame(rows, "timestamp TIMESTAMP, service STRING, level STRING, message STRING")
    paths = {t: str(tmp_path / t) for t in ("hot", "warm", "cold")}
    files.write_hot(logs.where("message IN ('a', 'd')"), paths["hot"])
    files.write_warm(logs.where("message = 'b'"), paths["warm"])
    files.write_cold(logs.where("message = 'c'"), paths["cold"])

    def found(start, end, which=paths):
        return sorted(r["message"] for r in files.read_range(spark, which, start, end, now).collect())

    assert found(datetime(2024, 1, 1), now) == ["a", "b", "c", "d"]
    assert found(datetime(2024, 2, 1), datetime(2024, 2, 27, 12)) == ["b", "d"]
    # A tier outside of the range is not touched: its folder need not exist.
    assert found(datetime(2024, 2, 28), now, {**paths, "cold": "/no/such/folder", "warm": "/no/such/folder"}) == ["a"]
    hot = spark.read.parquet(paths["hot"])
    for frame in (
        files.read_range(spark, paths, datetime(2024, 2, 28), now, now),
        search.within(hot, "24h", as_of=now),
        search.entries(hot, start=datetime(2024, 2, 28)),
        search.fielded(hot, end=datetime(2024, 2, 27)),
        search.quick_search(hot, time_range="1h", as_of=now),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan, plan
