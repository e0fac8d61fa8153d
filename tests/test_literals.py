"""Hand-written cases for rules, patterns and bounds."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logspark.functions import levels, pii, text, timefx
from logspark.operators import alerts, anomaly, audit, enrich, metrics, multiline, parse, report, search, tiers, topology
from logspark.operators.ordered import nearest_rank
from logspark.sources import intake


def one(spark, value, column, name="v"):
    return spark.createDataFrame([(value,)], f"{name} STRING").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("p, want", [(500, 10), (950, 19)])
def test_nearest_rank(spark, p, want):
    df = spark.range(1, 21).withColumnRenamed("id", "x")
    assert nearest_rank(df, [], "x", {"r": p}).first()["r"] == want


def test_nearest_rank_handles_negative_equal_and_null_values(spark):
    values = [-5.5, -5.5, None, 0.0, 3.0, 3.0, 1e9]
    df = spark.createDataFrame([("k", v) for v in values], "k STRING, x DOUBLE")
    row = nearest_rank(df, ["k"], "x", {"low": 1, "mid": 500, "top": 1000}).first()
    assert (row["n"], row["low"], row["mid"], row["top"]) == (6, -5.5, 0.0, 1e9)


def figures(spark, line):
    df = spark.createDataFrame([(line,)], "value STRING")
    return text.with_line_figures(df, "value").first()


@pytest.mark.parametrize(
    "line, ms",
    [("latency: 1.23s", 1230.0), ("took 345 ms", 345.0), ("took 45 millisecond", 45.0), ('x "GET /" 200 123 45', 45.0), ("nothing here", None)],
)
def test_duration(spark, line, ms):
    assert figures(spark, line)["duration_ms"] == ms


def test_line_figures(spark):
    assert figures(spark, "GET / 200 1500ms")["is_error"]
    assert figures(spark, "payload 12")["load"] == 12.0
    assert figures(spark, "CPU usage: 85.5%  Memory usage 40 %")["cpu"] == pytest.approx(0.855)
    assert figures(spark, "mem util 40 %")["memory"] == pytest.approx(0.4)
    assert figures(spark, 'x "GET /" 200 123 45')["bytes"] == 123.0


def test_empty_report(spark):
    row = report.performance_report(spark.createDataFrame([("hello",)], "value STRING")).first()
    assert (row["requests"], row["p95"], row["error_rate"], row["cpu"]) == (0, 0.0, 0.0, None)


def test_report_capacity_rows_and_advice(spark):
    lines = ["took 1500 ms error", "cpu usage 90%", "memory usage 95%", "load avg 4.5", "took 100 ms"]
    r = report.performance_report(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert [x["category"] for x in report.nfr_rows(r).orderBy("nfr").collect()] == ["Latency", "Reliability", "Throughput", "Capacity", "Capacity"]
    assert report.recommendations(r).count() == 6


def test_app_line_level_must_be_exact(spark):
    lines = ["2024-01-15T10:30:00Z WARNING [x] GET /a", "2024-01-15T10:30:00Z warn [x] GET /a 12ms slow", "2024-01-15T10:30:00Z INFO [x] GET /b response_time=7ms"]
    rows = parse.app_entries(spark.createDataFrame([(x,) for x in lines], "value STRING")).orderBy("endpoint").collect()
    assert [(r["level"], r["endpoint"], r["response_time"]) for r in rows] == [("WARN", "/a", 12), ("INFO", "/b", 7)]


@pytest.mark.parametrize(
    "line, name, fields",
    [
        ('{"level":"warn","message":"hi"}', "json", {"level": "warn"}),
        ("2024-01-15T10:30:00Z ERROR db down", "kubernetes", {"stream": "ERROR", "log_type": "db", "message": "down"}),
        ("2024-01-15T10:30:00Z ERROR [x] down", "docker", {"level": "ERROR"}),
        ("2024-01-15 10:30:00 ERROR [main] com.shop.Cart: no stock", "java_stacktrace", {"thread": "main", "class": "com.shop.Cart", "message": "no stock"}),
        ("Jan 15 10:30:00 web1 nginx[12]: ready", "syslog", {"logsource": "web1", "program": "nginx", "pid": "12", "message": "ready"}),
        ('10.0.0.1 - bob [15/Jan/2024:10:30:00 +0000] "GET /a HTTP/1.1" 200 12', "apache_common", {"clientip": "10.0.0.1", "verb": "GET", "response": "200", "bytes": "12"}),
        ("<34>Oct 11 22:14:15 mymachine su: failed", "rfc3164", {"facility": "4", "severity_number": "2", "level": "FATAL"}),
        ('a=1 b="x y" a=2', "logfmt", {"a": "2", "b": "x y"}),
        ("a=1", "raw", {"message": "a=1"}),
        ("{broken", "raw", {"message": "{broken"}),
    ],
)
def test_formats(spark, line, name, fields):
    row = parse.read_fields(spark.createDataFrame([(line,)], "value STRING")).first()
    assert row["format"] == name
    assert {k: row["fields"].get(k) for k in fields} == fields


def test_custom_format(spark):
    row = parse.read_fields(spark.createDataFrame([("#7# boom",)], "value STRING"), formats={"ticket": r"#%{INT:number}# %{GREEDYDATA:message}"}).first()
    assert (row["format"], row["fields"]) == ("ticket", {"number": "7", "message": "boom"})


def test_bad_time_goes_to_quarantine(spark):
    logs = parse.parse_logs(spark.createDataFrame([('{"timestamp":"yesterday","message":"x"}',), ('{"timestamp":"2024-01-15T10:30:00+02:00","message":"y"}',), ("{oops",)], "value STRING"))
    assert {r["reason"] for r in parse.quarantine(logs).collect()} == {"bad_timestamp", "bad_json"}
    good = logs.where(F.col("message") == "y").first()
    assert good["timestamp"] == datetime(2024, 1, 15, 8, 30)


@pytest.mark.parametrize("level, want", [("warning", "WARN"), ("Err", "ERROR"), ("CRIT", "FATAL"), ("bogus", "INFO")])
def test_levels(spark, level, want):
    assert one(spark, level, levels.normalise_level(F.col("v"))) == want


def test_level_from_message(spark):
    assert one(spark, "disk WARNING now", levels.extract_level([], F.col("v"))) == "WARN"
    assert one(spark, "disk fine", levels.extract_level([F.lit("")], F.col("v"))) == "INFO"


@pytest.mark.parametrize("value, kind", [("true", "boolean"), ("null", "null"), ("12", "integer"), (".5", "double"), ("-3", "string")])
def test_coercion(spark, value, kind):
    assert one(spark, value, text.coerced(F.col("v"))["kind"]) == kind


@pytest.mark.parametrize("mode, want", [("hash", f"[EMAIL_{hashlib.sha256(b'a@b.co').hexdigest()[:8]}]"), ("mask", "[EMAIL_******]"), ("remove", "[EMAIL_REDACTED]")])
def test_record_redaction(spark, mode, want):
    assert one(spark, "to a@b.co!", pii.redacted(F.col("v"), mode)) == f"to {want}!"


def test_text_mask(spark):
    assert one(spark, "a@b.co", pii.redacted_text(F.col("v"), "mask")) == "a@**co"


@pytest.mark.parametrize("value, hits", [("123-45-6789", 1), ("000-12-3456", 0), ("666-12-3456", 0), ("900-12-3456", 0), ("é123-45-6789", 1)])
def test_ssn(spark, value, hits):
    assert one(spark, value, F.size(pii.all_matches(F.col("v"), "SSN", pii.RECORD_PATTERNS["SSN"]))) == hits


SAMPLES = {
    "EMAIL": "x.y+z@mail.example.org", "PHONE": "(555) 123-4567", "SSN": "123-45-6789", "CREDIT_CARD": "4111 1111 1111 1111", "IP_ADDRESS": "10.1.2.3",
    "MAC_ADDRESS": "00:1A:2b:3c:4D:5e", "API_KEY": "a1" * 20, "JWT_TOKEN": "eyJhbGci.eyJzdWIi.c2ln", "UUID": "123E4567-e89b-12d3-a456-426614174000",
    "PASSWORD": "Passwd: hunter2", "USERNAME": "login=bob",
}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_every_type_is_found_and_gone(spark, kind):
    found = pii.all_matches(F.col("v"), kind, pii.RECORD_PATTERNS[kind])
    line = f"see {SAMPLES[kind]} there"
    assert one(spark, line, F.size(found)) == 1
    for mode in pii.MODES:
        out = one(spark, line, pii.redacted(F.col("v"), mode))
        assert SAMPLES[kind] not in out and out.startswith("see ") and out.endswith(" there")


def test_redact_reaches_maps_and_structs(spark):
    df = spark.sql("SELECT map('mail', 'a@b.co') AS m, named_struct('who', 'a@b.co', 'n', 1) AS s, 7 AS n")
    row = pii.redact(df, "remove").first()
    assert (row["m"]["mail"], row["s"]["who"], row["s"]["n"], row["n"]) == ("[EMAIL_REDACTED]", "[EMAIL_REDACTED]", 1, 7)


def test_multiline(spark):
    lines = ["Exception", "  at a.b", "  ... 3 more", "ok"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source STRING, line_no BIGINT, value STRING")
    rows = multiline.join_lines(df, chunk_lines=2).orderBy("line_no").collect()
    assert [(r["value"], r["lines"]) for r in rows] == [("Exception\n  at a.b\n  ... 3 more", 3), ("ok", 1)]


def test_multiline_custom_start(spark):
    df = spark.createDataFrame([("s", 0, "Traceback"), ("s", 1, "  File x")], "source STRING, line_no BIGINT, value STRING")
    assert multiline.join_lines(df).count() == 2
    assert multiline.join_lines(df, custom_starts=["^Traceback"]).count() == 1


@pytest.mark.parametrize("days, seconds, want", [(7, 0, "hot"), (7, 1, "warm"), (30, 0, "warm"), (31, 0, "cold")])
def test_tier_bounds(spark, days, seconds, want):
    now = datetime(2024, 3, 1)
    df = spark.createDataFrame([(now - timedelta(days=days, seconds=seconds),)], "timestamp TIMESTAMP")
    assert tiers.assign_tier(df, as_of=now).first()["tier"] == want


def test_long_range_needs_all_tiers(spark):
    now = datetime(2024, 3, 1)
    df = spark.createDataFrame([(now - timedelta(days=40), now)], "s TIMESTAMP, e TIMESTAMP")
    assert df.select(tiers.tiers_for(F.col("s"), F.col("e"), F.lit(now)).alias("t")).first()["t"] == ["hot", "warm", "cold"]


@pytest.mark.parametrize("size, want", [(2, "low"), (3, "medium"), (6, "high"), (11, "critical")])
def test_blast_levels(spark, size, want):
    assert spark.range(1).select(topology.blast_severity(F.lit(size)).alias("s")).first()["s"] == want


@pytest.mark.parametrize("value, op, fires", [(0.05, ">=", True), (0.05, ">", False), (None, ">", False), (0.04, "<=", True)])
def test_rule_operators(spark, value, op, fires):
    m = spark.createDataFrame([(datetime(2024, 1, 1), "svc", "error_rate", value)], "ts TIMESTAMP, service STRING, name STRING, value DOUBLE")
    r = spark.createDataFrame([("r", "error_rate", op, 0.05, None, "critical", "", {}, True)], alerts.RULE_SCHEMA)
    assert alerts.evaluate_rules(m, r).first()["fired"] is fires


def test_fingerprints_differ(spark):
    df = spark.createDataFrame([("a", {}, "s"), ("b", {}, "s"), ("a", {"k": "v"}, "s")], "r STRING, l MAP<STRING,STRING>, s STRING")
    assert df.select(alerts.fingerprint(F.col("r"), F.col("l"), F.col("s"))).distinct().count() == 3


@pytest.mark.parametrize("calls, want", [(1, 1.1), (90, 10.0), (500, 10.0)])
def test_edge_strength(spark, calls, want):
    rows = [(1, 1, None, "a", "op")] + [(1, i + 2, 1, "b", "op") for i in range(calls)]
    spans = spark.createDataFrame([(t, s, p, v, o, datetime(2024, 1, 1), 1.0, False) for t, s, p, v, o in rows],
                                  "trace_id INT, span_id INT, parent_span_id INT, service STRING, operation STRING, start_time TIMESTAMP, duration DOUBLE, error BOOLEAN")
    row = topology.dependencies(spans).first()
    assert (row["calls"], row["strength"]) == (calls, pytest.approx(want))


def test_halving_mean(spark):
    df = spark.createDataFrame([("k", 1, 100.0), ("k", 2, 200.0)], "k STRING, i INT, x DOUBLE")
    assert topology.halving_mean(df, ["k"], ["i"], "x").first()["halving_mean"] == 125.0


def test_halving_mean_of_a_long_series_equals_the_loop(spark):
    values = [float(i % 97 + 1) for i in range(5000)]
    want = 0.0
    for v in values:
        want = (want + v) / 2
    df = spark.createDataFrame(list(enumerate(values)), "i INT, x DOUBLE").withColumn("k", F.lit("k"))
    assert topology.halving_mean(df, ["k"], ["i"], "x").first()["halving_mean"] == pytest.approx(want, rel=1e-12)


def test_path_prefers_few_hops_then_small_names(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")], "`from` STRING, to STRING")
    row = topology.path_between(edges, "a", "e").first()
    assert (row["path"], row["hops"]) == (["a", "b", "d", "e"], 3)
    assert topology.path_between(edges, "e", "a").count() == 0


def test_lockout_counts_since_last_success(spark):
    at = datetime(2024, 1, 1)
    actions = ["fail"] * 4 + ["ok"] + ["fail"] * 5
    rows = [(i, at + timedelta(minutes=i), "bob", "auth.success" if a == "ok" else "auth.failed", None if a == "ok" else "invalid_password") for i, a in enumerate(actions)]
    df = spark.createDataFrame(rows, "event_id INT, timestamp TIMESTAMP, actor STRING, action STRING, reason STRING")
    locked = audit.lockouts(df, chunk_seconds=120).collect()
    assert [(r["event_id"], r["attempts"]) for r in locked] == [(9, 5)]


def test_wildcard_permissions(spark):
    roles = spark.createDataFrame([("log-admin", ["logs:*"]), ("root", ["*"])], "role STRING, permissions ARRAY<STRING>")
    users = spark.createDataFrame([("ann", "log-admin"), ("bob", "root")], "user_name STRING, role STRING")
    asked = spark.createDataFrame([("ann", "logs:read"), ("ann", "users:read"), ("bob", "users:read"), ("eve", "logs:read")], "user_name STRING, permission STRING")
    got = {(r["user_name"], r["permission"]): r["granted"] for r in audit.access_review(asked, users, roles).collect()}
    assert got == {("ann", "logs:read"): True, ("ann", "users:read"): False, ("bob", "users:read"): True, ("eve", "logs:read"): False}


def test_spans_of_time():
    assert timefx.span_seconds("5m", m="minute") == 300
    assert timefx.span_seconds("1m", m="month") == 30 * 86400
    with pytest.raises(ValueError):
        timefx.span_seconds("soon", m="minute")


def test_all_words_match(spark):
    df = spark.createDataFrame([("Database timeout ERROR",), ("database ok",)], "message STRING")
    assert df.where(search.has_all_words("error database timeout")).count() == 1


def test_relevance_terms_are_literal(spark):
    df = spark.createDataFrame([("a.b a.b axb",)], "message STRING")
    assert search.relevance(df, "a.b").first()["score"] == 2


def test_word_count_counts_the_leading_blank(spark):
    assert one(spark, " a b", text.word_count(F.col("v"))) == 3


def test_ip_numbers(spark):
    assert one(spark, "10.0.0.1", enrich.ip_number(F.col("v"))) == 167772161
    assert one(spark, "10.0.0.999", enrich.ip_number(F.col("v"))) is None


def test_field_list_last_key_wins(spark):
    df = spark.sql("SELECT array('a', '1', 'b', '{\"x\":2}', 'a', '3') AS f")
    assert df.select(intake.field_list(F.col("f")).alias("m")).first()["m"] == {"a": "3", "b": '{"x":2}'}


def test_attributes_are_merged(spark):
    body = '{"msg":"m","attributes":{"a":"1","b":"1"},"labels":{"b":"2"},"tags":{"c":"3"}}'
    df = spark.createDataFrame([("logs", body, datetime(2024, 1, 1))], "topic STRING, value STRING, timestamp TIMESTAMP")
    assert intake.log_records(intake.envelopes(df)).first()["attributes"] == {"a": "1", "b": "2", "c": "3"}


def test_histogram_quantile_in_the_last_bucket(spark):
    df = spark.createDataFrame([(float(x),) for x in (9000, 9000, 1)], "x DOUBLE")
    hist = metrics.latency_histogram(df, "x")
    assert metrics.histogram_quantile(hist, 0.95).first()["quantile"] == 5000.0


def test_odd_numbers_end_no_job(spark):
    lines = spark.createDataFrame(
        [("2024-01-15T10:30:00Z ERROR [m] GET /a response_time=99999999999999999999ms x",), ('10.0.0.1 - - "GET /" 200 12e400 45',), ("took 5 ms",)], "value STRING"
    )
    assert [r["response_time"] for r in parse.app_entries(lines).collect()] == [0]
    assert report.performance_report(lines).collect()[0]["total_bytes"] is not None
    assert parse.app_entries(spark.createDataFrame([("2024-01-15T10:30:00Z INFO [m] GET /a 12345ms x",)], "value STRING")).first()["response_time"] == 12345


def test_zero_threshold_and_zero_budget(spark):
    from datetime import datetime

    rows = spark.createDataFrame([(datetime(2024, 1, 1), "svc", "error_rate", 0.5)], "ts TIMESTAMP, service STRING, name STRING, value DOUBLE")
    limits = spark.createDataFrame([("error_rate", 0.0)], "name STRING, threshold DOUBLE")
    assert anomaly.threshold_anomalies(rows, limits).first()["confidence"] == 1.0
    logs = spark.createDataFrame([(datetime(2024, 1, 1), "a", "ERROR"), (datetime(2024, 1, 1), "b", "INFO")], "timestamp TIMESTAMP, service STRING, level STRING")
    slos = spark.createDataFrame(
        [("x", "a", 1.0, None, "30d", None), ("y", "b", 1.0, None, "30d", None), ("z", "c", 0.9, None, "30d", None)],
        "slo STRING, service STRING, objective DOUBLE, error_budget DOUBLE, window STRING, burn_rate_threshold DOUBLE",
    )
    got = {(r["slo"], r["look_back"]): r for r in alerts.burn_rates(logs, slos, windows=("1h",)).collect()}
    assert got["x", "1h"]["severity"] == "critical" and got["y", "1h"]["burn_rate"] is None
    assert (got["z", "30d"]["requests"], got["z", "30d"]["burn_rate"]) == (0, None)


def test_full_outage_is_a_drop(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), "a") for h in range(40) if h not in (30, 31, 32) for _ in range(5)]
    rows += [(start + timedelta(hours=h), "b") for h in range(36) for _ in range(5)] + [(start + timedelta(hours=39), "c")]
    logs = spark.createDataFrame(rows, "timestamp TIMESTAMP, service STRING")
    got = {(r["service"], r["bucket"].hour, r["n"]) for r in anomaly.throughput_drop(logs).collect()}
    assert got == {("a", h % 24, 0) for h in (30, 31, 32)} | {("b", h % 24, 0) for h in (36, 37, 38, 39)}


def test_unevaluated_time_is_not_held(spark):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("r", "s", at(1), True, 1.0), ("r", "s", at(9), True, 1.0), ("r", "s", at(10), True, 1.0), ("r", "s", at(11), False, 0.0)]
    seen = spark.createDataFrame(rows, "rule_name STRING, service STRING, ts TIMESTAMP, fired BOOLEAN, value DOUBLE")
    got = sorted((r["starts_at"].hour, r["ends_at"].hour, r["n"], r["status"]) for r in alerts.alert_states(seen).collect())
    assert got == [(1, 2, 1, "resolved"), (9, 11, 2, "resolved")]
    assert alerts.alert_states(seen, hold_seconds=3 * 3600).count() == 0


def test_times_without_year_and_more_iso_shapes(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from logspark.functions.timefx import parse_timestamp

    texts = {
        "Dec 31 23:00:00": datetime(2023, 12, 31, 23), "Jan  2 00:00:00": datetime(2024, 1, 2), "Feb 29 00:00:00": None,
        "2024-01-15T10:30:00+0200": datetime(2024, 1, 15, 8, 30), "2024-01-15T10:30": datetime(2024, 1, 15, 10, 30),
        "2024-01-15 10:30:00Z": datetime(2024, 1, 15, 10, 30), "2024-01-15 10:30:00+02:00": datetime(2024, 1, 15, 8, 30),
    }
    read = parse_timestamp(F.col("t"), as_of=F.lit(datetime(2024, 1, 1, 12))).cast("timestamp_ntz")
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", read.alias("x")).collect()}
    assert got == texts


def test_joined_entry_keeps_its_trace_and_repeated_keys_are_read(spark):
    entry = "2024-01-15T10:30:00Z ERROR [main] com.a.B: boom\n    at x.y"
    got = {r["format"]: r for r in parse.parse_logs(spark.createDataFrame([(entry,), ('{"message":"a","level":"WARN","message":"b"}',)], "value STRING")).collect()}
    assert got["java_stacktrace"]["message"] == "boom\n    at x.y"
    assert (got["json"]["message"], got["json"]["level"]) == ("b", "WARN")


def test_items_go_where_they_say_and_tag_arrays_are_read(spark):
    from logspark.sources import intake

    span = '{"type":"trace","traceId":"t","spanId":"s","start":1,"end":3,"tags":[{"key":"http.url","value":"/a"},{"key":"error","value":"true"}]}'
    rows = [("otel", '{"type":"metric","name":"m","value":1}'), ("otel", span), ("traces", '{"a":1}')]
    made = intake.envelopes(spark.createDataFrame(rows, "topic STRING, value STRING").selectExpr("*", "current_timestamp() AS timestamp"))
    parts = intake.split_signals(made)
    assert [parts[k].count() for k in ("metric", "trace", "log")] == [1, 2, 0]
    spans = {r["trace_id"]: r for r in intake.span_records(parts["trace"]).collect()}
    assert spans["t"]["tags"] == {"http.url": "/a", "error": "true"} and spans["t"]["error"] is True and spans[None]["error"] is False


def test_personal_data_in_nested_values(spark):
    from logspark.functions import pii

    row = spark.createDataFrame([(["a@b.co"], [{"x": ["mail c@d.co"]}], 5)], "a ARRAY<STRING>, b ARRAY<STRUCT<x:ARRAY<STRING>>>, n INT")
    got = pii.redact(row, "remove").first()
    assert (got["a"], got["b"][0]["x"], got["n"]) == (["[EMAIL_REDACTED]"], ["mail [EMAIL_REDACTED]"], 5)


def test_halving_mean_over_many_rows(spark):
    from datetime import datetime, timedelta

    values = [float(i % 7 + 1) for i in range(3000)]
    rows = [("k", datetime(2024, 1, 1) + timedelta(minutes=7 * i), v) for i, v in enumerate(values)]
    mean = 0.0
    for v in values:
        mean = (mean + v) / 2
    got = topology.halving_mean(spark.createDataFrame(rows, "k STRING, ts TIMESTAMP, v DOUBLE"), ["k"], ["ts"], "v").first()["halving_mean"]
    assert abs(got - mean) < 1e-12


def test_outliers_do_not_depend_on_the_layout(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.gauss(5 * (i % 3), 1), rng.gauss(0, 1)) for i in range(600)] + [(1000, 40.0, 9.0)]
    frame = spark.createDataFrame(rows, "id INT, x DOUBLE, y DOUBLE")
    made = [sorted(map(tuple, anomaly.cluster_outliers(frame.repartition(n), ["x", "y"]).collect())) for n in (2, 4, 16)]
    assert made[0] == made[1] == made[2] and any(r[0] == 1000 for r in made[0])


def test_expired_days_are_deleted(spark, tmp_path):
    from datetime import date, datetime

    from logspark.sources import files

    rows = spark.createDataFrame([(datetime(2024, 1, 1), 1), (datetime(2024, 2, 28), 2)], "timestamp TIMESTAMP, n INT")
    files.write_hot(rows, str(tmp_path / "hot"))
    assert files.drop_days_before(spark, str(tmp_path / "hot"), date(2024, 1, 31)) == ["event_date=2024-01-01"]
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "hot")).collect()] == [2]
