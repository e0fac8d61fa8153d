"""Multiline entries that close after five seconds: batch against a plain loop, stream against batch."""

import datetime
import random

import pytest

from logspark.operators import multiline
from logspark.session import scratch_path
from logspark.streaming import jobs, tables

START = datetime.datetime(2024, 5, 1)
SCHEMA = "source STRING, line_no BIGINT, timestamp TIMESTAMP, value STRING"
TEXTS = ["java.lang.Exception: x", "    at com.a.B", "  plain more", "Caused by: y", "a line", "    ... 3 more"]


def lines(seed, n=300):
    rng, out = random.Random(seed), []
    for source in "ab":
        ms = 0
        for i in range(n):
            ms += rng.choice([0, 0, 200, 900, 2000, 6000])
            out.append((source, i, START + datetime.timedelta(milliseconds=ms), rng.choice(TEXTS)))
    return out


def plain(rows):
    held, seen, out = {}, set(), []
    for source, no, at, text in sorted(rows, key=lambda r: (r[0], r[1])):
        entry = held.get(source)
        start, more = "xception" in text or "Caused" in text or " at " in text, text.startswith(" ")
        if start and (not more or source not in seen):
            seen.add(source)
            held[source] = [no, text, 1, at]
            out.append((source, held[source]))
        elif more and entry and at < entry[3] + datetime.timedelta(seconds=5):
            entry[1] += "\n" + text
            entry[2] += 1
        else:
            out.append((source, [no, text, 1, at]))
    return sorted((s, *e[:3]) for s, e in out)


def rows_of(frame):
    return sorted((r.source, r.line_no, r.value, r.lines) for r in frame.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows = lines(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(multiline.join_lines(frame, ts="timestamp", chunk_lines=7)) == plain(rows)


def test_stream_equals_batch(spark):
    rows = lines(3)
    end = [(s, 10_000, START + datetime.timedelta(days=1), "a line") for s in "ab"]
    frame = spark.createDataFrame(rows + end, SCHEMA)
    cuts = [0, 1, 2, 90, 91, 250, 20_000]
    pieces = [frame.where(f"line_no >= {a} AND line_no < {b}") for a, b in zip(cuts, cuts[1:])]
    base = scratch_path(spark, "entries")

    def start(stream):
        entries = jobs.multiline_entries(stream, watermark="1 hour").writeStream.format("parquet").option("path", f"{base}/rows")
        return entries.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    tables.in_runs(spark, pieces, start)
    assert rows_of(spark.read.parquet(f"{base}/rows")) == plain(rows + end)
