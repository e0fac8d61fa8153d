"""Substring deduplication by hashing lines, or the sentences that lines consist of.

Method: every unit is normalised (A-Z lower-cased, runs of white space alike), digested to 96 bits and
grouped globally. The earliest occurrence by (doc_id, position) stays; every later one is a repeat.
Neighbouring repeats of a text form a run, and runs of ``min_words`` words or more are removed; the query
removes every repeat. With a larger ``min_words`` a chance repeat of a short unit stays while short units
inside a repeated passage go. Sentences also end at full-width marks, with or without a blank after them, so
scripts without blanks have sentences too. Removed ranges are returned as code point offsets into the original text.

Scale: digests are counted and ranked by an aggregation with map-side combination, so a unit that half of
all documents hold costs one row per task; the join back is an equality that adaptive execution splits.
Only the units of one document ever meet in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.text import U64, Texts, mix, powers, signed, slices, texts_of

UNITS = ("line", "paragraph", "sentence")
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_WIDE_STOPS = [c.encode() for c in "\u3002\uff01\uff1f\uff61"]


def wide_stops(data: np.ndarray) -> np.ndarray:
    """Which byte positions follow a full-width full stop, exclamation or question mark."""
    out = np.zeros(len(data) + 1, bool)
    for a, b, c in _WIDE_STOPS:
        out[3:] |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    return out


def unit_texts(column: pa.Array, unit: str, lower: bool = False) -> Texts:
    """The texts; for sentences, words end after full-width marks too, as no blank need follow them."""
    texts = texts_of(column, lower)
    if unit == "sentence":
        stops = wide_stops(texts.data)
        at = np.flatnonzero(stops)
        at = at[~stops[np.minimum(at + 3, len(texts.data))]]  # the last of several marks
        word = np.searchsorted(texts.starts, at, side="right") - 1
        at = at[(word >= 0) & (at > texts.starts[word]) & (at < texts.ends[word])] if len(at) and len(texts.starts) else at[:0]
        if len(at):
            texts.__dict__["_spans"] = np.sort(np.r_[texts.starts, at]), np.sort(np.r_[texts.ends, at])
    return texts


def unit_starts(texts: Texts, unit: str) -> np.ndarray:
    """Which words begin a unit."""
    starts, ends, bounds = texts.starts, texts.ends, texts.bounds
    begins = np.zeros(len(starts), bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    breaks = np.r_[0, np.cumsum(texts.data == 10)]
    between = breaks[starts[1:]] - breaks[ends[:-1]]
    begins[1:] |= between >= (2 if unit == "paragraph" else 1)
    if unit == "sentence":
        begins[1:] |= _STOP[texts.data[ends[:-1] - 1]] | wide_stops(texts.data)[ends[:-1]]
    return begins


def units_of(unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = unit_texts(part.column("text"), unit, lower=True)
                at = np.flatnonzero(unit_starts(texts, unit))
                if not len(at):
                    continue
                stop = np.r_[at[1:], len(texts.starts)]
                owner = texts.owner[at]
                up, down = powers(len(texts.words) + 1)
                digests = []
                for words in (texts.words, mix(texts.words + U64(1))):
                    total = np.r_[U64(0), np.cumsum(words * up[: len(words)])]
                    digests.append(mix((total[stop] - total[at]) * down[at] ^ (stop - at).astype(U64)))
                number = np.arange(len(at)) - np.searchsorted(owner, owner)
                short = (digests[1] >> U64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(owner)), signed(digests[0]), pa.array(short), pa.array(number.astype(np.int32))],
                    ["doc_id", "d1", "d2", "unit"],
                )

    return run


def repeated_units(docs: DataFrame, unit: str) -> DataFrame:
    """``(doc_id, units)``: the numbers of the units of each document that occur earlier."""
    units = docs.mapInArrow(units_of(unit), "doc_id bigint, d1 bigint, d2 int, unit int")
    place = F.struct("doc_id", "unit")
    known = units.groupBy("d1", "d2").agg(F.min(place).alias("keep"), F.max(place).alias("other")).where("keep < other").drop("other")
    later = units.join(known, ["d1", "d2"]).where(place > F.col("keep"))
    content = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("one"), F.max(F.xxhash64("text")).alias("two"))
    by_doc = later.groupBy("doc_id").agg(F.collect_list("unit").alias("units"))
    return by_doc.join(content.where("one < two").select("doc_id"), "doc_id", "left_anti")


def cut(unit: str, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Take runs of repeated units out of each text and say where they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = unit_texts(part.column("text"), unit)
                at = np.flatnonzero(unit_starts(texts, unit))
                stop = np.r_[at[1:], len(texts.starts)]
                owner = texts.owner[at]
                units = part.column("units")
                doc = np.repeat(np.arange(len(texts)), pc.list_value_length(units).fill_null(0).to_numpy(zero_copy_only=False))
                flagged = np.zeros(len(at) + 1, bool)
                flagged[np.searchsorted(owner, doc) + units.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
                flagged = flagged[:-1]
                fresh = flagged.copy()
                fresh[1:] &= ~(flagged[:-1] & (owner[1:] == owner[:-1]))
                closing = flagged.copy()
                closing[:-1] &= ~flagged[1:] | fresh[1:]
                begin, end = np.flatnonzero(fresh), np.flatnonzero(closing)
                words = stop[end] - at[begin]
                begin, end, words = begin[words >= min_words], end[words >= min_words], words[words >= min_words]
                first, last, holder = texts.starts[at[begin]], texts.ends[stop[end] - 1], owner[begin]
                keep = np.zeros(len(texts.data) + 1, np.int8)
                keep[first] += 1
                keep[last] -= 1
                keep = np.cumsum(keep[:-1], dtype=np.int8) == 0
                offsets = np.r_[0, np.cumsum(keep)][texts.offsets]
                valid = pc.is_valid(part.column("text"))
                left = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(texts.data[keep].tobytes()))
                before = texts.characters(texts.offsets[:-1])
                spans = pa.StructArray.from_arrays(
                    [pa.array((texts.characters(x) - before[holder]).astype(np.int32)) for x in (first, last)], ["first", "last"]
                )
                bounds = np.searchsorted(holder, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array(np.bincount(holder, words, len(texts)).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
                        pc.if_else(valid, left.cast(pa.string()), pa.scalar(None, pa.string())),
                    ],
                    ["doc_id", "n_removed", "removed_words", "spans", "text"],
                )

    return run


def remove_repeats(docs: DataFrame, unit: str = "sentence", min_words: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_removed, removed_words, spans, text)`` per document: what is left, and the ranges taken out.

    ``spans`` is an ordered array of (first, last) code point offsets into the original text, so text and
    spans together say where each remaining piece came from. A null, empty or blank text has no unit and
    stays as it is. Rows with a null id take no part and are returned unchanged. Rows that repeat an id with
    the same text count once and are cut alike; an id with different texts is returned unchanged, though its
    units count as earlier text for others. An empty table gives no row; other columns are ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = repeated_units(docs.where("doc_id IS NOT NULL"), unit).withColumnRenamed("doc_id", "__id")
    joined = docs.join(found, docs["doc_id"] == found["__id"], "left").select("doc_id", "text", "units")
    schema = "doc_id bigint, n_removed bigint, removed_words bigint, spans array<struct<first:int,last:int>>, text string"
    return joined.mapInArrow(cut(unit, min_words), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: every repeated sentence, however short."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1)
