"""Token ids of documents in compressed files, in ascending id order of the documents.

``write_tokens`` encodes texts with a tokenizer file, appends an end id to each document and writes below a folder:

* ``table``: the shared frequency table ``(id, freq)``, a row for each id that occurs;
* ``blocks``: ``(part, first, n_tokens, frame)``; a part holds the documents of one range of ids, a frame up to
  ``BLOCK`` of its ids, coded by ``rans`` with checkpoints, checksums and the documents that it touches;
* ``parts``: ``(part, start, n_tokens, n_docs)``; ``start`` counts the ids of all parts before.

Frames are values of Parquet rows, so Spark's own writers commit the files in whatever store is used, and every
frame can be read alone: ``read_documents`` checks all sums and returns a row per document, ``read_tokens`` the
ids of documents, ``read_range`` ids by their place in the whole.

Results for odd input: a null text counts as empty; an empty text is the end id alone. Rows with a null id stand
behind all others. Rows that repeat an id stand next to each other, by number of ids and then by their sum.
An empty table gives empty files and no row. Other columns are ignored.

Scale: texts are tokenized once; the ids are written, counted per task, and dealt to parts by range of id, number
and sum of ids and row, so equal ids spread too. A part is coded as a stream: memory holds ``AT_ONCE`` blocks and one
document. The driver sees the frequency table only, at most as long as the vocabulary. A document over several
blocks is put together from sums of its pieces, a few bytes for each 65,536 ids.

Words: with ``by_words`` the tokenizer sees every distinct word of a task once. That is right for tokenizers that
drop white space and cut at every change between letters and signs, which a probe checks; texts that contain
the marker ``<|`` of special tokens are encoded whole. Words are known by a 64-bit hash and their size in bytes; a
batch in which two words share the hash but not the size is encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import rans
from logspark.llm.graph import stored
from logspark.llm.text import slices, texts_of
from logspark.operators.ordered import running
from logspark.session import scratch_path

END = 2
PART_TOKENS = 1 << 22
AT_ONCE = 32
#: Distinct words a worker remembers, about 40 bytes each; a full memory is emptied, which changes no result.
MEMORY = 2_000_000
#: Bytes of text encoded together: the more, the fewer words are met again.
TEXT_BYTES = 2 << 20
MARKER = "<|"
PROBE = "It's a TEST, of 12 words; e.g. ÉTÉ's 中文 <b> [x]\n\n  don't - stop!! (now)\tend."
_TAIL = r"([a-z0-9])([!-/:-@\[-`{-~]+)(\s|$)"


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; ``spec`` is the content of a tokenizer file."""

    def __init__(self, spec: str, by_words: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_words = by_words
        self.special = max((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()) if by_words else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.bytes, self.starts, self.sizes = (np.zeros(0, k) for k in (np.uint64, np.int32, np.int64, np.int32))
        self.pool = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Encode words in one go, kept apart by a special token; ``keys`` ascend."""
        number, mark = self.special
        ids = self.whole([f" {mark} ".join(w.decode() for w in words)])[0]
        cuts = np.flatnonzero(ids == number)
        sizes = np.diff(np.r_[-1, cuts, len(ids)]) - 1
        at = np.searchsorted(self.keys, keys)
        self.keys, self.bytes = np.insert(self.keys, at, keys), np.insert(self.bytes, at, [len(w) for w in words])
        self.starts, self.sizes = np.insert(self.starts, at, len(self.pool) + np.cumsum(sizes) - sizes), np.insert(self.sizes, at, sizes)
        self.pool = np.r_[self.pool, np.delete(ids, cuts)]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all texts in a row and where each ends; None if two words can't be told apart."""
        held = texts_of(pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3"))
        size = held.ends - held.starts
        keys, first, word = np.unique(held.words, return_index=True, return_inverse=True)
        if (size != size[first][word]).any():
            return None

        def known() -> np.ndarray:
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            return self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

        new = ~known()
        if new.any() and len(self.keys) + new.sum() > MEMORY:
            self.forget()
            new[:] = True
        if new.any():
            self.learn(keys[new], [held.data[a : a + n].tobytes() for a, n in zip(held.starts[first[new]].tolist(), size[first[new]].tolist())])
        at = np.searchsorted(self.keys, keys)
        if (self.bytes[at] != size[first]).any():
            return None
        at = at[word]
        sizes = self.sizes[at].astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[held.bounds]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_words:
            return self.whole(texts.to_pylist())
        plain = pc.invert(pc.match_substring(texts, MARKER)).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        at = np.flatnonzero(plain)
        found = self.words(texts.take(pa.array(at))) if len(at) else None
        if found is None:
            plain[:] = False
        else:
            ids, ends = found
            for i, a, b in zip(at.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[i] = ids[a:b]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.whole([texts[i].as_py()])[0]
        return out


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(spec: str, by_words: bool) -> Encoder:
    """One encoder a process and tokenizer, with the words it has seen."""
    key = zlib.crc32(spec.encode()), by_words
    if key not in _encoders:
        _encoders[key] = Encoder(spec, by_words)
    return _encoders[key]


def separable(spec: str) -> bool:
    """Whether a probe encoded by words equals the probe encoded whole."""
    try:
        made = Encoder(spec, True)
    except ValueError:
        return False
    return np.array_equal(made(pa.array([PROBE]))[0], made.whole([PROBE])[0])


def kind_of(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def token_rows(docs: DataFrame, spec: str, *, end: int = END, text: str = "text", id_col: str = "doc_id", by_words: bool = True) -> tuple[DataFrame, str]:
    """``(doc_id, n, crc, row, ids)`` per document, stored; ids are little-endian integers of the returned kind."""
    if by_words and not separable(spec):
        raise ValueError("this tokenizer needs by_words=False")
    kind = kind_of(max(Encoder(spec, False).size, end + 1))
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, by_words)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                rows = [np.r_[ids, np.uint32(end)] for ids in encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()), pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())],
                    ["doc_id", "n", "crc", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(run, "doc_id bigint, n bigint, crc bigint, ids binary").withColumn("row", F.monotonically_increasing_id())
    return stored(made, "token-rows"), kind


def id_counts(rows: DataFrame, kind: str) -> DataFrame:
    """``(id, n)``; each task sends a row for each id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind).astype(np.int64))
            if len(found) > len(total):
                found, total = total, found
            total = total.copy()
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def table_of(rows: DataFrame) -> rans.Table:
    """From rows ``(id, freq)``, at most one for each id of the vocabulary."""
    got = rows.collect()
    freq = np.zeros(max((r.id for r in got), default=-1) + 1, np.int64)
    for r in got:
        freq[r.id] = r.freq
    return rans.Table(freq)


class Part:
    """Documents of one part in order, turned into frames as soon as enough ids are there."""

    def __init__(self, table: rans.Table, number: int) -> None:
        self.table, self.number = table, number
        self.held: list[np.ndarray] = []
        self.size = self.first = self.docs_from = 0
        self.docs: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = self.first + self.size
        self.docs.append((doc_id or 0, doc_id is None, at, len(ids)))
        self.held.append(ids)
        self.size += len(ids)

    def made(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        step = rans.BLOCK * AT_ONCE
        if self.size < step and not last:
            return
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        whole = len(ids) // rans.BLOCK * rans.BLOCK
        docs = rans.Docs(*(np.array(c) for c in zip(*self.docs))) if self.docs else None
        at = 0
        while at + rans.BLOCK <= whole or last and at < len(ids):
            end = min(at + step, whole) if at < whole else len(ids)
            blocks = [ids[i : i + rans.BLOCK] for i in range(at, end, rans.BLOCK)]
            firsts = [self.first + at + i * rans.BLOCK for i in range(len(blocks))]
            raw = rans.frames(self.table, blocks, [docs.touching(a, a + len(b)) for a, b in zip(firsts, blocks)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.number] * len(blocks), pa.int32()), pa.array(firsts, pa.int64()), pa.array([len(b) for b in blocks], pa.int64()), pa.array(raw, pa.binary())],
                ["part", "first", "n_tokens", "frame"],
            )
            at = end
        self.first += at
        self.held, self.size = [ids[at:]], len(ids) - at
        self.docs = [d for d in self.docs if d[2] + d[3] > self.first]


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end: int = END, text: str = "text", id_col: str = "doc_id", by_words: bool = True) -> None:
    """Write the token files of all documents below ``path``; ``tokenizer`` is a file that the driver reads."""
    spark = docs.sparkSession
    with open(tokenizer or word_bpe(), encoding="utf-8") as f:
        spec = f.read()
    rows, kind = token_rows(docs, spec, end=end, text=text, id_col=id_col, by_words=by_words)
    counts = sorted((r.id, r.n) for r in id_counts(rows, kind).collect())
    freq = rans.frequencies(np.array([n for _, n in counts], np.int64))
    spark.createDataFrame([(i, int(f)) for (i, _), f in zip(counts, freq)], "id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(table_of(spark.read.parquet(f"{path}/table")).freq)
    total = sum(n for _, n in counts)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = Part(rans.Table(table.value), TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                part.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
                yield from part.made()
        yield from part.made(last=True)

    order = [F.col("doc_id").asc_nulls_last(), F.col("n").asc(), F.col("crc").asc(), F.col("row").asc()]
    parts = rows.repartitionByRange(max(1, -(-total // PART_TOKENS)), *order).sortWithinPartitions(*order)
    parts.select("doc_id", "ids").mapInArrow(code, "part int, first bigint, n_tokens bigint, frame binary").write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumns({"__all": F.lit(0), "__chunk": F.floor(F.col("part") / 1000)})
    before = running(sizes, ["__all"], "__chunk", ["part"], {"upto": ("sum", F.col("n_tokens"))})
    before.select("part", (F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens").write.parquet(f"{path}/parts")


def _pieces(path: str, spark: SparkSession, with_ids: bool) -> DataFrame:
    """Stretches of documents by frame: ``(part, at, doc_id, n_tokens, first, size, crc[, ids])``; ``at`` is a document's first place."""
    table = spark.sparkContext.broadcast(table_of(spark.read.parquet(f"{path}/table")).freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(table.value)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(i, AT_ONCE)
                held = [rans.Frame(raw) for raw in some.column("frame").to_pylist()]
                for part, first, h, ids in zip(some.column("part").to_pylist(), some.column("first").to_pylist(), held, rans.read(shared, held)):
                    d, plain = h.docs, ids.astype("<u4")
                    a, b = np.maximum(d.starts - first, 0), np.minimum(d.starts + d.sizes - first, h.n)
                    cut = [plain[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
                    columns = [
                        pa.array(np.full(len(a), part), pa.int32()), pa.array(d.starts, pa.int64()), pa.array(d.ids, pa.int64(), mask=d.null.astype(bool)),
                        pa.array(d.sizes, pa.int64()), pa.array(first + a, pa.int64()), pa.array(b - a, pa.int64()),
                    ]
                    last = pa.array(cut, pa.binary()) if with_ids else pa.array([zlib.crc32(c) for c in cut], pa.int64())
                    yield pa.RecordBatch.from_arrays([*columns, last], ["part", "at", "doc_id", "n_tokens", "first", "size", "ids" if with_ids else "crc"])

    schema = "part int, at bigint, doc_id bigint, n_tokens bigint, first bigint, size bigint, " + ("ids binary" if with_ids else "crc bigint")
    return spark.read.parquet(f"{path}/blocks").select("part", "first", "frame").mapInArrow(run, schema)


def _starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("__start"))
    return rows.join(parts, "part").withColumn("start", F.col("__start") + F.col("at")).drop("__start")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, from the files; every sum and checkpoint is checked."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for pieces in batch.column("pieces").to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = rans.joined_crc(crc, p["crc"], 4 * p["size"])
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "at", "doc_id", "n_tokens")), pa.array(sums, pa.int64())], ["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    # A text is one value, so its pieces are some ten thousand at most.
    whole = _pieces(path, spark, False).groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "size", "crc"))).alias("pieces"))
    summed = whole.mapInArrow(join, "part int, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return _starts(spark, path, summed).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents ``(doc_id, start, n_tokens, piece_start, ids)``: ``ids`` are little-endian 32-bit numbers."""
    rows = _starts(spark, path, _pieces(path, spark, True))
    return rows.select("doc_id", "start", "n_tokens", (F.col("start") + F.col("first") - F.col("at")).alias("piece_start"), "ids")


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids at the places [first, last) of the whole: ``(start, ids)`` by block, decoded from the checkpoints before them."""
    table = spark.sparkContext.broadcast(table_of(spark.read.parquet(f"{path}/table")).freq)
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("__start")), "part")
    begin = F.col("__start") + F.col("first")
    wanted = blocks.where((begin < last) & (begin + F.col("n_tokens") > first)).select(begin.alias("start"), "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rans.Table(table.value)
        for batch in batches:
            starts, raw = batch.column("start").to_pylist(), batch.column("frame").to_pylist()
            cut = [rans.read_range(shared, rans.Frame(r), max(first - s, 0), last - s).astype("<u4").tobytes() for s, r in zip(starts, raw)]
            yield pa.RecordBatch.from_arrays([pa.array([max(s, first) for s in starts], pa.int64()), pa.array(cut, pa.binary())], ["start", "ids"])

    return wanted.mapInArrow(run, "start bigint, ids binary")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, written and read back."""
    path = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_documents(spark, path)
