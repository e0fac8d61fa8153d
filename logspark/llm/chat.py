r"""Chat formatting in budgeted windows.

Every turn becomes ``### role: text</turn>`` and a newline. Inside roles and texts a backslash is put before
each backslash, each ``#`` of a run of three or more, and ``</turn>`` (in roles also before a colon), so the
marks of the template occur nowhere else and ``unescape`` gives the text back.

Windows: running sums of turn tokens choose spans of whole turns that fit ``budget``. A window after the
first repeats the leading system turn and the last turns before it, at most ``history`` turns and a quarter of
the budget; repeated turns are never targets. The loss mask covers the escaped text of each assistant turn
once, in the window where it is new. A turn above the budget has a window of its own.

Scale: turn numbers come from chunked running counts, and every ``CHUNK`` turns a new window begins whose
history is read from the chunk before, so a conversation with a third of all turns is dealt to many tasks.
Within a chunk turns are streamed in order; memory holds one window.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.ordered import row_numbers, with_lookback

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BUDGET = 512
HISTORY = 2
CHUNK = 512
#: The mark of a target's role.
TARGET = "assistant"
_MARKS = r"\\|#(?=##)|(?<=##)#|(?<=#)#(?=#)|</turn>"
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(r"\w+|[^\w\s]")
_loaded: dict[str, object] = {}

WINDOWS = "conv_id bigint, part bigint, window int, text string, tokens bigint, n_turns int, n_repeated int, loss array<struct<first:int,last:int>>"


def escaped(text: Column, extra: str = "") -> Column:
    return F.regexp_replace(text, _MARKS + extra, r"\\$0")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def counter(tokenizer: str | None) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the tokenizer file at that path; without one, words and signs."""
    if tokenizer is None:
        return lambda texts: [len(_PIECE.findall(t)) for t in texts]
    if tokenizer not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[tokenizer] = Tokenizer.from_file(tokenizer)
        _loaded[tokenizer].encode_special_tokens = True
    model = _loaded[tokenizer]
    return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


class Part:
    """The windows of one chunk of a conversation, fed turn by turn."""

    def __init__(self, key: tuple, budget: int, history: int) -> None:
        self.key, self.budget, self.number = key, budget, 0
        self.system: tuple[str, int] | None = None
        self.recent: deque[tuple[str, int]] = deque(maxlen=history)
        self.turns: list[tuple[str, int]] = []
        self.loss: list[tuple[int, int]] = []
        self.repeated = self.length = self.sum = 0

    def begin(self) -> None:
        """Start a window with the system turn and what fits of the history."""
        self.turns, self.loss = [self.system] if self.system else [], []
        past, room = [], self.budget // 4
        for turn in reversed(self.recent):
            room -= turn[1]
            if room < 0:
                break
            past.insert(0, turn)
        self.turns += past
        self.repeated, self.length = len(self.turns), sum(len(t) for t, _ in self.turns)
        self.sum = sum(n for _, n in self.turns)

    def close(self) -> tuple | None:
        if len(self.turns) == self.repeated:
            return None
        own = len(self.turns) - self.repeated
        row = (*self.key, self.number, "".join(t for t, _ in self.turns), self.sum, own, self.repeated, [{"first": a, "last": b} for a, b in self.loss])
        self.number += 1
        self.turns = []
        self.repeated = 0
        return row

    def add(self, turn: str, tokens: int, leads: bool, target: tuple[int, int] | None) -> tuple | None:
        closed = None
        if self.turns and len(self.turns) > self.repeated and self.sum + tokens > self.budget:
            closed = self.close()
        if not self.turns or closed:
            self.begin()
        if target:
            self.loss.append((self.length + target[0], self.length + target[1]))
        self.turns.append((turn, tokens))
        self.sum, self.length = self.sum + tokens, self.length + len(turn)
        if leads:
            self.system = (turn, tokens)
        else:
            self.recent.append((turn, tokens))
        return closed


def windows_of(budget: int, history: int, tokenizer: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part, key, size = counter(tokenizer), None, None, 0
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                turns = batch.slice(at, 256).to_pylist()
                tokens = count([t["turn_text"] for t in turns])
                for turn, n in zip(turns, tokens):
                    own_key = (turn["no_conv"], turn["conv"], turn["part"])
                    if own_key != key:
                        if part and (row := part.close()):
                            rows.append(row)
                        key, part = own_key, Part((None if own_key[0] else own_key[1], own_key[2]), budget, history)
                    text = turn["turn_text"]
                    if not turn["own"]:
                        if turn["leads"]:
                            part.system = (text, n)
                        else:
                            part.recent.append((text, n))
                        continue
                    target = (turn["body_at"], len(text) - len("</turn>\n")) if turn["target"] else None
                    if row := part.add(text, n, turn["leads"], target):
                        rows.append(row)
                        size += len(row[3])
                    if size > 1 << 22:
                        yield table(rows)
                        rows, size = [], 0
        if part and (row := part.close()):
            rows.append(row)
        if rows:
            yield table(rows)

    return run


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """One row per window: text, token sum, number of new and of repeated turns, and the loss mask.

    Turns are ordered by turn, role and text; null turn numbers come first. A null text or role is empty;
    rows with a null conv_id form one conversation with a null id. Repeated rows are turns of their own. A
    leading system turn is the first row of a conversation with role ``system``; other system turns are
    ordinary turns. Ranges of ``loss`` are code points of the window's text. An empty table gives no row;
    other columns are ignored.
    """
    if budget < 1 or not 0 <= history <= CHUNK:
        raise ValueError("budget must be positive and history at most a chunk")
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    )
    keys = ["no_conv", "conv"]
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    rows = row_numbers(rows, keys, "chunk", ["turn", "role", "body"], "place")
    leads = (F.col("place") == 1) & (F.col("role") == "system")
    head = F.concat(F.lit("### "), escaped(F.col("role"), "|:"), F.lit(": "))
    rows = rows.select(
        *keys,
        "place",
        leads.alias("leads"),
        (F.col("role") == TARGET).alias("target"),
        F.length(head).alias("body_at"),
        F.concat(head, escaped(F.col("body")), F.lit("</turn>\n")).alias("turn_text"),
    )
    dealt = with_lookback(rows, keys, "place", history, CHUNK) if history else rows.withColumns({"__part": F.floor((F.col("place") - 1) / CHUNK), "__own": F.lit(True)})
    dealt = dealt.withColumnsRenamed({"__part": "part", "__own": "own"}).where("own OR NOT leads")
    # A chunk's last turns may have no chunk after them.
    parts = dealt.groupBy(*keys, "part").agg(F.max("own").alias("own")).where("own").select(*keys, "part")
    dealt = dealt.join(parts, [*keys, "part"])
    system = rows.where("leads").join(parts.where("part > 0"), keys).select(*keys, "part", "place", "leads", "target", "body_at", "turn_text", F.lit(False).alias("own"))
    dealt = dealt.unionByName(system)
    dealt = dealt.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "place")
    return dealt.mapInArrow(windows_of(budget, history, tokenizer), WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn in a window."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the windows of each conversation hold, read back from their texts; windows come in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    done: list[tuple] = []
    state: list | None = None

    def finish() -> None:
        if state:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]))

    def table() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(columns, names)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    finish()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                new = read_turns(row["text"])[row["n_repeated"] :]
                for role, text in new:
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    target = unescape(row["text"][span["first"] : span["last"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[1] += len(new)
                state[5] += len(row["text"])
                state[6] += 1
        yield table()
        done.clear()
    finish()
    yield table()


def summary(formatted: DataFrame) -> DataFrame:
    """Counts and digests per conversation, derived from the formatted windows alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")
    return ordered.mapInArrow(digests, schema)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `conversations` and one conversation that holds the template's own marks."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return summary(windows(turns.unionByName(extra), tokenizer=TOKENIZER))
