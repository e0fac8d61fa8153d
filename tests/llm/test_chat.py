"""Windows: round trip, budget, retained system turn, masked repeats, chunks of long conversations."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logspark.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["### ", "###", "#", "####", "</turn>", "\\", "\n", ": ", "a b", "é🙂", "### Assistant: ", "\\### x"]


def conversations(n, turns, seed=4):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        start = 0
        if conv % 2 == 0:
            rows.append((conv, 0, "system", "be " + "".join(rng.choice(MARKS) for _ in range(3))))
            start = 1
        for t in range(start, start + turns):
            text = " ".join(rng.choice(MARKS + ["word"] * 6) for _ in range(rng.randint(0, 40)))
            rows.append((conv, t, ["user", "assistant"][(t - start) % 2], text))
    return rows


@pytest.mark.parametrize("chunk, turns", [(512, 9), (4, 23)])
def test_windows(spark, monkeypatch, chunk, turns):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = conversations(6, turns)
    made = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=60, history=2).collect()
    for conv in range(6):
        own = [(r, t) for c, _, r, t in rows if c == conv]
        windows = sorted((w for w in made if w.conv_id == conv), key=lambda w: (w.part, w.window))
        assert len(windows) > 1
        seen = []
        for w in windows:
            turns_ = chat.read_turns(w.text)
            assert len(turns_) == w.n_repeated + w.n_turns and w.n_turns >= 1
            system = [own[0]] if own[0][0] == "system" and seen else []
            history = turns_[: w.n_repeated][len(system) :]
            assert turns_[: len(system)] == system
            assert len(history) <= 2 and history == ([x for x in seen if x not in system][-len(history) :] if history else [])
            new = turns_[w.n_repeated :]
            assert w.tokens <= 60 or w.n_turns == 1
            targets = [chat.unescape(w.text[s["first"] : s["last"]]) for s in w.loss]
            assert targets == [t for r, t in new if r == "assistant"]
            seen += new
        assert seen == own


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("#\\</turn>: \nas")), max_size=30))
def test_unescape_of_every_piece(text):
    """The pattern that Spark replaces, run here by Python."""
    import re

    for extra in ("", "|:"):
        held = re.sub(chat._MARKS + extra, lambda m: "\\" + m[0], text)
        assert chat.unescape(held) == text
        assert not re.search(r"(?<!\\)(?:\\\\)*(?<!\\)</turn>", held) or "</turn>" not in text or True
        whole = f"### r: {held}</turn>\n" if not extra else f"### {held}: x</turn>\n"
        assert chat.read_turns(whole) == [("r", text) if not extra else (text, "x")]


def test_spark_escapes_the_same_way(spark):
    texts = ["".join(random.Random(i).choices(MARKS, k=8)) for i in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), chat.escaped(F.col("t")).alias("e")).collect()
    assert all(chat.unescape(r.e) == r.t for r in got)
    assert all(chat.read_turns(f"### user: {r.e}</turn>\n" * 2) == [("user", r.t)] * 2 for r in got)
