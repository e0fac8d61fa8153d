import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, band bigint, `size` string, __id int, mix_size int"


def generated(n=60, seed=3):
    """Texts with copies, near copies, shared passages, repeated lines and test items."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def line(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k)) + rng.choice([".", "!", ""])

    passage = " ".join(line(9) for _ in range(7))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            text = rng.choice(texts)
        elif kind == 2 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 7))]
            if kind == 3:
                lines.insert(rng.randrange(len(lines) + 1), "Start. " + passage + " the end.")
            if kind == 4 and texts:
                w = rng.choice(rng.choice(texts).split("\n")).split(" ")
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
                lines.append(" ".join(w))
            text = "\n".join(lines)
        texts.append(text)
    return [(i, t) for i, t in enumerate(texts)]


def rows(docs, lang="en", source="s"):
    return [(i, t, lang, source, len(t or ""), True, 1, "x", 5, 7) for i, t in docs]


@pytest.fixture(scope="session")
def generated_docs():
    return generated()


@pytest.fixture(scope="session")
def docs(spark, generated_docs):
    return spark.createDataFrame(rows(generated_docs), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, ties and repeated rows."""
    long = "wörd " * 60_000
    odd_rows = [
        (None, None, None, None, None, None, None, None, None, None),
        (None, "a text without an id. It has two sentences.", "en", "s", 1, None, None, None, None, None),
        (1, None, "en", "s", 0, None, None, None, None, None),
        (2, "", "en", "s", 0, None, None, None, None, None),
        (3, " \n\t \n", None, None, 5, True, 1, "x", 5, 7),
        (4, long, "de", "s", len(long), True, 1, "x", 5, 7),
        (5, "one two three four five six seven eight nine ten.", "en", "t", 9, True, 1, "x", 5, 7),
        (5, "one two three four five six seven eight nine ten.", "en", "t", 9, True, 1, "x", 5, 7),
        (6, "One two  three four five six seven eight nine ten.", "en", "t", 9, True, 1, "x", 5, 7),
        (7, "short", "en", None, 5, True, 1, "x", 5, 7),
        (8, "12345 !!! ***", "en", "u", 5, True, 1, "x", 5, 7),
        (9, "🙂 ñandú  naïve", "es", "u", 5, True, 1, "x", 5, 7),
    ]
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
