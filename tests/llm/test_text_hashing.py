import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.llm.text import slices, texts_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t🙂.", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_lines_and_shingles(column):
    held = texts_of(pa.array(column, pa.string()), lower=True)
    plain = [brute.WORD.findall(brute.lower(t)) for t in column]
    raw = held.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(held.starts, held.ends)] == [w for t in plain for w in t]
    assert np.diff(held.bounds).tolist() == [len(t) for t in plain]
    names = {}
    assert all(names.setdefault(h, w) == w for h, w in zip(held.words.tolist(), (w for t in plain for w in t)))
    assert len(set(names.values())) == len(names)
    starts, ends, owner = held.lines
    assert [(o, raw[a:b].decode()) for a, b, o in zip(starts, ends, owner)] == [(i, x) for i, t in enumerate(column) for x in brute.lower(t).split("\n")]
    hashes, bounds = held.shingles(3)
    known = {}
    for i, t in enumerate(column):
        own = brute.WORD.findall(brute.lower(t))
        expected = [] if not own else [tuple(own)] if len(own) < 3 else [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        got = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(expected)
        assert all(known.setdefault(g, e) == e for g, e in zip(got, expected))
    assert len(set(known.values())) == len(known)


def test_slices_cover_all_rows_and_sliced_columns_are_read_from_their_offset():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d e"])], ["text"]).slice(1)
    parts = list(slices(batch, limit=10))
    assert sum(p.num_rows for p in parts) == 4
    assert [t for p in parts for t in p.column("text").to_pylist()] == [None, "c" * 50, "", "d e"]
    assert texts_of(batch.column("text")).data.tobytes() == b"c" * 50 + b"d e"
