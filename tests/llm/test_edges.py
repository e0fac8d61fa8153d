"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

from logspark.llm import chat, decontaminate, langid, minhash, mixing, ngrams, passages, pseudonyms, rules, similar_lines


def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight"), (2, None), (None, "x"), (3, ""), (4, "short")], "item_id bigint, text string")


OPERATORS = {
    "quality": lambda d: ngrams.judged(d, d.where("doc_id > 4").select("doc_id")),
    "pseudonyms": lambda d: pseudonyms.pseudonymise(d, b"k"),
    "language": langid.predictions,
    "recognised": langid.recognised,
    "contained": lambda d: decontaminate.matches(d, benchmark(d.sparkSession)),
    "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark(d.sparkSession)),
    "passages": passages.remove_repeats,
    "lines": lambda d: similar_lines.removed_lines(similar_lines.judged_lines(d)),
    "cut_lines": similar_lines.dedup_lines,
    "mix": mixing.mixed,
    "groups": minhash.groups,
    "deduplicate": minhash.deduplicate,
    "rules": rules.judged,
}
FILTERS = {"recognised", "decontaminate", "cut_lines", "deduplicate"}


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_STEPS", 20)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(odd, name):
    got = OPERATORS[name](odd)
    assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes)
    got.collect()


def by_id(frame):
    return sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def test_groups(odd):
    got = by_id(OPERATORS["groups"](odd))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [
        (None, None, True), (None, None, True), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True),
        (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True), (9, 9, True),
    ]
    assert [r.n_shingles for r in got if r.doc_id in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [r.doc_id for r in by_id(OPERATORS["deduplicate"](odd))] == [None, None, 1, 2, 3, 4, 5, 7, 8, 9]


def test_lines(odd):
    got = {r.doc_id: (r.n_lines, list(r.removed)) for r in OPERATORS["lines"](odd).collect()}
    assert got == {4: (1, []), 5: (1, []), 6: (1, [0]), 7: (1, []), 8: (1, []), 9: (1, [])}
    kept = [r.doc_id for r in by_id(OPERATORS["cut_lines"](odd))]
    assert kept == [None, None, 1, 2, 3, 4, 5, 5, 7, 8, 9]


def test_passages(odd):
    got = {(r.doc_id, r.text): r.n_removed for r in OPERATORS["passages"](odd).collect()}
    assert got[(1, None)] == 0 and got[(2, "")] == 0 and got[(6, "")] == 1 and got[(7, "short")] == 0
    assert [n for (i, _), n in got.items() if i == 5] == [0]


def test_passages_of_an_id_with_two_texts_stay(spark):
    rows = [(1, "a b c d e f g h i j."), (2, "a b c d e f g h i j."), (2, "another text of the same id."), (3, "x. Another text of the same id.")]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=5).collect()
    assert {(r.doc_id, r.text) for r in got} == {*rows[:3], (3, "x. ")}


def test_contained(odd):
    assert sorted((r.doc_id, r.item_id) for r in OPERATORS["contained"](odd).collect()) == [(5, 1), (5, 1), (6, 1), (7, 4)]
    assert [r.doc_id for r in by_id(OPERATORS["decontaminate"](odd))] == [None, None, 1, 2, 3, 4, 8, 9]


def test_language(odd):
    got = by_id(OPERATORS["language"](odd))
    assert sorted(r.lang_pred == "und" for r in got[:2]) == [False, True]
    assert [r.lang_pred == "und" for r in got[2:]] == [True, True, True, False, False, False, False, False, True, False]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    recognised = [r.doc_id for r in by_id(langid.recognised(odd, least=0.0))]
    assert recognised == [None, 4, 5, 5, 6, 7, 9]
    unlabelled = odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in langid.predictions(unlabelled).collect()} == {("und", 0.0)}


def test_quality(odd):
    got = by_id(OPERATORS["quality"](odd))
    assert len(got) == 12
    assert sorted(r.perplexity is None for r in got[:2]) == [False, True]
    assert [r.perplexity is None for r in got[2:]] == [True, True] + [False] * 8
    assert all(not r.kept for r in got if r.perplexity is None)


def test_mix(odd):
    got = by_id(OPERATORS["mix"](odd))
    assert len(got) == 12 and [r.mix_size for r in got if r.doc_id in (1, 2, 3, 4)] == [0, 0, 0, 60000]
    assert all(r.mix_taken <= 2 * r.mix_size for r in got)


def test_rules(odd):
    got = by_id(OPERATORS["rules"](odd))
    assert len(got) == 12 and got[5].n_words == 60000 and got[5].base_failed
    assert [r.n_words for r in got[:5]][2:] == [0, 0, 0]


def test_pseudonyms(odd):
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id}
    got = OPERATORS["pseudonyms"](odd).collect()
    assert len(got) == 12 and all(r.text == texts[r.doc_id] and r.n_replaced == 0 and r.spans == [] for r in got if r.doc_id)


@pytest.mark.parametrize("tokenizer", [None, chat.TOKENIZER])
def test_chat(spark, tokenizer):
    schema = "conv_id bigint, turn bigint, role string, text string, part string, own int, place int"
    rows = [
        (None, 0, "user", "hi", "x", 1, 2), (None, 1, "assistant", "ho", "x", 1, 2), (1, None, "user", None, "x", 1, 2), (1, 2, None, "b", "x", 1, 2),
        (1, 2, None, "b", "x", 1, 2), (2, 0, "assistant", "wörd " * 50_000, "x", 1, 2), (3, 0, "system", "s", "x", 1, 2),
    ]
    got = {r.conv_id: r for r in chat.summary(chat.windows(spark.createDataFrame(rows, schema), tokenizer=tokenizer)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 2), 1: (3, 0), 2: (1, 250_000), 3: (1, 0)}
    assert chat.windows(spark.createDataFrame([], schema), tokenizer=tokenizer).count() == 0
