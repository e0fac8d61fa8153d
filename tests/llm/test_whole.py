"""Cases where an operator once did less than its whole job."""

import math
import random

import brute
import corpus_pipeline
import pytest

from logspark.llm import ngrams, passages, similar_lines


def test_short_lines_of_the_pipeline(spark, docs, generated_docs):
    rows = [(0, "same words\nfirst"), (1, "Same  words\nsecond one"), (2, "first"), (3, "word word word word word word"), (4, "other\nword")]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert {r.doc_id: r.text for r in got} == {0: "same words\nfirst", 1: "second one", 3: "word word word word word word", 4: "other\n"}
    removed, _ = brute.removed_lines(generated_docs)
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    for i, text in generated_docs:
        stay = [x for k, x in enumerate(text.split("\n")) if k not in removed.get(i, ())]
        assert brute.words(left.get(i)) == brute.words("\n".join(stay))


def test_every_repeated_sentence_goes(spark, tmp_path, generated_docs):
    wide = [(100, "今日は晴れ。明日は雨！？"), (101, "昨日は雪。今日は晴れ。明日は雨！？ おわり。"), (102, "おわり。\n今日は晴れ。"), (103, "ไม่มีช่องว่าง\nnew"), (104, "old\nไม่มีช่องว่าง\nOld")]
    spark.createDataFrame([*generated_docs, *wide], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in passages.op6_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].text for i, _ in wide] == [wide[0][1], "昨日は雪。 おわり。", "", "ไม่มีช่องว่าง\nnew", "old\n"]
    assert [tuple(s) for s in got[101].spans] == [(5, 17)]
    expected = brute.repeated_spans(generated_docs, min_words=1)
    assert {i: [tuple(s) for s in got[i].spans] for i, _ in generated_docs} == expected


def test_classes_and_links_of_lines(spark, tmp_path, generated_docs, monkeypatch):
    monkeypatch.setattr(similar_lines, "HEAVY", 40)
    monkeypatch.setattr(similar_lines, "PAIRS", 64)
    base = [f"w{i}" for i in range(12)]
    star = [(200 + k, " ".join([*base[:11], f"x{k}"])) for k in range(9)]  # all match each other
    docs = [*generated_docs, *star, (300, star[4][1]), (301, ""), (302, " \n\t"), (303, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in similar_lines.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in docs}
    first, lines = {}, {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if tokens := frozenset(brute.words(brute.lower(line))):
                lines.setdefault(i, []).append((k, tokens, first.setdefault(tokens, (i, k))))
    links = {a: sum(brute.similar(a, b, 80) for b in first) - 1 for a in first}
    assert max(links.values()) == 8
    for i, _ in docs:
        assert [tuple(x) for x in got[i].lines] == [(k, len(t), *c, links[t]) for k, t, c in lines.get(i, [])]
    removed, _ = brute.removed_lines(docs)
    assert {i: list(r.removed) for i, r in got.items() if r.removed} == removed
    assert got[301].n_lines == got[303].n_lines == 0 and got[302].removed == got[302].lines == []


def test_word_grams_of_quality(spark, generated_docs):
    """Against direct recursion over words; the order of known words counts, which short byte contexts hardly see."""
    marked = [(i, "en", 0 if i % 3 else 1, t) for i, t in [*generated_docs, (61, generated_docs[1][1]), (62, "zz unknownword\n é")]]
    docs = spark.createDataFrame([*marked, marked[1]], "doc_id bigint, lang string, role tinyint, text string").repartition(3)
    got = {r.doc_id: r for r in ngrams.word_scores(docs).collect()}
    train = [brute.words(t) for _, _, r, t in marked if r == 1]
    spelling = brute.KneserNey([w + "\n" for w in {w for t in train for w in t}], ngrams.ORDER, 1 / 4096)

    class Words(brute.KneserNey):
        def grams(self, text):
            padded = ("", "", *text)
            return [padded[i : i + 3] for i in range(len(text))]

        def p(self, gram):
            if len(gram) > 1:
                return super().p(gram)
            total, spare = self.contexts[1][()]
            c = self.counts[1].get(gram, 0)
            base = spelling.perplexity(gram[0] + "\n") ** -len((gram[0] + "\n").encode())
            return (c - self.discount(1, c) if c else 0) / total + spare / total * base

    plain = Words(train, 3, None)
    for i, _, _, text in marked:
        words = brute.words(text)
        expected = -len(words) * math.log(plain.perplexity(words))
        assert got[i].bytes == len(text.encode()) and got[i].log_p / ngrams.UNIT == pytest.approx(expected, rel=1e-3)


def test_links_in_large_groups_of_lines(spark, tmp_path, monkeypatch):
    """Groups of near copies are sent as members, not as one row for each of their pairs; long lines have wide masks."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    lines = []
    for size, copies in ((20, 60), (30, 50), (130, 25), (220, 25)):
        base = rng.sample(words, size)
        for _ in range(copies):
            line = list(base)
            for k in rng.sample(range(size), size // 20):
                line[k] = rng.choice(words)
            lines.append(" ".join(line))
    lines += [" ".join(rng.sample(words, rng.choice((12, 100, 200)))) for _ in range(40)]
    docs = list(enumerate(lines))
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sets = [frozenset(x.split()) for x in lines]
    first = {t: i for i, t in reversed(list(enumerate(sets)))}
    expected = {i: (first[t], sum(brute.similar(t, other, 80) for other in first) - 1) for i, t in enumerate(sets)}
    removed, _ = brute.removed_lines(docs)
    seen = []
    whole = similar_lines.verified
    monkeypatch.setattr(similar_lines, "verified", lambda d, pairs, members=None: seen.append((pairs.count(), members.count())) or whole(d, pairs, members))
    monkeypatch.setattr(similar_lines, "HEAVY", 1 << 20)
    monkeypatch.setattr(similar_lines, "DENSE", 1)
    monkeypatch.setattr(similar_lines, "BLOCK", 16)
    monkeypatch.setattr(similar_lines, "TILE_PAIRS", 64)
    monkeypatch.setattr(similar_lines, "COMPARED", 1 << 12)
    got = {r.doc_id: r for r in similar_lines.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r.lines[0].class_doc, r.lines[0].n_links) for i, r in got.items()} == expected
    assert {i for i, r in got.items() if r.removed} == set(removed)
    pairs, members = seen[0]
    assert members and pairs < sum(n for _, n in expected.values()) / 2


def test_quality_leaves_no_tables_behind(spark, generated_docs, monkeypatch, tmp_path):
    """Word grams go in rounds whose tables are deleted; sums are the same as in one round."""
    from pathlib import Path

    marked = [(i, "en", 0 if i % 3 else 1, t) for i, t in [*generated_docs, (61, " \n"), (62, None)]]
    docs = spark.createDataFrame([*marked, marked[1]], "doc_id bigint, lang string, role tinyint, text string").repartition(3)
    once = sorted(map(tuple, ngrams.word_scores(docs).collect()))
    monkeypatch.setattr(ngrams, "ROUND_BYTES", 1 << 12)
    monkeypatch.setattr(ngrams, "ROUNDS", 3)
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(ngrams, "LEAST_WORD_SHARDS", 5)
    monkeypatch.setattr("logspark.session.shared_dir", lambda _: str(tmp_path))
    turns = []
    whole = ngrams.pack_words
    monkeypatch.setattr(ngrams, "pack_words", lambda rounds, turn, shards: turns.append((rounds, turn)) or whole(rounds, turn, shards))
    assert sorted(map(tuple, ngrams.word_scores(docs).collect())) == once
    assert turns == [(3, 0), (3, 1), (3, 2)]
    assert [p.name.split("-")[0] for p in Path(tmp_path).iterdir()] == ["scores"]
