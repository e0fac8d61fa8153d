"""Operators against plain versions on generated texts, at small block sizes so that every path runs."""

import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm import decontaminate, langid, minhash, mixing, ngrams, passages, rules, similar_lines
from logspark.llm.graph import components


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [2, 256])
def test_minhash_groups(docs, generated_docs, monkeypatch, n, percent, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    expected = brute.groups(generated_docs, n, percent)
    got = {r.doc_id: r for r in minhash.groups(docs, n, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.n_shingles == len(brute.shingles(dict(generated_docs)[i], n)) and r.kept == (i == expected[i]) for i, r in got.items())
    assert {r.doc_id for r in minhash.deduplicate(docs, n, percent).collect()} == set(expected.values())


def test_b_bit_estimate():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << minhash.BITS, (2, minhash.HASHES)).astype(np.uint64)
    words = minhash.packed(low)
    assert minhash.equal_values(words[:1], words[1])[0] == int((low[0] == low[1]).sum())
    assert minhash.similarity(np.array([minhash.HASHES]))[0] == 1


def test_minhash_links_all_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words), " ".join(f"v{i}" for i in range(60))
    table = [(0, second + " new"), (1, first), (1, second), (1, first), (4, first + " new"), (6, "some other text of few words")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.groups(docs).collect()}
    assert got == {(0, 0, True), (1, 0, False), (4, 0, False), (6, 6, True)}
    apart = spark.createDataFrame(table[1:3] + table[1:2], "doc_id bigint, text string")
    assert sorted(r.text for r in minhash.deduplicate(apart).collect()) == sorted([first, second])


@pytest.mark.parametrize("block", [2, 256])
def test_minhash_connects_groups_around_several_centres(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(40):
        texts.append(" ".join(words))
        words[(i * 37) % 120] = f"x{i}"
    expected = brute.groups(list(enumerate(texts)), 5, 80)
    got = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(set(expected.values())) < 40


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 150, (100, 2))] + [(200 + i, 199 + (i * 7) % 50) for i in range(50)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted((r.id, r.root) for r in got) == sorted((x, root[x]) for x in linked)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_removed_lines(docs, generated_docs):
    expected, lines = brute.removed_lines(generated_docs)
    got = {r.doc_id: r for r in similar_lines.removed_lines(similar_lines.judged_lines(docs)).collect()}
    assert {i: list(r.removed) for i, r in got.items() if r.removed} == expected
    assert {i: r.n_lines for i, r in got.items()} == lines


def test_frequent_words_are_dealt_to_blocks(docs, generated_docs, monkeypatch):
    monkeypatch.setattr(similar_lines, "HEAVY", 3)
    monkeypatch.setattr(similar_lines, "SMALL_GROUP", 2)
    expected, _ = brute.removed_lines(generated_docs)
    got = similar_lines.removed_lines(similar_lines.judged_lines(docs)).collect()
    assert {r.doc_id: list(r.removed) for r in got if r.removed} == expected


def test_lines_that_need_several_rounds(spark):
    """Many lines that pass the filters against each other without matching, and one late match."""
    base = [f"w{i}" for i in range(20)]
    lines = [" ".join(base[:14] + [f"x{k}a{j}" for j in range(6)]) for k in range(12)]
    docs = list(enumerate([*lines, lines[9].replace("x9a0", "other"), " ".join(base)]))
    expected, _ = brute.removed_lines(docs)
    got = similar_lines.removed_lines(similar_lines.judged_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()
    assert {r.doc_id: list(r.removed) for r in got if r.removed} == expected == {12: [0]}


def test_cut_lines(docs, generated_docs):
    removed, _ = brute.removed_lines(generated_docs, min_tokens=5)
    expected = {}
    for i, text in generated_docs:
        lines = text.split("\n")
        left = "".join(x + ("\n" if k < len(lines) - 1 else "") for k, x in enumerate(lines) if k not in removed.get(i, ()))
        if brute.words(left) or not brute.words(text):
            expected[i] = left
    got = similar_lines.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == expected


def test_repeated_passages(docs, generated_docs):
    expected = brute.repeated_spans(generated_docs)
    texts = dict(generated_docs)
    assert any(expected.values())
    for row in passages.remove_repeats(docs).collect():
        spans = [(s["first"], s["last"]) for s in row.spans]
        assert spans == expected[row.doc_id] and row.n_removed == len(spans)
        left, at = "", 0
        for a, b in spans:
            left, at = left + texts[row.doc_id][at:a], b
        assert row.text == left + texts[row.doc_id][at:]


def test_containment(spark, docs, generated_docs):
    texts = [t for _, t in generated_docs]
    items = [(k, " ".join(texts[k * 3].split()[: 8 + 3 * k])) for k in range(15)] + [(90, "no such words in any document at all"), (91, None), (None, texts[0])]
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    expected = brute.containment(generated_docs, [x for x in items if x[0] is not None])
    assert {(r.doc_id, r.item_id): r.n_shared for r in found} == expected
    clean = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in generated_docs} - {i for i, _ in expected}


def test_perplexity(spark, generated_docs):
    marked = [(i, "en", 0 if i % 3 else 1, t) for i, t in generated_docs]
    docs = spark.createDataFrame(marked, "doc_id bigint, lang string, role tinyint, text string").repartition(3)
    plain = brute.KneserNey([t for _, _, r, t in marked if r], ngrams.ORDER, 1 / 4096)
    got = ngrams.scores(docs, ngrams.model(docs.where("role = 1"))).collect()
    assert len(got) == len(marked)
    texts = dict(generated_docs)
    for r in got:
        if r.bytes:
            assert math.exp(-r.log_p / ngrams.UNIT / r.bytes) == pytest.approx(plain.perplexity(texts[r.doc_id]), rel=1e-4)


def test_threshold_is_the_quantile_of_held_out_trusted_texts(spark):
    good = [(i, f"the cat and the dog sat on the mat and looked at number {i} of the house.", "en") for i in range(400)]
    bad = [(1000 + i, "Xq#z7|Kw$ " * 12, "en") for i in range(10)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in ngrams.judged(docs, docs.where("doc_id < 400").select("doc_id")).collect()}
    held = [i for i, *_ in good if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].kept for i in held) >= 0.99 * len(held)
    assert not any(got[i].kept for i, *_ in bad)
    assert ngrams.judged(docs, docs.where("false").select("doc_id")).where("kept").count() == 410


def test_language_held_out(spark):
    import random

    rng = random.Random(5)
    syllables = {"aa": ["tho", "wer", "ing", "ed"], "bb": ["ció", "ñas", "lle", "que"], "cc": ["sch", "üng", "ver", "tz"]}
    rows = []
    for i in range(360):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, lang))
    got = langid.predictions(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {i: x for i, _, x in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_gradients_of_the_network():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(2)
    n, steps, batch = langid.HIDDEN, 5, 3
    d = langid.Direction(*(rng.normal(0, 0.5, s) for s in ((257, 3 * n), (2 * n, n), (n, n), (2, n))))
    codes = rng.integers(0, 5, (steps, batch))
    target = rng.normal(0, 1, (steps, n, batch))

    def loss():
        states = np.empty((steps, n, batch))
        unrolled(states, None)
        return float((states * target).sum())

    def unrolled(states, kept):
        h = np.zeros((n, batch))
        spare = np.empty((2 * n, batch))
        for t in range(steps):
            gates, fresh, after = langid.step(d, codes[t], h, spare)
            if kept is not None:
                kept.append((t, h, gates, fresh))
            states[t] = h = after

    kept = []
    unrolled(np.empty((steps, n, batch)), kept)
    grads = langid.backpropagate(d, codes, target, kept)
    for name, at in (("inputs", (2, 3)), ("inputs", (1, n + 2)), ("inputs", (3, 2 * n + 1)), ("gates", (1, 2)), ("gates", (n + 1, 3)), ("candidate", (2, 2))):
        weights = getattr(d, name)
        weights[at] += 1e-5
        up = loss()
        weights[at] -= 2e-5
        down = loss()
        weights[at] += 1e-5
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=1e-5)


def test_water_filling(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["a", "b", "c", "d", None][min(i % 11, 4)]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    wanted, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = (wanted - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        target.update({s: 2 * sizes[s] for s in above})
        free -= above
    target.update({s: weight[s] * level for s in free})
    taken = {s: sum(r.mix_taken for r in got if r.source == s) for s in names}
    assert all(r.mix_target == pytest.approx(target[r.source]) and r.mix_source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - target[s]) <= 17 for s in names)
    assert all(r.mix_taken <= 2 * r.mix_size and r.mix_taken == r.mix_repeats * r.mix_size for r in got)
    assert sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_rule_counts(docs, generated_docs):
    got = {r.doc_id: r for r in rules.features(docs).collect()}
    for i, text in generated_docs:
        w = brute.words(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, g in enumerate(windows) if windows.count(g) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if brute.words(x)]
        expected = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines))
        assert tuple(got[i][c] for c in rules.COUNTS) == expected


def test_adaptive_limits(spark):
    usual = [(i, " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(60)), "en", "a") for i in range(150)]
    odd = [(900, " ".join(f"#{k}#" for k in range(60)), "en", "a"), (901, "few words", "en", "a"), (902, "same same same " * 30, "en", "a")]
    got = {r.doc_id: r for r in rules.judged(spark.createDataFrame(usual + odd, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i, *_ in usual)
    assert not got[900].kept and not got[900].base_failed and "symbols" in got[900].broken
    assert got[901].base_failed and got[902].base_failed


def test_merging_sketches_gives_the_sketch_of_all(spark, docs):
    found = rules.features(docs).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    parts = rules.sketches(found).groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = rules.sketches(found.withColumn("source", F.lit("x"))).select("lang", "rule", "bucket", "n")
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_items_that_repeat_words_are_found_everywhere(spark):
    """Few different shingles in a long text: every planted item is found, and no other pair."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    kinds = [lambda: some(1) * 60, lambda: some(3) * 20, lambda: some(1) * 40 + some(1) * 40, lambda: some(2) * 5 + some(12) + some(1) * 50, lambda: some(9) * 2]
    items = [(i, " ".join(kinds[i % len(kinds)]())) for i in range(200)]
    texts = []
    for i, item in items:
        text = some(600)
        at = rng.randrange(601)
        texts.append((1000 + i, " ".join([*text[:at], item, *text[at:]])))
    texts += [(5000 + k, " ".join(some(600))) for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    sets = lambda rows: {i: {" ".join(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in rows}
    held, wanted = sets(texts), sets(items)
    want = sorted((d, i) for d, have in held.items() for i, own in wanted.items() if 100 * len(have & own) >= 80 * len(own))
    assert sorted((r.doc_id, r.item_id) for r in found) == want and {(1000 + i, i) for i in range(200)} <= set(want)
