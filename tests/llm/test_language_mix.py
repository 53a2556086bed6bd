import zlib

import numpy as np
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from tallywork.llm import language_mix

LETTERS = {"aa": "kalipotu", "bb": "vrezwyx", "cc": "mnhgsd"}


def made(language, seed, size):
    rng = np.random.default_rng(seed)
    letters = LETTERS[language]
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(size))


def labelled(spark, per=40):
    rows = [(i, made(k, i, 60), k, "src1") for i, k in enumerate(LETTERS) for _ in [0] for i in range(i * 1000 + 500, i * 1000 + 500 + per)]
    return rows


def test_held_out_accuracy_and_proportions(spark):
    rows = labelled(spark) + [(9000, made("aa", 1, 70) + " " + made("cc", 2, 30), None, None), (9001, made("bb", 5, 3), None, None)]
    docs = documents(spark, rows)
    model = language_mix.learn(docs.where(~language_mix.held_out()))
    assert model[0] == sorted(LETTERS)
    found = {r.doc_id: r for r in language_mix.identify(docs, model).collect()}
    assert all(found[i].language == lang for i, _, lang, _ in rows if lang)
    mixed = found[9000]
    assert mixed.language == "aa" and set(mixed.proportions) == {"aa", "cc"} and abs(mixed.score - 0.7) < 0.05
    assert found[9001].language == "bb"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_prediction_is_of_the_text_alone(spark):
    docs = documents(spark, labelled(spark, 20))
    model = language_mix.learn(docs.where(~language_mix.held_out()))
    one = {r.doc_id: (r.language, r.score) for r in language_mix.identify(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q")})
    assert one == {r.doc_id: (r.language, r.score) for r in language_mix.identify(other, model).collect()}


def test_awkward_rows(spark):
    docs = documents(spark, awkward(spark) + labelled(spark, 10))
    model = language_mix.learn(docs)
    found = language_mix.identify(docs, model).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    for i in (1, 2, 3, 8):
        assert (by[i].language, by[i].score, by[i].proportions) == ("und", 0.0, {})
    assert by[4].language == "en" and by[7].language != "und"
    kept = language_mix.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_numbers_in_other_forms_are_no_letters(spark):
    table = np.log(np.full((1 << 16, 2), 0.5, np.float32))
    found = language_mix.mixtures(["½ ² ①", "Ⅳ ٣", "ª", "x²", "é", "漢"], ["aa", "bb"], table, 2.0)
    assert [m["language"] for m in found] == ["und", "und", "aa", "aa", "aa", "aa"]


def test_ties_go_to_the_language_that_sorts_first(spark):
    docs = documents(spark, [(i, made("aa", 3, 30), k, None) for i, k in enumerate(["zz", "mm", "bb"])] + [(9, made("aa", 4, 30), None, None)])
    found = language_mix.identify(docs, language_mix.learn(docs)).where("doc_id = 9").first()
    assert found.language == "bb" and found.score == 1.0


def plain_mixture(text, table, penalty):
    """Proportions by the plainest form of the method: every set of the k largest proportions, word by word."""
    words = []
    for word in language_mix.letters(text).split():
        buckets, _ = language_mix.trigrams(b" " + word + b" ")
        words.append(np.exp(np.maximum((w := table[buckets].sum(axis=0)) - w.max(), np.log(1e-30))))

    def maximised(inside, share):
        for _ in range(language_mix.ITERATIONS):
            joint = [w * share / (w * share).sum() for w in words]
            new = sum(joint) / len(words)
            moved, share = abs(new - share).max(), new
            if moved < language_mix.SETTLED:
                break
        return share, sum(np.log((w * share).sum()) for w in words)

    n = table.shape[1]
    single = [sum(np.log(w[j]) for w in words) for j in range(n)]
    best, chosen = max(single), np.eye(n)[int(np.argmax(single))]
    full, _ = maximised(None, np.full(n, 1 / n))
    order = np.argsort(-full, kind="stable")
    for k in range(2, n + 1):
        share = np.where(np.isin(np.arange(n), order[:k]), np.maximum(full, 1e-6), 0)
        share, fit = maximised(None, share / share.sum())
        if fit - (k - 1) * penalty * np.log(max(2, len(words))) > best:
            best, chosen = fit - (k - 1) * penalty * np.log(max(2, len(words))), share
    return chosen


def test_equals_plain_expectation_maximisation(spark):
    docs = documents(spark, labelled(spark, 20))
    names, table = language_mix.learn(docs)
    texts = [made("aa", i, 20 + i) + " " + made("bb", i + 50, 5 * i) + (" " + made("cc", i, 30) if i % 3 == 0 else "") for i in range(12)] + [made("cc", 1, 1)]
    for text, found in zip(texts, language_mix.mixtures(texts, names, table, 2.0)):
        want = plain_mixture(text, table.astype(np.float64), 2.0)
        assert {n: v for n, v in found["proportions"]}.keys() == {names[j] for j in np.flatnonzero(want > 0)}
        assert all(abs(v - want[names.index(n)]) < 2e-3 for n, v in found["proportions"])


def test_foreign_texts_do_not_fit(spark):
    rows = labelled(spark, 60)
    foreign = [(9000, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 4, None, None), (9001, " ".join("qxzjf"[(i * 7 + j) % 5] * 3 + "jqf" for i in range(30) for j in range(2)), None, None), (9002, made("bb", 7, 2), None, None)]
    docs = documents(spark, rows + foreign)
    model = language_mix.learn(docs)
    fits = language_mix.typical_fits(docs, model)
    assert fits.keys() == set(LETTERS)
    kept = {r.doc_id for r in language_mix.accepted(docs, model, fits=fits).collect()}
    assert kept == {r[0] for r in rows} | {9002}
    assert {9000, 9001} <= {r.doc_id for r in language_mix.accepted(docs, model).collect()}


def test_nothing_learned_and_empty_table(spark):
    docs = documents(spark, [(1, "words", None, None)])
    model = language_mix.learn(docs)
    assert [r.language for r in language_mix.identify(docs, model).collect()] == ["und"]
    assert language_mix.identify(documents(spark, []), model).count() == 0


def test_fold_is_that_of_the_checksum(spark):
    rows = [(i, "", None, None) for i in [*range(50), -3, None]]
    found = documents(spark, rows).select("doc_id", language_mix.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_single_language_needs_no_search(spark):
    table = np.log(np.full((1 << 16, 1), 0.5, np.float32))
    assert language_mix.mixtures(["some words"], ["en"], table, 2.0)[0]["score"] == 1.0


def test_counts_are_over_all_texts(spark):
    text = prose(1, 50)
    docs = documents(spark, [(1, text, "en", None), (2, text, "en", None), (3, "", "en", None), (4, text, None, None)])
    total = language_mix.trigram_counts(docs, "text", "lang").agg(F.sum("n")).first()[0]
    assert total == 2 * sum(c.isalpha() for c in text)
