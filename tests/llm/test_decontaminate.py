import re

import numpy as np
import pytest
from helpers import awkward, documents, lower, prose

from tallywork.llm import decontaminate
from tallywork.llm.fm_index import FmIndex, RankBits, WaveletTree

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for key, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for k in range(len(w)):
            for n in sizes:
                if k + n <= len(w) and tuple(w[k : k + n]) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[tuple(w[k : k + n])]
        out.append((key, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def result(df):
    return sorted(
        ((r[0], r.n_words, sorted(i for h in r.hits for i in range(h["start"], h["end"])), list(r["items"])) for r in df.collect()), key=repr
    )


ITEMS = [
    (1, prose(2, 25)), (2, "some words"), (None, prose(3, 12)), (3, ""), (4, None), (5, prose(2, 25)), (5, "text"), (6, "?!"), (7, prose(1, 300)[:900]),
]


def test_equals_brute_force_on_awkward_rows(spark):
    rows = awkward(spark) + [(20, prose(9, 30) + " " + prose(2, 25).upper() + ", " + prose(2, 25), "en", "x"), (21, "Some--words; some WORDS", "en", "x")]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, rows)
    expected = brute([(r[0], r[1]) for r in rows], ITEMS)
    assert result(decontaminate.contamination(docs, benchmark)) == expected
    # Small shards and a benchmark that takes many passes give the same.
    assert result(decontaminate.contamination(docs, benchmark, shard_bytes=50, block_bytes=120)) == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, awkward(spark))
    assert all(not r.hits and not r["items"] for r in decontaminate.contamination(docs, none).collect())
    empty = documents(spark, [])
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.decontaminated(empty, none).schema == empty.schema


def test_cut_keeps_clean_rows_and_all_columns(spark):
    passage = prose(2, 25)
    rows = [*awkward(spark), (30, "Before it. " + passage.upper() + " After it!", "en", "x")]
    docs = documents(spark, rows)
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    cut = decontaminate.decontaminated(docs, benchmark)
    assert cut.columns == docs.columns
    before = sorted(map(repr, (r for r in docs.collect() if r.doc_id not in (5, 6, 30))))
    assert sorted(map(repr, (r for r in cut.collect() if r.doc_id not in (5, 6, 30)))) == before
    assert [r.text for r in cut.where("doc_id = 30").collect()] == ["Before it. \n After it!"]
    assert not any(r.hits for r in decontaminate.contamination(cut, benchmark).collect())


@pytest.mark.parametrize("seed", range(8))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    alphabet = int(rng.integers(2, 9))
    text = np.append(rng.integers(0, alphabet, 400), 0)
    if seed % 2:
        text = np.append(np.tile(text[:40], 12), 0)  # copies
    index = FmIndex(text, alphabet, sample_every=7)
    lengths = rng.integers(1, 6, 40)
    phrases = np.zeros((40, 5), np.int64)
    for row, n in zip(phrases, lengths):
        row[5 - n :] = rng.integers(1, alphabet, n)
    low, high = index.search(phrases, lengths)
    for row, n, a, b in zip(phrases, lengths, low, high):
        phrase = row[5 - n :]
        at = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
        assert b - a == len(at) or (b <= a and not at)
        if at:
            assert sorted(index.locate(np.arange(a, b))) == at


def test_ranks():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, 333) == 1
    ranks = RankBits(bits)
    assert [int(ranks.ones(np.array([i]))[0]) for i in range(334)] == [int(bits[:i].sum()) for i in range(334)]
    symbols = rng.integers(0, 11, 333)
    tree = WaveletTree(symbols, 11)
    for c in range(11):
        assert tree.rank(np.full(334, c), np.arange(334)).tolist() == [int((symbols[:i] == c).sum()) for i in range(334)]
    found, _ = tree.symbol_and_rank(np.arange(333))
    assert found.tolist() == symbols.tolist()
