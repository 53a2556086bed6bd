import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywork.llm.packing import Stock, best_fit, encoder, packed, pieces, plan, reduced, sequences

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n \t x", "a<|endoftext|>b<|endoftext|>", "don't we'll I'M", "Ünï cödé \U0001f600‍\U0001f525 漢字かな กขค", "x" * 3000, "12345678901 a1b2", "\x00\x01é   z",
    "!!!???... --", "﻿‮", "   lead and trail   ", "tab\t\tnew\r\n\r\nline",
]


def ids_of(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [e.ids for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer():
    words = random.Random(3)
    mixed = ["".join(words.choice("aeÉß1 .\n\t'’#漢\U0001f600") for _ in range(60)) for _ in range(300)]
    with open(VOCABULARY, encoding="utf-8") as file:
        encode = encoder(file.read())
    for texts in (ODD, mixed, [prose(1, 2000)]):
        assert [list(x) for x in encode(texts)] == ids_of(texts)


def bins_of(counts, capacity):
    """The sequences of a plan, each as its pieces' (length, rank)."""
    rows, total = plan(counts, capacity)
    held = {}
    for (size, first, times, sequence, offset), after in zip(rows.tolist(), [*rows[1:].tolist(), [0]]):
        last = after[1] if after[0] == size else counts[size]
        for rank in range(first, last):
            held.setdefault(sequence + (rank - first) // times, []).append((offset + (rank - first) % times * size, size, rank))
    assert sorted(held) == list(range(total))
    return held


def checked(counts, capacity):
    held = bins_of(counts, capacity)
    assert Counter((s, r) for b in held.values() for _, s, r in b) == Counter((s, r) for s, n in counts.items() for r in range(n))
    for b in held.values():
        at = 0
        for offset, size, _ in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    return len(held)


def fewest(sizes, capacity):
    """The least number of sequences, by trying everything."""

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        head, rest = left[0], left[1:]
        options = [1 << 30]

        def fill(room, start, rest, taken):
            options.append(1 + best(tuple(x for i, x in enumerate(rest) if i not in taken)))
            for i in range(start, len(rest)):
                if rest[i] <= room:
                    fill(room - rest[i], i + 1, rest, taken | {i})

        fill(capacity - head, 0, rest, frozenset())
        return min(options)

    return best(tuple(sorted(sizes, reverse=True)))


@pytest.mark.parametrize("seed", range(60))
def test_fixed_sets_are_in_some_best_packing(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 20, 30, 100])
    low = chance.choice([1, capacity // 6, capacity // 4, capacity // 3])
    sizes = [chance.randint(max(1, low), capacity) for _ in range(chance.randint(1, 9))]
    stock = Stock(Counter(sizes))
    fixed = sum(g.bins for g in reduced(stock, capacity))
    left = [s for s, n in stock.left.items() for _ in range(n)]
    assert fixed + fewest(left, capacity) == fewest(sizes, capacity)
    assert fewest(sizes, capacity) <= checked(dict(Counter(sizes)), capacity) <= fewest(sizes, capacity) + 1


def test_three_pieces_can_be_fixed():
    """No two pieces beside 50 fill more than 26 and 24, and three do not fit."""
    stock = Stock(Counter([50, 26, 24, 20, 20]))
    assert [[p[0] for p in g.parts] for g in reduced(stock, 100)][0] == [50, 26, 24]


def test_large_counts_are_packed_as_one_by_one():
    """Counts in bulk give as many sequences as best fit piece by piece, and few more than fit at all."""
    chance = np.random.default_rng(1)
    for capacity, low in ((2048, 1), (500, 120), (64, 9)):
        counts = dict(Counter((low + (capacity - low) * chance.random(4000) ** 2).astype(int).tolist()))
        total = checked(counts, capacity)
        rooms = []
        for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            fitting = [i for i, r in enumerate(rooms) if r >= size]
            if fitting:
                i = min(fitting, key=lambda i: rooms[i])
                rooms[i] -= size
            else:
                rooms.append(capacity - size)
        assert total <= len(rooms) and (low > 1 or total <= -(-sum(s * n for s, n in counts.items()) // capacity) + 1)
        stock = Stock(counts)
        assert sum(g.bins for g in best_fit(stock, capacity)) == len(rooms)
    many, sequences_ = plan({100: 10**12, 28: 10**12, 2048: 10**11}, 2048)
    assert len(many) < 50 and sequences_ == 10**11 + 10**12 * 128 // 2048


def test_documents_are_cut_and_packed(spark):
    rows = [*awkward(spark), *((100 + i, t, "en", "s") for i, t in enumerate(ODD)), *((200 + i, "the same text", "en", "s") for i in range(300))]
    table = documents(spark, rows).repartition(5)
    cut = pieces(table, VOCABULARY, capacity=128)
    out = packed(cut, capacity=128)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    got = out.collect()
    by_document = {}
    for r in got:
        by_document.setdefault(r.doc_id, []).append(r)
    expected = {}
    for key, ids in zip([r[0] for r in rows], ids_of(r[1] or "" for r in rows)):
        expected.setdefault(key, []).append([*ids, 0])
    for key, there in expected.items():
        length = len(there[0])
        mine = sorted(by_document[key], key=lambda r: r.piece)
        assert len(mine) == len(there) * -(-length // 128)
        for r in mine:
            assert np.frombuffer(r.ids, "<u4").tolist() == there[0][r.start : r.start + r.length]
            assert r.length == (128 if r.piece else (length - 1) % 128 + 1)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(held) <= -(-sum(r.length for r in got) // 128) + 1
    # The packed sequences hold the ids of their pieces in order.
    whole = {r.sequence_id: r for r in sequences(out).collect()}
    assert sum(len(r.ids) for r in whole.values()) == 4 * sum(r.length for r in got)
    for r in got:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert (r.offset, r.doc_id, r.piece) in map(tuple, whole[r.sequence_id].pieces)


def test_empty_table(spark):
    assert packed(pieces(documents(spark, []), VOCABULARY).withColumn("crc", F.crc32("ids"))).count() == 0
