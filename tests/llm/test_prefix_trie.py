import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallywork.llm import prefix_trie
from tallywork.operators.stages import written

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, observe=None):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, node int, depth int, conv int")
    head, base = F.crc32(F.col("conv").cast("string")) % 6, F.col("conv") - F.col("conv") % 100
    out = prefix_trie.conversation_trie(table, head, base, 5, observe=observe)
    return sorted((tuple(r) for r in out.select(*NAMES).collect()), key=repr)


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(int(c - abs(c) % 100 * (1 if c > 0 else -1)), [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    kids = {n: sum(len(m) == len(n) + 1 for m in below[n]) for n in members}
    out = []
    for n, convs in members.items():
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below[n] if m)
        ids = ",".join(map(str, sorted(ends.get(n, []))))
        out.append((
            min(convs), len(n), min(members[n[:-1]]) if n else None, len(convs), kids[n], sum(not kids[m] for m in below[n]), saved, hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    chance = random.Random(2)
    rows = [(c, t, chance.choice(["user", "system"]), chance.choice(["a", "bb", "ccc"])) for c in range(-130, 330) for t in range(chance.randint(1, 7))]
    rows += [(500 + c, t, "user", "shared") for c in range(80) for t in range(7)]
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [
        (1, None, "user", "x"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, "ab", "c"), (3, 5, "a", "bc"), (None, 0, "user", "x"), (100, 0, "user", "long " * 5000), (101, 1, "u", "é😀"),
        (102, 1, "u", "é😀"), (7, -1, "b", "x"), (7, None, "a", "y"), (2**40, 1, "z", "z"), (6, 1, "u", "one"), (205, 0, "u", "no base"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(5, 0, "u", "t")]) == brute([(5, 0, "u", "t")])


def test_one_long_conversation_takes_few_rounds(spark):
    """A chain of 600 turns is contracted in far fewer rounds than it is deep, and each works on less."""
    rows = [(9, t, "user", f"turn {t % 5}") for t in range(600)] + [(c, t, "user", f"turn {t % 5}") for c in range(10, 20) for t in range(12)]
    seen = []
    assert found(spark, rows, lambda turn, nodes: seen.append(nodes)) == brute(rows)
    assert len(seen) < 45 and sum(seen) < 8 * seen[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_of_random_trees(spark, seed):
    chance = random.Random(seed)
    parent = {0: None} | {i: chance.choice([i - 1, i - 1, chance.randrange(i), 0]) for i in range(1, 400)}
    weight = {i: chance.randint(-5, 50) for i in parent}
    total = dict(weight)
    for i in range(399, 0, -1):
        total[parent[i]] += total[i]
    key = lambda i: None if i is None else i.to_bytes(16, "big")
    tree = written(spark.createDataFrame([(key(i), key(p), weight[i], 1) for i, p in parent.items()], "node binary, parent binary, w long, one long"), "tree")
    got = prefix_trie.subtree_totals(tree, ["w", "one"]).collect()
    assert {int.from_bytes(r.node, "big"): r.w for r in got} == total and len(got) == 400
    assert max(r.one for r in got) == 400


def test_ends_in_runs(spark):
    """Ids of many runs, negative ones too, are hashed in order."""
    ids = [*range(-3000, 5000, 3), 2**50, -(2**50)]
    random.Random(1).shuffle(ids)
    ends = spark.createDataFrame([(b"n" * 16, i) for i in ids] + [(b"m" * 16, 1)], "node binary, conv long").repartition(7)
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.ends_digest(ends).collect()}
    assert got == {b"n" * 16: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"m" * 16: hashlib.sha256(b"1").hexdigest()}
