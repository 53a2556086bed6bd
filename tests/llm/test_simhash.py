import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, lower, prose

from tallywork.llm import simhash
from tallywork.llm.components import components


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    out = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def reach(prints, distance):
    """Component number per position, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute(rows, distance=3):
    prints = [brute_print(r[1]) for r in rows]
    parts = reach(prints, distance)
    least = defaultdict(list)
    for r, c in zip(rows, parts):
        if r[0] is not None:
            least[c].append(r[0])
    return sorted(((r[0], p, min(least[c], default=None)) for r, p, c in zip(rows, prints, parts)), key=repr)


def near_rows():
    base = prose(70, 400).split()
    rows = [(500, " ".join(base), "en", "x"), (501, " ".join(base).upper(), "en", "x"), (502, "\t" + "  ".join(base), "en", "x")]
    for i in range(60):
        words = list(base)
        words[(i * 37) % 400] = f"new{i}"
        rows.append((600 + i, " ".join(words), "en", "x"))
    return rows + [(700 + i, prose(i, 1 + i % 5), "en", "x") for i in range(40)]


@pytest.mark.parametrize("options", [{}, {"split_above": 5}, {"distance": 6}])
def test_equals_all_pairs(spark, options):
    rows = awkward(spark) + near_rows() + [(None, "", "en", "x")]
    found = simhash.near_copies(documents(spark, rows), **options)
    assert sorted(map(tuple, found.select("doc_id", "print", "component_id").collect()), key=repr) == brute(rows, options.get("distance", 3))


def test_one_of_each_component_stays(spark):
    rows = awkward(spark) + near_rows()
    docs = documents(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    stays = {r for r in brute(rows) if r[0] == r[2]}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in stays}
    assert kept.where("doc_id = 5").count() == 2


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("options", [{}, {"split_above": 20}])
def test_near_copies_by_similarity(spark, options):
    """Copies with some words changed are found, other texts are not; the smallest id stays."""
    rows, similar = [], []
    for base in range(40):
        words = prose(base, 150 + 10 * base).split()
        rows.append((base * 10, " ".join(words), "en", "x"))
        for copy in range(1, 4):
            changed = list(words)
            for i in range(0, len(words), 30 * copy):
                changed[i] = f"w{base}x{copy}x{i}"
            rows.append((base * 10 + copy, " ".join(changed), "en", "x"))
            similar.append((base * 10 + copy, jaccard(rows[-1][1], " ".join(words))))
    rows += [(5000 + i, prose(900 + i, 60), "en", "x") for i in range(300)] + [(9000, "", "en", "x"), (9001, None, "en", "x")]
    docs = documents(spark, rows)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs, shingle=5, similarity=0.8, **options).collect()}
    assert all(i // 10 == c // 10 for i, c in found.items() if i < 5000)
    near = [i for i, j in similar if j >= 0.8]
    assert len(near) >= 80 and sum(found[i] != i for i in near) >= 0.95 * len(near)
    assert all(found[5000 + i] == 5000 + i for i in range(300)) and found[9001] == 9000
    assert simhash.one_of_each(docs, shingle=5, similarity=0.8).columns == docs.columns


def test_links_have_the_similarity(spark):
    """Pairs below 0.8 both stay, also where one is linked to a third text; links are all of 0.8 or more."""
    rows, pairs = [], []
    for base in range(60):
        words = prose(base, 400).split()
        changed = list(words)
        for i in range(0, 400, 14 + base):
            changed[i] = f"w{base}x{i}"
        rows += [(10 * base, " ".join(words), "en", "x"), (10 * base + 1, " ".join(changed), "en", "x"), (10 * base + 2, " ".join([*changed, "end"]), "en", "x")]
        pairs.append((base, jaccard(rows[-3][1], rows[-2][1]), jaccard(rows[-3][1], rows[-1][1])))
    assert sum(0.5 <= one < 0.79 for _, one, _ in pairs) >= 20
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows), shingle=5, similarity=0.8).collect()}
    for base, *similar in pairs:
        assert found[10 * base] == 10 * base
        assert found[10 * base + 1] == found[10 * base + 2] == (10 * base if max(similar) >= 0.8 else 10 * base + 1)


def test_repeats_count_once_by_similarity(spark):
    """Texts that share a looped line only all stay; those of equal shingles and other counts are copies."""
    loop = "all rights are reserved by us "
    rows = [(i, loop * 60 + prose(i, 40), "en", "x") for i in range(12)]
    rows += [(100 + i, prose(50, 60) + " " + loop * (2 + 40 * i) + prose(51, 60), "en", "x") for i in range(3)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows), shingle=5, similarity=0.8).collect()}
    assert found == {**{i: i for i in range(12)}, 100: 100, 101: 100, 102: 100}


def crowd(base, count, changed=4, size=200):
    """Texts of one base, each with some words of its own."""
    words = prose(base, size).split()
    out = []
    for copy in range(count):
        mine = list(words)
        for i in random.Random(copy).sample(range(size), changed):
            mine[i] = f"w{copy}x{i}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_texts": 50}, {"block_shingles": 3000}])
def test_blocks_of_a_neighbourhood_lose_no_link(spark, blocks):
    """Mixed similarities around the limit: the edges join up what comparing all pairs joins up."""
    texts = [t for c in (1, 2, 3, 4, 5) for t in crowd(1, 60, c)] + crowd(2, 40, 2) + ["one two", "three"]
    sets = [np.unique(simhash.hashes(t, 5)).view(np.int64) for t in texts]
    table = spark.createDataFrame([(b"r" if i < 340 else b"s", i.to_bytes(4, "big"), x.tolist()) for i, x in enumerate(sets)], "root binary, print binary, shingles array<bigint>")
    edges = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash.linked_texts(table, 0.8, **blocks).collect()]
    same = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in edges) and len(same) > 2000
    root = simhash.merge(np.arange(len(texts)), *np.array(edges).T)
    assert root.tolist() == simhash.merge(np.arange(len(texts)), *np.array(same).T).tolist()
    # No more than a forest for every two blocks that meet.
    assert len(edges) < len(texts) * (1 if not blocks else 25)


def test_shared_counts(spark):
    chance = np.random.default_rng(3)
    for share in (simhash.DENSE_SHARE, 0.0, 2.0):
        first, second = ([np.unique(chance.integers(0, 60, chance.integers(0, 40))) for _ in range(n)] for n in (30, 50))
        before, simhash.DENSE_SHARE = simhash.DENSE_SHARE, share
        try:
            assert simhash.shared_counts(first, second).tolist() == [[len(np.intersect1d(a, b)) for b in second] for a in first]
        finally:
            simhash.DENSE_SHARE = before
    assert simhash.shared_counts([], second).shape == (0, 50)


@pytest.mark.parametrize("count", [300, 3000])
def test_an_unlinked_crowd_is_no_square_of_rows(spark, count):
    """Texts of about 0.7 similarity all stay, and no step makes more rows than in proportion."""
    rows = [(i, t, "en", "x") for i, t in enumerate(crowd(9, count))]
    docs = documents(spark, rows, extra=False)
    prints = simhash.fingerprints(docs, "doc_id", "text", 5, wide=True).select("print").distinct()
    pairs = simhash.wide_pairs(prints, 0.8)
    # Each of the parts' two bands may join the crowd up once more.
    assert pairs.count() < 40 * count
    found = simhash.near_copies(docs, shingle=5, similarity=0.8).where("doc_id <> component_id").count()
    if count == 300:
        sets = [np.unique(simhash.hashes(r[1], 5)) for r in rows]
        i, j = simhash.similar(sets, sets, 0.8)
        assert found == len({max(x) for x in zip(i.tolist(), j.tolist()) if x[0] != x[1]})
    assert found < count / 10


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_copies(empty, shingle=5, similarity=0.8).count() == 0
    assert simhash.near_copies(empty).count() == simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_joins_up_all_links(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    codes = centres[rng.integers(0, 6, 700)]
    for _ in range(seed + 1):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    codes = np.unique(np.concatenate((codes, rng.integers(0, 2**63, 200, dtype=np.uint64)))).view(np.int64)
    bucket = np.zeros(len(codes), np.int64) if seed % 2 else codes & 3
    a, b = simhash.linked(bucket, codes, 3)
    mine = dict(zip(codes[a].tolist(), codes[b].tolist()))
    expected = {}
    for k in np.unique(bucket):
        inside = codes[bucket == k].tolist()
        parts = reach(inside, 3)
        least = defaultdict(list)
        for c, p in zip(inside, parts):
            least[p].append(c)
        expected |= {c: min(least[p]) for c, p in zip(inside, parts) if min(least[p]) != c}
    assert mine == expected


def test_gray_rank_is_the_place_in_the_sequence():
    places = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(places ^ (places >> np.uint64(1))) == places).all()


def test_groups_are_pruned():
    """Far fewer pairs are looked at than there are, also within one crowd of near copies."""
    rng = np.random.default_rng(0)
    crowd = np.full(4000, np.uint64(0x123456789ABCDEF0))
    for _ in range(4):
        crowd = crowd ^ (np.uint64(1) << rng.integers(0, 30, 4000).astype(np.uint64))
    codes = np.unique(crowd)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    one = np.zeros(len(codes), np.int64)
    i, _ = index.pairs(np.arange(len(codes)), 3, one, index.uniform_labels(one))
    assert len(i) == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (400, 401), (401, 400)]
    rng = np.random.default_rng(1)
    edges = [edges[i] for i in rng.permutation(len(edges))]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 100 for i in range(101, 161)}, **{i: 200 for i in range(201, 260)}, 1000: 200, 301: 300, 302: 300, 401: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
