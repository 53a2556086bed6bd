import random
import re

import pytest
from helpers import awkward, documents, prose
from pyspark.sql import functions as F

from tallywork.llm import line_dedup


def brute(rows, levels=("line", "sentence"), least=80):
    units = []
    for key, text, *_ in rows:
        text = text or ""
        for level in levels:
            at, mine = 0, []
            for part in re.split(r"(\n)" if level == "line" else r"(\n|(?<=\.) )", text):
                words = re.sub("[A-Z]", lambda m: m[0].lower(), part).rstrip(" \t\r\n\v\f.")
                words = re.findall(r"[^ \t\r\n\v\f]+", words)
                if part not in ("\n", " ") and words:
                    mine.append((level, tuple(words), (key is None, key or 0, at), key, at, at + len(part)))
                at += len(part)
            units += [(*u, v) for u, v in zip(mine, [*(u[4] for u in mine[1:]), None])]
    first = {}
    for level, words, rank, *_ in units:
        first[level, words] = min(first.get((level, words), rank), rank)
    out = []
    for key in {r[0] for r in rows}:
        # Whether each character is in a repeated unit, or in the break between two that are neighbours.
        gone = set()
        mine = [u for u in units if u[3] == key]
        repeated = {(u[0], u[4]) for u in mine if first[u[:2]] != u[2]}
        ends = {}
        for level, _, _, _, start, end, following in mine:
            if (level, start) in repeated:
                gone.update(range(start, end))
                if any((other, following) in repeated for other in levels):
                    ends[end] = following
        for end, following in ends.items():
            gone.update(range(end, following))
        spans, at = [], None
        for i in sorted(gone):
            if at is None or i > at[1]:
                at = [i, i + 1]
                spans.append(at)
            at[1] = i + 1
        out.append((key, [tuple(x) for x in spans if x[1] - x[0] >= least]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(i, rng.randint(2, 14)).capitalize() + rng.choice([".", "", ". "]) for i in range(25)]
    rows = awkward(spark) + [(100 + i, rng.choice(["", " "]) + "".join(rng.choice(pool) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.randint(1, 12))), "en", "x") for i in range(60)]
    found = line_dedup.repeated_units(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    expected = dict(brute(rows))
    assert all([tuple(s) for s in r.removed] == expected[r.doc_id] for r in found) and sum(bool(x) for x in expected.values()) > 15
    every = line_dedup.repeated_units(documents(spark, rows), least_run=1).collect()
    expected = dict(brute(rows, least=1))
    assert all([tuple(s) for s in r.removed] == expected[r.doc_id] for r in every)


def test_first_occurrence_survives_and_clean_rows_stay(spark):
    passage = prose(3, 60)
    rows = [(i, f"{prose(100 + i, 30)}\n{passage}\n{prose(200 + i, 30)}", "en", "x") for i in range(20)] + [(50, prose(7, 300), "en", "x")]
    rows.append((60, f"{prose(8, 20)}. {passage}. {prose(9, 20)}.", "en", "x"))
    docs = documents(spark, rows)
    cut = line_dedup.without(docs, line_dedup.repeated_units(docs))
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert [i for i, t in texts.items() if passage in t] == [0] or sorted(i for i, t in texts.items() if passage in t) == [0]
    assert texts[0] == rows[0][1] and texts[50] == rows[20][1]
    assert texts[1] == f"{prose(101, 30)}\n{prose(201, 30)}"
    assert texts[60] == f"{prose(8, 20)}. {prose(9, 20)}."


def test_paragraphs_and_empty_table(spark):
    block = prose(1, 8) + "\n" + prose(2, 8)
    docs = documents(spark, [(1, f"x\n\n{block}\n \n\ny", "en", "x"), (2, f"{block}\n\nz", "en", "x")])
    found = {r.doc_id: [tuple(s) for s in r.removed] for r in line_dedup.repeated_units(docs, levels=("paragraph",), least_run=20).collect()}
    assert found == {1: [], 2: [(0, len(block))]}
    assert line_dedup.repeated_units(documents(spark, [])).count() == 0


def test_line_of_most_documents(spark):
    shared = prose(5, 9)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit(shared + "\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    found = line_dedup.repeated_units(docs, least_run=20)
    assert found.where(F.size("removed") > 0).count() == 3999


def test_short_lines_and_other_scripts_go_with_their_passage(spark):
    """A copied passage goes with its short lines; a short line alone stays; lines without spaces are units too."""
    poem = "\n".join(["One", "two three", "", prose(3, 14), "four", "x"])
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 4
    rows = [
        (1, poem, "en", "x"), (2, f"{prose(4, 30)}\n{poem}\n{prose(5, 30)}", "en", "x"), (3, f"{prose(6, 30)}\ntwo three\n{prose(7, 30)}", "en", "x"),
        (4, chinese, "zh", "x"), (5, f"別\n{chinese}\n別的", "zh", "x"),
    ]
    docs = documents(spark, rows)
    texts = {r.doc_id: r.text for r in line_dedup.without(docs, line_dedup.repeated_units(docs)).collect()}
    assert texts == {1: poem, 2: f"{prose(4, 30)}\n{prose(5, 30)}", 3: rows[2][1], 4: chinese, 5: "別\n別的"}
