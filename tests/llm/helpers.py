"""Small tables with every awkward case, and plain-Python versions of the rules."""

import random
import re

WORDS = "the of and to in that is was he for it with as his on be at by had not but from they she which or we an were been".split()
#: Columns whose names operators use inside.
CLASHING = {
    "key": 1, "found": "x", "spans": "y", "mix": 2, "units": "z", "epoch": 3, "removed": "r", "print": 4, "host": "h", "page": "p", "subtrees": "s",
    "main_text": "m", "level0": "l", "whole": 5, "cut": "c", "doc": "d", "id": 6, "turns": "t", "path": "q",
}


def prose(seed, size):
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) + chosen.choice(["", "", "ing", "ed", "er"]) for _ in range(size))


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text, lang, source); columns with clashing names beside them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    if not extra:
        return spark.createDataFrame(data, schema)
    names = ", ".join(f"`{k}` {'long' if isinstance(v, int) else 'string'}" for k, v in CLASHING.items())
    return spark.createDataFrame([(*d, *CLASHING.values()) for d in data], f"{schema}, {names}")


def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, "", "en", "src1"), (2, None, None, None), (None, "no id here but some words to read", "en", "src1"), (3, " \n\t ", "en", "src2"),
        (4, long, "en", "src0"), (5, prose(2, 40), "en", "src0"), (5, prose(2, 40), "en", "src0"), (6, prose(2, 40), "en", None), (7, "é", None, "src9"),
        (8, "...!!! 123 \x00\x0b", "fr", "src3"), (9, "Ünï cödé wörds \U0001f600 in a text", "de", "src4"), (10, prose(3, 12), "en", "src7"),
    ]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
