"""The skipping search against the plain one, and what counts as defined."""

import random
import time

import pytest

from tallywork.functions.code_check import finding, longest_valid_prefix
from tallywork.operators import code_jobs

PIECES = (
    "x = 1|y = x|print(q)|if x:|    z = 2|else:|try:|    w = r|except E as e:|finally:|    pass|foo(|1,|)|[|]|'''|a b c||"
    "for i in y:|def f(a, *b):|    return b|  bad|@dec|class C:|x = (1 2|while True: x \\|f'{x'|'abc|x = = 2|(x|= 5)|{|}|{1:2,"
).split("|")


def plain_search(code):
    lines, names = code.split("\n")[:-1], []
    for n in range(len(lines), 0, -1):
        text = "\n".join(lines[:n])
        text = text if text.endswith("\n") else text + "\n"
        found, undefined = finding(text)
        if found == "ok":
            return text, "\n".join(lines[n:]), names
        names = undefined if found == "undefined" else names
    return "", code, []


@pytest.mark.filterwarnings("ignore")
def test_search_equals_the_plain_one():
    rng = random.Random(11)
    for _ in range(4000):
        code = "\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12)))
        assert longest_valid_prefix(code) == plain_search(code)


@pytest.mark.parametrize(
    "code,undefined",
    [
        ("a = b", ["b"]), ("import os.path as p, sys.x\np\nsys\nos", ["os"]), ("from m import a as c, d\na\nc\nd", ["a"]),
        ("def f(a, /, b, *c, d=1, **e):\n    return a, b, c, d, e", ["a", "c", "d", "e"]), ("lambda v: v", ["v"]),
        ("async def g(h):\n    return h\ng", ["g", "h"]), ("for i, (j, k) in []:\n    i, j, k", []), ("[q for q in range(3)]", []),
        ("try:\n    pass\nexcept Exception as e:\n    e", ["e"]), ("late\nlate = 1", []), ("class K: pass\nK\nlen", []),
        ("Symbol", []),
    ],
)
def test_names(code, undefined):
    assert finding(code, {"Symbol"}) == ("undefined" if undefined else "ok", undefined)
    assert finding("for") == ("syntax_error", [])


def test_depth_is_a_finding_of_its_own():
    assert finding("x = " + "-" * 100_000 + "1") == ("too_deep", [])
    assert finding("x\0") == ("syntax_error", [])


def test_long_open_text_is_quick():
    code = "x = 1\n" + "y = [\n" + "1,\n" * 3000
    assert longest_valid_prefix(code) == ("x = 1\n", "y = [\n" + "1,\n" * 2999 + "1,", [])
    code = "x = 1\nprint(q)\n" + "y = x\n" * 3000
    assert longest_valid_prefix(code)[0::2] == ("x = 1\n", ["q"])


def test_a_long_block_is_quick():
    """Twenty thousand lines within one function, with an error and an undefined name far apart."""
    body = "".join(f"    v{i} = v{max(i - 1, 0)} + 1\n" for i in range(20_000))
    code = "def f(v0):\n" + body.replace("    v15000 =", "    v15000 = missing +", 1).replace("    v19000 =", "    v19000 = = ", 1)
    started = time.perf_counter()
    prefix, rest, names = longest_valid_prefix(code)
    assert prefix.count("\n") == 15_001 and rest.startswith("    v15000") and names == ["missing"]
    assert time.perf_counter() - started < 20


def test_blank_lines_and_comments_belong_to_what_parses():
    assert longest_valid_prefix("# a\n\nx = (\n") == ("# a\n", "x = (", [])
    assert longest_valid_prefix("x = 1\n\n  # c\ny = q\nz") == ("x = 1\n\n  # c\n", "y = q", ["q"])
    assert longest_valid_prefix("") == ("", "", []) and longest_valid_prefix("x = 1") == ("", "x = 1", [])


@pytest.mark.filterwarnings("ignore")
def test_other_line_breaks_are_read_as_the_parser_does():
    rng = random.Random(12)
    for _ in range(500):
        code = rng.choice(["\r", "\f", "\n\f", "\r\n"]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 6))) + "\nlast"
        assert longest_valid_prefix(code) == plain_search(code)


def test_rewrite(spark):
    rows = [
        (1, "go ```python\na = 1\nprint(q)\nb"), (2, "```python\na = 1\nb"), (3, "no code"), (4, "```python\nx = [\n" + "1,\n" * 6 + "2"),
        (5, "```python\na = 1\nif a:\n\n\nb"), (6, "```python\na = 1\nprint(q)\nb"),
    ]
    df = spark.createDataFrame(rows, "id bigint, buffer string")
    got = {r.id: (r.rolled_back, r.new_buffer) for r in code_jobs.rewrite_decision(df).collect()}
    assert got == {
        1: (True, "go ```python\na = 1\n# Define symbols q"), 2: (False, rows[1][1]), 4: (True, "```python\n"),
        5: (True, "```python\na = 1\n"), 6: (True, "```python\na = 1\n# Define symbols q"),
    }
