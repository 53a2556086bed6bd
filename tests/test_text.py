"""Edge rows with values derived by hand."""

import pytest
from pyspark.sql import functions as F

from tallywork.functions import text as tx
from tallywork.functions.answers import answer_value, floor_mod, is_valid_answer

LAST_BOXED = [
    (r"\boxed{12} \boxed{}", "12"),
    ("oxed{1\n2} oxed{7}", "7"),
    (r"\boxed{\frac{1}{2}}", r"\frac{1"),
    ("oxed{a\u2028b}", "a\u2028b"),
    ("oxed{a\rb}", "a\rb"),
    ("no box", ""),
    (r"\boxed{}", ""),
    ("", ""),
]


def test_last_boxed(values):
    assert values([(t,) for t, _ in LAST_BOXED], "t string", tx.last_boxed("t")) == [w for _, w in LAST_BOXED]


def test_first_boxed_needs_the_command(values):
    texts = [("oxed{3}",), (r"\boxed{} \boxed{4}",), (r"x \boxed{042} y",)]
    assert values(texts, "t string", tx.first_boxed("t")) == ["", "", "042"]


def test_redact_sections(values):
    text = "a```python\nx```b```output\ny```c<thoughts>z\n</thoughts>d ```python open"
    want = "a[CODE REDACTED]b[OUTPUT REDACTED]c[THOUGHTS REDACTED]d ```python open"
    assert values([(text,), (want,)], "t string", tx.redact_sections("t")) == [want, want]


def test_extract_sections(values):
    text = "p```python\n# c\nx = 1\n  # d\n```q```output\n\u2003# no\n5```r"
    assert values([(text,), ("none",)], "t string", tx.extract_sections("t")) == ["```python\nx = 1\n```\n\n```output\n5```", ""]


def test_last_code_block(values):
    texts = [
        ("```python\nx=1\n``` ```python\n\n```", ""), ("```python x = 1 ``` tail", "x = 1"),
        ("```python\n\x1c\u3000y\u3000\x1c```", "y"), ("```python open", ""),
    ]
    assert values([(t,) for t, _ in texts], "t string", tx.last_code_block("t")) == [w for _, w in texts]


def test_completes_code(values):
    rows = [("```python\nx", "\n```"), ("```python\nx\n```", "```python\ny\n```"), ("", "no"), ("```python\n", "```")]
    assert values(rows, "t string, a string", tx.completes_code("t", "a")) == [True, False, False, False]


def test_open_code_suffix_uses_the_first_fence(values):
    rows = [("a```python\nb```python\nc",), ("```python x",), ("```python\n",)]
    assert values(rows, "t string", tx.open_code_suffix("t")) == ["b```python\nc", "", ""]


@pytest.mark.parametrize(
    "text,old,new,want",
    [("abcabc", "bc", "X", "abcaX"), ("aaa", "aa", "b", "ab"), ("abc", "z", "X", "abc"), ("héhé", "é", "e", "héhe"),
     ("abc", "", "X", "abcX"), ("abc", "abc", "", "")],
)
def test_replace_last(values, text, old, new, want):
    assert values([(text, old, new)], "t string, o string, n string", tx.replace_last("t", "o", "n")) == [want]


def test_truncation(values):
    lines = [("é" * 999,), ("é" * 1000,)]
    want = ["é" * 999, "é" * 100 + "[truncated 800 characters]" + "é" * 100]
    assert values(lines, "t string", tx.truncate_line("t")) == want
    text = "\n".join("x" * 500 for _ in range(20))
    assert values([(text,), ("y" * 9000,)], "t string", tx.truncate_output("t")) == [
        text[:2000] + f"[truncated {len(text) - 4000} characters]" + text[-2000:],
        "y" * 100 + "[truncated 8800 characters]" + "y" * 100,
    ]


def test_token_counts(values):
    texts = [("a_1 b, c!",), ("",), ("é ü\tx\x0by",), ("</think>",)]
    assert values(texts, "t string", tx.token_count("t")) == [5, 0, 4, 4]


def test_training_span(values):
    assert values([("ab```python c",), ("ab",)], "t string", tx.training_span("t")) == ["ab", "ab"]


def test_stdout_delta_strips_a_set(values):
    rows = [("abbacab", "ab"), ("abc", ""), ("", "a"), ("xyz", "ab")]
    assert values(rows, "o string, s string", tx.stdout_delta("o", "s")) == ["cab", "abc", "", "xyz"]


def test_error_texts(values):
    error = 'Traceback\n  File "/t/tmp.py", line 3, in <module>\n    f()\n  File "/t/tmp.py", line 2, in f\nValueError: x'
    warning = "/t/tmp.py:1: SyntaxWarning: x"
    rows = [(" out \n", error + "\n", "/t/tmp.py", 1), ("", error, "/t/tmp.py", None), (" 42\n", warning, "/t/tmp.py", 0), ("", warning, "/t/tmp.py", 0)]
    masked = error.replace("/t/tmp.py", "<temporary_file>")
    cleaned = values(rows, "o string, e string, p string, c int", tx.clean_error_output("o", "e", "p", "c"))
    assert cleaned == ["out\n" + masked, masked, "42", ""]
    codes = [("a\nb\nc", masked), ("a\nb", "no file"), ("a\nb\nc", '  File "<temporary_file>", line 3\nSyntaxError')]
    assert values(codes, "c string, e string", tx.error_line_prefix("c", "e")) == ["a", "a\nb", "a\nb"]
    ends = [(masked, 1), ("Execution timed out after 5 seconds.", None), ("", 0), (masked, 0), ("Killed", -9), ("MemoryError", 1)]
    assert values(ends, "o string, c int", tx.execution_outcome("o", "c")) == ["error", "timeout", "ok", "ok", "error", "error"]


VALID = ["5", " 42 ", "+5", "-5", "007", "1_000", "9007199254740992", "\u20037\u3000"]
INVALID = ["", "1.0", "1e3", "7/2", "9007199254740993", "_1", "1__0", "1_", "+", "0x1", "nan", "5 5", None]


def test_valid_answers(values):
    assert values([(v,) for v in VALID], "a string", is_valid_answer("a")) == [True] * len(VALID)
    assert values([(v,) for v in INVALID], "a string", is_valid_answer("a")) == [False] * len(INVALID)
    assert values([(v,) for v in VALID], "a string", answer_value("a")) == [str(int(v)) for v in VALID]


def test_floor_mod(values):
    assert values([(-5,), (1005,), (0,)], "v bigint", floor_mod(F.col("v"))) == [995, 5, 0]


def test_token_limit_with_and_without_a_count(values):
    texts = [("a " * 9,), ("a " * 10,), ("word" * 50,), ("",)]
    assert values(texts, "t string", tx.tokens_below("t", 10)) == [True, False, True, True]


def test_redaction_is_stable_on_closed_sections(values):
    text = "a```python\nx```b```output\ny```c<thoughts>z</thoughts>"
    once = tx.redact_sections("t")
    assert values([(text,)], "t string", once) == values([(text,)], "t string", tx.redact_sections(once))
