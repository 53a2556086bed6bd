"""Text extraction as native column expressions (no Python UDF).

Character positions and lengths are code points. A NULL text gives a NULL or empty result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: markers, patterns and labels of the text format -------------------
FENCE, PYTHON_FENCE = "```", "```python"
OPEN_CODE = "```python\n"
END_OF_THOUGHT = "</think>"
# (?d): only \n ends a line, so the dot also matches \r and U+2028.
BOXED = r"(?d)oxed\{(.*?)\}"
COMMAND_BOXED = r"(?d)\\boxed\{(.*?)\}"
PYTHON_SECTION = r"(?s)```python(.*?)```"
OUTPUT_SECTION = r"(?s)```output(.*?)```"
THOUGHTS_SECTION = r"(?s)<thoughts>(.*?)</thoughts>"
ANY_SECTION = r"(?s)(```python.*?```|```output.*?```)"
CODE_BLOCK = r"(?sU)```python[\s\x1C-\x1F]*(.*?)[\s\x1C-\x1F]*```"
# A box that is filled, for texts that are still growing.
FILLED_BOX = r"oxed\{([^}\n]+)\}"
CODE_LABEL = "[CODE REDACTED]"
OUTPUT_LABEL = "[OUTPUT REDACTED]"
THOUGHTS_LABEL = "[THOUGHTS REDACTED]"
MASKED_FILE = "<temporary_file>"
ERROR_LINE_MARK = 'File "<temporary_file>", line '
TIMED_OUT = r"^Execution timed out after [0-9]+ seconds\.$"
# White space as Unicode-aware trimming sees it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Stand-in token: a run of ASCII word characters, or one other character that is not a space.
WORD = "[A-Za-z0-9_]++"
TOKEN_SPACE = " \t\n\r\f\x0b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1))


def strip(c: Column | str) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def last_boxed(c: Column | str) -> Column:
    """Last non-empty boxed text, else ''."""
    filled = F.filter(_matches(c, BOXED), lambda m: m != "")
    return F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit(""))


def first_boxed(c: Column | str) -> Column:
    """First boxed text in its command form, '' if absent."""
    return F.regexp_extract(_col(c), COMMAND_BOXED, 1)


def redact_sections(c: Column | str) -> Column:
    """Python, then output, then thoughts sections become fixed labels."""
    c = F.regexp_replace(_col(c), PYTHON_SECTION, CODE_LABEL)
    c = F.regexp_replace(c, OUTPUT_SECTION, OUTPUT_LABEL)
    return F.regexp_replace(c, THOUGHTS_SECTION, THOUGHTS_LABEL)


def answer_outside_sections(c: Column | str) -> Column:
    """Last boxed text that is not inside a section."""
    return last_boxed(redact_sections(c))


def extract_sections(c: Column | str) -> Column:
    """All python and output sections, a blank line between them, comment lines dropped."""
    joined = F.array_join(F.transform(_matches(c, ANY_SECTION), strip), "\n\n")
    kept = F.filter(F.split(joined, "\n"), lambda line: ~strip(line).startswith("#"))
    return F.array_join(kept, "\n")


def last_code_block(c: Column | str) -> Column:
    """Content of the last closed python block, also when that is empty; '' if none."""
    return F.coalesce(F.try_element_at(_matches(c, CODE_BLOCK), F.lit(-1)), F.lit(""))


def completes_code(text: Column | str, added: Column | str) -> Column:
    """Does adding ``added`` give ``text`` its first filled, closed code block?"""
    text = _col(text)
    return (last_code_block(text) == "") & (last_code_block(F.concat(text, _col(added))) != "")


def open_code_suffix(c: Column | str) -> Column:
    """Text after the first code opening, '' if there is none."""
    c = _col(c)
    at = F.instr(c, OPEN_CODE)
    return F.when(at == 0, "").otherwise(F.substr(c, at + F.lit(len(OPEN_CODE))))


def replace_last(c: Column | str, old: Column | str, new: Column | str) -> Column:
    """Replace the last occurrence of ``old``; unchanged if absent."""
    c, old, new = _col(c), _col(old), _col(new)
    behind = F.length(F.call_function("substring_index", c, old, F.lit(-1)))
    before = F.substr(c, F.lit(1), F.length(c) - behind - F.length(old))
    after = F.substr(c, F.length(c) - behind + 1)
    return (
        F.when(old == "", F.concat(c, new))
        .when(F.contains(c, old), F.concat(before, new, after))
        .otherwise(c)
    )


def _cut_middle(c: Column, limit: int, keep: int) -> Column:
    length = F.length(c)
    cut = F.concat(
        F.left(c, F.lit(keep)),
        F.lit("[truncated "), (length - 2 * keep).cast("string"), F.lit(" characters]"),
        F.right(c, F.lit(keep)),
    )
    return F.when(length >= limit, cut).otherwise(c)


def truncate_line(c: Column | str) -> Column:
    """A line of 1,000 characters or more keeps its first and last 100."""
    return _cut_middle(_col(c), 1000, 100)


def truncate_output(c: Column | str) -> Column:
    """``truncate_line`` per line; then 7,500 characters or more keep the outer 2,000s."""
    lines = F.transform(F.split(_col(c), "\n"), truncate_line)
    return _cut_middle(F.array_join(lines, "\n"), 7500, 2000)


def token_count(c: Column | str) -> Column:
    """Stand-in token count; a table that brings its own count should use that column.

    Runs become one character and spaces none, so the length that is left is the count.
    """
    runs = F.regexp_replace(_col(c), WORD, "w")
    return F.length(F.translate(runs, TOKEN_SPACE, "")).cast("bigint")


def tokens_below(c: Column | str, limit: int) -> Column:
    """``token_count(c) < limit``; a text of fewer characters needs no count."""
    return (F.length(_col(c)) < limit) | (token_count(c) < limit)


def thought_and_rest(c: Column | str) -> tuple[Column, Column]:
    """The text before the first end-of-thought marker, and the text from the marker on.

    No token crosses the border, so counts of the two parts add up.
    """
    c = _col(c)
    head = F.substring_index(c, END_OF_THOUGHT, 1)
    return head, F.substr(c, F.length(head) + 1)


def training_span(c: Column | str) -> Column:
    """Text up to the next python fence, or all of it."""
    return F.substring_index(_col(c), PYTHON_FENCE, 1)


def stdout_delta(output: Column | str, seen: Column | str) -> Column:
    """Drop leading characters that belong to the set of seen characters."""
    return F.ltrim(_col(output), _col(seen))


def masked_error(stderr: Column | str, path: Column | str) -> Column:
    """Error text with the script's path masked."""
    return F.replace(strip(stderr), _col(path), F.lit(MASKED_FILE))


def clean_error_output(stdout: Column | str, stderr: Column | str, path: Column | str, code: Column | str) -> Column:
    """What a run that ended with return code ``code`` shows: a successful one its printed output
    only, warnings left out; any other the printed output, if there is any, and the masked error.
    """
    stdout, masked = strip(stdout), masked_error(stderr, path)
    return F.when(_col(code) == 0, stdout).when(stdout != "", F.concat_ws("\n", stdout, masked)).otherwise(masked)


def error_line_prefix(code: Column | str, masked_error: Column | str) -> Column:
    """Code before the line that the last traceback entry names; all of it if none does."""
    code = _col(code)
    marked = F.filter(F.split(_col(masked_error), "\n"), lambda line: F.contains(line, F.lit(ERROR_LINE_MARK)))
    # The field behind the line's first comma, without leading " line" characters, all digits.
    numbers = F.transform(marked, lambda line: F.regexp_extract(line, r"^[^,]*,[line ]*([0-9]+)(?:,|$)", 1))
    last = F.try_element_at(F.filter(numbers, lambda n: n != ""), F.lit(-1)).try_cast("int")
    lines = F.split(code, "\n")
    # A slice that ends one line early: line 0 would drop the code's last line.
    upto = F.when(last > 0, last - 1).otherwise(F.size(lines) - 1)
    return F.when(last.isNull(), code).otherwise(F.array_join(F.slice(lines, F.lit(1), upto), "\n"))


def execution_outcome(error: Column | str, code: Column | str) -> Column:
    """ok if the return code is 0, else timeout or error; a run that was cut off has no code."""
    return F.when(_col(code) == 0, "ok").when(_col(error).rlike(TIMED_OUT), "timeout").otherwise("error")
