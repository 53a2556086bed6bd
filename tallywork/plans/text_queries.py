"""Text extraction queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.functions import text as tx
from tallywork.plans.inputs import read_input, with_inputs
from tallywork.plans.registry import query

# SQL spellings of the text rules: there the dot already stops at \n only.
BOX_LAST = r"coalesce(list_filter(regexp_extract_all({c}, 'oxed\{{(.*?)\}}', 1), lambda m: m <> '')[-1], '')"
REDACTED = (
    "regexp_replace(regexp_replace(regexp_replace({c}, '(?s)```python(.*?)```', '[CODE REDACTED]', 'g'), "
    "'(?s)```output(.*?)```', '[OUTPUT REDACTED]', 'g'), "
    "'(?s)<thoughts>(.*?)</thoughts>', '[THOUGHTS REDACTED]', 'g')"
)
BLOCK_LAST = r"coalesce(regexp_extract_all({c}, '(?s)```python\s*(.*?)\s*```', 1)[-1], '')"
STRIP = r"regexp_replace({c}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
SECTIONS = (
    "array_to_string(list_filter(string_split(array_to_string(list_transform(regexp_extract_all({c}, "
    "'(?s)(```python.*?```|```output.*?```)', 1), lambda m: " + STRIP.format(c="m") + "), chr(10) || chr(10)), chr(10)), "
    "lambda l: NOT starts_with(" + STRIP.format(c="l") + ", '#')), chr(10))"
)
TOKENS = r"len(regexp_extract_all({c}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r\f\x0B]'))"
LINE_CUT = (
    "CASE WHEN length({c}) >= 1000 THEN left({c}, 100) || '[truncated ' || CAST(length({c}) - 200 AS VARCHAR)"
    " || ' characters]' || right({c}, 100) ELSE {c} END"
)


def _texts(expr: str, name: str) -> str:
    return with_inputs(f"SELECT doc_id, {expr} AS {name} FROM fx_texts", "texts")


def _select(spark, folder, source, *columns):
    return read_input(spark, folder, source).select("doc_id", *columns)


@query("last_boxed", _texts(BOX_LAST.format(c="text"), "boxed"))
def last_boxed(spark, folder):
    return _select(spark, folder, "texts", tx.last_boxed("text").alias("boxed"))


@query("first_boxed", with_inputs(r"""
SELECT generation_id, regexp_extract(completion, '\\boxed\{(.*?)\}', 1) AS boxed FROM fx_completions""", "completions"))
def first_boxed(spark, folder):
    return read_input(spark, folder, "completions").select("generation_id", tx.first_boxed("completion").alias("boxed"))


@query("redact_sections", _texts(REDACTED.format(c="text"), "redacted"))
def redact_sections(spark, folder):
    return _select(spark, folder, "texts", tx.redact_sections("text").alias("redacted"))


@query("answer_outside_sections", _texts(BOX_LAST.format(c=REDACTED.format(c="text")), "answer"))
def answer_outside_sections(spark, folder):
    return _select(spark, folder, "texts", tx.answer_outside_sections("text").alias("answer"))


@query("extract_sections", _texts(SECTIONS.format(c="text"), "sections"))
def extract_sections(spark, folder):
    return _select(spark, folder, "texts", tx.extract_sections("text").alias("sections"))


@query("last_code_block", _texts(BLOCK_LAST.format(c="text"), "code"))
def last_code_block(spark, folder):
    return _select(spark, folder, "texts", tx.last_code_block("text").alias("code"))


@query("completes_code", _texts(
    f"{BLOCK_LAST.format(c='text')} = '' AND {BLOCK_LAST.format(c='(text || added)')} <> ''", "completes"))
def completes_code(spark, folder):
    return _select(spark, folder, "texts", tx.completes_code("text", "added").alias("completes"))


@query("open_code_suffix", _texts(
    "CASE WHEN strpos(text, '```python' || chr(10)) = 0 THEN '' "
    "ELSE substr(text, strpos(text, '```python' || chr(10)) + 10) END", "suffix"))
def open_code_suffix(spark, folder):
    return _select(spark, folder, "texts", tx.open_code_suffix("text").alias("suffix"))


@query("replace_last", _texts(
    "CASE WHEN contains(text, '. ') THEN substr(text, 1, length(text) - strpos(reverse(text), ' .') - 1) || '<' || lang || '>' "
    "|| substr(text, length(text) - strpos(reverse(text), ' .') + 2) ELSE text END", "replaced"))
def replace_last(spark, folder):
    new = F.concat(F.lit("<"), F.col("lang"), F.lit(">"))
    return _select(spark, folder, "texts", tx.replace_last("text", F.lit(". "), new).alias("replaced"))


@query("truncate_lines", with_inputs(
    f"SELECT doc_id, {LINE_CUT.format(c='line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line "
    "FROM fx_texts)", "texts"))
def truncate_lines(spark, folder):
    lines = read_input(spark, folder, "texts").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", tx.truncate_line("line").alias("line"))


@query("truncate_output", with_inputs(
    "SELECT doc_id, CASE WHEN length(t) >= 7500 THEN left(t, 2000) || '[truncated ' || CAST(length(t) - 4000 AS VARCHAR) "
    "|| ' characters]' || right(t, 2000) ELSE t END AS output FROM (SELECT doc_id, array_to_string(list_transform("
    f"string_split(text, chr(10)), lambda l: {LINE_CUT.format(c='l')}), chr(10)) AS t FROM fx_texts)", "texts"))
def truncate_output(spark, folder):
    return _select(spark, folder, "texts", tx.truncate_output("text").alias("output"))


@query("token_count", _texts(TOKENS.format(c="text"), "tokens"))
def token_count(spark, folder):
    return _select(spark, folder, "texts", tx.token_count("text").alias("tokens"))


@query("training_span", _texts("string_split(text, '```python')[1]", "span"))
def training_span(spark, folder):
    return _select(spark, folder, "texts", tx.training_span("text").alias("span"))


@query("stdout_delta", _texts("ltrim(text, substr(text, 1, CAST(doc_id % 6 AS INT)))", "delta"))
def stdout_delta(spark, folder):
    seen = F.substr("text", F.lit(1), (F.col("doc_id") % 6).cast("int"))
    return _select(spark, folder, "texts", tx.stdout_delta("text", seen).alias("delta"))


CLEANED = (
    "SELECT doc_id, code, returncode, CASE WHEN returncode = 0 THEN o WHEN o <> '' THEN o || chr(10) || e ELSE e END AS output, "
    "e AS error FROM (SELECT doc_id, code, returncode, "
    f"{STRIP.format(c='stdout')} AS o, replace({STRIP.format(c='stderr')}, path, '<temporary_file>') AS e FROM fx_executions)"
)


def _cleaned(spark, folder):
    runs = read_input(spark, folder, "executions")
    return runs.withColumn("output", tx.clean_error_output("stdout", "stderr", "path", "returncode"))


@query("clean_error_output", with_inputs(f"SELECT doc_id, output FROM ({CLEANED})", "executions"))
def clean_error_output(spark, folder):
    return _cleaned(spark, folder).select("doc_id", "output")


@query("error_line_prefix", with_inputs(f"""
SELECT doc_id, CASE WHEN n IS NULL THEN code
                    ELSE array_to_string(list_slice(string_split(code, chr(10)), 1, n - 1), chr(10)) END AS prefix
FROM (SELECT doc_id, code, TRY_CAST(regexp_extract_all(error, 'File "<temporary_file>", line ([0-9]+)', 1)[-1] AS BIGINT) AS n
      FROM ({CLEANED}))""", "executions"))
def error_line_prefix(spark, folder):
    runs = read_input(spark, folder, "executions")
    masked = tx.masked_error("stderr", "path")
    return runs.select("doc_id", tx.error_line_prefix("code", masked).alias("prefix"))


@query("execution_outcome", with_inputs(f"""
SELECT doc_id, CASE WHEN returncode = 0 THEN 'ok' WHEN regexp_full_match(error, 'Execution timed out after [0-9]+ seconds\\.') THEN 'timeout' ELSE 'error' END AS outcome
FROM ({CLEANED})""", "executions"))
def execution_outcome(spark, folder):
    outcome = tx.execution_outcome(tx.masked_error("stderr", "path"), "returncode")
    return read_input(spark, folder, "executions").select("doc_id", outcome.alias("outcome"))
