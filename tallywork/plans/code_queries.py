"""Checks of the code in whole documents. The SQL states what each planted shape must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.functions.text import open_code_suffix
from tallywork.operators import code_jobs
from tallywork.plans.inputs import read_input, with_inputs
from tallywork.plans.registry import query

ALLOWED = ("Symbol", "symbols", "sqrt")


@query("code_check_report", with_inputs("""
WITH findings(shape, finding, name) AS (VALUES (0, 'ok', NULL), (1, 'undefined', 'total'), (2, 'syntax_error', NULL),
  (3, 'ok', NULL), (3, 'undefined', 'alpha'), (3, 'undefined', 'zeta'), (4, 'undefined', 'b'), (4, 'undefined', 'gamma'))
SELECT method, finding, name, count(*) AS blocks FROM fx_code_texts JOIN findings USING (shape) GROUP BY ALL
""", "code_texts"))
def code_check_report(spark, folder):
    return code_jobs.code_check_report(read_input(spark, folder, "code_texts"), ALLOWED)


PREFIXES = """
codes AS (SELECT *, substr(buffer, strpos(buffer, '```python' || chr(10)) + 10) AS code FROM fx_buffers),
checked AS (SELECT *,
    CASE shape WHEN 0 THEN string_split(code, 'print')[1] WHEN 1 THEN string_split(code, 'print')[1]
               WHEN 2 THEN '' ELSE string_split(code, chr(10))[1] || chr(10) END AS prefix,
    CASE shape WHEN 0 THEN '' WHEN 1 THEN 'print(q)' || chr(10) || 'c = (r,' || chr(10) || '2)'
               WHEN 2 THEN code ELSE 'if k:' || chr(10) END AS suffix,
    CASE shape WHEN 1 THEN 'q' ELSE '' END AS names
  FROM codes)
"""


@query("valid_prefix_table", with_inputs(f"WITH {PREFIXES} SELECT DISTINCT code, prefix, suffix, names FROM checked", "buffers"))
def valid_prefix_table(spark, folder):
    codes = read_input(spark, folder, "buffers").select(open_code_suffix("buffer").alias("code"))
    return code_jobs.valid_prefix_table(codes).withColumn("names", F.array_join("names", " "))


@query("rewrite_decision", with_inputs(f"""
WITH {PREFIXES} SELECT doc_id, names, shape IN (1, 2) AS rolled_back,
       CASE WHEN shape IN (1, 2) THEN substr(buffer, 1, length(buffer) - length(code)) || prefix
            || CASE WHEN names <> '' THEN '# Define symbols ' || names ELSE '' END ELSE buffer END AS new_buffer
FROM checked""", "buffers"))
def rewrite_decision(spark, folder):
    decided = code_jobs.rewrite_decision(read_input(spark, folder, "buffers").select("doc_id", "buffer"))
    return decided.select("doc_id", F.array_join("names", " ").alias("names"), "rolled_back", "new_buffer")
