"""Inputs of the registered queries, derived from the given tables.

Every input is one SELECT over whole tables, without a shuffle but for the DISTINCT of the
questions. The same text feeds Spark and the SQL check, apart from the name of the string type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Answers as they arrive: about 13 per question, of many shapes; some without a question.
ANSWERS = """
SELECT CASE WHEN event_id % 101 <> 50 THEN user_id * 10 + event_id % 5 END AS question_id,
       event_id AS generation_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'math' ELSE 'code' END AS method,
       CAST(event_id * 37 % 340 AS BIGINT) AS arrival,
       CASE WHEN event_id % 11 = 0 THEN ''      WHEN event_id % 13 = 0 THEN '7/2'
            WHEN event_id % 17 = 0 THEN '1.0'   WHEN event_id % 19 = 0 THEN '-5'
            WHEN event_id % 23 = 0 THEN '1005'  WHEN event_id % 29 = 0 THEN ' 3 '
            WHEN event_id % 31 = 0 THEN '+2'    WHEN event_id % 37 = 0 THEN '002'
            WHEN event_id % 41 = 0 THEN '1_000' WHEN event_id % 43 = 0 THEN '9007199254740993'
            WHEN event_id % 47 = 0 THEN '-0'    WHEN event_id % 53 = 0 THEN '1e3'
            WHEN event_id % 59 = 0 THEN '100000000000000000000'          WHEN event_id % 61 = 0 THEN '100000000000000000001'
            WHEN event_id % 67 = 0 THEN '633825300114114700748351602688' WHEN event_id % 71 = 0 THEN '633825300114114700748351602689'
            WHEN event_id % 79 = 0 THEN '1606938044258990275541962092341162602522202993782792835301376'
            WHEN event_id % 83 = 0 THEN '-1606938044258990275541962092341162602522202993782792835301377'
            WHEN event_id % 73 = 0 THEN '-00100_000_000_000_000_000_000'
            WHEN user_id % 7 = 3 THEN CAST(event_id AS STRING)
            ELSE CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING) END AS answer
FROM {events}
"""

# The same with continuous arrivals, and gaps in question, method and arrival.
ARRIVALS = f"""
SELECT CASE WHEN generation_id % 97 <> 3 THEN question_id END AS question_id, generation_id,
       CASE WHEN generation_id % 89 <> 5 THEN method END AS method,
       CASE WHEN generation_id % 83 <> 7 THEN arrival + (generation_id % 1009) / 1009e0 END AS arrival, answer
FROM ({ANSWERS}) AS timed
"""

# Questions asked, among them some without any answer, and a missing one.
QUESTIONS = """
SELECT DISTINCT CASE WHEN event_id % 101 <> 50 THEN user_id * 10 + event_id % 6 END AS question_id FROM {events}
"""

# A problem table: texts repeat where documents are copies, some words serve as keywords.
PROBLEMS = """
SELECT CAST(doc_id AS STRING) AS id, doc_id AS position, text AS problem,
       doc_id * 7 % 1000 AS answer
FROM {documents}
"""

# Completions in six shapes: right, code, answer and empty box, both, no marker, neither; some
# without a known answer or a question.
# Four completions answer one prompt, sixteen make one training call.
COMPLETIONS = """
SELECT CASE WHEN doc_id % 40 < 38 THEN CAST(floor(doc_id / 4.0) AS BIGINT) END AS question_id, doc_id AS generation_id,
       CAST(floor(doc_id / 16.0) AS BIGINT) + 1 AS call_idx,
       CASE WHEN doc_id % 21 <> 2 THEN CAST(floor(doc_id / 4.0) AS BIGINT) % 10 END AS correct_answer,
       replace(text, '. ', '.' || chr(10) || chr(10)) ||
       CASE doc_id % 7
         WHEN 0 THEN '</think> ' || chr(92) || 'boxed' || chr(123)
                     || CAST(CAST(floor(doc_id / 4.0) AS BIGINT) % 10 AS STRING) || chr(125)
         WHEN 1 THEN '</think>' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```'
         WHEN 2 THEN '</think> ' || chr(92) || 'boxed' || chr(123) || CAST(doc_id % 10 AS STRING) || chr(125)
                     || ' ' || chr(92) || 'boxed' || chr(123) || chr(125)
         WHEN 3 THEN '</think> ' || chr(92) || 'boxed' || chr(123) || '1' || chr(125) || ' ```python' || chr(10)
         WHEN 4 THEN ''
         WHEN 5 THEN '</think> ' || chr(92) || 'boxed' || chr(123) || chr(125)
         ELSE '</think> done' END AS completion
FROM {documents}
"""

# The evaluation set, in the same shapes, as completed at the start and after every 16 calls.
EVALUATION = COMPLETIONS.replace("CAST(floor(doc_id / 16.0) AS BIGINT) + 1 AS call_idx", "CAST(floor(doc_id / 64.0) AS BIGINT) * 16 AS call_idx")

# Whole documents with sections, boxes, open fences and long lines planted around them.
TEXTS = """
SELECT doc_id, lang,
       CASE doc_id % 9
         WHEN 0 THEN text || '```python' || chr(10) || '# plan' || chr(10) || 'x = ' || CAST(doc_id AS STRING)
                     || chr(10) || '  # note' || chr(10) || 'print(x)' || chr(10) || '```' || chr(10)
                     || '```output' || chr(10) || '42' || chr(10) || '```' || chr(10)
                     || chr(92) || 'boxed' || chr(123) || CAST(doc_id % 100 AS STRING) || chr(125)
         WHEN 1 THEN chr(92) || 'boxed' || chr(123) || '1' || chr(125) || text
                     || chr(92) || 'boxed' || chr(123) || chr(125)
         WHEN 2 THEN 'plan' || chr(10) || '```python' || chr(10) || 'for i in range(3):' || chr(10)
                     || '    # ```python' || chr(10) || text
         WHEN 3 THEN '<thoughts>' || text || 'boxed' || chr(123) || '9' || chr(125) || '</thoughts> so '
                     || chr(92) || 'boxed' || chr(123) || CAST(doc_id % 7 AS STRING) || chr(125)
         WHEN 4 THEN '```python' || chr(10) || 'y = 1' || chr(10) || '```' || text
                     || '```python' || chr(10) || chr(10) || '```'
         WHEN 5 THEN '```output' || chr(10) || text || 'oxed' || chr(123) || '3' || chr(125) || '```'
                     || chr(92) || 'boxed' || chr(123) || '7/2' || chr(125)
         WHEN 6 THEN replace(text, chr(10), ' ') || chr(10) || repeat('z', CAST(990 + doc_id % 20 AS INT))
         WHEN 7 THEN text || chr(10) || 'oxed' || chr(123) || 'a' || chr(10) || 'b' || chr(125)
                     || ' oxed' || chr(123) || 'frac' || chr(123) || '1' || chr(125) || '2' || chr(125)
         ELSE text END AS text,
       CASE doc_id % 4 WHEN 0 THEN chr(10) || '```'
            WHEN 1 THEN '```python' || chr(10) || 'z = 3' || chr(10) || '```'
            WHEN 2 THEN 'k = ' || CAST(doc_id AS STRING) || chr(10) || '```' ELSE 'more' END AS added
FROM {documents}
"""

# Logged runs of code: fine, failed with a traceback, timed out, failed to parse, fine with a
# warning, killed without a word about a file.
EXECUTIONS = """
SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS code,
       '/tmp/run' || CAST(doc_id AS STRING) || '/tmp.py' AS path,
       CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || ' seen ' || chr(10) ELSE text END AS stdout,
       CASE doc_id % 6 WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 2 THEN NULL WHEN 5 THEN -9 ELSE 1 END AS returncode,
       CASE doc_id % 6
         WHEN 0 THEN ''
         WHEN 4 THEN '/tmp/run' || CAST(doc_id AS STRING) || '/tmp.py:1: SyntaxWarning: "is" with a literal'
         WHEN 5 THEN 'Killed'
         WHEN 1 THEN 'Traceback (most recent call last):' || chr(10) || '  File "/tmp/run' || CAST(doc_id AS STRING)
                     || '/tmp.py", line ' || CAST(doc_id % 9 + 3 AS STRING) || ', in <module>' || chr(10)
                     || '    f()' || chr(10) || '  File "/tmp/run' || CAST(doc_id AS STRING)
                     || '/tmp.py", line ' || CAST(doc_id % 5 + 1 AS STRING) || ', in f' || chr(10)
                     || 'ValueError: ' || text || chr(10)
         WHEN 2 THEN 'Execution timed out after 5 seconds.'
         ELSE '  File "/tmp/run' || CAST(doc_id AS STRING) || '/tmp.py", line ' || CAST(doc_id % 7 + 1 AS STRING)
                     || chr(10) || '    x = (' || chr(10) || 'SyntaxError: invalid syntax' END AS stderr
FROM {documents}
"""

# Generation logs: five records per run, the last one final; some runs have an end before it, and
# one question and one generation's number are missing. Runs come in pairs, the own run of a
# method (defer 0) and the hand-over to the other method (defer 1).
LOGS = """
SELECT event_id AS position, question_id, method, generation_idx, defer_count, request_counter,
       request_counter * 40 + event_id % 7 AS token_counter,
       CASE WHEN method = 'code' THEN CAST(event_id % 61 AS STRING) || ' s' END AS elapsed,
       CASE WHEN event_type = 'click' THEN 'step ' || props END AS new_buffer,
       CASE WHEN method = 'code' AND request_counter < 5 THEN 'a = ' || CAST(event_id AS STRING) END AS code,
       CASE WHEN event_id % 4 = 1 THEN chr(10) || props END AS injected,
       request_counter * 20 + event_id * 7 % 19 + 0.5e0 AS log_time,
       CASE WHEN request_counter = 5 OR event_id % 365 = 8 THEN CASE WHEN method = 'code' AND event_id % 3 = 0 THEN 'terminated' ELSE 'final' END
            WHEN method = 'math' THEN 'stream_complete'
            WHEN event_type = 'view' THEN 'terminal_code_execution'
            WHEN event_type = 'click' THEN 'longest_valid_prefix'
            WHEN event_type = 'error' THEN 'intermediate_code_execution'
            WHEN event_type = 'signup' THEN 'stop_token' ELSE 'unassigned' END AS reason,
       method = 'code' AND request_counter < 5 AND event_type IN ('click', 'signup') AS flag_for_training,
       'Question ' || coalesce(CAST(question_id AS STRING), '') || chr(10) || '```python' || chr(10) || 'a = '
         || CAST(event_id AS STRING) || chr(10) || '# check' || chr(10) || '```' || chr(10) || '```output' || chr(10)
         || props || chr(10) || '```' || chr(10) || repeat('word ', CAST(event_id % 60 AS INT)) AS prompt,
       CASE WHEN event_id % 10 = 4 THEN ''
            ELSE repeat('step ', CAST(event_id % 30 AS INT)) || '```python' || chr(10) || 'b = 2' END AS buffer,
       CASE WHEN request_counter < 5 THEN NULL WHEN event_id % 35 = 4 THEN ''
            ELSE CAST((coalesce(question_id, 4) + event_id % 3) % 10 AS STRING) END AS answer
FROM (
  SELECT *, CASE WHEN (coalesce(generation_idx, 1) + defer_count) % 2 = 1 THEN 'math' ELSE 'code' END AS method
  FROM (
    SELECT event_id, event_type, props,
           CASE WHEN event_id < 320 OR event_id >= 400 THEN CAST(floor(event_id / 80.0) AS BIGINT) END AS question_id,
           CASE WHEN event_id < 500 OR event_id >= 510 THEN CAST(floor(event_id / 10.0) AS BIGINT) % 8 + 1 END AS generation_idx,
           CAST(floor(event_id / 5.0) AS BIGINT) % 2 AS defer_count,
           event_id % 5 + 1 AS request_counter
    FROM {events}) AS numbered) AS records
"""

# Answers of every second question; of its duplicates the later position is the valid one.
LOG_PROBLEMS = """
SELECT CAST(floor(event_id / 3.0) AS BIGINT) * 2 AS question_id, event_id AS position, event_id * 3 % 10 AS answer
FROM {events}
"""

# Training records with whole documents as prompts and what follows a code output.
TRAINING_LOGS = """
SELECT doc_id AS position, CAST(floor(doc_id / 8.0) AS BIGINT) AS question_id, doc_id % 8 AS generation_idx,
       'code' AS method, 0 AS defer_count,
       CAST(floor(doc_id / 2.0) AS BIGINT) % 3 + 1 AS request_counter,
       doc_id % 5 <> 4 AS flag_for_training,
       text AS prompt,
       replace(text, '. ', '.' || chr(10)) || CASE doc_id % 3
         WHEN 0 THEN chr(92) || 'boxed' || chr(123) || '5' || chr(125)
         WHEN 1 THEN '```python' || chr(10) || 'x = 1' ELSE '' END AS buffer,
       CASE WHEN doc_id % 11 = 0 THEN '-1' ELSE CAST((doc_id + floor(doc_id / 8.0)) % 3 AS BIGINT) || '' END AS eventual_answer,
       CAST(CAST(floor(doc_id / 8.0) AS BIGINT) % 3 AS STRING) AS correct_answer
FROM {documents}
"""

# Whole documents with code blocks: fine, undefined names, broken, two blocks, star argument.
CODE_TEXTS = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'math' ELSE 'code' END AS method, doc_id % 6 AS shape,
       text || CASE doc_id % 6
         WHEN 0 THEN '```python' || chr(10) || 'x = ' || CAST(doc_id AS STRING) || chr(10) || 'print(x)' || chr(10) || '```'
         WHEN 1 THEN '```python' || chr(10) || 'print(total)' || chr(10) || '```'
         WHEN 2 THEN '```python' || chr(10) || 'for i in range(3) print(i)' || chr(10) || '```'
         WHEN 3 THEN '```python' || chr(10) || 'a = 1' || chr(10) || '``` then ```python' || chr(10)
                     || 'b = zeta + alpha + Symbol' || chr(10) || '```'
         WHEN 4 THEN '```python' || chr(10) || 'import math as m' || chr(10) || 'def f(a, *b):' || chr(10)
                     || '    return m.pi + a + len(b) + gamma' || chr(10) || '```'
         ELSE '' END AS text
FROM {documents}
"""

# Buffers that end in open code: sound, undefined name, open list, open block.
BUFFERS = """
SELECT doc_id, doc_id % 4 AS shape, text || '```python' || chr(10) || CASE doc_id % 4
         WHEN 0 THEN 'a = 1' || chr(10) || 'b = a' || chr(10) || 'print(b'
         WHEN 1 THEN 'a = ' || CAST(doc_id AS STRING) || chr(10) || 'print(q)' || chr(10) || 'c = (r,' || chr(10) || '2)' || chr(10) || 'd = '
         WHEN 2 THEN 'x = [' || chr(10) || '1,' || chr(10) || '2,' || chr(10) || '3,' || chr(10) || '4,' || chr(10)
                     || '5,' || chr(10) || '6,' || chr(10) || '7'
         ELSE 'k = ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || 'if k:' || chr(10) || chr(10) || 'z' END AS buffer
FROM {documents}
"""

# Turns of all roles, cut into pieces of 16 characters; a turn is one request of a generation.
PLANTED_TURNS = """
SELECT conv_id AS generation_id, turn AS request_counter,
       CASE WHEN (conv_id + turn) % 2 = 0 THEN 'math' ELSE 'code' END AS method,
       text || CASE conv_id % 5
         WHEN 0 THEN ' ' || chr(92) || 'boxed' || chr(123) || chr(125) || ' oxed' || chr(123)
                     || CAST(turn AS STRING) || chr(125) || ' and ' || text
         WHEN 1 THEN chr(10) || '```python' || chr(10) || 'x = ' || CAST(conv_id AS STRING) || chr(10) || '```' || text
         WHEN 2 THEN '```python' || chr(10) || '```' || text
         WHEN 3 THEN '```python' || chr(10) || 'y = oxed' || chr(123) || '8' || chr(125) || chr(10) || '``` ' || text
         ELSE '' END AS text
FROM {conversations}
"""

INPUTS = {
    "answers": ANSWERS, "arrivals": ARRIVALS, "questions": QUESTIONS, "problems": PROBLEMS, "completions": COMPLETIONS, "evaluation": EVALUATION,
    "texts": TEXTS, "executions": EXECUTIONS, "logs": LOGS, "log_problems": LOG_PROBLEMS,
    "training_logs": TRAINING_LOGS, "turns": PLANTED_TURNS,
    "code_texts": CODE_TEXTS, "buffers": BUFFERS,
}
PIECE = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, read as it lies."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """The input ``text`` over given frames; also works on streams."""
    return spark.sql(text, **frames)


def read_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = INPUTS[name]
    tables = {t: table(spark, folder, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return derive(spark, text, **tables)


def check_sql(name: str) -> str:
    """The input as SQL text for the check."""
    text = re.sub(r"\{(\w+)\}", r"\1", INPUTS[name])
    return re.sub(r"\bAS STRING\b", "AS VARCHAR", text)


def with_inputs(sql: str, *names: str) -> str:
    """``sql`` with the named inputs in front of it as fx_<name>."""
    heads = ", ".join(f"fx_{n} AS ({check_sql(n)})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
