"""Generation logs, problem tables, prompts, budgets and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators import budget, curate, logs, prompts, throttle
from tallywork.plans.inputs import PIECE, read_input, with_inputs
from tallywork.plans.registry import query
from tallywork.plans.text_queries import SECTIONS, TOKENS
from tallywork.session import run_folder
from tallywork.sources import log_files, problems

RUN = "question_id, method, generation_idx, defer_count"
ENDS = f"""ends AS (SELECT * FROM fx_logs WHERE reason IN ('final', 'terminated')),
  last_ends AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY {RUN} ORDER BY log_time DESC) = 1)"""


def _same(a: str, b: str, *columns: str) -> str:
    """Whether rows of two tables agree, also in missing values."""
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)


KNOWN = """known AS (SELECT question_id, CAST(answer AS VARCHAR) AS correct_answer FROM fx_log_problems
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY position DESC) = 1)"""
CHUNKS = f"""chunks AS (SELECT generation_id, request_counter, method, chunk_idx, substr(text, chunk_idx * {PIECE} + 1, {PIECE}) AS chunk,
    (chunk_idx + 1) * {PIECE} >= length(text) AS is_last
  FROM (SELECT *, unnest(generate_series(0, greatest(length(text) - 1, 0) // {PIECE})) AS chunk_idx FROM fx_turns))"""


def cut_pieces(turns):
    """Texts as a stream of chunks, the last one marked; an empty text is one empty chunk.

    A text is cut in one go, as a substring is counted out from the text's first character.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = turns.select("generation_id", "request_counter", "method", F.when(F.length("text") > 0, pieces).otherwise(F.array("text")).alias("pieces"))
    return cut.select("generation_id", "request_counter", "method", F.size("pieces").alias("n"), F.posexplode("pieces").alias("at", "chunk")).select(
        "generation_id", "request_counter", "method", F.col("at").cast("bigint").alias("chunk_idx"), "chunk", (F.col("at") + 1 == F.col("n")).alias("is_last"),
    )


def _logs(spark, folder):
    return read_input(spark, folder, "logs")


def _ends(spark, folder):
    return logs.closings(_logs(spark, folder))


def _chunks(spark, folder):
    return cut_pieces(read_input(spark, folder, "turns"))


# ---- Logs ---------------------------------------------------------------------------


@query("final_logs", with_inputs("SELECT * FROM fx_logs WHERE reason = 'final'", "logs"))
def final_logs(spark, folder):
    return logs.final_logs(_logs(spark, folder))


@query("training_logs", with_inputs("SELECT * FROM fx_logs WHERE flag_for_training", "logs"))
def training_logs(spark, folder):
    return logs.training_logs(_logs(spark, folder))


@query("normalize_logs", with_inputs("""
SELECT question_id, method, generation_idx, defer_count, request_counter, CASE WHEN method = 'math' THEN token_counter END AS token_counter,
       log_time, CASE WHEN method = 'code' THEN elapsed END AS elapsed, reason,
       CASE WHEN method = 'code' THEN flag_for_training END AS flag_for_training,
       CASE WHEN method = 'math' OR reason <> 'unassigned' THEN prompt END AS prompt,
       CASE WHEN method = 'code' THEN buffer END AS buffer, CASE WHEN method = 'code' THEN new_buffer END AS new_buffer,
       CASE WHEN method = 'code' THEN code END AS code, CASE WHEN method = 'code' THEN injected END AS injected,
       CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS eventual_answer, CAST(NULL AS VARCHAR) AS correct_answer FROM fx_logs""", "logs"))
def normalize_logs(spark, folder):
    rows = _logs(spark, folder).drop("answer")
    math = rows.where("method = 'math'").drop("flag_for_training", "buffer", "elapsed", "new_buffer", "code", "injected")
    code = rows.where("method = 'code'").drop("token_counter")
    unassigned = code.where("reason = 'unassigned'").drop("prompt")
    return logs.normalize_logs(math, code.where("reason <> 'unassigned'"), unassigned)


@query("union_question_logs", with_inputs("SELECT * FROM fx_logs", "logs"))
def union_question_logs(spark, folder):
    rows = _logs(spark, folder)
    return logs.union_question_logs(*[rows.where(F.coalesce("question_id", F.lit(0)) % 3 == i) for i in range(3)])


@query("fill_eventual_answer", with_inputs(f"""
WITH {ENDS} SELECT l.{RUN.replace(', ', ', l.')}, l.request_counter, l.reason,
       CASE WHEN coalesce(e.answer, '') = '' THEN '-1' ELSE e.answer END AS eventual_answer
FROM fx_logs l JOIN last_ends e ON {_same("l", "e", *logs.RUN)}""", "logs"))
def fill_eventual_answer(spark, folder):
    filled = logs.fill_eventual_answer(_logs(spark, folder))
    return filled.select(*logs.RUN, "request_counter", "reason", "eventual_answer")


FLAGS = f"""flags AS (SELECT *, reason NOT IN ('final', 'terminated') AND coalesce(lag(reason) OVER (
       PARTITION BY {RUN} ORDER BY request_counter, reason IN ('final', 'terminated')) = 'terminal_code_execution', false) AS training_flag FROM fx_logs)"""


@query("training_flag", with_inputs(f"WITH {FLAGS} SELECT {RUN}, request_counter, reason, training_flag FROM flags", "logs"))
def training_flag(spark, folder):
    return logs.training_flag(_logs(spark, folder).select(*logs.RUN, "request_counter", "reason"))


@query("attach_correct_answer", with_inputs(f"""
WITH {KNOWN} SELECT {RUN}, request_counter, coalesce(correct_answer, '') AS correct_answer
FROM fx_logs LEFT JOIN known USING (question_id)""", "logs", "log_problems"))
def attach_correct_answer(spark, folder):
    rows = _logs(spark, folder).select(*logs.RUN, "request_counter")
    return logs.attach_correct_answer(rows, read_input(spark, folder, "log_problems"))


@query("arrival_times", with_inputs(f"""
WITH {ENDS} SELECT e.question_id, e.method, e.generation_idx, e.defer_count, e.log_time + coalesce(p.log_time, 0) AS arrival
FROM ends e LEFT JOIN last_ends p ON {_same("p", "e", "question_id", "generation_idx")}
  AND p.defer_count = e.defer_count - 1 AND p.method <> e.method""", "logs"))
def arrival_times(spark, folder):
    return logs.arrival_times(_ends(spark, folder).select(*logs.RUN, "log_time"))


@query("sorted_logs", with_inputs(f"""
SELECT {RUN}, log_time, reason FROM fx_logs
ORDER BY question_id, generation_idx, defer_count, log_time NULLS LAST, method""", "logs"))
def sorted_logs(spark, folder):
    return logs.sorted_logs(_logs(spark, folder).select(*logs.RUN, "log_time", "reason"))


@query("generation_outcome", with_inputs(f"""
WITH {ENDS}, {KNOWN} SELECT method, defer_count, CASE WHEN coalesce(answer, '') = '' THEN 'none'
       WHEN coalesce(correct_answer, '') = '' THEN 'unknown' WHEN answer = correct_answer THEN 'right' ELSE 'wrong' END AS outcome, count(*) AS runs
FROM last_ends LEFT JOIN known USING (question_id) GROUP BY ALL""", "logs", "log_problems"))
def generation_outcome(spark, folder):
    return logs.generation_outcome(_ends(spark, folder), read_input(spark, folder, "log_problems"))


OUTPUTS = """outputs AS (SELECT 'generation_logs' AS output, * FROM fx_logs
  UNION ALL SELECT 'generation_logs_final', * FROM fx_logs WHERE reason = 'final'
  UNION ALL SELECT 'generation_logs_training', * FROM fx_logs WHERE flag_for_training)"""


@query("write_generation_logs", with_inputs(f"""
WITH {OUTPUTS} SELECT output, {RUN}, request_counter, log_time, reason, prompt, buffer FROM outputs""", "logs"))
def write_generation_logs(spark, folder):
    home = run_folder(spark, "logs")
    rows = _logs(spark, folder)
    log_files.write_generation_logs(rows, home)
    written = spark.read.schema(f"{rows.schema.toDDL()}, output string").parquet(home)
    return written.select("output", *logs.RUN, "request_counter", "log_time", "reason", "prompt", "buffer")


@query("archive_run_logs", with_inputs(f"WITH {OUTPUTS} SELECT 'run-1' AS run_id, * FROM outputs", "logs"))
def archive_run_logs(spark, folder):
    """A run is archived, another beside it, and the first once more."""
    rows = _logs(spark, folder)
    home, archive = run_folder(spark, "run"), run_folder(spark, "archive")
    log_files.write_generation_logs(rows, home)
    for run in ("run-1", "run-2", "run-1"):
        kept = log_files.archive_run_logs(spark, home, archive, run, rows.schema)
    return kept


# ---- Chunks -------------------------------------------------------------------------


@query("generation_counters", with_inputs(f"""
WITH {CHUNKS} SELECT generation_id, max(request_counter) AS last_request, count(DISTINCT request_counter) AS requests,
       count(*) AS chunks FROM chunks GROUP BY generation_id""", "turns"))
def generation_counters(spark, folder):
    return logs.generation_counters(_chunks(spark, folder))


@query("running_prompt", with_inputs("""
SELECT generation_id, request_counter, string_agg(text, '') OVER (PARTITION BY generation_id ORDER BY request_counter) AS prompt
FROM fx_turns""", "turns"))
def running_prompt(spark, folder):
    return logs.running_prompt(_chunks(spark, folder))


@query("throttled_checks", with_inputs("""
WITH times AS (SELECT DISTINCT question_id, arrival FROM fx_answers),
next AS (SELECT a.question_id, a.arrival, min(b.arrival) AS following FROM times a
         LEFT JOIN times b ON b.question_id IS NOT DISTINCT FROM a.question_id AND b.arrival >= a.arrival + 5 GROUP BY ALL),
kept AS (SELECT question_id, min(arrival) AS arrival FROM times GROUP BY question_id
         UNION ALL SELECT n.question_id, n.following FROM kept k
         JOIN next n ON n.question_id IS NOT DISTINCT FROM k.question_id AND n.arrival = k.arrival WHERE n.following IS NOT NULL)
SELECT * FROM kept""", "answers").replace("WITH", "WITH RECURSIVE", 1))
def throttled_checks(spark, folder):
    return throttle.throttled_checks(read_input(spark, folder, "answers"), "question_id", "arrival", 5)


# ---- Problems, prompts and budgets --------------------------------------------------


@query("scan_problems", with_inputs("SELECT id, CASE WHEN position % 9 = 4 THEN '' WHEN position % 9 <> 5 THEN problem END AS problem, "
                                    "answer FROM fx_problems", "problems"))
def scan_problems(spark, folder):
    """From a file of more columns in another order, with empty and missing texts."""
    path = run_folder(spark, "problems")
    rows = read_input(spark, folder, "problems")
    text = F.when(F.col("position") % 9 == 4, "").when(F.col("position") % 9 != 5, F.col("problem"))
    problems.write_csv(rows.select("answer", "position", text.alias("problem"), "id"), path)
    return problems.scan_problems(spark, path)


@query("scan_training_set", with_inputs("SELECT prompt, correct_answer FROM fx_training_logs", "training_logs"))
def scan_training_set(spark, folder):
    path = run_folder(spark, "training")
    rows = read_input(spark, folder, "training_logs")
    problems.write_csv(rows.select("question_id", "correct_answer", "eventual_answer", "prompt"), path)
    return problems.scan_training_set(spark, path)


@query("publish_questions", with_inputs("SELECT id, problem FROM fx_problems", "problems"))
def publish_questions(spark, folder):
    path = run_folder(spark, "questions")
    problems.publish_questions(read_input(spark, folder, "problems").select("id", "problem", "answer"), path)
    return problems.read_csv(spark, path, T.StructType(problems.PROBLEM_SCHEMA.fields[:2]))


@query("sample_problems", with_inputs("""
SELECT id, problem, answer FROM fx_problems ORDER BY md5(id || '-43'), id LIMIT 150""", "problems"))
def sample_problems(spark, folder):
    return logs.sample_problems(read_input(spark, folder, "problems").select("id", "problem", "answer"), limit=150)


@query("select_questions", with_inputs("""
SELECT id, CASE WHEN NOT (contains(problem, 'the') OR contains(problem, 'der')) THEN CAST(210 AS BIGINT) END AS preset_answer
FROM fx_problems""", "problems"))
def select_questions(spark, folder):
    rows = logs.select_questions(read_input(spark, folder, "problems"), ["the", "der"])
    return rows.select("id", "preset_answer")


CONTEXT = 1500


@query("context_limit_filter", with_inputs(
    f"SELECT position FROM fx_training_logs WHERE {TOKENS.format(c='prompt')} <= {CONTEXT} - 10", "training_logs"))
def context_limit_filter(spark, folder):
    rows = read_input(spark, folder, "training_logs")
    return curate.context_limit_filter(rows, limit=CONTEXT).select("position")


@query("length_filter", with_inputs(
    f"SELECT position FROM fx_training_logs WHERE {TOKENS.format(c='prompt')} < 3000 AND {TOKENS.format(c='buffer')} < 1000",
    "training_logs"))
def length_filter(spark, folder):
    rows = read_input(spark, folder, "training_logs")
    return curate.length_filter(rows, "prompt", "buffer").select("position")


def _literal(template: str, **values: str) -> str:
    """The template as a SQL concatenation."""
    text = template.replace("'", "''")
    for name, value in values.items():
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return "'" + text.replace("{{", "{").replace("}}", "}") + "'"


@query("prompt_templates", with_inputs(f"""
SELECT id, {_literal(prompts.CODE_PROMPT, question='problem')} AS code_prompt,
       {_literal(prompts.OUTPUT_BRIDGE, code_output="CAST(answer AS VARCHAR)")} AS output_bridge,
       {_literal(prompts.MATH_PROMPT, question='problem')} AS math_prompt, {_literal(prompts.MATH_BRIDGE)} AS math_bridge
FROM fx_problems""", "problems"))
def prompt_templates(spark, folder):
    rows = read_input(spark, folder, "problems").select(
        "id", F.col("problem").alias("question"), F.col("answer").cast("string").alias("code_output")
    )
    return prompts.prompt_templates(rows).drop("question", "code_output")


@query("handover_prompts", with_inputs(f"""
WITH {ENDS}, own AS (SELECT *, {SECTIONS.format(c='prompt')} AS sections FROM last_ends WHERE defer_count = 0)
SELECT o.question_id, o.generation_idx, o.method, o.answer, n.method AS to_method, n.answer AS to_answer,
       'Question ' || coalesce(CAST(o.question_id AS VARCHAR), '') || CASE WHEN o.method = 'code' THEN
         CASE WHEN sections <> '' THEN {_literal(prompts.SECTIONS_LEAD)} || sections ELSE '' END
         || CASE WHEN o.answer <> '' THEN {_literal(prompts.HINT_LEAD)} || o.answer || {_literal(prompts.MATH_CHECK)} ELSE '' END
       ELSE CASE WHEN o.buffer <> '' THEN {_literal(prompts.THOUGHTS_LEAD)} || o.buffer || {_literal(prompts.THOUGHTS_END)} ELSE '' END
         || CASE WHEN o.answer <> '' THEN {_literal(prompts.HINT_LEAD)} || o.answer || {_literal(prompts.CODE_CHECK)} ELSE '' END
       END AS handover
FROM own o LEFT JOIN last_ends n ON {_same("n", "o", "question_id", "generation_idx")} AND n.defer_count = 1
""", "logs"))
def handover_prompts(spark, folder):
    ends = logs.last_ends(_ends(spark, folder), "prompt", "buffer", "answer")
    return prompts.handover_prompts(ends.withColumn("question", F.concat(F.lit("Question "), F.coalesce(F.col("question_id").cast("string"), F.lit("")))))


START = 1_700_000_000


def _numbered(spark, folder):
    return read_input(spark, folder, "problems").select("id", (F.col("position") + 1).alias("idx"))


@query("budget_schedule", with_inputs(f"""
SELECT id, idx, CAST(trunc({START} + 240 + idx * (17100 - 240) / n) AS BIGINT) AS deadline,
       CAST(trunc({START} + 240 + idx * (n * 360 - 240) / n) AS BIGINT) AS batch_deadline
FROM (SELECT id, position + 1 AS idx FROM fx_problems), (SELECT CAST(count(*) AS DOUBLE) AS n FROM fx_problems)""", "problems"))
def budget_schedule(spark, folder):
    rows = _numbered(spark, folder)
    count = rows.agg(F.count("*").cast("double")).scalar()
    fixed = budget.budget_schedule(rows, START, count)
    batch = budget.budget_schedule(fixed.withColumnRenamed("deadline", "fixed"), START, count, budget.batch_budget(count))
    return batch.select("id", "idx", F.col("fixed").alias("deadline"), F.col("deadline").alias("batch_deadline"))


@query("deadline_default", with_inputs(f"""
SELECT id, idx * 20 + {START} AS started, CASE WHEN idx * 20 > 17100 THEN CAST(210 AS BIGINT) END AS answer
FROM (SELECT id, position + 1 AS idx FROM fx_problems)""", "problems"))
def deadline_default(spark, folder):
    rows = _numbered(spark, folder).select("id", (F.col("idx") * 20 + START).alias("started"))
    return budget.deadline_default(rows, START + budget.TOTAL)


# ---- Curation -----------------------------------------------------------------------

LABELLED = f"""
spans AS (SELECT *, string_split(buffer, '```python')[1] AS completion FROM fx_training_logs WHERE flag_for_training),
eligible AS (SELECT *, CASE WHEN eventual_answer IN ('-1', '') OR correct_answer = '' THEN NULL
                            WHEN eventual_answer = correct_answer THEN 'right' ELSE 'wrong' END AS label
             FROM spans WHERE {TOKENS.format(c='prompt')} < 3000 AND {TOKENS.format(c='completion')} < 1000),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id, label ORDER BY position) AS pair
           FROM eligible WHERE label IS NOT NULL),
paired AS (SELECT w.question_id, w.pair, w.position AS wrong_position, r.position AS right_position
           FROM placed w JOIN placed r ON r.question_id = w.question_id AND r.pair = w.pair
           WHERE w.label = 'wrong' AND r.label = 'right')
"""


def _labelled(spark, folder):
    return curate.eligible_rows(read_input(spark, folder, "training_logs"))


@query("pair_right_wrong", with_inputs(f"WITH {LABELLED} SELECT * FROM paired WHERE pair = 1", "training_logs"))
def pair_right_wrong(spark, folder):
    return curate.pair_right_wrong(_labelled(spark, folder))


@query("pair_right_wrong_all", with_inputs(f"WITH {LABELLED} SELECT * FROM paired", "training_logs"))
def pair_right_wrong_all(spark, folder):
    return curate.pair_right_wrong(_labelled(spark, folder), all_pairs=True)


FROM_LOGS = f"""
{FLAGS}, {ENDS}, {KNOWN},
filled AS (SELECT f.position, f.question_id, f.prompt, f.buffer, f.training_flag, CASE WHEN coalesce(e.answer, '') = '' THEN '-1' ELSE e.answer END AS eventual,
                  coalesce(k.correct_answer, '') AS correct_answer, string_split(f.buffer, '```python')[1] AS completion
           FROM flags f JOIN last_ends e ON {_same("f", "e", *logs.RUN)} LEFT JOIN known k ON k.question_id = f.question_id),
eligible AS (SELECT *, CASE WHEN eventual = correct_answer THEN 'right' ELSE 'wrong' END AS label FROM filled
             WHERE training_flag AND eventual <> '-1' AND correct_answer <> ''
               AND {TOKENS.format(c='prompt')} < 90 AND {TOKENS.format(c='completion')} < 25),
firsts AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY question_id, label ORDER BY position) = 1)
"""


@query("training_set", with_inputs(f"""
WITH {FROM_LOGS} SELECT position, question_id, label, prompt, completion, correct_answer FROM firsts
QUALIFY count(*) OVER (PARTITION BY question_id) = 2 ORDER BY position""", "logs", "log_problems"))
def training_set(spark, folder):
    """From raw logs: flag, run's answer, known answer, completion, token limits, pairs, order."""
    records = curate.answered(_logs(spark, folder), read_input(spark, folder, "log_problems"))
    return curate.training_set(records, max_input=90, max_output=25)


@query("sequential_order", with_inputs("SELECT position, prompt, correct_answer FROM fx_training_logs ORDER BY position", "training_logs"))
def sequential_order(spark, folder):
    rows = read_input(spark, folder, "training_logs").select("position", "prompt", "correct_answer")
    return curate.sequential_order(rows)
