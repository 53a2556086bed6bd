"""Votes, early stop and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.functions.answers import answer_value, floor_mod, is_valid_answer
from tallywork.operators import budget, votes
from tallywork.plans.inputs import read_input, with_inputs
from tallywork.plans.registry import query

DEADLINE = 210

# Answers with their whole-number value, NULL if invalid: digits that a double gives back.
VALUED = """
valued AS (
  SELECT * EXCLUDE (ok, num), CASE WHEN ok AND format('{:.0f}', abs(TRY_CAST(num AS DOUBLE))) = ltrim(replace(num, '-', ''), '0') OR ok AND num SIMILAR TO '-?0+'
                                   THEN CAST(num AS BIGNUM) END AS v
  FROM (SELECT *, regexp_full_match(trim(answer), '[+-]?[0-9](_?[0-9])*') AS ok, replace(replace(trim(answer), '_', ''), '+', '') AS num FROM fx_answers)),
counted AS (SELECT question_id, v, count(*) AS c FROM valued GROUP BY ALL),
freq AS (SELECT question_id, v, CASE WHEN v IS NULL THEN 0 WHEN v = 0 THEN (c + 1) // 2 ELSE c END AS f FROM counted),
ranked AS (SELECT question_id, v, CASE WHEN v = 0 THEN c ELSE 2 * c END AS w,
                  row_number() OVER (PARTITION BY question_id
                    ORDER BY v IS NULL, CASE WHEN v = 0 THEN c ELSE 2 * c END DESC, v DESC) AS rn FROM counted)
"""
# A value's last digits, with its sign, give the modulo.
FLOOR_MOD = "CAST((CAST(right(replace(CAST({c} AS VARCHAR), '-', ''), 3) AS BIGINT) * CASE WHEN {c} < 0 THEN -1 ELSE 1 END + 1000) % 1000 AS BIGINT)"
TOP3 = """
top3 AS (SELECT question_id, coalesce(l[1], 0) AS highest, coalesce(l[2], 0) AS second, coalesce(l[3], 0) AS third
         FROM (SELECT question_id, list_reverse_sort(list(f)) AS l FROM freq GROUP BY question_id))
"""


def _rule(h: str, s: str, t: str) -> str:
    return f"(({h} >= 2 AND {s} <= 0 AND {t} <= 0) OR ({h} >= 3 AND {s} <= 1) OR ({h} >= 4 AND {s} <= 3) OR {h} >= 5)"


def _sql(body: str, *more: str) -> str:
    inputs = ("answers", "questions") if STOPS in more else ("answers",)
    return with_inputs(f"WITH {VALUED}{''.join(', ' + m for m in more)} {body}", *inputs)


def deadlines(questions):
    """Questions with a deadline each, in seconds since the start."""
    return budget.budget_schedule(questions.withColumn("idx", F.coalesce("question_id", F.lit(0)) % SCHEDULE["count"] + 1), **SCHEDULE)


# A deadline for each question, from a schedule of the length of these arrivals.
SCHEDULE = {"start": 0, "count": 37, "total": 400, "loading": 20}
STOPS = f"""
asked AS (SELECT question_id, CAST(trunc(20 + (coalesce(question_id, 0) % 37 + 1) * (400 - 20) / 37e0) AS BIGINT) // 20 + 1 AS final FROM fx_questions),
ticks AS (SELECT question_id, final, CAST(unnest(generate_series(1, final)) AS BIGINT) AS t FROM asked),
seen AS (SELECT k.question_id, k.final, k.t, x.method, x.v FROM ticks k
         LEFT JOIN valued x ON x.question_id IS NOT DISTINCT FROM k.question_id AND x.arrival <= 20 * k.t),
totals AS (SELECT question_id, final, t, count(method) AS n, count(*) FILTER (method = 'math') AS m FROM seen GROUP BY ALL),
by_value AS (SELECT question_id, t, v, count(*) AS c, count(*) FILTER (method = 'math') AS cm FROM seen
             WHERE v IS NOT NULL GROUP BY ALL),
by_tick AS (SELECT question_id, t,
              list_reverse_sort(list(CASE WHEN v = 0 THEN (c + 1) // 2 ELSE c END)) || [0, 0, 0] AS fa,
              list_reverse_sort(list(CASE WHEN v = 0 THEN (cm + 1) // 2 ELSE cm END)) || [0, 0, 0] AS fm,
              max(ROW(CASE WHEN v = 0 THEN c ELSE 2 * c END, v)) AS best FROM by_value GROUP BY ALL),
judged AS (SELECT o.question_id, o.t, b.best[2] AS v,
             CASE WHEN b.t IS NOT NULL AND {_rule('fm[1]', 'fm[2]', 'fm[3]')} THEN 'math_agrees'
                  WHEN b.t IS NOT NULL AND {_rule('fa[1]', 'fa[2]', 'fa[3]')} THEN 'all_agree'
                  WHEN n = 16 THEN 'all_in' WHEN m >= 4 THEN 'enough_math'
                  WHEN o.t = final THEN 'deadline' END AS reason
           FROM totals o LEFT JOIN by_tick b ON b.question_id IS NOT DISTINCT FROM o.question_id AND b.t = o.t),
stops AS (SELECT question_id, t AS tick, reason, coalesce({FLOOR_MOD.format(c="v")}, 210) AS answer
          FROM judged WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY t) = 1)
"""


@query("majority_answer", _sql(f"SELECT question_id, {FLOOR_MOD.format(c='v')} AS answer FROM ranked WHERE rn = 1"))
def majority_answer(spark, folder):
    return votes.majority_answer(read_input(spark, folder, "answers"))


@query("top_vote", _sql("""
SELECT question_id, CASE WHEN v IS NOT NULL THEN w END AS weight, CAST(v AS VARCHAR) AS value FROM ranked WHERE rn = 1"""))
def top_vote(spark, folder):
    return votes.top_vote(read_input(spark, folder, "answers"))


@query("vote_frequencies", _sql("SELECT * FROM top3", TOP3))
def vote_frequencies(spark, folder):
    return votes.vote_frequencies(read_input(spark, folder, "answers"))


@query("top3_frequencies", _sql("""
SELECT question_id, CAST(v AS VARCHAR) AS value, f AS frequency, row_number() OVER (PARTITION BY question_id ORDER BY f DESC, v DESC NULLS LAST) AS place
FROM freq QUALIFY place <= 3"""))
def top3_frequencies(spark, folder):
    return votes.top_frequencies(read_input(spark, folder, "answers")).withColumn("place", F.col("place").cast("bigint"))


@query("early_answer", _sql(f"SELECT question_id, {_rule('highest', 'second', 'third')} AS stop FROM top3", TOP3))
def early_answer(spark, folder):
    return votes.early_answer(read_input(spark, folder, "answers"))


@query("poll_snapshots", with_inputs(f"""
SELECT question_id, t AS tick, method, answer, count(*) AS arrived
FROM fx_answers, (SELECT CAST(t AS BIGINT) AS t FROM generate_series(1, {DEADLINE // 20 + 1}) AS g(t))
WHERE arrival <= 20 * t GROUP BY ALL""", "answers"))
def poll_snapshots(spark, folder):
    return votes.poll_snapshots(read_input(spark, folder, "answers"), DEADLINE)


@query("early_stop_tick", _sql("SELECT * FROM stops", STOPS))
def early_stop_tick(spark, folder):
    return votes.early_stop_tick(deadlines(read_input(spark, folder, "questions")), read_input(spark, folder, "answers"))


@query("results_by_method", with_inputs("""
SELECT question_id, method, arrival, generation_id, answer,
       row_number() OVER (PARTITION BY question_id, method ORDER BY arrival NULLS FIRST, generation_id) AS position
FROM fx_arrivals""", "arrivals"))
def results_by_method(spark, folder):
    return votes.results_by_method(read_input(spark, folder, "arrivals"))


@query("union_methods", with_inputs("""
SELECT * FROM fx_answers WHERE method = 'math' UNION ALL SELECT * FROM fx_answers WHERE method = 'code'""", "answers"))
def union_methods(spark, folder):
    answers = read_input(spark, folder, "answers")
    return votes.union_methods(answers.where("method = 'math'"), answers.where("method = 'code'"))


@query("predict_table", with_inputs(f"""
WITH {VALUED} SELECT q.question_id, coalesce({FLOOR_MOD.format(c="v")}, 210) AS answer
FROM fx_questions q LEFT JOIN ranked r ON r.question_id IS NOT DISTINCT FROM q.question_id AND rn = 1""", "answers", "questions"))
def predict_table(spark, folder):
    return votes.predict_table(read_input(spark, folder, "questions"), read_input(spark, folder, "answers"))


@query("valid_answer_filter", _sql("SELECT question_id, generation_id, answer, CAST(v AS VARCHAR) AS value FROM valued WHERE v IS NOT NULL"))
def valid_answer_filter(spark, folder):
    answers = read_input(spark, folder, "answers").where(is_valid_answer("answer"))
    return answers.select("question_id", "generation_id", "answer", answer_value("answer").alias("value"))


@query("mod_1000", _sql(f"""
SELECT generation_id, CAST(v AS VARCHAR) AS value, {FLOOR_MOD.format(c='v')} AS answer FROM valued WHERE v IS NOT NULL"""))
def mod_1000(spark, folder):
    valued = read_input(spark, folder, "answers").select("generation_id", answer_value("answer").alias("value"))
    return valued.where("value IS NOT NULL").select("*", floor_mod("value").alias("answer"))


@query("late_results", _sql("""
SELECT a.question_id, generation_id, method, arrival, a.answer, coalesce(arrival > 20 * tick, false) AS late,
       CASE WHEN arrival > 20 * tick AND method = 'code' THEN 'terminated' ELSE 'final' END AS reason
FROM valued a LEFT JOIN stops s ON s.question_id IS NOT DISTINCT FROM a.question_id""", STOPS))
def late_results(spark, folder):
    answers = read_input(spark, folder, "answers")
    closes = votes.early_stop_tick(deadlines(read_input(spark, folder, "questions")), answers).select("question_id", (F.col("tick") * 20).alias("closed_at"))
    return votes.late_results(answers, closes)
