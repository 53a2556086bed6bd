import pytest
from pyspark.sql import types as T

from tallywork import session
from tallywork.session import run_folder, shared_folder
from tallywork.sources import log_files, problems

CSV_TEXT = '"id","problem","answer"\n"012345","one, ""two""",7\n"ab12cd"," line\n\nbreak\\text ",250\n"999999","",0\n'


def test_scan_keeps_ids_breaks_and_spaces(spark, tmp_path):
    path = tmp_path / "problems.csv"
    path.write_text(CSV_TEXT, encoding="utf-8")
    got = [tuple(r) for r in problems.scan_problems(spark, str(path)).collect()]
    assert got[0] == ("012345", 'one, "two"', 7)
    assert got[1] == ("ab12cd", " line\n\nbreak\\text ", 250)
    assert got[2][0] == "999999" and got[2][2] == 0 and len(got) == 3


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text('answer,note,problem,id\n7,x,"p, 1",1\n,y,,2\n\\N,z,"",3\n', encoding="utf-8")
    got = [tuple(r) for r in problems.scan_problems(spark, str(path)).collect()]
    assert got == [("1", "p, 1", 7), ("2", None, None), ("3", "", None)]
    path = tmp_path / "swapped.csv"
    path.write_text("question,prompt,correct_answer\nq1,p1,5\n", encoding="utf-8")
    assert [tuple(r) for r in problems.scan_training_set(spark, str(path)).collect()] == [("p1", "5")]


def test_missing_columns_and_bad_values_are_errors(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("id,problem\n1,p\n", encoding="utf-8")
    with pytest.raises(ValueError, match="answer"):
        problems.scan_problems(spark, str(path))
    path = tmp_path / "bad.csv"
    path.write_text("id,problem,answer\n1,p,seven\n", encoding="utf-8")
    with pytest.raises(Exception, match="seven"):
        problems.scan_problems(spark, str(path)).collect()
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("id,problem,answer\n1,p,7\n", encoding="utf-8")
    (folder / "b.csv").write_text("problem,id,answer\np,2,8\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        problems.scan_problems(spark, str(folder)).collect()


def test_texts_come_back_as_they_were(spark):
    texts = ["", None, " ", "a,b", 'q"q', '"', "x\r\ny", "\n", "\\", "\\n", "é\u2028", "null", "\t tab "]
    rows = [(str(i), t, i) for i, t in enumerate(texts)]
    path = run_folder(spark, "texts")
    problems.write_csv(spark.createDataFrame(rows, problems.PROBLEM_SCHEMA).coalesce(1), path)
    assert sorted(map(tuple, problems.scan_problems(spark, path).collect()), key=lambda r: r[2]) == rows


def test_publish_drops_the_answer(spark):
    rows = [("1", 'a "b"\nc', 3), ("2", "é, \\frac{1}{2}", 4)]
    path = run_folder(spark, "published")
    problems.publish_questions(spark.createDataFrame(rows, problems.PROBLEM_SCHEMA), path)
    got = problems.read_csv(spark, path, T.StructType(problems.PROBLEM_SCHEMA.fields[:2]))
    assert sorted(map(tuple, got.collect())) == [r[:2] for r in rows]
    assert spark.read.text(path).first()[0] == "id,problem"


def test_archive_of_runs(spark):
    schema = "question_id bigint, method string, generation_idx bigint, defer_count bigint, log_time double, reason string, flag_for_training boolean"
    archive = run_folder(spark, "archive")
    for run, n in (("r1", 2), ("r2", 3), ("r1", 2)):
        rows = [(q, "code", 1, 0, float(q), "final" if q else "stop_token", q == 0) for q in range(n)]
        df = spark.createDataFrame(rows, schema)
        folder = run_folder(spark, "run")
        paths = log_files.write_generation_logs(df, folder)
        kept = log_files.archive_run_logs(spark, folder, archive, run, df.schema)
        counts = {r.output: r["count"] for r in kept.groupBy("output").count().collect()}
        assert counts == {"generation_logs": n, "generation_logs_final": n - 1, "generation_logs_training": 1}
    assert spark.read.parquet(archive).count() == 2 * (2 + 3)
    log_files.write_csv_outputs(spark, folder, {"generation_logs_final": paths["generation_logs_final"]}, df.schema)
    assert problems.read_csv(spark, f"{folder}/generation_logs_final.csv", df.schema).collect()[0].reason == "final"


def test_outputs_are_sorted(spark):
    rows = [(q % 7, "code", q % 3, 0, float(q % 11), "final", False) for q in range(200)]
    df = spark.createDataFrame(rows, "question_id bigint, method string, generation_idx bigint, defer_count bigint, log_time double, reason string, flag_for_training boolean")
    paths = log_files.write_generation_logs(df.repartition(5), run_folder(spark, "sorted"))
    order = ["question_id", "generation_idx", "defer_count", "log_time", "method"]
    got = [tuple(r[c] for c in order) for r in spark.read.parquet(paths["generation_logs_final"]).collect()]
    assert got == sorted(got) and len(got) == 200


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_intermediates_can_be_removed(spark):
    path = run_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = session._made[:-1]
    session._made[:] = [path]
    try:
        assert session.remove_run_folders(spark) == 1
    finally:
        session._made[:] = kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
