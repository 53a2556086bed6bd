import corpus_pipeline
from helpers import awkward, documents, prose

import __spark_entry__
from tallywork.llm import language_mix, mixing, queries


def folder(spark, tmp_path, rows, items):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_each_stage_does_its_part_and_keeps_the_rest(spark, tmp_path):
    passage, secret = prose(77, 15), "token = 0123456789abcdef0123456789abcdef"
    clean = [(i, prose(i, 80), "en", f"src{i % 10}") for i in range(100, 160)]
    copies = [(1000 + i, prose(5000, 120) + (f" extra{i}" if i % 2 else ""), "en", "src1") for i in range(8)]
    two = prose(78, 20).split()
    # Cutting the passage in the middle brings the ends of another one together.
    twice = f"{prose(5, 30)}. {' '.join(two[:10])} {passage} {' '.join(two[10:])} {prose(6, 30)}"
    leaks = [(2002, twice, "en", "src2"), (2000, f"{prose(1, 30)}. {passage.upper()}. {prose(2, 30)}", "en", "src2"), (2001, passage, "en", "src2")]
    rows = [*clean, *copies, *leaks, (3000, f"{prose(3, 40)} {secret} {prose(4, 40)}", "en", "src3"), (4000, "123 ...", "en", "src4"), (4001, None, None, None),
            (4002, "½ ² ①", "en", "src4"), (4003, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 3, None, "src4"), (4004, "qxzkv wpt xqj vbnq mzx kqw plx zzq xkcd qwv " * 5, None, "src4")]
    home = folder(spark, tmp_path, rows, [(1, passage), (2, " ".join(two))])
    docs = spark.read.parquet(f"{home}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, home), name)
        seen.append({r.doc_id: r for r in docs.collect()})
        if name != "mixture":
            assert docs.schema == before.schema
            assert all(r.n_chars == len(r.text) for r in seen[-1].values())
    languages, near, passages, secrets, mixture = seen
    assert languages.keys() == texts.keys() - {4000, 4001, 4002, 4003, 4004}
    assert near.keys() == languages.keys() - {i for i, *_ in copies[1:]}
    assert passages.keys() == near.keys() - {2001} and passage.lower() not in passages[2000].text.lower()
    assert not any(" ".join(two[i : i + 10]) in passages[2002].text.replace("\n", " ") for i in range(11))
    assert secrets[3000].text == texts[3000].replace(secret, "[SECRET]")
    assert all(secrets[i].text == t for i, t, *_ in clean)
    assert mixture.keys() <= secrets.keys() and 0 < len(mixture)
    assert docs.columns == [*before.columns, "_epoch"]  # the test's rows have a column epoch


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    for name, rows, items in (("awkward", awkward(spark), [(None, None), (1, "")]), ("empty", [], [])):
        home = folder(spark, tmp_path / name, rows, items)
        out = corpus_pipeline.run(spark, home)
        rows_out = out.collect()
        assert {r.doc_id for r in rows_out} <= {r[0] for r in rows if r[1] and any(map(str.isalpha, r[1]))}
        assert bool(rows_out) == bool(rows) and all(r.n_chars == len(r.text) for r in rows_out)
        # Of the rows of one id either all are read in an epoch or none; linked ones with a greater id are gone.
        assert sum(r.doc_id == 5 and r["_epoch"] == 0 for r in rows_out) in (0, 2) and all(r.doc_id not in (6, None) for r in rows_out)


def test_entry_registers_all(spark):
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_wrong_labels_hardly_matter(spark):
    """The given documents: accuracy on the fold that was not learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.QUERIES["op2_language_mix"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, total = found.selectExpr("count_if(lang_pred = lang)", "count(*)").first()
    assert total > 200 and right >= 0.98 * total
    assert docs.where(language_mix.held_out()).count() == total


def test_oracle_mixture_constants_reach_both(spark):
    assert str(queries.SHARE) in queries.MIXING_SQL and mixing.BUCKET_DIGITS == 3
