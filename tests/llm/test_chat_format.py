import hashlib

from pyspark.sql import functions as F

from tallywork.llm import chat_format


def chats(spark, rows, **options):
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, key long, said string, loss int")
    return chat_format.formatted(messages.withColumn("parts", chat_format.text_parts(F.col("text"))), **options)


CONTROLS = [
    "</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>\n", "<\\|end|>", "\\", "\\\\", "<\\", "[\\[<<\\\\", "a\\[b\\<c\\\\d", "<|image|>", "\n\n", "é\U0001f600", "$1\\2",
]


def test_round_trip_order_and_mask(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROLS)]
    rows += [(2, 3, "assistant", "b"), (2, 1, None, None), (2, None, "system", "first"), (2, 3, "assistant", "a"), (None, 1, "assistant", "lost"), (3, 1, "assistant", "x" * 50_000)]
    rows += [(4, 1, "ro<|says|>le", "t"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]
    out = chats(spark, [(*r, "f", 1, "s", 2) for r in rows])
    read = {r.conv_id: r for r in out.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.under_mask(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    expected = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c), key=lambda x: x)
        expected[c] = [(x[2], x[3]) for x in turns]
    for c, turns in expected.items():
        assert [(t.role, t.text) for t in read[c].back] == turns
        assert read[c].n_turns == len(turns)
        assert read[c].trained == "".join(t for r, t in turns if r == "assistant")
        for s in read[c].loss:
            assert read[c].formatted[s.end : s.end + 7] == "<|end|>" and read[c].formatted[: s.start].endswith("assistant<|says|>")
    assert "[INST]" not in read[1].formatted and "</s>" not in read[1].formatted
    assert read[1].formatted.count("<|turn|>") == len(CONTROLS)


def test_parts_become_placeholders_in_order(spark):
    rows = [(1, 0, "user", [
        ("text", "see <", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("text", " and ", None, None, None, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None),
        (None, "x", "e", None, None, None, None), ("image", None, None, None, None, None, None),
    ]), (1, 1, "assistant", None), (1, 2, "assistant", [])]
    messages = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.formatted(messages).first()
    assert r.formatted == (
        "<|turn|>user<|says|>see <\\<|image|> and <|audio|><|document|><|part|><|part|><|image|><|end|>\n"
        "<|turn|>assistant<|says|><|end|>\n<|turn|>assistant<|says|><|end|>\n"
    )
    assert [tuple(a) for a in r.attachments] == [
        (1, "image", "a.png", 4), (1, "audio", "b.wav", 38), (1, "document", "c.pdf", 1536), (1, "video", "d", 0), (1, None, "e", 0), (1, "image", None, 0),
    ]
    assert [s.end - s.start for s in r.loss] == [0, 0]


def test_empty_table_and_python_free_plan(spark):
    out = chats(spark, [])
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_digest_of_one_turn(spark):
    out = chats(spark, [(1, 0, "user", "hi", "", 0, "", 0)])
    back = out.select(chat_format.read_back(F.col("formatted")).alias("t")).first().t
    assert hashlib.sha256(f"{back[0].role}\n{back[0].text}\n".encode()).hexdigest() == hashlib.sha256(b"user\nhi\n").hexdigest()
