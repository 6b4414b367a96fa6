"""Chats: round trips, ties, attachments and odd rows."""

import hashlib

from pyspark.sql import functions as F

from marginalia.llm import chat, queries


def test_chats_are_reversible(spark):
    said = "</s>[INST] ok \\l [/INST]<|turn|>x<|end|>\\\\b"
    parts = [("text", said, None, None), ("image", None, "a<b.png", None), ("text", None, None, None), ("audio", None, "c.wav", 7), ("document", None, None, None)]
    turns = spark.createDataFrame([(1, 1, "assistant", parts), (1, 0, "us<|er", [("text", "hi", None, None)]), (1, None, None, None), (2, 0, "assistant", [("text", "", None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = chat.format_chats(turns).persist()
    one = made.where("conv_id = 1").first()
    assert [a["n_tokens"] for a in one["attachments"]] == [256, 7, 512] and one["n_media_tokens"] == 775 and one["n_turns"] == 3
    back = chat.read_back(made).where("conv_id = 1").first()
    assert [t["role"] for t in back["turns"]] == ["", "us<|er", "assistant"]
    assert back["learned"][0].startswith(said) and back["turns"][1]["text"] == "hi"
    plain = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", said)], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text"))))
    assert chat.read_back(plain).first()["learned"] == [said]


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))


def _said(spark, rows):
    back = chat.read_back(chat.format_chats(_turns(spark, rows))).collect()
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}


def test_ties_are_in_the_order_of_their_texts(spark):
    texts = ["a!", "a", "a<", "a=", "a\\", "a]", "a[", "", "a", None, "a;"]
    got = _said(spark, [(1, 0, "user", t) for t in texts] + [(1, 0, "assistant", "z"), (1, None, "user", "first")])
    assert got == {1: [("user", "first"), ("assistant", "z"), *(("user", t) for t in sorted((t or "" for t in texts), key=lambda t: t.encode()))]}


def test_turns_in_any_number_of_blocks(spark):
    rows = [(2, k, "user" if k % 2 == 0 else "assistant", f"<|turn|> {k}") for k in range(200)] + [(3, 1 << 40, "user", "far"), (3, -5, "user", "before")]
    got = _said(spark, rows[::-1])
    assert got == {2: [(r, t) for _, _, r, t in rows[:200]], 3: [("user", "before"), ("user", "far")]}


def test_the_query_matches_plain_python(spark):
    path = "/root/testdata/sf0.01"
    said = {}
    for r in queries.table(spark, path, "conversations").collect():
        said.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op4_chat_format(spark, path).collect()}
    assert got.keys() == said.keys()
    for conv_id, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        one = got[conv_id]
        assert one["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (one["n_turns"], one["loss_chars"], one["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, None, None, None), (2, 0, "assistant", "long " * 100_000)]
    made = chat.format_chats(_turns(spark, rows).withColumn("seen", F.lit(1)).withColumn("ts", F.lit(2)).withColumn("block", F.lit(3)).withColumn("formatted", F.lit(4)))
    got = {r["conv_id"]: r for r in made.collect()}
    assert got[1]["n_turns"] == 2 and got[None]["n_turns"] == 1 and len(got[2]["formatted"]) > 500_000
    assert chat.format_chats(_turns(spark, [])).count() == 0
