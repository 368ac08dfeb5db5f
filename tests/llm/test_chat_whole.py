"""Chat records that are very long, or hold fields of more than one layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import chat


def test_very_long_turn_keeps_its_conversation(spark, tmp_path):
    turn = F.when(F.col("id") == 1, F.repeat(F.lit("x"), F.lit(24_000_000))).otherwise("a")
    texts = spark.range(3).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 1, "assistant").otherwise("user").alias("role"), turn.alias("text"))
    texts.write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op3_chat(spark, str(tmp_path)).where("conv_id = 1").first()
    assert (got["mapping"], got["n_turns"], got["loss_chars"]) == ("messages", 3, 24_000_000)


def test_loss_is_what_the_mask_cuts_out(spark):
    turns = [("user" if k % 2 else "assistant", f"t{k} \\ <| é😀 {'x' * (k % 7)}") for k in range(9_000)]
    df = spark.createDataFrame([(1, turns), (2, [("user", "q")]), (3, [])], "k int, t array<struct<role: string, content: string>>")
    found = chat.format_chat(df.select("k", F.struct(F.col("t").alias("messages")).alias("r")), "r")
    got = {r["k"]: r["l"] for r in found.withColumn("l", chat.under_mask("formatted", "loss_spans")).collect()}
    assert got == {1: [t for r, t in turns if r == "assistant"], 2: [], 3: []}
    wrong = found.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"))))
    assert wrong.where("k = 1").withColumn("l", chat.under_mask("formatted", "loss_spans")).first()["l"][0] == turns[0][1][1:]


def test_structs_of_other_layouts(spark):
    df = spark.createDataFrame([("s", [("human", "q"), ("gpt", "a")], 7), (None, None, 8)], "system string, conversations array<struct<`from`: string, value: string>>, label int")
    rows = chat.format_chat(df.withColumn("r", F.struct(*df.columns)), "r").withColumn("b", chat.read_back(F.col("formatted"))).orderBy("label").collect()
    assert [(r["mapping"], [(t["role"], t["text"]) for t in r["b"]]) for r in rows] == [("from_value", [("system", "s"), ("user", "q"), ("assistant", "a")]), (None, [])]


def test_records_of_mixed_layouts(spark):
    turns = '"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]'
    spoken = '"dialogue": [{"speaker": "human", "text": "q"}, {"speaker": "bot", "text": "a"}]'
    plain, led = [("user", "q"), ("assistant", "a")], [("system", "s"), ("user", "q"), ("assistant", "a")]
    records = [
        (f'{{"prompt": "p", {turns}}}', "messages", plain), (f'{{"system": "s", {turns}}}', "messages", led), (f'{{{turns}, "input": "i"}}', "messages", plain),
        (f'{{{spoken}, "system": "s"}}', "speaker_text", led), (f'{{{spoken}, {turns}, "system": "s", "output": "o"}}', "messages", led),
        ('{"prompt": "q", "completion": "a", "context": "c", "system": "s"}', "prompt_completion", led), ('{"prompt": "q", "messages": []}', None, []),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(records)], "k int, r string")
    found = chat.format_chat(df, "r").withColumn("b", chat.read_back(F.col("formatted"))).orderBy("k").collect()
    assert [(r["mapping"], [(t["role"], t["text"]) for t in r["b"]]) for r in found] == [x[1:] for x in records]
    assert all("".join(r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]) == "".join(t for role, t in x[2] if role == "assistant") for r, x in zip(found, records, strict=True))
