import hashlib

from tessera.llm import chat

PIECES = ["</s>", "[INST]", "[/INST]", "<s>[INST]", "<s\\>[INST]", "\\", "\\l", "\\b", "<", "[", "é🙂", "\n", " ", "word"]


def test_round_trip_of_hard_texts(spark, rng):
    rows, want = [], {}
    for c in range(150):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "[/INST]odd</s>", ""])
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 9)))
            rows.append((c, t, role or None, text or None, "x"))
            want.setdefault(c, []).append((role, text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    back = chat.recovered(chat.format_chats(df)).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == want
    for r in back:
        assert r.loss_text == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        plain = "".join(f"<s>[INST]{role}[/INST]{x}</s>" for role, x in want[r.conv_id])
        clean = not any("</s>" in role + x or "[/INST]" in role for role, x in want[r.conv_id])
        assert (r.formatted == plain) == clean


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: r for r in chat.recovered(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [t.text for t in got[1].turns] == ["a", "a", "b"]
    assert len(got[2].loss_text) == 300_000


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = chat.op2_chat_format(spark, str(tmp_path)).collect()
    probe = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, len(probe))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()
