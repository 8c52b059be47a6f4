import hashlib

from pyspark.sql import functions as F

from loomstat.llm import chat as C


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a\\", "\\<|", "<|", "<<||", "", None,
        "line\nline\n", "tab\tend<|image:1|>", "\r\n\r", "漢字 𝒳"]


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "us\\er\n<|im_start|>", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, "x"), (None, 0, "assistant", "y"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    back = {r.conv_id: r for r in C.read_back(C.format_chat(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t or "") for _, _, r, t in rows[:len(HARD)]]
    assert back[1].loss_texts == [t or "" for i, t in enumerate(HARD) if i % 2]
    assert back[1].formatted.count(C.END) == len(HARD)
    assert [(t.role, t.text) for t in back[2].turns] == [("", "x")]
    assert [t.text for t in back[3].turns] == ["a", "b", "b"]
    assert back[None].loss_texts == ["y"]


def test_parts_and_attachments(spark):
    part = C.PART_TYPE
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "s3://a.png", 2.0), ("text", "<|x", None, None)]),
            (1, 1, "assistant", [("text", "and ", None, None), ("audio", None, "b.wav", 1.5)]),
            (1, 2, "user", [("document", None, "c.pdf", None), ("odd", "kept", None, None)]), (1, 3, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>")
    r = C.read_back(C.format_chat(df, text=None, parts="content")).first()
    assert [t.text for t in r.turns] == ["see <|image:1|><|x", "and <|audio:2|>", "<|document:3|>kept", ""]
    assert [(a.ordinal, a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (1, 0, "image", "s3://a.png", 513), (2, 1, "audio", "b.wav", 77), (3, 2, "document", "c.pdf", 513)]
    assert r.attachment_tokens == 513 + 77 + 513


def test_query_against_plain_python(spark, folder, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("path", F.lit("clash"))
    out = {r.conv_id: r for r in C.op2_chat_format(spark, folder(conversations=df)).collect()}
    want = {-1: [(0, "user", HARD[0]), (1, "assistant", HARD[0])]}
    for r in df.collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert out.keys() == want.keys()
    for k, turns in want.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = out[k]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{a}\n{t}\n" for _, a, t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.format_chat(df).count() == 0
    assert C.op2_chat_format(spark, folder(conversations=df)).count() == 1
