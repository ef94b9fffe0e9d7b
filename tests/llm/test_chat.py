import hashlib
import random

from pyspark.sql import functions as F

from tokentide.llm import chat
from tokentide.llm.queries import op5_chat_format

random.seed(17)
TURNS = f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, text string, formatted string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_texts_come_back(spark):
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "|", ">", "[", "a", "\n", "<|end|>\n", "<|user|>\n", "é", "$1"]
    rows = []
    for conv in range(80):
        for turn in range(random.randrange(1, 6)):
            rows.append((conv, turn, random.choice(["user", "assistant", "a|>\nb", "<|end|>"]), [part("text", "".join(random.choices(bits, k=8)))]))
    made = chat.format_conversations(conversations(spark, rows))
    for r in chat.read_back(made).collect():
        own = sorted(x for x in rows if x[0] == r.conv_id)
        assert [tuple(t) for t in r.turns] == [(role, p[0][1]) for _, _, role, p in own]
        assert r.loss_text == "".join(p[0][1] for _, _, role, p in own if role == "assistant")
    for r in made.collect():
        assert r.formatted.count("<|") == 2 * sum(x[0] == r.conv_id for x in rows)


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=60, height=28), part("text", " and <|image|>"), part("audio", ref="b.wav", seconds=1.01)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("video", "unknown"), None, part("image"), part("text", None)]),
    ]
    r = chat.format_conversations(conversations(spark, rows)).first()
    assert r.formatted == "<|user|>\nsee <|image|> and <\\|image|\\><|audio|><|end|>\n<|assistant|>\n<|document|><|image|><|end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 26), (1, "document", "c.pdf", 768), (1, "image", None, 1)]
    assert r.attachment_tokens == 798
    (s,) = r.loss
    assert r.formatted[s.start : s.start + s.length] == "<|document|><|image|>"


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", None),
        (None, 1, "assistant", [part("text", None)]),
        (2, 1, None, [part("text", "b")]),
        (2, 1, None, [part("text", "a")]),
        (2, 1, None, [part("text", "a")]),
        (2, None, "assistant", []),
        (3, 0, "assistant", [part("text", "long " * 50_000)]),
    ]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(conversations(spark, rows))).collect()}
    assert [tuple(t) for t in got[None].turns] == [("user", ""), ("assistant", "")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", ""), ("", "a"), ("", "a"), ("", "b")]
    assert len(got[3].loss_text) == 250_000
    assert chat.format_conversations(conversations(spark, rows).limit(0)).count() == 0


def test_query_keeps_the_extra_conversation(spark):
    r = op5_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.format_conversations(conversations(spark, []).where(F.col("turn") > 0)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
