import hashlib
import random

from pyspark.sql import functions as F

from shelfwise.llm import chat
from shelfwise.llm.queries import PROBE

SCHEMA = "conv_id bigint, turn bigint, role string, text string, number int, formatted string, segment string"
TEXTS = ["hello", "", None, PROBE, "<|", "&lt;|", "&amp;lt;|", "a&b <|im_start|>user\nx", "two\nlines\n", "<|im_end|>\n", "é🙂", "&", "<", "|>", "&#10;"]


def rows():
    r = random.Random(4)
    out = []
    for conv in [*range(40), None]:
        for turn in range(r.randint(1, 9)):
            out.append((conv, turn, r.choice(["user", "assistant", "assistant", "system", None, "odd\nrole", "assistant\nx", "a<|&"]),
                        r.choice(TEXTS), 1, "f", "s"))
    out += [(100, 0, "user", "same", 1, "f", "s"), (100, 0, "user", "same", 1, "f", "s"), (100, None, "assistant", "first", 1, "f", "s"),
            (101, 1, "user", "no reply", 1, "f", "s"), (102, 5, "assistant", "only", 1, "f", "s")]
    return out


def conversations(all_rows):
    groups = {}
    for conv, turn, role, text, *_ in all_rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(g)] for c, g in groups.items()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digest_of_every_conversation(spark):
    got = {r.conv_id: r for r in chat.chat_digest(spark.createDataFrame(rows(), SCHEMA)).collect()}
    want = conversations(rows())
    assert set(got) == set(want)
    for conv, turns in want.items():
        g = got[conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (g.loss_chars, g.loss_sha256, g.n_examples) == (len(loss), sha(loss), sum(r == "assistant" for r, _ in turns))


def test_examples_are_prefixes_with_one_trained_reply(spark):
    esc = lambda t: t.replace("&", "&amp;").replace("<|", "&lt;|")
    fmt = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA)).filter("conv_id is not null")
    full = (chat.expand_examples(fmt).join(fmt, "conv_id")
            .withColumn("example", chat.example_text(F.col("formatted"), F.col("loss_end"))).collect())
    by_conv = conversations(rows())
    assert len(full) == sum(r == "assistant" for c, t in by_conv.items() if c is not None for r, _ in t)
    chars = {}
    for r in full:
        turns = by_conv[r.conv_id]
        parts = [f"<|im_start|>{esc(a).replace(chr(10), '&#10;')}\n{esc(b)}<|im_end|>\n" for a, b in turns]
        assert r.formatted == "".join(parts)
        assert r.example == "".join(parts[:r.context_turns + 1]) and r.context_chars == len("".join(parts[:r.context_turns]))
        assert r.example[r.loss_start:r.loss_end] == r.reply == esc(turns[r.context_turns][1])
        chars[r.conv_id] = chars.get(r.conv_id, 0) + len(r.example)
    for g in chat.chat_digest(spark.createDataFrame(rows(), SCHEMA)).filter("conv_id is not null").collect():
        assert g.example_chars == chars.get(g.conv_id, 0)


def test_no_rows(spark):
    assert chat.chat_digest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_plan_is_native(spark):
    plan = chat.chat_digest(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
