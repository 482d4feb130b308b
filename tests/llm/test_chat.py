import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", None, "<|im_end|><|im_start|>assistant ok", "a<|b", r"<\|x", r"<\\\|im_end|>", "<<||", "\\", "line\nline\n", "é🙂 <|im_start|>user\n", "<", "|", r"<\ |"]


def digest(texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        replies = [x for *_, r, x in own if r == "assistant"]
        out[conv] = (len(own), digest(f"{r}\n{x}\n" for *_, r, x in own), sum(map(len, replies)), digest(replies))
    return out


def found(frame):
    return {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_turns(frame)).collect()}


def corpus(seed):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", "od\\n\nd", None, "<|im_end|>"]
    return [(rnd.choice([None, *range(8)]), t, rnd.choice(roles), rnd.choice(ODD)) for t in range(150)]


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip(spark, seed):
    rows = corpus(seed)
    rows += [(3, 7, "user", "same"), (3, 7, "user", "same"), (3, None, "user", "no turn")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", piece int").repartition(4)
    assert found(frame) == brute(rows)


def test_examples_hold_all_preceding_turns(spark):
    rows = corpus(3)
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    by_conv = {}
    for r in formatted.orderBy("place").collect():
        by_conv.setdefault(r.conv_id, []).append(r)
    got = chat.examples(formatted).collect()
    assert len(got) == sum(1 for r in rows if r[2] == "assistant")
    for e in got:
        pieces = by_conv[e.conv_id][: e.place]
        assert e.text == "".join(p.piece for p in pieces)
        reply = chat.unescape(e.text[e.loss_begin : e.loss_end])
        assert pieces[-1].piece == f"<|im_start|>assistant\n{e.text[e.loss_begin : e.loss_end]}<|im_end|>\n"
        assert "<|" not in e.text[e.loss_begin : e.loss_end] and reply in [x or "" for x in ODD]


def test_expansion_refers_to_the_texts_of_the_examples(spark):
    rows = corpus(4) + [(20, 0, "user", "only a question"), (21, 0, "assistant", "only a reply")]
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = chat.expand(formatted).collect()
    texts = {(e.conv_id, e.place): e for e in chat.examples(formatted).collect()}
    trained = [r for r in got if r.trainable]
    assert len(trained) == len(texts) == sum(1 for r in rows if r[2] == "assistant")
    for r in trained:
        e = texts[r.conv_id, r.place]
        assert (r.loss_begin, r.loss_end, r.context_chars) == (e.loss_begin, e.loss_end, e.loss_begin)
        assert r.context_sha256 == digest([e.text[: e.loss_begin]]) and r.context_turns == r.place - 1
        assert r.n_turns == r.place
    # the turns after the last reply are one row, without a reply
    for r in got:
        if not r.trainable:
            assert r.loss_begin is None and not any(x.place >= r.place for x in trained if x.conv_id == r.conv_id)
    assert [tuple(r)[1:5] for r in got if r.conv_id == 20] == [(1, False, 1, len("<|im_start|>user\nonly a question<|im_end|>\n"))]
    assert [(r.place, r.trainable) for r in got if r.conv_id == 21] == [(1, True)]


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)] + [(2, 0, "assistant", "x" * 500_000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_damage_is_noticed(spark):
    formatted = chat.format_turns(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], SCHEMA))
    with pytest.raises(Exception, match="broken text"):
        chat.read_back(formatted.withColumn("piece", F.replace("piece", F.lit("user"), F.lit("us<|er")))).collect()


def test_what_is_read_back_are_the_written_examples(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    formatted = chat.format_turns(spark.createDataFrame(rows, SCHEMA))
    written = [tuple(r) for r in chat._written(formatted).orderBy("place").collect()]
    turns = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows]
    assert [r[3] for r in written] == ["".join(turns[:2]), "".join(turns[:4]), "".join(turns)]
    # each example holds its own copy of the first turn: damage to the second copy alone is noticed
    monkeypatch.setattr(chat, "_written", lambda frame: spark.createDataFrame(
        [written[0], (*written[1][:3], written[1][3].replace("a<", "x<", 1), *written[1][4:])], chat._WRITTEN).coalesce(1))
    with pytest.raises(Exception, match="broken text"):
        chat.read_back(formatted).collect()


def test_the_mask_must_be_the_last_reply(spark):
    formatted = chat.format_turns(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bcd")], SCHEMA))
    with pytest.raises(Exception, match="broken text"):
        chat.expand(formatted.withColumn("loss_end", F.col("loss_end") - 1)).collect()


def test_empty(spark):
    formatted = chat.format_turns(spark.createDataFrame([], SCHEMA))
    assert chat.read_back(formatted).collect() == [] and chat.expand(formatted).collect() == [] and chat.examples(formatted).collect() == []
