"""Event logs of conversations against a plain fold, and the template's round trip."""

import hashlib
import random
from collections import defaultdict

import pytest

from llm import chat

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def test_template_round_trip():
    rng = random.Random(3)
    bits = ["\\", "###", "</turn>", "### assistant: ", "\n", ": ", ":", "a", "é", "\U0001f600", "#", "<", "</", "turn>", " ", ""]
    for _ in range(3000):
        said = [tuple("".join(rng.choice(bits) for _ in range(rng.randint(0, n))) for n in (5, 9)) for _ in range(rng.randint(1, 4))]
        formatted = [chat.turn(*x) for x in said]
        assert list(chat.turns("".join(x[0] for x in formatted))) == said
        assert [chat.unescape(x[lo:hi]) for x, lo, hi in formatted] == [text for _, text in said]


def plain_fold(events):
    convs = defaultdict(dict)
    for conv, _, message, kind, role, text in sorted(events, key=lambda e: (e[0] is not None, e[0], e[1])):
        said = convs[conv]
        if message is None or kind not in ("delta", "edit", "regenerate"):
            continue
        if kind == "regenerate":
            for m in [m for m in said if m >= message]:
                del said[m]
        mine = said.setdefault(message, ["", ""])
        if role is not None:
            mine[0] = role
        if kind != "regenerate":
            mine[1] = ("" if kind == "edit" else mine[1]) + (text or "")
    return {(c, m): tuple(x) for c, said in convs.items() for m, x in said.items()}


@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_fold(spark, parts):
    """With 16 partitions most of the long conversations go over several borders."""
    rng, events = random.Random(int(parts)), []
    for conv in [*range(12), None]:
        for seq in range(rng.choice([3, 50, 900])):
            kind = rng.choices(["delta", "edit", "regenerate", None, "other"], [20, 1, 1, 0.3, 0.3])[0]
            message = None if rng.random() < 0.02 else rng.randint(0, 9)
            role = rng.choice([None, None, "user", "assistant"])
            events.append((conv, seq, message, kind, role, None if rng.random() < 0.05 else f"{seq} "))
    rng.shuffle(events)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = chat.fold(spark.createDataFrame(events, LOG)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.conv_id, r.message): (r.role, r.text) for r in got} == plain_fold(events)


def test_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "delta", "user", "Wha"), (1, 1, 0, "delta", None, "t?"), (1, 2, 1, "delta", "assistant", "Bad"),
        (1, 3, 2, "delta", "user", "Hm"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", "assistant", "Go"),
        (1, 6, 1, "delta", None, "od"), (1, 7, 0, "edit", None, "What is it?"),
    ]
    got = chat.render(chat.fold(spark.createDataFrame(events, LOG))).collect()
    assert len(got) == 1
    assert list(chat.turns(got[0].formatted)) == [("user", "What is it?"), ("assistant", "Good")]
    assert [got[0].formatted[s.start : s.end] for s in got[0].loss] == ["Good"]


def test_long_conversations_are_several_parts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} </turn> " * 5) for i in range(40)]
    log = chat.conversation_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chars=7)
    parts = chat.render(chat.fold(log), chars=200).orderBy("part").collect()
    assert len(parts) > 5
    assert [t for p in parts for t in chat.turns(p.formatted)] == [(r[2], r[3]) for r in rows]


def test_rows_with_nulls_ties_and_repeats(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, -3, "system", None), (1, None, None, "c\\"),
        (None, 0, "user", ""), (None, 1, "assistant", "x" * 1000), (2, 0, "assistant", "é\U0001f600" * 300), (1, 1, "user", "### "),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.conversation_log(docs)))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 6, None: 2, 2: 1}
    assert got[2].loss_chars == 600 and got[2].loss_sha256 == hashlib.sha256(("é\U0001f600" * 300).encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{'x' * 1000}\n".encode()).hexdigest()
    parts = chat.render(chat.fold(chat.conversation_log(docs))).where("conv_id = 1").collect()
    turns = [t for p in parts for t in chat.turns(p.formatted)]
    assert turns[:4] == [("", "c\\"), ("system", ""), ("user", "a"), ("user", "a")]
    assert sorted(turns[4:]) == [("assistant", "b"), ("user", "### ")]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert chat.digests(chat.render(chat.fold(log))).collect() == []
