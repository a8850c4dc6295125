"""Folding of chat events, rendering and reading back."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tavola.llm import chatlog
from tavola.llm.queries import QUERIES

LOG = "conv_id long, seq long, message long, kind string, role string, text string, node string"


def formatted(spark, events):
    df = spark.createDataFrame([(*e, "x") for e in events], LOG).repartition(3)
    return {r["conv_id"]: r for r in chatlog.format_log(df).collect()}


def test_fold(spark):
    events = [
        (1, 1, 10, "start", "user", None), (1, 2, 10, "delta", "user", "Hel"), (1, 3, 10, "delta", "user", "lo"),
        (1, 4, 11, "start", "assistant", None), (1, 5, 11, "delta", "assistant", "bad"), (1, 6, 12, "start", "user", "why"),
        (1, 7, 11, "regenerate", "assistant", None), (1, 8, 11, "delta", "assistant", "good"), (1, 9, 11, "delta", "assistant", "!"),
        (1, 10, 10, "edit", "user", "Hi"), (1, 11, 10, "delta", "user", " you"), (1, 12, 13, "odd", "user", "no"), (1, 13, 13, None, "user", "no"),
        (2, 1, 5, "delta", None, "begun by its delta"), (3, 1, 5, "odd", "user", "x"), (None, 2, 1, "delta", "user", "b"), (None, 1, 1, "delta", "user", "a"),
    ]
    got = formatted(spark, events)
    turns = {c: chatlog.parse(r["formatted"]) for c, r in got.items()}
    assert turns == {1: [("user", "Hi you"), ("assistant", "good!")], 2: [("", "begun by its delta")], 3: [], None: [("user", "ab")]}
    (span,) = got[1]["loss"]
    assert got[1]["formatted"][span["start"] : span["end"]] == "good!" and got[1]["n_turns"] == 2
    assert formatted(spark, []) == {}


def test_render_is_reversible():
    rng = random.Random(1)
    pieces = ["\\", "###", "#", "##", "</turn>", "<", "</", "turn>", "\n", " ", "a", "### assistant\n", "\\###", "é"]
    for _ in range(3000):
        turns = [("".join(rng.choices(pieces, k=rng.randrange(4))), "".join(rng.choices(pieces, k=rng.randrange(9)))) for _ in range(rng.randrange(4))]
        text, loss = chatlog.render([*turns, ("assistant", "end")])
        assert chatlog.parse(text) == [*turns, ("assistant", "end")]
        assert chatlog.unescape(text[loss[-1][0] : loss[-1][1]]) == "end"
    with pytest.raises(ValueError):
        chatlog.parse("### user\nopen")


def test_turns(spark):
    rows = [
        (1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, None, "system", None), (1, 1, "assistant", "two"),
        (2, 5, None, "x"), (3, 0, "assistant", "\\### ok </turn>" * 2000), (None, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, place int")
    made = chatlog.format_log(chatlog.turn_log(df)).select("conv_id", chatlog.read_back("formatted", "loss").alias("r"), "formatted")
    got = {r["conv_id"]: r for r in made.collect()}
    want = {1: [("system", ""), ("user", "one"), ("assistant", "two"), ("assistant", "two")], 2: [("", "x")], 3: [("assistant", rows[5][3])], None: [("user", "")]}
    assert {c: chatlog.parse(r["formatted"]) for c, r in got.items()} == want
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["r"]["loss_chars"] == len(loss)
        assert got[c]["r"]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["r"]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chatlog.format_log(chatlog.turn_log(df.limit(0))).count() == 0


def test_query(spark, data):
    got = QUERIES["op11_chat"](spark, data)
    fixed = got.where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert fixed["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert fixed["loss_chars"] == len(text) and fixed["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got.count() == spark.read.parquet(f"{data}/conversations.parquet").agg(F.countDistinct("conv_id")).first()[0] + 1
