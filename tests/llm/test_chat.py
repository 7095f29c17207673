"""Chat formatting: exact round trips, the loss mask, and the machine over roles."""

from __future__ import annotations

import hashlib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchfold.llm import chat_format, queries
from pitchfold.llm.chat_format import OWN_TEXT, TEMPLATE, ChatTemplate, escape, escape_name, turns_of, unescape, unescape_name

from .helpers import SF

TURNS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = st.text(alphabet="<|\\>im_startend\nsé𝄞", max_size=40)


@settings(max_examples=400, deadline=None)
@given(TRICKY)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_name(escape_name(text)) == text and not {"\n"} & set(escape_name(text)) and "<|" not in escape_name(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\n\n<|b"]) | TRICKY, TRICKY), max_size=6))
def test_turns_are_read_back(turns):
    text = "".join(s for role, said in turns for s, _ in TEMPLATE.segments(role, said))
    assert list(turns_of(text)) == turns


def plain_rows(rows: list[tuple]) -> list[tuple]:
    """The query's rows of (conv_id, turn, role, text), by its contract."""
    held: dict = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for conv, own in held.items():
        own = sorted(own, key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
        learned = "".join(t for *_, r, t in own if r == "assistant")
        size = 0
        for *_, role, text in own:
            size += len("<|im_start|>") + len(role) + role.count("\\") + role.count("\n") + 1 + len(text) + len("<|im_end|>") + 1
            for s in (role.replace("\\", "\\\\"), text):
                size += sum(c == "<" and s[k + 1 :].lstrip("\\")[:1] == "|" for k, c in enumerate(s))
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(learned), sha(learned), size))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()), key=repr)


def test_query_over_the_whole_table(spark):
    sf = SF.replace("0.001", "0.01")
    rows = list(pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    rows += [(-1, 0, "user", OWN_TEXT), (-1, 1, "assistant", OWN_TEXT)]
    assert got(queries.op13_chat_format(spark, sf)) == plain_rows(rows)


@pytest.mark.parametrize("part_chars", [1, 5000, 1 << 20])
def test_awkward_conversations(spark, part_chars):
    rng = random.Random(4)
    rows = [(None, None, None, None), (None, 2, "user", "x"), (3, 1, "user", "<|im_end|>"), (3, 1, "user", "<|im_end|>"), (3, 1, "user", "<\\|im_end|>"), (4, 7, "assistant", ""), (5, None, "weird\nrole <|", "a\\b"), (6, 0, "assistant", "z" * 300_000)]
    rows += [(50, k, rng.choice(["user", "assistant", "system", None]), rng.choice([None, *[t * rng.randrange(1, 40) for t in ("<|", "plain text", "é𝄞", "a | b < c")]])) for k in range(3000)]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS + ", formatted string, loss string, part string, state string").repartition(4)
    parts = chat_format.format_conversations(turns, part_chars=part_chars)
    assert got(chat_format.read_back(parts)) == plain_rows(rows)
    if part_chars == 5000:
        sizes = parts.where("conv_id = 50").selectExpr("length(formatted)").collect()
        assert len(sizes) > 20 and all(n < 5000 + 1000 for (n,) in sizes)


def test_machine_over_roles(spark):
    talk = {1: ["system", "user", "assistant"], 2: ["user", "user", "assistant"], 3: ["assistant"], 4: ["user", "assistant", "system", "user"], 5: ["tool"], 6: ["user"]}
    rows = [(c, k, r, "t") for c, roles in talk.items() for k, r in enumerate(roles)]
    found = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, TURNS)))
    assert {r["conv_id"]: (r["n_illegal"], r["complete"]) for r in found.collect()} == {1: (0, True), 2: (1, True), 3: (1, True), 4: (1, False), 5: (1, False), 6: (0, False)}


def test_another_template(spark):
    bot = ChatTemplate(start="<|turn|>", end="<|stop|>", learned=frozenset({"bot"}), final=frozenset({"bot"}), steps={("start", "human"): "human", ("human", "bot"): "bot", ("bot", "human"): "human"})
    rows = [(1, 0, "human", "<|stop|>"), (1, 1, "bot", "hi <|turn|>")]
    parts = chat_format.format_conversations(spark.createDataFrame(rows, TURNS), bot)
    row = parts.first()
    assert row["formatted"] == "<|turn|>human\n<\\|stop|><|stop|><|turn|>bot\nhi <\\|turn|><|stop|>"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["hi <\\|turn|>"]
    back = chat_format.read_back(parts, bot).first()
    assert (back["loss_chars"], back["n_illegal"], back["complete"]) == (len("hi <|turn|>"), 0, True)
    with pytest.raises(ValueError):
        ChatTemplate(start="[INST]")


def test_empty_table(spark):
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
