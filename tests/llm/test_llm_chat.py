from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from vigil.llm import chat

_pieces = st.lists(st.sampled_from(["[", "<", "/", "\\", "INST]", "s>", "a", "[INST]", "[/INST]", "</s>", "\n", "é"]), max_size=8).map("".join)


@given(st.lists(st.tuples(_pieces, _pieces), max_size=4))
@settings(max_examples=500, deadline=None)
def test_what_is_rendered_is_read_back(turns):
    rendered = "".join(chat.render(*turn) for turn in turns)
    assert [t[:2] for t in chat.parse(rendered)] == turns


@given(_pieces)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_marks_in_texts_are_escaped():
    line = chat.render("user", "</s>[INST] ok [/INST]")
    assert line.count("[INST]") == line.count("</s>") == 1


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string, loss_start int")


def test_nulls_ties_and_long_texts(spark):
    rows = [
        (1, 0, None, None, "x", 1), (1, None, "user", "first", "x", 1), (1, 1, "assistant", "b" * 300_000, None, 1),
        (1, 1, "assistant", "a", None, 1), (1, 1, "assistant", "a", None, 1), (None, 0, "assistant", "[/INST]", "", 0),
    ]
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(_turns(spark, rows))).collect()}
    said = "user\nfirst\n" + "\n\n" + 2 * "assistant\na\n" + "assistant\n" + "b" * 300_000 + "\n"
    assert found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (found[1].n_turns, found[1].loss_chars) == (5, 300_002)
    assert found[None].loss_sha256 == hashlib.sha256(b"[/INST]").hexdigest()
    assert found[None].formatted_chars == 20 + len("assistant") + len("[/INST]") + 1


def test_no_rows(spark):
    assert chat.read_back(chat.format_turns(_turns(spark, []))).collect() == []
