"""Chat records to turns, and turns to marked text and back."""

from __future__ import annotations

import hashlib
import json

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from shelfmark import session
from shelfmark.llm import chat, queries

FOLDER = "/root/testdata/sf0.001"
FRAGMENTS = ["<", "[", "\\", "/", "s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "INST]", "SYS>>", "[ROLE]",
             "[/ROLE]", "[/TURN]", "TURN]", "a", " ", "\n", "é", ">", "]", "</", "[/"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]x"]),
                          st.lists(st.sampled_from(FRAGMENTS), max_size=12).map("".join)), max_size=6))
def test_marked_turns_read_back(turns):
    marker = chat.Marker()
    marked = [marker.write(*turn) for turn in turns]
    assert list(marker.read("".join(m for m, _, _ in marked))) == turns
    for (role, text), (m, low, high) in zip(turns, marked):
        assert (low is None) == (role != "assistant")
        assert low is None or marker.unescape(m[low:high]) == text
        assert not any(mark in marker.escape(text) for mark in marker.template.marks())


LAYOUTS = {
    "messages": ({"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "name": "n"}]},
                 [("user", "q"), ("assistant", "a")]),
    "message parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]},
                      [("user", "qr")]),
    "from and value": ({"id": "x", "system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
                       [("system", "s"), ("user", "q"), ("assistant", "")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    "prompt and completion": ({"prompt": "p", "completion": 5}, [("user", "p"), ("assistant", "5")]),
    "prompt and response": ({"prompt": "p", "response": "r", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "question and answer": ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    "turn row": ({"conv_id": 3, "turn": 7, "role": "user", "text": "q"}, [("user", "q")]),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    record, want = LAYOUTS[name]
    layouts = chat.Layouts()
    known = len(layouts.known)
    layout, key, turns = layouts.turns(json.dumps(record))
    assert layout == name and [t[1:] for t in turns] == want and len(layouts.known) == known
    assert layouts.turns(json.dumps({**record, "score": {"of": [1]}}))[0] == name  # further fields: by most paths


def test_fingerprints_differ():
    marks = {chat.fingerprint(chat.paths(record)) for record, _ in LAYOUTS.values()}
    assert len(marks) == len(LAYOUTS)
    assert chat.paths({"a": [], "b": {"c": [{"d": 1}, {"e": None}]}, "f": {}}) == {"a[]", "b.c[].d", "b.c[].e", "f"}


def folded(spark, records, **options):
    class Kept:
        def __init__(self):
            self.turns, self.loss, self.chars = [], [], 0

        def piece(self, text):
            self.chars += len(text)

        def turn(self, role, text):
            self.turns.append(f"{role}:{text}")

        def learned(self, text):
            self.loss.append(text)

        def row(self):
            return self.turns, self.loss, self.chars

    df = spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r), 1, "x") for r in records],
                               "record string, conv_id int, text string")
    path = session.work_path(spark, "chats")
    chat.format_chats(df, path, **options)
    rows = chat.fold_chats(chat.read_chats(spark, path), Kept, "conv_id long, turns array<string>, loss array<string>, chars long").collect()
    return {r.conv_id: r for r in rows}, df


@pytest.mark.parametrize("piece_chars", [1 << 20, 30])
def test_odd_records(spark, piece_chars):
    flat = [{"conv_id": c, "turn": t, "role": r, "text": x} for c, t, r, x in [
        (5, 2, "assistant", "second <s>"), (5, 1, "user", "first"), (5, 1, "user", "first"), (5, None, "system", None),
        (6, 0, None, "no role"), (None, 0, "user", "no id"), (None, 1, "assistant", "still none"), (7, 0, "assistant", "y" * 100_000)]]
    records = flat + [record for record, _ in LAYOUTS.values()] + [
        {"conv_id": 8, "messages": []}, None, "", "no json", "[1]", {"unknown": 1}, {"conv_id": 9, "prompt": None, "completion": "c"}]
    found, df = folded(spark, records, piece_chars=piece_chars)
    assert found[5].turns == ["system:", "user:first", "user:first", "assistant:second <s>"] and found[5].loss == ["second <s>"]
    assert found[6].turns == [":no role"] and found[None].turns == ["user:no id", "assistant:still none"]
    assert found[7].loss == ["y" * 100_000] and found[7].chars == 100_007
    assert found[1].turns == ["user:q", "assistant:a"] and found[3].turns == ["user:q"] and 8 not in found
    assert found[9].turns == ["assistant:c"]
    assert sum(len(r.turns) for r in found.values()) == len(flat) + sum(len(w) for _, w in LAYOUTS.values()) + 1
    lost = chat.unmapped(chat.canonical_turns(df)).collect()
    assert sorted((r.record or "", r.record is None) for r in lost) == sorted(
        [("", True), ("", False), ("no json", False), ("[1]", False), ('{"unknown": 1}', False)])
    assert folded(spark, [])[0] == {}


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, role, coalesce(text, '') FROM '{FOLDER}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    rows += [(-1, role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    plain = {}
    for conv, role, text in rows:
        plain.setdefault(conv, []).append((role, text))
    found = queries.op13_chat(spark, FOLDER).collect()
    assert len(found) == len(plain)
    for r in found:
        turns = plain[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for _, t in turns)
