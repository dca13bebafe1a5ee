import json

import pytest

from tiltframe.llm import chat

AWKWARD = ["\\### Assistant: </turn> ok", "####  ### </turn", "\\\\h\\l", "", "a\nb</turn>\n### x: y", "é" * 9]


def back(df):
    out = {}
    for r in chat.read_back(df).orderBy("conv_id", "segment").collect():
        turns, learned = out.setdefault(r.conv_id, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        learned += r.learned
    return out


def test_round_trip_of_awkward_texts(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(AWKWARD)]
    rows += [(2, 700 - i, "a: \\role:", t) for i, t in enumerate(AWKWARD)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = back(chat.format_turns(df))
    assert found[1] == ([(r[2], r[3]) for r in rows[:6]], [r[3] for r in rows[:6] if r[2] == "assistant"])
    assert found[2] == ([(r[2], r[3]) for r in reversed(rows[6:])], [])


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None), (None, 3, "user", "x"), (None, 3, "user", "x"), (None, 3, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert back(chat.format_turns(df)) == {
        None: ([("assistant", "y"), ("user", "x"), ("user", "x"), ("", "")], ["y"])
    }
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_long_conversation_is_cut_into_segments(spark):
    df = spark.range(1000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "string(id) AS text")
    segments = chat.format_turns(df)
    assert segments.count() == 4
    assert [t for _, t in back(segments)[7][0]] == [str(i) for i in range(1000)]


def test_layouts_are_selected_by_fingerprint(spark):
    want = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    frames = [
        spark.sql("SELECT 1L id, array(named_struct('role','user','content','hi'), named_struct('role','assistant','content','yo')) messages"),
        spark.sql("SELECT 1L id, array(named_struct('from','human','value','hi'), named_struct('from','gpt','value','yo')) conversations"),
        spark.sql("SELECT 1L id, 'hi' prompt, 'yo' completion"),
        spark.sql("SELECT 1L id, 'hi' instruction, '' `input`, 'yo' output, 5 turn, 'q' role"),
    ]
    for df in frames:
        assert sorted(map(tuple, chat.canonical_turns(df).collect())) == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.sql("SELECT 1L id, 2 other"))


def test_json_rows_of_different_layouts(spark):
    good = [
        {"id": "1", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
        {"id": "2", "prompt": "a", "completion": "b"},
        {"id": "3", "instruction": "i", "input": None, "output": "o"},
    ]
    odd = ['{"id": "4", "nothing": 1}', "no json", None]
    df = spark.createDataFrame([(json.dumps(g),) for g in good] + [(o,) for o in odd], "raw string")
    turns, left = chat.turns_from_json(df, "raw")
    assert sorted(map(tuple, turns.collect())) == [
        ("1", 0, "user", "hi"), ("1", 1, "assistant", "yo"), ("2", 0, "user", "a"), ("2", 1, "assistant", "b"),
        ("3", 0, "user", "i"), ("3", 1, "assistant", "o"),
    ]
    assert {r.raw for r in left.collect()} == set(odd)
