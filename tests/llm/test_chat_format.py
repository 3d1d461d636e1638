import hashlib
import json

import pytest

from veldt.llm import chat_format as m

TALKS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno \\ <\\| <<||"), (1, 1, "assistant", "second of equal turns"),
    (2, 0, "a%0A<b\nc", None), (2, None, None, "first"), (None, 0, "assistant", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"),
]


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted(((o is not None, o or 0, r or "", t or "") for k, o, r, t in rows if k == key))
        out[key] = [(r, t) for _, _, r, t in turns]
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r["key"]: r for r in m.read_back(m.render(m.turn_rows(df))).collect()}
    want = expected(TALKS)
    assert set(got) == set(want)
    for key, turns in want.items():
        r = got[key]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        spans = [r["formatted"][s["from"] : s["to"]] for s in r["loss_spans"]]
        assert "".join(spans).replace("<\\|", "<|").replace("\\\\", "\\") == r["loss_text"]
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(turns)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert m.read_back(m.render(m.turn_rows(df))).count() == 0


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(7, "p", "c")], "id int, prompt string, completion string")
    assert m.layout_of(df.schema).name == "prompt"
    assert [tuple(r) for r in m.turn_rows(df, "id").collect()] == [(7, 0, "user", "p"), (7, 1, "assistant", "c")]
    df = spark.createDataFrame([(7, [("human", "q"), ("gpt", None)])], "id int, conversations array<struct<from:string,value:string>>")
    assert [tuple(r)[1:] for r in m.turn_rows(df, "id").collect()] == [(0, "user", "q"), (1, "assistant", "")]
    with pytest.raises(ValueError):
        m.layout_of(spark.range(1).schema)


def test_json_rows_of_mixed_layouts(spark):
    rows = [(1, {"prompt": "a", "completion": "b", "x": 1}), (2, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "z"}]}), (3, {"instruction": "i", "output": "o"}), (4, {"instruction": "i", "input": "u", "output": "o"})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [(5, "no json"), (6, None)], "id long, body string")
    got = {}
    for r in m.json_turn_rows(df, "id", "body").orderBy("key", "ord").collect():
        got.setdefault(r["key"], []).append((r["role"], r["text"]))
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "q"), ("assistant", "z")], 3: [("user", "i"), ("assistant", "o")], 4: [("system", "i"), ("user", "u"), ("assistant", "o")]}
    assert {r["id"] for r in m.unmatched_json(df, "body").collect()} == {5, 6}


def test_query_has_the_probe_and_no_python(spark, sf):
    df = m.op1_chat_format(spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    r = df.where("conv_id = -1").first()
    assert r["n_turns"] == 2 and r["loss_sha256"] == hashlib.sha256(m.PROBE.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{m.PROBE}\nassistant\n{m.PROBE}\n".encode()).hexdigest()
