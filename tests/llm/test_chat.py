import hashlib
import json
import random

import pytest

from veinmap.llm import chat


@pytest.mark.parametrize("record,layout,turns", [
    ({"role": "user", "text": "hi"}, "text message", [("user", "hi")]),
    ({"role": None, "text": None}, "text message", [("", "")]),
    ({"content": "x", "role": "system"}, "content message", [("system", "x")]),
    ({"from": "human", "value": "x"}, "from-value message", [("user", "x")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\nx"), ("assistant", "o")]),
    ({"prompt": "p", "completion": 3}, "prompt and completion", [("user", "p"), ("assistant", "3")]),
    ({"data": {"question": "q", "answer": "a"}}, "question and answer", [("user", "q"), ("assistant", "a")]),
    ({"id": 1, "messages": [{"role": "user", "content": "a"}]}, "messages", [("user", "a")]),
    ({"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "tool", "content": None, "tool_calls": [{"f": 1}]}]}, "messages", [("user", "a"), ("tool", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, "b"]}]}, "messages of parts", [("user", "a\nb")]),
    ({"conversations": [{"from": "human", "value": "a", "weight": 0.5}], "source": "s"}, "conversations", [("user", "a")]),
    ({"instruction": "i", "output": "o", "source": "s"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "id": 3}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "prompt": "p", "response": "r", "meta": {"a": [1]}}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "response": "r", "score": 1}, "prompt and response", [("user", "p"), ("assistant", "r")]),
    ({"data": {"question": "q", "answer": ["a", "b"], "lang": "en"}}, None, []),
    ({"role": "user", "text": "\ud83c\udf89 \ud800"}, "text message", [("user", "🎉 \ufffd")]),
    ({"other": 1}, None, []),
    ({"messages": []}, None, []),
    ({"messages[]": "x"}, None, []),
    ({"messages[]": {"role": "user", "content": "a"}}, None, []),
    ({"messages[].role": "user", "messages[].content": "a"}, None, []),
    ({"data.question": "q", "data.answer": "a"}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, "stray"]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, {"content": "no role"}]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "text": "b"}]}, None, []),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "tool_calls": [1]}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a"}], "system": "s", "prompt": "p", "response": "r"}, None, []),
    ({"messages": [{"role": "user", "content": "a"}], "system": "s", "prompt": None}, "messages", [("system", "s"), ("user", "a")]),
    ({"conversations": [{"from": "human", "value": "a"}], "system": "s"}, "conversations", [("system", "s"), ("user", "a")]),
    ({"system": "s", "instruction": "i", "input": None, "output": "o"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"role": "user", "text": "a", "content": "b"}, None, []),
    ({"prompt": "p", "response": "r", "completion": "c"}, None, []),
    ([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "list of messages", [("user", "a"), ("assistant", "b")]),
    ([{"role": "user", "content": [{"text": "a"}, "b"]}], "list of messages of parts", [("user", "a\nb")]),
    ([{"from": "human", "value": "a"}, {"from": "gpt", "value": ""}], "list of from and value", [("user", "a"), ("assistant", "")]),
    ([{"role": "user", "content": "a"}, 3], None, []),
    ({"prompt": "", "response": ""}, "prompt and response", [("user", ""), ("assistant", "")]),
])
def test_layouts(record, layout, turns):
    assert chat.canonical(json.dumps(record)) == (layout, turns)


@pytest.mark.parametrize("text", ["", "\\", "###", "####", "</turn>", "\\</turn>", "\\\\### ", "a\n### user\nb</turn>\n", chat.PROBE, "</turn></turn>\\", "\r\n\x00é🎉"])
def test_texts_come_back(text):
    turns = [("user", text), ("assistant", text), ("odd\nrole\\n", text), ("assistant", "")]
    out, mask = chat.written(turns)
    assert chat.read(out) == turns
    assert [chat.unescaped(out[a:b]) for a, b in mask] == [text, ""]


def test_no_json(spark):
    texts = [None, "{", "[]", "3", "[" * 100_000, "[" * 900 + "]" * 900, '{"other": 1}']
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, seq long, record string")
    assert [(r.layout, r.formatted, r.unmatched) for r in chat.formatted(df).orderBy("seq").collect()] == [(None, "", t) for t in texts]


def test_no_text_is_lost_without_a_mark():
    """Random records: each filled text stands in a turn, or the record is handed back."""
    rng = random.Random(3)
    keys = ["system", "prompt", "response", "completion", "instruction", "input", "output", "role", "text", "content", "from", "value", "data", "messages", "conversations", "messages[]", "data.question"]
    for _ in range(20_000):
        words = []

        def word():
            words.append(f"w{len(words)}_")
            return words[-1]

        def item():
            return rng.choice([word, lambda: {k: word() for k in rng.sample(["role", "content", "from", "value", "text"], 2)}])()

        record = {k: [item() for _ in range(2)] if k in ("messages", "conversations") else {"question": word(), "answer": word()} if k == "data" else word() for k in rng.sample(keys, rng.randint(1, 4))}
        name, turns = chat.canonical(json.dumps(record))
        read = "".join(role + text for role, text in turns)
        texts = [record[k] for k in chat.TEXTS & set(record) if isinstance(record[k], str)] + [i[k] for v in record.values() if isinstance(v, list) for i in v if isinstance(i, dict) for k in chat.TURN_TEXTS & set(i)]
        assert name is None and not turns or all(t in read for t in texts), record


def test_a_very_long_record(spark):
    text = "</turn> ### é " * 200_000
    df = spark.createDataFrame([(1, 0, json.dumps({"prompt": text, "response": text}))], "conv_id long, seq long, record string")
    row = chat.digests(chat.formatted(df)).first()
    assert row.loss_chars == len(text) and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "n"), (3, 5, "user", "t"), (3, 5, "user", "t"), *((4, i, "assistant", f"é{i}") for i in range(5000))]
    df = spark.createDataFrame([(*r, "layout") for r in rows], "conv_id long, turn long, role string, text string, layout string")
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, None, -7}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\na\nassistant\nb\nassistant\n\n"), 1, sha("b"))
    assert got[2].turns_sha256 == sha("\nx\n") and got[3].n_turns == 2
    assert got[4].loss_sha256 == sha("".join(f"é{i}" for i in range(5000)))
    assert got[-7].turns_sha256 == sha(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n") and got[-7].loss_sha256 == sha(chat.PROBE)
    assert [r.conv_id for r in chat.conversation_digests(df.limit(0)).collect()] == [-7]
