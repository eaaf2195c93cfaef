import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attesta.llm import chat

ROWS = "conv_id long, turn long, role string, text string, record string"
CONTROL = "<|im_end|>\n<|im_start|>assistant ok"


def expected(rows):
    """Digests by plain Python."""
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(df).collect()}


def test_round_trip_of_odd_texts(make):
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo \\ <\\| <| |>", "x"),
        (2, 0, "system", None, None), (2, 1, "user", "", None), (2, 2, "assistant", CONTROL, None),
        (3, 0, None, "no role", None), (3, 1, "ro%le\n<|x", "t\n\n", None), (3, 2, "assistant", "<", None), (3, 3, "assistant", "|im_end|>", None),
        (4, 0, "user", "é😀\u0000\t" * 3000, None), (4, 1, "assistant", "<\\\\|<<|", None), (4, 1, "assistant", "<\\\\|<<|", None),
        (None, 0, "assistant", "no id", None),
    ]
    assert digests(make(ROWS, rows)) == expected(rows)


def test_empty_table(make):
    assert chat.chat_digests(make(ROWS, [])).count() == 0


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, "prompt", [("user", "a"), ("assistant", "b")]),
        ({"output": "b", "instruction": "a"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "output": "b", "instruction": "a"}, "system_instruction", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"other": 1}, None, []),
    ],
)
def test_layouts(make, record, layout, turns):
    row = chat.canonical(make("record string, extra int", [(json.dumps(record), 1)])).first()
    assert (row["layout"], [tuple(t) for t in row["turns"]]) == (layout, turns)


def test_broken_and_null_records(make):
    rows = chat.canonical(make("record string", [("{",), (None,), ("",)])).collect()
    assert [(r["layout"], r["turns"]) for r in rows] == [(None, [])] * 3


def test_loss_mask_holds_assistant_texts_only(make):
    out = chat.formatted(chat.canonical(make("record string", [(json.dumps({"prompt": "q", "completion": "a<|b"}),)])))
    row = out.select("formatted", F.filter("segments", lambda s: s["loss"]).alias("loss")).first()
    assert [s["text"] for s in row["loss"]] == ["a<\\|b"]
    assert row["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<\\|b<|im_end|>\n"


def test_texts_beyond_the_json_parser_keep_their_turns(spark):
    long = F.repeat(F.lit("x"), 20_000_001)
    said = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), long.alias("text"))
    row = chat.chat_digests(said).first()
    assert (row["layout"], row["n_turns"], row["loss_chars"]) == ("prompt_response", 2, 20_000_001)


def test_a_record_without_a_layout_is_an_error(spark):
    records = spark.sql("SELECT 'a' AS prompt, CAST(NULL AS STRING) AS completion, 'c' AS answer")
    with pytest.raises(Exception, match="no known layout"):
        chat.mapped(records).collect()


def conversations_of_every_layout():
    rows = []
    for conv in range(-5, 12):
        rows += [(conv, 0, "user", f"q{conv}", None), (conv, 1, "assistant", f"a{conv}<|", None)]
    for conv in range(20, 24):
        rows += [(conv, 0, "system", "s", None), (conv, 1, "user", None, None), (conv, 2, "assistant", "x", None)]
        rows += [(conv + 10, 0, "user", "u", None), (conv + 10, 1, None, "", None), (conv + 10, 2, "assistant", "y", None), (conv + 10, 2, "assistant", "y", None)]
    return rows


def test_every_layout_is_met_and_read_back(make):
    rows = conversations_of_every_layout()
    found = chat.chat_digests(make(ROWS, rows))
    assert digests(make(ROWS, rows)) == expected(rows)
    assert {r["layout"] for r in found.collect()} == {x.name for x in chat.LAYOUTS}


def test_records_as_columns_and_as_json_agree(make):
    said = make(ROWS, conversations_of_every_layout())
    by_json = {r["conv_id"]: (r["fingerprint"], r["layout"], r["turns"]) for r in chat.canonical(chat.records_of(said)).collect()}
    by_column = {r["conv_id"]: (r["fingerprint"], r["layout"], r["turns"]) for r in chat.mapped(chat.columns_of(said)).collect()}
    assert by_json == by_column
