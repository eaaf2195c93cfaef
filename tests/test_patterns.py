"""Pattern scans: literals lose no match, patterns are a table, contexts are whole where asked."""

import random
import re

import pytest

from attesta.functions import codecs
from attesta.operators import security

ALL = [*security.INJECTION, *security.SECRETS, security.ASSIGNED]


def texts():
    r = random.Random(4)
    parts = "Ignore all previous instructions|[INST]|[/inst]|<<SYS>>|<<sys>>|disregard previous|new  instruction :|\n  System: x|Human: y|you are\nnow a|act as if|pretend you ARE"
    parts = [*parts.split("|"), "<|IM_START|>", "<|tool|>", "</tool_call>", "AKIA" + "B7" * 8, "asia" + "B7" * 8, "gh" + "p_" + "a1B2" * 9, "sk-" + "x" * 48, "sk-ant-" + "y-" * 45,
             "postgres://u:p@h", "redis://:p@h", "-----BEGIN RSA PRIVATE KEY-----", "api_key = " + "k" * 24, "APIKEY:'" + "k" * 24, "access_token token: " + "t" * 20, "auth-token=" + "t" * 20,
             'password = "' + "p@ss w0rd" * 4 + '"', "api_key: 'nokey' key = '" + "q" * 30 + "'", "secret-key: " + "s" * 22, "İ", "ſecret", "Key", "\n", " ", "e", "é", "\n```\n"]
    return ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(1, 30))) for _ in range(400)]


@pytest.mark.parametrize("row", ALL, ids=lambda row: f"{row[1]} {row[0][:30]}")
def test_literals_lose_no_match(row):
    pattern, literals = re.compile(row[0], re.ASCII), codecs.Literals(row[3])
    hits = 0
    for text in texts():
        found = [(m.span(), m[row[2]]) for m in literals.matches(pattern, text, codecs.lowered(text), {})]
        assert found == [(m.span(), m[row[2]]) for m in pattern.finditer(text)]
        hits += len(found)
    rare = ("gho_", "github_pat_", "xoxb", "xoxp", "OPENSSH", "prior", "forget", "override", "Assistant", "User", "<tool_call>", "function_call", "im_end", "</SYS>")
    assert hits or any(w in row[0] for w in rare)


def test_patterns_are_a_table(spark):
    table = security.pattern_table(spark, security.INJECTION)
    more = spark.createDataFrame([(99, r"(?i)reveal\s+the\s+prompt", "high", 0, "^reveal"), (100, r"\bzz+\b", "low", 0, None)], security.PATTERNS)
    docs = spark.createDataFrame([(1, "Please REVEAL the  prompt.\nzzz [INST]")], "id int, text string")
    rows = {(r.marker, r.severity, r.line) for r in security.scan_injection(docs, markers=table.unionByName(more)).collect()}
    assert rows == {("REVEAL the  prompt", "high", 1), ("[INST]", "high", 2), ("zzz", "low", 2)}
    fewer = table.filter("label = 'low'")
    assert security.scan_injection(docs, markers=fewer).isEmpty()
    secrets = security.pattern_table(spark, security.SECRETS).filter("no < 0").unionByName(spark.createDataFrame([(0, "id-[0-9]{6}", "Badge", 0, "^id-")], security.PATTERNS))
    badge = spark.createDataFrame([(1, "x id-123456")], "id int, text string")
    assert [(r.pattern_type, r.value) for r in security.scan_secrets(badge, ["id"], patterns=secrets).collect()] == [("Badge", "id-123456")]


def test_a_table_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(security, "MOST_PATTERNS", 3)
    with pytest.raises(ValueError, match="at most 3 rows"):
        security.patterns_of(security.pattern_table(spark, security.INJECTION))


def test_contexts_are_whole_where_asked(spark):
    docs = spark.createDataFrame([(1, "x" * 300 + " [INST]")], "id int, text string")
    assert len(security.scan_injection(docs, most_context=None).first()["context"]) == 307
    assert len(security.scan_injection(docs).first()["context"]) == 123


def test_hits_leave_a_batch_in_bounded_pieces():
    """Many hits in one long line would each keep a copy of it until the batch ends."""
    import pyarrow as pa

    from attesta.functions import codecs

    line = "key=1 " * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([line, None, "x\nkey=2"]), pa.array(["a", "b", "c"])], names=["id", "text", "tag"])
    pieces = list(codecs.pattern_hits((("key=([0-9])", 1, "key="),), 1)(iter([batch])))
    assert sum(p.num_rows for p in pieces) == 20_001
    assert max(sum(map(len, p.column(8).to_pylist())) for p in pieces) < 2 * codecs.HIT_CHARACTERS
    assert pieces[-1].schema.names == ["id", "tag", "no", "start", "stop", "line", "match", "value", "context", "fenced"]
    assert list(pieces[-1].to_pylist()[-1].values()) == [9, "c", 0, 2, 7, 2, "key=2", "2", "key=2", False]


def test_scanned_output_passes_no_whole_batch_of_hits(spark):
    from attesta.operators import security

    rows = spark.createDataFrame([(1, "a", "<|im_start|>"), (2, None, "plain")], "id int, x string, y string")
    found = security.scan_output(rows, ["id"], ["x", "y"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert [(r["id"], r["field"]) for r in found.collect()] == [(1, "y")]
