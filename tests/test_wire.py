"""Streamed-response parsing, tool-call assembly and scoring."""

import json

import pytest

from servebench.operators import wire as W

LINES = "request_id long, line_no int, arrived_at double, line string"


def lines(spark, texts, rid=1):
    return spark.createDataFrame([(rid, i, 100.0 + i, t) for i, t in enumerate(texts)], LINES)


def chunk(content=None, tool_calls=None, usage=None):
    d = {"choices": [{"delta": {}}]}
    if content is not None:
        d["choices"][0]["delta"]["content"] = content
    if tool_calls is not None:
        d["choices"][0]["delta"]["tool_calls"] = tool_calls
    if usage is not None:
        d["usage"] = usage
    return "data: " + json.dumps(d)


def test_sse_body(spark):
    body = [chunk("Hello"), "", chunk(" world"), "", chunk(usage={"prompt_tokens": 7, "completion_tokens": 2}), "",
            "data: [DONE]", ""]
    ch = W.parse_wire(lines(spark, body))
    assert ch.count() == 3
    facts = W.chunk_facts(ch)
    s = W.wire_summary(facts).collect()[0]
    assert s.text == "Hello world" and s.n_token_chunks == 2
    assert s.usage_completion_tokens == 2 and s.usage_prompt_tokens == 7
    assert s.first_token_at == 100.0


def test_sse_edge_cases(spark):
    assert W.parse_wire(lines(spark, ["", "   ", chunk("a"), ""])).count() == 1
    # last line without newline still parsed
    assert W.parse_wire(lines(spark, [chunk("a"), chunk("b")])).count() == 2
    # malformed JSON between good lines is skipped
    assert W.parse_wire(lines(spark, [chunk("a"), "data: {bad json", chunk("b")])).count() == 2
    # trailing text after a JSON object is malformed too
    assert W.parse_wire(lines(spark, [chunk("a"), 'data: {"choices":[]} trailing'])).count() == 1
    assert W.parse_wire(lines(spark, [chunk("a"), 'data: {"choices":[]} {}', "data: {'choices':[]}"])).count() == 1
    # an odd number costs neither its chunk nor the fields beside it
    odd = W.chunk_facts(W.parse_wire(lines(spark, [chunk("a", usage={"prompt_tokens": "x", "completion_tokens": 2.0})]))).first()
    assert (odd.content, odd.prompt_tokens, odd.completion_tokens) == ("a", None, 2)
    # lines after the terminator are ignored; lines without the prefix too
    assert W.parse_wire(lines(spark, [chunk("a"), "data: [DONE]", chunk("late"), "event: ping"])).count() == 1


PAYLOADS = [
    '{"choices":[{"delta":{"content":"a b"}}]}', '{"choices": [{"delta": {"content": ""}}]}',
    '{"id":"x","object":"chat.completion.chunk","created":17,"model":"m","system_fingerprint":null,"choices":[{"index":0,'
    '"delta":{"role":"assistant","content":"\u00e9\U0001f600\u2028"},"logprobs":null,"finish_reason":"stop"}],"usage":null}',
    '{"choices":[{"delta":{"content":"a\\nb"}}]}', '{"choices":[{"delta":{"content":"a\tb"}}]}',
    '{"choices":[{"delta":{"content":null}}]}', '{"choices":[{"delta":{"content":"a"}},{"delta":{"content":"b"}}]}',
    '{"choices":[{"delta":{"content":"a","content":"b"}}]}', '{"choices":[{"delta":{"content":"a"}}]}}', '{"choices":[]}', "{}",
    '{"choices":[{"delta":{"content":"a"}}]}\u0085', '{"choices":[{"delta":{"content":"a","tool_calls":[{"index":0}]}}]}',
    '{"created":01,"choices":[{"delta":{"content":"a"}}]}', '{"choices":[{"delta":{"content":"a"}}],"usage":{"prompt_tokens":3}}',
]


def test_plain_chunks_read_as_a_json_reader_does(spark):
    """What the pattern reads is what the parse gives; the plain ones need no parse."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "i int, p string").select("i", "p", W.plain_text(F.col("p")).alias("t"))
    both = df.select("i", "t", W.plain_chunk(F.col("t")).alias("fast"), W.parsed_chunk(F.col("p")).alias("full")).collect()
    assert [r.i for r in both if r.t] == [0, 1, 2]
    assert all(r.fast == r.full for r in both if r.t)
    read = W.parse_wire(lines(spark, ["data: " + p for p in PAYLOADS])).collect()
    assert sorted((r.line_no, r.choices, r.usage) for r in read) == sorted((r.i, c.choices, c.usage) for r in both for c in r.full)
    facts = {r.line_no: r for r in W.chunk_facts(W.parse_wire(lines(spark, ["data: " + p for p in PAYLOADS]))).collect()}
    assert [facts[i].content for i in (0, 1, 6, 9)] == ["a b", "", "ab", ""]
    assert [(facts[i].has_token, facts[i].n_tool_deltas) for i in (0, 1, 5, 12)] == [(True, 0), (False, 0), (False, 0), (True, 1)]


def test_facts_read_a_line_once_and_sort_no_lines(spark):
    """Lines are read once, before they are dealt by request; facts of plain chunks make no array of choices; the first
    terminator is found without ordering a request's lines, also where keys or places are null or come twice."""
    rows = [(1, 0, chunk("a")), (1, 3, chunk("b")), (1, 3, " data: [DONE]\t"), (1, 2, " " + chunk("c") + "\r"), (1, 5, chunk("d")),
            (1, None, chunk("n")), (1, 2, chunk("c")), (1, 1, "data: "), (1, 1, None), (None, 0, chunk("x")), (None, 2, "data: [DONE]"),
            (None, 7, chunk("y")), (2, None, "data: [DONE]"), (2, 1, chunk("z")), (3, 4, chunk("q\n", usage={"prompt_tokens": 3}))]
    facts = W.chunk_facts(W.parse_wire(spark.createDataFrame([(r, n, 1.0, t) for r, n, t in rows], LINES)))
    got = [(r.request_id, r.line_no, r.content, r.has_token, r.n_tool_deltas, r.prompt_tokens) for r in facts.collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "a", True, 0, None), (1, 2, "c", True, 0, None), (1, 2, "c", True, 0, None),
                                           (1, None, "n", True, 0, None), (None, 0, "x", True, 0, None), (3, 4, "q\n", True, 0, 3)], key=str)
    plan = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "regexp_extract" in plan[plan.index("Exchange hashpartitioning"):] and plan.count("regexp_extract(") == 1
    assert "struct(delta" not in plan and "Sort [request_id" in plan and "line_no" not in plan[plan.index("Sort [request_id"):].split("\n")[0]


def calls_of(spark, deltas):
    body = [chunk(tool_calls=d) for d in deltas] + ["data: [DONE]"]
    ch = W.parse_wire(lines(spark, body))
    return W.assemble_tool_calls(W.tool_call_deltas(ch)).orderBy("index").collect()


def test_tool_call_assembly(spark):
    c = calls_of(spark, [[{"index": 0, "id": "call_1", "function": {"name": "get_", "arguments": ""}}],
                         [{"index": 0, "function": {"name": "weather", "arguments": '{"loc'}}],
                         [{"index": 0, "function": {"arguments": 'ation": "SF"}'}}]])
    assert len(c) == 1 and c[0].name == "get_weather" and c[0].id == "call_1"
    assert json.loads(c[0].arguments) == {"location": "SF"}
    two = calls_of(spark, [[{"index": 0, "function": {"name": "a"}}, {"index": 1, "function": {"name": "b"}}],
                           [{"index": "0", "function": {"arguments": "{}"}}]])
    assert [(x["index"], x.name, x.arguments) for x in two] == [(0, "a", "{}"), (1, "b", "")]


SCORE_CASES = [
    ("get_weather", '{"location": "SF"}', "get_weather", ["location"], True),
    ("other", '{"location": "SF"}', "get_weather", ["location"], False),
    ("get_weather", '{"unit": "c"}', "get_weather", ["location"], False),
    (None, None, "get_weather", ["location"], False),
    ("get_weather", '{"location": "SF"}', None, None, None),
    ("get_weather", '{"location": ', "get_weather", ["location"], False),
    ("get_weather", '[1, 2]', "get_weather", [], False),
    ("get_weather", '{"location": "SF"} }', "get_weather", ["location"], False),
    ("get_weather", '{"location": "SF"} {}', "get_weather", ["location"], False),
    ("get_weather", '{"location": "SF"}, "x": {}', "get_weather", ["location"], False),
    ("get_weather", "{'location': 'SF'}", "get_weather", ["location"], False),
    ("get_weather", ' {"location": "SF"}\n', "get_weather", ["location"], True),
]


@pytest.mark.parametrize("name,args,exp,req,expected", SCORE_CASES)
def test_score_tool_call(spark, name, args, exp, req, expected):
    calls = spark.createDataFrame([(1, 0, "id", name, args)] if name else [],
                                  "request_id long, index int, id string, name string, arguments string")
    exps = spark.createDataFrame([(1, exp, req)] if exp else [],
                                 "request_id long, exp_name string, required_args array<string>")
    scored = spark.createDataFrame([(1,)], "request_id long")
    out = W.score_tool_calls(calls, exps, scored).collect()
    assert out[0].tool_call_correct == expected


def test_classify_status(spark):
    rows = [(1, None, None, None, None), (2, "asyncio.TimeoutError", None, None, None),
            (3, "httpx.HTTPStatusError", 503, "x" * 500, None), (4, "httpx.HTTPStatusError", 500, None, None),
            (5, "ValueError", None, None, "m" * 400), (6, "httpx.ReadTimeout", None, None, "read timeout"),
            (7, "asyncio.CancelledError", None, None, None)]
    df = spark.createDataFrame(rows, "request_id long, exc_kind string, http_code int, body string, message string")
    out = {r.request_id: (r.status, r.error) for r in W.classify_status(df).collect()}
    assert out[1] == ("success", "") and out[2] == ("timeout", "Request timed out")
    assert out[3] == ("error", "HTTP 503: " + "x" * 200)
    assert out[4] == ("error", "HTTP 500: (streaming response body not available)")
    assert out[5] == ("error", "m" * 300)
    assert out[6][0] == "error" and out[7] == ("pending", "")
    opt = {r.request_id: r.status for r in
           W.classify_status(df, timeout_kinds=("asyncio.TimeoutError", "httpx.ReadTimeout")).collect()}
    assert opt[6] == "timeout"


def test_one_pass_records_equal_two_branch(spark):
    from conftest import SF001
    from servebench.sources import standins as S

    req = S.requests_df(spark, SF001)
    lines = S.wire_lines_df(spark, SF001, req)
    exp = S.expectations_df(spark, SF001, req)
    cols = ["request_id", "first_token_at", "tool_call_correct"]
    a = W.request_records_from_wire(req, lines, exp).select(*cols)
    chunks = W.parse_wire(lines)
    calls = W.assemble_tool_calls(W.tool_call_deltas(chunks))
    scored = req.filter("category = 'tool_call' and status = 'success'").select("request_id")
    b = (req.select("request_id").join(W.first_token(W.chunk_facts(chunks)), "request_id", "left")
         .join(W.score_tool_calls(calls, exp, scored), "request_id", "left").select(*cols))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.filter("tool_call_correct is not null").count() > 0
