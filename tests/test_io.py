"""Sources and sinks: pool formats and rejects, write policy, CSV, capture
reader, first-available resolution, pool validation."""

import json
import os
import tempfile

import pytest

from servebench.operators.curate import pool as PL
from servebench.operators import wire as W
from servebench.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="servebench-test-", dir="/tmp")


ENTRY = {"id": "a1", "category": "short_chat", "source": "s", "messages": [{"role": "user", "content": "hi there"}],
         "max_tokens": 1024, "input_token_count": 8}


def test_pool_jsonl_and_rejects(spark):
    d = _tmp()
    path = os.path.join(d, "pool.jsonl")
    bad = {"id": "b2", "category": "short_chat", "messages": []}          # no source -> reject
    bare = {"id": "c3", "category": "reasoning", "source": "s", "messages": [{"role": "user", "content": "x"}]}
    with open(path, "w") as f:
        f.write(json.dumps(ENTRY) + "\n\n" + json.dumps(bad) + "\n" + json.dumps(bare) + "\n")
    ok, rej = IO.read_prompt_pool(spark, path)
    rows = {r.id: r for r in ok.collect()}
    assert set(rows) == {"a1", "c3"} and [r.id for r in rej.collect()] == ["b2"]
    assert rows["c3"].max_tokens == 1024 and rows["c3"].input_token_count == 0   # defaults


def test_pool_json_array(spark):
    d = _tmp()
    path = os.path.join(d, "pool.json")
    with open(path, "w") as f:
        json.dump([ENTRY, dict(ENTRY, id="a2")], f, indent=2)
    ok, _ = IO.read_prompt_pool(spark, path)
    assert sorted(r.id for r in ok.collect()) == ["a1", "a2"]


@pytest.mark.parametrize("names", [("a.json", "b.jsonl"), ("b.json", "a.jsonl")])
def test_pool_folder_of_arrays_and_lines(spark, names):
    d = _tmp()
    with open(os.path.join(d, names[0]), "w") as f:
        json.dump([ENTRY, dict(ENTRY, id="a2")], f, indent=2)
    with open(os.path.join(d, names[1]), "w") as f:
        f.write("\n" + "\n".join(json.dumps(dict(ENTRY, id=i)) for i in ("b1", "b2", "b3")) + "\n")
    ok, rej = IO.read_prompt_pool(spark, d)
    assert sorted(r.id for r in ok.collect()) == ["a1", "a2", "b1", "b2", "b3"] and rej.count() == 0


def test_malformed_line_fails(spark):
    d = _tmp()
    path = os.path.join(d, "pool.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps(ENTRY) + "\n{not json\n")
    ok, _ = IO.read_prompt_pool(spark, path)
    with pytest.raises(Exception):
        ok.collect()


def test_write_policy_keeps_existing(spark):
    d = _tmp()
    path = os.path.join(d, "out")
    df = spark.createDataFrame([ENTRY], IO.POOL_SCHEMA)
    IO.write_prompt_pool(df, path, force=True)
    assert IO.pool_line_count(spark, path) == 1
    two = spark.createDataFrame([ENTRY, dict(ENTRY, id="z")], IO.POOL_SCHEMA)
    IO.write_prompt_pool(two, path)               # kept: not forced
    assert IO.pool_line_count(spark, path) == 1
    IO.write_prompt_pool(two, path, force=True)   # replaced
    assert IO.pool_line_count(spark, path) == 2
    line = spark.read.text(path).first().value
    assert "tools" not in line and "expected_tool" not in line   # NULL fields omitted


def test_request_csv(spark):
    d = _tmp()
    empty = spark.createDataFrame([], "request_id long, category string, status string, request_sent_at double, "
                                      "first_token_at double, completed_at double, ttft double, e2e_latency double, "
                                      "output_tps double, input_tokens long, output_tokens long, "
                                      "tool_call_correct boolean")
    assert IO.write_request_csv(empty, os.path.join(d, "none")) is False
    assert not os.path.exists(os.path.join(d, "none"))
    one = spark.createDataFrame([(1, "c", "success", 1.0, 1.5, 2.0, 0.5, 1.0, 10.0, 5, 5, None)], empty.schema)
    assert IO.write_request_csv(one, os.path.join(d, "csv"))
    header = spark.read.text(os.path.join(d, "csv")).first().value
    assert header.split(",") == IO.REQUEST_CSV_COLUMNS


def test_wire_capture_and_first_available(spark):
    d = _tmp()
    cap = os.path.join(d, "cap")
    os.makedirs(cap)
    with open(os.path.join(cap, "part.json"), "w") as f:
        for i, line in enumerate(['data: {"choices":[{"delta":{"content":"a"}}]}', "data: [DONE]"]):
            f.write(json.dumps({"request_id": 7, "line_no": i, "arrived_at": 1.0 + i, "line": line}) + "\n")
    lines = IO.read_wire_capture(spark, cap)
    from servebench.operators import wire as W

    assert W.parse_wire(lines).count() == 1
    got = IO.read_first_available(spark, [(os.path.join(d, "missing"), "json", IO.WIRE_SCHEMA),
                                          (cap, "json", IO.WIRE_SCHEMA)])
    assert got.count() == 2
    assert IO.read_first_available(spark, [(os.path.join(d, "missing"), "json", None)]) is None
    both = IO.read_first_available(spark, [(cap, "json", IO.WIRE_SCHEMA), (cap, "json", IO.WIRE_SCHEMA)], union=True)
    assert both.count() == 4


def test_validate_pool(spark):
    rows = [ENTRY,
            dict(ENTRY, id="m", messages=[]),
            dict(ENTRY, id="x", input_token_count=100),
            dict(ENTRY, id="r", messages=[{"role": None, "content": "a"}])]
    df = spark.createDataFrame(rows, IO.POOL_SCHEMA)
    out = {r.check: r.n for r in PL.validate_pool(df).collect()}
    assert out == {"entries": 4, "missing_fields": 0, "empty_messages": 1, "bad_messages": 1, "token_mismatch": 1}


def test_check_weights():
    PL.check_weights({"a": 0.5, "b": 0.5})
    with pytest.raises(ValueError):
        PL.check_weights({"a": 0.5, "b": 0.6})


def test_require_prompts(spark):
    d = _tmp()
    path = os.path.join(d, "pool.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps({"id": "x"}) + "\n")
    ok, rej = IO.read_prompt_pool(spark, path)
    assert rej.count() == 1
    with pytest.raises(ValueError):
        IO.require_prompts(ok, path)


def test_pool_file_holds_tool_objects(spark):
    d = _tmp()
    path = os.path.join(d, "pool")
    fn = '{"name":"f","parameters":{"a":"x, \\"y\\"\\n"}}'
    tools = [{"type": "function", "function": fn}, {"type": None, "function": "no object"}]
    rows = [dict(ENTRY, tools=tools, expected_tool={"name": "f", "required_args": ["a,b", "c"]}), dict(ENTRY, id="bare", tools=[])]
    IO.write_prompt_pool(spark.createDataFrame(rows, IO.POOL_SCHEMA), path, force=True)
    got = {r["id"]: r for r in map(json.loads, (r.value for r in spark.read.text(path).collect()))}
    assert got["a1"]["tools"] == [{"type": "function", "function": json.loads(fn)}, {"function": "no object"}]
    assert got["a1"]["expected_tool"]["required_args"] == ["a,b", "c"]
    assert got["a1"]["messages"] == ENTRY["messages"] and got["a1"]["input_token_count"] == 8
    assert got["bare"]["tools"] == []
    back = {r.id: r for r in IO.read_prompt_pool(spark, path)[0].collect()}
    assert json.loads(back["a1"].tools[0].function) == json.loads(fn)


def test_report_config_loses_keys_at_any_depth():
    config = {"endpoint": {"url": "u", "api_key": "k"}, "runs": [{"api_key": "k", "n": 1}], "api_key": "k"}
    assert IO.without_key(config) == {"endpoint": {"url": "u"}, "runs": [{"n": 1}]}


def test_load_prompt_pool_counts_what_it_skips(spark, tmp_path):
    good = '{"id":"a","category":"c","source":"s","messages":[{"role":"user","content":"x"}]}'
    (tmp_path / "pool.jsonl").write_text(good + "\n" + '{"id":"b","category":"c"}\n{"category":"c"}\n')
    prompts, skipped = IO.load_prompt_pool(spark, str(tmp_path / "pool.jsonl"))
    assert [r.id for r in prompts.collect()] == ["a"] and skipped == 2
    (tmp_path / "none.jsonl").write_text('{"id":"b"}\n')
    with pytest.raises(ValueError):
        IO.load_prompt_pool(spark, str(tmp_path / "none.jsonl"))


BODIES = {
    7: ['data: {"choices":[{"delta":{"content":"a"}}]}\r', "", ": ping", 'data: {"choices":[{"delta":{"content":"b\u2028c"}}]}',
        'data: {"usage":{"prompt_tokens":3,"completion_tokens":2}}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}'],
    8: ['data: {"choices":[{"delta":{"content":"x"}}]}', "data: {broken", "data: [DONE] "],
    9: [],
    10: ['data: {"choices":[{"delta":{"content":"no terminator"}}]}'],
}


def _bodies(folder, stamped):
    for r, lines in BODIES.items():
        stamps = [f"{100 * r + n}.5 " if stamped else "" for n in range(len(lines))]
        (folder / f"{r}.sse").write_bytes("\n".join(s + x for s, x in zip(stamps, lines)).encode())
    (folder / "notes.txt").write_text("data: {}")


def _chunks(lines):
    return sorted((r.request_id, r.line_no, r.arrived_at, str(r.choices), str(r.usage)) for r in W.parse_wire(lines).collect())


@pytest.mark.parametrize("stamped", [False, True])
@pytest.mark.parametrize("streaming", [False, True])
def test_response_text_gives_the_chunks_of_the_capture(spark, tmp_path, stamped, streaming):
    bodies = tmp_path / "bodies"
    bodies.mkdir()
    _bodies(bodies, stamped)
    capture = [(r, n, 100 * r + n + 0.5 if stamped else None, x) for r, lines in BODIES.items() for n, x in enumerate(lines)]
    got = IO.read_response_text(spark, str(bodies), streaming, stamped)
    if streaming:
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        got.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        got = spark.read.parquet(out)
    want = _chunks(spark.createDataFrame(capture, IO.WIRE_SCHEMA))
    assert _chunks(got) == want and [w[:2] for w in want] == [(7, 0), (7, 3), (7, 4), (8, 0), (10, 0)]


def test_stamped_line_without_a_time_keeps_its_text(spark, tmp_path):
    (tmp_path / "3.sse").write_text("data: {}\n1.25 data: [DONE]")
    assert [tuple(r) for r in IO.read_response_text(spark, str(tmp_path), stamped=True).collect()] == [
        (3, 0, None, "data: {}"), (3, 1, 1.25, "data: [DONE]")]
