"""Corpus curation: tool normalisation, converters, routing, sampling."""

import json

import pytest
from pyspark.sql import functions as F

from servebench.operators.curate import chat as C
from servebench.operators.curate import documents as D
from servebench.operators.curate import pool as PL
from servebench.operators.curate import tools as TO
from servebench.specs import CATEGORY_SPECS, LongDocParams


def test_normalize_tools(spark):
    raw = json.dumps([{"type": "function", "function": {"name": "a"}}, {"name": "b", "parameters": {}},
                      {"function": {"name": "c"}}, "a string", {}])
    df = spark.createDataFrame([(1, raw), (2, "not json"), (3, '{"name": "x"}')], "row_id long, tools_json string")
    out = {r.row_id: r for r in TO.normalize_tools(df).collect()}
    tools = [json.loads(t) for t in out[1].tools]
    assert [t["function"]["name"] for t in tools] == ["a", "b", "c"]
    assert all(t["type"] == "function" for t in tools)
    assert out[2].n_tools == 0 and out[3].n_tools == 0


def test_math_filter(spark):
    q = "What is the sum of " + " ".join(["one"] * 120) + " numbers?"
    df = spark.createDataFrame([(1, q), (2, ""), (3, "one")], "doc_id long, text string")
    assert [r.doc_id for r in D.math_prompts(df).collect()] == [1]


def test_chat_eligibility(spark):
    rows = [(1, 0, "user", "Please explain how rainbows form in the sky", "English", 0),
            (2, 0, "user", "Please explain how rainbows form in the sky", "Chinese", 0),
            (3, 0, "user", "Please explain how rainbows form in the sky", None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string, lang string, toxic int")
    p = C.first_user_turn(C.conversation_facts(df))
    assert [r.conv_id for r in p.collect()] == [1]


def test_route_takes_in_order_and_spills_over(spark):
    """A quota takes the first ids; what it leaves goes to the next category that fits."""
    texts = [(1, "alpha " * 20), (2, "prove " * 20), (3, "alpha " * 20),      # short, short, over the short quota
             (4, "solve " * 20),                                            # over it too, and a reasoning keyword
             (5, "alpha " * 60), (6, "prove " * 60), (7, "alpha " * 60),      # medium, over its quota: 6 reasoning, 7 nowhere
             (8, "solve " * 60), (9, "alpha beta")]                          # over the reasoning quota; too short
    df = spark.createDataFrame([(cid, 0, "user", t.strip(), None, 0) for cid, t in texts],
                               "conv_id long, turn int, role string, content string, lang string, toxic int")
    specs = {c: dict(s) for c, s in CATEGORY_SPECS.items()}
    specs["short_chat"] |= {"min_tok": 5, "max_tok": 30}
    specs["medium_chat"] |= {"min_tok": 30, "max_tok": 100}
    specs["reasoning"] |= {"min_tok": 5, "max_tok": 100}
    fetch = {"short_chat": 2, "medium_chat": 1, "reasoning": 2, "multi_turn": 0}
    routed, _ = C.route_chat(C.first_user_turn(C.conversation_facts(df)), fetch, specs=specs)
    got = sorted((r.category, r.conv_id) for r in routed.collect())
    assert got == [("medium_chat", 5), ("reasoning", 4), ("reasoning", 6), ("short_chat", 1), ("short_chat", 2)]


def test_sample_balanced_pool(spark):
    toks = [60, 80, 120, 180, 250, 300, 400, 450]
    df = spark.createDataFrame([(f"id{i}", "s", "short_chat", i, t, 1024) for i, t in enumerate(toks)],
                               "id string, source string, category string, origin long, n_tokens int, max_tokens int")
    b = PL.token_bucket(df)
    s = PL.sample_balanced(b, {"short_chat": 4}).collect()
    assert len(s) == 4 and len({r.id for r in s}) == 4
    assert len({r.n_tokens for r in s}) >= 2
    assert {r.bucket for r in s} == {0, 1, 2, 3}


def test_sample_small_target_and_topup(spark):
    toks = [60, 61, 62, 63, 600, 700]  # two out of range -> bucketless
    df = spark.createDataFrame([(f"id{i}", "s", "short_chat", i, t, 1024) for i, t in enumerate(toks)],
                               "id string, source string, category string, origin long, n_tokens int, max_tokens int")
    s = PL.sample_balanced(PL.token_bucket(df), {"short_chat": 5}).collect()
    assert len(s) == 5 and len({r.id for r in s}) == 5
    s2 = PL.sample_balanced(PL.token_bucket(df), {"short_chat": 2}).collect()
    assert len(s2) == 2


def test_targets():
    t = PL.category_targets(100)
    assert t["short_chat"] == 25 and t["reasoning"] == 5
    assert PL.category_targets(100, only="tool_call") == {"tool_call": 100}
    q = PL.source_quotas(t)
    assert q[("hermes_fc", "tool_call")] == int(60 * 0.55) and q[("swe_smith", "code_generation")] == 30


def test_ws_truncate(spark):
    df = spark.createDataFrame([("a  b\tc\nd e",)], "t string")
    r = df.select(D.ws_truncate(F.col("t"), F.lit(3)).alias("x")).collect()[0].x
    assert r == "a  b\tc"


def test_weights(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("b",)], "category string")
    w = {r.category: r.share for r in PL.normalize_weights(pool, {"a": 0.0, "c": 1.0}).collect()}
    assert w == {"a": 0.5, "b": 0.5}
    w2 = {r.category: r.share for r in PL.normalize_weights(pool, {"a": 1.0, "b": 3.0}).collect()}
    assert w2 == {"a": 0.25, "b": 0.75}


def test_long_doc_token_count_matches_direct_count(spark):
    from conftest import SF01

    from servebench.functions.tokens import ws_tokens
    from servebench.sources import standins as S
    from servebench.specs import LongDocParams

    p = LongDocParams(min_tok=500, max_tok=2000, min_chars=2500, trunc_lo=600, trunc_margin=200, over_margin=50)
    c = D.long_doc_candidates(S.long_docs_df(spark, SF01), p)
    direct = (F.lit(2 + 4 + 1 + 4 + 1) + ws_tokens("system") + ws_tokens("user_content")).cast("int")
    bad = c.filter(F.col("n_tokens") != direct)
    assert c.filter("truncated").count() > 0
    assert bad.count() == 0


def test_first_n_of_any_quota(spark):
    """The first N keys of each group: whole numbers of any size and text, quotas
    within one prefix, beyond the group, and of nothing."""
    import random

    from servebench.functions.selection import first_n

    rnd = random.Random(3)
    keys = {"dense": list(range(-50, 3000)), "wide": sorted({rnd.getrandbits(63) - (1 << 62) for _ in range(2000)}),
            "near": [(5 << 42) + i for i in range(1500)], "none": [1, 2]}
    df = spark.createDataFrame([(g, k, f"{k + (1 << 62):020d}") for g, ks in keys.items() for k in ks], "g string, k long, t string").repartition(3)
    for n in (0, 1, 777, 1500, 4000):
        quotas = {(g,): n for g in ("dense", "wide", "near", "absent")}
        for key in ("k", "t"):
            got = {}
            for r in first_n(df, quotas, ["g"], key).collect():
                got.setdefault(r.g, []).append(r.k)
            assert {g: sorted(v) for g, v in got.items()} == {g: ks[:n] for g, ks in keys.items() if g != "none" and n}
    with pytest.raises(TypeError):
        first_n(df.withColumn("d", F.lit(1.5)), quotas, ["g"], "d")


def test_sample_balanced_against_sort(spark):
    """Targets, buckets and order as a plain sort gives them, also where a bucket runs short."""
    import hashlib
    import random

    rnd = random.Random(4)
    rows = [(f"i{i}", "s", rnd.choice(["short_chat", "reasoning"]), i, rnd.choice([60, 120, 250, 400, 9000]), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, source string, category string, origin long, n_tokens int, max_tokens int")
    targets = {"short_chat": 350, "reasoning": 41}
    b = PL.token_bucket(df)
    got = {c: [r.id for r in sorted(PL.sample_balanced(b, targets).collect(), key=lambda r: r.sample_rank) if r.category == c] for c in targets}
    for c, t in targets.items():
        mine = sorted(((hashlib.md5(f"{r.id}#0".encode()).hexdigest(), r.id, r.bucket) for r in b.collect() if r.category == c))
        picks = [x for bucket in range(4) for x in [y for y in mine if y[2] == bucket][:max(1, t // 4)]]
        top = [x for x in mine if x not in picks][:max(0, t - len(picks))]
        assert got[c] == [x[1] for x in picks + top][:t]


def test_request_plan_follows_weights(spark):
    """Weighted category draw, uniform prompt draw (with replacement)."""
    pool = spark.createDataFrame([(f"{c}{i}", c) for c, n in (("a", 3), ("b", 5), ("c", 2)) for i in range(n)],
                                 "id string, category string")
    shares = PL.normalize_weights(pool, {"a": 0.6, "b": 0.3, "c": 0.1})
    keys = spark.range(0, 20000).withColumnRenamed("id", "request_id")
    plan = PL.request_plan(keys, pool, shares)
    assert plan.count() == 20000
    mix = {r.category: r["count"] / 20000 for r in plan.groupBy("category").count().collect()}
    assert abs(mix["a"] - 0.6) < 0.02 and abs(mix["b"] - 0.3) < 0.02 and abs(mix["c"] - 0.1) < 0.02
    per_prompt = {r.prompt_id: r["count"] for r in plan.filter("category = 'b'").groupBy("prompt_id").count().collect()}
    assert len(per_prompt) == 5 and min(per_prompt.values()) > 0.8 * max(per_prompt.values())
    assert plan.filter("substr(prompt_id, 1, 1) <> category").count() == 0


def test_tool_tokens_space_structure_only(spark):
    texts = ['[{"name":"f","description":"a,b:c \\"d:e\\" ,"}]', "[]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(TO.spaced_json(F.col("t")).alias("s"), TO.tools_tokens(F.col("t")).alias("n")).collect()
    spaced = '[{"name": "f", "description": "a,b:c \\"d:e\\" ,"}]'
    assert [r.s for r in rows] == [spaced, "[]", None]
    assert [r.n for r in rows] == [len(spaced.split()), 1, 0]


def test_call_without_name_and_comma_in_key(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "hello there", None, None), (1, 1, "assistant", "x", None, '{"a,b":1,"c":2}'),
         (1, 2, "user", "later", None, None),
         (2, 0, "user", "hello there", None, None), (2, 1, "assistant", "x", "f", "[1]")],
        "conv_id long, turn int, role string, content string, tc_name string, tc_args string")
    out = {r.conv_id: r for r in TO.cut_at_tool_call(turns, lo=0).collect()}
    assert (out[1].exp_name, out[1].exp_args, out[1].n_messages) == ("", ["a,b", "c"], 1)
    assert (out[2].exp_name, out[2].exp_args) == ("f", [])


def test_transcript_call_that_is_no_object_drops_the_row(spark):
    good = 'ASSISTANT: <functioncall> {"name":"g","arguments":{"k":1}} </functioncall>\n\n'
    df = spark.createDataFrame(
        [(1, None, "USER: a b\n\n" + good), (2, None, 'USER: a b\n\nASSISTANT: <functioncall> [1] </functioncall>\n\nUSER: c\n\n' + good),
         (3, None, "USER: a b\n\nASSISTANT: <functioncall> {x </functioncall>\n\nUSER: c\n\n" + good)],
        "conv_id long, system string, chat string")
    out = {r.conv_id: r.exp_args for r in TO.split_transcript(df, lo=0).collect()}
    assert out == {1: ["k"], 3: ["k"]}


def test_first_turn_knows_unicode_blanks(spark):
    rows = [(1, 0, "user", "one　two three four"), (2, 0, "user", "　"), (2, 1, "user", "now there are words"),
            (3, 0, "user", " two words　")]
    log = spark.createDataFrame(rows, "conv_id long, turn int, role string, content string")
    out = {r.conv_id: (r.first_user, r.n_words) for r in C.first_user_turn(C.conversation_facts(log)).collect()}
    assert out == {1: (rows[0][3], 4), 2: ("now there are words", 4)}


def test_ws_truncate_cuts_at_the_nth_token(spark):
    import re

    texts = ["a  b\tc\n\nd e ", "  lead and more", "one", "", " \n", "x\x01y z\x01 w", "é ü  ö\u00a0k l", "t " * 500]
    for n in (0, 1, 2, 3, 7):
        df = spark.createDataFrame([(i, t, n) for i, t in enumerate(texts)], "i int, t string, n int")
        for r in df.select("t", D.ws_truncate(F.col("t"), F.col("n")).alias("got")).collect():
            runs = re.findall(r"[^ \t\n\r\f\v]+[ \t\n\r\f\v]*", r.t)
            assert r.got == "".join(runs[:n]).rstrip(" \t\n\r\f\v")


def test_long_documents_ask_the_task_of_their_part(spark):
    p = LongDocParams(min_tok=5, max_tok=60, min_chars=5, trunc_lo=10, trunc_margin=20)
    rows = [(1, "longbench", "gov_report", "q?"), (2, "longbench", "multi_news", "q?"), (3, "longbench", "other", "q?"),
            (4, "longbench", None, "q?"), (5, "longbench", "gov_report", None), (6, "scrolls", "gov_report", None),
            (7, "scrolls", "narrative_qa", None), (8, "scrolls", "qmsum", None), (9, "govreport", "qmsum", None)]
    docs = spark.createDataFrame([(i, s, c, q, "some words here", 15) for i, s, c, q in rows],
                                 "doc_id long, source_name string, config string, question string, text string, n_chars int")
    got = D.long_doc_candidates(docs, p, config_col="config")
    asked = {r.doc_id: r.user_content.split("\n\n---\n\n")[1] for r in got.collect()}
    report = "Please provide a comprehensive summary of the above government report."
    assert asked == {1: "Please provide a comprehensive summary of the above report.",
                     2: "Based on the articles above, write a multi-document summary.",
                     3: "Based on the above, q?", 4: "Based on the above, q?", 6: report,
                     7: "Based on the above text, please answer the question.",
                     8: "Summarize the key points from the above meeting transcript.", 9: asked[9]}
    assert "qmsum" not in asked[9] and asked[9] != asked[8]
    plain = {r.doc_id: r.user_content for r in D.long_doc_candidates(docs, p).collect()}
    assert plain[1].endswith("Based on the above, q?") and plain[8].endswith(report)


def test_a_text_is_counted_once_however_often_its_count_is_used(spark):
    from servebench.operators.curate import documents as D
    from servebench.specs import LongDocParams

    p = LongDocParams(min_tok=5, max_tok=60, min_chars=1, trunc_lo=10, trunc_margin=5, over_margin=5)
    rows = [(k, " ".join(f"w{i}" for i in range(n)), n * 3, s, "why?") for k, (n, s) in enumerate(
        [(3, "govreport"), (20, "govreport"), (200, "pg19"), (40, "scrolls"), (80, "longbench"), (30, "longbench_v2")])] + [(9, None, 0, "pg19", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source_name string, question string")
    out = D.long_doc_prompts(D.long_doc_candidates(docs, p), p).select("doc_id", "n_tokens", "truncated")
    assert out.count() > 0 and all(5 <= r.n_tokens <= 60 for r in out.collect())
    problems = docs.selectExpr("doc_id", "repeat(text, 40) as text", "array('1') as inputs", "array('2') as outputs")
    for df, most in ((out, 8), (D.math_prompts(docs, lo=1), 8), (D.code_prompts(problems).select("doc_id", "n_tokens"), 8)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate inline" in plan
        assert plan.count("regexp_extract_all(") <= most, plan
