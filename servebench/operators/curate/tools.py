"""Tool definitions and function-calling conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.tokens import PER_MESSAGE_TOKENS, REPLY_PRIMING_TOKENS, token_count
from ..wire import json_object_valid, json_valid, strip_ws
from .common import within

# String values, separators, and the runs between them.
JSON_PIECES = r'"(?:[^"\\]++|\\.)*+"|[,:]|[^",:]++'
WRAP_PREFIX = '{"type":"function","function":'


def parse_tool_list(c: Column | str) -> Column:
    """Elements of a JSON list as JSON text; non-lists and bad JSON give an
    empty list (E9)."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>"),
                      F.array().cast("array<string>"))


def normalize_tool(e: Column) -> Column:
    """One tool element in the function-tool shape, or NULL to drop it (E8):
    full form kept; a bare ``{name, ...}`` wrapped; a ``{function}`` without
    type completed; anything else (strings, ``{}``) dropped."""
    keys = F.json_object_keys(e)
    is_obj = keys.isNotNull()
    has_fn = F.coalesce(F.array_contains(keys, "function"), F.lit(False))
    has_name = F.coalesce(F.array_contains(keys, "name"), F.lit(False))
    typ = F.get_json_object(e, "$.type")
    return (F.when(is_obj & (typ == "function") & has_fn, e)
            .when(is_obj & has_name, F.concat(F.lit(WRAP_PREFIX), e, F.lit("}")))
            .when(is_obj & has_fn, F.concat(F.lit(WRAP_PREFIX), F.get_json_object(e, "$.function"), F.lit("}"))))


def normalize_tools(df: DataFrame, col: str = "tools_json", key: str = "row_id") -> DataFrame:
    """Normalised tool list per row, order kept, with its JSON text."""
    tools = F.filter(F.transform(parse_tool_list(col), normalize_tool), lambda x: x.isNotNull())
    return df.select(key, tools.alias("tools")).select(
        key, "tools", F.size("tools").alias("n_tools"),
        F.when(F.size("tools") > 0, F.concat(F.lit("["), F.array_join("tools", ","), F.lit("]"))).alias("tools_text"))


def spaced_json(text: Column) -> Column:
    """Compact JSON text with a space after each structural ``,`` and ``:``."""
    pieces = F.regexp_extract_all(text, F.lit(JSON_PIECES), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.isin(",", ":"), F.concat(p, F.lit(" "))).otherwise(p)), "")


def expected_args(args: Column) -> Column:
    """Argument names of a call; none when its text is not a JSON object."""
    return F.when(json_object_valid(args), F.json_object_keys(args)).otherwise(F.array().cast("array<string>"))


def tools_tokens(tools_text: Column, counter: str = "ws") -> Column:
    """Tokens of the tool list, spaced as a default JSON dump: a space after
    each ``,`` and ``:`` between values, none inside string values."""
    return F.coalesce(token_count(spaced_json(tools_text), counter), F.lit(0))


def has_call() -> Column:
    """An assistant turn carrying a tool call, named or not."""
    return (F.col("role") == "assistant") & (F.col("tc_name").isNotNull() | F.col("tc_args").isNotNull())


def cut_at_tool_call(turns: DataFrame, tools: DataFrame | None = None, key: str = "conv_id",
                     order: str = "turn", lo: int = 100, hi: int = 16000, require_tools: Column | None = None,
                     counter: str = "ws") -> DataFrame:
    """Prompt = messages before the first assistant turn carrying a tool call
    (E5).  ``turns`` has ``role``, ``content``, ``tc_name``, ``tc_args``
    (both NULL when the turn has no call; a call may lack either).

    The cut position and the expectation are per-conversation aggregates;
    the prompt's message count and tokens are a second aggregate over the
    turns before the cut.  Kept: system/user/assistant turns with content;
    at least one user turn; tool-JSON tokens added; ``lo <= tokens <= hi``.
    The expectation is the first call's name and argument keys (bad JSON or
    a non-object gives no keys; a missing name is empty); no call gives no
    expectation.
    """
    role = F.col("role")
    is_tc = has_call()
    cut = turns.groupBy(key).agg(
        F.min(F.when(is_tc, F.col(order))).alias("_cut"),
        F.min_by(F.when(is_tc, F.coalesce("tc_name", F.lit(""))), F.when(is_tc, F.col(order))).alias("exp_name"),
        F.min_by(F.when(is_tc, F.col("tc_args")), F.when(is_tc, F.col(order))).alias("_exp_args"))
    keep = role.isin("system", "user", "assistant") & (F.length("content") > 0)
    before = (turns.join(cut.select(key, "_cut"), key)
              .filter(keep & (F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))))
    agg = before.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(role == "user").alias("_n_user"),
        F.sum(F.lit(PER_MESSAGE_TOKENS) + token_count(role, counter) + token_count("content", counter)).alias("_tok"))
    j = agg.join(cut, key)
    if tools is not None:
        j = j.join(tools.select(key, "n_tools", "tools_text"), key, "left")
    else:
        j = j.withColumn("n_tools", F.lit(0)).withColumn("tools_text", F.lit(None).cast("string"))
    n_tools = F.coalesce("n_tools", F.lit(0))
    tok = (F.lit(REPLY_PRIMING_TOKENS) + F.col("_tok")
           + F.when(n_tools > 0, tools_tokens(F.col("tools_text"), counter)).otherwise(F.lit(0))).cast("int")
    req = F.when(F.col("exp_name").isNotNull(), expected_args(F.col("_exp_args")))
    cond = (F.col("n_messages") > 0) & (F.col("_n_user") > 0) & within(tok, lo, hi)
    if require_tools is not None:
        cond = cond & (~require_tools | (n_tools > 0))
    return j.select("*", tok.alias("n_tokens"), req.alias("exp_args"), n_tools.alias("_nt")).filter(cond).select(
        key, "n_messages", F.col("_nt").alias("n_tools"), "n_tokens", "exp_name", "exp_args")


def tool_prompt_messages(turns: DataFrame, chosen: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Prompt message lists (turns before the first tool call) of the chosen
    conversations, collected only for those keys."""
    role = F.col("role")
    t = turns.join(chosen.select(key), key, "left_semi")
    is_tc = has_call()
    cut = t.groupBy(key).agg(F.min(F.when(is_tc, F.col(order))).alias("_cut"))
    keep = role.isin("system", "user", "assistant") & (F.length("content") > 0)
    before = t.join(cut, key).filter(keep & (F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), role.alias("role"),
                                                 F.col("content").alias("content"))))
    return before.groupBy(key).agg(parts.alias("_m")).select(
        key, F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        .alias("messages"))


def tool_structs(tools: Column) -> Column:
    """Normalised tool JSON texts as ``struct<type, function>`` (function
    kept as JSON text: its schema is open)."""
    return F.transform(tools, lambda e: F.struct(F.get_json_object(e, "$.type").alias("type"),
                                                 F.get_json_object(e, "$.function").alias("function")))


# FIXED VALUES: role names of the raw function-calling format.
RAW_ROLES = {"system": "system", "human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant"}
TOOL_TAG = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"


def map_raw_roles(c: Column) -> Column:
    out = None
    for raw, role in RAW_ROLES.items():
        out = (F.when(c == raw, F.lit(role)) if out is None else out.when(c == raw, F.lit(role)))
    return out


def cut_at_tool_tag(turns: DataFrame, tools: DataFrame | None = None, key: str = "conv_id", order: str = "turn",
                    lo: int = 100, hi: int = 16000, counter: str = "ws") -> DataFrame:
    """Raw ``from/value`` conversations (E6): ``human`` -> user, ``gpt`` ->
    assistant; the first assistant value holding a ``<tool_call>{...}
    </tool_call>`` block ends the prompt, even when its JSON is bad (then no
    expectation).  A call whose ``arguments`` is present but not an object
    drops the conversation.  Then as :func:`cut_at_tool_call`."""
    role = map_raw_roles(F.col("from"))
    value = F.col("value")
    nonempty = F.length(value) > 0
    tagged = nonempty & (role == "assistant") & value.rlike(TOOL_TAG)
    t = turns.select(key, order, role.alias("role"), value.alias("content"),
                     F.when(tagged, F.regexp_extract(value, TOOL_TAG, 1)).alias("_tc"))
    cut = t.groupBy(key).agg(F.min(F.when(F.col("_tc").isNotNull(), F.col(order))).alias("_cut"),
                             F.min_by("_tc", F.when(F.col("_tc").isNotNull(), F.col(order))).alias("_tc"))
    before = (t.drop("_tc").join(cut.select(key, "_cut"), key)
              .filter(F.col("role").isNotNull() & (F.length("content") > 0)
                      & (F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))))
    agg = before.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("_n_user"),
        F.sum(F.lit(PER_MESSAGE_TOKENS) + token_count("role", counter) + token_count("content", counter)).alias("_tok"))
    j = agg.join(cut, key)
    if tools is not None:
        j = j.join(tools.select(key, "n_tools", "tools_text"), key, "left")
    else:
        j = j.withColumn("n_tools", F.lit(0)).withColumn("tools_text", F.lit(None).cast("string"))
    n_tools = F.coalesce("n_tools", F.lit(0))
    tok = (F.lit(REPLY_PRIMING_TOKENS) + F.col("_tok")
           + F.when(n_tools > 0, tools_tokens(F.col("tools_text"), counter)).otherwise(F.lit(0))).cast("int")
    tc = F.col("_tc")
    ok_json = tc.isNotNull() & json_object_valid(tc)
    args = F.get_json_object(tc, "$.arguments")
    has_args = F.array_contains(F.coalesce(F.json_object_keys(tc), F.array().cast("array<string>")), "arguments")
    args_obj = json_object_valid(args)
    exp_name = F.when(ok_json, F.coalesce(F.get_json_object(tc, "$.name"), F.lit("")))
    exp_args = F.when(ok_json, expected_args(args))
    dropped = ok_json & has_args & ~F.coalesce(args_obj, F.lit(False))
    cond = (F.col("n_messages") > 0) & (F.col("_n_user") > 0) & within(tok, lo, hi) & ~dropped
    return j.select("*", tok.alias("n_tokens"), exp_name.alias("exp_name"), exp_args.alias("exp_args"),
                    n_tools.alias("_nt"), cond.alias("_ok")).filter("_ok").select(
        key, "n_messages", F.col("_nt").alias("n_tools"), "n_tokens", "exp_name", "exp_args")


# FIXED VALUES: transcript markers and the end markers of a call, in the
# order they are tried.
USER_MARK = "USER: "
ASSISTANT_MARK = "ASSISTANT: "
CALL_MARK = "<functioncall>"
CALL_END_MARKERS = ("</functioncall>", "</", "\n\n", "\nFUNCTION")
BRACKET_SPAN = r"(\[[\s\S]*?\])"


def _after(c: Column, mark: str) -> Column:
    return F.substring(c, F.instr(c, mark) + len(mark), 1 << 30)


def transcript_tools(system: Column) -> Column:
    """Tool list from a system text: the first bracketed span (shortest
    match) that parses to a non-empty list whose first item mentions
    ``name``; a span that does not parse ends the search with no tools."""
    spans = F.regexp_extract_all(F.coalesce(system, F.lit("")), F.lit(BRACKET_SPAN), 1)
    bad = F.array_position(F.transform(spans, lambda s: F.try_parse_json(s).isNull()), True)
    good = F.array_position(F.transform(spans, lambda s: F.coalesce(
        F.from_json(s, "array<string>")[0].contains("name"), F.lit(False))), True)
    pick = F.when((good > 0) & ((bad == 0) | (good < bad)), F.element_at(spans, good.cast("int")))
    return F.when(pick.isNotNull(), F.filter(F.transform(parse_tool_list(pick), normalize_tool), lambda x: x.isNotNull()))


def split_transcript(transcripts: DataFrame, key: str = "conv_id", lo: int = 100, hi: int = 16000,
                     counter: str = "ws") -> DataFrame:
    """``USER: ... ASSISTANT: ...`` transcripts -> tool-call prompts.

    The chat is split on the user marker (one row per part, ``posexplode``).
    The first part whose assistant text holds a parseable call ends the
    prompt, and drops the transcript when the call is no object; the call
    text runs to the first end marker present (tried in order) and is
    retried with single quotes turned double.  Earlier parts
    with an unparseable call keep their user turn but lose the assistant
    turn.  Only transcripts with a call are kept; tool tokens are not counted.
    """
    parts = transcripts.select(key, "system", F.posexplode(F.split("chat", USER_MARK, -1)).alias("pos", "part")) \
        .filter("pos >= 1")
    part = F.col("part")
    has_a = F.instr(part, ASSISTANT_MARK) > 0
    user = strip_ws(F.when(has_a, F.substring_index(part, ASSISTANT_MARK, 1)).otherwise(part))
    rest = F.when(has_a, _after(part, ASSISTANT_MARK))
    has_fc = F.coalesce(rest.contains(CALL_MARK), F.lit(False))
    fc = _after(rest, CALL_MARK)
    cut = None
    for m in CALL_END_MARKERS:
        cut = (F.when(fc.contains(m), F.substring_index(fc, m, 1)) if cut is None
               else cut.when(fc.contains(m), F.substring_index(fc, m, 1)))
    fc_s = strip_ws(cut.otherwise(fc))
    fc_q = F.regexp_replace(fc_s, "'", '"')
    parsed = F.when(has_fc & json_valid(fc_s), fc_s).when(has_fc & json_valid(fc_q), fc_q)
    p = parts.select(key, "system", "pos", user.alias("user"), has_a.alias("has_a"), has_fc.alias("has_fc"),
                     strip_ws(rest).alias("assistant"), parsed.alias("call"))
    first = p.groupBy(key).agg(F.min(F.when(F.col("call").isNotNull(), F.col("pos"))).alias("_cut"),
                               F.min_by("call", F.when(F.col("call").isNotNull(), F.col("pos"))).alias("call"),
                               F.first("system").alias("system"))
    first = first.filter(json_object_valid("call"))
    msg_tok = F.lit(PER_MESSAGE_TOKENS) + token_count(F.lit("user"), counter) + token_count("user", counter)
    asst_tok = F.when(F.col("has_a") & ~F.col("has_fc"),
                      F.lit(PER_MESSAGE_TOKENS) + token_count(F.lit("assistant"), counter)
                      + token_count("assistant", counter)).otherwise(F.lit(0))
    upto = p.drop("system", "call").join(first.select(key, "_cut"), key).filter(F.col("pos") <= F.col("_cut"))
    is_cut = F.col("pos") == F.col("_cut")
    agg = upto.groupBy(key).agg(
        F.sum(msg_tok + F.when(is_cut, F.lit(0)).otherwise(asst_tok)).alias("_tok"),
        F.sum(F.lit(1) + F.when(~is_cut & F.col("has_a") & ~F.col("has_fc"), F.lit(1)).otherwise(F.lit(0)))
        .alias("_n"))
    sysv = F.col("system")
    has_sys = sysv.isNotNull() & (F.length(sysv) > 0)
    sys_tok = F.when(has_sys, F.lit(PER_MESSAGE_TOKENS) + token_count(F.lit("system"), counter)
                     + token_count(sysv, counter)).otherwise(F.lit(0))
    j = agg.join(first, key)
    tok = (F.lit(REPLY_PRIMING_TOKENS) + F.col("_tok") + sys_tok).cast("int")
    call = F.col("call")
    args = F.get_json_object(call, "$.arguments")
    tools = transcript_tools(sysv)
    out = j.select(key, (F.col("_n") + F.when(has_sys, 1).otherwise(0)).cast("bigint").alias("n_messages"),
                   tok.alias("n_tokens"), F.coalesce(F.get_json_object(call, "$.name"), F.lit("")).alias("exp_name"),
                   expected_args(args).alias("exp_args"),
                   F.coalesce(F.size(tools), F.lit(0)).cast("int").alias("n_tools"))
    return out.filter(within(F.col("n_tokens"), lo, hi))
