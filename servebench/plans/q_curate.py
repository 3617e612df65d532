"""Corpus-curation queries (E1-E26) over stand-in corpora.

The supplied conversations and documents are far shorter than real prompt
corpora, so the chat queries run the category spec with every token bound
scaled by 1/10, and the long-document queries use 500/2000 tokens; the logic
is the full-scale logic with those parameters.  Targets follow the reference
rule ``max(1, int(total * weight))`` with ``total`` = number of conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.curate import chat as C
from ..operators.curate import documents as D
from ..operators.curate import tools as TO
from ..sources import standins as S
from ..specs import (CATEGORY_SPECS, FETCH_OVERSHOOT, MATH_SYSTEM, REASONING_KEYWORDS, LongDocParams,
                     scaled_specs)
from ..catalog_support import materialize
from .catalog import register

_MEMO: dict = {}


def _memo(kind: str, spark, sf_dir, build):
    """Reuse a materialised stage within one session (its checkpoint files
    live as long as the session)."""
    k = (kind, id(spark), spark.sparkContext.applicationId, sf_dir)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


LANGS = ("en",)
CHAT_SPECS = scaled_specs(0.1)
# The pool's buckets follow the bounds its prompts are cut at.
POOL_SPECS = CATEGORY_SPECS | {c: CHAT_SPECS[c] for c in ("short_chat", "medium_chat", "multi_turn")} | {
    "long_context": dict(CATEGORY_SPECS["long_context"], buckets=[(500, 800), (800, 1200), (1200, 1600), (1600, 2001)])}
LONG = LongDocParams(min_tok=500, max_tok=2000, min_chars=2500, trunc_lo=600, trunc_margin=200, over_margin=50)


def ws(expr: str) -> str:
    """DuckDB text of the ``ws`` token count."""
    return f"len(regexp_extract_all({expr}, '\\S+'))"


def words_sql(expr: str) -> str:
    """DuckDB text of the word count over all Unicode blanks."""
    return f"len(regexp_extract_all({expr}, '[^{C.BLANKS}]+'))"


def blank_sql(expr: str) -> str:
    return f"trim({expr}, '{C.BLANKS}')"


def spaced_sql(expr: str) -> str:
    """DuckDB text of compact JSON spaced as a default dump."""
    return (f"""array_to_string(list_transform(regexp_extract_all({expr}, '"(?:[^"\\\\]|\\\\.)*"|[,:]|[^",:]+'), """
            "lambda p: case when p in (',', ':') then p || ' ' else p end), '')")


WS_SQL = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def total_prompts(spark, sf_dir) -> int:
    """Pool size of the stand-in build: one prompt per conversation."""
    return S.table(spark, sf_dir, "conversations").select("conv_id").distinct().count()


def targets_for(total: int, specs=CATEGORY_SPECS) -> dict:
    return {c: max(1, int(total * s["weight"])) for c, s in specs.items()}


TOTAL_SQL = "(select count(distinct conv_id) from conversations)"


def target_sql(cat: str) -> str:
    w = CATEGORY_SPECS[cat]["weight"]
    return f"greatest(1, cast(floor({TOTAL_SQL} * cast({w!r} as double)) as bigint))"


# ---------------------------------------------------------------------------
# Chat (E1-E4)
# ---------------------------------------------------------------------------

def chat_facts(spark, sf_dir):
    return C.conversation_facts(S.chat_log_df(spark, sf_dir))


_FACTS_SQL = f"""
, facts as (
  select conv_id, count(*) as n_turns, max(lang) as lang, max(coalesce(toxic, 0)) as toxic,
    arg_min({blank_sql('content')}, turn) filter (where role = 'user' and length({blank_sql('content')}) > 0) as first_user,
    count(*) filter (where role in ('user', 'assistant') and length({blank_sql('content')}) > 0) as n_mt,
    cast(2 + coalesce(sum(4 + {ws('role')} + {ws('content')})
         filter (where role in ('user', 'assistant') and length({blank_sql('content')}) > 0), 0) as int) as mt_tokens
  from chat_log group by conv_id)
, passing as (
  select *, {words_sql('first_user')} as n_words, {ws('first_user')} as text_tok, 2 + 4 + 1 + {ws('first_user')} as single_tok
  from facts
  where (lang is null or lang in ('en')) and n_turns > 0 and toxic = 0
    and first_user is not null and {words_sql('first_user')} >= 3)
"""


@register("chat_eligible", S.duck_with("chat_log") + _FACTS_SQL + """
select conv_id, n_turns from facts where (lang is null or lang in ('en')) and n_turns > 0 and toxic = 0
""")
def q_chat_eligible(spark, sf_dir):
    f = chat_facts(spark, sf_dir)
    return f.filter(C.chat_eligible(f, LANGS)).select("conv_id", "n_turns")


@register("first_user_turn", S.duck_with("chat_log") + _FACTS_SQL + """
select conv_id, first_user, cast(n_words as int) as n_words, cast(single_tok as int) as single_tok from passing
""")
def q_first_user_turn(spark, sf_dir):
    p = C.first_user_turn(chat_facts(spark, sf_dir), LANGS)
    return p.select("conv_id", "first_user", "n_words", "single_tok")


def passing_turns(spark, sf_dir):
    """First user turns of eligible conversations (one row per conversation),
    materialised once: routing evaluates several cut-offs over it."""
    return _memo("passing", spark, sf_dir,
                 lambda: materialize(C.first_user_turn(chat_facts(spark, sf_dir), LANGS)))


def _route(spark, sf_dir):
    total = _memo("total", spark, sf_dir, lambda: total_prompts(spark, sf_dir))
    fetch = {c: FETCH_OVERSHOOT * t for c, t in targets_for(total).items()}
    return C.route_chat(passing_turns(spark, sf_dir), fetch, specs=CHAT_SPECS)


def _kw_sql(expr: str) -> str:
    return "(" + " or ".join(f"contains(lower({expr}), '{k}')" for k in REASONING_KEYWORDS) + ")"


_S, _M, _R, _MT = (CHAT_SPECS[c] for c in ("short_chat", "medium_chat", "reasoning", "multi_turn"))
_ROUTE_SQL = _FACTS_SQL + f"""
, tg as (select 3 * {target_sql('short_chat')} as ts, 3 * {target_sql('medium_chat')} as tm,
           3 * {target_sql('reasoning')} as tr, 3 * {target_sql('multi_turn')} as tmt)
, base as (select p.* from (select *, row_number() over (order by conv_id) as rn from passing) p)
, s as (select conv_id from (select conv_id, row_number() over (order by conv_id) as r from base
        where text_tok between {_S['min_tok']} and {_S['max_tok']}) x, tg where r <= ts)
, m as (select conv_id from (select conv_id, row_number() over (order by conv_id) as r from base
        where text_tok > {_M['min_tok']} and text_tok <= {_M['max_tok']}) x, tg where r <= tm)
, rs as (select conv_id from (select conv_id, row_number() over (order by conv_id) as r from base
         where text_tok between {_R['min_tok']} and {_R['max_tok']} and {_kw_sql('first_user')}
           and conv_id not in (select conv_id from s) and conv_id not in (select conv_id from m)) x, tg where r <= tr)
, routed as (
  select b.conv_id, case when s.conv_id is not null then 'short_chat' when m.conv_id is not null then 'medium_chat'
                         else 'reasoning' end as category, b.first_user, b.text_tok, b.single_tok as n_tokens
  from base b left join s on b.conv_id = s.conv_id left join m on b.conv_id = m.conv_id
  left join rs on b.conv_id = rs.conv_id
  where s.conv_id is not null or m.conv_id is not null or rs.conv_id is not null)
, mt as (select conv_id, 'multi_turn' as category, n_mt as n_messages, mt_tokens as n_tokens
         from (select *, row_number() over (order by conv_id) as r from base
               where n_turns >= 5 and n_mt >= 5 and mt_tokens between {_MT['min_tok']} and {_MT['max_tok']}) x, tg
         where r <= tmt)
"""


@register("route_chat", S.duck_with("chat_log") + _ROUTE_SQL + """
select conv_id, category, cast(text_tok as int) as text_tok, cast(n_tokens as int) as n_tokens from routed
""")
def q_route_chat(spark, sf_dir):
    routed, _ = _route(spark, sf_dir)
    return routed.select("conv_id", "category", "text_tok", "n_tokens")


@register("multi_turn", S.duck_with("chat_log") + _ROUTE_SQL + """
select conv_id, category, n_messages, n_tokens from mt
""")
def q_multi_turn(spark, sf_dir):
    _, multi = _route(spark, sf_dir)
    return multi


# ---------------------------------------------------------------------------
# Tools (E5, E8, E9)
# ---------------------------------------------------------------------------

_NORM_SQL = """
, el as (select row_id, case when json_valid(tools_json) and try(json_type(tools_json)) = 'ARRAY'
                             then json_extract(tools_json, '$[*]') else [] end as els from tool_defs)
, nt as (select row_id, list_filter(list_transform(els, lambda e:
           case when try(json_type(e)) <> 'OBJECT' then null
                when json_extract_string(e, '$.type') = 'function' and json_exists(e, '$.function') then cast(e as varchar)
                when json_exists(e, '$.name') then concat('{"type":"function","function":', cast(e as varchar), '}')
                when json_exists(e, '$.function')
                  then concat('{"type":"function","function":', cast(json_extract(e, '$.function') as varchar), '}')
           end), lambda x: x is not null) as tools from el)
, ntools as (select row_id, tools, cast(len(tools) as int) as n_tools,
               case when len(tools) > 0 then concat('[', array_to_string(tools, ','), ']') end as tools_text from nt)
"""


@register("normalize_tools", S.duck_with("tool_defs") + _NORM_SQL + """
select row_id, n_tools, tools_text from ntools
""")
def q_normalize_tools(spark, sf_dir):
    return TO.normalize_tools(S.tool_defs_df(spark, sf_dir)).select("row_id", "n_tools", "tools_text")


@register("tool_prompts", S.duck_with("fc_turns", "tool_defs") + _NORM_SQL + f"""
, cut as (select conv_id, min(turn) filter (where role = 'assistant' and tc_args is not null) as cut_at,
            arg_min(coalesce(tc_name, ''), turn) filter (where role = 'assistant' and tc_args is not null) as exp_name,
            arg_min(tc_args, turn) filter (where role = 'assistant' and tc_args is not null) as exp_args_raw,
            max(source) as source
          from fc_turns group by conv_id)
, pre as (select f.conv_id, count(*) as n_messages, count(*) filter (where f.role = 'user') as n_user,
            sum(4 + {ws('f.role')} + {ws('f.content')}) as tok
          from fc_turns f join cut c on f.conv_id = c.conv_id
          where f.role in ('system', 'user', 'assistant') and length(f.content) > 0
            and (c.cut_at is null or f.turn < c.cut_at)
          group by f.conv_id)
, j as (select p.conv_id, p.n_messages, p.n_user, c.source, c.exp_name, c.exp_args_raw,
          coalesce(t.n_tools, 0) as n_tools,
          cast(2 + p.tok + case when coalesce(t.n_tools, 0) > 0
               then {ws(spaced_sql('t.tools_text'))} else 0 end as int) as n_tokens
        from pre p join cut c on p.conv_id = c.conv_id left join ntools t on t.row_id = p.conv_id)
select conv_id, cast(n_messages as bigint) as n_messages, n_tools, n_tokens, exp_name,
  case when exp_name is null then null
       when json_valid(exp_args_raw) and try(json_type(exp_args_raw)) = 'OBJECT'
         then cast(to_json(json_keys(exp_args_raw)) as varchar) else '[]' end as exp_args
from j where n_messages > 0 and n_user > 0 and n_tokens between 100 and 16000
  and (source <> 'toolace' or n_tools > 0)
""")
def q_tool_prompts(spark, sf_dir):
    turns = S.fc_turns_df(spark, sf_dir)
    tools = TO.normalize_tools(S.tool_defs_df(spark, sf_dir)).withColumnRenamed("row_id", "conv_id")
    src = turns.groupBy("conv_id").agg(F.max("source").alias("source"))
    out = TO.cut_at_tool_call(turns, tools, lo=100, hi=16000)
    return (out.join(src, "conv_id").filter((F.col("source") != "toolace") | (F.col("n_tools") > 0))
            .select("conv_id", "n_messages", "n_tools", "n_tokens", "exp_name", F.to_json("exp_args").alias("exp_args")))


# ---------------------------------------------------------------------------
# Documents
# ---------------------------------------------------------------------------

@register("math_prompts", f"""
select doc_id, n_tokens from (
  select doc_id, cast(2 + 4 + 1 + {len(MATH_SYSTEM.split())}
         + 4 + 1 + {ws('text')} as int) as n_tokens
  from documents where length(text) > 0 and {ws('text')} >= 10) x
where n_tokens between 100 and 4000
""")
def q_math_prompts(spark, sf_dir):
    return D.math_prompts(S.table(spark, sf_dir, "documents"))


def _long_sql(final: str) -> str:
    from ..specs import LONG_DOC_SOURCES

    rows = ", ".join(
        "('{}', '{}', {}, {}, {}, {})".format(
            s["source"], s["system"], f"'{s['suffix']}'" if s["suffix"] else "null",
            f"'{s['question_prefix']}'" if s["question_prefix"] else "null",
            "true" if s["min_chars"] else "false", "true" if s["precheck"] else "false")
        for s in LONG_DOC_SOURCES)
    mx = LONG.max_tok
    lo, hi = LONG.trunc_lo, LONG.max_tok - LONG.trunc_margin
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return S.duck_with("long_docs") + f"""
, spec as (select * from (values {rows}) t(source_name, system, suffix, question_prefix, min_chars, precheck))
, d as (select l.*, s.system, s.suffix, s.question_prefix, s.min_chars, s.precheck, {ws('l.text')} as text_tok
        from long_docs l join spec s on l.source_name = s.source_name
        where length(l.text) > 0 and (not s.min_chars or l.n_chars >= {LONG.min_chars})
          and (s.question_prefix is null or length(l.question) > 0))
, c as (select *, text_tok > {mx - LONG.over_margin} as truncated,
          cast({lo} + (cast('0x' || substring(md5(concat(source_name, ':', cast(doc_id as varchar))), 1, 15) as bigint)
               % {hi - lo + 1}) as int) as n_draw
        from d where text_tok > {mx - LONG.over_margin} or not precheck or text_tok >= {LONG.min_tok - LONG.over_margin})
, b as (select *, case when truncated then n_draw end as n_keep,
          case when truncated then regexp_replace(array_to_string(list_slice(regexp_extract_all(text, '(\\S+\\s*)', 1), 1, n_draw), ''), '\\s+$', '')
               else text end as body from c)
, u as (select *, case when question_prefix is null then body || {sep} || suffix
                       else body || {sep} || question_prefix || question end as user_content from b)
, t as (select *, cast(2 + 4 + 1 + {ws('system')} + 4 + 1 + {ws('user_content')} as int) as n_tokens from u)
{final}
"""


@register("long_doc_prompts", _long_sql(f"""
select doc_id, source_name, truncated, n_tokens, md5(user_content) as content_md5 from t
where n_tokens between {LONG.min_tok} and {LONG.max_tok}
"""))
def q_long_doc_prompts(spark, sf_dir):
    c = D.long_doc_candidates(S.long_docs_df(spark, sf_dir), LONG)
    return D.long_doc_prompts(c, LONG).select("doc_id", "source_name", "truncated", "n_tokens",
                                              F.md5("user_content").alias("content_md5"))


@register("truncate_docs", _long_sql(f"""
select doc_id, source_name, n_keep, cast({ws('body')} as int) as kept_tokens, md5(body) as body_md5 from t where truncated
"""))
def q_truncate_docs(spark, sf_dir):
    c = D.long_doc_candidates(S.long_docs_df(spark, sf_dir), LONG)
    return c.filter("truncated").select("doc_id", "source_name", "n_keep",
                                        F.regexp_count("body", F.lit(r"\S+")).cast("int").alias("kept_tokens"),
                                        F.md5("body").alias("body_md5"))


def _code_sql() -> str:
    from ..specs import CODE_SYSTEM

    nl = "chr(10)"
    return S.duck_with("code_problems") + f"""
, x as (select doc_id, text, inputs, outputs, least(len(inputs), len(outputs), 3) as n from code_problems
        where length(text) >= 100)
, u as (select doc_id, n, text
          || case when len(inputs) > 0 and len(outputs) > 0 then {nl} || {nl} || 'Examples:' ||
               array_to_string(list_transform(range(1, n + 1), lambda i:
                 {nl} || {nl} || 'Input:' || {nl} || inputs[i] || {nl} || 'Output:' || {nl} || outputs[i]), '')
             else '' end
          || {nl} || {nl} || 'Provide an efficient solution in Python with clear comments.' as user_content
        from x)
select doc_id, cast(n as int) as n_examples, n_tokens, md5(user_content) as content_md5 from (
  select *, cast(2 + 4 + 1 + {len(CODE_SYSTEM.split())} + 4 + 1 + {ws('user_content')} as int) as n_tokens from u) y
where n_tokens between 500 and 8000
"""


@register("code_prompts", _code_sql())
def q_code_prompts(spark, sf_dir):
    out = D.code_prompts(S.code_problems_df(spark, sf_dir))
    return out.select("doc_id", "n_examples", "n_tokens", F.md5("user_content").alias("content_md5"))


def _traj_sql() -> str:
    from ..specs import TRAJECTORY_FOLLOW_UP

    follow = 4 + 1 + len(TRAJECTORY_FOLLOW_UP.split())
    return f"""
with f6 as (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)
, sizes as (select conv_id, count(*) as n_raw from conversations group by conv_id)
, a as (select conv_id, count(*) as n, arg_max(role, turn) as last_role,
          sum(4 + {ws('role')} + {ws('text')}) as tok
        from f6 where rn <= 6 and role in ('system', 'user', 'assistant') and length(text) > 0 group by conv_id)
, j as (select a.*, s.n_raw, last_role <> 'user' as appended from a join sizes s on a.conv_id = s.conv_id
        where s.n_raw >= 2)
select conv_id, n + case when appended then 1 else 0 end as n_messages, appended,
  cast(2 + tok + case when appended then {follow} else 0 end as int) as n_tokens
from j where 2 + tok + case when appended then {follow} else 0 end between 500 and 8000
"""


@register("trajectory_prompts", _traj_sql())
def q_trajectory_prompts(spark, sf_dir):
    turns = S.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    return D.trajectory_prompts(turns)


# ---------------------------------------------------------------------------
# Pool assembly
# ---------------------------------------------------------------------------

from ..catalog_support import inner, materialize  # noqa: E402
from ..operators.curate import pool as PL  # noqa: E402
from ..specs import SOURCE_SHARES  # noqa: E402

_MAX_TOKENS = {c: s["max_tokens"] for c, s in CATEGORY_SPECS.items()}


def _tool_prompts_df(spark, sf_dir):
    turns = S.fc_turns_df(spark, sf_dir)
    tools = TO.normalize_tools(S.tool_defs_df(spark, sf_dir)).withColumnRenamed("row_id", "conv_id")
    src = turns.groupBy("conv_id").agg(F.max("source").alias("source"))
    out = TO.cut_at_tool_call(turns, tools, lo=100, hi=16000)
    return out.join(src, "conv_id").filter((F.col("source") != "toolace") | (F.col("n_tools") > 0))


def candidates(spark, sf_dir) -> DataFrame:
    """Every converter's output as uniform candidate rows."""
    routed, multi = _route(spark, sf_dir)
    mt_by_cat = F.create_map(*[x for c, m in _MAX_TOKENS.items() for x in (F.lit(c), F.lit(m))])
    long = D.long_doc_prompts(D.long_doc_candidates(S.long_docs_df(spark, sf_dir), LONG), LONG)
    parts = [
        PL.make_candidates(routed, "wildchat", F.col("category"), "conv_id", max_tokens=mt_by_cat[F.col("category")]),
        PL.make_candidates(multi, "wildchat", "multi_turn", "conv_id", max_tokens=_MAX_TOKENS["multi_turn"]),
        PL.make_candidates(D.math_prompts(S.table(spark, sf_dir, "documents")), "gsm8k", "reasoning", "doc_id",
                           max_tokens=_MAX_TOKENS["reasoning"]),
        PL.make_candidates(D.code_prompts(S.code_problems_df(spark, sf_dir)), "code_contests", "code_generation",
                           "doc_id", max_tokens=_MAX_TOKENS["code_generation"]),
        PL.make_candidates(D.trajectory_prompts(S.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")),
                           "swe_smith", "code_generation", "conv_id", max_tokens=_MAX_TOKENS["code_generation"]),
        PL.make_candidates(long, F.col("source_name"), "long_context", "doc_id", max_tokens=_MAX_TOKENS["long_context"]),
        PL.make_candidates(_tool_prompts_df(spark, sf_dir), F.col("source"), "tool_call", "conv_id",
                           max_tokens=_MAX_TOKENS["tool_call"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _plan_inputs(spark, sf_dir):
    total = _memo("total", spark, sf_dir, lambda: total_prompts(spark, sf_dir))
    targets = PL.category_targets(total)
    quotas = PL.source_quotas(targets)
    return targets, quotas


def admitted(spark, sf_dir):
    """Admitted candidates, materialised in the shared checkpoint folder: the
    sampling steps read them several times."""
    _, quotas = _plan_inputs(spark, sf_dir)
    return _memo("admitted", spark, sf_dir,
                 lambda: materialize(PL.admit_first_n(materialize(candidates(spark, sf_dir)), quotas)))


def bucketed(spark, sf_dir):
    return PL.token_bucket(admitted(spark, sf_dir), specs=POOL_SPECS)


def sampled(spark, sf_dir, seed: int = 0):
    targets, _ = _plan_inputs(spark, sf_dir)
    return _memo(f"sampled{seed}", spark, sf_dir,
                 lambda: materialize(PL.sample_balanced(bucketed(spark, sf_dir), targets, seed)))


# --- SQL side -------------------------------------------------------------

def _cand_sql() -> str:
    from .catalog import _ORACLE

    def idx(src: str, cat: str, origin: str) -> str:
        return f"substring(md5(concat_ws(':', {src}, {cat}, cast({origin} as varchar))), 1, 12)"

    mt_case = "case category " + " ".join(f"when '{c}' then {m}" for c, m in _MAX_TOKENS.items()) + " end"
    parts = [
        f"select {idx(chr(39)+'wildchat'+chr(39), 'category', 'conv_id')} as id, 'wildchat' as source, category, "
        f"cast(conv_id as bigint) as origin, cast(n_tokens as int) as n_tokens, cast({mt_case} as int) as max_tokens "
        f"from {inner(_ORACLE['route_chat'])} x",
        f"select {idx(chr(39)+'wildchat'+chr(39), chr(39)+'multi_turn'+chr(39), 'conv_id')}, 'wildchat', 'multi_turn', "
        f"cast(conv_id as bigint), cast(n_tokens as int), {_MAX_TOKENS['multi_turn']} from {inner(_ORACLE['multi_turn'])} x",
        f"select {idx(chr(39)+'gsm8k'+chr(39), chr(39)+'reasoning'+chr(39), 'doc_id')}, 'gsm8k', 'reasoning', "
        f"cast(doc_id as bigint), cast(n_tokens as int), {_MAX_TOKENS['reasoning']} from {inner(_ORACLE['math_prompts'])} x",
        f"select {idx(chr(39)+'code_contests'+chr(39), chr(39)+'code_generation'+chr(39), 'doc_id')}, 'code_contests', "
        f"'code_generation', cast(doc_id as bigint), cast(n_tokens as int), {_MAX_TOKENS['code_generation']} "
        f"from {inner(_ORACLE['code_prompts'])} x",
        f"select {idx(chr(39)+'swe_smith'+chr(39), chr(39)+'code_generation'+chr(39), 'conv_id')}, 'swe_smith', "
        f"'code_generation', cast(conv_id as bigint), cast(n_tokens as int), {_MAX_TOKENS['code_generation']} "
        f"from {inner(_ORACLE['trajectory_prompts'])} x",
        f"select {idx('source_name', chr(39)+'long_context'+chr(39), 'doc_id')}, source_name, 'long_context', "
        f"cast(doc_id as bigint), cast(n_tokens as int), {_MAX_TOKENS['long_context']} "
        f"from {inner(_ORACLE['long_doc_prompts'])} x",
        f"select {idx('src', chr(39)+'tool_call'+chr(39), 'conv_id')}, src, 'tool_call', cast(conv_id as bigint), "
        f"cast(n_tokens as int), {_MAX_TOKENS['tool_call']} from (select *, case when conv_id % 2 = 0 then 'hermes_fc' "
        f"else 'toolace' end as src from {inner(_ORACLE['tool_prompts'])} y) x",
    ]
    return "\nunion all\n".join(parts)


def _targets_sql() -> str:
    return "\nunion all\n".join(f"select '{c}' as category, {target_sql(c)} as target" for c in CATEGORY_SPECS)


def _quotas_sql() -> str:
    rows = []
    for cat, lst in SOURCE_SHARES.items():
        for src, share in lst:
            rows.append(f"select '{src}' as source, '{cat}' as category, "
                        f"cast(floor(3 * {target_sql(cat)} * cast({share!r} as double)) as bigint) as quota")
    return "\nunion all\n".join(rows)


def _buckets_sql() -> str:
    return ", ".join(f"('{c}', {i}, {lo}, {hi})" for c, s in POOL_SPECS.items()
                     for i, (lo, hi) in enumerate(s["buckets"]))


def _pool_sql() -> str:
    return f"""with cands as ({_cand_sql()})
, q as ({_quotas_sql()})
, ad as (
  select c.id, c.source, c.category, c.origin, c.n_tokens, c.max_tokens from (
    select c.*, row_number() over (partition by c.source, c.category order by c.origin) as rn
    from cands c where exists (select 1 from q where q.source = c.source and q.category = c.category)) c
  join q on q.source = c.source and q.category = c.category where c.rn <= q.quota
  union all
  select * from cands c where not exists (select 1 from q where q.source = c.source and q.category = c.category))
, bs as (select * from (values {_buckets_sql()}) t(category, bucket, lo, hi))
, bk as (select ad.*, bs.bucket from ad left join bs
         on bs.category = ad.category and ad.n_tokens >= bs.lo and ad.n_tokens < bs.hi)
, tg as (select category, target, greatest(1, target // 4) as per_bucket from ({_targets_sql()}) t)
, k as (select *, md5(id || '#' || '0') as ok from bk)
, picks as (
  select k.id, k.source, k.category, k.origin, k.n_tokens, k.max_tokens, k.bucket, k.ok, 0 as phase, k.bucket as b, k.rn
  from (select *, row_number() over (partition by category, bucket order by ok) as rn from k where bucket is not null) k
  join tg on tg.category = k.category where k.rn <= tg.per_bucket)
, np as (select category, count(*) as np from picks group by 1)
, rem as (select tg.category, tg.target - coalesce(np.np, 0) as remaining from tg left join np on tg.category = np.category)
, top as (
  select l.id, l.source, l.category, l.origin, l.n_tokens, l.max_tokens, l.bucket, l.ok, 1 as phase, -1 as b, l.rn
  from (select *, row_number() over (partition by category order by ok) as rn from k
        where id not in (select id from picks)) l
  join rem on rem.category = l.category where l.rn <= rem.remaining)
, bothp as (select * from picks union all select * from top)
, fin as (select *, row_number() over (partition by category order by phase, b, rn) as sample_rank from bothp)
, sampled as (select fin.* from fin join tg on tg.category = fin.category where fin.sample_rank <= tg.target)
"""


@register("category_targets", f"""
with tg as ({_targets_sql()}), q as ({_quotas_sql()})
select q.source, q.category, cast(tg.target as int) as target, cast(3 * tg.target as int) as fetch_target,
  cast(q.quota as int) as quota
from q join tg on q.category = tg.category
""")
def q_category_targets(spark, sf_dir):
    targets, quotas = _plan_inputs(spark, sf_dir)
    return PL.targets_df(spark, targets, quotas)


@register("admit_first_n", _pool_sql() + """
select id, source, category, origin, n_tokens, max_tokens from ad
""")
def q_admit_first_n(spark, sf_dir):
    return admitted(spark, sf_dir)


@register("token_bucket", _pool_sql() + """
select id, category, n_tokens, bucket from bk
""")
def q_token_bucket(spark, sf_dir):
    return bucketed(spark, sf_dir).select("id", "category", "n_tokens", "bucket")


@register("sample_balanced", _pool_sql() + """
select id, category, bucket, n_tokens, cast(sample_rank as int) as sample_rank from sampled
""")
def q_sample_balanced(spark, sf_dir):
    return sampled(spark, sf_dir).select("id", "category", "bucket", "n_tokens",
                                         F.col("sample_rank").cast("int").alias("sample_rank"))


@register("pool_stats", _pool_sql() + """
, ps as (select category, count(*) as pool_size from ad group by 1)
, ss as (select category, count(*) as cnt, min(n_tokens) as mn, max(n_tokens) as mx from sampled group by 1)
select ps.category, cast(coalesce(sum(ss.cnt), 0) as bigint) as count, cast(coalesce(sum(tg.target), 0) as int) as target,
  cast(coalesce(sum(ps.pool_size), 0) as bigint) as pool_size, coalesce(min(ss.mn), 0) as min_tokens, coalesce(max(ss.mx), 0) as max_tokens
from ps join tg on ps.category = tg.category left join ss on ss.category = ps.category group by rollup (ps.category)
""")
def q_pool_stats(spark, sf_dir):
    targets, _ = _plan_inputs(spark, sf_dir)
    return PL.pool_stats(sampled(spark, sf_dir), admitted(spark, sf_dir), targets)


@register("category_counts", _pool_sql() + """
select category, count(*) as n, round(count(*) * 100e0 / (select count(*) from sampled), 6) as pct
from sampled group by 1
""")
def q_category_counts(spark, sf_dir):
    return PL.category_counts(sampled(spark, sf_dir))


_WEIGHTS_VALUES = ", ".join(f"('{c}', cast({s['weight']!r} as double))" for c, s in CATEGORY_SPECS.items())
_NW_SQL = f"""
, present as (select category, count(*) as n_prompts from sampled group by 1)
, wj as (select p.category, p.n_prompts, coalesce(w.weight, 0e0) as weight
         from present p left join (values {_WEIGHTS_VALUES}) w(category, weight) on w.category = p.category)
, wt as (select sum(weight) as tot, count(*) as cnt from wj)
, shares as (select wj.category, wj.n_prompts,
               case when wt.tot = 0 or wt.tot is null then 1e0 else wj.weight end as weight,
               round(case when wt.tot = 0 or wt.tot is null then 1e0 / wt.cnt else wj.weight / wt.tot end, 6) as share
             from wj, wt)
"""


@register("normalize_weights", _pool_sql() + _NW_SQL + """
select category, n_prompts, weight, share from shares
""")
def q_normalize_weights(spark, sf_dir):
    return PL.normalize_weights(sampled(spark, sf_dir), {c: s["weight"] for c, s in CATEGORY_SPECS.items()})


@register("request_plan", _pool_sql() + _NW_SQL + "," + S.duck_with("requests").strip()[4:] + """
, cum as (select category, share,
            sum(share) over (order by category rows between unbounded preceding and current row) as hi
          from shares)
, cum2 as (select c.category, c.hi, c.hi - c.share as lo, z.size
           from cum c join (select category, count(*) as size from sampled group by 1) z on z.category = c.category)
, draws as (select request_id,
              cast('0x' || substring(md5('cat#' || cast(request_id as varchar) || '#0'), 1, 15) as bigint)
                / 1152921504606846976e0 as u,
              cast('0x' || substring(md5('pick#' || cast(request_id as varchar) || '#0'), 1, 15) as bigint) as h
            from requests)
, pj as (select d.request_id, c.category, d.h % c.size as pos from draws d join cum2 c
         on d.u >= c.lo and (d.u < c.hi or c.hi = (select max(hi) from cum2)))
, ranked as (select category, id, row_number() over (partition by category order by id) - 1 as pos from sampled)
select pj.request_id, pj.category, ranked.id as prompt_id
from pj join ranked on ranked.category = pj.category and ranked.pos = pj.pos
""")
def q_request_plan(spark, sf_dir):
    pool = sampled(spark, sf_dir)
    shares = PL.normalize_weights(pool, {c: s["weight"] for c, s in CATEGORY_SPECS.items()})
    keys = S.requests_df(spark, sf_dir).select("request_id")
    return PL.request_plan(keys, pool, shares)


# ---------------------------------------------------------------------------
# Tagged tool calls in raw conversations
# ---------------------------------------------------------------------------

_TAG_RE = "(?s)<tool_call>\\s*(\\{.*?\\})\\s*</tool_call>"


@register("tool_prompts_tagged", S.duck_with("raw_fc_turns", "tool_defs") + _NORM_SQL + f"""
, t as (select conv_id, turn,
          case "from" when 'system' then 'system' when 'human' then 'user' when 'user' then 'user'
                      when 'gpt' then 'assistant' when 'assistant' then 'assistant' end as role,
          value as content,
          case when length(value) > 0 and "from" in ('gpt', 'assistant') and regexp_matches(value, '{_TAG_RE}')
               then regexp_extract(value, '{_TAG_RE}', 1) end as tc
        from raw_fc_turns)
, cut as (select conv_id, min(turn) filter (where tc is not null) as cut_at,
            arg_min(tc, turn) filter (where tc is not null) as tc from t group by conv_id)
, pre as (select t.conv_id, count(*) as n_messages, count(*) filter (where t.role = 'user') as n_user,
            sum(4 + {ws('t.role')} + {ws('t.content')}) as tok
          from t join cut c on t.conv_id = c.conv_id
          where t.role is not null and length(t.content) > 0 and (c.cut_at is null or t.turn < c.cut_at)
          group by t.conv_id)
, j as (select p.conv_id, p.n_messages, p.n_user, c.tc, coalesce(n.n_tools, 0) as n_tools,
          cast(2 + p.tok + case when coalesce(n.n_tools, 0) > 0
               then {ws(spaced_sql('n.tools_text'))} else 0 end as int) as n_tokens,
          c.tc is not null and json_valid(c.tc) and try(json_type(c.tc)) = 'OBJECT' as ok_json
        from pre p join cut c on p.conv_id = c.conv_id left join ntools n on n.row_id = p.conv_id)
, k as (select *, ok_json and coalesce(try(json_exists(tc, '$.arguments')), false) as has_args,
          ok_json and coalesce(try(json_exists(tc, '$.arguments')), false)
            and try(json_type(tc, '$.arguments')) = 'OBJECT' as args_obj
        from j)
select conv_id, cast(n_messages as bigint) as n_messages, n_tools, n_tokens,
  case when ok_json then coalesce(try(json_extract_string(tc, '$.name')), '') end as exp_name,
  case when ok_json then case when has_args then cast(to_json(try(json_keys(tc, '$.arguments'))) as varchar) else '[]' end end
    as exp_args
from k where n_messages > 0 and n_user > 0 and n_tokens between 100 and 16000 and not (has_args and not args_obj)
""")
def q_tool_prompts_tagged(spark, sf_dir):
    tools = TO.normalize_tools(S.tool_defs_df(spark, sf_dir)).withColumnRenamed("row_id", "conv_id")
    out = TO.cut_at_tool_tag(S.raw_fc_turns_df(spark, sf_dir), tools)
    return out.withColumn("exp_args", F.to_json("exp_args"))


# ---------------------------------------------------------------------------
# Transcripts with <functioncall>
# ---------------------------------------------------------------------------

def _norm_list_sql(expr: str) -> str:
    return f"""list_filter(list_transform({expr}, lambda e:
           case when try(json_type(e)) <> 'OBJECT' then null
                when json_extract_string(e, '$.type') = 'function' and json_exists(e, '$.function') then cast(e as varchar)
                when json_exists(e, '$.name') then concat('{{"type":"function","function":', cast(e as varchar), '}}')
                when json_exists(e, '$.function')
                  then concat('{{"type":"function","function":', cast(json_extract(e, '$.function') as varchar), '}}')
           end), lambda x: x is not null)"""


def _transcript_sql() -> str:
    nl = "chr(10)"
    obj = "json_valid({0})"
    q = "replace(fc_s, '''', '\"')"
    return S.duck_with("transcripts") + f"""
, p0 as (select conv_id, system, unnest(string_split(chat, 'USER: ')) as part,
           unnest(range(len(string_split(chat, 'USER: ')))) as pos from transcripts)
, q as (select conv_id, system, pos,
          {strip_sql("case when instr(part, 'ASSISTANT: ') > 0 then split_part(part, 'ASSISTANT: ', 1) else part end")} as usr,
          instr(part, 'ASSISTANT: ') > 0 as has_a,
          case when instr(part, 'ASSISTANT: ') > 0 then substr(part, instr(part, 'ASSISTANT: ') + 11) end as rest
        from p0 where pos >= 1)
, r as (select *, coalesce(contains(rest, '<functioncall>'), false) as has_fc,
          substr(rest, instr(rest, '<functioncall>') + 14) as fc from q)
, s as (select *, {strip_sql(f'''case when contains(fc, '</functioncall>') then split_part(fc, '</functioncall>', 1)
              when contains(fc, '</') then split_part(fc, '</', 1)
              when contains(fc, {nl} || {nl}) then split_part(fc, {nl} || {nl}, 1)
              when contains(fc, {nl} || 'FUNCTION') then split_part(fc, {nl} || 'FUNCTION', 1) else fc end''')} as fc_s
        from r)
, t as (select *, case when has_fc and {obj.format('fc_s')} then fc_s
                       when has_fc and {obj.format(q)} then {q} end as call from s)
, fst as (select * from (
          select conv_id, min(pos) filter (where call is not null) as cut,
            arg_min(call, pos) filter (where call is not null) as call, first(system) as system
          from t group by conv_id) x where call is not null and try(json_type(call)) = 'OBJECT')
, agg as (select t.conv_id,
            sum(4 + 1 + {ws('t.usr')} + case when t.pos = f.cut then 0
                 when t.has_a and not t.has_fc then 4 + 1 + {ws(strip_sql('t.rest'))} else 0 end) as tok,
            sum(1 + case when t.pos <> f.cut and t.has_a and not t.has_fc then 1 else 0 end) as n
          from t join fst f on t.conv_id = f.conv_id where t.pos <= f.cut group by t.conv_id)
, sp as (select f.*, a.tok, a.n, regexp_extract_all(coalesce(f.system, ''), '(\\[[\\s\\S]*?\\])', 1) as spans
         from fst f join agg a on a.conv_id = f.conv_id)
, pk as (select *, coalesce(list_position(list_transform(spans, lambda x: not json_valid(x)), true), 0) as bad,
           coalesce(list_position(list_transform(spans, lambda x:
             coalesce(try(contains(cast(json_extract(x, '$[0]') as varchar), 'name')), false)), true), 0) as good
         from sp)
, fin as (select *, case when good > 0 and (bad = 0 or good < bad) then spans[good] end as picked,
            length(system) > 0 as has_sys from pk)
select conv_id, cast(n + case when has_sys then 1 else 0 end as bigint) as n_messages,
  cast(2 + tok + case when has_sys then 4 + 1 + {ws('system')} else 0 end as int) as n_tokens,
  coalesce(json_extract_string(call, '$.name'), '') as exp_name,
  case when json_exists(call, '$.arguments') and try(json_type(call, '$.arguments')) = 'OBJECT'
       then cast(to_json(json_keys(call, '$.arguments')) as varchar) else '[]' end as exp_args,
  cast(coalesce(len(case when picked is not null and json_valid(picked) and try(json_type(picked)) = 'ARRAY'
       then {_norm_list_sql("json_extract(picked, '$[*]')")} end), 0) as int) as n_tools
from fin
where 2 + tok + case when has_sys then 4 + 1 + {ws('system')} else 0 end between 100 and 16000
"""


@register("transcript_turns", _transcript_sql())
def q_transcript_turns(spark, sf_dir):
    return TO.split_transcript(S.transcripts_df(spark, sf_dir)).withColumn("exp_args", F.to_json("exp_args"))


def _cand_info_sql() -> str:
    """Per candidate (source, category, origin): message count, tool count,
    whether an expectation exists, and the tool-definition tokens."""
    from .catalog import _ORACLE

    tools_tok = ws(spaced_sql('n.tools_text'))
    parts = [
        f"select 'wildchat' as source, category, cast(conv_id as bigint) as origin, cast(1 as bigint) as n_messages, "
        f"0 as n_tools, false as has_exp, 0 as tools_tok from {inner(_ORACLE['route_chat'])} x",
        f"select 'wildchat', 'multi_turn', cast(conv_id as bigint), cast(n_messages as bigint), 0, false, 0 "
        f"from {inner(_ORACLE['multi_turn'])} x",
        f"select 'gsm8k', 'reasoning', cast(doc_id as bigint), cast(2 as bigint), 0, false, 0 "
        f"from {inner(_ORACLE['math_prompts'])} x",
        f"select 'code_contests', 'code_generation', cast(doc_id as bigint), cast(2 as bigint), 0, false, 0 "
        f"from {inner(_ORACLE['code_prompts'])} x",
        f"select 'swe_smith', 'code_generation', cast(conv_id as bigint), cast(n_messages as bigint), 0, false, 0 "
        f"from {inner(_ORACLE['trajectory_prompts'])} x",
        f"select source_name, 'long_context', cast(doc_id as bigint), cast(2 as bigint), 0, false, 0 "
        f"from {inner(_ORACLE['long_doc_prompts'])} x",
        f"select case when x.conv_id % 2 = 0 then 'hermes_fc' else 'toolace' end, 'tool_call', cast(x.conv_id as bigint), "
        f"cast(x.n_messages as bigint), x.n_tools, x.exp_name is not null, "
        f"case when x.n_tools > 0 then {tools_tok} else 0 end "
        f"from {inner(_ORACLE['tool_prompts'])} x left join ntools_i n on n.row_id = x.conv_id",
    ]
    norm = _NORM_SQL.replace(", el as", ", el_i as").replace("from el)", "from el_i)").replace(
        ", nt as", ", nt_i as").replace("from nt)", "from nt_i)").replace(", ntools as", ", ntools_i as")
    return "\n".join(["info_base as (select 1 as _one)", norm.replace("from tool_defs)", "from tool_defs)"),
                      ", info as (" + "\nunion all\n".join(parts) + ")"])
