"""Source/sink queries (A1-A7) and the end-to-end pool build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog_support import inner, materialize
from ..operators.curate import chat as C
from ..operators.curate import documents as D
from ..operators.curate import pool as PL
from ..operators.curate import tools as TO
from ..operators.curate.common import msg
from ..session import scratch_path
from ..sources import io as IO
from ..sources import standins as S
from ..specs import CODE_SYSTEM, MATH_SYSTEM
from . import q_curate as QC
from .catalog import _ORACLE, register


def _no_tools():
    return F.lit(None).cast("array<struct<type:string,function:string>>")


def _no_expectation():
    return F.lit(None).cast("struct<name:string,required_args:array<string>>")


def _entry_parts(spark, sf_dir, chosen: DataFrame) -> DataFrame:
    """(source, category, origin, messages, tools, expected_tool) of the
    chosen candidates.  Collected message lists are built only for chosen
    keys; projections are joined to the (small) chosen set."""
    def keys(src_filter):
        return chosen.filter(src_filter).select(F.col("origin").alias("_o"), "source", "category")

    def attach(df, key, src_filter, messages, tools=None, exp=None):
        tools = _no_tools() if tools is None else tools
        exp = _no_expectation() if exp is None else exp
        k = keys(src_filter).withColumnRenamed("source", "_src").withColumnRenamed("category", "_cat")
        j = df.join(k, df[key] == k["_o"])
        return j.select(F.col("_src").alias("source"), F.col("_cat").alias("category"), F.col("_o").alias("origin"),
                        messages.alias("messages"), tools.alias("tools"), exp.alias("expected_tool"))

    passing = QC.passing_turns(spark, sf_dir)
    chat_log = S.chat_log_df(spark, sf_dir)
    is_wc = (F.col("source") == "wildchat")
    parts = [
        attach(passing, "conv_id", is_wc & (F.col("category") != "multi_turn"),
               F.array(msg("user", F.col("first_user")))),
    ]
    mt_keys = keys(is_wc & (F.col("category") == "multi_turn")).select(F.col("_o").alias("conv_id"))
    parts.append(attach(C.multi_turn_messages(chat_log, mt_keys), "conv_id",
                        is_wc & (F.col("category") == "multi_turn"), F.col("messages")))
    docs = S.table(spark, sf_dir, "documents")
    parts.append(attach(docs, "doc_id", F.col("source") == "gsm8k",
                        F.array(msg("system", F.lit(MATH_SYSTEM)), msg("user", F.col("text")))))
    code = D.code_prompts(S.code_problems_df(spark, sf_dir))
    parts.append(attach(code, "doc_id", F.col("source") == "code_contests",
                        F.array(msg("system", F.lit(CODE_SYSTEM)), msg("user", F.col("user_content")))))
    conv = S.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    tj_keys = keys(F.col("source") == "swe_smith").select(F.col("_o").alias("conv_id"))
    parts.append(attach(D.trajectory_messages(conv, tj_keys), "conv_id", F.col("source") == "swe_smith",
                        F.col("messages")))
    long = D.long_doc_candidates(S.long_docs_df(spark, sf_dir), QC.LONG)
    parts.append(attach(long, "doc_id", F.col("category") == "long_context",
                        F.array(msg("system", F.col("system")), msg("user", F.col("user_content")))))
    turns = S.fc_turns_df(spark, sf_dir)
    tc_keys = keys(F.col("category") == "tool_call").select(F.col("_o").alias("conv_id"))
    tmsgs = TO.tool_prompt_messages(turns, tc_keys)
    tools = TO.normalize_tools(S.tool_defs_df(spark, sf_dir)).withColumnRenamed("row_id", "conv_id")
    tp = QC._tool_prompts_df(spark, sf_dir).join(tmsgs, "conv_id").join(tools.select("conv_id", "tools"), "conv_id", "left")
    exp = F.when(F.col("exp_name").isNotNull(), F.struct(
        F.col("exp_name").alias("name"),
        F.col("exp_args").alias("required_args")))
    tool_list = F.when(F.size("tools") > 0, TO.tool_structs(F.col("tools")))
    parts.append(attach(tp, "conv_id", F.col("category") == "tool_call", F.col("messages"), tool_list, exp))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_pool(spark, sf_dir, seed: int = 0) -> DataFrame:
    """E1-E22 end to end: converters -> union -> first-N admission ->
    buckets -> balanced sample -> entries with message lists, in shuffled
    order (``pool_order``).  Materialised in the shared checkpoint folder."""
    sampled = QC.sampled(spark, sf_dir, seed)
    parts = _entry_parts(spark, sf_dir, sampled)
    entries = sampled.join(parts, ["source", "category", "origin"])
    return materialize(entries.select(
        "id", "category", "source", "messages", "tools", "expected_tool", "max_tokens",
        F.col("n_tokens").alias("input_token_count"),
        F.create_map(F.lit("origin"), F.col("origin").cast("string")).alias("source_metadata"), "pool_order"))


def _pool_info_sql(final: str) -> str:
    return (QC._pool_sql() + ", " + S.DUCK_TOOL_DEFS.strip() + "\n, " + QC._cand_info_sql()
            + "\n, si as (select s.*, i.n_messages, i.n_tools, i.has_exp, i.tools_tok from sampled s join info i"
              " on i.source = s.source and i.category = s.category and i.origin = s.origin)\n" + final)


@register("build_pool", _pool_info_sql("""
select id, category, source, cast(n_messages as int) as n_messages, cast(n_tokens as int) as input_token_count,
  max_tokens, n_tools > 0 as has_tools, has_exp as has_expected_tool from si
"""))
def q_build_pool(spark, sf_dir):
    p = build_pool(spark, sf_dir)
    return p.select("id", "category", "source", F.size("messages").alias("n_messages"), "input_token_count",
                    "max_tokens", F.col("tools").isNotNull().alias("has_tools"),
                    F.col("expected_tool").isNotNull().alias("has_expected_tool"))


def _written_pool(spark, sf_dir) -> str:
    path = scratch_path(spark, "pool")
    pool = build_pool(spark, sf_dir)
    IO.write_prompt_pool(pool, path, force=True, stats=PL.pool_stats(QC.sampled(spark, sf_dir),
                                                                     QC.admitted(spark, sf_dir),
                                                                     QC._plan_inputs(spark, sf_dir)[0]))
    return path


@register("pool_roundtrip", _pool_info_sql("""
select id, category, source, max_tokens, n_tokens as input_token_count, cast(n_tools as int) as n_tool_objects from si
"""))
def q_pool_roundtrip(spark, sf_dir):
    """The pool read back, and from the text of its lines the number of tools
    whose function is written as an object."""
    path = _written_pool(spark, sf_dir)
    prompts, _ = IO.read_prompt_pool(spark, path)
    tools = spark.read.text(path).select(
        F.get_json_object("value", "$.id").alias("id"),
        F.regexp_count("value", F.lit(r'"type":"function","function":\{')).alias("n_tool_objects"))
    return prompts.join(tools, "id").select("id", "category", "source", "max_tokens", "input_token_count", "n_tool_objects")


@register("pool_load", QC._pool_sql() + """
select id, category, true as valid from sampled
""")
def q_pool_load(spark, sf_dir):
    """Load a written pool plus rejects: rows with their validity flag."""
    path = _written_pool(spark, sf_dir)
    prompts, rejects = IO.read_prompt_pool(spark, path)
    return (prompts.select("id", "category", F.lit(True).alias("valid"))
            .unionByName(rejects.select("id", "category", F.lit(False).alias("valid"))))


# Every converter stores the message-list count as the claim, except tool
# prompts, whose claim adds the tool-definition tokens the check ignores; a
# message without its role counts one token less.
@register("validate_pool", _pool_info_sql("""
, v as (select count(*) as entries,
          count(*) filter (where origin % 7 = 0) as missing, count(*) filter (where origin % 5 = 0) as empty,
          count(*) filter (where origin % 3 = 0) as bad,
          count(*) filter (where n_tokens > 0 and tools_tok / greatest(n_tokens, 1) > 0.2e0)
          + count(*) filter (where origin % 3 = 0 and n_tokens > 0 and (tools_tok + 1) / greatest(n_tokens, 1) > 0.2e0)
            as mism from si)
select 'entries' as "check", entries + missing + empty + bad as n from v
union all select 'missing_fields', missing from v
union all select 'empty_messages', empty from v
union all select 'bad_messages', bad from v
union all select 'token_mismatch', mism from v
"""))
def q_validate_pool(spark, sf_dir):
    """Checks over the raw entries of a pool file that also holds faulty copies:
    without category (``origin % 7 = 0``), without messages (``% 5``), with a
    first message without role (``% 3``)."""
    pool = build_pool(spark, sf_dir)
    origin = F.col("source_metadata")["origin"].cast("bigint")
    no_role = F.transform("messages", lambda m, i: F.when(i == 0, F.struct(
        F.lit(None).cast("string").alias("role"), m["content"].alias("content"))).otherwise(m))
    faulty = (pool.filter(origin % 7 == 0).withColumn("category", F.lit(None).cast("string"))
              .unionByName(pool.filter(origin % 5 == 0).withColumn("messages", F.filter("messages", lambda m: F.lit(False))))
              .unionByName(pool.filter(origin % 3 == 0).withColumn("messages", no_role)))
    path = scratch_path(spark, "pool_raw")
    IO.write_prompt_pool(pool.unionByName(faulty), path, force=True)
    return PL.validate_pool(IO.read_pool_entries(spark, path))


# Like the reference's CSV, NULL and empty text are both written as empty
# fields, so a reader of the file sees NULL for an empty error text.
@register("request_export", _ORACLE["record_export"].replace(
    "select w.request_id, cast(w.request_id as varchar) as prompt_id", "select cast(w.request_id as varchar) as prompt_id")
    .replace(", round(ia.itl_avg, 6) as itl_avg", "")
    .replace("'' as error", "cast(null as varchar) as error"))
def q_request_export(spark, sf_dir):
    from .q_wire import q_record_export

    rec = q_record_export(spark, sf_dir).drop("request_id", "itl_avg")
    path = scratch_path(spark, "requests_csv")
    IO.write_request_csv(rec, path)
    return IO.read_request_csv(spark, path)


def _run_report_sql() -> str:
    from . import q_analytics as QA

    return f"""with s as {inner(QA.RUN_SUMMARY_SQL)}, e as {inner(QA._EFF_SQL)},
ts as {inner(_ORACLE['throughput_timeseries'])}, cs as {inner(_ORACLE['concurrency_samples'])},
it as {inner(_ORACLE['itl_distribution'])}, pc as {inner(_ORACLE['category_breakdown'])}
select s.total_requests, round(e.effective_concurrency, 1) as effective_concurrency,
  cast((select count(*) from ts) as int) as n_timeseries, cast((select count(*) from cs) as int) as n_concurrency,
  it.itl_p95, (select count(*) from pc) as n_categories,
  (select cast(count as bigint) from pc where category = 'tool_call') as tool_call_requests, true as keys_dropped
from s, e, it"""


@register("run_report", _run_report_sql())
def q_run_report(spark, sf_dir):
    """Write the run report, read the document back and report what it
    holds: total requests, effective concurrency, series lengths, the token-gap
    p95, the categories, and that the API keys were dropped and nothing else."""
    from . import q_analytics as QA

    rep = IO.run_report(QA.q_run_summary(spark, sf_dir), QA.q_throughput_timeseries(spark, sf_dir),
                        QA.samples(spark, sf_dir), QA.q_effective_concurrency(spark, sf_dir),
                        {"endpoint": {"url": "http://localhost", "api_key": "secret"},
                         "test": {"duration_seconds": QA.DUR, "warmup_seconds": QA.WARM}, "metadata": {"api_key": "secret"}},
                        itl=QA.q_itl_distribution(spark, sf_dir), per_category=QA.q_category_breakdown(spark, sf_dir))
    path = scratch_path(spark, "run_report")
    IO.write_run_json(rep, path)
    doc = F.col("value")
    return spark.read.text(path).select(
        F.get_json_object(doc, "$.metrics.total_requests").cast("bigint").alias("total_requests"),
        F.get_json_object(doc, "$.effective_concurrency").cast("double").alias("effective_concurrency"),
        F.json_array_length(F.get_json_object(doc, "$.timeseries")).alias("n_timeseries"),
        F.json_array_length(F.get_json_object(doc, "$.concurrency_timeseries")).alias("n_concurrency"),
        F.get_json_object(doc, "$.metrics.itl.p95").cast("double").alias("itl_p95"),
        F.size(F.json_object_keys(F.get_json_object(doc, "$.metrics.per_category"))).cast("bigint").alias("n_categories"),
        F.get_json_object(doc, "$.metrics.per_category.tool_call.count").cast("bigint").alias("tool_call_requests"),
        (~doc.contains("secret") & doc.contains('"endpoint":{"url":"http://localhost"}')).alias("keys_dropped"))
