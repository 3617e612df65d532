"""Views over the supplied test tables that stand in for benchmark data.

No supplied table holds request logs, wire captures or tool definitions, so
these views derive them from ``events``, ``documents``, ``conversations`` and
``labels`` (see FIXTURES.md section 3).  Each view exists twice: as a Spark
DataFrame builder, and as DuckDB SQL text used by the oracle queries.  Both
give the same rows.

Time is compressed 600x so the month of events becomes a 4,320 s run starting
at epoch 1704067200 with about a dozen requests in flight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..specs import RunParams

# FIXED VALUES: the stand-in run.
RUN_START = 1704067200.0
RUN_DURATION = 4320.0
RUN_WARMUP = 30.0
RUN_GPUS = 8
RUN = RunParams(start=RUN_START, duration=RUN_DURATION, warmup=RUN_WARMUP, gpu_count=RUN_GPUS)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_micros(df: DataFrame, col: str) -> str:
    """Microseconds since the epoch, independent of the session time zone."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})"
    return f"unix_micros({col})"


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------

def requests_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a streaming file source (one file per table, so the
    folder is read with a glob filter)."""
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir.rstrip("/")))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """The request-log stand-in from an ``events`` DataFrame (batch or
    streaming: the derivation is a stateless projection)."""
    us = _epoch_micros(ev, "ts")
    e = ev.selectExpr(
        "event_id", "user_id", "event_type", "value",
        "cast(get_json_object(props, '$.k') as int) as k",
        f"1704067200e0 + ({us} / 1e6 - 1704067200e0) / 600e0 as sent")
    r = e.selectExpr(
        "*",
        """case user_id % 7 when 0 then 'short_chat' when 1 then 'medium_chat'
             when 2 then 'tool_call' when 3 then 'code_generation' when 4 then 'long_context'
             when 5 then 'multi_turn' else 'reasoning' end as category""",
        """case when event_type = 'error' then 'error'
             when event_type = 'signup' and k >= 90 then 'timeout' else 'success' end as status""")
    return r.selectExpr(
        "event_id as request_id", "category", "status", "sent as request_sent_at",
        "case when status = 'success' and k > 0 then sent + 5e-2 + k * 5e-3 end as first_token_at",
        "sent + 5e-2 + k * 5e-3 + value * 1e-1 as completed_at",
        "cast(50 + k * k * 7 as bigint) as input_tokens",
        """case when status = 'success' then cast(floor(value * (1e0 + k * 1e-1)) as bigint)
             else cast(0 as bigint) end as output_tokens""",
        "case when category = 'tool_call' and status = 'success' then k % 3 <> 0 end as tool_call_correct",
        "k as k_")


def _dealt(requests: DataFrame) -> DataFrame:
    """Requests dealt out by id before each becomes thousands of rows, as a
    capture is that many servers write; the count is given, because the size
    of the few requests says nothing about the rows to come."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.repartition(n, "request_id")


def chunk_times_df(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> DataFrame:
    """One arrival per output token of a request, with uneven gaps.  Built with
    a generator (``explode(sequence)``) so no join is needed."""
    req = requests if requests is not None else requests_df(spark, sf_dir)
    r = _dealt(req.filter("first_token_at is not null and output_tokens > 0")
               .selectExpr("request_id", "category", "first_token_at", "completed_at", "output_tokens as n"))
    return (r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
            .selectExpr("request_id", "cast(i as int) as seq", "category",
                        "first_token_at + (completed_at - first_token_at) * (i * (i + 1)) / (n * (n + 1)) as arrived_at"))


def wire_lines_df(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> DataFrame:
    """Streamed-response lines: content and tool-call deltas, blank lines, a
    malformed line, usage (missing for every third request), the terminator,
    and a line after the terminator for every tenth request.  One generator
    over the line numbers of a response: three per token, then the last three."""
    req = requests if requests is not None else requests_df(spark, sf_dir)
    bs = "chr(92)"
    # What nearly all lines are is asked first, and once a request what does not change in it.
    line = f"""case
      when line_no >= 3 * n then case line_no - 3 * n
        when 0 then concat('data: {{"choices":[{{"delta":{{}}}}],"usage":{{"completion_tokens":', n, '}}}}')
        when 1 then 'data: [DONE]'
        else 'data: {{"choices":[{{"delta":{{"content":"after the end"}}}}]}}' end
      when line_no % 3 = 1 then ''
      when line_no % 3 = 2 then 'data: {{not valid json}}'
      when line_no > last_call then concat('data: {{"choices":[{{"delta":{{"content":"t', line_no div 3, ' "}}}}]}}')
      when line_no = 0 then concat('data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"id":"call_', request_id, '","function":{{"name":"get_","arguments":""}}}}]}}}}]}}')
      when line_no = 3 then concat('data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"function":{{"name":"weather","arguments":"{{', {bs}, '"loc"}}}}]}}}}]}}')
      else concat('data: {{"choices":[{{"delta":{{"tool_calls":[{{"index":0,"function":{{"arguments":"ation', {bs}, '":1}}"}}}}]}}}}]}}') end as line"""
    r = (_dealt(req.filter("first_token_at is not null and output_tokens > 0")
                .selectExpr("request_id", "if(category = 'tool_call', 6, -1) as last_call", "first_token_at", "completed_at",
                            "cast(output_tokens as int) as n"))
         .withColumn("line_no", F.explode(F.sequence(F.lit(0), 3 * F.col("n") + 2))))
    there = """case when line_no < 3 * n then line_no % 3 < 2 or line_no = 5 when line_no = 3 * n then request_id % 3 <> 0
      when line_no = 3 * n + 1 then true else request_id % 10 = 0 end"""
    seq = "cast(line_no div 3 as bigint)"
    return r.filter(there).selectExpr(
        "request_id", "line_no",
        f"case when line_no >= 3 * n then completed_at else first_token_at + (completed_at - first_token_at) "
        f"* ({seq} * ({seq} + 1)) / (cast(n as bigint) * (n + 1)) end as arrived_at", line)


def capture_events_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as capture events (``LIVE_EVENTS``): requests sent, response
    lines, ends, and the close of the capture after the drain limit."""
    req = requests_df(spark, sf_dir)
    exp = expectations_df(spark, sf_dir, req).withColumnRenamed("request_id", "r_")
    none = {"line_no": "cast(null as long)", "line": "cast(null as string)", "category": "cast(null as string)",
            "input_tokens": "cast(null as long)", "exp_name": "cast(null as string)",
            "required_args": "cast(null as array<string>)", "status": "cast(null as string)", "error": "cast(null as string)"}

    def events(df: DataFrame, kind: str, at: str, **given: str) -> DataFrame:
        return df.selectExpr(f"'{kind}' as kind", "request_id", f"{at} as at",
                             *[f"{given.get(c, e)} as {c}" for c, e in none.items()])

    sent = events(req.join(exp, F.col("request_id") == F.col("r_"), "left"), "sent", "request_sent_at", category="category",
                  input_tokens="input_tokens", exp_name="exp_name", required_args="required_args")
    ends = events(req, "end", "completed_at", status="status", error="''")
    lines = events(wire_lines_df(spark, sf_dir, req), "line", "arrived_at", line_no="cast(line_no as long)", line="line")
    close = events(spark.range(1).selectExpr("cast(-1 as long) as request_id"), "close",
                   repr(RUN_START + RUN_DURATION + 3 * RUN.request_timeout) + "e0")
    return sent.unionByName(ends).unionByName(lines).unionByName(close)


def capture_stream(spark: SparkSession, events: DataFrame, slices: int = 6, files: int = 4) -> DataFrame:
    """The events as a stream of ``files`` files per interval of the run, a
    micro-batch each, written one interval after the other; every 97th line is
    written 45 s late, so that lines come a batch after their terminator."""
    at = F.col("at") + F.when(F.col("line_no") % 97 == 0, 45.0).otherwise(0.0) - RUN_START
    part = F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor(at * slices / RUN_DURATION))).cast("int")
    parts, path = scratch_path(spark, "intervals"), scratch_path(spark, "capture")
    events.withColumn("_part", part).write.partitionBy("_part").parquet(parts)
    for k in range(slices):
        spark.read.schema(events.schema).parquet(f"{parts}/_part={k}").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def expectations_df(spark: SparkSession, sf_dir: str, requests: DataFrame | None = None) -> DataFrame:
    """Expected tool per tool_call request: ``get_weather`` requiring
    ``location``, plus ``unit`` when ``request_id % 5 = 0``."""
    req = requests if requests is not None else requests_df(spark, sf_dir)
    return req.filter("category = 'tool_call'").selectExpr(
        "request_id", "'get_weather' as exp_name",
        "case when request_id % 5 = 0 then array('location', 'unit') else array('location') end as required_args")


def chat_log_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return (c.join(d, c.conv_id == d.doc_id, "left").drop("doc_id")
            .join(lab, c.conv_id == lab.doc_id, "left")
            .select("conv_id", "turn", "role", F.when(F.col("conv_id") % 16 == 7, F.regexp_replace("text", " ", "\u3000"))
                    .otherwise(F.col("text")).alias("content"), "lang",
                    F.coalesce("toxic", F.lit(0)).alias("toxic")))


def tool_defs_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id as row_id",
        """case doc_id % 5
             when 0 then concat('[{"type":"function","function":{"name":"f', doc_id, '","parameters":{}}}]')
             when 1 then concat('[{"name":"f', doc_id, '","description":"bare: a, b"}]')
             when 2 then concat('[{"function":{"name":"f', doc_id, '"}}]')
             when 3 then 'not json'
             else '["not_a_dict",{}]' end as tools_json""")


# ---------------------------------------------------------------------------
# DuckDB text of the same views (oracle side)
# ---------------------------------------------------------------------------

DUCK_REQUESTS = """
requests as (
  with e as (
    select event_id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k,
           1704067200e0 + (epoch_us(ts) / 1e6 - 1704067200e0) / 600e0 as sent
    from events),
  r as (
    select *,
      case user_id % 7 when 0 then 'short_chat' when 1 then 'medium_chat'
        when 2 then 'tool_call' when 3 then 'code_generation' when 4 then 'long_context'
        when 5 then 'multi_turn' else 'reasoning' end as category,
      case when event_type = 'error' then 'error'
           when event_type = 'signup' and k >= 90 then 'timeout' else 'success' end as status
    from e)
  select event_id as request_id, category, status, sent as request_sent_at,
    case when status = 'success' and k > 0 then sent + 5e-2 + k * 5e-3 end as first_token_at,
    sent + 5e-2 + k * 5e-3 + value * 1e-1 as completed_at,
    cast(50 + k * k * 7 as bigint) as input_tokens,
    case when status = 'success' then cast(floor(value * (1e0 + k * 1e-1)) as bigint)
         else cast(0 as bigint) end as output_tokens,
    case when category = 'tool_call' and status = 'success' then k % 3 <> 0 end as tool_call_correct,
    k as k_
  from r)"""

DUCK_CHUNK_TIMES = """
chunk_times as (
  select r.request_id, cast(r.i as int) as seq, r.category,
    r.first_token_at + (r.completed_at - r.first_token_at) * (r.i * (r.i + 1)) / (r.n * (r.n + 1)) as arrived_at
  from (select request_id, category, first_token_at, completed_at, output_tokens as n, unnest(range(output_tokens)) as i
        from requests where first_token_at is not null and output_tokens > 0) r)"""

DUCK_WIRE_LINES = """
wire_lines as (
  select request_id, 3 * seq as line_no, arrived_at,
    case when category = 'tool_call' and seq = 0 then concat('data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"call_', request_id, '","function":{"name":"get_","arguments":""}}]}}]}')
         when category = 'tool_call' and seq = 1 then concat('data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"weather","arguments":"{', chr(92), '"loc"}}]}}]}')
         when category = 'tool_call' and seq = 2 then concat('data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"ation', chr(92), '":1}"}}]}}]}')
         else concat('data: {"choices":[{"delta":{"content":"t', seq, ' "}}]}') end as line
  from chunk_times
  union all
  select request_id, 3 * seq + 1, arrived_at, '' from chunk_times
  union all
  select request_id, 3 * seq + 2, arrived_at, 'data: {not valid json}' from chunk_times where seq = 1
  union all
  select request_id, cast(3 * output_tokens as int), completed_at, concat('data: {"choices":[{"delta":{}}],"usage":{"completion_tokens":', output_tokens, '}}')
  from requests where first_token_at is not null and output_tokens > 0 and request_id % 3 <> 0
  union all
  select request_id, cast(3 * output_tokens + 1 as int), completed_at, 'data: [DONE]'
  from requests where first_token_at is not null and output_tokens > 0
  union all
  select request_id, cast(3 * output_tokens + 2 as int), completed_at, 'data: {"choices":[{"delta":{"content":"after the end"}}]}'
  from requests where first_token_at is not null and output_tokens > 0 and request_id % 10 = 0)"""

DUCK_EXPECTATIONS = """
expectations as (
  select request_id, 'get_weather' as exp_name,
    case when request_id % 5 = 0 then ['location', 'unit'] else ['location'] end as required_args
  from requests where category = 'tool_call')"""

DUCK_CHAT_LOG = """
chat_log as (
  select c.conv_id, c.turn, c.role, case when c.conv_id % 16 = 7 then replace(c.text, ' ', chr(12288)) else c.text end
      as content, d.lang,
    coalesce(l.toxic, 0) as toxic
  from conversations c
  left join documents d on d.doc_id = c.conv_id
  left join labels l on l.doc_id = c.conv_id)"""

DUCK_TOOL_DEFS = """
tool_defs as (
  select doc_id as row_id,
    case doc_id % 5
      when 0 then concat('[{"type":"function","function":{"name":"f', doc_id, '","parameters":{}}}]')
      when 1 then concat('[{"name":"f', doc_id, '","description":"bare: a, b"}]')
      when 2 then concat('[{"function":{"name":"f', doc_id, '"}}]')
      when 3 then 'not json'
      else '["not_a_dict",{}]' end as tools_json
  from documents)"""

# Finalised records (B10) over the stand-in requests, as DuckDB text.
DUCK_RECORDS = """
records as (
  select *,
    case when first_token_at is not null and first_token_at <> 0 and request_sent_at <> 0
         then first_token_at - request_sent_at end as ttft,
    case when completed_at is not null and completed_at <> 0 and request_sent_at <> 0
         then completed_at - request_sent_at end as e2e_latency,
    case when completed_at is not null and completed_at <> 0 and first_token_at is not null
              and first_token_at <> 0 and output_tokens > 0 and completed_at - first_token_at > 0
         then output_tokens / (completed_at - first_token_at) end as output_tps
  from requests)"""

_DEPS = {
    "requests": [],
    "records": ["requests"],
    "chunk_times": ["requests"],
    "wire_lines": ["chunk_times"],
    "expectations": ["requests"],
    "chat_log": [],
    "tool_defs": [],
}
_TEXT = {
    "requests": DUCK_REQUESTS, "records": DUCK_RECORDS, "chunk_times": DUCK_CHUNK_TIMES,
    "wire_lines": DUCK_WIRE_LINES, "expectations": DUCK_EXPECTATIONS,
    "chat_log": DUCK_CHAT_LOG, "tool_defs": DUCK_TOOL_DEFS,
}


def duck_with(*views: str) -> str:
    """A ``WITH`` clause defining the named stand-in views (and what they use)."""
    order: list[str] = []

    def add(v):
        for d in _DEPS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "with " + ",\n".join(_TEXT[v].strip() for v in order) + "\n"


# ---------------------------------------------------------------------------
# Curation inputs
# ---------------------------------------------------------------------------

def fc_turns_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-calling conversations: the chat log with a tool call on each
    conversation's second assistant turn, nameless when ``conv_id % 16 = 5``.  Argument text varies by
    ``conv_id % 4``: an object, another object, broken JSON, a JSON array."""
    from pyspark.sql import Window

    c = chat_log_df(spark, sf_dir)
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    c = c.withColumn("_arank", F.row_number().over(w))
    is_tc = (F.col("role") == "assistant") & (F.col("_arank") == 2)
    return c.select(
        "conv_id", "turn", "role", "content",
        F.when(is_tc & (F.col("conv_id") % 16 != 5), F.concat(F.lit("f"), F.col("conv_id").cast("string"))).alias("tc_name"),
        F.when(is_tc, F.expr("""case conv_id % 4
            when 0 then concat('{"city":"c', conv_id, '","days":', turn, '}')
            when 1 then '{"q,r":"x"}' when 2 then 'not json' else '[1,2]' end""")).alias("tc_args"),
        F.when(F.col("conv_id") % 2 == 0, "hermes_fc").otherwise("toolace").alias("source"))


def long_docs_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents assigned to the five long-document sources by the number in
    their ``source``; question sources take the first line as the question."""
    from ..specs import LONG_DOC_SOURCES

    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(s["source"]) for s in LONG_DOC_SOURCES])
    idx = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(len(LONG_DOC_SOURCES)))
    return d.select("doc_id", "text", "n_chars", names[idx].alias("source_name"),
                    F.substring_index("text", "\n", 1).alias("question"))


def code_problems_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as problem statements; two ``benchmark`` passages serve as
    one example input/output pair, absent when ``doc_id % 3 = 0``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nb = b.select(F.count(F.lit(1))).scalar()
    bi = b.select(F.col("item_id").alias("_i"), F.col("text").alias("_in"))
    bo = b.select(F.col("item_id").alias("_o"), F.col("text").alias("_out"))
    j = (d.withColumn("_i", F.pmod(F.col("doc_id"), nb)).withColumn("_o", F.pmod(F.col("doc_id") + 1, nb))
         .join(bi, "_i", "left").join(bo, "_o", "left"))
    has = (F.col("doc_id") % 3 != 0) & F.col("_in").isNotNull() & F.col("_out").isNotNull()
    return j.select("doc_id", "text", "n_chars",
                    F.when(has, F.array("_in")).otherwise(F.array().cast("array<string>")).alias("inputs"),
                    F.when(has, F.array("_out")).otherwise(F.array().cast("array<string>")).alias("outputs"))


DUCK_FC_TURNS = """
fc_turns as (
  select conv_id, turn, role, content,
    case when role = 'assistant' and arank = 2 and conv_id % 16 <> 5 then concat('f', conv_id) end as tc_name,
    case when role = 'assistant' and arank = 2 then
      case conv_id % 4 when 0 then concat('{"city":"c', conv_id, '","days":', turn, '}')
        when 1 then '{"q,r":"x"}' when 2 then 'not json' else '[1,2]' end end as tc_args,
    case when conv_id % 2 = 0 then 'hermes_fc' else 'toolace' end as source
  from (select *, row_number() over (partition by conv_id, role order by turn) as arank from chat_log))"""

DUCK_LONG_DOCS = """
long_docs as (
  select doc_id, text, n_chars,
    (['govreport', 'pg19', 'scrolls', 'longbench', 'longbench_v2'])[
      (cast(regexp_extract(source, '(\\d+)', 1) as int) % 5) + 1] as source_name,
    split_part(text, chr(10), 1) as question
  from documents)"""

DUCK_CODE_PROBLEMS = """
code_problems as (
  select d.doc_id, d.text, d.n_chars,
    case when d.doc_id % 3 <> 0 and bi.text is not null and bo.text is not null then [bi.text] else [] end as inputs,
    case when d.doc_id % 3 <> 0 and bi.text is not null and bo.text is not null then [bo.text] else [] end as outputs
  from documents d
  left join benchmark bi on bi.item_id = d.doc_id % (select count(*) from benchmark)
  left join benchmark bo on bo.item_id = (d.doc_id + 1) % (select count(*) from benchmark))"""

_DEPS.update({"fc_turns": ["chat_log"], "long_docs": [], "code_problems": []})
_TEXT.update({"fc_turns": DUCK_FC_TURNS, "long_docs": DUCK_LONG_DOCS, "code_problems": DUCK_CODE_PROBLEMS})


def raw_fc_turns_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw function-calling conversations (``from``/``value``): the chat log
    with roles renamed, and a ``<tool_call>`` block appended to each second
    assistant turn.  The block varies by ``conv_id % 4``: arguments object,
    no arguments, broken JSON, arguments given as a string."""
    c = fc_turns_df(spark, sf_dir)
    frm = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    block = F.expr("""case conv_id % 4
        when 0 then concat('{"name": "f', conv_id, '", "arguments": {"city": "c', conv_id, '", "days": 2}}')
        when 1 then concat('{"name": "f', conv_id, '"}')
        when 2 then concat('{"name": "f', conv_id, '", "arguments": {"city": }')
        else concat('{"name": "f', conv_id, '", "arguments": "city"}') end""")
    value = F.when(F.col("tc_name").isNotNull(),
                   F.concat(F.col("content"), F.lit("\n<tool_call>\n"), block, F.lit("\n</tool_call>"))) \
        .otherwise(F.col("content"))
    return c.select("conv_id", "turn", frm.alias("from"), value.alias("value"))


DUCK_RAW_FC_TURNS = """
raw_fc_turns as (
  select conv_id, turn,
    case when role = 'user' then 'human' when role = 'assistant' then 'gpt' else role end as "from",
    case when tc_name is not null then content || chr(10) || '<tool_call>' || chr(10) ||
      case conv_id % 4
        when 0 then concat('{"name": "f', conv_id, '", "arguments": {"city": "c', conv_id, '", "days": 2}}')
        when 1 then concat('{"name": "f', conv_id, '"}')
        when 2 then concat('{"name": "f', conv_id, '", "arguments": {"city": }')
        else concat('{"name": "f', conv_id, '", "arguments": "city"}') end
      || chr(10) || '</tool_call>' else content end as value
  from fc_turns)"""

_DEPS.update({"raw_fc_turns": ["fc_turns"]})
_TEXT.update({"raw_fc_turns": DUCK_RAW_FC_TURNS})


def transcripts_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``USER: ... ASSISTANT: ...`` transcript per conversation.  The
    system turn (plus a function list when ``conv_id`` is even) is the system
    text.  Calls by ``conv_id % 4``: 0 a JSON call closed by its end tag;
    1 a single-quoted call ended by a blank line; 2 a broken call followed by
    a valid one in the next assistant turn; 3 none, or a call that is no object
    followed by a valid one (``conv_id % 8 = 3``)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    c = c.withColumn("_arank", F.row_number().over(w))
    call = F.expr("""case
        when role = 'assistant' and _arank = 2 and conv_id % 4 = 0
          then concat('<functioncall> {"name": "f', conv_id, '", "arguments": {"city": "c', conv_id, '"}} </functioncall>')
        when role = 'assistant' and _arank = 2 and conv_id % 4 = 1
          then concat('<functioncall> {''name'': ''f', conv_id, ''', ''arguments'': {''days'': 2}}', chr(10), chr(10),
                      'FUNCTION RESPONSE: ok')
        when role = 'assistant' and _arank = 2 and conv_id % 4 = 2 then '<functioncall> {broken</functioncall>'
        when role = 'assistant' and _arank = 2 and conv_id % 8 = 3 then '<functioncall> ["f"]</functioncall>'
        when role = 'assistant' and _arank = 3 and (conv_id % 4 = 2 or conv_id % 8 = 3)
          then concat('<functioncall> {"name": "g', conv_id, '", "arguments": 5}</functioncall>')
        else text end""")
    line = F.concat(F.when(F.col("role") == "user", F.lit("USER: ")).otherwise(F.lit("ASSISTANT: ")), call,
                    F.lit("\n\n"))
    body = c.filter(F.col("role") != "system").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "")
        .alias("chat"))
    sysd = c.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("_sys"))
    funcs = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(' Functions: [{"name": "f'), F.col("conv_id").cast("string"),
                                                      F.lit('", "parameters": {}}]'))).otherwise(F.lit(""))
    return body.join(sysd, "conv_id", "left").select(
        "conv_id", F.concat(F.coalesce("_sys", F.lit("")), funcs).alias("system"), "chat")


DUCK_TRANSCRIPTS = """
transcripts as (
  with c as (select *, row_number() over (partition by conv_id, role order by turn) as arank from conversations),
  l as (select conv_id, turn, role,
          case when role = 'user' then 'USER: ' else 'ASSISTANT: ' end ||
          case
            when role = 'assistant' and arank = 2 and conv_id % 4 = 0
              then concat('<functioncall> {"name": "f', conv_id, '", "arguments": {"city": "c', conv_id, '"}} </functioncall>')
            when role = 'assistant' and arank = 2 and conv_id % 4 = 1
              then concat('<functioncall> {''name'': ''f', conv_id, ''', ''arguments'': {''days'': 2}}', chr(10), chr(10),
                          'FUNCTION RESPONSE: ok')
            when role = 'assistant' and arank = 2 and conv_id % 4 = 2 then '<functioncall> {broken</functioncall>'
            when role = 'assistant' and arank = 2 and conv_id % 8 = 3 then '<functioncall> ["f"]</functioncall>'
            when role = 'assistant' and arank = 3 and (conv_id % 4 = 2 or conv_id % 8 = 3)
              then concat('<functioncall> {"name": "g', conv_id, '", "arguments": 5}</functioncall>')
            else text end || chr(10) || chr(10) as line
        from c),
  b as (select conv_id, string_agg(line, '' order by turn) as chat from l where role <> 'system' group by conv_id),
  s as (select conv_id, arg_min(text, turn) as sys from conversations where role = 'system' group by conv_id)
  select b.conv_id, coalesce(s.sys, '') || case when b.conv_id % 2 = 0
           then concat(' Functions: [{"name": "f', b.conv_id, '", "parameters": {}}]') else '' end as system, b.chat
  from b left join s on b.conv_id = s.conv_id)"""

_DEPS.update({"transcripts": []})
_TEXT.update({"transcripts": DUCK_TRANSCRIPTS})
