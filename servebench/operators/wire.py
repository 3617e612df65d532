"""Streamed-response capture -> chunks -> request fields.

Input is one row per received text line: ``(request_id, line_no, arrived_at,
line)``.  Every step groups by request id, so the work shuffles once on that
key; per-request state (the terminator position, the text, the tool calls) is
bounded by one response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col_
from ..functions.tokens import token_count
from ..specs import ERROR_BODY_CHARS, ERROR_MESSAGE_CHARS

# FIXED VALUES: wire format markers.
DATA_PREFIX = "data: "
DONE_LINE = "data: [DONE]"

# Numbers are read as text, so that one odd number (``2.0``, ``"0"``) costs
# neither its chunk nor the fields beside it.
TOOL_DELTA = T.StructType([
    T.StructField("index", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("function", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType())])),
])
# A delta as :func:`chunk_tool_deltas` gives it.
ASSEMBLED_DELTA = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("id", T.StringType()),
                                T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
CHUNK_SCHEMA = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("delta", T.StructType([
            T.StructField("content", T.StringType()),
            T.StructField("tool_calls", T.ArrayType(TOOL_DELTA))])),
    ]))),
    T.StructField("usage", T.StructType([
        T.StructField("prompt_tokens", T.StringType()),
        T.StructField("completion_tokens", T.StringType())])),
])


# FIXED VALUES: a chunk as servers send nearly all of them, known keys once each and in their
# usual order, one choice whose delta holds a plain text without escapes and no tool call.
# Its one group is that text with the quote before it.
_TEXT = r'"[^"\\\x00-\x1f]*+"'
PLAIN_CHUNK = (r"^\{" + "".join(f'(?:"{k}": ?(?:{_TEXT}|null), ?)?+' for k in ("id", "object"))
               + r'(?:"created": ?(?:0|[1-9][0-9]{0,17}), ?)?+'
               + "".join(f'(?:"{k}": ?(?:{_TEXT}|null), ?)?+' for k in ("model", "service_tier", "system_fingerprint"))
               + r'"choices": ?\[\{(?:"index": ?(?:0|[1-9][0-9]{0,8}), ?)?+"delta": ?\{'
               + f'(?:"role": ?(?:{_TEXT}|null), ?)?+"content": ?' + r'("[^"\\\x00-\x1f]*+)"\}'
               + f'(?:, ?"logprobs": ?null)?+(?:, ?"finish_reason": ?(?:{_TEXT}|null))?+' + r'\}\](?:, ?"usage": ?null)?+\}\z')
PLAIN_CHUNK_CHARS = 1 << 20     # longer payloads, which a JSON reader may refuse, go its way

# FIXED VALUES: the whitespace characters stripped from both ends of a line.
WS_CHARS = " \t\n\r\f\x0b"


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (space, tab, newline, carriage
    return, form feed, vertical tab) -- a character-set trim, no regex."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def parse_wire(lines: DataFrame, key: str = "request_id", order: str = "line_no",
               time_col: str = "arrived_at", line_col: str = "line") -> DataFrame:
    """Server-sent-event lines -> parsed chunks (B1).

    Lines are trimmed; blank lines and lines without the ``data: `` prefix are
    ignored; reading stops at ``data: [DONE]`` (per request, the first such
    line); payloads that are not one whole JSON object are skipped.

    One scan and one exchange.  Lines are read before that exchange, each once, so
    where they must be dealt by request, a chunk's text moves and not its line; no filter
    is pushed below the exchange, so nothing is read again for one.  Where a request
    ends needs its lines together, but in no order.  What is then grouped by request is
    not moved again.  Beside ``choices`` and ``usage`` a chunk has what :func:`chunk_facts`
    reads: ``_plain``, the text of a plain chunk with a quote before it, else empty, and
    ``_parsed``, what was parsed of any other.
    """
    line = col_(line_col)
    # The filter is pushed into whatever makes the lines and names the line once.
    t = (lines.filter(F.ltrim(line, F.lit(WS_CHARS)).startswith(DATA_PREFIX))
         .select(key, order, time_col, _stripped_data(line).alias("_l")))
    t = t.select(key, order, time_col, "_l", (F.col("_l") == DONE_LINE).alias("_done"), _plain_line(F.col("_l")).alias("_plain"))
    other = (F.col("_plain") == "") & ~F.col("_done")
    full = F.try_element_at(parsed_chunk(F.substring("_l", len(DATA_PREFIX) + 1, 1 << 30)), F.lit(1))
    t = t.select(key, order, time_col, "_done", "_plain", F.when(other, full).alias("_parsed"))
    place = F.struct(F.col(order).alias("o"))      # compared as a struct, no place comes before any other
    end = F.min(F.when(F.col("_done"), place)).over(Window.partitionBy(key))
    plain = F.col("_plain") != ""
    kept = (t.select("*", end.alias("_end")).filter(F.col("_end").isNull() | (place < F.col("_end")))
            .filter(plain | F.col("_parsed").isNotNull()))
    return kept.select(key, order, time_col,
                       F.when(plain, plain_chunk(F.col("_plain"))[0]["choices"]).otherwise(F.col("_parsed.choices")).alias("choices"),
                       F.col("_parsed.usage").alias("usage"), "_plain", "_parsed")


def _stripped_data(line: Column) -> Column:
    """:func:`strip_ws` of a line; one that begins with the prefix and ends with a brace has nothing to strip."""
    return F.when(line.startswith(DATA_PREFIX) & line.endswith("}"), line).otherwise(strip_ws(line))


def _plain_line(line: Column) -> Column:
    """:func:`plain_text` of what follows the prefix of a stripped line."""
    return F.when(F.octet_length(line) < PLAIN_CHUNK_CHARS, F.regexp_extract(line, "^" + DATA_PREFIX + PLAIN_CHUNK[1:], 1)).otherwise(F.lit(""))


def plain_text(payload: Column) -> Column:
    """The text of a :data:`PLAIN_CHUNK` with a quote before it; empty for any other payload."""
    return F.when(F.length(payload) < PLAIN_CHUNK_CHARS, F.regexp_extract(payload, PLAIN_CHUNK, 1)).otherwise(F.lit(""))


def plain_chunk(plain: Column) -> Column:
    """:func:`parsed_chunk` of the payload whose :func:`plain_text` this is: what one pattern
    has read needs no JSON parse."""
    delta = F.struct(F.substring(plain, 2, 1 << 30).alias("content"),
                     F.lit(None).cast(T.ArrayType(TOOL_DELTA)).alias("tool_calls"))
    return F.array(F.struct(F.array(F.struct(delta.alias("delta"))).alias("choices"),
                            F.lit(None).cast(CHUNK_SCHEMA["usage"].dataType).alias("usage"), F.lit(True).alias("whole")))


def parsed_chunk(payload: Column) -> Column:
    """``[(choices, usage, true)]`` of a payload that is one whole JSON object, else
    an empty array: a single parse to VARIANT, framed as in :func:`json_valid`."""
    framed = F.concat(F.lit('{"value":'), payload, F.lit(',"end":0}'))

    def fields(v: Column) -> Column:
        whole = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) == 2
        chunk = F.try_variant_get(v, "$.value", CHUNK_SCHEMA.simpleString())
        return F.when(whole & strip_ws(payload).startswith("{"), F.struct(
            chunk["choices"].alias("choices"), chunk["usage"].alias("usage"), F.lit(True).alias("whole")))

    return F.filter(F.transform(F.array(F.try_parse_json(framed)), fields), lambda x: x.isNotNull())


def whole_number(c: Column | str) -> Column:
    """A number read as text as a whole number; NULL when it is none."""
    c = col_(c)
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def _one(choices: Column, of_one, of_any: Column) -> Column:
    """A chunk's figure: ``of_one`` of its delta where it has one choice, as nearly all
    have, which needs no walk over an array; ``of_any`` where it has not."""
    return F.when(F.size(choices) == 1, of_one(F.get(choices, F.lit(0))["delta"])).otherwise(of_any)


def has_token(choices: Column) -> Column:
    def carries(d: Column) -> Column:
        return (F.coalesce(F.length(d["content"]), F.lit(0)) > 0) | (F.coalesce(F.size(d["tool_calls"]), F.lit(0)) > 0)

    return _one(choices, carries, F.coalesce(F.exists(choices, lambda c: carries(c["delta"])), F.lit(False)))


def chunk_content(choices: Column) -> Column:
    return _one(choices, lambda d: F.coalesce(d["content"], F.lit("")),
                F.coalesce(F.array_join(F.transform(choices, lambda c: c["delta"]["content"]), ""), F.lit("")))


def n_tool_deltas(choices: Column) -> Column:
    def deltas(d: Column) -> Column:
        return F.coalesce(F.size(d["tool_calls"]), F.lit(0))

    return _one(choices, deltas, F.coalesce(F.aggregate(choices, F.lit(0), lambda a, c: a + deltas(c["delta"])), F.lit(0)))


def chunk_facts(chunks: DataFrame, key: str = "request_id", order: str = "line_no",
                time_col: str = "arrived_at") -> DataFrame:
    """Scalar facts per chunk: content text, whether it carries a token (B2),
    number of tool-call deltas, and usage numbers."""
    return chunks.select(key, order, time_col, *_facts(chunks), whole_number("usage.prompt_tokens").alias("prompt_tokens"),
                         whole_number("usage.completion_tokens").alias("completion_tokens"))


def _facts(chunks: DataFrame) -> list[Column]:
    """content, has_token and n_tool_deltas of chunks; those :func:`parse_wire` read by the pattern have but a text."""
    if "_plain" not in chunks.columns:
        ch = F.col("choices")
        return [chunk_content(ch).alias("content"), has_token(ch).alias("has_token"), n_tool_deltas(ch).alias("n_tool_deltas")]
    plain, ch = F.col("_plain") != "", F.col("_parsed.choices")
    return [F.when(plain, F.substring("_plain", 2, 1 << 30)).otherwise(chunk_content(ch)).alias("content"),
            F.when(plain, F.octet_length("_plain") > 1).otherwise(has_token(ch)).alias("has_token"),
            F.when(plain, F.lit(0)).otherwise(n_tool_deltas(ch)).alias("n_tool_deltas")]


def first_token(facts: DataFrame, key: str = "request_id", time_col: str = "arrived_at") -> DataFrame:
    """First token arrival, last token arrival and number of token-bearing
    chunks per request (B2)."""
    tok = F.col("has_token")
    return facts.groupBy(key).agg(F.min(F.when(tok, F.col(time_col))).alias("first_token_at"),
                                  F.max(F.when(tok, F.col(time_col))).alias("last_token_at"),
                                  F.count_if(tok).alias("n_token_chunks"))


def token_times(facts: DataFrame, key: str = "request_id", order: str = "line_no",
                time_col: str = "arrived_at") -> DataFrame:
    """Arrival rows of token-bearing chunks, numbered per request (input of
    B9)."""
    return facts.filter("has_token").select(key, F.col(order).alias("seq"), time_col)


def last_usage(facts: DataFrame, key: str = "request_id", order: str = "line_no") -> DataFrame:
    """Last non-zero ``prompt_tokens`` and ``completion_tokens``."""
    return facts.groupBy(key).agg(_last_truthy("prompt_tokens", order).alias("usage_prompt_tokens"),
                                  _last_truthy("completion_tokens", order).alias("usage_completion_tokens"))


def _last_truthy(c: str, order: str) -> Column:
    kept = F.when(F.col(c) != 0, F.col(c))
    return F.max_by(kept, F.when(kept.isNotNull(), F.col(order)))


def generated_text(facts: DataFrame, key: str = "request_id", order: str = "line_no") -> DataFrame:
    """Content deltas concatenated in arrival order (B4).  Sorting an explicit
    key after ``collect_list`` keeps the order deterministic (G6)."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("content").alias("c"))))
    return facts.filter(F.length("content") > 0).groupBy(key).agg(
        F.array_join(F.transform(parts, lambda s: s["c"]), "").alias("text"))


def tool_call_deltas(chunks: DataFrame, key: str = "request_id", order: str = "line_no") -> DataFrame:
    """One row per tool-call delta, across all choices, in arrival order."""
    # Chunks read by the pattern have none, so their choices are not made to be looked through.
    choices = "_parsed.choices" if "_parsed" in chunks.columns else "choices"
    some = F.exists(choices, lambda c: F.size(c["delta"]["tool_calls"]) > 0)
    c = chunks.filter(some).select(key, order, F.posexplode(choices).alias("_cpos", "_c"))
    d = c.select(key, order, "_cpos", F.posexplode("_c.delta.tool_calls").alias("_tpos", "_t"))
    return d.select(key, order, "_cpos", "_tpos",
                    F.coalesce(whole_number("_t.index"), F.lit(0)).cast("int").alias("index"),
                    F.col("_t.id").alias("id"), F.col("_t.function.name").alias("name"),
                    F.col("_t.function.arguments").alias("arguments"))


def assemble_tool_calls(deltas: DataFrame, key: str = "request_id", order: str = "line_no") -> DataFrame:
    """Tool calls rebuilt from deltas (B6): grouped by tool ``index``; the last
    non-empty id wins; name and argument pieces are concatenated in order."""
    pos = F.struct(F.col(order), F.col("_cpos"), F.col("_tpos"))

    def concat_truthy(c: str) -> Column:
        x = F.col(c)
        parts = F.sort_array(F.collect_list(F.when(F.length(x) > 0, F.struct(pos.alias("p"), x.alias("v")))))
        return F.array_join(F.transform(parts, lambda s: s["v"]), "")

    idv = F.col("id")
    return deltas.groupBy(key, "index").agg(
        F.coalesce(F.max_by(F.when(F.length(idv) > 0, idv), F.when(F.length(idv) > 0, pos)), F.lit("")).alias("id"),
        concat_truthy("name").alias("name"), concat_truthy("arguments").alias("arguments"))


def json_valid(c: Column | str) -> Column:
    """True when the whole text is one JSON value; never NULL.

    The text is set as the first value of a two-field object: text after it
    breaks that object or its key list.  ``try_parse_json`` rejects what the
    key list tolerates, such as single quotes.  Residual difference from a
    strict parser: NaN literals and duplicate keys."""
    c = col_(c)
    framed = F.concat(F.lit('{"value":'), c, F.lit(',"end":0}'))
    ok = F.try_parse_json(framed).isNotNull() & (F.json_object_keys(framed) == F.array(F.lit("value"), F.lit("end")))
    return F.coalesce(ok, F.lit(False))


def json_object_valid(c: Column | str) -> Column:
    """True when the whole text is one JSON object; never NULL."""
    return F.coalesce(strip_ws(c).startswith("{"), F.lit(False)) & json_valid(c)


def score_tool_calls(calls: DataFrame, expectations: DataFrame, scored: DataFrame,
                     key: str = "request_id") -> DataFrame:
    """Tool-call correctness per scored request.

    ``scored`` lists the requests to score (tool_call prompts with an
    expectation that finished successfully); ``expectations`` holds
    ``exp_name`` and ``required_args``.  No calls -> false; otherwise the call
    with the expected name and the lowest index decides: its arguments must be
    one JSON object containing every required key.  Requests not in
    ``scored`` get NULL (left to the caller).
    """
    e = expectations.select(key, "exp_name", "required_args")
    hit = F.col("name") == F.col("exp_name")
    # One aggregate over the calls: how many there are, and the deciding one's arguments.
    j = (scored.select(key).join(e, key, "left").join(calls.select(key, "index", "name", "arguments"), key, "left")
         .groupBy(key).agg(F.any_value("exp_name").alias("exp_name"), F.any_value("required_args").alias("required_args"),
                           F.count("index").alias("_n_calls"),
                           F.min_by(F.when(hit, F.col("arguments")), F.when(hit, F.col("index"))).alias("_args")))
    args = F.col("_args")
    keys = F.json_object_keys(args)
    ok = (json_object_valid(args)
          & (F.size(F.array_except(F.coalesce("required_args", F.array().cast("array<string>")), keys)) == 0))
    correct = (F.when(F.col("exp_name").isNull(), F.lit(None).cast("boolean"))
               .when(F.col("_n_calls") == 0, F.lit(False))
               .when(args.isNull(), F.lit(False))
               .otherwise(F.coalesce(ok, F.lit(False))))
    return j.select(key, correct.alias("tool_call_correct"))


def classify_status(outcomes: DataFrame, timeout_kinds=("asyncio.TimeoutError",),
                    http_error_kind: str = "httpx.HTTPStatusError",
                    cancelled_kind: str = "asyncio.CancelledError") -> DataFrame:
    """Status and error text from a captured outcome.

    ``outcomes`` has ``exc_kind`` (NULL on success), ``http_code``, ``body``
    and ``message``.  Only the kinds in ``timeout_kinds`` map to ``timeout``
    (D6: pass e.g. ``httpx.ReadTimeout`` too to also treat client timeouts as
    timeouts); a cancelled request stays ``pending`` (D5).
    """
    k = F.col("exc_kind")
    is_timeout = k.isin(*timeout_kinds)
    http_text = F.concat(F.lit("HTTP "), F.col("http_code").cast("string"), F.lit(": "),
                         F.coalesce(F.substring("body", 1, ERROR_BODY_CHARS),
                                    F.lit("(streaming response body not available)")))
    status = (F.when(k.isNull(), "success").when(k == cancelled_kind, "pending")
              .when(is_timeout, "timeout").otherwise("error"))
    error = (F.when(k.isNull() | (k == cancelled_kind), F.lit("")).when(is_timeout, F.lit("Request timed out"))
             .when(k == http_error_kind, http_text)
             .otherwise(F.coalesce(F.substring("message", 1, ERROR_MESSAGE_CHARS), F.lit(""))))
    return outcomes.select("request_id", status.alias("status"), error.alias("error"))


def output_tokens_with_fallback(usage_tokens: Column, text: Column, counter: str = "ws") -> Column:
    """Usage count when non-zero, else the token count of the generated text
    when non-empty, else 0 (B5).  Pass a NULL text for requests that did not
    complete (the fallback runs only after a finished stream)."""
    return (F.when(usage_tokens.isNotNull() & (usage_tokens != 0), usage_tokens)
            .when(F.length(text) > 0, token_count(text, counter).cast("bigint"))
            .otherwise(F.lit(0).cast("bigint")))


def wire_summary(facts: DataFrame, key: str = "request_id", order: str = "line_no",
                 time_col: str = "arrived_at") -> DataFrame:
    """B2 + B3 + B4 in one aggregate: a single shuffle of the chunk facts."""
    tok = F.col("has_token")
    parts = F.sort_array(F.collect_list(F.when(F.length("content") > 0,
                                               F.struct(F.col(order).alias("o"), F.col("content").alias("c")))))
    return facts.groupBy(key).agg(
        F.min(F.when(tok, F.col(time_col))).alias("first_token_at"),
        F.max(F.when(tok, F.col(time_col))).alias("last_token_at"),
        F.count_if(tok).alias("n_token_chunks"),
        _last_truthy("prompt_tokens", order).alias("usage_prompt_tokens"),
        _last_truthy("completion_tokens", order).alias("usage_completion_tokens"),
        F.array_join(F.transform(parts, lambda s: s["c"]), "").alias("text"))


# ---------------------------------------------------------------------------
# One pass per request: everything a record needs from the capture
# ---------------------------------------------------------------------------

def chunk_tool_deltas(choices: Column) -> Column:
    """Tool-call deltas of one chunk across all its choices, in order."""
    return F.flatten(F.transform(F.coalesce(choices, F.array().cast(CHUNK_SCHEMA["choices"].dataType)),
                                 lambda c, cpos: F.transform(
                                     F.coalesce(c["delta"]["tool_calls"], F.array().cast(T.ArrayType(TOOL_DELTA))),
                                     lambda t, tpos: F.struct(
                                         F.coalesce(whole_number(t["index"]), F.lit(0)).cast("int").alias("index"), t["id"].alias("id"),
                                         t["function"]["name"].alias("name"),
                                         t["function"]["arguments"].alias("arguments")))))


def assemble(deltas: Column) -> Column:
    """Tool calls from an ordered delta list: grouped by index (sorted), last
    non-empty id, names and arguments concatenated (B6, per request)."""
    idxs = F.array_sort(F.array_distinct(F.transform(deltas, lambda d: d["index"])))

    def of(i):
        return F.filter(deltas, lambda d: d["index"] == i)

    def cat(i, field):
        return F.array_join(F.transform(F.filter(of(i), lambda d: F.length(d[field]) > 0), lambda d: d[field]), "")

    return F.transform(idxs, lambda i: F.struct(
        i.alias("index"),
        F.coalesce(F.try_element_at(F.filter(of(i), lambda d: F.length(d["id"]) > 0), F.lit(-1))["id"],
                   F.lit("")).alias("id"),
        cat(i, "name").alias("name"), cat(i, "arguments").alias("arguments")))


def request_wire_facts(lines: DataFrame, key: str = "request_id", order: str = "line_no",
                       time_col: str = "arrived_at") -> DataFrame:
    """Per request, in ONE aggregate over the parsed capture: first/last
    token arrival, token-chunk count, last non-zero usage, generated text,
    assembled tool calls and the mean inter-token gap.  The only lists
    gathered are the text parts and tool-call deltas of one response, which
    are the output itself."""
    ch = parse_wire(lines, key, order, time_col)
    content, token, _ = _facts(ch)
    facts = ch.select(key, order, time_col, content, token,
                      F.when(F.col("_parsed").isNotNull(), chunk_tool_deltas(F.col("_parsed.choices"))).alias("tool_deltas"),
                      whole_number("usage.prompt_tokens").alias("prompt_tokens"),
                      whole_number("usage.completion_tokens").alias("completion_tokens"))
    tok = F.col("has_token")
    parts = F.sort_array(F.collect_list(F.when(F.length("content") > 0,
                                               F.struct(F.col(order).alias("o"), F.col("content").alias("c")))))
    tdel = F.sort_array(F.collect_list(F.when(F.size("tool_deltas") > 0,
                                              F.struct(F.col(order).alias("o"), F.col("tool_deltas").alias("d")))))
    a = facts.groupBy(key).agg(
        F.min(F.when(tok, F.col(time_col))).alias("first_token_at"),
        F.max(F.when(tok, F.col(time_col))).alias("last_token_at"),
        F.count_if(tok).alias("n_token_chunks"),
        _last_truthy("prompt_tokens", order).alias("usage_prompt_tokens"),
        _last_truthy("completion_tokens", order).alias("usage_completion_tokens"),
        F.array_join(F.transform(parts, lambda s: s["c"]), "").alias("text"),
        F.flatten(F.transform(tdel, lambda s: s["d"])).alias("_deltas"))
    # Consecutive gaps telescope: their mean is (last - first) / (n - 1), so
    # no list of arrival times is needed.
    n_gaps = F.col("n_token_chunks") - 1
    itl_avg = F.when(n_gaps > 0, (F.col("last_token_at") - F.col("first_token_at")) / n_gaps)
    return a.select(key, "first_token_at", "last_token_at", "n_token_chunks", "usage_prompt_tokens",
                    "usage_completion_tokens", "text", assemble(F.col("_deltas")).alias("tool_calls"),
                    itl_avg.alias("itl_avg"))


def score_inline(calls: Column, exp_name: Column, required: Column) -> Column:
    """B7 on a per-request call array: no calls -> false; the first call (by
    index) with the expected name decides; NULL when nothing is expected."""
    match = F.try_element_at(F.filter(calls, lambda c: c["name"] == exp_name), F.lit(1))
    args = match["arguments"]
    ok = json_object_valid(args) & (F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")),
                                                          F.json_object_keys(args))) == 0)
    return (F.when(exp_name.isNull(), F.lit(None).cast("boolean"))
            .when(F.coalesce(F.size(calls), F.lit(0)) == 0, F.lit(False))
            .when(match.isNull(), F.lit(False))
            .otherwise(F.coalesce(ok, F.lit(False))))


def request_records_from_wire(requests: DataFrame, lines: DataFrame, expectations: DataFrame,
                              key: str = "request_id", counter: str = "ws") -> DataFrame:
    """Per-request record fields rebuilt from the capture (B2-B7, B5) joined to
    the request log.  The capture is parsed and shuffled once."""
    w = request_wire_facts(lines, key)
    e = expectations.select(key, "exp_name", "required_args")
    j = (requests.drop("first_token_at", "tool_call_correct", "output_tokens")
         .join(w, key, "left").join(e, key, "left"))
    ok = F.col("status") == "success"
    scored = ok & (F.col("category") == "tool_call")
    up = F.col("usage_prompt_tokens")
    out_tok = output_tokens_with_fallback(F.col("usage_completion_tokens"),
                                          F.when(ok, F.col("text")), counter)
    tc = F.when(scored, score_inline(F.col("tool_calls"), F.col("exp_name"), F.col("required_args")))
    return j.select(
        key, "category", "status", "request_sent_at", "first_token_at", "completed_at",
        F.when(up.isNotNull(), up).otherwise(F.col("input_tokens")).alias("input_tokens"),
        out_tok.alias("output_tokens"), tc.alias("tool_call_correct"), "itl_avg")
