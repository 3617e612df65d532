"""Per-request records: finalisation (B10), inter-token latency (B9), export
projection (B11) and token counts of texts and message lists (B12, B13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import truthy
from ..functions.tokens import token_count

EXPORT_COLUMNS = ["prompt_id", "category", "status", "request_sent_at", "first_token_at",
                  "completed_at", "ttft", "e2e_latency", "output_tps", "input_tokens",
                  "output_tokens", "tool_call_correct", "error"]


def finalize_records(requests: DataFrame) -> DataFrame:
    """Add ``ttft``, ``e2e_latency`` and ``output_tps``.

    Missing or zero timestamps leave the figure NULL (D3); output rate needs
    tokens > 0 and a positive generation time.  Applies to failed requests too.
    """
    sent, first, done = F.col("request_sent_at"), F.col("first_token_at"), F.col("completed_at")
    gen = done - first
    return requests.select(
        "*",
        F.when(truthy(first) & truthy(sent), first - sent).alias("ttft"),
        F.when(truthy(done) & truthy(sent), done - sent).alias("e2e_latency"),
        F.when(truthy(done) & truthy(first) & (F.col("output_tokens") > 0) & (gen > 0),
               F.col("output_tokens") / gen).alias("output_tps"))


def inter_token_latency(token_times: DataFrame, key: str = "request_id",
                        order: str = "seq", time_col: str = "arrived_at", block: int | None = None) -> DataFrame:
    """One row per gap between consecutive token arrivals (B9); requests
    with fewer than two arrivals give no rows.

    One pass over the arrivals: ``lag`` streams over a request's sorted rows, which
    spill where they are many, and arrivals that come dealt by request are not moved
    again.  What makes the arrivals (a parse, mostly) runs once.  ``block`` is taken
    for callers of the former form, which cut a request into blocks; it changes nothing.
    """
    before = F.lag(time_col).over(Window.partitionBy(key).orderBy(order))
    return (token_times.select(key, order, time_col, before.alias("_prev"))
            .select(key, order, (F.col(time_col) - F.col("_prev")).alias("itl")).filter(F.col("itl").isNotNull()))


def itl_arrays(token_times: DataFrame, key: str = "request_id", order: str = "seq",
               time_col: str = "arrived_at") -> DataFrame:
    """Array form of B9: ``itl_values`` per request (consecutive differences)."""
    ts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(time_col).alias("t")))),
                     lambda s: s["t"])
    return (token_times.groupBy(key).agg(ts.alias("_ts"))
            .select(key, F.when(F.size("_ts") >= 2,
                                F.zip_with(F.slice("_ts", 2, F.size("_ts")), F.slice("_ts", 1, F.size("_ts") - 1),
                                           lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))
                    .alias("itl_values")))


def record_export(records: DataFrame, itl: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """The 14-column per-request export (B11): record fields plus ``itl_avg``.

    ``itl`` holds one row per gap (from :func:`inter_token_latency`); it is
    averaged per request with map-side partial aggregation and joined back.
    """
    rec = records
    if "prompt_id" not in rec.columns:
        rec = rec.withColumn("prompt_id", F.col(key).cast("string"))
    if "error" not in rec.columns:
        rec = rec.withColumn("error", F.lit(""))
    if itl is not None:
        avg = itl.groupBy(key).agg(F.avg("itl").alias("itl_avg"))
        rec = rec.drop("itl_avg").join(avg, key, "left")
    elif "itl_avg" not in rec.columns:
        rec = rec.withColumn("itl_avg", F.lit(None).cast("double"))
    return rec.select(key, *EXPORT_COLUMNS, "itl_avg")




def doc_tokens(docs: DataFrame, text_col: str = "text", key: str = "doc_id", counter: str = "ws") -> DataFrame:
    """Token count of every text."""
    return docs.select(key, token_count(text_col, counter).alias("n_tokens"))




def conversation_tokens(chat: DataFrame, key: str = "conv_id", role: str = "role", content: str = "content",
                        counter: str = "ws") -> DataFrame:
    """Message-list token count per conversation (B13, D8): 4 per message
    plus the tokens of its role and content, plus 2.  A sum with constant
    state per conversation; no message list is built."""
    from ..functions.tokens import PER_MESSAGE_TOKENS, REPLY_PRIMING_TOKENS

    per = F.lit(PER_MESSAGE_TOKENS) + token_count(role, counter) + token_count(content, counter)
    return chat.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_messages"),
                                 (F.lit(REPLY_PRIMING_TOKENS) + F.sum(per)).cast("int").alias("n_tokens"))
