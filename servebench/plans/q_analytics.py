"""Run-analytics queries (C1-C20) over the stand-in request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import metrics as M
from ..operators import timeline as TL
from ..operators import views as V
from ..operators.records import finalize_records, inter_token_latency
from ..sources import standins as S
from .catalog import register

P = S.RUN
START, DUR, WARM, GPUS = S.RUN_START, S.RUN_DURATION, S.RUN_WARMUP, S.RUN_GPUS
CUT = "1704067230e0"   # start + warmup
EFF = "4290e0"         # duration - warmup


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finalize_records(S.requests_df(spark, sf_dir))


def _dist_inner(expr: str, prefix: str, cond: str = "status = 'success'") -> str:
    return (f"avg({expr}) filter (where {cond}) as {prefix}_avg, "
            + ", ".join(f"quantile_cont({expr}, {p}) filter (where {cond}) as {prefix}_{n}"
                        for n, p in (("p50", "0.5"), ("p90", "0.9"), ("p95", "0.95"), ("p99", "0.99"))))


def _dist_outer(prefix: str, gate: str | None = None, scale: str = "") -> str:
    out = []
    for n in ("avg", "p50", "p90", "p95", "p99"):
        v = f"round({prefix}_{n}{scale}, 6)"
        if gate:
            v = f"case when {gate} then {v} end"
        out.append(f"{v} as {prefix}_{n}")
    return ", ".join(out)


# ---------------------------------------------------------------------------
# run_summary (flagship)
# ---------------------------------------------------------------------------

RUN_SUMMARY_SQL = S.duck_with("records") + f"""
, a as (
  select count(*) filter (where status = 'success') as n_ok, count(*) as n_att,
    cast(sum(input_tokens) filter (where status = 'success') as bigint) as in_tok,
    cast(sum(output_tokens) filter (where status = 'success') as bigint) as out_tok,
    count(*) filter (where status = 'success' and tool_call_correct is not null) as tc_total,
    count(*) filter (where status = 'success' and tool_call_correct) as tc_correct,
    {_dist_inner('ttft', 'ttft')}, {_dist_inner('e2e_latency', 'e2e')}, {_dist_inner('output_tps', 'tps')}
  from records where request_sent_at >= {CUT})
select
  case when n_ok > 0 then n_ok else 0 end as total_requests,
  case when n_ok > 0 then n_att else 0 end as total_attempted,
  case when n_ok > 0 then n_att - n_ok else 0 end as failed_requests,
  case when n_ok > 0 and n_att > 0 then round((n_att - n_ok) / n_att, 6) else 0e0 end as error_rate,
  case when n_ok > 0 then round(n_ok * 60e0 / {EFF}, 6) else 0e0 end as rpm,
  case when n_ok > 0 then round(n_ok * 600e0 / {EFF}, 6) else 0e0 end as rpm_10,
  case when n_ok > 0 then in_tok else 0 end as total_input_tokens,
  case when n_ok > 0 then out_tok else 0 end as total_output_tokens,
  case when n_ok > 0 then round(out_tok / {EFF}, 6) else 0e0 end as system_throughput_tps,
  case when n_ok > 0 then round(in_tok / {EFF}, 6) else 0e0 end as input_throughput_tps,
  case when n_ok > 0 then round((in_tok + out_tok) / {EFF}, 6) else 0e0 end as combined_throughput_tps,
  case when n_ok > 0 then round(out_tok / {EFF} / {GPUS}e0, 6) end as throughput_per_gpu,
  case when n_ok > 0 then {EFF} else 0e0 end as effective_duration_seconds,
  {_dist_outer('ttft', 'n_ok > 0')}, {_dist_outer('e2e', 'n_ok > 0')}, {_dist_outer('tps', 'n_ok > 0')},
  case when n_ok > 0 and tc_total > 0 then round(tc_correct / tc_total, 6) end as tool_call_accuracy,
  case when n_ok > 0 then tc_total else 0 end as tool_call_total,
  case when n_ok > 0 then tc_correct else 0 end as tool_call_correct
from a
"""


@register("run_summary", RUN_SUMMARY_SQL)
def q_run_summary(spark, sf_dir):
    return M.run_summary(records(spark, sf_dir), P)


# Empty run (D4): a warmup longer than the whole log leaves no steady success.
EMPTY_WARMUP = 10.0 ** 9
RUN_SUMMARY_EMPTY_SQL = RUN_SUMMARY_SQL.replace(f">= {CUT}", f">= {START + EMPTY_WARMUP!r}e0")


@register("run_summary_empty", RUN_SUMMARY_EMPTY_SQL)
def q_run_summary_empty(spark, sf_dir):
    from dataclasses import replace

    return M.run_summary(records(spark, sf_dir), replace(P, warmup=EMPTY_WARMUP, duration=EMPTY_WARMUP + DUR - WARM))


@register("error_rate", S.duck_with("requests") + f"""
select count(*) as attempted, count(*) filter (where status = 'success') as succeeded,
  count(*) - count(*) filter (where status = 'success') as failed,
  case when count(*) > 0 then round((count(*) - count(*) filter (where status = 'success')) / count(*), 6)
       else 0e0 end as error_rate
from requests where request_sent_at >= {CUT}
""")
def q_error_rate(spark, sf_dir):
    return M.error_rate(S.requests_df(spark, sf_dir), P)


_FR = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@register("percentiles", S.duck_with("records") + """
, a as (select quantile_cont(e2e_latency, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])
               filter (where status = 'success') as q
        from records where request_sent_at >= """ + CUT + """)
select f.fraction, round(a.q[f.i], 6) as value
from a, (values (1, 0.0e0), (2, 0.1e0), (3, 0.25e0), (4, 0.5e0), (5, 0.75e0), (6, 0.9e0), (7, 0.95e0),
                (8, 0.99e0), (9, 1.0e0)) f(i, fraction)
""")
def q_percentiles(spark, sf_dir):
    return M.percentiles(records(spark, sf_dir), P, "e2e_latency", _FR)


@register("latency_distribution", S.duck_with("records") + f"""
, a as (select {_dist_inner('ttft', 'ttft')}, {_dist_inner('e2e_latency', 'e2e')}, {_dist_inner('output_tps', 'tps')}
        from records where request_sent_at >= {CUT})
select {_dist_outer('ttft')}, {_dist_outer('e2e')}, {_dist_outer('tps')} from a
""")
def q_latency_distribution(spark, sf_dir):
    return M.latency_distribution(records(spark, sf_dir), P)


@register("itl_distribution", S.duck_with("records", "chunk_times") + f"""
, gaps as (
  select request_id, arrived_at - lag(arrived_at) over (partition by request_id order by seq) as itl
  from chunk_times)
, a as (select {_dist_inner('itl', 'itl', 'true')}
        from gaps where itl is not null and request_id in
          (select request_id from records where request_sent_at >= {CUT} and status = 'success'))
select {_dist_outer('itl')} from a
""")
def q_itl_distribution(spark, sf_dir):
    req = S.requests_df(spark, sf_dir)
    itl = inter_token_latency(S.chunk_times_df(spark, sf_dir, req))
    return M.itl_distribution(finalize_records(req), itl, P)


@register("tool_accuracy", S.duck_with("requests") + f"""
select count(tool_call_correct) as tool_call_total,
  count(*) filter (where tool_call_correct) as tool_call_correct,
  case when count(tool_call_correct) > 0
       then round(count(*) filter (where tool_call_correct) / count(tool_call_correct), 6) end as tool_call_accuracy
from requests where request_sent_at >= {CUT} and status = 'success'
""")
def q_tool_accuracy(spark, sf_dir):
    return M.tool_accuracy(S.requests_df(spark, sf_dir), P)


@register("category_breakdown", S.duck_with("records") + f"""
, a as (select category, count(*) as count,
          {_dist_inner('ttft', 'ttft', 'true')}, {_dist_inner('e2e_latency', 'e2e', 'true')},
          {_dist_inner('output_tps', 'tps', 'true')},
          avg(input_tokens) as avg_input_tokens, avg(output_tokens) as avg_output_tokens
        from records where request_sent_at >= {CUT} and status = 'success' group by category)
select category, count, {_dist_outer('ttft')}, {_dist_outer('e2e')}, {_dist_outer('tps')},
  round(avg_input_tokens, 6) as avg_input_tokens, round(avg_output_tokens, 6) as avg_output_tokens
from a
""")
def q_category_breakdown(spark, sf_dir):
    return M.category_breakdown(records(spark, sf_dir), P)


# ---------------------------------------------------------------------------
# Time series and concurrency (C11-C14)
# ---------------------------------------------------------------------------

@register("throughput_timeseries", S.duck_with("records") + f"""
, s as (select * from records where status = 'success' and completed_at is not null and completed_at <> 0)
, g as (select cast(greatest(floor((completed_at - {START!r}e0) / 10e0), 0) as bigint) as bucket,
          cast(sum(output_tokens) as bigint) as output_tokens, count(*) as request_count,
          quantile_cont(ttft, 0.5) as t50, quantile_cont(ttft, 0.95) as t95,
          quantile_cont(e2e_latency, 0.5) as e50, quantile_cont(e2e_latency, 0.95) as e95
        from s group by 1)
, d as (select range as bucket from range(0, (select max(bucket) from g) + 1))
select round(d.bucket * 10e0, 1) as time_offset, coalesce(g.output_tokens, 0) as output_tokens,
  round(coalesce(g.output_tokens, 0) / 10e0, 1) as throughput_tps, coalesce(g.request_count, 0) as request_count,
  round(t50, 6) as ttft_p50, round(t95, 6) as ttft_p95, round(e50, 6) as e2e_p50, round(e95, 6) as e2e_p95
from d left join g on d.bucket = g.bucket
""")
def q_throughput_timeseries(spark, sf_dir):
    return TL.throughput_timeseries(records(spark, sf_dir), START, 10.0)


_EVENTS_SQL = """
, ev as (select request_sent_at as t, 1 as d from requests
         union all select completed_at, -1 from requests where completed_at is not null and completed_at <> 0)
, per as (select t, sum(d) as net from ev group by t)
, curve as (select t, cast(sum(net) over (order by t rows between unbounded preceding and current row) as bigint) as active
            from per)
"""


@register("in_flight", S.duck_with("requests") + _EVENTS_SQL + """
select round(t - {START!r}e0, 6) as t_offset, active from curve
""".replace("{START!r}", repr(START)))
def q_in_flight(spark, sf_dir):
    return TL.in_flight(S.requests_df(spark, sf_dir)).select(r6(F.col("t") - START).alias("t_offset"), "active")


@register("peak_concurrency", S.duck_with("requests") + _EVENTS_SQL + """
select max(active) as peak_concurrency,
  round(min(t) filter (where active = (select max(active) from curve)) - {START!r}e0, 6) as peak_offset
from curve
""".replace("{START!r}", repr(START)))
def q_peak_concurrency(spark, sf_dir):
    return TL.peak_concurrency(S.requests_df(spark, sf_dir)).select(
        "peak_concurrency", r6(F.col("peak_at") - START).alias("peak_offset"))


_N_TICKS = int(DUR + 30)
_SAMPLES_SQL = f"""
, ticks as (select range as k from range(0, {_N_TICKS}))
, samples as (
  select k, {START!r}e0 + k as sampled_at, count(r.request_id) as active
  from ticks left join requests r
    on r.request_sent_at <= {START!r}e0 + k
   and (r.completed_at is null or r.completed_at = 0 or r.completed_at > {START!r}e0 + k)
  group by k)
"""


def samples(spark, sf_dir):
    return TL.concurrency_samples(S.requests_df(spark, sf_dir), P, spark)


@register("concurrency_samples", S.duck_with("requests") + _SAMPLES_SQL + """
select k, round(sampled_at, 6) as sampled_at, active from samples
""")
def q_concurrency_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("k", r6("sampled_at").alias("sampled_at"), "active")


_EFF_SQL = S.duck_with("requests") + _SAMPLES_SQL + """
, g as (select active, lead(sampled_at) over (order by sampled_at) - sampled_at as dt from samples)
select case when count(dt) > 0 and sum(dt) <> 0 then round(sum(active * dt) / sum(dt), 6) else 0e0 end
  as effective_concurrency
from g where dt is not null
"""


@register("effective_concurrency", _EFF_SQL)
def q_effective_concurrency(spark, sf_dir):
    return TL.effective_concurrency(samples(spark, sf_dir))


@register("concurrency_series", S.duck_with("requests") + _SAMPLES_SQL + """
select round(sampled_at - (select min(sampled_at) from samples), 1) as time, active as concurrency from samples
""")
def q_concurrency_series(spark, sf_dir):
    return TL.concurrency_series(samples(spark, sf_dir))


# ---------------------------------------------------------------------------
# Report views
# ---------------------------------------------------------------------------

@register("ttft_scatter", S.duck_with("records") + """
select request_id, input_tokens, round(ttft, 6) as ttft, category
from records where status = 'success' and ttft is not null
""")
def q_ttft_scatter(spark, sf_dir):
    return V.ttft_scatter(records(spark, sf_dir))


@register("ttft_histogram", S.duck_with("records") + """
, v as (select ttft * 1000e0 as v from records where status = 'success' and ttft is not null and ttft * 1000e0 > 0)
, m as (select min(v) as lo, case when (max(v) - min(v)) / 30e0 <> 0 then (max(v) - min(v)) / 30e0 else 1e0 end as w
        from v having count(*) > 0)
, c as (select cast(least(floor((v - lo) / w), 29) as int) as bin, count(*) as count from v, m group by 1)
, b as (select cast(range as int) as bin from range(0, 30))
select b.bin, cast(floor(m.lo + b.bin * m.w + 0.5e0) as bigint) as label, coalesce(c.count, 0) as count
from b cross join m left join c on b.bin = c.bin
""")
def q_ttft_histogram(spark, sf_dir):
    return V.ttft_histogram(records(spark, sf_dir))


def _inner(sql: str) -> str:
    return "(" + sql.strip() + ")"


def _stack_sql(src: str, metric: str, prefix: str, scale: str) -> str:
    return "\nunion all\n".join(
        f"select '{metric}' as metric, {i} as stat_order, '{st}' as stat, round({prefix}_{st} * {scale}, 6) as value from {src}"
        for i, st in enumerate(("avg", "p50", "p90", "p95", "p99")))


def _latency_table_sql() -> str:
    from .catalog import _ORACLE

    lat, itl = _ORACLE["latency_distribution"], _ORACLE["itl_distribution"]
    return (f"with L as {_inner(lat)}, I as {_inner(itl)}\n"
            + "\nunion all\n".join([_stack_sql("L", "TTFT", "ttft", "1000e0"), _stack_sql("L", "E2E Latency", "e2e", "1000e0"),
                                    _stack_sql("L", "Output TPS", "tps", "1e0"), _stack_sql("I", "ITL", "itl", "1000e0")]))


@register("latency_table", _latency_table_sql())
def q_latency_table(spark, sf_dir):
    return V.latency_table(q_latency_distribution(spark, sf_dir), q_itl_distribution(spark, sf_dir))


def _category_chart_sql() -> str:
    from .catalog import _ORACLE

    return (f"with b as {_inner(_ORACLE['category_breakdown'])}\n"
            "select category, case when ttft_avg is not null and ttft_avg <> 0 then round(ttft_avg * 1000e0, 6) "
            "else 0e0 end as avg_ttft_ms, coalesce(round(tps_avg, 6), 0e0) as avg_tps from b")


@register("category_chart", _category_chart_sql())
def q_category_chart(spark, sf_dir):
    return V.category_chart(q_category_breakdown(spark, sf_dir))


def _cards_sql() -> str:
    cards = [
        (1, "System Throughput", "system_throughput_tps", "output tok/s", "true", "null"),
        (2, "Input Processing", "input_throughput_tps", "input tok/s", "true", "null"),
        (3, "Throughput per GPU", "throughput_per_gpu", "tok/s/GPU",
         "throughput_per_gpu is not null and throughput_per_gpu <> 0", "null"),
        (4, "Avg TTFT", "coalesce(ttft_avg, 0e0) * 1000e0", "ms", "true", "null"),
        (5, "P99 TTFT", "coalesce(ttft_p99, 0e0) * 1000e0", "ms", "true", "null"),
        (6, "Avg Output TPS", "coalesce(tps_avg, 0e0)", "tok/s per request", "true", "null"),
        (7, "Total Requests", "total_requests", "completed successfully", "true", "null"),
        (8, "RPM", "rpm", "requests/min", "true", "null"),
        (9, "Error Rate", "error_rate * 100e0", "@failed_requests / total_attempted", "true",
         "case when error_rate < 0.01e0 then 'green' when error_rate < 0.05e0 then 'yellow' else 'red' end"),
        (10, "Effective Concurrency", "round(effective_concurrency, 1)", "/ 64", "true", "null"),
        (11, "Total Output Tokens", "total_output_tokens", "generated", "true", "null"),
        (12, "Total Input Tokens", "total_input_tokens", "processed", "true", "null"),
        (13, "Tool Call Accuracy", "tool_call_accuracy * 100e0", "@tool_call_correct / tool_call_total",
         "tool_call_accuracy is not null", "null"),
    ]
    def unit_sql(u: str) -> str:
        if u.startswith("@"):   # counts caption: "<a> / <b>" from two columns
            a, b = (x.strip() for x in u[1:].split("/"))
            return f"concat(cast({a} as varchar), ' / ', cast({b} as varchar))"
        return f"'{u}'"

    body = "\nunion all\n".join(
        f"select {o} as card_order, '{n}' as card, round(cast({v} as double), 6) as value, {unit_sql(u)} as unit, "
        f"cast({r} as varchar) as rating from s, e where {show}" for o, n, v, u, show, r in cards)
    return f"with s as {_inner(RUN_SUMMARY_SQL)}, e as {_inner(_EFF_SQL)}\n{body}"


@register("summary_cards", _cards_sql())
def q_summary_cards(spark, sf_dir):
    return V.summary_cards(q_run_summary(spark, sf_dir), q_effective_concurrency(spark, sf_dir))


def _weights_values() -> str:
    from ..specs import CATEGORY_SPECS

    return ", ".join(f"('{c}', cast({s['weight']!r} as double))" for c, s in CATEGORY_SPECS.items())


@register("dispatch_mix", S.duck_with("requests") + f"""
, c as (select category, count(*) as n from requests group by category)
, w as (select * from (values {_weights_values()}) t(category, weight))
, tot as (select count(*) as total from requests)
, j as (select coalesce(c.category, w.category) as category, coalesce(c.n, 0) as n,
          case when total > 0 then coalesce(c.n, 0) / total else 0e0 end as share, coalesce(w.weight, 0e0) as weight
        from c full join w on c.category = w.category cross join tot)
select category, n, round(share, 6) as observed_share, weight, round(share - weight, 6) as share_minus_weight from j
""")
def q_dispatch_mix(spark, sf_dir):
    return V.dispatch_mix(S.requests_df(spark, sf_dir))


@register("category_breakdown_overall", S.duck_with("records") + f"""
, a as (select category, count(*) as count,
          {_dist_inner('ttft', 'ttft', 'true')}, {_dist_inner('e2e_latency', 'e2e', 'true')},
          {_dist_inner('output_tps', 'tps', 'true')},
          avg(input_tokens) as avg_input_tokens, avg(output_tokens) as avg_output_tokens
        from records where request_sent_at >= {CUT} and status = 'success'
        group by grouping sets ((category), ()))
select category, count, {_dist_outer('ttft')}, {_dist_outer('e2e')}, {_dist_outer('tps')},
  round(avg_input_tokens, 6) as avg_input_tokens, round(avg_output_tokens, 6) as avg_output_tokens
from a
""")
def q_category_breakdown_overall(spark, sf_dir):
    return M.category_breakdown(records(spark, sf_dir), P, with_overall=True)
