"""Chat-log converters.

The reference walks a chat log once, filling per-category quotas in source
order.  Here every per-conversation fact is an aggregate with constant state
(no message lists are collected), and quotas become cut-off keys: a quota
takes every eligible row in order until full, so "row r goes to short" is
"r is short-eligible and its key is at or below the N-th smallest
short-eligible key", found by counting key prefixes.  Spill-over to reasoning
is the complement (P2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.selection import thresholds, up_to
from ...functions.tokens import PER_MESSAGE_TOKENS, REPLY_PRIMING_TOKENS, token_count
from ...specs import CATEGORY_SPECS, REASONING_KEYWORDS
from ..wire import strip_ws
from .common import within

CHAT_CATEGORIES = ("short_chat", "medium_chat", "multi_turn", "reasoning")
MIN_WORDS = 3
MULTI_TURN_MIN_TURNS = 5
# FIXED VALUES: the characters that part words (Unicode blanks and separators).
BLANKS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
          "\u200a\u2028\u2029\u202f\u205f\u3000")


def conversation_facts(chat_log: DataFrame, key: str = "conv_id", order: str = "turn",
                       counter: str = "ws") -> DataFrame:
    """One row per conversation with constant-state aggregates: turn count,
    language/toxicity/redaction flags, the first non-blank user turn
    (trimmed), and the multi-turn message count and token total."""
    role, content = F.col("role"), F.col("content")
    stripped = F.btrim(content, F.lit(BLANKS))
    user_nb = (role == "user") & (F.length(stripped) > 0)
    mt = role.isin("user", "assistant") & (F.length(stripped) > 0)
    redacted = F.col("redacted") if "redacted" in chat_log.columns else F.lit(False)
    toxic = F.col("toxic") if "toxic" in chat_log.columns else F.lit(0)
    lang = F.col("lang") if "lang" in chat_log.columns else F.lit(None).cast("string")
    a = chat_log.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.max(lang).alias("lang"),
        F.max(F.coalesce(toxic.cast("int"), F.lit(0))).alias("toxic"),
        F.max(F.coalesce(redacted.cast("boolean"), F.lit(False))).alias("redacted"),
        F.min_by(F.when(user_nb, stripped), F.when(user_nb, F.col(order))).alias("first_user"),
        F.count_if(mt).alias("n_mt"),
        F.sum(F.when(mt, F.lit(PER_MESSAGE_TOKENS) + token_count(role, counter) + token_count(content, counter)))
        .alias("_mt_sum"))
    return a.withColumn("mt_tokens", (F.lit(REPLY_PRIMING_TOKENS) + F.coalesce("_mt_sum", F.lit(0))).cast("int")) \
        .drop("_mt_sum")


def chat_eligible(facts: DataFrame, languages=("English",)) -> Column:
    """Language missing, empty or accepted, non-empty, not toxic, not redacted."""
    return ((F.col("lang").isNull() | (F.col("lang") == "") | F.col("lang").isin(*languages)) & (F.col("n_turns") > 0)
            & (F.col("toxic") == 0) & ~F.col("redacted"))


def first_user_turn(facts: DataFrame, languages=("English",), counter: str = "ws") -> DataFrame:
    """Eligible conversations whose first non-blank user turn has at least
    three words (E2), with its text and single-message token counts."""
    fu = F.col("first_user")
    words = F.regexp_count(fu, F.lit(f"[^{BLANKS}]+"))
    out = facts.filter(chat_eligible(facts, languages) & fu.isNotNull() & (words >= MIN_WORDS))
    text_tok = token_count(fu, counter)
    single = (F.lit(REPLY_PRIMING_TOKENS + PER_MESSAGE_TOKENS) + token_count(F.lit("user"), counter) + text_tok)
    return out.select("*", words.alias("n_words"), text_tok.alias("text_tok"), single.cast("int").alias("single_tok"))


def _has_keyword(text: Column, keywords) -> Column:
    low = F.lower(text)
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | low.contains(kw)
    return cond


def route_chat(passing: DataFrame, fetch_targets: dict, key: str = "conv_id", specs: dict | None = None,
               keywords=REASONING_KEYWORDS, max_input_tokens: int = 80000) -> tuple[DataFrame, DataFrame]:
    """Route first user turns to short / medium / reasoning (E3) and pick
    multi-turn conversations (E4).  Returns ``(routed, multi_turn)``.

    ``passing`` is the output of :func:`first_user_turn`; ``key`` is the
    source order (unique).  All passing rows are considered.
    ``max_input_tokens`` caps multi-turn only.
    """
    specs = specs or CATEGORY_SPECS
    t = {c: int(fetch_targets.get(c, 0)) for c in CHAT_CATEGORIES}
    tok = F.col("text_tok")
    base = passing
    s, m, r, mt = (specs[c] for c in CHAT_CATEGORIES[:2] + ("reasoning", "multi_turn"))
    short_el = within(tok, s["min_tok"], s["max_tok"])
    med_el = (tok > F.lit(m["min_tok"])) & (tok <= F.lit(m["max_tok"]))
    reas_el = within(tok, r["min_tok"], r["max_tok"]) & _has_keyword(F.col("first_user"), keywords)

    hi = min(mt["max_tok"], max_input_tokens)
    mt_el = ((F.col("n_turns") >= MULTI_TURN_MIN_TURNS) & (F.col("n_mt") >= MULTI_TURN_MIN_TURNS)
             & within(F.col("mt_tokens"), mt["min_tok"], hi))
    # The three quotas that depend on no other, in one grouped pass: a row
    # stands once under each category it is eligible for.
    offers = base.select(key, F.explode(F.filter(F.array(
        F.when(short_el, F.lit("short_chat")), F.when(med_el, F.lit("medium_chat")), F.when(mt_el, F.lit("multi_turn"))),
        lambda c: c.isNotNull())).alias("category"))
    cuts = thresholds(offers, {(c,): n for c, n in t.items() if c != "reasoning"}, ["category"], key)
    b = base.withColumns({"_short": short_el & up_to(base, key, cuts.get(("short_chat",))),
                          "_medium": med_el & up_to(base, key, cuts.get(("medium_chat",)))})
    # Spill-over: what neither took.
    b = b.withColumn("_spill", reas_el & ~F.col("_short") & ~F.col("_medium"))
    spill = b.filter("_spill").select(key, F.lit("reasoning").alias("category"))
    more = thresholds(spill, {("reasoning",): t["reasoning"]}, ["category"], key)
    category = (F.when(F.col("_short"), "short_chat").when(F.col("_medium"), "medium_chat")
                .when(F.col("_spill") & up_to(b, key, more.get(("reasoning",))), "reasoning"))
    routed = (b.withColumn("category", category).filter("category IS NOT NULL")
              .select(key, "category", "first_user", "text_tok", F.col("single_tok").alias("n_tokens")))
    multi = (base.filter(mt_el & up_to(base, key, cuts.get(("multi_turn",))))
             .select(key, F.lit("multi_turn").alias("category"), F.col("n_mt").alias("n_messages"), F.col("mt_tokens").alias("n_tokens")))
    return routed, multi


def multi_turn_messages(chat_log: DataFrame, chosen: DataFrame, key: str = "conv_id",
                        order: str = "turn") -> DataFrame:
    """Ordered user/assistant messages of the chosen conversations.  Only
    conversations that passed the token cap are collected, so each collected
    list is bounded by that cap."""
    role, content = F.col("role"), F.col("content")
    keep = role.isin("user", "assistant") & (F.length(strip_ws(content)) > 0)
    rows = chat_log.filter(keep).join(chosen.select(key), key, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), role.alias("role"), content.alias("content"))))
    return rows.groupBy(key).agg(parts.alias("_m")).select(
        key, F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
