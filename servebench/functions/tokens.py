"""Token counting (D7) and message-list token totals.

The counter is ``ws``: the number of maximal non-whitespace runs (``\\S+``), a
native Spark expression (``regexp_count``) inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col_

# FIXED VALUES: per-message overhead and reply priming of the message count.
PER_MESSAGE_TOKENS = 4
REPLY_PRIMING_TOKENS = 2


def ws_tokens(c: Column | str) -> Column:
    """Count of ``\\S+`` runs; 0 for NULL text."""
    return F.coalesce(F.regexp_count(col_(c), F.lit(r"\S+")), F.lit(0)).cast("int")


def token_count(c: Column | str, counter: str = "ws") -> Column:
    if counter == "ws":
        return ws_tokens(c)
    raise ValueError(f"unknown token counter {counter!r}")


def message_tokens(messages: Column | str, counter: str = "ws") -> Column:
    """Tokens of a message list: 4 per message plus the tokens of every string
    value (role and content), plus 2 for reply priming (D8)."""
    return F.aggregate(
        col_(messages), F.lit(REPLY_PRIMING_TOKENS),
        lambda acc, m: acc + F.lit(PER_MESSAGE_TOKENS) + token_count(m["role"], counter)
        + token_count(m["content"], counter)).cast("int")
