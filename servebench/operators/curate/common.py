"""Shared pieces of the corpus converters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.columns import col_
from ...functions.tokens import PER_MESSAGE_TOKENS, REPLY_PRIMING_TOKENS, token_count

MESSAGE = "struct<role:string,content:string>"


def messages_tokens(pairs: list[tuple[str, Column | str]], counter: str = "ws") -> Column:
    """Message-list token count (D8) for a fixed list of (role literal,
    content expression) pairs, without building the array first."""
    total = F.lit(REPLY_PRIMING_TOKENS)
    for role, content in pairs:
        total = total + F.lit(PER_MESSAGE_TOKENS) + token_count(F.lit(role), counter) + token_count(col_(content), counter)
    return total.cast("int")


def msg(role: str | Column, content: Column | str) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), col_(content).alias("content"))



def within(x: Column, lo: int, hi: int) -> Column:
    return (x >= F.lit(lo)) & (x <= F.lit(hi))
