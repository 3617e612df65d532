"""A prompt pool from a declared list of corpora.

A :class:`Source` names one corpus, its share of each category and the routes it
may be read by, in order of preference; the first route whose path exists is used,
with that route's own converter.  A converter turns the corpus into rows of

    origin (whole number, unique in the corpus, its source order), messages
    [category] [n_tokens] [tools] [expected_tool]

and knows nothing of quotas, token limits or sampling.  ``category`` may be left
out where the source has one; ``n_tokens`` is counted from the messages where
it is not given.  Rows without an origin, without messages or with a message without
content (it cannot be counted) are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.hashing import entry_id
from ...functions.tokens import message_tokens
from ...session import ensure_checkpoint_dir
from ...sources.io import EXPECTED_TOOL, TOOL, path_exists
from ...specs import CATEGORY_SPECS, FETCH_OVERSHOOT
from . import pool as PL
from .common import MESSAGE

KEYS = ["source", "category", "origin"]


@dataclass(frozen=True)
class Route:
    """One way to read a corpus, and the converter of what is read there."""

    path: str
    convert: Callable[[DataFrame], DataFrame]
    format: str = "parquet"
    schema: T.StructType | None = None
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return self.convert((reader.schema(self.schema) if self.schema else reader).load(self.path))


@dataclass(frozen=True)
class Source:
    """A corpus; ``shares`` gives per category its part of the rows to fetch."""

    name: str
    shares: dict[str, float]
    routes: tuple[Route, ...]

    def route(self, spark: SparkSession) -> Route | None:
        return next((r for r in self.routes if path_exists(spark, r.path)), None)


class Pool(NamedTuple):
    entries: DataFrame          # in the pool file's schema, with ``pool_order``
    stats: DataFrame            # per category and in total
    used: dict[str, str]        # source -> path it was read from
    missing: list[str]          # sources none of whose routes exists


def _converted(source: Source, rows: DataFrame) -> DataFrame:
    """A converter's rows in one shape, of the categories the source serves."""
    have = set(rows.columns)
    if "category" not in have:
        if len(source.shares) != 1:
            raise ValueError(f"{source.name}: a converter for several categories must give each row's category")
        rows = rows.withColumn("category", F.lit(next(iter(source.shares))))

    def given(name: str, kind: T.DataType):
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    messages = F.col("messages").cast(f"array<{MESSAGE}>")
    counted = message_tokens(messages).cast("int")
    return rows.filter(F.col("origin").isNotNull() & (F.size("messages") > 0) & F.col("category").isin(*source.shares)).select(
        F.lit(source.name).alias("source"), "category", F.col("origin").cast("bigint").alias("origin"), messages.alias("messages"),
        (F.coalesce(F.col("n_tokens").cast("int"), counted) if "n_tokens" in have else counted).alias("n_tokens"),
        given("tools", T.ArrayType(TOOL)), given("expected_tool", EXPECTED_TOOL))


def fetch_quotas(sources: list[Source], targets: dict) -> dict:
    """Rows to fetch per (source, category): the source's share of the target
    times the overshoot; categories without a target are not fetched."""
    return {(s.name, c): int(targets[c] * FETCH_OVERSHOOT * share) for s in sources for c, share in s.shares.items() if c in targets}


def build_pool(spark: SparkSession, sources: list[Source], total: int = 5000, category: str | None = None,
               max_input_tokens: int = 80_000, seed: int = 0, specs: dict | None = None) -> Pool:
    """The pool of ``total`` prompts (of one ``category`` where given).

    Per category: the target by weight, the first rows of each source up to its quota
    that lie within the category's token range (and ``max_input_tokens``), a sample
    balanced over the token buckets, shuffled by ``seed``.  The result does not depend
    on how the corpora are stored or partitioned.

    Each corpus is read twice: once for keys and token counts, which are written to the
    checkpoint folder and sampled without their messages, and once for the messages of
    the chosen rows.  A category short of material gives what it has; a source that
    cannot be found is named in ``missing``; with none at all the build fails.
    """
    specs = specs or CATEGORY_SPECS
    targets = PL.category_targets(total, specs, category)
    unknown = {c for s in sources for c in s.shares} - set(specs)
    if unknown:
        raise ValueError(f"categories without a specification: {sorted(unknown)}")
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("source names must differ")
    routes = {s.name: s.route(spark) for s in sources if set(s.shares) & set(targets)}
    found = [s for s in sources if routes.get(s.name)]
    if not found:
        raise ValueError(f"no source could be read: {sorted(routes)}")

    rows = reduce(DataFrame.unionByName, [_converted(s, routes[s.name].read(spark)) for s in found])
    limits = [(F.col("category") == c) & F.col("n_tokens").between(specs[c]["min_tok"], min(specs[c]["max_tok"], max_input_tokens))
              for c in targets]
    rows = rows.filter(reduce(lambda a, b: a | b, limits))
    max_tokens = F.create_map(*[F.lit(x) for c in targets for x in (c, specs[c]["max_tokens"])])
    candidates = rows.select(entry_id(F.concat_ws(":", "source", "category"), F.col("origin")).alias("id"), *KEYS, "n_tokens",
                             max_tokens[F.col("category")].cast("int").alias("max_tokens"))
    ensure_checkpoint_dir(spark)
    admitted = PL.admit_first_n(candidates.checkpoint(), fetch_quotas(found, targets)).checkpoint()
    sampled = PL.sample_balanced(PL.token_bucket(admitted, specs=specs), targets, seed).checkpoint()
    entries = sampled.join(rows.drop("n_tokens"), KEYS).select(
        "id", "category", "source", "messages", "tools", "expected_tool", "max_tokens",
        F.col("n_tokens").alias("input_token_count"),
        F.create_map(F.lit("origin"), F.col("origin").cast("string")).alias("source_metadata"), "pool_order")
    return Pool(entries, PL.pool_stats(sampled, admitted, targets), {s.name: routes[s.name].path for s in found},
                sorted(set(routes) - {s.name for s in found}))
