"""URL rules by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains when the url's
path starts with the rule's.  With the host's labels reversed and each ended by
a dot (``en.example.net`` -> ``net.example.en.``) a rule's hosts are one
interval of the sorted keys, and the intervals of different rules are nested
or apart.  Pages are range-partitioned and sorted by that key; one sweep over
a partition keeps the stack of rules whose interval is open and tests their
paths.  A busy host spreads over partitions, since the range key goes on with
the path and the page id.

Rules are swept in slices of at most ``RULES_PER_SWEEP`` (the proven bound of
what travels to the tasks); over several slices the longest fitting rule of
all of them wins, so any number of rules is handled exactly.

Edge cases: a NULL url or one without ``://`` has an empty host and path and
no rule; a url whose path is empty fits no rule (a rule's path starts with
``/``); of equally long fitting rules the smaller one as text wins; repeated
rows keep a row each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import prepare

RULES_PER_SWEEP = 100_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host up to ``/ ? #`` after the first ``://`` with
    A-Z lower-cased, path from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The canonical key: labels reversed, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweeper(rules: Sequence[UrlRule]):
    intervals: dict[str, list[UrlRule]] = {}
    for r in rules:
        intervals.setdefault(".".join(reversed(r.host.split("."))) + ".", []).append(r)
    starts = sorted(s.encode() for s in intervals)  # UTF-8 bytes, the order Spark sorts strings in
    by_start = {s.encode(): sorted(rs, key=lambda r: (-len(r.text), r.text)) for s, rs in intervals.items()}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[bytes] = []
        at = None
        for b in batches:
            keys, paths = b.column("key").to_pylist(), b.column("path").to_pylist()
            found: list[UrlRule | None] = []
            for key, path in zip(keys, paths):
                k = key.encode()
                if at is None:  # rules before the partition's first key: only its own prefixes can be open
                    at = bisect_left(starts, k)
                    for end in range(len(k)):
                        if k[end] == 0x2E and k[:end + 1] in by_start and k[:end + 1] != k:
                            stack.append(k[:end + 1])
                while stack and not k.startswith(stack[-1]):
                    stack.pop()
                while at < len(starts) and starts[at] <= k:
                    if k.startswith(starts[at]):
                        stack.append(starts[at])
                    at += 1
                best = None
                for s in stack:
                    for r in by_start[s]:
                        if path.startswith(r.path):
                            if best is None or (-len(r.text), r.text) < (-len(best.text), best.text):
                                best = r
                            break
                found.append(best)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"), b.column("key"),
                 pa.array([r and r.text for r in found], pa.string()),
                 pa.array([r and r.verdict for r in found], pa.string())],
                names=["page_id", "host", "path", "key", "rule", "rule_verdict"])

    return sweep


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, default: str = DEFAULT_VERDICT,
                rules_per_sweep: int = RULES_PER_SWEEP) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    prepare(spark)
    host, path = url_parts(F.col("url").cast("string"))
    keyed = (pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
             .withColumn("key", host_key(F.col("host"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    out_schema = "page_id long, host string, path string, key string, rule string, rule_verdict string"
    slices = [rules[i:i + rules_per_sweep] for i in range(0, len(rules), rules_per_sweep)] or [()]
    out = dealt.mapInArrow(_sweeper(slices[0]), out_schema)
    for s in slices[1:]:
        before = out.withColumnsRenamed({"rule": "rule0", "rule_verdict": "verdict0"})
        out = _longest(before, _sweeper(s))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def _longest(before: DataFrame, sweep) -> DataFrame:
    """Sweep another slice over the same sorted partitions; keep the longer rule."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed():
            for b in batches:
                held.append(b)
                yield b
        for new in sweep(feed()):
            old = held.pop(0)
            rule, verdict = [], []
            for r0, v0, r, v in zip(old.column("rule0").to_pylist(), old.column("verdict0").to_pylist(),
                                    new.column("rule").to_pylist(), new.column("rule_verdict").to_pylist()):
                first = r is None or r0 is not None and (-len(r0), r0) <= (-len(r), r)
                rule.append(r0 if first else r)
                verdict.append(v0 if first else v)
            yield pa.RecordBatch.from_arrays([*new.columns[:4], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=new.schema.names)

    return before.mapInArrow(step, "page_id long, host string, path string, key string, rule string, rule_verdict string")
