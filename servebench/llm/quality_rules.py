"""Quality rules as a bitmask ledger.

Each document is measured once and every rule is evaluated once; the ledger
row holds the measurements and one long whose bit ``r`` says that rule ``r``
failed.  Policies are versioned masks over the rules: applying one, comparing
two or finding what each rule costs are bitwise operations on the ledger and
never touch the texts again.

Edge cases: NULL or blank text has no words, measures 0 everywhere and fails
``too_few_words``; repeated rows and NULL ids each keep a row of their own; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name, id_and_bytes, prepare

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_marks"]
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

_BLANKS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


@dataclass(frozen=True)
class Rule:
    """Rule number ``bit`` fails where ``failed`` (SQL over the measurements) is
    true.  Whole-number comparisons only, so every engine agrees."""
    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_share", "100 * n_symbols > 10 * n_words"),
    Rule(3, "capital_share", "100 * n_upper > 30 * n_letters"),
    Rule(4, "exclamation_share", "100 * n_marks > 20 * n_words"),
    Rule(5, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(6, "word_length", "2 * word_chars < 3 * n_words OR word_chars > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept when none of them failed."""
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        by_name = {r.name: r.bit for r in RULES}
        return sum(1 << by_name[n] for n in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_trigrams"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))


def measure_text(data: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = data.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    starts = len(data) - int(hist[0x80:0xC0].sum())  # code points: bytes that do not continue one
    repeat = 0
    if n >= 4:
        tri = list(zip(words, words[1:], words[2:]))
        count = Counter(tri)
        if len(count) < len(tri):
            covered = 0  # the first word not yet counted
            for i, t in enumerate(tri):
                if count[t] > 1:
                    repeat += i + 3 - max(covered, i)
                    covered = i + 3
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return (n, starts - int(hist[_BLANKS].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeat,
            len(lines), int(hist[65:91].sum()), int(hist[65:91].sum() + hist[97:123].sum()), int(hist[ord("!")]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure_text(t.as_py()) for t in b.column(1)]
        columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                         names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements, ``failed`` (rule bits)."""
    prepare(docs.sparkSession)
    m = id_and_bytes(docs).mapInArrow(_measure, LEDGER_SCHEMA)
    return with_bits(m)


def with_bits(measured: DataFrame) -> DataFrame:
    """Every rule evaluated once on the measurements, as bits of ``failed``."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes ``policy``."""
    c = F.col(failed) if isinstance(failed, str) else failed
    return c.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of ``policy`` costs: (rule, n_failed, n_only), the last the
    documents kept if only that rule were dropped.  One aggregate over the
    ledger on the distinct bit patterns (at most 2^rules), no second look at a text."""
    mask = F.lit(policy.mask).cast("long")
    patterns = led.select(F.col("failed").bitwiseAND(mask).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    chosen = [r for r in RULES if policy.mask >> r.bit & 1]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                                for r in chosen])).alias("r")
    hit = F.col("p").bitwiseAND(F.col("r.bit")) != 0
    return (patterns.select("p", "n", rules).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))


def judged(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (base rules and ``policy``)."""
    return ledger(docs).withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(policy)})


def kept_rows(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and ``policy``:
    only the text goes to Python and only its measurements come back, so no join brings
    rows and verdicts together and no other column is copied."""
    prepare(docs.sparkSession)

    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        rows = [measure_text(t.as_py()) for t in texts]
        columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)

    own = free_name(docs, "measures")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       measured(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias(own))
    judged_ = with_bits(rows.select("row", f"{own}.*")).filter(passes(BASE) & passes(policy))
    return judged_.select("row.*")
