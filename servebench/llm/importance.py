"""Quality classifier by importance resampling.

Two generative models of hashed byte n-grams (3 and 4 bytes, case kept) are fitted: the target on labelled good
documents, the raw one on all documents.  A document's log weight is the sum
of log(target / raw) over its grams, the same weight importance resampling
gives it; adding Gumbel noise (a function of doc_id and ``seed``) and taking
the k largest draws k documents without replacement in proportion to their
weights.

``k``: the share of documents whose weight reaches the ``keep`` quantile of the
labelled good ones, unless the caller names a number.  The labelled rows used
are bounded by ``LABELLED`` (smallest hash of doc_id first); everything else
covers all documents.

Edge cases: NULL and empty texts have weight 0; documents with equal keys are
kept or dropped together; without labelled good documents every weight is 0
and all documents stay; several labels of a document count as the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts as C
from .tables import cut, id_and_bytes, prepare

SLOTS = 1 << 16
LABELLED = 20_000
KEEP = 0.002
SEED = 20240229
_M3, _M4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
STEP = 1 << 22


def gram_slots(data: bytes | memoryview) -> Iterator[np.ndarray]:
    """Slots of all 3- and 4-byte grams of a text, in pieces of bounded size."""
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(whole) - 2, 0), STEP):
        b = whole[at:at + STEP + 3].astype(np.uint32)
        three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        yield (three[:STEP] * _M3) >> np.uint32(17)                          # lower half of the slots
        if len(b) > 3:
            four = (three[:-1] | b[3:] << np.uint32(24)) * _M4
            yield (four[:STEP] >> np.uint32(17)) + np.uint32(SLOTS // 2)     # upper half


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(2 * SLOTS, np.int64)  # all documents, then labelled good ones
    for b in batches:
        for text, good in zip(b.column("text"), b.column("good").to_pylist()):
            for s in gram_slots(text.as_buffer()):
                c = np.bincount(s, minlength=SLOTS) if len(s) > SLOTS else None
                for base in (0, SLOTS) if good else (0,):
                    if c is not None:
                        n[base:base + SLOTS] += c
                    else:
                        np.add.at(n, s + np.uint32(base), 1)
    yield from C.blocks(n, TaskContext.get().partitionId())


def label_sample(labels: DataFrame, column: str, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled documents (doc_id, value): a bounded, documented sample."""
    one = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("value"))
           .dropna().groupBy("doc_id").agg(F.max("value").alias("value")))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def weigh(docs: DataFrame, labels: DataFrame, seed: int = SEED, labelled: int = LABELLED) -> DataFrame:
    """doc_id, log_weight, sample_key, quality (the label of a sampled row, else NULL)."""
    prepare(docs.sparkSession)
    sample = cut(label_sample(labels, "quality", labelled))  # at most `labelled` rows of 12 bytes: broadcast
    src = id_and_bytes(docs).join(F.broadcast(sample.withColumnRenamed("value", "quality")), "doc_id", "left")
    n = C.gathered(src.select("text", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
                   .mapInArrow(_count, C.SCHEMA), 2 * SLOTS)
    raw, good = n[:SLOTS].astype(np.float64), n[SLOTS:].astype(np.float64)
    ratio = np.zeros(SLOTS)
    if good.sum() > 0:
        ratio = np.log((good + 0.5) / (good + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [float(sum(ratio[s].sum() for s in gram_slots(t.as_buffer()))) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(w, pa.float64())],
                                             names=["doc_id", "quality", "log_weight"])

    w = src.select("doc_id", "text", "quality").mapInArrow(score, "doc_id long, quality int, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return w.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))


STEPS = float(1 << 20)


def in_steps(v: Column) -> Column:
    """A double as whole steps of 2^-20: the resolution keys are ranked at."""
    return F.round(v * STEPS).cast("long")


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a double column in steps, exactly: four counting
    passes over 16 bits each (at most 65,536 rows to the driver a pass)."""
    steps = df.select(in_steps(F.col(column)).alias("o"))
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        rest = steps if shift == 48 else steps.filter(F.shiftright("o", shift + 16) == prefix)
        got = rest.groupBy(F.shiftright("o", shift).alias("p")).agg(F.count("*").alias("n")).collect()
        for r in sorted(got, key=lambda r: -r.p):
            if left <= r.n:
                prefix = r.p
                break
            left -= r.n
    return prefix


def select(weighed: DataFrame, k: int | None = None, keep: float = KEEP) -> DataFrame:
    """Gumbel top-k over the output of ``weigh`` (cut it first): adds ``kept``."""
    total = weighed.count()
    if k is None:
        good = weighed.filter(F.col("quality") == 1)
        n_good = good.count()
        if n_good == 0:
            k = total
        else:  # ranks counted among the bounded labelled rows
            floor = kth_largest(good, "log_weight", max(1, n_good - int(keep * n_good)))
            k = weighed.filter(in_steps(F.col("log_weight")) >= floor).count()
    if k >= total:
        return weighed.withColumn("kept", F.lit(True))
    if k <= 0:
        return weighed.withColumn("kept", F.lit(False))
    return weighed.withColumn("kept", in_steps(F.col("sample_key")) >= kth_largest(weighed, "sample_key", k))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, sample_key, kept for every document."""
    return select(cut(weigh(docs, labels, seed)), k).select("doc_id", "log_weight", "sample_key", "kept")
