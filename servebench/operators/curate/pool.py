"""Pool assembly: targets, first-N admission, token buckets, balanced
sampling, stats, validation, request plans and weight normalisation
(E15-E26).

Randomness is replaced by md5-derived keys (D1): the same input gives the
same pool.  Every "first N" counts key prefixes to find where a group's quota
runs out and filters by that (``functions/selection.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.columns import r6
from ...functions.hashing import entry_id, hash_int, order_key, unit_hash
from ...functions.selection import before, first_n, parts, ranked
from ...functions.tokens import message_tokens
from ...specs import CATEGORY_SPECS, FETCH_OVERSHOOT, SOURCE_SHARES, TOKEN_MISMATCH_TOLERANCE

CANDIDATE_COLUMNS = ["id", "source", "category", "origin", "n_tokens", "max_tokens"]


def category_targets(total: int, specs: dict | None = None, only: str | None = None) -> dict:
    """Per-category targets: ``max(1, int(total * weight))``, or everything to
    one category when ``only`` is given (E16)."""
    specs = specs or CATEGORY_SPECS
    if only:
        return {only: total}
    return {c: max(1, int(total * s["weight"])) for c, s in specs.items()}


def source_quotas(targets: dict, overshoot: int = FETCH_OVERSHOOT, shares: dict | None = None) -> dict:
    """Fetch quota per (source, category): ``int(fetch * share)``; the full
    fetch target for sources without a share entry (E16)."""
    shares = shares or SOURCE_SHARES
    out = {}
    for cat, t in targets.items():
        fetch = t * overshoot
        for src, share in shares.get(cat, []):
            out[(src, cat)] = int(fetch * share)
    return out


def targets_df(spark, targets: dict, quotas: dict) -> DataFrame:
    rows = [(s, c, int(targets[c]), int(targets[c]) * FETCH_OVERSHOOT, int(q)) for (s, c), q in quotas.items()]
    return spark.createDataFrame(rows, "source string, category string, target int, fetch_target int, quota int")


def make_candidates(df: DataFrame, source: Column | str, category: Column | str, origin: str,
                    tokens: str = "n_tokens", max_tokens: int | Column = 1024) -> DataFrame:
    """Uniform candidate rows with a deterministic id."""
    src = F.lit(source) if isinstance(source, str) else source
    cat = F.lit(category) if isinstance(category, str) else category
    mt = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    return df.select(entry_id(F.concat_ws(":", src, cat), F.col(origin)).alias("id"), src.alias("source"),
                     cat.alias("category"), F.col(origin).cast("bigint").alias("origin"),
                     F.col(tokens).cast("int").alias("n_tokens"), mt.cast("int").alias("max_tokens"))


def admit_first_n(cands: DataFrame, quotas: dict) -> DataFrame:
    """First ``quota`` candidates per (source, category) in source order
    (E17).  Pairs without a quota are kept whole (their converter already
    applied its own quota)."""
    if not quotas:
        return cands
    pair = ["source", "category"]
    quoted = F.struct(*pair).isin(*[F.struct(F.lit(s), F.lit(c)) for s, c in quotas])
    return first_n(cands, quotas, pair, "origin").unionByName(cands.filter(~quoted))


def token_bucket(cands: DataFrame, spark=None, specs: dict | None = None) -> DataFrame:
    """Index of the first half-open bucket ``[lo, hi)`` holding the count, or
    NULL when out of range (E19).  The bucket table has 4 rows per category
    (fixed size), broadcast for the range join."""
    from ...specs import bucket_spec_df

    b = bucket_spec_df(spark or cands.sparkSession, specs)   # 4 rows per category
    j = cands.join(F.broadcast(b), (cands.category == b.category) & (cands.n_tokens >= b.lo) & (cands.n_tokens < b.hi),
                   "left")
    return j.select(*[cands[c] for c in cands.columns], b.bucket)


def sample_balanced(bucketed: DataFrame, targets: dict, seed: int = 0, n_buckets: int = 4) -> DataFrame:
    """Balanced sample per category (E20): ``max(1, target div 4)`` from each
    bucket without replacement, then a top-up from everything not picked
    (bucketless rows included), cut to the target in bucket order.

    The order is a hash of the id, so its leading digits part every group
    evenly: counts per part say which parts a quota reaches, and only rows of
    those are numbered, part by part.  No category is sorted in one task.
    """
    spark = bucketed.sparkSession
    per = {c: max(1, t // n_buckets) for c, t in targets.items()}
    # one row per category (7): the broadcast sides below are this table and tables of its size
    tdf = spark.createDataFrame([(c, int(t), int(per[c])) for c, t in targets.items()],
                                "category string, target long, per_bucket long")
    k = bucketed.join(F.broadcast(tdf.select("category")), "category", "left_semi").withColumn("_ok", order_key("id", seed))

    in_bucket = k.filter(F.col("bucket").isNotNull())
    by_bucket = ["category", "bucket"]
    reached = parts(in_bucket, by_bucket, "_ok").join(F.broadcast(tdf), "category").filter("_before < per_bucket")
    picks = (ranked(in_bucket, by_bucket, "_ok", "_rn", reached).join(F.broadcast(tdf.select("category", "per_bucket")), "category")
             .filter("_rn <= per_bucket").drop("per_bucket"))
    # How many each bucket gives; the buckets' picks follow one another in the sample.
    given = in_bucket.groupBy(*by_bucket).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(tdf), "category")
    given = given.select("category", "bucket", F.least("_n", "per_bucket").alias("_n")).withColumn("_first", before(["category"], "bucket", "_n"))
    chosen = picks.join(F.broadcast(given.select("category", "bucket", "_first")), by_bucket)
    chosen = chosen.select(*bucketed.columns, "_ok", (F.col("_first") + F.col("_rn")).alias("sample_rank"))

    n_picks = given.groupBy("category").agg(F.sum("_n").alias("_np"))
    missing = tdf.join(F.broadcast(n_picks), "category", "left").select("category", "target", F.coalesce("_np", F.lit(0)).alias("_np"))
    rest = k.join(picks.select("id"), "id", "left_anti")
    reached = parts(rest, ["category"], "_ok").join(F.broadcast(missing), "category").filter("_before < target - _np")
    top = (ranked(rest, ["category"], "_ok", "_rn", reached).join(F.broadcast(missing), "category")
           .select(*bucketed.columns, "_ok", (F.col("_np") + F.col("_rn")).alias("sample_rank")))
    final = chosen.unionByName(top).join(F.broadcast(tdf.select("category", "target")), "category").filter("sample_rank <= target")
    return final.select(*bucketed.columns, "sample_rank", F.col("_ok").alias("pool_order"))


def pool_stats(sampled: DataFrame, cands: DataFrame, targets: dict) -> DataFrame:
    """Per category with a non-empty candidate pool: sampled count, target,
    pool size and token range; and their total, as the row without a category (E22)."""
    spark = sampled.sparkSession
    tdf = spark.createDataFrame([(c, int(t)) for c, t in targets.items()], "category string, target int")
    pool = cands.groupBy("category").agg(F.count(F.lit(1)).alias("pool_size"))
    s = sampled.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.min("n_tokens").alias("min_tokens"),
                                        F.max("n_tokens").alias("max_tokens"))
    each = pool.join(tdf, "category").join(s, "category", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return each.rollup("category").agg(
        zero(F.sum("count")).cast("bigint").alias("count"), zero(F.sum("target")).cast("int").alias("target"),
        zero(F.sum("pool_size")).cast("bigint").alias("pool_size"), zero(F.min("min_tokens")).alias("min_tokens"),
        zero(F.max("max_tokens")).alias("max_tokens"))


def category_counts(pool: DataFrame) -> DataFrame:
    """Count and percentage per category (E24); the total is a scalar
    subquery."""
    total = pool.select(F.count(F.lit(1))).scalar()
    return pool.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(
        "category", "n", r6(F.col("n") * F.lit(100.0) / total).alias("pct"))


def normalize_weights(pool: DataFrame, weights: dict | None) -> DataFrame:
    """Weights of the categories that have prompts (E26): configured weight
    (missing -> 0), normalised to sum 1; all zero (or no weights) -> equal."""
    spark = pool.sparkSession
    present = pool.groupBy("category").agg(F.count(F.lit(1)).alias("n_prompts"))
    if weights:
        # one row per configured category
        wdf = spark.createDataFrame([(c, float(w)) for c, w in weights.items()], "category string, weight double")
        j = present.join(F.broadcast(wdf), "category", "left").select(
            "category", "n_prompts", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        j = present.select("category", "n_prompts", F.lit(1.0).alias("weight"))
    tot = j.select(F.sum("weight")).scalar()
    cnt = j.select(F.count(F.lit(1))).scalar()
    equal = (tot == 0) | tot.isNull()
    return j.select("category", "n_prompts", F.when(equal, F.lit(1.0)).otherwise(F.col("weight")).alias("weight"),
                    r6(F.when(equal, F.lit(1.0) / cnt).otherwise(F.col("weight") / tot)).alias("share"))


def check_weights(weights: dict, tolerance: float = 0.01) -> None:
    """Configured weights must sum to 1 within ``tolerance``."""
    total = sum(weights.values())
    if abs(total - 1.0) > tolerance:
        raise ValueError(f"Distribution weights must sum to 1.0, got {total}")


def request_plan(keys: DataFrame, pool: DataFrame, shares: DataFrame, key: str = "request_id",
                 seed: int = 0) -> DataFrame:
    """One planned prompt per key (E25): a weighted category draw, then a
    uniform draw within the category, both with replacement.

    The category draw is a range join of a [0,1) hash against the cumulative
    shares (at most 7 rows, broadcast); the prompt draw is an equi-join on
    (category, position) against the pool ranked by id (a hash, so its
    leading digits part a category evenly).
    """
    wc = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, 0)
    cum = shares.select("category", F.sum("share").over(wc).alias("_hi"))   # <= 7 rows
    sizes = pool.groupBy("category").agg(F.count(F.lit(1)).alias("_size"))
    cum = cum.join(sizes, "category")
    # The (<= 7) cumulative bounds as one scalar array: each draw finds its
    # band by counting bounds at or below it -- no join.
    bands = cum.select(F.array_sort(F.collect_list(F.struct("_hi", "category", "_size")))).scalar()
    seed_s = F.lit(str(seed))
    u = unit_hash(F.concat(F.lit("cat#"), F.col(key).cast("string"), F.lit("#"), seed_s))
    # u lies in [0, 1); the index is clamped so rounding in the cumulative sum
    # can never leave a draw without a category.
    withb = keys.select(key, bands.alias("_bands"), u.alias("_u"))
    b = F.col("_bands")
    idx = F.least(F.size(F.filter(b, lambda x: x["_hi"] <= F.col("_u"))), F.size(b) - 1)
    band = F.element_at(b, idx + 1)
    h = hash_int(F.concat(F.lit("pick#"), F.col(key).cast("string"), F.lit("#"), seed_s))
    picked = withb.select(key, band["category"].alias("category"), F.pmod(h, band["_size"]).alias("_pos"))
    placed = ranked(pool.select("category", "id"), ["category"], "id", "_no")
    return (picked.withColumn("_no", F.col("_pos") + 1).join(placed, ["category", "_no"])
            .select(key, "category", F.col("id").alias("prompt_id")))


def validate_pool(pool: DataFrame, counter: str = "ws", count_tools: bool = False) -> DataFrame:
    """Integrity checks of a pool (E23), one row per check with its count:
    missing required fields, empty messages, messages lacking role or content,
    claimed token count off by more than 20 %.  Only errors fail a pool;
    mismatches are reported.  Tool tokens are ignored unless
    ``count_tools`` (so tool prompts show up as mismatches, as in the
    reference check)."""
    required = ["id", "category", "source", "messages", "max_tokens", "input_token_count"]
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.col(c).isNull() if c in pool.columns else F.lit(True))
    msgs = F.col("messages")
    empty = ~missing & (F.coalesce(F.size(msgs), F.lit(0)) <= 0)
    bad_msgs = F.when(~missing & ~empty, F.size(F.filter(msgs, lambda m: m["role"].isNull())) +
                      F.size(F.filter(msgs, lambda m: m["content"].isNull()))).otherwise(F.lit(0))
    actual = message_tokens(msgs, counter)
    if count_tools and "tools" in pool.columns:
        from .tools import tools_tokens

        tt = F.when(F.size("tools") > 0, tools_tokens(F.concat(F.lit("["), F.array_join(
            F.transform("tools", lambda t: F.to_json(t)), ","), F.lit("]")), counter)).otherwise(F.lit(0))
        actual = actual + tt
    claimed = F.col("input_token_count")
    mismatch = (~missing & ~empty & (claimed > 0)
                & (F.abs(actual - claimed) / F.greatest(claimed, F.lit(1)) > F.lit(TOKEN_MISMATCH_TOLERANCE)))
    flags = pool.select(missing.alias("missing_fields"), empty.alias("empty_messages"),
                        bad_msgs.alias("_bad"), mismatch.alias("token_mismatch"))
    a = flags.agg(F.count(F.lit(1)).alias("entries"), F.count_if("missing_fields").alias("missing_fields"),
                  F.count_if("empty_messages").alias("empty_messages"),
                  F.coalesce(F.sum("_bad"), F.lit(0)).cast("bigint").alias("bad_messages"),
                  F.count_if("token_mismatch").alias("token_mismatch"))
    checks = ["entries", "missing_fields", "empty_messages", "bad_messages", "token_mismatch"]
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n"))
                                        for c in checks])).alias("r")).select("r.*")
