"""The library-level pool build over a user's own corpora."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from servebench.operators.curate.build import Route, Source, build_pool
from servebench.operators.curate.common import msg
from servebench.sources import io as IO

SPECS = {
    "reasoning": {"weight": 0.5, "min_tok": 8, "max_tok": 40, "max_tokens": 64, "buckets": [(8, 16), (16, 24), (24, 32), (32, 41)]},
    "code_generation": {"weight": 0.5, "min_tok": 8, "max_tok": 60, "max_tokens": 128, "buckets": [(8, 20), (20, 30), (30, 40), (40, 61)]},
}


def asked(column):
    return lambda df: df.select(F.col("n").alias("origin"), F.array(msg("user", F.col(column))).alias("messages"))


def words(n):
    return " ".join(["w"] * n)


@pytest.fixture(scope="module")
def corpora(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpora")
    rows = {"math": [{"n": i, "question": words(i % 50)} for i in range(400)],
            "code_raw": [{"n": i, "task": words(5 + i % 70)} for i in range(300)],
            "code_more": [{"n": i, "task": words(3 + i % 9)} for i in range(200)] + [{"n": None, "task": words(9)}, {"n": 900, "task": None}]}
    for name, some in rows.items():
        (d / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in some))
    return d, rows


def sources(d):
    return [Source("math", {"reasoning": 1.0}, (Route(f"{d}/math.jsonl", asked("question"), "json"),)),
            Source("code", {"code_generation": 0.6}, (Route(f"{d}/code_parsed", asked("prompt")),
                                                      Route(f"{d}/code_raw.jsonl", asked("task"), "json"))),
            Source("more", {"code_generation": 0.5}, (Route(f"{d}/code_more.jsonl", asked("task"), "json"),)),
            Source("gone", {"reasoning": 0.5}, (Route(f"{d}/nowhere", asked("x")),))]


def brute(corpora, total, seed, cap=80_000, only=None):
    """The same build over lists: ids per category."""
    plan = {"math": ("math", "question", "reasoning", 1.0), "code": ("code_raw", "task", "code_generation", 0.6),
            "more": ("code_more", "task", "code_generation", 0.5)}
    out = {}
    for cat, spec in SPECS.items():
        if only and cat != only:
            continue
        target = total if only else max(1, int(total * spec["weight"]))
        cands = []
        for name, (table, column, c, share) in plan.items():
            if c != cat:
                continue
            # per message 4 and the role, and 2 for the reply's start
            rows = sorted((r["n"], 2 + 4 + 1 + len((r[column] or "").split())) for r in corpora[table] if r["n"] is not None)
            ok = [(n, t) for n, t in rows if spec["min_tok"] <= t <= min(spec["max_tok"], cap)]
            cands += [(hashlib.md5(f"{name}:{cat}:{n}".encode()).hexdigest()[:12], t) for n, t in ok[:int(target * 3 * share)]]
        order = sorted(cands, key=lambda x: hashlib.md5(f"{x[0]}#{seed}".encode()).hexdigest())
        per, picks = max(1, target // 4), []
        for lo, hi in spec["buckets"]:
            picks += [x for x in order if lo <= x[1] < hi][:per]
        picks += [x for x in order if x not in picks]
        out[cat] = {i for i, _ in picks[:target]}
    return out


@pytest.mark.parametrize("total,seed,cap,only", [(40, 0, 80_000, None), (100, 3, 30, None), (24, 1, 80_000, "code_generation")])
def test_build_equals_the_same_steps_over_lists(spark, corpora, total, seed, cap, only):
    d, rows = corpora
    pool = build_pool(spark, sources(d), total, only, cap, seed, SPECS)
    got = {}
    for r in pool.entries.collect():
        got.setdefault(r.category, set()).add(r.id)
        text = r.messages[0].content
        assert r.input_token_count == 7 + len((text or "").split()) <= cap and r.max_tokens == SPECS[r.category]["max_tokens"]
    assert got == brute(rows, total, seed, cap, only)
    assert pool.used["code"].endswith("code_raw.jsonl")
    assert pool.missing == ([] if only else ["gone"])
    totals = {r.category: r["count"] for r in pool.stats.collect()}
    assert totals.pop(None) == sum(totals.values()) and totals == {c: len(x) for c, x in got.items()}


def test_built_pool_is_written_and_loaded(spark, corpora, tmp_path):
    pool = build_pool(spark, sources(corpora[0]), 20, specs=SPECS)
    IO.write_prompt_pool(pool.entries, str(tmp_path / "pool"), force=True, stats=pool.stats)
    back, skipped = IO.load_prompt_pool(spark, str(tmp_path / "pool"))
    assert skipped == 0 and back.count() == 20


def test_build_refuses_what_it_cannot_do(spark, corpora):
    d = corpora[0]
    with pytest.raises(ValueError, match="no source could be read"):
        build_pool(spark, sources(d)[3:], 10, specs=SPECS)
    with pytest.raises(ValueError, match="without a specification"):
        build_pool(spark, [Source("x", {"other": 1.0}, (Route(f"{d}/math.jsonl", asked("question"), "json"),))], 10, specs=SPECS)
    two = Source("x", {"reasoning": 1.0, "code_generation": 1.0}, (Route(f"{d}/math.jsonl", asked("question"), "json"),))
    with pytest.raises(ValueError, match="category"):
        build_pool(spark, [two], 10, specs=SPECS)
