"""Category and run specifications.

Everything under "FIXED VALUES" must equal the figures the prompt-pool format
and its consumers expect; they are stated plainly, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: category specification (weight, admitted input-token range,
# output cap, four half-open token buckets).
# ---------------------------------------------------------------------------
CATEGORY_SPECS = {
    "short_chat":      {"weight": 0.25, "min_tok": 50,    "max_tok": 500,   "max_tokens": 1024,
                        "buckets": [(50, 100), (100, 200), (200, 350), (350, 500)]},
    "medium_chat":     {"weight": 0.15, "min_tok": 500,   "max_tok": 4000,  "max_tokens": 2048,
                        "buckets": [(500, 1000), (1000, 2000), (2000, 3000), (3000, 4000)]},
    "tool_call":       {"weight": 0.20, "min_tok": 100,   "max_tok": 16000, "max_tokens": 4096,
                        "buckets": [(100, 500), (500, 2000), (2000, 5000), (5000, 16000)]},
    "code_generation": {"weight": 0.10, "min_tok": 500,   "max_tok": 8000,  "max_tokens": 4096,
                        "buckets": [(500, 1500), (1500, 3000), (3000, 5000), (5000, 8000)]},
    "long_context":    {"weight": 0.15, "min_tok": 20000, "max_tok": 70000, "max_tokens": 2048,
                        "buckets": [(20000, 32000), (32000, 45000), (45000, 58000), (58000, 70000)]},
    "multi_turn":      {"weight": 0.10, "min_tok": 2000,  "max_tok": 16000, "max_tokens": 2048,
                        "buckets": [(2000, 4000), (4000, 8000), (8000, 12000), (12000, 16000)]},
    "reasoning":       {"weight": 0.05, "min_tok": 100,   "max_tok": 4000,  "max_tokens": 4096,
                        "buckets": [(100, 500), (500, 1000), (1000, 2000), (2000, 4000)]},
}

# FIXED VALUES: substrings that route a chat prompt to "reasoning".
REASONING_KEYWORDS = [
    "math", "calculate", "solve", "proof", "prove", "equation", "theorem",
    "logic", "reasoning", "step by step", "think through", "analyze",
    "algorithm", "derive", "compute", "integral", "derivative", "probability",
    "statistics", "hypothesis", "deduce", "infer", "contradiction",
]

# FIXED VALUES: system prompts and instruction suffixes used when building
# prompts from corpora.
MATH_SYSTEM = ("You are a helpful math tutor. Solve the problem step by step, "
               "showing your work clearly.")
CODE_SYSTEM = ("You are an expert competitive programmer. Solve the following problem "
               "efficiently.")
CODE_SUFFIX = "\n\nProvide an efficient solution in Python with clear comments."
TRAJECTORY_FOLLOW_UP = ("Based on the above context, analyze the issue and provide a fix "
                        "with code.")
LONG_DOC_SYSTEM = ("You are a helpful assistant. Provide a detailed answer based on the "
                   "provided context.")
LONG_DOC_REPORT_TASK = ("Please provide a comprehensive summary of the above government "
                        "report, covering the key findings, recommendations, and conclusions.")
LONG_DOC_BOOK_SYSTEM = ("You are a helpful literary assistant. Provide thoughtful analysis "
                        "based on the text.")
LONG_DOC_BOOK_TASK = ("Based on the passage above, provide a detailed summary covering the "
                      "main themes, characters, and key events.")
LONG_DOC_QA_SYSTEM = "You are a helpful assistant. Answer based on the provided context."
LONG_DOC_QA_PREFIX = "Based on the above, "
LONG_DOC_SEPARATOR = "\n\n---\n\n"

# FIXED VALUES: per-source shares of a category's fetch target.
SOURCE_SHARES = {
    "tool_call": [("hermes_fc", 0.55), ("toolace", 0.45)],
    "long_context": [("govreport", 0.35), ("pg19", 0.25), ("scrolls", 0.20),
                     ("longbench", 0.12), ("longbench_v2", 0.08)],
    "code_generation": [("code_contests", 0.60), ("swe_smith", 1.00)],
    "reasoning": [("gsm8k", 1.00)],
}

# FIXED VALUES: run defaults.
DEFAULT_BUCKET_SECONDS = 10.0
DEFAULT_WARMUP_SECONDS = 30.0
DEFAULT_DURATION_SECONDS = 600.0
DEFAULT_REQUEST_TIMEOUT = 180.0
SAMPLER_TAIL_SECONDS = 30.0
FETCH_OVERSHOOT = 3
ERROR_BODY_CHARS = 200
ERROR_MESSAGE_CHARS = 300
TOKEN_MISMATCH_TOLERANCE = 0.20


@dataclass(frozen=True)
class RunParams:
    """Parameters of one benchmark run (times are epoch seconds)."""

    start: float
    duration: float = DEFAULT_DURATION_SECONDS
    warmup: float = DEFAULT_WARMUP_SECONDS
    gpu_count: int | None = None
    bucket_seconds: float = DEFAULT_BUCKET_SECONDS
    request_timeout: float = DEFAULT_REQUEST_TIMEOUT
    weights: dict = field(default_factory=lambda: {c: s["weight"] for c, s in CATEGORY_SPECS.items()})


def category_spec_df(spark: SparkSession, specs: dict | None = None) -> DataFrame:
    """The 7-row category dimension (small, fixed size: safe to broadcast)."""
    specs = specs or CATEGORY_SPECS
    schema = T.StructType([
        T.StructField("category", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("min_tok", T.IntegerType(), False),
        T.StructField("max_tok", T.IntegerType(), False),
        T.StructField("max_tokens", T.IntegerType(), False),
        T.StructField("cat_order", T.IntegerType(), False),
        T.StructField("buckets", T.ArrayType(T.StructType([
            T.StructField("lo", T.IntegerType(), False),
            T.StructField("hi", T.IntegerType(), False)]), False), False),
    ])
    rows = [(c, float(s["weight"]), s["min_tok"], s["max_tok"], s["max_tokens"], i,
             [(lo, hi) for lo, hi in s["buckets"]]) for i, (c, s) in enumerate(specs.items())]
    return spark.createDataFrame(rows, schema)


def bucket_spec_df(spark: SparkSession, specs: dict | None = None) -> DataFrame:
    """One row per (category, bucket): 28 rows for the default spec."""
    specs = specs or CATEGORY_SPECS
    rows = [(c, i, lo, hi) for c, s in specs.items() for i, (lo, hi) in enumerate(s["buckets"])]
    return spark.createDataFrame(rows, "category string, bucket int, lo int, hi int")


# ---------------------------------------------------------------------------
# FIXED VALUES: long-document sources.  ``suffix`` follows the document after
# the separator; ``question_prefix`` is used by question sources instead.
# ---------------------------------------------------------------------------
SCROLLS_REPORT_TASK = "Please provide a comprehensive summary of the above government report."
LONG_DOC_V2_SYSTEM = "You are a helpful assistant. Provide a detailed answer based on the context."
LONG_DOC_V2_PREFIX = "Based on the above text, please answer: "
# What is asked of the parts of a source, by configuration; the source's own entry holds for the rest.
LONG_DOC_CONFIG_TASKS = {
    ("longbench", "gov_report"): "Please provide a comprehensive summary of the above report.",
    ("longbench", "multi_news"): "Based on the articles above, write a multi-document summary.",
    ("scrolls", "gov_report"): SCROLLS_REPORT_TASK,
    ("scrolls", "narrative_qa"): "Based on the above text, please answer the question.",
    ("scrolls", "qmsum"): "Summarize the key points from the above meeting transcript.",
}
LONG_DOC_SOURCES = [
    {"source": "govreport", "system": LONG_DOC_SYSTEM, "suffix": LONG_DOC_REPORT_TASK,
     "question_prefix": None, "min_chars": True, "precheck": True},
    {"source": "pg19", "system": LONG_DOC_BOOK_SYSTEM, "suffix": LONG_DOC_BOOK_TASK,
     "question_prefix": None, "min_chars": True, "precheck": True},
    {"source": "scrolls", "system": LONG_DOC_SYSTEM, "suffix": SCROLLS_REPORT_TASK,
     "question_prefix": None, "min_chars": True, "precheck": False},
    {"source": "longbench", "system": LONG_DOC_QA_SYSTEM, "suffix": None,
     "question_prefix": LONG_DOC_QA_PREFIX, "min_chars": False, "precheck": False},
    {"source": "longbench_v2", "system": LONG_DOC_V2_SYSTEM, "suffix": None,
     "question_prefix": LONG_DOC_V2_PREFIX, "min_chars": False, "precheck": False},
]
# FIXED VALUES: long-document limits at full scale.
LONG_DOC_MIN_CHARS = 25000
LONG_DOC_TRUNC_LO = 22000
LONG_DOC_TRUNC_MARGIN = 2000
LONG_DOC_OVER_MARGIN = 50


@dataclass(frozen=True)
class LongDocParams:
    """Bounds of the long-document converter; defaults are the full-scale
    values, tests pass smaller ones (the supplied corpora are shorter)."""

    min_tok: int = 20000
    max_tok: int = 70000
    min_chars: int = LONG_DOC_MIN_CHARS
    trunc_lo: int = LONG_DOC_TRUNC_LO
    trunc_margin: int = LONG_DOC_TRUNC_MARGIN
    over_margin: int = LONG_DOC_OVER_MARGIN


def scaled_specs(factor: float) -> dict:
    """Category specs with every token bound multiplied by ``factor`` (for
    corpora shorter than real prompt sources)."""
    out = {}
    for c, s in CATEGORY_SPECS.items():
        f = lambda x: int(round(x * factor))
        out[c] = dict(s, min_tok=f(s["min_tok"]), max_tok=f(s["max_tok"]),
                      buckets=[(f(lo), f(hi)) for lo, hi in s["buckets"]])
    return out
