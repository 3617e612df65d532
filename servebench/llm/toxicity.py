"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps the words of a clause to the classes INSULT, THREAT,
TARGET, NEGATION, REPORT and OTHER.  Three small machines read that string:
one remembers a negation for the next few words, one a target for the next
few, one whether the clause reports what somebody said.  Their product
(``compose``) is the clause machine; its arcs on INSULT and THREAT carry the
weight of the matched clause, the learned strength of the entry times the
factors of the states.  A document's log odds are the prior without matches
plus the weights of its clauses, so a lone word never scores outside a clause.

Learned from labelled rows outside the held-out fold, at most ``LABELLED`` of
them: entries (whole words, or word beginnings of 4 to 7 letters) that occur in
toxic documents far more often than chance allows, their strengths, the prior,
and how much a negated or reported match still counts.  Labels, lang, source
and doc_id are never inputs of a score.

Edge cases: NULL and empty texts score the prior of a text without matches;
without labelled rows the fixed lexicon alone is used; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxic_lexicon as LX
from .importance import label_sample
from .tables import crc_mod, cut, id_and_text, prepare

LABELLED = 20_000       # labelled rows learned from
MIN_LEN, MAX_LEN = 4, 7  # letters of a learned word beginning
FIXED_STRENGTH = 6.0
THRESHOLD = 0.7

WORDS = re.compile(r"[^\W\d_]+")
TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n\"]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


# --- the machines -----------------------------------------------------------
@dataclass(frozen=True)
class Machine:
    """A deterministic machine over the classes: ``step[state][cls]`` is the next
    state, ``factor[state]`` what it does to the weight of a match read in it."""
    step: tuple[tuple[int, ...], ...]
    factor: tuple[float, ...]


def countdown(cls: int, reach: int, factor: float) -> Machine:
    """State 0 until ``cls`` is read, then ``reach`` down to 1 over the next words."""
    step = tuple(tuple(reach if c == cls else max(0, s - 1) for c in range(6)) for s in range(reach + 1))
    return Machine(step, (1.0,) + (factor,) * reach)


def latch(cls: int, factor: float) -> Machine:
    """State 1 from ``cls`` to the end of the clause."""
    return Machine((tuple(int(c == cls) for c in range(6)), (1,) * 6), (1.0, factor))


def compose(*machines: Machine) -> Machine:
    """The product machine; its factor is the product of the factors."""
    out = machines[0]
    for m in machines[1:]:
        n = len(m.factor)
        out = Machine(
            tuple(tuple(out.step[a][c] * n + m.step[b][c] for c in range(6)) for a in range(len(out.factor)) for b in range(n)),
            tuple(out.factor[a] * m.factor[b] for a in range(len(out.factor)) for b in range(n)))
    return out


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)      # whole words
    stems: dict[str, float] = field(default_factory=dict)      # word beginnings
    negated: float = 0.15
    reported: float = 0.3
    targeted: float = 1.3
    threat: float = 8.0
    prior: float = -3.0

    def __post_init__(self):
        self.machine = compose(countdown(NEGATION, 3, self.negated), countdown(TARGET, 4, self.targeted),
                               latch(REPORT, self.reported))
        self.lengths = sorted({len(s) for s in self.stems})
        self.classes = {w: c for c, ws in ((TARGET, LX.TARGETS), (NEGATION, LX.NEGATIONS), (REPORT, LX.REPORTS)) for w in ws}
        self.phrases: dict[str, list[tuple[str, ...]]] = {}
        for p in LX.THREATS:
            self.phrases.setdefault(p.split()[0], []).append(tuple(p.split()))
        self.keys = set(self.words) | set(self.phrases)

    def may_match(self, words: Iterable[str]) -> bool:
        """Whether any word can start a match (so most documents need no clauses)."""
        distinct = set(words)
        return not self.keys.isdisjoint(distinct) or any(
            not self.stems.keys().isdisjoint({w[:n] for w in distinct}) for n in self.lengths)

    def strength(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clauses(self, text: str) -> Iterator[list[str]]:
        clause: list[str] = []
        for t in TOKENS.findall(text):
            if t[0].isalpha():
                clause.append(t)
            elif clause:
                yield clause
                clause = []
        if clause:
            yield clause

    def matches(self, clause: list[str]) -> Iterator[tuple[float, float]]:
        """(strength, factor) of every match of a clause."""
        state, skip = 0, 0
        for i, w in enumerate(clause):
            cls, weight = self.classes.get(w, OTHER), 0.0
            if skip:
                skip -= 1
            else:
                for p in self.phrases.get(w, ()):
                    if tuple(clause[i:i + len(p)]) == p:
                        cls, weight, skip = THREAT, self.threat, len(p) - 1
                        break
                if cls == OTHER and (weight := self.strength(w)):
                    cls = INSULT
            if weight:
                yield weight, self.machine.factor[state]
            state = self.machine.step[state][cls]

    def log_odds(self, text: str) -> float:
        low = text.lower()
        if not self.may_match(WORDS.findall(low)):
            return self.prior
        return self.prior + sum(s * f for c in self.clauses(low) for s, f in self.matches(c))


def probability(log_odds: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, log_odds))))


# --- learning ---------------------------------------------------------------
def word_features(word: str) -> Iterator[str]:
    """Entries a word supports: itself (ended by ``$``) and its beginnings."""
    if len(word) >= 3:
        yield word + "$"
        for n in range(MIN_LEN, min(MAX_LEN, len(word)) + 1):
            yield word[:n]


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fs, ds, ps = [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            seen = {}
            before = ""
            for w in WORDS.findall(text.lower()):
                for f in word_features(w):
                    seen.setdefault(f, before)
                before = w
            fs += seen.keys()
            ps += seen.values()
            ds += [doc] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(fs, pa.string()), pa.array(ds, pa.int64()), pa.array(ps, pa.string())],
                                         names=["feature", "doc_id", "before"])


def _clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter[str] = Counter()
        for text in b.column("text").to_pylist():
            n.update({f for w in set(WORDS.findall(text.lower())) for f in word_features(w)})
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                                             names=["feature", "n"])


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Grammar:
    """Fit the grammar on labelled rows whose crc32(doc_id) mod 3 is not 1."""
    prepare(docs.sparkSession)
    fold = labels.filter(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    sample = cut(label_sample(fold, "toxic", labelled))  # bounded: broadcast
    rows = cut(id_and_text(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]))
    sizes = {r.value: r.n for r in rows.groupBy("value").agg(F.count("*").alias("n")).collect()}
    n_tox, n_clean = sizes.get(1, 0), sum(n for v, n in sizes.items() if v != 1)
    fixed = {w: FIXED_STRENGTH for w in LX.INSULTS}
    if not n_tox or not n_clean:
        return Grammar(words=fixed)
    # Candidates: support counts differing neighbours, so copies of one text count once.
    toxic = cut(rows.filter("value = 1").select("doc_id", "text")
                .mapInArrow(_toxic_features, "feature string, doc_id long, before string")
                .groupBy("feature").agg(F.countDistinct("before").alias("support"), F.count("*").alias("tox"))
                .filter("support >= 4"))
    clean = (rows.filter("value <> 1").select("text").mapInArrow(_clean_counts, "feature string, n long")
             .groupBy("feature").agg(F.sum("n").alias("n")))
    share = n_tox / (n_tox + n_clean)
    # As many toxic documents as make a chance find among all candidates unlikely.
    least = max(4, math.ceil(math.log(0.01 / max(toxic.count(), 1)) / math.log(share)))
    odds = F.log((F.col("tox") + 0.5) / F.lit(n_tox + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    entries = (toxic.filter(F.least("support", "tox") >= least).join(clean, "feature", "left")
               .withColumn("clean", F.coalesce("n", F.lit(0))).filter(F.col("clean") <= 0.05 * F.col("tox"))
               .withColumn("odds", odds).filter("odds >= 3").select("feature", "odds").collect())  # what the grammar holds
    words, stems = dict(fixed), {}
    for r in sorted(entries, key=lambda r: (len(r.feature), r.feature)):
        f = r.feature
        if f.endswith("$"):
            words[f[:-1]] = max(words.get(f[:-1], 0.0), min(r.odds, 8.0))
        elif not any(f[:n] in stems for n in range(MIN_LEN, len(f))):
            stems[f] = min(r.odds, 8.0)
    g = Grammar(words=words, stems=stems)
    return _calibrated(rows, g)


def _calibrated(rows: DataFrame, g: Grammar) -> Grammar:
    """Prior and factors from the labelled rows, by what kind of match they hold."""
    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[str, int]] = Counter()
        for b in batches:
            for text, value in zip(b.column("text").to_pylist(), b.column("value").to_pylist()):
                found = {f for c in g.clauses(text.lower()) for _, f in g.matches(c)}
                kind = ("none" if not found else "plain" if max(found) >= 1 else
                        "reported" if max(found) >= g.reported else "negated")
                n[kind, int(value == 1)] += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]), pa.array([k[1] for k in n], pa.int32()),
                                              pa.array(list(n.values()), pa.int64())], names=["kind", "toxic", "n"])

    got = Counter()
    for r in rows.select("text", "value").mapInArrow(kinds, "kind string, toxic int, n long").groupBy("kind", "toxic").agg(F.sum("n").alias("n")).collect():
        got[r.kind, r.toxic] = r.n

    def factor(kind: str, default: float) -> float:
        """How much of a strength of 8 the observed rate amounts to (20 rows of prior)."""
        expected = probability(-3.0 + default * 8.0)
        rate = (got[kind, 1] + 20 * expected) / (got[kind, 0] + got[kind, 1] + 20)
        return min(1.0, max(0.0, (math.log(rate / (1 - rate)) + 3.0) / 8.0))

    prior = math.log((got["none", 1] + 0.5) / (got["none", 0] + 0.5))
    return Grammar(words=g.words, stems=g.stems, prior=max(-8.0, min(-1.0, prior)),
                   negated=factor("negated", g.negated), reported=factor("reported", g.reported))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted for every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [probability(grammar.log_odds(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()),
                                              pa.array([int(x >= THRESHOLD) for x in s], pa.int32())],
                                             names=["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
