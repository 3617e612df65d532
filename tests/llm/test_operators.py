"""The ten operators on a small corpus with hard rows, against brute force."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, part int"


def corpus():
    """Copies, near copies, shared passages, blanks, odd characters, NULLs and a very long text."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(40))
    base = [word() for _ in range(120)]
    texts = [None, "", " \t\n", "one two", "One two", "é ü\u00a0x\u2003y  z\n\n end ", "a" * 300, "<|endoftext|> ok", "x\x1fy z"]
    texts += [" ".join(word() for _ in range(rng.randint(3, 200))) for _ in range(30)]
    texts += [" ".join(base)] * 3
    for _ in range(40):                       # copies between 70 and 100 % alike
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [f"{word()} {passage} {word()}" for _ in range(12)]
    texts += ["spam " * 400, " ".join(word() for _ in range(30_000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return {i: t for i, t in zip(ids, texts)}


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1, "clash", 3) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """A NULL id, rows repeated whole, and one id with two texts."""
    t = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(None, t), (1, t), (1, t), (2, t + " more"), (2, "something else"), (None, None)], "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(t):
    return (t or "").encode()


# --- 1 -----------------------------------------------------------------------
def test_quality_measures(docs, texts, odd, empty):
    from servebench.llm import quality_rules as QR

    got = {r.doc_id: r for r in QR.judged(docs).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        b = utf8(t)
        w = b.split()
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in b.split(b"\n") if x.split()]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(w), len(covered), len(lines) - len(set(lines)), base)
        assert r.word_chars == sum(len(x.decode()) for x in w)
        assert not (base and r.kept)
    assert QR.judged(odd).count() == 6 and QR.judged(empty).count() == 0
    kept = QR.kept_rows(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_ablation_is_the_ledger_recounted(docs):
    from servebench.llm import quality_rules as QR

    led = QR.ledger(docs)
    bits = [r.failed & QR.STRICT.mask for r in led.select("failed").collect()]
    for r in QR.ablation(led, QR.STRICT).collect():
        bit = 1 << next(x.bit for x in QR.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only) == (sum(bool(b & bit) for b in bits), bits.count(bit))


# --- 2 -----------------------------------------------------------------------
def test_vector_links(spark):
    import numpy as np
    from servebench.llm import vectors as V

    rng = np.random.default_rng(3)
    center = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in center[i % 6] + rng.normal(scale=0.05 if i % 2 else 0.12, size=16)], i % 3 if i % 11 else None) for i in range(240)]
    rows += [(300, rows[5][1], rows[5][2]), (301, None, 1), (302, [0.0] * 16, 1), (303, [1.0] * 15 + [None], 1),
             (304, [float("nan")] * 16, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, mask string")
    link, par = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    for k, a in enumerate(ok):
        for b in ok[k + 1:]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                    link[a[0]] += 1
                    link[b[0]] += 1
                    u, v = find(a[0]), find(b[0])
                    par[max(u, v)] = min(u, v)
    for block in (2048, 7):
        got = {r.vec_id: r for r in V.links(df, block=block).groupBy("vec_id").sum("n_links").withColumnRenamed("sum(n_links)", "n").collect()}
        assert {i: r.n for i, r in got.items()} == dict(link)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()}
    assert out == {r[0]: (link[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}
    assert V.near_duplicates(df.limit(0)).count() == 0


# --- 3 -----------------------------------------------------------------------
def test_suffix_removals(docs, texts, odd, empty):
    from servebench.llm import suffix

    first, want = {}, {}
    for i in sorted(texts):
        b = utf8(texts[i])
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    for i, t in texts.items():
        b = utf8(t)
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removals(docs).collect()}
    assert got == want
    same = sorted((r.doc_id or 0, r.n_removed) for r in suffix.removals(odd).collect())
    t = len(" ".join(f"w{i}" for i in range(60)))
    assert same == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, t)]
    assert suffix.removals(empty).count() == 0
    out = suffix.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(texts)


# --- 4 -----------------------------------------------------------------------
def test_url_rules(spark):
    from servebench.llm import url_filter as U

    urls = [None, "", "no scheme", "http://a.example.net/en/x?q#f", "http://EXAMPLE.net/de/", "https://x.NET", "https://x.net/",
            "ftp://example.com/de/a", "http://example.com/den", "http://badexample.com/de/", "http://b.org/fr/", "a://org/fr/#x://net/",
            "http://net:80/", "http://example.net./en/", "x://y.example.net?/en/", "http://.net/", "http://é.net/z"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(1, urls[4], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, path string")
    rules = [*U.RULES, U.UrlRule("example.net", "/en/x", "block"), U.UrlRule("é.net", "/", "allow")]

    def judge(u, rs):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
            path = rest[n:]
            path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fit = [r for r in rs if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fit, key=lambda r: (-len(r.text), r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    for rs, sweep in ((U.RULES, 100), (rules, 100), (rules, 2)):
        got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.filter_urls(df, rs, rules_per_sweep=sweep).collect())
        assert got == sorted((i, h, p, r or "", v) for i, u, _ in rows for h, p, r, v in [judge(u, rs)])
    assert U.filter_urls(df.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------
def shingles(t):
    w = utf8(t).translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_components(texts):
    sets, par = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = find(a), find(b)
                par[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("short,rounds", [(8, 1), (0, 0)])
def test_jaccard_components(docs, texts, monkeypatch, short, rounds):
    """Leaders, blocks and pairs each find the same components."""
    from servebench.llm import jaccard as J

    monkeypatch.setattr(J, "SHORT", short)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "LEADER_ROUNDS", rounds)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()} == jaccard_components(texts)


def test_jaccard_odd_rows(odd, empty):
    from servebench.llm import jaccard as J

    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.near_duplicates(odd).collect())
    assert got == [(0, 0, 0), (0, 56, 0), (1, 56, 1), (1, 56, 1), (2, 1, 1), (2, 57, 1)]
    assert J.near_duplicates(empty).count() == 0


# --- 6 -----------------------------------------------------------------------
def test_packing(docs, texts, odd, empty):
    import public_tokenizers as P
    from servebench.llm.q_tokens import packed
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed(docs).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = ids[at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packed(odd).count() == 6 and packed(empty).count() == 0


def test_cutting_stock_uses_every_item_once():
    import numpy as np
    from servebench.llm import packing as K

    rng = np.random.default_rng(1)
    for top in (1, 5, 64, 256):
        demand = rng.integers(0, 40, top)
        plan = K.plan(demand, 256, max_columns=300)
        assert (sum((p * n for p, n in plan), np.zeros(top, int)) == demand).all()
        assert all((p * np.arange(1, top + 1)).sum() <= 256 for p, _ in plan)
        used = (demand * np.arange(1, top + 1)).sum()
        if top == 64:
            assert sum(n for _, n in plan) <= math.ceil(used / 256) + 4


def test_cutting_stock_padding_of_the_default_setting():
    """With the columns production uses, at most two sequences more than the tokens fill."""
    import numpy as np
    from servebench.llm import packing as K

    for seed, top in ((1, 32), (1, 64), (2, 64)):
        demand = np.random.default_rng(seed).integers(0, 40, top)
        plan = K.plan(demand, K.SEQUENCE // K.UNIT)
        assert (sum(p * n for p, n in plan) == demand).all()
        used = (demand * np.arange(1, top + 1)).sum()
        assert sum(n for _, n in plan) <= math.ceil(used / (K.SEQUENCE // K.UNIT)) + 2


def test_cutting_stock_beside_a_session(spark):
    """The linear program of a full histogram ends soon in a driver that runs Spark."""
    import time

    import numpy as np
    from servebench.llm import packing as K

    assert spark.range(1000).selectExpr("sum(id)").first()[0] == 499500
    began = time.time()
    demand = np.random.default_rng(3).integers(1, 400, 256)
    plan = K.plan(demand, 256)
    assert (sum(p * n for p, n in plan) == demand).all() and time.time() - began < 60
    upper = np.triu(np.random.default_rng(4).integers(1, 5, (40, 40)).astype(float))
    assert np.allclose(np.einsum("ij,jk->ik", upper, K._inverse(upper)), np.eye(40))


# --- 7 -----------------------------------------------------------------------
def test_bpe(docs, texts, odd, empty):
    import public_tokenizers as P
    import tiktoken
    from servebench.llm import bpe
    from servebench.llm.q_tokens import BPE_FILE, tokenizer

    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(BPE_FILE), "rb"))})
    for r in bpe.encode_documents(docs, *tokenizer(BPE_FILE)).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == utf8(texts[r.doc_id])
    assert bpe.encode_digests(odd, *tokenizer(BPE_FILE)).count() == 6
    assert bpe.encode_digests(empty, *tokenizer(BPE_FILE)).count() == 0


def test_numbered_units_are_the_units():
    from servebench.llm.units import numbered, units

    odd = ["", " ", "a b  c", "one two", "two one two", "\u3000a b", "a b\x1f", "a\x85 b", "x", "", "é ü\u00a0x\u2003y  z\n\n end ", "a b\x00 c"]
    for some in (odd, odd[::-1], ["one two"], [""], []):
        distinct, number, sizes = numbered(some)
        ends = [0, *sizes.cumsum().tolist()]
        assert [[u for u in map(distinct.__getitem__, number[a:b].tolist()) if u] for a, b in zip(ends, ends[1:])] == list(map(units, some))
        assert len(set(distinct)) == len(distinct) and len(number) == ends[-1]


# --- 8 -----------------------------------------------------------------------
def test_lm_base_score(docs, texts, odd, empty):
    from servebench.llm import ppm

    learned = {i: utf8(t).translate(LOWER).split() + [None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, ws in learned.items() if not out[i] for w in ws)
    total, distinct = sum(c.values()), len(c)
    for r in ppm.score(docs).collect():
        ws = learned[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert ppm.score(odd).count() == 6 and ppm.score(empty).count() == 0


def test_ppm_chances_sum_to_one(monkeypatch):
    import numpy as np
    from servebench.llm import ppm

    rng = np.random.default_rng(2)
    monkeypatch.setattr(ppm, "SYMBOLS", 6)
    count = rng.integers(0, 3, 6 ** 4) * rng.integers(0, 2, 6 ** 4)
    p = 10.0 ** ppm.log_probabilities(count, 1).reshape(-1, 6).astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    # A context never seen gives what the shorter context gives.
    n = count.reshape(6, 36, 6)
    unseen = np.argwhere(n.sum(axis=2) == 0)
    short = 10.0 ** ppm.log_probabilities(count, 1).reshape(6, 36, 6).astype(float)
    for a, bc in unseen:
        same = [x for x in range(6) if n[x, bc].sum() == 0]
        assert np.allclose(short[a, bc], short[same[0], bc])


def trie_score(learned, text, order):
    """Brute-force PPM: method C with exclusion over all symbols; ``learned`` maps contexts to counts."""
    def chance(context, x):
        if context is None:
            return 1 / 231
        shorter = context[1:] if context else None
        n = learned.get(context)
        if not n:
            return chance(shorter, x)
        whole = sum(n.values()) + (len(n) if len(n) < 231 else 0)
        if x in n:
            return n[x] / whole
        return len(n) / whole * chance(shorter, x) / (1 - sum(chance(shorter, y) for y in n))

    seen, total = {}, 0.0
    t = (-1,) * order + tuple(text) + (-1,)
    for i in range(order, len(t)):
        at = t[i - order:i], t[i]
        if at not in seen:
            seen[at] = math.log10(chance(*at))
        total += seen[at]
    return total


def test_lm_score_is_the_byte_tries(spark, monkeypatch):
    """All bytes and contexts longer than three symbols count."""
    from servebench.llm import ppm

    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789.,;:!?()[]{}<>=+*/#%&@ éüßñ中文字жшщ\n"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = {i: " ".join(rng.choice(stock) for _ in range(rng.randint(0, 300))) for i in range(90)}
    texts[90], texts[91] = "ABC abc", None
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    size = sum(len(utf8(t)) + 1 for i, t in texts.items() if not out[i])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert len({b for t in texts.values() for b in utf8(t).translate(LOWER)}) > 64
    for order in (ppm.order_for(size), 6):
        learned = defaultdict(Counter)
        for i, t in texts.items():
            if not out[i]:
                s = (-1,) * order + tuple(utf8(t).translate(LOWER)) + (-1,)
                for k in range(order, len(s)):
                    for n in range(order + 1):
                        learned[s[k - n:k]][s[k]] += 1
        with monkeypatch.context() as m:
            m.setattr(ppm, "order_for", lambda n: order)
            got = {r.doc_id: r.score for r in ppm.score(df).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            if out[i] or i % 9 == 0:
                assert math.isclose(got[i], trie_score(learned, utf8(t).translate(LOWER), order), rel_tol=1e-5), i
    assert [ppm.order_for(1 << n) for n in (1, 20, 30, 35)] == [3, 4, 6, 7]


# --- 9, 10 -------------------------------------------------------------------
@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    stems = ["blorg", "snarf"]
    rows, labels = [], []
    for i in range(700):
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        toxic, good = i % 7 == 0, i % 5 != 0
        if toxic:
            for _ in range(5):
                w[rng.randrange(60)] = rng.choice(stems) + "".join(rng.choice("aeiou") for _ in range(3))
        text = " ".join(w) if good else " ".join(x + "###" for x in w)
        rows.append((i, text, "lang", 9))
        labels.append((i, int(good), int(toxic), "t"))
    rows.append((1000, None, None, None))
    return (spark.createDataFrame(rows, "doc_id long, text string, quality string, toxic int"),
            spark.createDataFrame(labels + labels[:3], "doc_id long, quality int, toxic int, text string"))


def test_importance_resampling(labelled):
    from servebench.llm import importance as I

    docs, labels = labelled
    got = {r.doc_id: r for r in I.resample(docs, labels).collect()}
    good = [i for i in range(700) if i % 5]
    assert len(got) == 701 and got[1000].log_weight == 0
    assert sum(got[i].kept for i in good) >= 0.98 * len(good) and not any(got[i].kept for i in range(0, 700, 5))
    top = sorted(got.values(), key=lambda r: -r.sample_key)[:100]
    assert {r.doc_id for r in I.resample(docs, labels, k=100).filter("kept").collect()} == {r.doc_id for r in top}
    assert I.resample(docs, labels.limit(0)).filter("kept").count() == 701 and I.resample(docs.limit(0), labels).count() == 0


def test_toxicity_learns_held_out(labelled):
    from servebench.llm import toxicity as T

    docs, labels = labelled
    g = T.learn(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, g).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].predicted == (i % 7 == 0) for i in held) and got[1000].predicted == 0
    assert T.score(docs.limit(0), T.learn(docs.limit(0), labels)).count() == 0


def test_toxic_entries_of_a_large_vocabulary(spark):
    """A rarer, toxic-only word is learned although over 50,000 entries have more support."""
    from servebench.llm import toxicity as T

    rng = random.Random(13)
    vocabulary = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(13_000)})
    assert len({f for w in vocabulary for f in T.word_features(w)}) > 50_000
    ids = [i for i in range(1_000) if zlib.crc32(str(i).encode()) % 3 != 1][:330]
    rows = []
    for k, i in enumerate(ids):
        w = rng.sample(vocabulary, len(vocabulary)) if k < 33 else rng.sample(vocabulary, 3)
        rows.append((i, " ".join([*w, "zzblorgish"] if k < 10 else w)))
    labels = [(i, int(k < 30)) for k, i in enumerate(ids)]
    g = T.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zzblorgish" in g.words and not set(vocabulary) & set(g.words)


def test_toxic_clauses():
    from servebench.llm import toxicity as T

    g = T.Grammar(words={"idiot": 6.0})
    p = lambda t: T.probability(g.log_odds(t))
    assert p("You idiot!") > p("The idiot ran.") > 0.7 and p("I will kill you") > 0.7
    assert p("He is not an idiot.") < 0.5 and p("She said idiot") < 0.7 and p("") < 0.1
    assert p("Not now. You are an idiot") > 0.9  # a negation ends with its clause


def test_ppm_turns_part_the_long_contexts():
    """Every (context, symbol) of a chunk is asked about in one turn, with all that share its last three symbols."""
    import numpy as np
    import pyarrow as pa

    from servebench.llm import ppm

    texts = [b"", b"abracadabra abracadabra", bytes(range(256)), b"x", b"the cat sat on the mat " * 9]
    docs = ppm.Docs(pa.table({"doc_id": pa.array(range(5)), "text": pa.array(texts, pa.binary()),
                              "held_out": [False] * 5, "train": [True, True, False, True, True]}))
    for order in (3, 5, 7):
        keys, doc = ppm.long_grams(docs.symbols(), docs.offs, order)
        assert len(keys) == sum(map(len, texts)) + 5
        turns = [docs.long_grams(order, k) for k in range(ppm.TURNS)]
        assert ppm.TURNS > 1 and all(len(t[0]) for t in turns)
        assert sorted(x for k, _, number, _ in turns for x in k[number].tolist()) == sorted(keys.tolist())
        assert sum(int(n.sum()) for _, n, _, _ in turns) == int(docs.train[doc].sum())
        heads = [set((k >> np.uint64(64 - ppm.PART_BITS)).tolist()) for k, _, _, _ in turns]
        assert not set.intersection(*heads)


def test_ppm_chunk_asks_once_about_a_shared_key(monkeypatch):
    """The pieces of a chunk ask together, each key once, with the counts and numbers of plain counting."""
    import numpy as np
    import pyarrow as pa

    from servebench.llm import chunks as K
    from servebench.llm import ppm

    rng = random.Random(23)
    stock = [bytes(rng.choices(range(256), k=rng.randint(1, 7))) for _ in range(40)]
    texts = [b" ".join(rng.choices(stock, k=rng.randint(0, 30))) for _ in range(60)] + [b"", b"Abc abC", b""]
    train = [i % 4 != 1 for i in range(len(texts))]
    docs = ppm.Docs(pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.binary()),
                              "held_out": [not x for x in train], "train": train}))
    monkeypatch.setattr(ppm, "PIECE", 300)
    assert len(list(docs.pieces())) > 5 and ppm.CHUNK_BYTES > K.CHUNK_BYTES
    whole = ppm.long_grams(docs.symbols(), docs.offs, 6)
    for bits in ((12, 20), (4, 5), (63, 63)):       # one block, many, a plain search
        monkeypatch.setattr(ppm, "BLOCK_BITS", bits)
        asked = [(docs.counts(), docs.distinct(), docs.tokens())]
        for turn in range(ppm.TURNS):
            mine = (whole[0] >> np.uint64(64 - ppm.PART_BITS)) * np.uint64(ppm.TURNS) >> np.uint64(ppm.PART_BITS) == np.uint64(turn)
            asked.append((docs.long_counts(6, turn), docs.long_grams(6, turn), (whole[0][mine], whole[1][mine])))
        for (keys, count), (same, n, number, doc), (ident, of) in asked:
            want = Counter({k: 0 for k in ident.tolist()})
            want.update(k for k, d in zip(ident.tolist(), of.tolist()) if train[d])
            assert keys.tolist() == same.tolist() == sorted(want) and count.tolist() == n.tolist() == [want[k] for k in sorted(want)]
            assert keys[number].tolist() == ident.tolist() and doc.tolist() == of.tolist()
    none = ppm.Docs(docs.table.slice(0, 0))
    assert not len(none.counts()[0]) and not len(none.long_grams(6, 0)[2])
