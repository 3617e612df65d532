"""Operators 11 to 13 against brute force, with hard rows."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, g string, part int, digest string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéXYZ") for _ in range(rng.randint(1, 8)))
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "en", "en", "fr", None, "é", ""])
        doc = rng.choice([i, i * 1_000_003, -i, 5, None, (1 << 62) + i]) if i % 3 else i
        text = rng.choice([None, "", word(), " ".join(word() for _ in range(rng.randint(1, 60)))])
        rows.append((doc, text, lang, rng.choice(["s", None]), rng.choice([None, i]), 1, "g", 2, "x"))
    return rows + [rows[9]] * 20 + [(5, "same", "en", "s", 4, 1, "g", 2, "x")] * 30


@pytest.fixture(scope="module")
def rows():
    return _docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# --- 11 ----------------------------------------------------------------------
def manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, low(r[1]) if bad else r[1]), r[0]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            at = levels[-1]
            levels.append([sha("".join(at[i:i + 8])) for i in range(0, len(at), 8)])
        return levels

    def climb(levels, k):
        for at in levels[:-1]:
            f = k - k % 8
            yield "".join(at[f:k]), "".join(at[k + 1:f + 8])
            k //= 8

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[2] for g in sorted(groups[x], key=lambda g: g[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for j, x in enumerate(langs):
        for k, g in enumerate(sorted(groups[x], key=lambda g: g[:3])):
            path = [*climb(trees[x], k), *climb(top, j)]
            f = g[3]
            for a, b in path:
                f = sha(a + f + b)
            out.append((g[4], g[2], trees[x][-1][0], root, sha("".join(a + b for a, b in path)), f, f == root))
    return out


@pytest.mark.parametrize("stride", [1, 4])
def test_manifest(docs, rows, stride, monkeypatch, spark):
    from servebench.llm import merkle

    if stride == 1:   # many rounds of small slot arrays, in this process
        for n, v in (("STRIDE", 1), ("BLOCK_BITS", 3), ("BLOCK", 8)):
            monkeypatch.setattr(merkle, n, v)
        slots = [sha(str(i)) for i in range(100)]
        level, n = slots, 100
        while n > 1:
            level = [merkle.levels(level[i:i + 8], n)[-1][0] for i in range(0, len(level), 8)]
            n = -(-n // 8)
        monkeypatch.undo()
        assert merkle.levels(slots, 100)[-1] == level
        return
    got = [tuple(r) for r in merkle.manifest(docs, merkle.altered_third()).collect()]
    assert Counter(got) == Counter(manifest(rows))


def test_manifest_small_and_empty(spark):
    from servebench.llm import merkle

    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(None, None, None, None, None, 1, "g", 2, "x")]
    r = merkle.manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert [tuple(x) for x in r] == manifest(one) and r[0].leaf == sha("-----") == r[0].root and r[0].verified


def test_ranks_against_sort(spark):
    from servebench.llm.ranks import ranked

    rng = random.Random(1)
    keys = [rng.choice([rng.getrandbits(63) - (1 << 62), rng.randrange(300), -rng.randrange(300)]) for _ in range(3000)]
    df = spark.createDataFrame([(k % 2, k) for k in keys], "g long, k long").repartition(4)
    for r in ranked(df, ["g"], "k", "rank", "again").distinct().collect():
        mine = [k for k in keys if k % 2 == r.g]
        assert r["rank"] == sum(k < r.k for k in mine) and r.again == (mine.count(r.k) > 1)


# --- 12 ----------------------------------------------------------------------
def chat(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            text = rng.choice(["Hi.", "ok", "no!  ", " ", None, "", "What? yes", "x.", "é…", "Done!\n"])
            rows.append((c if c % 7 else None, rng.choice([t, t, t, None, t - 3]), role, text, "clash"))
    return rows


def _sql(rows):
    from servebench.llm.q_manifest import op12_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return Counter(tuple(int(x) if hasattr(x, "item") else x for x in r) for r in con.execute(op12_sql()).fetchall())


def test_repair_against_sql(spark):
    from servebench.llm import repair

    rows = chat(150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = Counter(tuple(r) for r in repair.repaired(df).collect())
    assert got == _sql(rows)
    assert repair.repaired(df.limit(0)).collect() == []


def test_repair_across_partitions(spark):
    """One conversation of most rows, cut into many segments, has the result of one derivation."""
    from servebench.llm import repair

    rng = random.Random(11)
    rows = [(3, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"t{t}.", f"t{t}", f"t{t % 9}!", " "]), "x") for t in range(400)]
    rows += [(c, t, "user", "a.", "x") for c in range(8) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = Counter(tuple(r) for r in repair.repaired(df).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert got == _sql(rows)


def test_agenda_finds_the_least_of_all_edit_sequences():
    from servebench.llm.repair import END_COSTS, NAMES, Row, lightest, walk
    import re

    rng = random.Random(2)
    for _ in range(60):
        rows = [Row(rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "a", " "]), 1, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        best = [(10 ** 9, "")]

        def go(i, inserted, cost, audit, initials):
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", initials):
                    heapq.heappush(best, (cost, audit))
            else:
                r = rows[i]
                more = 5 * r.truncated
                go(i + 1, inserted, cost + 2, audit + "D", initials)
                if not r.gone:
                    go(i + 1, inserted, cost + more, audit + "K", initials + r.role[0])
                    for x in "ua":
                        go(i + 1, inserted, cost + 1 + more, audit + "R", initials + x)
            if inserted < 2:
                for x in "ua":
                    go(i, inserted + 1, cost + 5, audit + "I", initials + x)

        go(0, 0, 0, "", "")
        cost, final = lightest(rows, END_COSTS, [0])[0]
        steps = list(walk(rows, final, 0))
        assert (cost, "".join(s[0] for s in steps)) == min(best)
        assert all(s[1] is None or s[1].split(":")[0] in (*NAMES.values(), "system") for s in steps)


# --- 13 ----------------------------------------------------------------------
def test_prefix_hash_spans_and_extensions():
    from servebench.llm.fingerprints import Prefix, code_points

    rng = random.Random(4)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = "".join(rng.choice("ab") for _ in range(40)) + a[50:200] + "é" + a[:30]
    p, q = Prefix(code_points(a)), Prefix(code_points(b))
    for _ in range(500):
        i, j = rng.randrange(300), rng.randrange(len(b))
        n = rng.randint(0, min(300 - i, len(b) - j, 6))
        assert p.equal(i, q, j, n) == (a[i:i + n] == b[j:j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert p.common(i, q, j) == want


def test_fingerprint_is_the_same_by_blocks(monkeypatch):
    from servebench.llm import fingerprints as FP

    rng = random.Random(6)
    codes = FP.code_points("".join(rng.choice("abcdé ") for _ in range(5000)))
    want = FP.fingerprint(codes)
    other = codes.copy()
    other[4321] += 1
    monkeypatch.setattr(FP, "STEP", 97)
    assert FP.fingerprint(codes) == want and FP.fingerprint(other) != want
    assert FP.common_prefix(codes, other) == 4321 and FP.common_prefix(codes, codes[:4000]) == 4000


def _spans(t):
    return {t[max(0, i - 8):i] if i >= 8 else "^" + t[:i] for i in range(1, len(t) + 1)}


def test_edited_neighbours(docs, rows, spark):
    from servebench.llm import fingerprints as FP

    before = spark.conf.get("spark.sql.shuffle.partitions")
    by_id = {}
    keyed = [r for r in rows if r[0] is not None]
    for r in keyed:
        by_id.setdefault(r[0], r[1] or "")
    unique = spark.createDataFrame([(i, t, "en", "s", 1, 1, "g", 2, "x") for i, t in by_id.items()], SCHEMA).repartition(4)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        got = {r.doc_id: r for r in FP.edited(unique).collect()}
        n = FP.edited(docs).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert n == len(rows) and got.keys() == by_id.keys()
    ids = sorted(by_id)
    marks, far = {}, []
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = by_id[i], by_id[j]
        k = len(a) // 4
        e = a[:len(a) - k] + b[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), sha(e))
        assert marks.setdefault(a, r.fingerprint) == r.fingerprint and (r.fingerprint == r.edited_fingerprint) == (a == e)
        for value, other in ((r.near_edited, e), (r.near_next, b)):
            x, y = _spans(a), _spans(other)
            j_ = len(x & y) / len(x | y) if x | y else 1.0
            far.append(abs(value - 2 * j_ / (1 + j_)))
            assert 0 <= value <= 1 and (len(x | y) > FP.KEPT or far[-1] < 1e-9)
        same = 0
        while same < min(len(a), len(e)) and a[same] == e[same]:
            same += 1
        assert r.common_chars == same
    assert len(set(marks.values())) == len(marks) and max(far) < 0.35 and sum(far) / len(far) < 0.05


def test_edited_small(spark):
    from servebench.llm import fingerprints as FP

    assert FP.edited(spark.createDataFrame([], SCHEMA)).collect() == []
    r = FP.edited(spark.createDataFrame([(None, "abcdefgh", None, None, None, 1, "g", 2, "x")], SCHEMA)).collect()
    assert len(r) == 1 and r[0].edited_sha256 == sha("abcdefab") and r[0].near_next == 1.0 and r[0].common_chars == 6
