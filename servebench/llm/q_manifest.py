"""Queries of operators 11 (Merkle manifest), 12 (conversation repair) and 13 (fingerprints), SQL of 11 and 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, merkle, repair
from .tables import table


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.altered_third())


def _crc32(value: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([xor(c, b)] || range(8), lambda d, i: {step})"
    codes = f"list_transform(string_split({value}, ''), lambda ch: CAST(ord(ch) AS BIGINT))"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {byte}), 4294967295)"


def op11_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``op11_merkle_manifest`` over ``docs``."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    sides = ("coalesce(string_agg(digest, '') OVER (PARTITION BY {k} pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
             "coalesce(string_agg(digest, '') OVER (PARTITION BY {k} pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
       CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM {docs}),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n FROM d),
tree(lang, lvl, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
            FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 8),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM tree WHERE n = 1),
top(lvl, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL SELECT lvl + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(digest, '' ORDER BY pos))
            FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
inner_runs AS (SELECT lang, lvl, pos, {sides.format(k='lang, lvl,')} FROM tree WHERE n > 1),
outer_runs AS (SELECT lvl, pos, {sides.format(k='lvl,')} FROM top WHERE n > 1),
l AS (SELECT p.*, s.subroot, s.pos AS at, row_number() OVER () AS r FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang),
steps AS (SELECT r, x.lvl, a, b FROM l JOIN inner_runs x ON l.lang IS NOT DISTINCT FROM x.lang AND x.pos = l.pos >> (3 * x.lvl)
          UNION ALL SELECT r, 100 + y.lvl, a, b FROM l JOIN outer_runs y ON y.pos = l.at >> (3 * y.lvl)),
walk AS (SELECT r, string_agg(a || b, '' ORDER BY lvl) AS proof, list(a || '*' || b ORDER BY lvl) AS runs FROM steps GROUP BY r),
done AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([changed] || coalesce(runs, []), lambda c, x: sha256(replace(x, '*', c))) AS folded_root
  FROM l LEFT JOIN walk USING (r))
SELECT *, folded_root = root AS verified FROM done"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_sql(conversations: str = "conversations") -> str:
    """DuckDB SQL for the rows of ``op12_conversation_repair``: every state's best repair of the
    rows from ``i`` on, as text of cost (9 digits), audit, chr(31) and repaired lines."""
    shown = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    kind = _crc32(f"({shown('conv_id')} || ':' || {shown('turn')})") + " % 20"
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    made = {q: "assistant" if q == 2 else "user" for q in after}

    def put(v: str, letter: str, cost: str, line: str) -> str:
        cut = f"strpos({v}, chr(31))"
        return (f"(printf('%09d', substr({v}, 1, 9)::BIGINT + {cost}) || '{letter}' || substr({v}, 10, {cut} - 9) "
                f"|| {line} || substr({v}, {cut} + 1))")

    def inserted(source: str) -> str:
        """Up to three rows inserted before the rest."""
        for _ in range(3):
            best = ", ".join(f"least(v{q}, {put(f'v{n}', 'I', '5', f"chr(10) || '{made[q]}:'")}) AS v{q}" for q, n in after.items())
            source = f"(SELECT conv_id, i, {best} FROM {source})"
        return source

    def edited(q: int) -> str:
        add = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        ways = [put(f"v{q}", "D", "2", "''")]
        keep = {0: ["s1", "u2"], 1: ["u2"], 2: ["a3"], 3: ["u2"]}[q]
        ways += [f"CASE WHEN NOT gone AND substr(role, 1, 1) = '{k[0]}' THEN {put(f'v{k[1]}', 'K', add, "chr(10) || role || ':' || text")} END" for k in keep]
        ways.append(f"CASE WHEN NOT gone THEN {put(f'v{after[q]}', 'R', f'1 + {add}', f"chr(10) || '{made[q]}:' || text")} END")
        return f"least({', '.join(ways)}) AS v{q}"

    start = "(SELECT conv_id, max(i) + 1 AS i, '000000000' || chr(31) AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, '000000000' || chr(31) AS v3 FROM f GROUP BY conv_id)"
    step = (f"(SELECT f.conv_id, f.i, {', '.join(map(edited, after))} FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i - 1)")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, {shown('role')} AS role, {shown('text')} AS text, {kind} AS kind FROM {conversations}),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (SELECT *, regexp_replace(text, '[ 	-
]+$', '') AS said,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM n),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
        said = '' OR again AS gone FROM p),
best(conv_id, i, v0, v1, v2, v3) AS (SELECT * FROM {inserted(start)} UNION ALL SELECT * FROM {inserted(step)}),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
won AS (SELECT conv_id, v0, strpos(v0, chr(31)) AS cut FROM best WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(v0, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(v0, 10, cut - 10), '') AS audit, sha256(coalesce(substr(v0, cut + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM c.conv_id"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))
