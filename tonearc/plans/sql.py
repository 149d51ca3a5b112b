"""DuckDB SQL of the fixtures, as common table expressions to build oracles from."""

from __future__ import annotations

TOKENS = r"""tok AS (SELECT doc_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS word
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS a FROM documents)),
docs AS (SELECT doc_id, date '2020-01-01' + (doc_id % 1000)::INT AS date, ((doc_id * 31) % 200 - 100) / 100.0e0 AS sentiment FROM documents)"""

LEX = """lexv AS (SELECT word, CASE WHEN neg AND pos THEN NULL WHEN neg THEN 'negative' WHEN pos THEN 'positive' END AS lex
  FROM (SELECT DISTINCT word, (word LIKE 'er%' OR word LIKE '%ung') AS neg, (word LIKE '%ing' OR word LIKE 'th%') AS pos FROM tok))"""

TRIM = """keep AS (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT doc_id) >= 30),
tt AS (SELECT doc_id, pos, CASE WHEN keep.word IS NULL THEN NULL ELSE tok.word END AS word FROM tok LEFT JOIN keep ON tok.word = keep.word)"""


def model(kind: str = "lda", factors: tuple[int, int] = (7919, 104729), trimmed: bool = False) -> str:
    """WITH ..., asg (doc_id, pos, word, z), lexv (word, lex), mix (doc_id, z, l1, l2, l1_p, l2_p, p), lf (z, l1, l2)."""
    L1, L2 = {"lda": (5, 1), "rjst": (5, 3), "jst": (3, 5)}[kind]
    a, g = (1.0, 5.0)
    base = f"((doc_id * {factors[0]} + pos::BIGINT * {factors[1]}) % {L1 * L2})::INT"
    source = "tt" if trimmed else "tok"
    if kind == "lda":
        asg = f"asg AS (SELECT doc_id, pos, word, {base} AS z FROM {source} WHERE word IS NOT NULL)"
        lex = f"lexv AS (SELECT DISTINCT word, NULL AS lex FROM {source} WHERE word IS NOT NULL)"
    else:
        level = "CASE lex WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 END"
        own = f"(b // 3) * 3 + {level}" if kind == "rjst" else f"({level}) * 5 + b % 5"
        asg = f"asg AS (SELECT doc_id, pos, word, coalesce({own}, b)::INT AS z FROM (SELECT tok.*, lex, {base} AS b FROM tok JOIN lexv USING (word)))"
        lex = LEX
    l2_p = "1.0e0" if L2 == 1 else f"(n + {g}e0) / (n1 + {g * L2}e0)"
    return f"""WITH {TOKENS}{", " + TRIM if trimmed else ""}, {lex}, {asg},
lf AS (SELECT z, (z // {L2})::INT AS l1, (z % {L2})::INT AS l2 FROM (SELECT unnest(range({L1 * L2}))::INT AS z)),
zd AS (SELECT doc_id, z, count(*) AS n FROM asg GROUP BY ALL),
dl AS (SELECT doc_id, lf.z, l1, l2, coalesce(zd.n, 0) AS n FROM docs CROSS JOIN lf LEFT JOIN zd USING (doc_id, z)),
dn AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, l1) AS n1, sum(n) OVER (PARTITION BY doc_id) AS tot FROM dl),
mix AS (SELECT *, l1_p * l2_p AS p FROM (SELECT doc_id, z, l1, l2, n, n1, (n1 + {a}e0) / (tot + {a * L1}e0) AS l1_p, {l2_p} AS l2_p FROM dn))"""


def phi(kind: str = "lda") -> str:
    """..., wz (word, z, n), cell (word, z, n, beta), phi (word, z, n, p)."""
    allowed = {"lda": "true", "rjst": "lex IS NULL OR (CASE lex WHEN 'negative' THEN 0 ELSE 2 END) = lf.z % 3", "jst": "lex IS NULL OR (CASE lex WHEN 'negative' THEN 0 ELSE 2 END) = lf.z // 5"}[kind]
    return f""", wz AS (SELECT word, z, count(*) AS n FROM asg GROUP BY ALL),
cell AS (SELECT lexv.word, lf.z, coalesce(n, 0) AS n, CASE WHEN {allowed} THEN 0.01e0 ELSE 0e0 END AS beta FROM lexv CROSS JOIN lf LEFT JOIN wz ON wz.word = lexv.word AND wz.z = lf.z),
sums AS (SELECT z, sum(n) AS nz, sum(beta) AS bz FROM cell GROUP BY z),
phi AS (SELECT word, cell.z, n, (n + beta) / (nz + bz) AS p FROM cell JOIN sums USING (z))"""


def topic(z: str = "l1") -> str:
    return f"'topic' || ({z} + 1)"


def sentiment(z: str) -> str:
    return f"(['negative', 'neutral', 'positive'])[{z} + 1]"


def rolled(series: str, period: str, window: int, by: str = "topic") -> str:
    """A table of (date, by, value) gap-filled and rolled, without null periods; window of complete periods only."""
    part, key = (f"PARTITION BY {by}", f", {by}") if by else ("", "")
    keys = f"CROSS JOIN (SELECT DISTINCT {by} FROM {series})" if by else ""
    return f"""SELECT date{key}, CASE WHEN k >= {window} THEN r END AS value FROM (
  SELECT c.date{key.replace(", ", ", c.")}, s.value AS v, avg(s.value) OVER w AS r, count(*) OVER w AS k
  FROM (SELECT t.d::DATE AS date{key} FROM (SELECT unnest(generate_series((SELECT min(date) FROM {series})::TIMESTAMP, (SELECT max(date) FROM {series})::TIMESTAMP, INTERVAL 1 {period})) AS d) t {keys}) c
  LEFT JOIN {series} s ON s.date = c.date {f"AND s.{by} = c.{by}" if by else ""}
  WINDOW w AS ({part.replace(by, "c." + by) if by else ""} ORDER BY c.date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL"""
