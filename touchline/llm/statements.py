"""SQL of the queries that SQL can express on whole tables, written independently of the operators."""

from __future__ import annotations

#: Steps of the reflected CRC-32 polynomial for each byte value, as a list named t.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([v::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t
  FROM range(256) r(v))"""


def _crc(data: str) -> str:
    """crc32 of a list of byte values, in a query that has ``t``."""
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295)"


def _latin_bytes(text: str) -> str:
    """UTF-8 byte values of a text of code points below 256."""
    spread = "lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::UBIGINT] ELSE [(192 | (ord(ch) >> 6))::UBIGINT, (128 | (ord(ch) & 63))::UBIGINT] END"
    return f"flatten(list_transform(string_split({text}, ''), {spread}))"


def _add(state: str, cost: str, edit: str) -> str:
    """A state is its cost in nine digits and its audit; null where it can't be reached."""
    return f"(lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"


def _least(*states: str) -> str:
    return f"least({', '.join(states)})"


def _made(state: str) -> str:
    return f"CASE WHEN NOT gone THEN {_add(state, '1 + extra', 'R')} END"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_add(state, 'extra', 'K')} END"


def _gone(state: str) -> str:
    return _add(state, "2", "D")


_TURN_REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc(_latin_bytes("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS h
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) copies(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, E' \t\n\x0b\x0c\r') AS bare,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ordered),
judged AS (
  SELECT *, bare = '' AS is_blank, bare <> '' AND again AS is_again, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS is_cut FROM seen),
codes AS (SELECT conv_id, i, initial, role, text, is_blank OR is_again AS gone, CASE WHEN is_cut THEN 5 ELSE 0 END AS extra FROM judged),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_again) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows
  FROM judged GROUP BY conv_id),
walked AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM facts
  UNION ALL
  SELECT conv_id, i, b0, b1, {_least('b2', _add('b0', '5', 'I'), _add('b1', '5', 'I'), _add('b3', '5', 'I'))},
    {_least('b3', _add(_least('b2', _add('b0', '5', 'I'), _add('b1', '5', 'I')), '5', 'I'))}
  FROM (
    SELECT w.conv_id, c.i, {_gone('s0')} AS b0, {_least(_gone('s1'), _kept('s0', 's'))} AS b1,
      {_least(_gone('s2'), *[x for s in ('s0', 's1', 's3') for x in (_kept(s, 'u'), _made(s))])} AS b2,
      {_least(_gone('s3'), _kept('s2', 'a'), _made('s2'))} AS b3
    FROM walked w JOIN codes c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1)),
ends AS (
  SELECT f.conv_id, left({_least('s0', 's3')}, 9)::BIGINT AS cost, substr({_least('s0', 's3')}, 10) AS audit
  FROM walked w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.rows),
letters AS (
  SELECT conv_id, place, edit, sum((edit <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY place) AS i,
    sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY place) AS turn, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
  FROM (SELECT conv_id, audit[place] AS edit, place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM ends))),
made AS (
  SELECT l.conv_id, l.place, CASE WHEN edit = 'K' THEN c.role WHEN (turn + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN edit = 'I' THEN '' ELSE c.text END AS text
  FROM letters l LEFT JOIN codes c ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.i = l.i WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(role || ':' || text, E'\n' ORDER BY place) AS whole FROM made GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_VARIANTS = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc(_latin_bytes("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM lowered, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (SELECT word, n, i, left(word, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.head || a.tail = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.head || a.tail = b.word),
counted AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n, min(other) FILTER (other_n = most) AS top
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form, CASE WHEN top_n >= 10 * w.n THEN top_n END::BIGINT AS form_n
  FROM words w LEFT JOIN counted c ON c.word = w.word),
chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.onward)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.onward IS NULL
"""

STATEMENTS: dict[str, str] = {"op11_cyk_turn_repair": _TURN_REPAIR, "op12_permuterm_variants": _VARIANTS}
