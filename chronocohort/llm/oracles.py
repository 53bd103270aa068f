"""SQL that gives the same rows as the newer queries of this subpackage."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _step(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, half a byte at a time."""
    steps = "[" + ", ".join(str(_step(c)) for c in range(16)) + "]"
    digit = "instr('0123456789ABCDEF', substr({0}, p + CASE WHEN p % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1"
    digits = f"list_transform(range(2 * strlen({text})), lambda p: ({digit.format(f'hex(encode({text}))')})::BIGINT)"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, x: xor({steps}[(xor(c, x) & 15) + 1], c >> 4))"
    return f"xor({folded}, 4294967295)"


def _value(expression: str) -> str:
    return f"coalesce(strlen({expression}::VARCHAR) || ':' || {expression}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _walk(name: str, start: str, nodes: str, same: str) -> str:
    """Recursive table of (id, lang, level, pos, h, proof): a leaf's version on its way up through ``nodes``."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT w.id, w.lang, w.level + 1, w.pos // 2, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN s.pos < w.pos THEN s.h || w.h ELSE w.h || s.h END),
         w.proof || coalesce(s.h, ''), (w.n + 1) // 2
  FROM {name} AS w LEFT JOIN {nodes} AS s ON {same} AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)"""


OP12_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
               CASE WHEN n_chars IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed FROM documents)),
node AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaf
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM node WHERE n > 1 GROUP BY lang, level, pos // 2),
sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, sub.pos, subroot AS h, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
{_walk("low", "SELECT id, lang, 0 AS level, pos, coalesce(changed, leaf) AS h, '' AS proof, n FROM leaf", "node", "s.lang IS NOT DISTINCT FROM w.lang")},
{_walk("high", "SELECT id, low.lang, 0 AS level, sub.pos, low.h, low.proof, sub.n FROM low JOIN sub ON sub.lang IS NOT DISTINCT FROM low.lang WHERE low.n = 1", "top", "true")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
FROM leaf JOIN high USING (id) JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang, (SELECT h AS root FROM top WHERE n = 1)
WHERE high.n = 1
"""

_CHANGED = crc32_sql("doc_id::VARCHAR || ':' || run")

OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
marked AS (SELECT run, n, {_CHANGED} AS h FROM own),
cut AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM marked),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
gone AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM v, unnest(range(1, length(word) + 1)) AS t(p)),
pairs AS (
  SELECT DISTINCT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM gone a JOIN gone b ON a.short = b.short AND a.p = b.p AND a.word <> b.word
  UNION ALL
  SELECT DISTINCT a.word, a.n, b.word, b.n FROM gone a JOIN v b ON a.short = b.word
  UNION ALL
  SELECT DISTINCT b.word, b.n, a.word, a.n FROM gone a JOIN v b ON a.short = b.word),
best AS (SELECT a AS word, na AS n, count(*) AS n_near, arg_min(b, (-nb, b)) AS b, max(nb) AS nb FROM pairs GROUP BY 1, 2),
form AS (SELECT word, n_near, CASE WHEN nb >= 2 * n THEN b END AS form, CASE WHEN nb >= 2 * n THEN nb END AS form_n FROM best),
chain AS (
  SELECT word, word AS root FROM v
  UNION ALL
  SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root AND form.form IS NOT NULL)
SELECT v.word, form.form, chain.root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM v LEFT JOIN form ON form.word = v.word JOIN chain ON chain.word = v.word
WHERE NOT EXISTS (SELECT 1 FROM form f WHERE f.word = chain.root AND f.form IS NOT NULL)
"""
