"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .line_dedup import MIN_CHARS, MIN_DOCS
from .quality_rules import BOILERPLATE, COMMON_TEXTS, COMMON_WORDS
from .sharding import DRAW_DIGITS, Node, tree

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

VECTORS = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach AS (SELECT vec_id AS n, vec_id AS c FROM ok UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.n),
heads AS (SELECT n, min(c) AS c FROM reach GROUP BY n),
counts AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, CAST(coalesce(c, vec_id) AS BIGINT) AS component_id, coalesce(vec_id = coalesce(c, vec_id), false) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN heads ON n = vec_id"""

DOCUMENTS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_of x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x.k >= 85 * (p.k + q.k - x.k)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.d),
heads AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_shingles, CAST(c AS BIGINT) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN heads ON d = w.doc_id"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t HAVING count(DISTINCT doc_id) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN f USING (t) WHERE doc_id > least),
lists AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM cut GROUP BY doc_id),
each_word AS (SELECT doc_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS x FROM w),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.k) AS t FROM each_word e LEFT JOIN cut c ON c.doc_id = e.doc_id AND c.k = e.k WHERE c.k IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _draw(key: str, node: Node) -> str:
    return f"-ln((CAST('0x' || substr(md5({key} || ':{node.name}'), 1, {DRAW_DIGITS}) AS BIGINT) + 0.5) / {16**DRAW_DIGITS}.0) / {node.weight}"


def _descend(key: str, node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _descend(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    cases = " ".join(f"WHEN {d} <= least({', '.join(draws)}) THEN {_descend(key, c)}" for d, c in zip(draws, node.children))
    return f"CASE {cases} END"


_KEY = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
#: The checksum's table is made by its rule: eight times, shift right, and subtract the polynomial where a 1 fell out.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END)) AS t)"
SHARDS = f"""
WITH {_CRC_TABLE},
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, CAST(len(h) // 2 + 1 AS BIGINT) AS size,
        xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32
      FROM b, crc)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5({_KEY}), 25, 8) AS BIGINT) % 1024, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM (SELECT *, CAST({_descend(_KEY, tree(8))} AS INTEGER) AS shard, CAST({_descend(_KEY, tree(9, 8))} AS INTEGER) AS grown_shard FROM s)"""

_LINE_WORDS = r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))"
_FAILS = rf"""(len(regexp_extract_all(l, '[#*$%&|<>]')) > 0.3 * {_LINE_WORDS} OR len(regexp_extract_all(l, '!')) > 0.3 * {_LINE_WORDS} OR ({_LINE_WORDS} > 3 AND upper(l) = l AND lower(l) <> l)
  OR ({_LINE_WORDS} <= 3 AND NOT regexp_matches(l, '[.!?…。！？:;"''”’)\]][\x20\x09-\x0D]*$')) OR len(regexp_extract_all(l, '[|»«›>•·→]')) > 0.2 * {_LINE_WORDS} OR regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))"""
RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
many AS (SELECT doc_id, t FROM tri GROUP BY doc_id, t HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM tri JOIN many USING (doc_id, t)) GROUP BY doc_id),
lines AS (SELECT doc_id, text, unnest(ls) AS l FROM d),
good AS (SELECT doc_id, text, l, length(regexp_replace(l, '{_SPACE}+', '', 'g')) AS c FROM lines WHERE NOT {_FAILS}),
common AS (SELECT l FROM good WHERE {_LINE_WORDS} <= {COMMON_WORDS} GROUP BY l HAVING count(DISTINCT text) >= {COMMON_TEXTS}),
kept AS (SELECT doc_id, sum(c) AS c FROM good ANTI JOIN common USING (l) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(c, 0) AS BIGINT) AS kept_chars
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * word_chars AS kept FROM m"""

LINES = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, x, regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS k
      FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM d)),
common AS (SELECT k FROM l WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM l ANTI JOIN common USING (k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

MERGE = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x FROM d),
parts AS (SELECT doc_id, unnest(['row', 'lang', 'source']) AS part FROM d UNION ALL SELECT doc_id, CAST(i AS VARCHAR) FROM lines),
named AS (SELECT doc_id, part, b, b || ':' || doc_id || ':' || part AS s FROM parts, (SELECT unnest(['L', 'R']) AS b)),
code AS (SELECT doc_id, part, b,
    xor(list_reduce(list_concat([4294967295], list_transform(range(length(s)), lambda i: CAST(ascii(substr(s, CAST(i + 1 AS BIGINT), 1)) AS BIGINT))), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 11 AS c FROM named, crc),
c AS (SELECT doc_id, part, max(c) FILTER (b = 'L') AS l, max(c) FILTER (b = 'R') AS r FROM code GROUP BY 1, 2),
ops AS (SELECT doc_id, i, x, l, r, CASE WHEN l <= 2 THEN l END AS le, CASE WHEN r <= 2 THEN r END AS re, CASE WHEN l IN (3, 4) THEN l END AS lg, CASE WHEN r IN (3, 4) THEN r END AS rg
        FROM lines JOIN c USING (doc_id) WHERE part = CAST(i AS VARCHAR)),
made AS (SELECT *, CASE WHEN le <> re THEN NULL ELSE coalesce(le, re) END AS e, CASE WHEN lg <> rg THEN NULL ELSE coalesce(lg, rg) END AS g FROM ops),
texts AS (SELECT doc_id,
    coalesce(string_agg(CASE WHEN e = 0 THEN '' ELSE x || CASE e WHEN 1 THEN '!' WHEN 2 THEN '?' ELSE '' END END || CASE WHEN g IS NULL THEN '' ELSE CASE WHEN e = 0 THEN '' ELSE chr(10) END || CASE g WHEN 3 THEN '!' ELSE '?' END END, chr(10) ORDER BY i)
      FILTER (coalesce(e, 1) <> 0 OR g IS NOT NULL), '') AS text,
    count(*) FILTER (e IS NOT NULL) + count(*) FILTER (g IS NOT NULL) AS clean, count(*) FILTER (le <> re AND le > 0 AND re > 0) AS ee, count(*) FILTER (le <> re AND (le = 0 OR re = 0)) AS ed, count(*) FILTER (lg <> rg) AS ii,
    bool_or(l <= 4) AS lc, bool_or(r <= 4) AS rc FROM made GROUP BY doc_id),
cols AS (SELECT doc_id, part, v, CASE l WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS lv, CASE r WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS rv
         FROM (SELECT doc_id, part, CASE part WHEN 'lang' THEN lang ELSE source END AS v, l, r FROM d JOIN c USING (doc_id) WHERE part IN ('lang', 'source'))),
settled AS (SELECT doc_id, part, CASE WHEN lv = rv THEN lv WHEN lv = v THEN rv WHEN rv = v THEN lv ELSE v END AS v, lv <> v AS lc, rv <> v AS rc, lv <> v AND rv <> v AND lv <> rv AS clash FROM cols),
wide AS (SELECT doc_id, max(v) FILTER (part = 'lang') AS lang, max(v) FILTER (part = 'source') AS source, bool_or(lc) AS lc, bool_or(rc) AS rc,
    count(*) FILTER ((lc OR rc) AND NOT clash) AS clean, count(*) FILTER (clash) AS ee FROM settled GROUP BY doc_id),
joined AS (SELECT d.doc_id, d.lang AS bl, d.source AS bs, array_to_string(d.ls, chr(10)) AS bt, w.lang, w.source, x.text, w.clean + x.clean AS clean, w.ee + x.ee AS ee, x.ed, x.ii, c.l = 0 OR c.r = 0 AS gone,
    c.l = 0 AND c.r > 0 AND (w.rc OR x.rc) OR c.r = 0 AND c.l > 0 AND (w.lc OR x.lc) AS clash
  FROM d JOIN wide w USING (doc_id) JOIN texts x USING (doc_id) JOIN c ON c.doc_id = d.doc_id AND c.part = 'row'),
added AS (SELECT -1 - doc_id AS id, lang, source, CASE l WHEN 3 THEN '!' ELSE '?' END AS t FROM d JOIN c USING (doc_id) WHERE part = 'row' AND l IN (3, 4)
  UNION ALL SELECT -2 - doc_id, lang, source, CASE r WHEN 3 THEN '!' ELSE '?' END FROM d JOIN c USING (doc_id) WHERE part = 'row' AND r IN (3, 4)),
fresh AS (SELECT id, min(lang) AS lang, min(source) AS source, min(t) AS t, count(DISTINCT (lang, source, t)) = 1 AS same FROM added GROUP BY id)
SELECT doc_id, CASE WHEN clash THEN bl WHEN NOT gone THEN lang END AS lang, CASE WHEN clash THEN bs WHEN NOT gone THEN source END AS source, CASE WHEN clash THEN sha256(bt) WHEN NOT gone THEN sha256(text) END AS text_sha256,
  CAST(CASE WHEN clash THEN 0 WHEN gone THEN 1 ELSE clean END AS BIGINT) AS n_clean, CAST(CASE WHEN gone THEN 0 ELSE ee END AS BIGINT) AS n_edit_edit,
  CAST(CASE WHEN clash THEN 1 WHEN gone THEN 0 ELSE ed END AS BIGINT) AS n_edit_delete, CAST(CASE WHEN gone THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert FROM joined
UNION ALL
SELECT id, CASE WHEN same THEN lang END, CASE WHEN same THEN source END, CASE WHEN same THEN sha256(t) END, CAST(same AS BIGINT), 0, 0, CAST(NOT same AS BIGINT) FROM fresh"""

NEGATIVES = """
WITH ok AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS pos, p.s AS ps, n.b, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
      FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT a AS anchor_id, pos AS positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""
