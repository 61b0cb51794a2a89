"""The queries of this folder as DuckDB SQL over whole tables, written from their contracts and not from the operators.

The others have none: op2 and op10 depend on order and on a fit, op4 and op9 on fitted models, op7 on a tokenizer, op11 on eigenvectors; tests hold
these against plain versions, round trips or held-out accuracy."""

from __future__ import annotations

from .sharding import PRIME, round_keys

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = r"""
WITH lines AS (
  SELECT doc_id, n, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL)),
classes AS (SELECT w, min((doc_id, n)) AS first FROM lines WHERE len(w) > 0 GROUP BY w),
shingles AS (
  SELECT DISTINCT first, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT first, w, unnest(range(1, len(w) - 3)) AS i FROM classes WHERE len(w) >= 5)),
sizes AS (SELECT first, count(*) AS size FROM shingles GROUP BY first),
common AS (SELECT a.first AS later, b.first AS earlier, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND b.first < a.first GROUP BY a.first, b.first),
near AS (SELECT DISTINCT later FROM common JOIN sizes x ON x.first = later JOIN sizes y ON y.first = earlier WHERE 5 * c >= 4 * (x.size + y.size - c)),
judged AS (
  SELECT l.doc_id, l.n, l.line, coalesce((l.doc_id, l.n) <> c.first OR near.later IS NOT NULL, false) AS gone
  FROM lines l LEFT JOIN classes c ON l.w = c.w LEFT JOIN near ON near.later = c.first),
texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""

_OP3 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.size + y.size - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(max(size), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

_WORDS5 = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP5 = rf"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_WORDS5} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, p.size, i FROM places p JOIN windows x ON x.s = p.s AND x.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(owners.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

_OP6 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts)),
firsts AS (SELECT s, min((doc_id, i)) AS first FROM words WHERE s IS NOT NULL GROUP BY s),
repeats AS (SELECT doc_id, i, word, coalesce((doc_id, i) <> first, false)::INT AS again FROM words LEFT JOIN firsts USING (s)),
judged AS (SELECT doc_id, i, word, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM repeats),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""

_OP8 = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, length(h) // 2 AS n, base, substr(h, 2 * base + 1, 2 * 599) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 500)) AS base FROM texts)),
bytes AS (
  SELECT doc_id, base + k AS i, substr(p, 2 * k - 1, 2) AS byte, CASE WHEN base + k + 99 <= n THEN hash(substr(p, 2 * k - 1, 200)) END AS s
  FROM (SELECT doc_id, n, base, p, unnest(range(1, least(501, n - base + 1))) AS k FROM pieces)),
firsts AS (SELECT s, min(doc_id * 1000000000 + i) AS first FROM bytes WHERE s IS NOT NULL GROUP BY s),
repeats AS (SELECT doc_id, i, byte, coalesce(doc_id * 1000000000 + i <> first, false)::INT AS again FROM bytes LEFT JOIN firsts USING (s)),
judged AS (SELECT doc_id, i, byte, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM repeats),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM judged),
kept AS (SELECT doc_id, sum(gone) AS n, count(*) FILTER (begins) AS spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS h FROM runs GROUP BY doc_id)
SELECT doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256 FROM texts t LEFT JOIN kept k USING (doc_id)
"""

_OP12 = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM texts)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS p FROM grams WHERE size >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(p[1:k], ' ') AS x, array_to_string(p[k + 1:size], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, u.f AS l, v.f AS r, (1000000::HUGEINT * c.a * c.a) // (u.f::HUGEINT * v.f) AS score
  FROM cuts c JOIN grams u ON u.lang = c.lang AND u.phrase = x JOIN grams v ON v.lang = c.lang AND v.phrase = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s
  JOIN (SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS part FROM candidates WHERE size = 3) t
  ON t.lang = s.lang AND t.part = s.phrase AND 100 * t.a >= 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest ANTI JOIN inside USING (lang, phrase))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _shards(rows: str, shards: int, seed: int) -> str:
    """The permutation of numbered rows (doc_id, size, text_crc32, row_no), from its definition; a walk is a recursion."""
    left, right = "v // b", "v % b"
    steps = []
    for k, (shift, factor) in enumerate(round_keys(seed)):
        t = f"(({{}} + {shift}) % {PRIME})"
        value = lambda half, t=t, factor=factor: f"((({t.format(half)} * {t.format(half)} % {PRIME}) * {t.format(half)} % {PRIME}) * {factor} % {PRIME})"
        change = f"le, (ri + {value('le')}) % b AS ri" if k % 2 else f"(le + {value('ri')}) % a AS le, ri"
        steps.append(f"SELECT row_no, n, a, b, {change} FROM ")
    inner = f"(SELECT row_no, n, a, b, {left} AS le, {right} AS ri FROM walk WHERE steps = 0 OR v >= n)"
    for step in steps:
        inner = f"({step}{inner})"
    return f"""
WITH RECURSIVE rows AS ({rows}),
sizes AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM rows),
walk AS (
  SELECT row_no, n, a, (n + a - 1) // a AS b, row_no AS v, 0 AS steps FROM rows, sizes
  UNION ALL
  SELECT row_no, n, a, b, le * b + ri AS v, 1 AS steps FROM {inner})
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INTEGER AS shard, (v // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM rows JOIN walk USING (row_no) WHERE steps = 1 AND v < n
"""


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))"  # CRC-32, reflected
_ROWS = f"""
SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no
FROM (
  SELECT doc_id, len(bytes) + 1 AS size, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, crcs[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
       (SELECT {_TABLE} AS crcs))
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _OP1, "op3_ngram_join": _OP3, "op5_decontaminate": _OP5, "op6_phrase_dedup": _OP6, "op8_suffix_dedup": _OP8, "op12_collocations": _OP12,
    "op13_shards": _shards(_ROWS, shards=8, seed=13),
}
