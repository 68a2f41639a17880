"""DuckDB statements for the queries of the corpus checks (operators 11 to 13)."""

# CRC-32 as a sum: what each byte adds depends on its value and its distance from the
# end, and the start value on the number of bytes. Messages of up to CRC_BYTES bytes.
CRC_BYTES = 256
_CRC = f"""
steps(b, x, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM steps WHERE k < 8
), bytes AS (
  SELECT b, x AS t FROM steps WHERE k = 8
), far(k, b, t) AS (
  SELECT 1, b, t FROM bytes
  UNION ALL
  SELECT far.k + 1, far.b, xor(far.t >> 8, bytes.t) FROM far JOIN bytes ON bytes.b = far.t & 255
  WHERE far.k < {CRC_BYTES}
), begun(n, z) AS (
  SELECT 0, 4294967295
  UNION ALL
  SELECT n + 1, xor(z >> 8, bytes.t) FROM begun JOIN bytes ON bytes.b = z & 255 WHERE n < {CRC_BYTES}
), split AS (
  SELECT m.message, s.place, ord(substr(m.message, s.place, 1))::BIGINT AS c
  FROM messages m, unnest(range(1, length(m.message) + 1)) AS s(place)
), parts AS (
  SELECT message, 2 * place AS place, CASE WHEN c < 128 THEN c ELSE 192 + (c >> 6) END AS b FROM split
  UNION ALL
  SELECT message, 2 * place + 1, 128 + (c & 63) FROM split WHERE c >= 128
), placed AS (
  SELECT message, b, count(*) OVER (PARTITION BY message) AS n,
         row_number() OVER (PARTITION BY message ORDER BY place DESC) AS k
  FROM parts
), crcs AS (
  SELECT message, xor(xor(bit_xor(far.t), any_value(begun.z)), 4294967295) AS crc
  FROM placed JOIN far USING (k, b) JOIN begun USING (n)
  GROUP BY message
)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         coalesce(regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p(i)
  WHERE len(w) > 0
), spots AS (
  SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS words
  FROM (SELECT * FROM docs, (SELECT DISTINCT m FROM windows)), unnest(range(1, len(w) - m + 2)) AS p(i)
), hits AS (
  SELECT row, m, i, item FROM spots JOIN windows USING (m, words)
), hit_words AS (
  SELECT row, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(m)) AS p(k) GROUP BY row
), hit_items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""


def field(value: str) -> str:
    """``-`` if null, else the number of bytes, a colon and the value."""
    return f"coalesce(strlen({value}::VARCHAR) || ':' || ({value}::VARCHAR), '-')"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(map(field, fields)) + ")"


def _tree(name: str, group: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (group, pos, n, h), with their level."""
    return f"""{name}({group}, level, pos, n, h) AS (
  SELECT {group}, 0, pos, n, h FROM {leaves}
  UNION ALL
  SELECT {group}, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY {group}, level, pos // 3, n
)"""


MERKLE = f"""
WITH RECURSIVE messages AS (
  SELECT DISTINCT doc_id::VARCHAR AS message FROM documents WHERE doc_id IS NOT NULL
), {_CRC}, rows AS (
  SELECT row_number() OVER () AS row, doc_id, source, {_leaf("text")} AS h,
         CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed
  FROM documents LEFT JOIN crcs ON message = doc_id::VARCHAR
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h, row) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM rows
), {_tree("nodes", "source", "leaves")}, subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, 0 AS whole
  FROM nodes WHERE n = 1
), {_tree("tops", "whole", "subroots")}, paths AS (
  SELECT l.row, x.level, x.pos, x.h, x.pos < l.pos // (3 ** x.level)::BIGINT AS before
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1
    AND x.pos // 3 = l.pos // (3 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT l.row, 1000 + x.level, x.pos, x.h, x.pos < s.pos // (3 ** x.level)::BIGINT
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
    JOIN tops x ON x.n > 1 AND x.pos // 3 = s.pos // (3 ** (x.level + 1))::BIGINT
), own AS (
  SELECT row, level, pos FROM (
    SELECT l.row, x.level, l.pos // (3 ** x.level)::BIGINT AS pos
    FROM leaves l JOIN (SELECT DISTINCT source, level FROM nodes WHERE n > 1) x
      ON x.source IS NOT DISTINCT FROM l.source
    UNION ALL
    SELECT l.row, 1000 + x.level, s.pos // (3 ** x.level)::BIGINT
    FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source,
      (SELECT DISTINCT level FROM tops WHERE n > 1) x
  )
), sides AS (
  SELECT o.row, o.level,
         coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos < o.pos), '') AS lefts,
         coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos > o.pos), '') AS rights
  FROM own o JOIN paths p ON p.row = o.row AND p.level = o.level
  GROUP BY o.row, o.level
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY level) AS k FROM sides
), folds(row, k, h) AS (
  SELECT row, 0, changed FROM leaves
  UNION ALL
  SELECT f.row, f.k + 1, sha256(n.lefts || f.h || n.rights)
  FROM folds f JOIN numbered n ON n.row = f.row AND n.k = f.k + 1
), folded AS (
  SELECT row, arg_max(h, k) AS folded_root FROM folds GROUP BY row
), proofs AS (
  SELECT row, sha256(string_agg(lefts || rights, '' ORDER BY level)) AS proof FROM numbered GROUP BY row
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root,
       coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.h AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  JOIN tops t ON t.n = 1 JOIN folded f ON f.row = l.row LEFT JOIN proofs p ON p.row = l.row
"""

SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT row, id, unnest(regexp_extract_all(low, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM (SELECT row_number() OVER () AS row, coalesce(doc_id::VARCHAR, '') AS id, {_LOWER.format("text")} AS low
          FROM documents)
  ) GROUP BY id, run
), messages AS (
  SELECT DISTINCT id || ':' || run AS message FROM runs
), {_CRC}, spelled AS (
  SELECT n, CASE WHEN crc % 97 = 0
                 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2)
                 ELSE run END AS word
  FROM runs JOIN crcs ON message = id || ':' || run
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS p(i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b
    ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION
  SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION
  SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), chosen AS (
  SELECT b.word, b.n_near, b.most, min(p.near) AS near
  FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.most GROUP BY ALL
), formed AS (
  SELECT w.word, w.n, coalesce(c.n_near, 0) AS n_near,
         CASE WHEN c.most >= 2 * w.n THEN c.near END AS form, CASE WHEN c.most >= 2 * w.n THEN c.most END AS form_n
  FROM words w LEFT JOIN chosen c USING (word)
), chain(word, upto, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.upto AS root
FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
