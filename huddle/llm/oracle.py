"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


from huddle.llm.sharding import BYTE_LIMIT, HASH_BITS

# A document's depth is the least at which all documents of its prefix fit.
EXTENDIBLE_HASHING = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
sums AS (
  SELECT depth, hash >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS bytes
  FROM d, range(0, {HASH_BITS + 1}) AS r(depth) GROUP BY ALL),
leaf AS (
  SELECT DISTINCT d.hash, min(s.depth) FILTER (s.bytes <= {BYTE_LIMIT}) OVER (PARTITION BY d.hash) AS fit
  FROM (SELECT DISTINCT hash FROM d) d JOIN sums s ON s.prefix = d.hash >> ({HASH_BITS} - s.depth)),
placed AS (
  SELECT d.*, coalesce(fit, {HASH_BITS}) AS depth, fit IS NULL AS overflow,
         row_number() OVER (PARTITION BY d.hash) - 1 AS i
  FROM d JOIN leaf USING (hash)),
paged AS (
  SELECT *, CAST(CASE WHEN overflow THEN i // greatest({BYTE_LIMIT} // greatest(n_bytes, 1), 1) ELSE 0 END AS INTEGER) AS page FROM placed)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, page,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> ({HASH_BITS} - depth)), CAST(depth AS INTEGER), '0') END || '.' || page AS shard
FROM paged
"""

# Lines by their whole keys; a key of enough documents stays in the largest alone.
RANGE_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.largest AS gone FROM k LEFT JOIN often o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row
"""

# The 256 entries of crc32's table follow from its polynomial; a text's bytes are read from its hex form.
_CRC_TABLE = """
crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
  FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes; the table is ``crc.t``."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (f"xor(4294967295, list_reduce(list_transform(range(strlen({text})), lambda i: {byte}),"
            " lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))")


# Near words share a text with one letter left out, at the same place (replaced) or
# as a whole word (one more, one fewer).
BIT_SLICED = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
                unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
low AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("doc || ':' || run")} AS h FROM low, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                 ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
          FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, other, m FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) = 1),
found AS (SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, b.other AS form, b.m AS form_n
          FROM words w LEFT JOIN (SELECT word, count(*) AS n_near FROM pairs GROUP BY word) p USING (word)
          LEFT JOIN best b ON b.word = w.word AND b.m >= 10 * w.n),
chain AS (SELECT word, word AS root, 0 AS step FROM found
          UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(c.root, c.step) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM found f
"""

_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                      for c in ("doc_id", "source", "lang", "n", "text"))


def _leaf(n: str) -> str:
    return "sha256(" + _FIELDS.replace("CAST(n AS", f"CAST({n} AS") + ")"


# Both kinds of trees level by level; a leaf's path is the join of its nodes' siblings.
DAG_DESCENT = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                  CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed,
                  n_chars IS NOT NULL AS known FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS tree FROM leaves),
nodes AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS m FROM placed
          UNION ALL
          SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2
          FROM nodes WHERE m > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, h FROM nodes WHERE m = 1),
upper AS (SELECT 0 AS level, tree AS i, h, count(*) OVER () AS m FROM subroots
          UNION ALL
          SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2
          FROM upper WHERE m > 1 GROUP BY level, i // 2),
walk AS (SELECT tree, i AS leaf_i, i, 0 AS level, '' AS proof, CASE WHEN known THEN coalesce(changed, leaf) ELSE leaf END AS node,
                false AS above FROM placed
         UNION ALL
         SELECT w.tree, w.leaf_i,
                CASE WHEN n.m > 1 THEN w.i // 2 ELSE w.tree END, CASE WHEN n.m > 1 THEN w.level + 1 ELSE 0 END,
                w.proof || CASE WHEN n.m > 1 THEN coalesce(s.h, '') ELSE '' END,
                CASE WHEN n.m <= 1 THEN w.node
                     WHEN w.i % 2 = 1 THEN sha256(s.h || w.node) ELSE sha256(w.node || coalesce(s.h, '')) END,
                n.m <= 1
         FROM walk w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.i = w.i
         LEFT JOIN nodes s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE NOT w.above),
climb AS (SELECT tree, leaf_i, i, level, proof, node FROM walk WHERE above
          UNION ALL
          SELECT c.tree, c.leaf_i, c.i // 2, c.level + 1, c.proof || coalesce(s.h, ''),
                 CASE WHEN c.i % 2 = 1 THEN sha256(s.h || c.node) ELSE sha256(c.node || coalesce(s.h, '')) END
          FROM climb c JOIN upper n ON n.level = c.level AND n.i = c.i AND n.m > 1
          LEFT JOIN upper s ON s.level = c.level AND s.i = xor(c.i, 1)),
top AS (SELECT h FROM upper WHERE m = 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, top.h AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root,
       c.node = top.h AS verified
FROM placed p JOIN subroots r USING (tree) CROSS JOIN top
JOIN climb c ON c.tree = p.tree AND c.leaf_i = p.i
JOIN (SELECT max(level) AS last FROM upper) u ON c.level = u.last
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_extendible_hashing": EXTENDIBLE_HASHING, "op11_range_lines": RANGE_LINES,
            "op12_bit_sliced": BIT_SLICED, "op13_dag_descent": DAG_DESCENT}
