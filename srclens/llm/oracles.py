"""DuckDB SQL of the training-data queries that SQL can express."""

#: Exact integer scores of every anchor with every row that takes part; doubles hold them without error up to 2^53.
OP12 = """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 3
"""

#: crc32 of a decimal id, bit by bit: a byte is xored in, then eight shifts (marked -1) follow.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
    list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END))"""

OP13 = """
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role) AS l FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, l, CAST({crc} % 9 AS BIGINT) AS h FROM lists),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l
  FROM hashed a LEFT JOIN lists b ON b.conv_id = a.conv_id - a.conv_id % 5),
pre AS (
  SELECT conv_id, d, len(l) = d AS ends, CAST(to_json(l[1:d]) AS VARCHAR) AS k,
         CASE WHEN d = 0 THEN NULL ELSE CAST(to_json(l[1:d - 1]) AS VARCHAR) END AS up,
         CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].text) END AS bytes
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT k, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM pre GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.up = n.k),
spans AS (
  SELECT DISTINCT a.k AS top, b.k AS k FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.d <= b.d),
sub AS (
  SELECT s.top, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
  FROM spans s JOIN full_ f ON f.k = s.k GROUP BY s.top)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sub ON sub.top = f.k LEFT JOIN full_ p ON p.k = f.up
""".format(crc=_CRC32.format(c="conv_id"))

ORACLES = {"op12_residue_gemm": OP12, "op13_turn_trie": OP13}
