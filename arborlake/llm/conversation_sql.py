"""SQL of the conversation and vector operators, for a check against DuckDB."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a byte is mixed in, then eight shifts follow."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
ids AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
g AS (SELECT c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS one FROM k JOIN ids ON k.conv_id IS NOT DISTINCT FROM ids.conv_id WHERE f <> 0),
o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, one) AS i,
  row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, one) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM g),
q AS MATERIALIZED (SELECT c, i, turn, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prev, bare = '' AS blank, bare <> '' AND nth > 1 AS again,
  bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS late, CASE WHEN bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra FROM o),
n AS MATERIALIZED (SELECT ids.c, coalesce(max(i), 0) AS n FROM ids LEFT JOIN q ON ids.c = q.c GROUP BY ids.c),
b AS (SELECT c, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM n
  UNION ALL
  SELECT c, i, CASE WHEN gone THEN [4 + a[1], 4 + a[2], 4 + a[3], 4 + a[4]] ELSE [least(v0, 3 + v2, 6 + v3), least(v1, 3 + v2, 6 + v3), least(v2, 3 + v3), least(v3, 3 + v2)] END AS v FROM (
    SELECT q.c, q.i, blank OR again AS gone, b.v AS a,
      least(4 + a[1], 3 + extra + a[3], CASE r WHEN 's' THEN extra + a[2] WHEN 'u' THEN extra + a[3] ELSE 1e15::BIGINT END) AS v0,
      least(4 + a[2], 3 + extra + a[3], CASE r WHEN 'u' THEN extra + a[3] ELSE 1e15::BIGINT END) AS v1,
      least(4 + a[3], 3 + extra + a[4], CASE r WHEN 'a' THEN extra + a[4] ELSE 1e15::BIGINT END) AS v2,
      least(4 + a[4], 3 + extra + a[3], CASE r WHEN 'u' THEN extra + a[3] ELSE 1e15::BIGINT END) AS v3
    FROM b JOIN q ON q.c = b.c AND q.i = b.i - 1)),
costs AS MATERIALIZED (SELECT * FROM b),
f AS (SELECT c, 1::BIGINT AS i, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL
  SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE nxt END,
    audit || e, CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, new || ':' || text) ELSE list_append(lines, new || ':') END
  FROM (SELECT f.c, f.i, s, audit, lines, role, text, r, CASE WHEN s = 3 THEN 4 ELSE 3 END AS nxt, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS new,
      CASE WHEN x.v[s] = 4 + y.v[s] THEN 'D' WHEN x.v[s] = 3 + x.v[CASE WHEN s = 3 THEN 4 ELSE 3 END] THEN 'I'
        WHEN x.v[s] = extra + CASE WHEN r = 's' AND s = 1 THEN y.v[2] WHEN r = 'u' AND s <> 3 THEN y.v[3] WHEN r = 'a' AND s = 3 THEN y.v[4] ELSE 1e15::BIGINT END THEN 'K' ELSE 'R' END AS e
    FROM f JOIN n ON n.c = f.c JOIN costs x ON x.c = f.c AND x.i = f.i LEFT JOIN costs y ON y.c = f.c AND y.i = f.i + 1 LEFT JOIN q ON q.c = f.c AND q.i = f.i
    WHERE f.i <= n.n OR x.v[s] > 0)),
done AS (SELECT c, audit, lines FROM f QUALIFY row_number() OVER (PARTITION BY c ORDER BY length(audit) DESC) = 1),
t AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE late) AS truncated,
  count(*) FILTER (WHERE prev IS NOT NULL AND prev || r NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  v[1]::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ids JOIN done USING (c) JOIN (SELECT c, v FROM costs WHERE i = 1) USING (c) LEFT JOIN t USING (c)
"""

OP12_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""

OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS MATERIALIZED (SELECT c.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS s, coalesce(list(length(text) ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS chars
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, d, s[1:d] AS k, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, CASE WHEN d > 1 THEN s[1:d - 1] ELSE [] END AS up, d = len(s) AS stops FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, any_value(up) AS up, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE stops), '')) AS ends_sha256
  FROM p GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.k = kids.k),
above AS (SELECT k[1:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY k[1:a])
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN above ON above.k = m.k LEFT JOIN n up ON up.k = m.up AND m.depth > 0
"""
