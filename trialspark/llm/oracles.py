"""DuckDB SQL for the registered queries that SQL can express."""

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWERED.format("text"))

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM bw))),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, s)),
placed AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(placed.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(placed.n, 0) > 0 AS contaminated
FROM d LEFT JOIN placed USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7 = """
WITH e AS (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS score
      FROM p q JOIN p c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""

CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"
CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

# every place in the pattern (empty, s, u, a) keeps its cheapest cost c, audit a and lines r; a row x is applied after insertions
_ADD = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 'r': {0}.r || {3}}}"
_NEXT = "list_min([y[1], y[2], y[4]])"


def _add(state: str, cost: str, edit: str, line: str = "''") -> str:
    return _ADD.format(state, cost, edit, line)


_INSERTED = (f"list_transform([[s[1], s[2], list_min([s[3], {_add('list_min([s[1], s[2], s[4]])', '2', 'I', 'chr(10) || $$user:$$')}]), s[4]]], "
             f"lambda z: [z[1], z[2], z[3], list_min([z[4], {_add('z[3]', '2', 'I', 'chr(10) || $$assistant:$$')}])])[1]")
_LINE = "chr(10) || {} || ':' || x.text"
_STEP = f"""[{_add('y[1]', '3', 'D')},
  list_min([{_add('y[2]', '3', 'D')}, {_add('y[1]', "CASE WHEN NOT x.gone AND x.i = 's' THEN x.cut ELSE 100000000 END", 'K', _LINE.format('x.role'))}]),
  list_min([{_add('y[3]', '3', 'D')}, {_add(_NEXT, "CASE WHEN NOT x.gone AND x.i = 'u' THEN x.cut ELSE 100000000 END", 'K', _LINE.format('x.role'))},
            {_add(_NEXT, 'CASE WHEN NOT x.gone THEN 2 + x.cut ELSE 100000000 END', 'R', _LINE.format("'user'"))}]),
  list_min([{_add('y[4]', '3', 'D')}, {_add('y[3]', "CASE WHEN NOT x.gone AND x.i = 'a' THEN x.cut ELSE 100000000 END", 'K', _LINE.format('x.role'))},
            {_add('y[3]', 'CASE WHEN NOT x.gone THEN 2 + x.cut ELSE 100000000 END', 'R', _LINE.format("'assistant'"))}])]"""
_NOTHING = "{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}"
_NOWHERE = "{'c': CAST(100000000 AS BIGINT), 'a': '', 'r': ''}"

OP11 = f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
           FROM conversations, {CRC_TABLE}),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
             NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank FROM d),
g AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM o),
h AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS trunc FROM g),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
             count(*) FILTER (trunc) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'st': [{_NOTHING}], 'role': role, 'text': text, 'i': role[1], 'gone': blank OR dup, 'cut': CAST(trunc AS BIGINT)}} ORDER BY n) AS rows
      FROM h GROUP BY conv_id),
e AS (SELECT * EXCLUDE (rows), list_reduce([{{'st': [{_NOTHING}, {_NOWHERE}, {_NOWHERE}, {_NOWHERE}], 'role': '', 'text': '', 'i': '', 'gone': false, 'cut': CAST(0 AS BIGINT)}}] || rows,
        lambda q, x: {{'st': list_transform(list_transform([q.st], lambda s: {_INSERTED}), lambda y: {_STEP})[1],
                      'role': '', 'text': '', 'i': '', 'gone': false, 'cut': CAST(0 AS BIGINT)}}).st AS st FROM c),
b AS (SELECT * EXCLUDE (st), list_transform(list_transform([st], lambda s: {_INSERTED}), lambda y: list_min([y[1], y[4]]))[1] AS best FROM e)
SELECT id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS id FROM conversations) a LEFT JOIN b ON id IS NOT DISTINCT FROM b.conv_id
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, sum(a.x * c.x) AS score
      FROM p a JOIN p c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
h AS (SELECT g.anchor_id, g.vec_id AS positive_id, g.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY g.anchor_id, g.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM g JOIN s ON g.anchor_id = s.anchor_id AND NOT s.same WHERE g.n <= 5 AND 30 * g.score <= 100 * s.score AND 100 * s.score <= 90 * g.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score
FROM h WHERE rank <= 10
"""

OP13 = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS b, {CRC.format("coalesce(text, '')")} AS crc, md5(coalesce(source, '')) AS s FROM documents, {CRC_TABLE}),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, b, crc, s) - 1 AS copy FROM d),
h AS (SELECT *, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || b || '|' || crc || '|' || copy) AS h FROM c),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h) - 1 + CAST('0x' || substr(md5('42|' || s), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)
                / count(*) OVER (PARTITION BY s) AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, s, h) - 1 AS p, count(*) OVER () AS n FROM f),
q AS (SELECT *, p * 16 // n AS shard FROM p)
SELECT doc_id, b + 1 AS size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, p - (shard * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""

ORACLES: dict[str, str] = {"op4_decontaminate": OP4, "op7_top_k": OP7, "op11_conversations": OP11, "op12_hard_negatives": OP12, "op13_sharding": OP13}
