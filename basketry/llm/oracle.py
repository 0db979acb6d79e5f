"""DuckDB SQL for the queries that SQL can follow: brute force over the whole tables, for small ones."""

from __future__ import annotations

from basketry.llm import licenses

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_scan() -> str:
    """op2: every phrase looked for at every word; shares by the document frequencies of the phrases' words."""
    phrases = [(label, k, p) for label, p in licenses.BASE.items() for k in (0,)]
    phrases += [(label, k, p) for label, ps in licenses.TEMPLATES.items() for k, p in enumerate(ps)]
    values = ",\n  ".join(f"('{label}', {k}, '{p}', {str(label in licenses.BASE).lower()})" for label, k, p in phrases)
    return f"""WITH phrases(label, k, phrase, base) AS (VALUES
  {values}),
parts AS (SELECT *, string_split(phrase, ' ') AS ws FROM phrases),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(c='text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
vocabulary AS (SELECT DISTINCT unnest(ws) AS word FROM parts),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS word FROM docs) s WHERE word IN (SELECT word FROM vocabulary) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM docs) + 1) / (coalesce(n, 0) + 1)) + 1e-6 AS v FROM vocabulary LEFT JOIN df USING (word)),
weights AS (SELECT label, k, phrase, base, ws, sum(v) AS weight FROM (SELECT label, k, phrase, base, ws, unnest(ws) AS word FROM parts) p JOIN idf USING (word) GROUP BY ALL),
places AS (SELECT r, label, k, base, weight, CASE WHEN list_has_all(w, ws) THEN list_filter(range(len(w) - len(ws) + 1), lambda i: w[i + 1:i + len(ws)] = ws) ELSE [] END AS spots FROM docs, weights),
shares AS (SELECT r, label, base, bool_and(len(spots) > 0) AS whole,
  CASE WHEN bool_and(len(spots) > 0) THEN 1.0 WHEN base THEN 0.0 ELSE sum(CASE WHEN len(spots) > 0 THEN weight ELSE 0 END) / sum(weight) END AS share
  FROM places GROUP BY r, label, base),
base_at AS (SELECT r, flatten(list(spots)) AS spots FROM places WHERE base GROUP BY r),
named AS (SELECT r, coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE whole AND base), '') AS base_labels,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (WHERE whole), '') AS labels, max(share) AS score FROM shares GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, list_min(spots) AS first_word, list_max(spots) AS last_word, base_labels, labels,
  round(score, 9) AS score FROM docs JOIN base_at USING (r) JOIN named USING (r)"""


EMBEDDING_LINKS = """WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON id = vec_id"""

NGRAM_JOIN = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
often AS (SELECT g, count(*) AS n FROM grams GROUP BY g HAVING count(*) > 1),
ranked AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(n, 1), g) AS r FROM grams LEFT JOIN often USING (g)),
prefix AS (SELECT doc_id, g, len(s) AS size FROM ranked JOIN sets USING (doc_id) WHERE n IS NOT NULL AND r <= len(s) - ceil(len(s) * 9 / 10.0) + 1),
candidates AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.size, b.size) * 10 >= greatest(a.size, b.size) * 9),
common AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS c, len(x.s) AS na, len(y.s) AS nb FROM candidates JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON id = doc_id"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII or UTF-8 string expression, bit by bit."""
    octets = f"list_transform(range(0, CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2)) AS BIGINT))"
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda a, b: {step}), 4294967295)"


PREFIX_TRIE = f"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS p,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_crc32('CAST(c AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT c FROM own) x),
turns AS (SELECT convs.c, 0 AS late, p, role, text FROM convs JOIN own ON own.c = convs.c - convs.c % 5 AND p < h
  UNION ALL SELECT convs.c, 1, p, role, text FROM convs JOIN own ON own.c = convs.c AND p >= h),
ranked AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY late, p) AS d FROM turns),
steps AS (SELECT c, d, strlen(text) AS bytes, md5(concat(strlen(role), ':', role, text)) AS t FROM ranked),
paths AS (SELECT c, d, bytes, string_agg(t, '') OVER (PARTITION BY c ORDER BY d) AS path FROM steps
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM paths JOIN lengths USING (c) GROUP BY path, d),
family AS (SELECT node.path, parent.conv_id AS parent_conv_id, parent.path AS above FROM nodes node LEFT JOIN nodes parent ON node.depth > 0 AND parent.path = substr(node.path, 1, CAST(32 * (node.depth - 1) AS INT))),
children AS (SELECT above AS path, count(*) AS n_children FROM family WHERE above IS NOT NULL GROUP BY above),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens FROM whole a JOIN (SELECT *, unnest(range(0, depth + 1)) AS k FROM whole) b
  ON a.depth = b.k AND a.path = substr(b.path, 1, CAST(32 * b.k AS INT)) GROUP BY a.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM whole JOIN family USING (path) JOIN sums USING (path)"""

SPELLING = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER.format(c='text')}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, {_crc32("concat(id, ':', run)")} AS h FROM runs WHERE length(run) >= 7),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) + 2 AS INT)) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
without AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) s),
pairs AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
best AS (SELECT near.word, n_near, m, min(other) AS other FROM near JOIN pairs USING (word, m) GROUP BY ALL),
told AS (SELECT words.word, CASE WHEN m >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM told UNION SELECT follow.word, told.form FROM follow JOIN told ON told.word = follow.root AND told.form IS NOT NULL),
last AS (SELECT follow.word, root FROM follow JOIN told ON told.word = root AND told.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM told JOIN last USING (word)"""
