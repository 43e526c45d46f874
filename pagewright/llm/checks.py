"""DuckDB SQL the queries are checked against."""

from pagewright.llm import licenses, secret_scan


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""

HISTORY = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest,
                  CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS original FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN f USING (digest)"""

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = r"[^\x20\x09-\x0D]+"

LINKS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 175 * count(*) >= 75 * (any_value(a.n) + any_value(b.n))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.root)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id"""

MIX = rf"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS shuffle FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, rank % 3 + 1 AS weight FROM g),
p AS (SELECT *, row_number() OVER full_ AS place, CAST((SELECT sum(source_size) FROM g)
      - coalesce(sum(3 * source_size) OVER (full_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (full_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW full_ AS (ORDER BY source_size / weight, rank)),
o AS (SELECT min(place) AS first, arg_min(level, place) AS level FROM p WHERE level * weight <= 3 * source_size),
t AS (SELECT p.source, source_size, rank, CASE WHEN place < o.first THEN CAST(3 * source_size AS DOUBLE) ELSE o.level * weight END AS target
      FROM p, o),
q AS (SELECT d.*, source_size, rank, target, CAST(sum(size) OVER (PARTITION BY rank ORDER BY shuffle, doc_id
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, turn, CAST(turn * source_size + upto AS DOUBLE) / target AS finish
      FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0 AND turn < ceil(target / source_size)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, sum(size) AS taken FROM r WHERE spent <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)"""


LINES = r"""
WITH l AS (SELECT doc_id, place, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  e' \t\n\x0b\x0c\r') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, coalesce(keeper <> doc_id, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT f.lang, f.size, f.phrase, f.f AS a, k, string_split(f.phrase, ' ') AS w FROM f, (SELECT unnest([1, 2, 3, 4]) AS k)
      WHERE f.size > 1 AND k < f.size),
s AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, k, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN n ON n.lang = c.lang
      JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(w[1:k], ' ')
      JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(w[k + 1:c.size], ' ')
      QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
t AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = s.lang AND f.size > len(string_split(s.phrase, ' '))
      AND 100 * f.f >= 100 * s.a AND contains(' ' || f.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM t QUALIFY rank <= 2000"""


def _clusters() -> str:
    far = "list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v)"
    steps = []
    for i in range(11):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, vec_id, any_value(v) AS v, arg_min(c, [d, c]) AS c, min(d) AS d
            FROM (SELECT v.*, c.c, {far} AS d FROM v, c{i} c) GROUP BY row, vec_id)""")
        if i < 10:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN
                (SELECT c, list(x ORDER BY place) AS v FROM (SELECT c, place, floor(sum(x) / count(*)) AS x
                 FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY c, place) GROUP BY c) m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < 8),
{", ".join(steps)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia,
       CAST((SELECT sum(cluster_inertia) FROM t) AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c10.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a10 JOIN t USING (c) JOIN c10 USING (c)"""


CLUSTERS = _clusters()


def _secrets() -> str:
    parts = []
    for place, rule in enumerate(secret_scan.RULES):
        p = quoted(rule.pattern)
        parts.append(f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, unnest(regexp_extract_all(t, {p})) AS hit,
            unnest(regexp_extract_all(t, {p}, {rule.group})) AS judged,
            unnest(string_split_regex(t, {p})[1:len(regexp_extract_all(t, {p}))]) AS gap,
            unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i FROM x""")
    return f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM m),
k AS (SELECT doc_id, place, kind, CAST(stop - length(hit) AS BIGINT) AS start, kind || ':' || CAST(stop - length(hit) AS BIGINT)
      || ':' || CAST(stop AS BIGINT) AS span FROM e WHERE length(judged) >= least)
SELECT x.doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place <= 2), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM x LEFT JOIN k USING (doc_id) GROUP BY x.doc_id"""


SECRETS = _secrets()


def _licenses() -> str:
    runs = []
    for number, (label, phrase) in enumerate([*licenses.BASE, *licenses.NOTICES]):
        words, size = phrase.split(), licenses.GRAM
        runs += [f"({number}, '{label}', {str(number < len(licenses.BASE)).lower()}, {len(words)}, {i}, '{' '.join(words[i:i + size])}')"
                 for i in range(len(words) - size + 1)]
    more = licenses.GRAM - 1
    along = "PARTITION BY doc_id, template ORDER BY first, diagonal"
    return rf"""
WITH t(template, label, base, length, place, gram) AS (VALUES {", ".join(runs)}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {more - 1}), lambda i: array_to_string(w[i:i + {more}], ' '))) AS gram,
      unnest(range(0, len(w) - {more})) AS spot FROM w WHERE len(w) > {more}),
v AS (SELECT doc_id, template, spot - place AS diagonal, any_value(label) AS label, any_value(base) AS base, any_value(length) AS length,
      min(spot) AS first, max(spot) AS last, count(*) AS votes FROM g JOIN t USING (gram) GROUP BY doc_id, template, spot - place),
a AS (SELECT *, CASE WHEN base OR lag(last) OVER ({along}) IS NULL OR abs(diagonal - lag(diagonal) OVER ({along})) > {licenses.SHIFT}
      OR first - max(last) OVER ({along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {licenses.GRAM + licenses.REACH}
      THEN 1 ELSE 0 END AS apart FROM v),
b AS (SELECT *, sum(apart) OVER ({along} ROWS UNBOUNDED PRECEDING) AS span FROM a),
s AS (SELECT doc_id, template, span, any_value(label) AS label, any_value(base) AS base, min(first) AS first,
      least(1.0::DOUBLE, CAST(sum(votes + {more}) AS DOUBLE) / any_value(length)) AS share FROM b GROUP BY doc_id, template, span),
k AS (SELECT *, base AND share >= 1.0 AS exact FROM s),
d AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, CAST(min(first) FILTER (exact) AS BIGINT) AS first_word, CAST(max(first) FILTER (exact) AS BIGINT) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR (NOT base AND share >= {licenses.SHARE})) AS labels,
      max(share) AS score FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN d USING (doc_id)"""


LICENSES = _licenses()
