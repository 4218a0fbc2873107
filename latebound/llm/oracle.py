"""DuckDB SQL for the queries that SQL can express over whole tables.

The others have none: fingerprints (op4) and the seeded choice of blocks (op9)
use hashes that DuckDB lacks; trained spans and scores (op2, op12), token ids (op6,
op7, op10), the packing search (op10) and eigenvectors (op11) are no SQL. Tests hold
those against brute force or held-out rows.
"""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, SYMBOLS

_SPACE = r"\x20\x09-\x0D"

_WORDS = rf"""
words AS (SELECT doc_id, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS ws FROM documents)"""


def _rule(r) -> str:
    bounds = ([f"({r.ratio}) >= {r.least}"] if r.least is not None else []) + (
        [f"({r.ratio}) <= {r.most}"] if r.most is not None else [])
    return f"coalesce({' AND '.join(bounds)}, TRUE)"


def _stop_counts() -> str:
    split = rf"string_split_regex(lower(t), '[{_SPACE}.,;:!?]+')"
    return " ".join(f"""WHEN '{code}' THEN CAST(len(list_filter({split},
         lambda x: list_contains([{', '.join(repr(w) for w in listed)}], x))) AS BIGINT)""" for code, listed in STOP_WORDS.items())


QUALITY = rf"""
WITH {_WORDS},
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM words),
counts AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CASE lower(regexp_extract(d.lang, '^[A-Za-z]+')) {_stop_counts()} END AS n_stop_words
  FROM words w JOIN documents d ON d.doc_id = w.doc_id JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND {' AND '.join(_rule(r) for r in RULES)} AS kept FROM judged"""

_PHRASE_WINDOW = 13

PHRASES = f"""
WITH {_WORDS},
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {_PHRASE_WINDOW - 1}], ' ') AS w
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_PHRASE_WINDOW - 2})) AS i FROM words)),
owned AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {_PHRASE_WINDOW})) AS p FROM owned)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words) x
         LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

_PASSAGE = 50

PASSAGES = f"""
WITH {_WORDS},
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {_PASSAGE - 1}], ' ') AS w
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_PASSAGE - 2})) AS i FROM words)),
twice AS (SELECT doc_id, i - 1 AS a FROM (SELECT *, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
breaks AS (SELECT *, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + {_PASSAGE} THEN 0 ELSE 1 END AS fresh FROM twice),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM breaks),
spans AS (SELECT doc_id, min(a) AS a, max(a) + {_PASSAGE} AS b FROM runs GROUP BY doc_id, run),
joined AS (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(j.n, 0) AS BIGINT) AS n_repeated,
       coalesce(j.spans, '') AS spans
FROM words w LEFT JOIN joined j ON j.doc_id = w.doc_id"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM sound UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comps AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN comps c ON c.a = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id"""

_CLUSTERS, _ROUNDS = 16, 3


def _assigned(r: int) -> str:
    """Each vector's nearest centroid of round ``r``."""
    return f"""
a{r} AS (SELECT * FROM (
  SELECT k.vec_id, k.x, c.j, c.c, k.row,
         CAST(list_sum(list_transform(list_zip(k.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d,
         row_number() OVER (PARTITION BY k.row ORDER BY d, c.j) AS place
  FROM kept k, c{r} c) WHERE place = 1)"""


def _moved(r: int) -> str:
    """The centroids after round ``r``."""
    return f"""
s{r} AS (SELECT j, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
         FROM (SELECT j, unnest(x) AS v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY j, i),
m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r + 1} AS (SELECT c{r}.j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.j = c{r}.j)"""


CLUSTERS = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x,
         row_number() OVER () AS row
  FROM embeddings WHERE len(embedding) = 64
    AND list_sum(list_transform(embedding, lambda e: CASE WHEN e IS NULL OR NOT isfinite(e) THEN 1 ELSE 0 END)) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS j, x AS c
       FROM kept QUALIFY j < {_CLUSTERS}),{','.join(_assigned(r) + ',' + _moved(r) for r in range(_ROUNDS))},{_assigned(_ROUNDS)}
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{_ROUNDS}"""

ORACLE_SQL: dict[str, str] = {
    "op1_nn_descent": VECTORS,
    "op3_quality_rules": QUALITY,
    "op5_suffix_dedup": PASSAGES,
    "op8_phrase_dedup": PHRASES,
    "op13_pivot_clusters": CLUSTERS,
}
