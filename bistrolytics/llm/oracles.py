"""SQL equivalents of the registered queries, where SQL can express them.

Not here: token files, token counts and byte-level BPE (tokenizers), quality rules and language
(compression), the classifier and the pipeline (training); their tests compare with plain versions.
"""

from __future__ import annotations

from .licenses import RULES, sentence_table, sentences

ORACLES: dict[str, str] = {}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_repeats"] = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(text="text")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
wins AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS passage FROM starts),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

_ALNUM = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
tests AS (
  SELECT item_id, j, n, array_to_string(w[j:j+n-1], ' ') AS passage
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS j FROM items WHERE len(w) > 0)),
starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM tests) WHERE len(w) >= n),
hits AS (
  SELECT doc_id, i, s.n, item_id, j
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS passage FROM starts) s JOIN tests t ON t.n = s.n AND t.passage = s.passage),
hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY 1),
runs AS (
  SELECT doc_id, max(length) AS longest FROM (
    SELECT doc_id, n + count(*) - 1 AS length FROM (
      SELECT doc_id, n, item_id, i - j AS line, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS run FROM hits)
    GROUP BY doc_id, item_id, n, line, run) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN runs USING (doc_id)"""

ORACLES["op7_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(text=_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""


_TABLE = sentence_table()
_KNOWN = ", ".join(f"'{s}'" for s in _TABLE)
_PATTERNS = ", ".join(
    f"('{name}', '|{'|'.join(str(_TABLE[s]) for s in sentences(text))}|')" for name, text in RULES
)
ORACLES["op4_license_scan"] = rf"""
WITH k AS (SELECT [{_KNOWN}] AS known),
rules(name, pattern) AS (VALUES {_PATTERNS}),
cut AS (
  SELECT doc_id, list_filter(list_transform(
      string_split_regex(coalesce(text, ''), '[.;:!?]+[ \t\r\n]+|[\r\n]+|[.;:!?]+$'),
      lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents),
placed AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(0, len(p))) AS place FROM cut),
found AS (SELECT doc_id, place, list_position(known, sentence) AS id FROM placed, k WHERE list_contains(known, sentence)),
marked AS (
  SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) > 2 THEN '|/|' ELSE '|' END AS mark FROM found),
lines AS (
  SELECT doc_id, string_agg(mark || id, '' ORDER BY place) || '|' AS line, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids
  FROM marked GROUP BY 1),
named AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, count(*) AS n
  FROM (SELECT DISTINCT doc_id, name FROM lines JOIN rules ON contains(line, pattern)) GROUP BY 1)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_licenses
FROM cut LEFT JOIN lines USING (doc_id) LEFT JOIN named USING (doc_id)"""


_FAILS = {
    "A": "len(w) < 50",
    "B": "100 * len(list_distinct(w)) < 65 * len(w)",
    "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')",
    "E": "coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)",
}
ORACLES["op11_filter_audit"] = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_PLAIN.format(text="text")} AS w FROM documents),
said AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
fails AS (SELECT doc_id, part, {", ".join(f"{test} AS {name}" for name, test in _FAILS.items())} FROM texts),
docs AS (
  SELECT part, concat({", ".join(f"if({name}, '{name}', '')" for name in _FAILS)}) AS failed,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM fails LEFT JOIN said USING (doc_id)),
kinds AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS goods, count(*) FILTER (WHERE toxic) AS toxics FROM docs GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders(filter_order) AS (
  SELECT letter FROM letters
  UNION ALL SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step-1] AS earlier, filter_order[1:step] AS upto
  FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
audit AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE translate(failed, upto, '') = failed), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE translate(failed, earlier, '') = failed AND contains(failed, own)), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE translate(failed, earlier, '') <> failed AND contains(failed, own)), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE failed = own), 0) AS unique_fails,
         coalesce(sum(goods) FILTER (WHERE translate(failed, earlier, '') = failed AND contains(failed, own)), 0) AS good_lost,
         coalesce(sum(toxics) FILTER (WHERE translate(failed, earlier, '') = failed AND contains(failed, own)), 0) AS toxic_lost
  FROM kinds, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audit"""

_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)"
ORACLES["op12_topk_scan"] = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row_key, {_WHOLE} AS x FROM embeddings WHERE {_USABLE}),
scored AS (
  SELECT q.row_key, q.vec_id AS query_id, c.vec_id, CAST({_DOT.format(a="q.x", b="c.x")} AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5"""

_APART = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _assigned(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT row_key, vec_id, x, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT v.*, cluster, {_APART} AS d FROM v, c{k}) GROUP BY 1, 2, 3)"""


def _moved(k: int) -> str:
    """A floor of sums: an integer division that goes down, also below 0."""
    return f"""
m{k} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT cluster, i, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY 1, 2)
  GROUP BY 1),
c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""


ORACLES["op13_heap_means"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row_key, {_WHOLE} AS x FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INTEGER) AS cluster, x AS c FROM v WHERE vec_id IS NOT NULL
  QUALIFY cluster < 40),
{",".join(_assigned(k) + "," + _moved(k) for k in range(5))},
{_assigned(5)},
named AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c5)
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 JOIN named USING (cluster)"""
