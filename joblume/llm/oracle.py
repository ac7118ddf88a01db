"""The corpus operators that SQL can express, in DuckDB SQL, from their rules alone."""

from __future__ import annotations

_BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_BLANKS}'), lambda w: w <> '')"


def _repeats(units: str, same: str, length: int, joiner: str, size: str) -> str:
    """Units of documents, without those in a window of ``length`` whose sequence starts earlier."""
    return f"""
WITH d AS (SELECT doc_id, {units} AS u FROM documents),
placed AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS p FROM d),
alike AS (SELECT doc_id, p, unit, {same} AS same FROM placed),
windows AS (SELECT doc_id, p, list(same) OVER w AS x, count(*) OVER w AS n FROM alike
            WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)),
again AS (SELECT doc_id, p FROM windows WHERE n = {length}
          QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM again, range({length}) r(k)),
kept AS (SELECT doc_id, string_agg(unit, {joiner} ORDER BY p) AS t FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT d.doc_id, CAST(len(u) AS BIGINT) AS {size}, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""


# a break at the very end begins no further line
_LINES = """(CASE WHEN coalesce(text, '') = '' THEN [] WHEN ends_with(text, chr(10))
    THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END)"""

LINE_DEDUP = _repeats(_LINES, "trim(unit, ' ' || chr(9) || chr(13))", 3, "chr(10)", "n_lines")
SUBSTRING_DEDUP = _repeats(_words("coalesce(text, '')"), "unit", 20, "' '", "n_words")

_COMPONENTS = """
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
    AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(b, vec_id)) AS kept FROM embeddings LEFT JOIN least_of ON a = vec_id"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = doc_id"""
