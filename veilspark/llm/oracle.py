"""The queries of this package that SQL can express, for another engine to check."""

from __future__ import annotations

from .chat import END, START
from .license_rules import parse
from .licenses import BASE, BASE_LEVEL, CONFIDENCE, LOWER, UPPER
from .queries import PROBE

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), escaped AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS safe FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{START}') + length(role) + 1 + length(safe) + {len(END)})::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

WARC = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT digest, min(page_id) AS first FROM payloads WHERE octet_length(body) >= 100 GROUP BY digest
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.digest = f.digest AND octet_length(body) >= 100
"""

SUBSTRINGS = r"""
WITH lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 19) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM lists WHERE len(w) >= 20)
), marked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS later FROM windows
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM marked WHERE later)
), words AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM lists)
), kept AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS text, count(*) AS n
  FROM words k ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id
)
SELECT l.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM lists l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""



SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY term, docs
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def _clusters(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every round as two more tables: assignments, then floors of the means."""
    assign = """
a{r} AS MATERIALIZED (
  SELECT vec_id, row, v, min(d) AS distance, arg_min(c, d * 1000 + c)::INT AS cluster
  FROM (
    SELECT vec_id, row, v, c, list_sum(list_transform(range(1, {dims} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d
    FROM kept, c{r}
  ) GROUP BY vec_id, row, v
)"""
    update = """
s{r} AS (
  SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{p}, range(1, {dims} + 1) t(i) GROUP BY ALL
), c{r} AS MATERIALIZED (
  SELECT c, coalesce(any_value(g.m), any_value(o.m)) AS m FROM c{p} o LEFT JOIN (
    SELECT cluster, list(floor_div ORDER BY i) AS m FROM (
      SELECT cluster, i, CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS floor_div FROM s{r}
    ) GROUP BY cluster
  ) g ON o.c = g.cluster GROUP BY c
)"""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c, v AS m FROM kept
  QUALIFY c < {k}
)"""]
    for r in range(rounds + 1):
        if r:
            parts.append(update.format(r=r, p=r - 1, dims=dims))
        parts.append(assign.format(r=r, dims=dims))
    last = f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, array_to_string(m, ',') AS centroid, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = c"""
    return ",".join(parts) + last


def _licenses() -> str:
    """Every rule on every text, without gates; what another detection holds is joined away."""

    def hits(pattern: str, level: int, no: int, label: str) -> str:
        return (
            f"SELECT doc_id, {no} AS no, {level} AS level, '{label}' AS label, "
            f"unnest(regexp_extract_all(t, '{pattern}')) AS m FROM texts"
        )

    phrases = {
        label: " [0-9]+:" + "  [0-9]+:".join(p.split(" ")) + " " for label, p in BASE.items()
    }
    found = " UNION ALL ".join(hits(r.pattern, r.level, r.no, r.label) for r in parse())
    base = " UNION ALL ".join(hits(p, BASE_LEVEL, 0, label) for label, p in phrases.items())
    return f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), texts AS MATERIALIZED (
  SELECT doc_id, array_to_string(list_transform(w, lambda x, i: ' ' || (i - 1) || ':' || x || ' '), '') AS t FROM words
), found AS MATERIALIZED (
  SELECT *, regexp_extract(m, '^ ([0-9]+):', 1)::INT AS a, regexp_extract(m, '([0-9]+):[^ ]* $', 1)::INT AS z
  FROM ({found})
), kept AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.a <= f.a AND o.z >= f.z AND o.level <= f.level
      AND (o.a < f.a OR o.z > f.z OR o.level < f.level OR o.no < f.no))
), base AS (
  SELECT doc_id, label, regexp_extract(m, '^ ([0-9]+):', 1)::BIGINT AS a FROM ({base})
), places AS (
  SELECT doc_id, count(*) AS n, min(a) AS first_word, max(a) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
), labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, min(level) AS level
  FROM (SELECT doc_id, label, level FROM kept UNION ALL SELECT doc_id, label, {BASE_LEVEL} FROM base) GROUP BY doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce({list(CONFIDENCE)}[level], 0)::DOUBLE AS score
FROM words w LEFT JOIN places p ON w.doc_id = p.doc_id LEFT JOIN labels l ON w.doc_id = l.doc_id
"""


def oracle() -> dict[str, str]:
    return {
        "op4_chat": CHAT,
        "op7_warc": WARC,
        "op8_substrings": SUBSTRINGS,
        "op11_licenses": _licenses(),
        "op12_search": SEARCH,
        "op13_centroids": _clusters(),
    }
