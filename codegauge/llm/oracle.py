"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from codegauge.llm.licenses import PHRASES, TEMPLATES, parts
from codegauge.llm.sharding import LIMIT_BYTES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP7 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, item, n, p FROM dw JOIN iw USING (n, s)),
word AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN found USING (r)"""


def _template_regex(template: str) -> str:
    """The template over words that each follow a blank."""
    return "".join({"(": "(?:", ")": ")?"}.get(p) or (f"(?: [^ ]+){{0,{p}}}" if isinstance(p, int) else f"(?: {p})")
                   for p in parts(template)) + " "


def licenses_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> str:
    phrase_rows = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in phrases)
    template_rows = ", ".join(f"('{label}', '{_template_regex(t)}')" for label, t in templates)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
phrase(p, label, n) AS (VALUES {phrase_rows}),
template(label, pattern) AS (VALUES {template_rows}),
place AS (SELECT r, q - 1 AS place_at, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS q FROM d) JOIN phrase
          ON array_to_string(w[q : q + n - 1], ' ') = p),
base AS (SELECT r, count(*) AS n_base, min(place_at) AS first_word, max(place_at) AS last_word FROM place GROUP BY r),
own AS (SELECT r, label FROM (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d) JOIN template
        ON regexp_matches(s, pattern)),
base_label AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
label AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT r, label FROM place UNION SELECT r, label FROM own) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN r IN (SELECT r FROM own) THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN base_label USING (r) LEFT JOIN label USING (r)"""



def near_duplicates_sql(shingle: int, percent: int) -> str:
    """Links by counting common shingles, components by following links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p : p + {shingle} - 1], ' ') AS s
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {shingle} + 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(r, q) AS (SELECT a, b FROM sides UNION SELECT reach.r, sides.b FROM reach JOIN sides ON reach.q = sides.a),
c AS (SELECT reach.r, min(d.doc_id) AS c FROM reach JOIN d ON d.r = q GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id,
       doc_id IS NOT DISTINCT FROM coalesce(least(c, doc_id), doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)"""



def shards_sql(limit: int) -> str:
    """The depth of a row: one more than its deepest prefix that is too large and holds two hashes."""
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT r, h, b, k, h >> (60 - k) AS x FROM d, (SELECT unnest(range(0, 61)) AS k)),
f AS (SELECT k, x FROM p GROUP BY k, x HAVING sum(b) > {limit} AND min(h) < max(h)),
e AS (SELECT d.r, d.doc_id, d.b, d.h, coalesce(max(f.k) + 1, 0) AS depth
      FROM d JOIN p ON p.r = d.r LEFT JOIN f ON f.k = p.k AND f.x = p.x GROUP BY ALL),
s AS (SELECT *, lpad(bin(h >> (60 - depth)), CAST(depth AS INTEGER), '0') AS shard FROM e)
SELECT doc_id, b AS bytes, shard, CAST(depth AS BIGINT) AS depth, '0' AS page, CAST(sum(b) OVER w AS BIGINT) AS shard_bytes,
       count(*) OVER w AS shard_rows, b > {limit} AS oversize
FROM s WINDOW w AS (PARTITION BY shard)"""



_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


_OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p : p + 19], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
again AS (SELECT r, p FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY r, p) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS q FROM again),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)"""


ORACLE = {
    "op1_top_k": _OP1,
    "op2_near_duplicates": near_duplicates_sql(2, 80),
    "op3_hash_shards": shards_sql(LIMIT_BYTES),
    "op4_license_scan": licenses_sql(),
    "op7_decontaminate": _OP7,
    "op13_substring_dedup": _OP13,
}
