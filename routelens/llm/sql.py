"""DuckDB twins of the ``opN_<name>`` queries that SQL can express.

Not here: toxicity, quality and LM scoring (trained models), packing (a tokenizer and a subset-sum
search), SimHash (XXH64), nearest neighbours (approximate) and chat repair (a dynamic programme); their
tests hold them against brute force or plain versions.
"""

from __future__ import annotations

from routelens.llm.url_filter import DEPTH, RULES

OP4_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '1', doc_id, text)), 1, 15))::BIGINT * 8 AS h
  FROM documents),
b AS (SELECT *, length(bin(size)) * 16 + ((size * 16) >> length(bin(size))) AS bucket FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS position
  FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((position - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS full_size,
         (sum(source_size) OVER ())::DOUBLE AS total FROM s),
f AS (
  SELECT *, coalesce(sum(full_size) OVER (ORDER BY full_size / weight, position
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled,
         sum(weight) OVER (ORDER BY full_size / weight, position
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
t AS (
  SELECT source, source_size, position,
         least(full_size, (max((total - filled) / left_weight) OVER ()) * weight) AS target FROM f),
r AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.position,
         row_number() OVER (PARTITION BY t.position ORDER BY b.bucket, b.h, b.doc_id) - 1 AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         (('0x' || substr(md5(concat_ws('|', '1|offset', t.position)), 1, 3))::BIGINT % 1024 + 0.5) / 1024 AS shift
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rate * (rank + 1) + shift) - floor(rate * rank + shift), ceil(rate)))::BIGINT AS taken
FROM r
"""

OP7_EXACT_DEDUP = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""

_TOKEN = r"""
CASE WHEN regexp_extract(s, '\.([A-Za-z]{1,5})$', 1) <> '' THEN kind(regexp_replace(s, '\.[A-Za-z]{1,5}$', ''))
          || '.' || lower(regexp_extract(s, '\.([A-Za-z]{1,5})$', 1)) ELSE kind(s) END"""
_KIND = r"""
CASE WHEN regexp_matches(x, '^\d{4}-\d{2}(-\d{2})?$') THEN '{date}' WHEN regexp_matches(x, '^\d+$') THEN '{n}'
     WHEN regexp_matches(x, '^[0-9a-fA-F-]{8,}$') THEN '{hex}' WHEN regexp_matches(x, '\d') THEN '{mixed}' ELSE lower(x) END"""


def _token(s: str) -> str:
    """The typed token of a segment, the SQL for its kind put in twice."""
    stem = r"regexp_replace(s, '\.[A-Za-z]{1,5}$', '')"
    body = _TOKEN.replace(f"kind({stem})", _KIND.replace("x,", f"{stem},").replace("lower(x)", f"lower({stem})"))
    return body.replace("kind(s)", _KIND.replace("x,", "s,").replace("lower(x)", "lower(s)")).replace("(s,", f"({s},").replace(
        "lower(s)", f"lower({s})")


def _level(n: int) -> str:
    """One level of the template tree: the branches that the rows of level n - 1 take."""
    return f"""
c{n} AS (SELECT host, template, purity, tokens[{n}] AS token, sum(bad) AS bad, sum(seen) AS seen
         FROM r{n - 1} WHERE len(tokens) >= {n} GROUP BY ALL),
w{n} AS (SELECT host, template, count(*) FILTER (WHERE NOT starts_with(token, '{{')) AS words FROM c{n} GROUP BY ALL),
n{n} AS (SELECT c.*, CASE WHEN words >= 30 AND NOT starts_with(token, '{{') THEN '*' ELSE token END AS name
         FROM c{n} c JOIN w{n} USING (host, template)),
b{n} AS (SELECT host, template, purity, name, sum(bad)::DOUBLE AS b, sum(seen)::DOUBLE AS n FROM n{n} GROUP BY ALL),
z{n} AS (SELECT *, (b / greatest(n, 1) - purity)
                   / sqrt(greatest(purity * (1 - purity), 0.01::DOUBLE) / greatest(n, 1)) AS z FROM b{n}),
s{n} AS (SELECT *, CASE WHEN n = 0 THEN 'unlabelled' WHEN z > 1.0 THEN 'worse' WHEN z < -1.0 THEN 'better'
                        ELSE 'alike' END AS side FROM z{n}),
m{n} AS (SELECT host, template, side, sum(b) AS mb, sum(n) AS mn FROM s{n} GROUP BY ALL),
t{n} AS (SELECT host, template, name, template || '/' || side AS next, (mb + 4.0::DOUBLE * purity) / (mn + 4.0::DOUBLE) AS next_purity
         FROM s{n} JOIN m{n} USING (host, template, side)),
k{n} AS (SELECT host, template, token, next, next_purity FROM n{n} JOIN t{n} USING (host, template, name)),
r{n} AS (SELECT r.host, r.tokens, r.bad, r.seen, coalesce(k.next, r.template) AS template,
                coalesce(k.next_purity, r.purity) AS purity
         FROM r{n - 1} r LEFT JOIN k{n} k ON k.host = r.host AND k.template = r.template AND k.token = r.tokens[{n}])"""


def _fits(host: str, prefix: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{prefix}')"


_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP10_URL_FILTER = rf"""
WITH u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS mark, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, CASE WHEN mark > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
             CASE WHEN mark > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
f AS (SELECT *, CASE {' '.join(f"WHEN {_fits(h, x)} THEN '{h}{x}'" for h, x, _ in _LONGEST_FIRST)} END AS rule,
             CASE {' '.join(f"WHEN {_fits(h, x)} THEN '{v}'" for h, x, v in _LONGEST_FIRST)} END AS ruled,
             list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {_token('s')})[1:4] AS tokens FROM p),
shapes AS (SELECT host, tokens, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) FILTER (WHERE rule IS NOT NULL) AS seen
           FROM f GROUP BY ALL),
base AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(seen), 0) + 1.0::DOUBLE) AS base FROM shapes),
hosts AS (SELECT host, (sum(bad) + 4.0::DOUBLE * any_value(base)) / (sum(seen) + 4.0::DOUBLE) AS p0 FROM shapes, base GROUP BY host),
r0 AS (SELECT host, tokens, bad, seen, '' AS template, p0 AS purity FROM shapes JOIN hosts USING (host)),
{','.join(_level(n) for n in range(1, DEPTH + 1))}
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.ruled, CASE WHEN r.purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       r.template, r.purity
FROM f JOIN r{DEPTH} r ON r.host = f.host AND r.tokens = f.tokens
"""

_SPACE = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

OP11_LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, row, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id, row
"""



def _round(n: int) -> str:
    """Round n of the clustering: vectors to their nearest centroid of round n - 1, then new centroids."""
    return f"""
a{n} AS (SELECT row, min(struct_pack(d := {_squared}, c := cluster)) AS best FROM v, c{n - 1} GROUP BY row),
s{n} AS (SELECT best.c AS cluster, j, sum(x[j])::HUGEINT AS s, count(*)::HUGEINT AS n
         FROM a{n} JOIN v USING (row), range(1, 65) t(j) GROUP BY ALL),
m{n} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS moved FROM s{n} GROUP BY cluster),
c{n} AS (SELECT cluster, coalesce(moved, c) AS c FROM c{n - 1} LEFT JOIN m{n} USING (cluster))"""


_squared = "list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT"

OP12_CENTROIDS = rf"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster, x AS c FROM v
  QUALIFY cluster < 16),
{','.join(_round(n).replace(' AS (SELECT', ' AS MATERIALIZED (SELECT') for n in (1, 2, 3))},
f AS MATERIALIZED (SELECT row, min(struct_pack(d := {_squared}, c := cluster)) AS best FROM v, c3 GROUP BY row)
SELECT vec_id, best.c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM f JOIN v USING (row) JOIN c3 ON c3.cluster = best.c
"""

OP13_HARD_NEGATIVES = r"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op4_mix": OP4_MIX, "op7_exact_dedup": OP7_EXACT_DEDUP, "op10_url_filter": OP10_URL_FILTER,
                              "op11_line_dedup": OP11_LINE_DEDUP, "op12_centroids": OP12_CENTROIDS, "op13_hard_negatives": OP13_HARD_NEGATIVES}
