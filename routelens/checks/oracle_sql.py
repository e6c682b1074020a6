"""DuckDB twins of the registered queries (the correctness oracle).

Each string runs on DuckDB against the pre-registered parquet views.  Where
possible the SQL uses a different formulation from the Spark job (windows
instead of array folds, brute-force pairs instead of block products).
"""

from __future__ import annotations

from decimal import Decimal

from routelens.constants import (CASCADE_BUDGETS, CASCADE_ERROR_RATES, KNN_NEIGHBORS, WTP_GRID,
                                 WTP_TEXT)

ORACLE_SQL: dict[str, str] = {}


def _dbl(x: float) -> str:
    return f"{x!r}::DOUBLE"


WTP_VALUES_SQL = ", ".join(f"({i}, {_dbl(x)}, '{t}')" for i, (x, t) in enumerate(zip(WTP_GRID, WTP_TEXT)))

NTOK = "len(regexp_extract_all({0}, '\\S+'))"


def ntok(expr: str) -> str:
    return NTOK.format(expr)


EVAL_LONG = f"""
eval_base AS (
  SELECT d.doc_id, d.text, d.lang, d.source, r.range AS m,
         ('0x' || substr(md5(d.doc_id::VARCHAR || '|' || r.range::VARCHAR), 1, 8))::BIGINT::DOUBLE
           / 4294967296.0::DOUBLE AS u,
         array_to_string(list_filter(regexp_extract_all(d.text, '\\S+'), lambda w, i: (i - 1) % 5 <= r.range), ' ') AS resp
  FROM documents d CROSS JOIN range(5) r
),
eval_long AS (
  SELECT doc_id,
         lang || '.' || source || '.' || doc_id::VARCHAR AS sample_id,
         lang || '-' || source AS eval_name,
         lang AS family, source,
         [text] AS prompt,
         'm' || m::VARCHAR AS model, m::INTEGER AS model_idx,
         CASE WHEN (doc_id + m) % 97 = 0 THEN NULL
              WHEN u < 0.15::DOUBLE + 0.12::DOUBLE * m THEN 1.0::DOUBLE
              WHEN u < 0.20::DOUBLE + 0.12::DOUBLE * m THEN 0.5::DOUBLE
              ELSE 0.0::DOUBLE END AS performance,
         [resp] AS response,
         ({ntok('text')} * 100000 * (m + 1) + {ntok('resp')} * 200000 * (m + 1)
           + CASE WHEN m = 4 THEN 5000000000 ELSE 0 END)::BIGINT AS cost_pico
  FROM eval_base
),
model_price AS (
  SELECT 'm' || range::VARCHAR AS model, (100000 * (range + 1))::BIGINT AS prompt_pico,
         (200000 * (range + 1))::BIGINT AS completion_pico,
         CASE WHEN range = 4 THEN 5000000000 END::BIGINT AS request_pico
  FROM range(5)
),
oracle_lab AS (
  SELECT sample_id, eval_name,
         CASE WHEN mx > 0 THEN model ELSE 'no_model_correct' END AS oracle,
         CASE WHEN mx > 0 THEN performance ELSE 0.0::DOUBLE END AS oracle_performance,
         CASE WHEN mx > 0 THEN cost_pico ELSE 0 END::BIGINT AS oracle_cost_pico
  FROM (SELECT *, max(performance) OVER (PARTITION BY sample_id) AS mx,
               row_number() OVER (PARTITION BY sample_id
                                  ORDER BY performance DESC NULLS LAST, cost_pico, model_idx) AS rn
        FROM eval_long)
  WHERE rn = 1
)
"""


def with_fixtures(body: str, extra: str = "") -> str:
    ctes = EVAL_LONG.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"


def sql(name: str, body: str, extra: str = "") -> None:
    ORACLE_SQL[name] = with_fixtures(body, extra)


sql("q_token_cost", f"""
SELECT e.sample_id, e.model,
       ((SELECT sum({ntok('x')}) FROM unnest(e.prompt) t(x)) * p.prompt_pico
        + (SELECT sum({ntok('x')}) FROM unnest(e.response) t(x)) * p.completion_pico
        + coalesce(p.request_pico, 0))::BIGINT AS cost_pico
FROM eval_long e JOIN model_price p USING (model)
""")

_PIECES = "len(regexp_extract_all(x, '[0-9A-Za-z]+|[^ \\t\\n\\x0b\\f\\r0-9A-Za-z]'))"
_OWN = f"sum(CASE WHEN e.model IN ('m1', 'm3') THEN {_PIECES} ELSE {ntok('x')} END)"

sql("q_token_cost_plugin", f"""
SELECT e.sample_id, e.model,
       ((SELECT {_OWN} FROM unnest(e.prompt) t(x)) * p.prompt_pico
        + (SELECT {_OWN} FROM unnest(e.response) t(x)) * p.completion_pico
        + coalesce(p.request_pico, 0))::BIGINT AS cost_pico
FROM eval_long e JOIN model_price p USING (model)
""")

ORACLE_SQL["q_token_count"] = f"SELECT doc_id, {ntok('text')}::BIGINT AS n_tokens FROM documents"

sql("q_oracle_label", """
SELECT sample_id, eval_name, oracle, round(oracle_performance, 6) AS oracle_performance, oracle_cost_pico
FROM oracle_lab
""")

sql("q_oracle_scores", """
SELECT eval_name, 'oracle' AS model, round(avg(oracle_performance), 6) AS performance,
       sum(oracle_cost_pico)::BIGINT AS total_cost_pico
FROM oracle_lab GROUP BY eval_name
""")

sql("q_eval_scores", """
SELECT eval_name, model, round(avg(coalesce(performance, 0.0::DOUBLE)), 6) AS performance,
       sum(cost_pico)::BIGINT AS total_cost_pico
FROM eval_long GROUP BY eval_name, model
UNION ALL
SELECT eval_name, 'oracle' AS model, round(avg(oracle_performance), 6) AS performance,
       sum(oracle_cost_pico)::BIGINT AS total_cost_pico
FROM oracle_lab GROUP BY eval_name
""")

sql("q_fill_performance", """
SELECT e.sample_id, e.model, coalesce(e.performance, 0.0::DOUBLE) AS performance, o.oracle
FROM eval_long e JOIN oracle_lab o USING (sample_id)
""")

sql("q_response_length", f"""
SELECT model, round(avg({ntok('response[1]')}), 6) AS avg_response_tokens FROM eval_long GROUP BY model
""")

# ---------------------------------------------------------------- ingest

_W = ",\n".join(f"round(avg(performance) FILTER (WHERE model = 'm{i}'), 6) AS m{i}_perf, "
                f"min(cost_pico) FILTER (WHERE model = 'm{i}') AS m{i}_cost" for i in range(5))
sql("q_to_wide", f"SELECT sample_id, eval_name, {_W} FROM eval_long GROUP BY sample_id, eval_name")

sql("q_to_long", """
SELECT sample_id, eval_name, model, avg(performance) AS performance, min(cost_pico) AS cost_pico
FROM eval_long GROUP BY sample_id, eval_name, model
""")

sql("q_complete_samples", """
SELECT sample_id, model, performance, cost_pico FROM eval_long
WHERE sample_id NOT IN (SELECT sample_id FROM eval_long WHERE performance IS NULL)
""")

sql("q_eval_family", """
SELECT eval_name, count(*) AS n_rows, round(avg(performance), 6) AS performance
FROM eval_long WHERE starts_with(eval_name, 'en') GROUP BY eval_name
""")

sql("q_eval_from_id", """
SELECT sample_id, model, split_part(sample_id, '.', 1) AS eval_family FROM eval_long
""")

sql("q_models", "SELECT model, min(model_idx) AS model_idx FROM eval_long GROUP BY model")

sql("q_dedupe_first", """
SELECT sample_id, model, performance FROM (
  SELECT *, row_number() OVER (PARTITION BY model, prompt ORDER BY doc_id) AS rn FROM eval_long)
WHERE rn = 1
""")

ORACLE_SQL["q_choice_score"] = """
SELECT doc_id, choice,
       CASE WHEN choice = '__invalid__' THEN NULL
            ELSE 1.0::DOUBLE - (ascii(choice) - 65)::DOUBLE / 4.0::DOUBLE END AS score
FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '__invalid__' ELSE chr((65 + doc_id % 5)::INTEGER) END AS choice
      FROM documents)
"""

ORACLE_SQL["q_metric_select"] = """
SELECT doc_id, round(CASE doc_id % 4
    WHEN 0 THEN quality::DOUBLE
    WHEN 1 THEN quality::DOUBLE * 0.5::DOUBLE
    WHEN 2 THEN ((doc_id * 7) % 101)::DOUBLE / 100.0::DOUBLE
    ELSE 1.0::DOUBLE - (ascii(chr((65 + doc_id % 5)::INTEGER)) - 65)::DOUBLE / 4.0::DOUBLE END, 6) AS value
FROM labels
"""

ORACLE_SQL["q_select_prompts"] = """
WITH firsts AS (
  SELECT conv_id, text, min(turn) AS t FROM conversations WHERE role <> 'assistant' GROUP BY conv_id, text),
d AS (SELECT conv_id, list(text ORDER BY t) AS d FROM firsts GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN len(d) = 1 THEN d
                           WHEN len(d) = 4 THEN [d[1], d[3]]
                           ELSE list_filter(d, lambda x: NOT (contains(x, '[BEGIN DATA]')
                                OR contains(x, '<|The Start of Assistant ')
                                OR contains(x, chr(10) || '************' || chr(10) || '[END DATA]'))) END AS sel
      FROM d)
SELECT conv_id, len(sel)::INTEGER AS n_selected, md5(array_to_string(sel, chr(1))) AS selected_md5 FROM s
"""

LOG_FOLD = """
lab AS (SELECT doc_id AS conv_id, quality::DOUBLE AS correct FROM labels),
fold AS (
  SELECT 'conv' || ((conv_id % 7 + conv_id // 5000 * 7))::VARCHAR || '.jsonl' AS file, conv_id,
         coalesce(list(text ORDER BY turn) FILTER (WHERE role <> 'assistant'), []) AS prompts,
         coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS s0
  FROM conversations GROUP BY conv_id),
folded AS (
  SELECT f.file, f.conv_id, f.conv_id::VARCHAR AS sample_id, f.prompts,
         CASE WHEN len(f.s0) > 1 THEN f.s0[1:len(f.s0) - 1] ELSE f.s0 END AS sampled, lab.correct
  FROM fold f LEFT JOIN lab USING (conv_id))
"""

ORACLE_SQL["q_log_fold"] = "WITH " + LOG_FOLD.strip() + """
SELECT file, sample_id, len(prompts)::INTEGER AS n_prompts, md5(array_to_string(prompts, chr(1))) AS prompt_md5,
       len(sampled)::INTEGER AS n_sampled, md5(array_to_string(sampled, chr(1))) AS sampled_md5, correct
FROM folded
"""

ORACLE_SQL["q_log_header"] = """
WITH ev AS (
  SELECT conv_id, (conv_id % 7 + conv_id // 5000 * 7) AS k, conv_id * 100 + turn + 1 AS pos, 'sampling' AS type
  FROM conversations
  UNION ALL
  SELECT DISTINCT c.conv_id, (c.conv_id % 7 + c.conv_id // 5000 * 7) AS k, c.conv_id * 100 + 99 AS pos, 'match' AS type
  FROM conversations c JOIN labels l ON l.doc_id = c.conv_id)
SELECT 'conv' || k::VARCHAR || '.jsonl' AS file, pos, conv_id::VARCHAR AS sample_id, type,
       'm' || (k % 5)::VARCHAR AS model, 'conv-' || k::VARCHAR AS eval_name
FROM ev WHERE k <> 3
"""

ORACLE_SQL["q_convert_logs"] = "WITH " + LOG_FOLD.strip() + f""",
conv AS (
  SELECT sample_id, 'conv-' || ((conv_id % 7 + conv_id // 5000 * 7))::VARCHAR AS eval_name, 'm' || ((conv_id % 7 + conv_id // 5000 * 7) % 5)::VARCHAR AS model,
         ((conv_id % 7 + conv_id // 5000 * 7) % 5)::INTEGER AS m, prompts, sampled,
         CASE WHEN correct = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS performance
  FROM folded WHERE (conv_id % 7 + conv_id // 5000 * 7) <> 3 AND correct IS NOT NULL),
priced AS (
  SELECT sample_id, eval_name, model, performance,
         (coalesce((SELECT sum({ntok('x')}) FROM unnest(prompts) t(x)), 0) * 100000 * (m + 1)
          + coalesce((SELECT sum({ntok('x')}) FROM unnest(sampled) t(x)), 0) * 200000 * (m + 1)
          + CASE WHEN m = 4 THEN 5000000000 ELSE 0 END)::BIGINT AS cost_pico
  FROM conv)
SELECT sample_id, eval_name, model, performance, cost_pico,
       CASE WHEN performance > 0 THEN model ELSE 'no_model_correct' END AS oracle
FROM priced
"""

ORACLE_SQL["q_convert_logs_models"] = "WITH " + LOG_FOLD.strip() + f""",
runs AS (
  SELECT sample_id, 'conv-' || k::VARCHAR AS eval_name, (k + CASE WHEN o = 2 THEN 3 ELSE o END) % 5 AS m,
         CASE WHEN o = 2 AND conv_id % 11 = 5 THEN list_append(prompts, 'again') ELSE prompts END AS prompts,
         CASE WHEN o = 2 THEN [x || ' ' || x for x in sampled] ELSE sampled END AS sampled,
         CASE WHEN o = 2 THEN (conv_id % 3 = 0)::INTEGER::DOUBLE ELSE (correct = 1)::INTEGER::DOUBLE END AS performance
  FROM (SELECT *, conv_id % 7 + conv_id // 5000 * 7 AS k, unnest([0, 1, 2]) AS o FROM folded WHERE correct IS NOT NULL)
  WHERE NOT (o = 1 AND (k = 3 OR conv_id % 13 = 4))),
priced AS (
  SELECT *, (coalesce((SELECT sum({ntok('x')}) FROM unnest(prompts) t(x)), 0) * 100000 * (m + 1)
             + coalesce((SELECT sum({ntok('x')}) FROM unnest(sampled) t(x)), 0) * 200000 * (m + 1)
             + CASE WHEN m = 4 THEN 5000000000 ELSE 0 END)::BIGINT AS cost
  FROM runs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id, eval_name, prompts ORDER BY performance DESC, cost, m) AS r FROM priced)
SELECT sample_id, eval_name, len(prompts)::INTEGER AS n_prompts, md5(array_to_string(prompts, chr(1))) AS prompt_md5,
       CASE WHEN max(performance) > 0 THEN 'm' || (max(m) FILTER (WHERE r = 1))::VARCHAR ELSE 'no_model_correct' END AS oracle,
       CASE WHEN max(performance) > 0 THEN max(cost) FILTER (WHERE r = 1) ELSE 0 END::BIGINT AS oracle_cost_pico,
       {', '.join(f"max(performance) FILTER (WHERE m = {m}) AS m{m}_perf, max(cost) FILTER (WHERE m = {m}) AS m{m}_cost" for m in range(5))}
FROM ranked GROUP BY sample_id, eval_name, prompts
"""

sql("q_convert_long", """
SELECT sample_id, split_part(sample_id, '.', 1) AS eval_name, oracle, oracle_cost_pico FROM oracle_lab
""")

# ---------------------------------------------------------------- split + embeddings

SPLIT_CTE = """
s AS (SELECT DISTINCT family, source, sample_id FROM eval_long),
su AS (SELECT family, sample_id,
              ('0x' || substr(md5('42|' || sample_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
       FROM (SELECT DISTINCT family, sample_id FROM s)),
split AS (SELECT family, sample_id,
                 CASE WHEN row_number() OVER (PARTITION BY family ORDER BY u, sample_id)
                           <= floor(count(*) OVER (PARTITION BY family) * 0.7::DOUBLE) THEN 'train'
                      ELSE 'test' END AS split
          FROM su)
"""

sql("q_split_samples", "SELECT family, sample_id, split FROM split", SPLIT_CTE)

sql("q_split_sources", """
SELECT s.family, s.sample_id, r.split
FROM (SELECT DISTINCT family, source, sample_id FROM s) s JOIN (
  SELECT family, source,
         CASE WHEN row_number() OVER (PARTITION BY family ORDER BY u, source)
                   <= floor(count(*) OVER (PARTITION BY family) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT family, source,
               ('0x' || substr(md5('42|' || source), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
        FROM (SELECT DISTINCT family, source FROM s))) r USING (family, source)
""", SPLIT_CTE)

sql("q_split_ood", """
SELECT wanted, family, sample_id, split FROM split, (SELECT DISTINCT family AS wanted FROM split) w
WHERE (family <> wanted AND split = 'train') OR (family = wanted AND split = 'test')
""", SPLIT_CTE)

sql("q_split_leak_check", """
SELECT family, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)::BIGINT AS n_train,
       sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END)::BIGINT AS n_test,
       (SELECT count(*) FROM split a JOIN split b USING (family, sample_id)
        WHERE a.split = 'train' AND b.split = 'test' AND a.family = x.family)::BIGINT AS n_overlap
FROM split x GROUP BY family
""", SPLIT_CTE)

ORACLE_SQL["q_cache_keys"] = "SELECT doc_id, sha256(text || 'hash32') AS hash FROM documents"

ORACLE_SQL["q_cache_misses"] = """
SELECT DISTINCT sha256(text || 'hash32') AS hash FROM documents
EXCEPT SELECT sha256(text || 'hash32') FROM documents WHERE doc_id % 3 = 0
"""

ORACLE_SQL["q_embed_cache"] = """
WITH t AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '\\S+'))) AS h FROM documents),
w AS (SELECT doc_id, (('0x' || substr(h, 1, 4))::INTEGER % 32) AS bucket,
             sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS w
      FROM t GROUP BY doc_id, bucket),
n AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS nrm FROM w GROUP BY doc_id)
SELECT doc_id, bucket::INTEGER AS bucket, round(((w::DOUBLE / nrm)::FLOAT)::DOUBLE, 6) AS value
FROM w JOIN n USING (doc_id) WHERE w <> 0
"""

# ---------------------------------------------------------------- kNN routing

KS_SQL = ", ".join(str(k) for k in KNN_NEIGHBORS)

KNN_CTE = f"""
miss AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
mtok AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '\\S+'))) AS h FROM miss),
mw AS (SELECT doc_id, (('0x' || substr(h, 1, 4))::INTEGER % 64) AS bucket,
              sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS w FROM mtok GROUP BY doc_id, bucket),
mn AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS nrm FROM mw GROUP BY doc_id),
mdense AS (SELECT m.doc_id, list(CASE WHEN coalesce(n.nrm, 0) > 0 THEN coalesce(w.w, 0)::DOUBLE / n.nrm ELSE 0.0 END::FLOAT
                                 ORDER BY b.range) AS embedding
           FROM miss m CROSS JOIN range(64) b LEFT JOIN mw w ON w.doc_id = m.doc_id AND w.bucket = b.range
           LEFT JOIN mn n ON n.doc_id = m.doc_id GROUP BY m.doc_id),
vecs AS (SELECT vec_id AS doc_id, embedding FROM embeddings UNION ALL SELECT doc_id, embedding FROM mdense),
rs AS (SELECT e.*, v.embedding FROM eval_long e JOIN vecs v USING (doc_id)),
smp AS (SELECT DISTINCT family, sample_id FROM rs),
su AS (SELECT family, sample_id,
              ('0x' || substr(md5('42|' || sample_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM smp),
split AS (SELECT family, sample_id,
                 CASE WHEN row_number() OVER (PARTITION BY family ORDER BY u, sample_id)
                           <= floor(count(*) OVER (PARTITION BY family) * 0.7::DOUBLE) THEN 'train'
                      ELSE 'test' END AS split
          FROM su),
vec AS (SELECT sample_id, any_value(embedding) AS embedding FROM rs GROUP BY sample_id),
qs AS (SELECT s.family, s.sample_id, v.embedding FROM split s JOIN vec v USING (sample_id) WHERE split = 'test'),
ts AS (SELECT s.family, s.sample_id, v.embedding FROM split s JOIN vec v USING (sample_id) WHERE split = 'train'),
pairs AS (SELECT q.family, q.sample_id AS query_id, t.sample_id AS neighbor_id,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 9) AS sim
          FROM qs q JOIN ts t USING (family)),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, query_id ORDER BY sim DESC, neighbor_id) AS rank
                      FROM pairs) WHERE rank <= {max(KNN_NEIGHBORS)}),
ks AS (SELECT unnest([{KS_SQL}]) AS k),
sc AS (SELECT nb.family, ks.k, nb.query_id, e.model_idx, avg(coalesce(e.performance, 0.0::DOUBLE)) AS score
       FROM nb JOIN ks ON nb.rank <= ks.k JOIN rs e ON e.sample_id = nb.neighbor_id
       GROUP BY nb.family, ks.k, nb.query_id, e.model_idx),
lens AS (SELECT s.family, e.model, e.model_idx, avg({ntok('e.response[1]')}) AS avg_len
         FROM rs e JOIN split s USING (sample_id) WHERE s.split = 'train' GROUP BY s.family, e.model, e.model_idx),
price AS (SELECT l.family, l.model_idx,
                 (p.completion_pico::DOUBLE + p.prompt_pico::DOUBLE
                  + coalesce(coalesce(p.request_pico, 0)::DOUBLE / nullif(l.avg_len, 0), 0.0::DOUBLE))
                 / 1000000000000.0::DOUBLE AS price
          FROM lens l JOIN model_price p USING (model)),
wtp AS (SELECT * FROM (VALUES {WTP_VALUES_SQL}) w(wi, wtp, wtp_text)),
util AS (SELECT sc.family, sc.k, sc.query_id, w.wtp, w.wtp_text, sc.model_idx,
                CASE WHEN w.wtp > 0 THEN sc.score * w.wtp - pr.price ELSE sc.score END AS u
         FROM sc JOIN price pr USING (family, model_idx) CROSS JOIN wtp w),
routed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, k, wtp, query_id
                                                       ORDER BY u DESC, model_idx) AS rn FROM util) WHERE rn = 1),
looked AS (SELECT r.family, r.k, r.wtp, r.wtp_text, r.query_id, e.model AS chosen,
                  coalesce(e.performance, 0.0::DOUBLE) AS performance, e.cost_pico
           FROM routed r JOIN rs e ON e.sample_id = r.query_id AND e.model_idx = r.model_idx),
sweep AS (SELECT family AS eval_name, k::INTEGER AS neighbors, wtp, any_value(wtp_text) AS wtp_text,
                 avg(performance) AS performance, sum(cost_pico)::BIGINT AS total_cost_pico
          FROM looked GROUP BY family, k, wtp),
te AS (SELECT e.* FROM rs e JOIN split s USING (sample_id) WHERE s.split = 'test'),
te_oracle AS (
  SELECT family, sample_id,
         CASE WHEN mx > 0 THEN performance ELSE 0.0::DOUBLE END AS oracle_performance,
         CASE WHEN mx > 0 THEN cost_pico ELSE 0 END::BIGINT AS oracle_cost_pico
  FROM (SELECT *, max(performance) OVER (PARTITION BY sample_id) AS mx,
               row_number() OVER (PARTITION BY sample_id ORDER BY performance DESC NULLS LAST, cost_pico, model_idx) AS rn
        FROM te) WHERE rn = 1),
base AS (SELECT family AS eval_name, model AS router, avg(coalesce(performance, 0.0::DOUBLE)) AS performance,
                sum(cost_pico)::BIGINT AS total_cost_pico FROM te GROUP BY family, model
         UNION ALL
         SELECT family, 'oracle', avg(oracle_performance), sum(oracle_cost_pico)::BIGINT FROM te_oracle GROUP BY family)
"""

sql("q_knn_neighbors", """
SELECT family, query_id AS sample_id, neighbor_id, round(sim, 6) AS sim, rank::BIGINT AS rank FROM nb
""", KNN_CTE)

for _metric, _sim in (("euclidean", "-list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[])"),
                      ("manhattan", "-list_sum(list_transform(range(1, len(q.embedding) + 1), "
                                    "lambda i: abs(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE)))")):
    sql(f"q_knn_{_metric}", """
SELECT family, query_id AS sample_id, neighbor_id, round(sim, 4) AS sim, rank::BIGINT AS rank FROM nb
""", KNN_CTE.replace("list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[])", _sim))

sql("q_knn_scores", """
SELECT family, k::INTEGER AS neighbors, query_id AS sample_id, model_idx, round(score, 6) AS score FROM sc
""", KNN_CTE)

sql("q_price_score", """
SELECT family, model_idx, round(price * 1000000000000.0::DOUBLE, 6) AS price_score_pico FROM price
""", KNN_CTE)

sql("q_route_knn", """
SELECT k::INTEGER AS neighbors, wtp, query_id AS sample_id, 'm' || model_idx::VARCHAR AS chosen FROM routed
""", KNN_CTE)

sql("q_route_lookup", """
SELECT k::INTEGER AS neighbors, wtp, query_id AS sample_id, chosen, performance, cost_pico FROM looked
""", KNN_CTE)

sql("q_wtp_sweep", """
SELECT eval_name, neighbors, wtp, round(performance, 6) AS performance, total_cost_pico FROM sweep
""", KNN_CTE)

sql("q_knn_grid", """
SELECT eval_name, 'knn|neighbors:' || neighbors::VARCHAR || '|metric:cosine|embedding:given|fraction:0.7'
                  || '|willingness_to_pay:' || wtp_text AS variant,
       round(performance, 6) AS performance, total_cost_pico FROM sweep
""", KNN_CTE)

sql("q_router_scores", """
SELECT eval_name, 'knn' AS router, neighbors, wtp, round(performance, 6) AS performance, total_cost_pico FROM sweep
UNION ALL
SELECT eval_name, router, NULL::INTEGER, NULL::DOUBLE, round(performance, 6), total_cost_pico FROM base
""", KNN_CTE)

sql("q_test_baselines", """
SELECT eval_name, router, round(performance, 6) AS performance, total_cost_pico FROM base
""", KNN_CTE)

# ---------------------------------------------------------------- cascade

def _grid_sql():
    from decimal import Decimal
    rows = []
    for b in CASCADE_BUDGETS:
        for ei, e in enumerate(CASCADE_ERROR_RATES):
            rows.append(f"({int(Decimal(repr(b)) * 10**12)}::BIGINT, {_dbl(b)}, {ei}, {_dbl(e)})")
    return ", ".join(rows)


CASCADE_CTE = f"""
fl AS (SELECT eval_name, sample_id, model, model_idx, coalesce(performance, 0.0::DOUBLE) AS performance,
              cost_pico, response FROM eval_long),
thr AS (SELECT eval_name, quantile_cont(performance, 0.95) AS threshold FROM fl GROUP BY eval_name),
lens AS (SELECT eval_name, model, model_idx, avg({ntok('response[1]')}) AS avg_len FROM fl
         GROUP BY eval_name, model, model_idx),
pr AS (SELECT l.eval_name, l.model_idx,
              (p.completion_pico::DOUBLE + p.prompt_pico::DOUBLE
               + coalesce(coalesce(p.request_pico, 0)::DOUBLE / nullif(l.avg_len, 0), 0.0::DOUBLE))
              / 1000000000000.0::DOUBLE AS price
       FROM lens l JOIN model_price p USING (model)),
ordr AS (SELECT fl.*, row_number() OVER (PARTITION BY fl.sample_id ORDER BY pr.price, fl.model_idx) AS pos
         FROM fl JOIN pr USING (eval_name, model_idx)),
grid AS (SELECT * FROM (VALUES {_grid_sql()}) g(budget_pico, budget, ei, err)),
c AS (SELECT o.eval_name, o.sample_id, o.model, o.performance, o.cost_pico, o.pos, g.budget_pico, g.budget, g.ei,
             g.err, t.threshold,
             (('0x' || substr(md5(o.sample_id || '|' || o.model || '|' || g.ei::VARCHAR), 1, 8))::BIGINT::DOUBLE
              / 4294967296.0::DOUBLE) < g.err AS wrong
      FROM ordr o CROSS JOIN grid g JOIN thr t USING (eval_name)),
c2 AS (SELECT *, CASE WHEN wrong THEN performance < threshold ELSE performance >= threshold END AS acc,
              sum(cost_pico) OVER (PARTITION BY sample_id, budget_pico, ei ORDER BY pos
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s_j
       FROM c),
c3 AS (SELECT *, coalesce(sum(acc::INTEGER) OVER (PARTITION BY sample_id, budget_pico, ei ORDER BY pos
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc_before
       FROM c2),
asked AS (SELECT * FROM c3 WHERE acc_before = 0 AND NOT (s_j >= budget_pico AND s_j - cost_pico > 0)),
per AS (SELECT eval_name, sample_id, budget, err, any_value(threshold) AS threshold,
               arg_max(performance, pos) AS last_performance, max(s_j) AS spent
        FROM asked GROUP BY eval_name, sample_id, budget, err),
cas AS (SELECT eval_name, budget AS max_cost_per_response, err AS evaluator_error_rate,
               any_value(threshold) AS performance_threshold, avg(last_performance) AS performance,
               sum(spent)::BIGINT AS total_cost_pico
        FROM per GROUP BY eval_name, budget, err)
"""

sql("q_accept_threshold", "SELECT eval_name, round(threshold, 6) AS threshold FROM thr", CASCADE_CTE)

sql("q_cascade", """
SELECT eval_name, max_cost_per_response, evaluator_error_rate, round(performance_threshold, 6) AS performance_threshold,
       round(performance, 6) AS performance, total_cost_pico FROM cas
""", CASCADE_CTE)

sql("q_cascade_grid", """
SELECT max_cost_per_response, evaluator_error_rate, round(avg(performance), 6) AS performance,
       sum(total_cost_pico)::BIGINT AS total_cost_pico, count(*) AS n_evals
FROM cas GROUP BY max_cost_per_response, evaluator_error_rate
""", CASCADE_CTE)

# ---------------------------------------------------------------- analysis

VR_CTE = f"""
wtp_grid AS (SELECT * FROM (VALUES {WTP_VALUES_SQL}) w(w, willingness_to_pay, wtp_text)),
vr AS (
  SELECT lang AS eval_name, 'knn' AS router, (v * 5 + 5)::INTEGER AS neighbors, 'cosine' AS metric,
         'e' || (v % 2)::VARCHAR AS embedding, any_value(g.willingness_to_pay) AS willingness_to_pay,
         any_value(g.wtp_text) AS wtp_text,
         round(avg(score), 9) AS performance, sum(n_chars)::BIGINT AS total_cost
  FROM (SELECT lang, (doc_id % 5)::INTEGER AS v, ((doc_id // 5) % 32)::INTEGER AS w,
               ((doc_id * 37 + doc_id % 5) % 23)::DOUBLE / 23.0::DOUBLE AS score, n_chars FROM documents) d
  JOIN wtp_grid g USING (w)
  GROUP BY lang, v, w),
scores AS (
  SELECT eval_name, model, avg(coalesce(performance, 0.0::DOUBLE)) AS performance, sum(cost_pico)::BIGINT AS total_cost
  FROM eval_long GROUP BY eval_name, model
  UNION ALL
  SELECT eval_name, 'oracle', avg(oracle_performance), sum(oracle_cost_pico)::BIGINT FROM oracle_lab GROUP BY eval_name),
best_pt AS (
  SELECT * FROM (
    SELECT eval_name, embedding, neighbors, performance, willingness_to_pay AS best_willingness_to_pay,
           CASE WHEN performance > 0 THEN total_cost
                ELSE min(total_cost) OVER (PARTITION BY eval_name, neighbors) END AS total_cost,
           row_number() OVER (PARTITION BY eval_name, neighbors ORDER BY performance DESC, willingness_to_pay) AS rn
    FROM vr) WHERE rn = 1),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eval_name, embedding
                                              ORDER BY performance DESC, total_cost, neighbors) AS rn2 FROM best_pt)
  WHERE rn2 = 1)
"""


def _hull_sql(src: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    on_a = " AND ".join(f"a.{c} = p.{c}" for c in keys)
    on_b = " AND ".join(f"b.{c} = p.{c}" for c in keys)
    return f"""
{name}_pts AS (SELECT {k}, x, max(y) AS y FROM {src} GROUP BY {k}, x),
{name}_vert AS (
  SELECT p.*, lag(p.x) OVER (PARTITION BY {", ".join("p." + c for c in keys)} ORDER BY p.x) AS px,
         lag(p.y) OVER (PARTITION BY {", ".join("p." + c for c in keys)} ORDER BY p.x) AS py
  FROM {name}_pts p WHERE NOT EXISTS (
    SELECT 1 FROM {name}_pts a, {name}_pts b
    WHERE {on_a} AND {on_b} AND a.x < p.x AND p.x < b.x
      AND (p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x) >= 0)),
{name} AS (SELECT *, (row_number() OVER (PARTITION BY {k} ORDER BY x) - 1)::INTEGER AS pos
           FROM {name}_vert WHERE py IS NULL OR y >= py)
"""


VR_HULL = VR_CTE + ",\nvr_xy AS (SELECT eval_name, neighbors, total_cost::DOUBLE AS x, performance AS y FROM vr)," + \
    _hull_sql("vr_xy", ["eval_name", "neighbors"], "nd")

sql("q_frontier", "SELECT eval_name, neighbors, pos, round(x, 6) AS x, round(y, 6) AS y FROM nd", VR_HULL)

AIQ_CTE = VR_HULL + """,
qual AS (SELECT eval_name, neighbors, count(*) AS n FROM (SELECT DISTINCT eval_name, neighbors, total_cost, performance
         FROM vr) GROUP BY eval_name, neighbors),
ar AS (SELECT eval_name, neighbors, coalesce(sum((x - px) * (y + py) / 2.0::DOUBLE), 0.0::DOUBLE) AS area,
              arg_max(x, x) AS last_x, arg_max(y, x) AS last_y
       FROM nd GROUP BY eval_name, neighbors),
arq AS (SELECT ar.*, max(last_x) OVER (PARTITION BY eval_name) AS max_x
        FROM ar JOIN qual USING (eval_name, neighbors) WHERE qual.n >= 3),
aiqs AS (SELECT eval_name, neighbors, (area + (max_x - last_x) * last_y) / nullif(max_x, 0) AS aiq FROM arq)
"""

sql("q_aiq", "SELECT eval_name, neighbors, round(aiq, 6) AS aiq FROM aiqs", AIQ_CTE)

sql("q_aiq_ranking", """
SELECT neighbors, round(avg(aiq), 6) AS mean_aiq, count(*) AS n_evals FROM aiqs GROUP BY neighbors
""", AIQ_CTE)

ZERO_CTE = VR_CTE + ",\nllm_xy AS (SELECT eval_name, total_cost::DOUBLE AS x, performance AS y FROM scores " \
    "WHERE model <> 'oracle')," + _hull_sql("llm_xy", ["eval_name"], "zr")

sql("q_zero_router", "SELECT eval_name, pos, round(x, 6) AS x, round(y, 6) AS y FROM zr", ZERO_CTE)

sql("q_macro_mean", """
SELECT router, neighbors, embedding, willingness_to_pay, round(avg(performance), 6) AS performance,
       round(avg(total_cost), 6) AS total_cost, count(*) AS n_evals
FROM vr GROUP BY router, neighbors, embedding, willingness_to_pay
""", VR_CTE)

sql("q_best_variant", """
SELECT eval_name, embedding, neighbors, round(performance, 6) AS performance, total_cost::BIGINT AS total_cost,
       best_willingness_to_pay FROM best
""", VR_CTE)

sql("q_frontier_series", """
SELECT v.eval_name, v.embedding, v.neighbors, v.willingness_to_pay, v.total_cost, round(v.performance, 6) AS performance
FROM vr v JOIN best b USING (eval_name, embedding, neighbors)
""", VR_CTE)

sql("q_family_series", """
SELECT v.eval_name, f.router, v.neighbors, v.willingness_to_pay AS x_value, v.total_cost, round(v.performance, 6) AS performance
FROM vr v JOIN (
  SELECT * FROM (
    SELECT eval_name, neighbors, CASE WHEN neighbors IN (5, 15) THEN 'knn' ELSE 'mlp' END AS router,
           row_number() OVER (PARTITION BY eval_name, neighbors IN (5, 15) ORDER BY performance DESC, total_cost, neighbors) AS rn3
    FROM best_pt WHERE neighbors <> 20) WHERE rn3 = 1) f USING (eval_name, neighbors)
UNION ALL
SELECT eval_name, 'cascade', -1, willingness_to_pay, total_cost, round(performance, 6) FROM vr WHERE neighbors = 15
""", VR_CTE)

_DISPLAY = ", ".join(f"('{m}', '{d}')" for m, d in __import__("routelens.constants", fromlist=["x"]).DISPLAY_NAMES)
sql("q_leaderboard", f"""
SELECT s.eval_name, s.model, coalesce(d.display_name, s.model) AS display_name, round(s.performance, 6) AS performance,
       s.total_cost
FROM scores s LEFT JOIN (VALUES {_DISPLAY}) d(model, display_name) USING (model)
""", VR_CTE)

UNION_CTE = VR_CTE + """,
u AS (SELECT DISTINCT * FROM (
  SELECT eval_name, router, neighbors, embedding, willingness_to_pay, performance, total_cost::DOUBLE AS total_cost FROM vr
  UNION ALL
  SELECT eval_name, model, NULL::INTEGER, NULL::VARCHAR, NULL::DOUBLE, performance, total_cost::DOUBLE FROM scores))
"""

sql("q_results_union", """
SELECT eval_name, router, neighbors, embedding, willingness_to_pay, round(performance, 6) AS performance,
       round(total_cost, 6) AS total_cost FROM u
""", UNION_CTE)

sql("q_baselines", """
SELECT router, router IN ('m0', 'm1', 'm2', 'm3', 'm4', 'oracle') AS is_baseline, count(*) AS n_rows
FROM u GROUP BY router
""", UNION_CTE)

_RW = ",\n".join(f"round(avg(performance) FILTER (WHERE model = '{n}'), 6) AS {n}_performance, "
                 f"round(avg(total_cost) FILTER (WHERE model = '{n}'), 6) AS {n}_total_cost"
                 for n in ["m0", "m1", "m2", "m3", "m4", "oracle"])
sql("q_results_wide", f"SELECT eval_name, {_RW} FROM scores GROUP BY eval_name", VR_CTE)

sql("q_average_accuracy", """
SELECT eval_name, round(avg(performance), 6) AS average_accuracy FROM scores WHERE model <> 'oracle' GROUP BY eval_name
""", VR_CTE)

sql("q_router_names", """
SELECT DISTINCT router || '|neighbors:' || neighbors::VARCHAR || '|metric:' || metric || '|embedding:' || embedding
       AS router_name FROM vr
""", VR_CTE)

NAME_SQL = ("router || '|neighbors:' || neighbors::VARCHAR || '|metric:' || metric || '|embedding:' || embedding"
            " || '|willingness_to_pay:' || wtp_text || '|performance'")

sql("q_variant_name", f"SELECT eval_name, {NAME_SQL} AS variant, round(performance, 6) AS performance FROM vr", VR_CTE)

sql("q_parse_variant", f"""
SELECT variant, parts[1] AS algorithm, parts[len(parts)] AS value_type,
       split_part(p, ':', 1) AS key, substr(p, strpos(p, ':') + 1) AS value, split_part(p, ':', 2) AS tolerant_value
FROM (SELECT variant, parts, unnest(parts[2:len(parts) - 1]) AS p
      FROM (SELECT DISTINCT {NAME_SQL} AS variant, string_split({NAME_SQL}, '|') AS parts FROM vr))
""", VR_CTE)

sql("q_csv_roundtrip", """
SELECT eval_name, model, round(performance, 6) AS performance, total_cost AS total_cost_pico FROM scores
""", VR_CTE)

ORACLE_SQL["q_log_scan"] = "WITH " + LOG_FOLD.strip() + """
SELECT file, sample_id, len(prompts)::INTEGER AS n_prompts, md5(array_to_string(prompts, chr(1))) AS prompt_md5,
       len(sampled)::INTEGER AS n_sampled, md5(array_to_string(sampled, chr(1))) AS sampled_md5,
       CASE WHEN correct IS NULL THEN NULL WHEN correct = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct
FROM folded
WHERE (conv_id % 7 + conv_id // 5000 * 7) <> 3
"""

ORACLE_SQL["q_prompt_extract"] = """
WITH u AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
p AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN t ELSE [array_to_string(t, chr(10))] END AS prompt FROM u)
SELECT conv_id::VARCHAR AS sample_id, len(prompt)::INTEGER AS n_prompts, md5(array_to_string(prompt, chr(1))) AS prompt_md5
FROM p
"""

ORACLE_SQL["q_list_parse"] = """
SELECT conv_id, len(t)::INTEGER AS n_prompts, md5(array_to_string(t, chr(1))) AS prompt_md5
FROM (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE role <> 'assistant' GROUP BY conv_id)
"""

ORACLE_SQL["q_encoder_embed"] = ORACLE_SQL["q_embed_cache"]

sql("q_convert_and_embed", """
SELECT o.sample_id, o.oracle, sha256(d.text || 'hash32') AS hash, coalesce(z.n_nonzero, 0)::INTEGER AS n_nonzero
FROM oracle_lab o JOIN documents d ON o.sample_id = d.lang || '.' || d.source || '.' || d.doc_id::VARCHAR
LEFT JOIN (SELECT doc_id, count(*) AS n_nonzero FROM (
             SELECT doc_id, (('0x' || substr(h, 1, 4))::INTEGER % 32) AS bucket,
                    sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END) AS w
             FROM (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '\\S+'))) AS h FROM documents)
             GROUP BY doc_id, bucket) WHERE w <> 0 GROUP BY doc_id) z ON z.doc_id = d.doc_id
""")

sql("q_cascade_series", """
SELECT eval_name, max_cost_per_response, total_cost_pico, round(performance, 6) AS performance FROM cas
WHERE evaluator_error_rate = 0.2
""", CASCADE_CTE)

ORACLE_SQL["q_results_store"] = ORACLE_SQL["q_results_union"]

sql("q_plot_points", """
SELECT router || '|' || neighbors::VARCHAR || '|' || embedding AS series, willingness_to_pay AS x_value,
       round(avg(total_cost), 6) AS total_cost, round(avg(performance), 6) AS performance
FROM vr WHERE starts_with(eval_name, 'en') GROUP BY router, neighbors, embedding, willingness_to_pay
UNION ALL
SELECT model, NULL::DOUBLE, round(avg(total_cost), 6), round(avg(performance), 6)
FROM scores WHERE starts_with(eval_name, 'en') GROUP BY model
""", VR_CTE)

KNN_OOD_CTE = (KNN_CTE.replace("FROM split s", "FROM split2 s").replace("JOIN split s", "JOIN split2 s")
               .replace("vec AS (", "split2 AS (SELECT wanted AS family, sample_id, split\n"
                        "  FROM split, (SELECT DISTINCT family AS wanted FROM split) x\n"
                        "  WHERE (family <> wanted AND split = 'train') OR (family = wanted AND split = 'test')),\nvec AS (", 1))

sql("q_route_knn_ood", """
SELECT family, k::INTEGER AS neighbors, wtp, query_id AS sample_id, chosen, performance, cost_pico FROM looked
""", KNN_OOD_CTE)

_SRC_SPLIT = """split AS (
  SELECT m.family, m.sample_id, r.split
  FROM (SELECT DISTINCT family, source, sample_id FROM rs) m JOIN (
    SELECT family, source,
           CASE WHEN row_number() OVER (PARTITION BY family ORDER BY u, source)
                     <= floor(count(*) OVER (PARTITION BY family) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT family, source,
                 ('0x' || substr(md5('42|' || source), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
          FROM (SELECT DISTINCT family, source FROM rs))) r USING (family, source)),
vec AS ("""
_i = KNN_CTE.index("split AS (")
_j = KNN_CTE.index("vec AS (")
KNN_SRC_CTE = KNN_CTE[:_i] + _SRC_SPLIT + KNN_CTE[_j + len("vec AS ("):]

sql("q_wtp_sweep_sources", """
SELECT eval_name, neighbors, wtp, round(performance, 6) AS performance, total_cost_pico FROM sweep
""", KNN_SRC_CTE)

ORACLE_SQL["q_convert_csv"] = ORACLE_SQL["q_convert_long"]

AIQ_EMB_CTE = VR_CTE + ",\nvr_xy AS (SELECT eval_name, embedding, total_cost::DOUBLE AS x, performance AS y FROM vr " \
    "WHERE router = 'knn')," + _hull_sql("vr_xy", ["eval_name", "embedding"], "nd") + """,
qual AS (SELECT eval_name, embedding, count(*) AS n FROM (SELECT DISTINCT eval_name, embedding, total_cost, performance
         FROM vr WHERE router = 'knn') GROUP BY eval_name, embedding),
ar AS (SELECT eval_name, embedding, coalesce(sum((x - px) * (y + py) / 2.0::DOUBLE), 0.0::DOUBLE) AS area,
              arg_max(x, x) AS last_x, arg_max(y, x) AS last_y
       FROM nd GROUP BY eval_name, embedding),
arq AS (SELECT ar.*, max(last_x) OVER (PARTITION BY eval_name) AS max_x
        FROM ar JOIN qual USING (eval_name, embedding) WHERE qual.n >= 3)
"""

sql("q_aiq_embedding", """
SELECT eval_name, embedding, round((area + (max_x - last_x) * last_y) / nullif(max_x, 0), 6) AS aiq FROM arq
""", AIQ_EMB_CTE)


def _variant_wide_sql():
    from routelens.sources.fixtures import fixture_variant_names
    exprs = []
    for n in fixture_variant_names():
        for m in ("performance", "total_cost"):
            exprs.append(f"round(avg({m}::DOUBLE) FILTER (WHERE vname = '{n}'), 6) AS \"{n}|{m}\"")
    return "SELECT eval_name, " + ",\n  ".join(exprs) + """
FROM (SELECT *, router || '|neighbors:' || neighbors::VARCHAR || '|metric:' || metric || '|embedding:' || embedding
                || '|willingness_to_pay:' || wtp_text AS vname FROM vr)
GROUP BY eval_name"""


sql("q_results_wide_variants", _variant_wide_sql(), VR_CTE)

sql("q_convert_job", f"""
SELECT m.sample_id, m.eval_name, m.model, round(coalesce(m.performance, 0.0::DOUBLE), 6) AS performance, m.cost_pico,
       CASE WHEN o.mx > 0 THEN o.model ELSE 'no_model_correct' END AS oracle
FROM m JOIN (SELECT *, max(performance) OVER (PARTITION BY sample_id, eval_name) AS mx,
                    row_number() OVER (PARTITION BY sample_id, eval_name
                                       ORDER BY performance DESC NULLS LAST, cost_pico, model_idx) AS rn FROM m) o
  ON o.sample_id = m.sample_id AND o.eval_name = m.eval_name AND o.rn = 1
""", f"""
l AS (SELECT (doc_id // 3)::VARCHAR AS sample_id, family AS eval_name, model, model_idx, prompt[1] AS p, response[1] AS r,
             CASE WHEN doc_id % 11 <> 3 THEN performance END AS performance FROM eval_long),
g AS (SELECT sample_id, eval_name, min(p) AS p FROM l GROUP BY sample_id, eval_name),
c AS (SELECT l.*, {ntok('g.p')} * q.prompt_pico + {ntok('l.r')} * q.completion_pico + coalesce(q.request_pico, 0) AS cost
      FROM l JOIN g ON g.sample_id = l.sample_id AND g.eval_name = l.eval_name JOIN model_price q ON q.model = l.model),
m AS (SELECT sample_id, eval_name, model, model_idx, avg(performance) AS performance, min(cost)::BIGINT AS cost_pico
      FROM c GROUP BY sample_id, eval_name, model, model_idx)
""")

ORACLE_SQL["q_one_to_one"] = """
SELECT count(*) FILTER (WHERE r IS NULL)::BIGINT AS only_left, count(*) FILTER (WHERE l IS NULL)::BIGINT AS only_right,
       count(*) FILTER (WHERE l > 1 OR r > 1)::BIGINT AS duplicated
FROM (SELECT doc_id, count(*) AS l FROM documents GROUP BY doc_id)
FULL JOIN (SELECT doc_id, count(*) AS r FROM labels GROUP BY doc_id) USING (doc_id)
"""


def _price_rows() -> str:
    """The shipped price list as SQL values (model, pico-USD a token of the prompt, pico-USD a request)."""
    import csv
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "prices.csv")
    with open(path, newline="") as f:
        rows = list(csv.DictReader(x for x in f if not x.startswith("#")))
    return ", ".join("('{}', {}, {})".format(r["model"].replace("'", "''"),
                                             int(Decimal(r["prompt_usd_per_10m_tokens"]) * 100000),
                                             int(Decimal(r["request_usd"] or "0") * 10 ** 12)) for r in rows)


ORACLE_SQL["q_price_list"] = f"""
SELECT model, (t::HUGEINT * prompt_pico + n::HUGEINT * request_pico)::DECIMAL(38,0) AS cost_pico
FROM (VALUES {_price_rows()}) p(model, prompt_pico, request_pico),
     (SELECT count(*) AS n, sum({ntok('text')}) AS t FROM documents)
"""

sql("q_eval_names", "SELECT DISTINCT eval_name FROM eval_long")
