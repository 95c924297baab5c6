"""DuckDB oracle SQL for the registered queries, built from shared CTE blocks.

Column names equal the Spark query's; floats are rounded identically on both sides where sums differ
in association order.
"""

from __future__ import annotations

FX_TEXT = """fx_text AS (
  SELECT d.doc_id AS k, split_part(d.text, chr(10), 1) AS question1, d.text AS question2,
         l.quality AS label
  FROM documents d JOIN labels l USING (doc_id))"""

TEXT_SRC = """text_src AS (
  SELECT k, 'text' AS query_type, question1 AS query_value, 'text' AS positive_type,
         question2 AS positive_value, CAST(NULL AS VARCHAR) AS source
  FROM fx_text WHERE coalesce(label, 0) = 1)"""

CAP_SRC = """cap_src AS (
  SELECT k, 'image' AS query_type, query_value, 'text' AS positive_type, positive_value, 'caption' AS source
  FROM (SELECT page_id AS k, printf('page_%06d.jpg', page_id) AS query_value,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS positive_value FROM pages)
  WHERE positive_value <> '')"""

CHAT_SRC = """chat_src AS (
  SELECT conv_id AS k, 'image' AS query_type, printf('conv_%06d.jpg', conv_id) AS query_value,
         'text' AS positive_type, arg_min(text, turn) AS positive_value, 'chat' AS source
  FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY conv_id)"""

AUDIO_SRC = """audio_src AS (
  SELECT k, 'audio' AS query_type, printf('%s_%06d.wav', source, idx) AS query_value, 'text' AS positive_type,
         text AS positive_value, source
  FROM (SELECT doc_id AS k, source, text,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx
        FROM documents)
  WHERE text <> '')"""

MANIFEST = """all_src AS (
  SELECT *, 0 AS g, 0 AS s FROM text_src
  UNION ALL SELECT *, 1, 0 FROM cap_src
  UNION ALL SELECT *, 1, 1 FROM chat_src
  UNION ALL SELECT *, 2, dense_rank() OVER (ORDER BY source) - 1 FROM audio_src),
ringed AS (
  SELECT *,
         CASE WHEN count(*) OVER w > 1 THEN 'text' END AS negative_type,
         CASE WHEN count(*) OVER w > 1
              THEN coalesce(lead(positive_value) OVER wo, first_value(positive_value) OVER wo) END AS negative_value,
         row_number() OVER (PARTITION BY g ORDER BY s, k) - 1 AS gpos
  FROM all_src WINDOW w AS (PARTITION BY g, s), wo AS (PARTITION BY g, s ORDER BY k)),
indexed AS (SELECT *, row_number() OVER (ORDER BY gpos, g) - 1 AS idx FROM ringed),
manifest AS (
  SELECT idx, CASE g WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'audio' END AS group_name, source, k,
         query_type, query_value, positive_type, positive_value, negative_type, negative_value,
         CASE WHEN idx < (SELECT greatest(1, CAST(floor(count(*) * (1.0 - CAST(0.1 AS DOUBLE))) AS BIGINT))
                          FROM ringed) THEN 'train' ELSE 'val' END AS split
  FROM indexed)"""

SOURCES = ",\n".join([FX_TEXT, TEXT_SRC, CAP_SRC, CHAT_SRC, AUDIO_SRC])
WITH_MANIFEST = "WITH " + SOURCES + ",\n" + MANIFEST + "\n"


def with_manifest(select: str) -> str:
    return WITH_MANIFEST + select


def with_sources(select: str) -> str:
    return "WITH " + SOURCES + "\n" + select

INVENTORY = """inventory AS (
  SELECT printf('page_%06d.jpg', page_id) AS path FROM pages WHERE starts_with(url, 'https://')
  UNION ALL
  SELECT CASE WHEN s = 1 THEN printf('images/conv_%06d.jpg', conv_id) ELSE printf('conv_%06d.jpg', conv_id) END
  FROM (SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS s FROM conversations GROUP BY conv_id)
  UNION ALL
  SELECT printf('%s_%06d.wav', source, idx)
  FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx
        FROM documents)
  WHERE doc_id IN (SELECT doc_id FROM labels))"""

PARSED = """parsed AS (
  SELECT idx, query_type, query_value, positive_type, positive_value,
         CASE WHEN source = 'chat' THEN negative_type END AS negative_type,
         CASE WHEN source = 'chat' THEN negative_value END AS negative_value,
         source, CAST(NULL AS VARCHAR) AS error
  FROM manifest)"""

ITEMS = """items AS (
  SELECT idx, 'query' AS role, query_type AS modality, query_value AS value FROM manifest
  UNION ALL SELECT idx, 'positive', positive_type, positive_value FROM manifest
  UNION ALL SELECT idx, 'negative', negative_type, negative_value FROM manifest WHERE negative_type IS NOT NULL)"""


def with_manifest_and(*blocks: str) -> str:
    return WITH_MANIFEST.rstrip() + ",\n" + ",\n".join(blocks) + "\n"


def payload_cols(role: str, out: str | None = None, src: str | None = None) -> str:
    out = out or role
    src = src or role
    return ", ".join(f"CASE WHEN {src}_type = '{m}' THEN {src}_value END AS {out}_{m}" for m in ("text", "image", "audio"))

PAIRS = """pairs AS (
  SELECT vec_id // 2 AS pair_id, arg_min(embedding, vec_id) AS q0, arg_max(embedding, vec_id) AS p0
  FROM embeddings GROUP BY 1),
fx AS (SELECT pair_id, pair_id // 32 AS batch_id, CAST(q0 AS DOUBLE[]) AS q, CAST(p0 AS DOUBLE[]) AS p FROM pairs),
tri AS (
  SELECT pair_id, batch_id, q, p,
         coalesce(lead(p) OVER (ORDER BY pair_id), first_value(p) OVER (ORDER BY pair_id)) AS n FROM fx)"""

BATCH_ROWS = """scores AS (
  SELECT a.batch_id, a.pair_id AS i, b.pair_id AS j, list_dot_product(a.q, b.p) * 20.0 AS s
  FROM fx a JOIN fx b USING (batch_id)),
sw AS (SELECT *, max(s) OVER (PARTITION BY batch_id, i) AS rm, max(s) OVER (PARTITION BY batch_id, j) AS cm FROM scores),
rws AS (
  SELECT batch_id, i AS pair_id, max(CASE WHEN i = j THEN s END) AS diag, max(s) AS row_max,
         min(CASE WHEN s = rm THEN j END) AS argmax_pair, max(rm) + ln(sum(exp(s - rm))) AS row_lse
  FROM sw GROUP BY batch_id, i),
cls AS (SELECT batch_id, j AS pair_id, max(cm) + ln(sum(exp(s - cm))) AS col_lse FROM sw GROUP BY batch_id, j),
brows AS (SELECT r.*, c.col_lse, CASE WHEN argmax_pair = pair_id THEN 1 ELSE 0 END AS hit FROM rws r JOIN cls c USING (batch_id, pair_id)),
per_batch AS (
  SELECT batch_id, count(*) AS n, 0.5 * (avg(row_lse - diag) + avg(col_lse - diag)) AS loss,
         avg(row_lse - diag) AS row_ce, avg(hit) AS top1
  FROM brows GROUP BY batch_id)"""


def cos_sql(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12)"
            f" * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))")



def neg_batches_sql(dim: str | None = None) -> str:
    """L4 per (dim, batch) over triples: candidates = batch positives then batch negatives, cosine x 20."""
    def tr(x):
        return f"list_slice({x}, 1, d)" if dim else x
    dims = f"(SELECT unnest({dim}) AS d)" if dim else "(SELECT 0 AS d)"
    return f"""cand AS (SELECT batch_id, pair_id AS j, 0 AS kind, p AS v FROM tri
              UNION ALL SELECT batch_id, pair_id, 1, n FROM tri),
ns AS (SELECT dd.d, t.batch_id, t.pair_id AS i, c.j, c.kind, 20.0 * {cos_sql(tr('t.q'), tr('c.v'))} AS s
       FROM tri t JOIN cand c USING (batch_id), {dims} dd),
nw AS (SELECT *, max(s) OVER (PARTITION BY d, batch_id, i) AS rm FROM ns),
nrows AS (SELECT d, batch_id, i, max(CASE WHEN kind = 0 AND i = j THEN s END) AS diag,
                 max(rm) + ln(sum(exp(s - rm))) AS lse,
                 min(CASE WHEN s = rm THEN kind * 1000000000000 + j END) AS best
          FROM nw GROUP BY d, batch_id, i),
nbatch AS (SELECT d, batch_id, count(*) AS n, avg(lse - diag) AS loss,
                  avg(CASE WHEN best = i THEN 1 ELSE 0 END) AS top1 FROM nrows GROUP BY d, batch_id)"""
