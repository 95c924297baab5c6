"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table.

``ORACLE`` holds the SQL of those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import bpe, hilbert_search, jaccard, language, lexical_search, license_scan, negatives, packing, quality, repetition, suffix_score, suffix_tree, toxicity, url_filter
from pairforge.llm.common import id_text_crc, table

#: The rules that op5 applies.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


#: Sequence length and the id that ends a document in op2.
PACK_TOKENS, PACK_END = 4096, 1
#: Fixed value: the least score that op12 predicts as label 1.
QUALITY_LEAST = 0.3


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_classes(table(spark, sf_dir, "documents"), k=3, part=90).drop("class")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), PACK_TOKENS, PACK_END)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def language_profiles(spark: SparkSession, sf_dir: str) -> language.Profiles:
    """The profiles learned outside the held-out fold."""
    return language.learn_profiles(table(spark, sf_dir, "documents").filter((id_text_crc(F.col("doc_id")) % 3) != 1))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), language_profiles(spark, sf_dir))
    return found.withColumn("held_out", (id_text_crc(F.col("doc_id")) % 3) == 1)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = (id_text_crc(F.col("doc_id")) % 7) == 2
    known = docs.filter(~held_out)
    counts = suffix_tree.count_words(known)
    coded = suffix_score.code_texts(docs, ~held_out, suffix_tree.grow(known, counts, depth=0), counts, keep={"held_out": held_out})
    return suffix_score.score_whole(coded, suffix_tree.grow(known, counts, coded=coded.filter("_learn")))


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network | None:
    """The network learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter((id_text_crc(F.col("doc_id")) % 5) != 0)
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_network(spark, sf_dir))
    return scored.withColumn("held_out", (id_text_crc(F.col("doc_id")) % 5) == 0)


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = (id_text_crc(F.col("doc_id")) % 5) == 0
    return quality.score(docs, quality.learn(docs, labels.filter(~held_out)), QUALITY_LEAST).withColumn("held_out", held_out)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_best_fit_packing, op3_bpe_round_trip, op4_language_mixture, op5_url_filter, op6_suffix_tree_scores,
                                  op7_toxicity, op8_repetition_rules, op9_license_scan, op10_hilbert_neighbours, op11_mask_search,
                                  op12_quality_classifier, op13_hard_negatives)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
ORACLE = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
                     FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * k >= 90 * (na.n + nb.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM r WHERE r.x = n.doc_id) AS component_id FROM n""",
    "op5_url_filter": f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT u.*, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
      FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM j WHERE k = 1""",
    "op11_mask_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
           FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
g AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS gain FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM i JOIN g USING (term) GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
}
