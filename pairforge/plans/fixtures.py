"""Source-shaped tables derived from the driver tables (FIXTURES.md FX1-FX4, FX6, FX7).

Each function reads whole tables; nothing is subset. The reference reads its sources from a hub, which
is not built; these derivations stand in for them with the same column shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.index import group_index
from pairforge.sources.tables import first_assistant_turn

NL = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: duplicate-question shape (k, question1, question2, label) from documents joined with labels:
    question1 = the document's first line, question2 = the whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id")
             .select(F.col("doc_id").alias("k"),
                     F.split_part(F.col("text"), F.lit(NL), F.lit(1)).alias("question1"),
                     F.col("text").alias("question2"),
                     F.col("quality").alias("label")))


def fx_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: captioned-image shape (k, filename, sentences struct{raw}) from pages (caption = the title)."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select(F.col("page_id").alias("k"),
                    F.format_string("page_%06d.jpg", F.col("page_id")).alias("filename"),
                    F.struct(F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("raw")).alias("sentences"))


def fx_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: image-chat shape (k, caption, candidates) from conversations.

    Caption = first assistant turn with text; candidates = conv_%06d.jpg then images/conv_%06d.jpg
    (A7 picks the first that exists when an inventory is given).
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    caps = first_assistant_turn(turns)
    name = F.format_string("conv_%06d.jpg", F.col("conv_id"))
    return caps.select(F.col("conv_id").alias("k"), "caption",
                       F.array(name, F.concat(F.lit("images/"), name)).alias("candidates"))


def fx_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: transcribed-audio shape (k, source, text = the whole document) from all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "source", "text")


def audio_sources(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the transcript sources (one row per source), in name order: the order of their concatenation."""
    names = table(spark, sf_dir, "documents").select("source").distinct().collect()
    return sorted(r[0] for r in names if r[0] is not None)


def fx_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6-like media inventory derived from table attributes (which files 'exist').

    Page images exist for https pages; chat images exist under images/ when the conversation has a
    system turn, else at the root; audio files exist for documents that have a labels row. Every row of
    the tables is considered; which files exist follows from data attributes.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    page_paths = pages.where(F.col("url").startswith("https://")).select(
        F.format_string("page_%06d.jpg", "page_id").alias("path"))
    conv = table(spark, sf_dir, "conversations").select("conv_id", "role")
    sys_flag = conv.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", 1).otherwise(0)).alias("s"))
    chat_paths = sys_flag.select(F.when(F.col("s") == 1, F.format_string("images/conv_%06d.jpg", "conv_id"))
                                  .otherwise(F.format_string("conv_%06d.jpg", "conv_id")).alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    ranked = group_index(docs, ["source"], ["doc_id"], pos_col="idx", size_col=None)
    audio = (ranked.join(lab, "doc_id", "left_semi")
                   .select(F.format_string("%s_%06d.wav", "source", "idx").alias("path")))
    return page_paths.unionByName(chat_paths).unionByName(audio)


#: Rows of a batch of pairs.
PAIR_BATCH = 32


def fx_pairs(spark: SparkSession, sf_dir: str, batch_size: int = PAIR_BATCH) -> DataFrame:
    """FX7: embedding pairs. Every row is used: pair i = vec_id div 2, query = the even id, positive = the odd
    one, or itself for a last vector without a partner (a bounded group of two); batch = pair div batch_size."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    g = (e.groupBy(F.floor(F.col("vec_id") / 2).alias("pair_id"))
          .agg(F.min_by("embedding", "vec_id").alias("q"), F.max_by("embedding", "vec_id").alias("p")))
    return g.select("pair_id", F.floor(F.col("pair_id") / batch_size).alias("batch_id"), "q", "p")


def fx_triples(spark: SparkSession, sf_dir: str, batch_size: int = PAIR_BATCH) -> DataFrame:
    """FX7 triples: negative of pair i = positive of the next pair (ring over pair order, C1)."""
    from pairforge.operators.order import ring_negatives
    pairs = fx_pairs(spark, sf_dir, batch_size)
    return ring_negatives(pairs, [], ["pair_id"], value_col="p", type_col=None, out_value="n")
