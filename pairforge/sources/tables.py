"""Source builders A2-A5: turn source-shaped tables into (query, positive) records.

Output record columns (the manifest row shape used everywhere):
``k`` (the source's own order key), ``query_type``, ``query_value``, ``positive_type``, ``positive_value``,
``source`` (nullable lineage tag). Ring negatives (C1) are added by the caller after filter and limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.operators.index import group_index, take_first

# Fixed values (must equal the reference's registered speech sources):
# name -> splits concatenated in this order, transcript column, audio file prefix, optional source.
TRANSCRIPT_CONFIGS = {
    "librispeech_clean": {"splits": ["train.100", "train.360"], "text_column": "text", "prefix": "librispeech", "optional": False},
    "librispeech_other": {"splits": ["train.500"], "text_column": "text", "prefix": "librispeech_other", "optional": False},
    "voxpopuli": {"splits": ["train"], "text_column": "raw_text", "prefix": "voxpopuli", "optional": False},
    "tedlium": {"splits": ["train"], "text_column": "text", "prefix": "tedlium", "optional": True},
    "peoples_speech": {"splits": ["train"], "text_column": "text", "prefix": "peoples_speech", "optional": True},
    "common_voice": {"splits": ["train"], "text_column": "sentence", "prefix": "common_voice", "optional": True},
    "gigaspeech": {"splits": ["train"], "text_column": "text", "prefix": "gigaspeech_xs", "optional": True},
}

RECORD_COLUMNS = ["k", "query_type", "query_value", "positive_type", "positive_value", "source"]


def _record(k: Column, qtype: str, qvalue: Column, pvalue: Column, source: Column | None) -> list[Column]:
    return [k.alias("k"), F.lit(qtype).alias("query_type"), qvalue.cast("string").alias("query_value"),
            F.lit("text").alias("positive_type"), pvalue.cast("string").alias("positive_value"),
            (source if source is not None else F.lit(None).cast("string")).alias("source")]


def qqp_pairs(df: DataFrame, limit: int = 0, key: str = "k") -> DataFrame:
    """A2: duplicate-question pairs. Keep label = 1 (missing label counts as 0); limit after the filter.

    Input: ``question1``, ``question2``, ``label`` and an order key. Text rows carry no source.
    """
    # missing label = 0, i.e. not kept: ``label = 1`` is the same predicate and reaches the parquet scan
    kept = df.where(F.col("label").cast("int") == 1)
    kept = take_first(kept, limit, [key])
    return kept.select(*_record(F.col(key), "text", F.col("question1"), F.col("question2"), None))


def _first_caption(sentences_type: T.DataType) -> Column:
    """Caption rule: ``sentences.raw`` if a struct, else the first element's ``raw``, else the first string."""
    s = F.col("sentences")
    if isinstance(sentences_type, T.StructType):
        return s.getField("raw")
    if isinstance(sentences_type, T.ArrayType):
        first = F.try_element_at(s, F.lit(1))
        if isinstance(sentences_type.elementType, T.StructType):
            return first.getField("raw")
        return first.cast("string")
    return s.cast("string")


def caption_pairs(df: DataFrame, inventory: DataFrame | None = None, limit: int = 0, key: str = "k",
                  image_root: str | None = None, source: str = "coco") -> DataFrame:
    """A3: captioned images. Limit *before* the filter; skip empty captions and files that do not exist.

    Input: ``sentences`` (struct{raw} | array<struct{raw}> | array<string>), ``filename`` and/or ``filepath``,
    an order key. ``inventory`` is a table of existing paths (column ``path``); None skips the check.
    """
    limited = take_first(df, limit, [key])
    names = [c for c in ("filename", "filepath") if c in df.columns]
    # ``filename or filepath`` with Python truthiness: an empty filename falls back to the filepath
    fname = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names]) if names else F.lit(None).cast("string")
    if image_root:
        # os.path.join semantics: an absolute name ignores the root; one separator is added when missing
        base = image_root if image_root.endswith("/") else image_root + "/"
        path = F.when(fname.startswith("/"), fname).otherwise(F.concat(F.lit(base), fname))
    else:
        path = fname
    caption = F.coalesce(_first_caption(df.schema["sentences"].dataType), F.lit(""))
    rows = limited.select(F.col(key).alias("_k"), path.alias("_path"), caption.alias("_caption"))
    rows = rows.where((F.col("_caption") != "") & F.col("_path").isNotNull())
    if inventory is not None:
        rows = rows.join(inventory.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi")
    return rows.select(*_record(F.col("_k"), "image", F.col("_path"), F.col("_caption"), F.lit(source)))


def first_assistant_turn(turns: DataFrame, conv_key: str = "conv_id", role_value: str = "assistant") -> DataFrame:
    """A4 (flat form): caption = text of the lowest turn with the assistant role and a non-empty text.

    ``min_by`` with a FILTER is a partial/final aggregate, so a conversation with many turns never
    gathers in one task before the map-side combine.
    """
    ok = (F.col("role") == role_value) & (F.col("text") != "")
    return (turns.where(ok).groupBy(conv_key)
                 .agg(F.min_by("text", "turn").alias("caption")))


def chat_caption_pairs(df: DataFrame, inventory: DataFrame | None = None, limit: int = 0, key: str = "k",
                       source: str = "llava_cc3m") -> DataFrame:
    """A4: image-chat captions. Input: ``caption`` (first assistant turn, see ``first_assistant_turn``) or a
    nested ``conversations`` array<struct<from,value>>, and ``candidates`` (ordered candidate paths) or
    ``image``. Skip rows without image, file or caption; path = first existing candidate (A7); limit after.
    """
    if "caption" in df.columns:
        caption = F.col("caption")
    else:
        turns = F.filter("conversations", lambda t: (t.getField("from") == "gpt") & (t.getField("value") != ""))
        caption = F.try_element_at(turns, F.lit(1)).getField("value")
    if "candidates" in df.columns:
        cands = F.col("candidates")
    else:
        cands = F.array(F.col("image"))
    rows = df.select(F.col(key).alias("_k"), caption.alias("_caption"), cands.alias("_cands"))
    rows = rows.where(F.col("_caption").isNotNull() & (F.col("_caption") != ""))
    if inventory is not None:
        from pairforge.operators.media import first_existing
        rows = first_existing(rows, "_cands", inventory, key="_k", out_col="_path")
    else:
        rows = rows.withColumn("_path", F.try_element_at(F.filter("_cands", lambda c: c.isNotNull() & (c != "")), F.lit(1)))
    rows = rows.where(F.col("_path").isNotNull())
    rows = take_first(rows, limit, ["_k"])
    return rows.select(*_record(F.col("_k"), "image", F.col("_path"), F.col("_caption"), F.lit(source)))


def transcript_pairs(df: DataFrame | list[DataFrame], name: str, limit: int = 0, key: str = "k",
                     text_col: str | None = None, prefix: str | None = None, source_col: str | None = None,
                     values: bool = True) -> DataFrame:
    """A5: transcribed audio. Splits (a list of DataFrames) are concatenated in order; limit *before* the
    empty-text filter; file ``{prefix}_{idx:06d}.wav`` where idx counts rows before the filter (0-based, in
    (split, key) order).

    With ``source_col`` one call handles many sources at once: idx restarts per source and the prefix is
    the source value (``name`` is then unused for paths).

    Only the keys and whether there is a text are indexed; the texts are joined back to them afterwards, or left out
    (null) with ``values=False``. (split, key) is unique within a source.
    """
    cfg = TRANSCRIPT_CONFIGS.get(name, {})
    text_col = text_col or cfg.get("text_column", "text")
    if isinstance(df, list):
        parts = [d.withColumn("_split", F.lit(i)) for i, d in enumerate(df)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        order = ["_split", key]
    else:
        order = [key]
    group = [source_col] if source_col else []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ix = group_index(df.select(*group, *order, (text != "").alias("_ok")), group, order, pos_col="_idx", size_col=None)
    if limit and limit > 0:
        ix = ix.where(F.col("_idx") < limit)
    rows = ix.where("_ok").drop("_ok")
    if values:
        texts = df.select(*[F.col(c).alias(f"_t_{c}") for c in (*group, *order)], text.alias("_text"))
        rows = rows.join(texts, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in (*group, *order)])
    else:
        rows = rows.withColumn("_text", F.lit(None).cast("string"))
    pfx = F.col(source_col) if source_col else F.lit(prefix or cfg.get("prefix", name))
    path = F.format_string("%s_%06d.wav", pfx, F.col("_idx"))
    src = F.col(source_col) if source_col else F.lit(name)
    return rows.select(*_record(F.col(key), "audio", path, F.col("_text"), src))
