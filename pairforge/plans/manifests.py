"""The flagship plan (T1 on the driver tables): text, image and audio sources -> interleaved manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.plans.assemble import Manifest, assemble
from pairforge.plans.fixtures import audio_sources, fx_captions, fx_chats, fx_questions, fx_transcripts
from pairforge.sources.tables import caption_pairs, chat_caption_pairs, qqp_pairs, transcript_pairs


def source_groups(spark: SparkSession, sf_dir: str, inventory: DataFrame | None = None, values: bool | str = True):
    """FX8 groups: text = questions; image = captions then chat; audio = every transcript source, by name."""
    text = qqp_pairs(fx_questions(spark, sf_dir))
    captions = caption_pairs(fx_captions(spark, sf_dir), inventory=inventory, source="caption")
    chats = chat_caption_pairs(fx_chats(spark, sf_dir), inventory=inventory, source="chat")
    audio = transcript_pairs(fx_transcripts(spark, sf_dir), "transcripts", source_col="source", values=values is True)
    return [("text", [text]), ("image", [captions, chats]), ("audio", [(audio, audio_sources(spark, sf_dir))])]


def training_manifest(spark: SparkSession, sf_dir: str, val_fraction: float | None = 0.1,
                      inventory: DataFrame | None = None, values: bool | str = True) -> Manifest:
    """The interleaved manifest; ``values=False`` gives the positional skeleton (no value columns checkpointed), ``"media"`` the
    skeleton with the paths of media items."""
    return assemble(source_groups(spark, sf_dir, inventory, values), val_fraction, values=values)
