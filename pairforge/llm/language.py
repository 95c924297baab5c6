"""Language identification by multilingual mixture inference.

Profiles are smoothed distributions of hashed byte trigrams per language, counted over all learning rows: tasks add
up counts, and one row per (language, bucket) is summed in Spark, so the model's size is languages x buckets.
A document is a mixture of languages: expectation-maximisation estimates the proportions from its trigrams'
likelihoods. The set of languages grows from the best single one; another language is tried only if the
likelihood rises towards it, and stays if the gain beats a penalty of ``PENALTY * log(trigrams)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import giving_back, worker_state
from pairforge.session import ensure_checkpoint_dir

BUCKETS = 1 << 13
#: Trigrams overlap, so each byte is counted about three times: three times the usual half a log per parameter.
PENALTY = 1.5
ROUNDS = 20
_LETTER = re.compile(r"[^\W\d_]")
_GAPS = re.compile(rb"[\x00-@\[-`{-\x7f]+")


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text; runs of ASCII non-letters count as one space."""
    raw = b" " + _GAPS.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip() + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass
class Profiles:
    languages: list[str]
    p: np.ndarray  # (buckets, languages): probability of a trigram


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.5) -> Profiles:
    """Count trigrams over all rows with a language. The result has one row of ``BUCKETS`` numbers per language."""
    ensure_checkpoint_dir(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])],
                                             names=["lang", "bucket", "n"])
    rows = (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
            .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    languages = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(languages)}
    n = np.full((BUCKETS, len(languages)), smooth)
    for r in rows:
        n[r["bucket"], at[r["lang"]]] += r["n"]
    return Profiles(languages, n / n.sum(axis=0))


def _em(c: np.ndarray, p: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions and log likelihood of counts ``c`` under the columns of ``p``."""
    total, last = c.sum(), -np.inf
    for _ in range(ROUNDS):
        s = p @ mix
        like = float(c @ np.log(s))
        if like - last < 1e-4 * total:
            break
        last = like
        mix = mix * (p.T @ (c / s)) / total
    return mix, float(c @ np.log(p @ mix))


def infer(text: str, model: Profiles) -> dict[str, float]:
    """Proportions of the selected languages, largest first; empty without letters."""
    if not model.languages or not _LETTER.search(text):
        return {}
    grams = trigrams(text)
    at, c = np.unique(grams, return_counts=True) if len(grams) < 2000 else _counts(grams)
    c = c.astype(float)
    total = c.sum()
    p = model.p[at]
    single = c @ np.log(p)
    chosen = [int(np.argmax(single))]
    mix, like = np.ones(1), float(single[chosen[0]])
    while len(chosen) < p.shape[1]:
        s = p[:, chosen] @ mix
        rise = p.T @ (c / s) - total  # how the likelihood rises when a little of a language is mixed in
        rise[chosen] = 0
        new = int(np.argmax(rise))
        if rise[new] <= 0:
            break
        mix2, like2 = _em(c, p[:, [*chosen, new]], np.append(0.9 * mix, 0.1))
        if like2 - like <= PENALTY * np.log(total):
            break
        chosen, mix, like = [*chosen, new], mix2, like2
    order = sorted(range(len(chosen)), key=lambda i: (-mix[i], chosen[i]))
    return {model.languages[chosen[i]]: float(mix[i]) for i in order}


def _counts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def identify(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: (id_col, lang_pred, score, languages).

    ``lang_pred`` is the language with the largest proportion (ties: the first name) and ``score`` that proportion;
    ``languages`` is the selected set as name:proportion, comma-joined. Null texts, texts without a letter, and
    all texts of a model without languages give ``und``, 0 and an empty set. Every row gives one row (repeated rows,
    null ids); an empty table none; other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)  # nothing is kept from an operator before
        m = shared.value
        for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            got = [infer(t, m) if t else {} for t in b.column(1).to_pylist()]
            top = [next(iter(g.items()), ("und", 0.0)) for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t[0] for t in top], pa.string()), pa.array([min(1.0, t[1]) for t in top], pa.float64()),
                 pa.array([",".join(f"{k}:{v:.3f}" for k, v in g.items()) for g in got], pa.string())],
                names=[id_col, "lang_pred", "score", "languages"])
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, languages string")


def keep_identified(docs: DataFrame, model: Profiles, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has a language of at least the proportion ``least``. Null and empty texts, and
    texts without a letter, have none and go; each row is judged on its own, so repeated rows and null ids stay or go alike;
    an empty table stays empty."""
    ensure_checkpoint_dir(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(None, lambda: None)  # nothing is kept from an operator before
        m = shared.value
        for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
            yield b.filter(pa.array([max(infer(t, m).values(), default=0.0) >= least if t else False for t in b.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(giving_back(run), docs.schema)
