"""License scans by a positional index of rare words, with DataFrame functions only.

One pass over the whole texts lists, per file, the places of words that occur in licence templates. Document
frequencies of those words (a table no larger than the templates' vocabulary) give their IDF. Each file looks up,
for each template, its highest-IDF words of that template and always the rarest word of the mandatory key phrase; a
posting (template, place in template) of such a word that stands at place p proposes that the template begins at p
minus that place. So every place of a key phrase is proposed, whatever else the file holds. The shifted place lists of
the key phrase's words are intersected with the proposals; what is left is verified, and its score is the IDF share of
the template's words that stand in line.

Everything about one file happens within its row, in time linear in its licence words (one sort for the scores), so
no group of files meets in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import ascii_lower, staged
from pairforge.session import ensure_checkpoint_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values: (label, notice text, mandatory key phrase) of well-known licence notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]


def _array(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(kind)


def _word_hits(docs: DataFrame, id_col: str, text_col: str, vocab: list[str]) -> DataFrame:
    """(id, n_words, hits: array of (w: index in vocab, p: place)) of each row."""
    words = docs.select(F.col(id_col).alias("_id"),
                        F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)).alias("_words"))
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.cast("int").alias("p"))),
                    lambda x: x["w"].isin(vocab))
    return words.select("_id", F.size("_words").cast("long").alias("n_words"),
                        F.transform(hits, lambda x: F.struct((F.array_position(_array(vocab, "array<string>"), x["w"]) - 1).cast("int").alias("w"),
                                                             x["p"].alias("p"))).alias("hits"))


def _begins(w: int, k: int) -> Column:
    """Where a phrase would begin whose ``k``-th word is the vocabulary word ``w``: its places, shifted."""
    return F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: (h["p"] - k).cast("int"))


def _aligned(codes: list[int], first: int = 0) -> Column:
    """Begins at which all words ``codes`` stand in line, the first of them ``first`` words after the begin."""
    found = _begins(codes[0], first)
    for k, w in enumerate(codes[1:], first + 1):
        found = F.array_intersect(found, _begins(w, k))
    return found


def _if_all(codes: list[int], then: Column, kind: str) -> Column:
    """``then`` where the row has all of the words; not evaluated elsewhere."""
    return F.when(F.size(F.array_except(_array(sorted(set(codes)), "array<int>"), F.col("present"))) == 0, then).otherwise(
        F.expr(f"cast(array() as {kind})"))


def _best_share(begins: Column, codes: list[int], idf: list[float]) -> Column:
    """The largest IDF share in line with one of ``begins``: (begin, weight) of all words, sorted and folded."""
    total = sum(idf[w] for w in codes) or 1.0
    found = F.concat(*[_weighted(F.array_intersect(begins, _begins(w, k)), idf[w] / total) for k, w in enumerate(codes)])
    zero = F.struct(F.lit(None).cast("int").alias("b"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def add(acc, x):
        now = F.when(acc["b"] == x["b"], acc["sum"] + x["v"]).otherwise(x["v"])
        return F.struct(x["b"].alias("b"), now.alias("sum"), F.greatest(acc["best"], now).alias("best"))
    return F.aggregate(F.array_sort(found), zero, add, lambda acc: F.least(F.lit(1.0), acc["best"]))


def _weighted(begins: Column, weight: float) -> Column:
    return F.transform(begins, lambda b: F.struct(b.alias("b"), F.lit(float(weight)).alias("v")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
                  templates: list[tuple[str, str, str]] | None = None, top_words: int = 8, min_share: float = 0.5) -> DataFrame:
    """Find licence phrases and notices in every whole text.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. ``base`` maps phrases to
    labels: all their places count. ``templates`` are (label, notice, key phrase); a notice is found where its key
    phrase stands in line and words with at least ``min_share`` of its IDF do. A file proposes places of each notice
    from its ``top_words`` highest-IDF words of that notice (ties: the word earlier in the vocabulary) and from the
    highest-IDF word of the key phrase. Null and empty texts
    have no words: counts 0, places null, empty labels, score 0. Every input row gives one row (repeated rows and
    null ids too), an empty table none; other columns are not read.

    Returns (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score): score is 1 with a base
    phrase, else the largest share of a found notice, else 0.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    base = BASE_PHRASES if base is None else base
    templates = TEMPLATES if templates is None else templates
    vocab = sorted({w for t in [*base, *(t[1] for t in templates)] for w in t.split()})
    code = {w: i for i, w in enumerate(vocab)}
    codes = lambda text: [code[w] for w in text.split()]

    rows = staged(_word_hits(docs, id_col, text_col, vocab), "license-hits")
    rows = rows.withColumn("present", F.array_distinct(F.transform("hits", lambda h: h["w"])))

    # document frequencies: at most len(vocab) rows, by construction
    n_docs = max(1, rows.count())
    freq = {r["w"]: r["n"] for r in rows.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = [math.log((1 + n_docs) / (1 + freq.get(i, 0))) for i in range(len(vocab))]
    by_idf = lambda ws: sorted(set(ws), key=lambda i: (-idf[i], i))

    found = {p: _if_all(codes(p), _aligned(codes(p)), "array<int>") for p in base}
    out = rows.select("_id", "n_words", "hits", "present", *[found[p].alias(f"base{i}") for i, p in enumerate(base)])

    verified, shares = [], []
    for i, (_, notice, key) in enumerate(templates):
        words, key_words = codes(notice), codes(key)
        at = next(k for k in range(len(words)) if words[k:k + len(key_words)] == key_words)
        top = F.slice(F.array_intersect(_array(by_idf(words), "array<int>"), F.col("present")), 1, top_words)
        rarest = by_idf(key_words)[0]
        proposed = F.concat(*[_begins(w, k) if w == rarest else
                              F.when(F.array_contains(top, w), _begins(w, k)).otherwise(F.expr("cast(array() as array<int>)"))
                              for k, w in enumerate(words)])
        verified.append(_if_all(key_words, F.array_intersect(_aligned(key_words, at), proposed), "array<int>").alias(f"v{i}"))
        shares.append(F.when(F.size(f"v{i}") > 0, _best_share(F.col(f"v{i}"), words, idf)).otherwise(F.lit(0.0)).alias(f"s{i}"))
    out = out.select("*", *verified).select("*", *shares)

    base_set = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.size(f"base{i}") > 0, F.lit(x)) for i, x in enumerate(base.values())]))
    notes = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when((F.col(f"s{i}") > 0) & (F.col(f"s{i}") >= min_share), F.lit(t[0]))
                                                                  for i, t in enumerate(templates)]))
    places = F.flatten(F.array(*[F.col(f"base{i}") for i in range(len(base))], F.expr("cast(array() as array<int>)")))
    best = F.array_max(F.array(F.lit(0.0), *[F.when(F.col(f"s{i}") >= min_share, F.col(f"s{i}")).otherwise(0.0) for i in range(len(templates))]))
    return out.select("_id", "n_words", places.alias("places"), base_set.alias("base"), notes.alias("notes"), best.alias("best")).select(
        F.col("_id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", "notes"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("best")).alias("score"))
