import collections

import corpus_pipeline
from pairforge.llm import jaccard, language, queries, toxicity
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    net, model = queries.toxicity_network(spark, SF), queries.language_profiles(spark, SF)
    ids = list(rows)
    clean = [i for i, s in zip(ids, toxicity.Scorer(net).scores([rows[i] for i in ids])) if s < 0.5]
    named = [i for i in clean if max(language.infer(rows[i], model).values(), default=0) >= 0.4]
    left = sorted({c for _, _, c in brute([(i, rows[i]) for i in named], 5, 80, 100)})
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, (clean, named, left)):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns and sorted(r.doc_id for r in now.collect()) == sorted(want), name
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in packed}) == left
    use = collections.Counter()
    for r in packed:
        use[r.sequence_id] += r.length
    assert max(use.values()) <= queries.PACK_TOKENS


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, df, SF)
            assert got.schema == df.schema
            got.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= (df.count() and 1)


def test_near_copies_keep_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(7, text), (3, text + " more"), (3, text + " more"), (9, "w1 w2"), (None, text), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, text + " more"), (9, "w1 w2"), (None, None)]))
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_a_tasks_end_gives_memory_back(monkeypatch):
    """After the last batch of a task, and not before it."""
    from pairforge.llm import common
    given = []
    monkeypatch.setattr(common, "_give_back", lambda: given.append(1))
    seen = []
    for x in common.giving_back(lambda batches: (2 * b for b in batches))(iter([1, 2, 3])):
        seen.append((x, len(given)))
    assert seen == [(2, 0), (4, 0), (6, 0)] and given == [1]


def test_language_keeps_nothing_of_the_operator_before(spark, monkeypatch):
    """The word table of the toxicity stage isn't held while the language stage runs."""
    import pyarrow as pa
    from pairforge.llm import common

    class Table:
        """Hands out the function that tasks run."""
        sparkSession, columns, dtypes, schema = spark, ["doc_id", "text"], [("doc_id", "bigint"), ("text", "string")], None

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run
    model = language.learn_profiles(spark.createDataFrame([(0, "the cat sat on the mat", "en")], "doc_id long, text string, lang string"))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["the cat sat on the mat"])], names=["doc_id", "text"])
    for run in (language.keep_identified(Table(), model), language.identify(Table(), model)):
        monkeypatch.setattr(common, "_STATE", {"before": 1})
        assert sum(b.num_rows for b in run(iter([batch]))) == 1
        assert common._STATE == {None: None}
