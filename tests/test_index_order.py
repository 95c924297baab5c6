"""P1, C1, C2, C3 invariants against brute force on the sf0.001 tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from pairforge.operators.index import global_index, group_index, take_first
from pairforge.operators.order import interleave, positional_split, ring_negatives, split_point


def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "lang", "source", "text")


def test_global_index_matches_row_number(spark):
    d = docs(spark)
    ix = global_index(d, ["lang", "doc_id"], num_partitions=7)
    got = {r.doc_id: r.idx for r in ix.df.collect()}
    want = {r.doc_id: r.rn - 1 for r in d.select("doc_id", F.row_number().over(
        Window.orderBy("lang", "doc_id")).alias("rn")).collect()}
    assert ix.total == d.count() == len(got)
    assert got == want


def test_group_index_restarts_per_group(spark):
    g = group_index(docs(spark), ["source"], ["doc_id"], pos_col="pos", size_col="n").collect()
    by = {}
    for r in g:
        by.setdefault(r.source, []).append((r.doc_id, r.pos, r.n))
    for rows in by.values():
        rows.sort()
        assert [p for _, p, _ in rows] == list(range(len(rows)))
        assert {n for _, _, n in rows} == {len(rows)}


def test_take_first_is_ordered_cap(spark):
    d = docs(spark)
    got = sorted(r.doc_id for r in take_first(d, 17, ["doc_id"]).collect())
    assert got == sorted(r.doc_id for r in d.orderBy("doc_id").limit(17).collect())
    assert take_first(d, 0, ["doc_id"]).count() == d.count()  # source limits: 0 = all


def test_ring_negatives_wrap(spark):
    d = docs(spark).withColumn("first", F.split_part("text", F.lit("\n"), F.lit(1)))
    rows = ring_negatives(d, ["source"], ["doc_id"], value_col="first", type_col=None).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for grp in by.values():
        grp.sort(key=lambda r: r.doc_id)
        if len(grp) == 1:
            assert grp[0].negative_value is None
            continue
        for i, r in enumerate(grp):
            assert r.negative_value == grp[(i + 1) % len(grp)].first


def test_interleave_is_round_robin_permutation(spark):
    d = docs(spark)
    groups = [d.where(F.col("lang") == lang) for lang in ("en", "fr", "de", "es")]
    rows = interleave(groups, ["doc_id"]).collect()
    assert sorted(r.idx for r in rows) == list(range(d.count()))
    lists = [sorted(r.doc_id for r in g.collect()) for g in groups]
    expect = []
    for p in range(max(len(x) for x in lists)):
        for x in lists:
            if p < len(x):
                expect.append(x[p])
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.idx)] == expect


def test_split_truncates_in_double():
    assert split_point(90, 0.3) == int(90 * (1.0 - 0.3)) == 62
    assert split_point(1, 0.5) == 1
    assert split_point(839, 0.1) == 755


def test_positional_split_partitions_rows(spark):
    ix = global_index(docs(spark), ["doc_id"])
    s = positional_split(ix.df, ix.total, 0.25).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in s}
    assert counts["train"] == split_point(ix.total, 0.25)
    assert counts["train"] + counts.get("val", 0) == ix.total


def test_index_partitions_setting(spark):
    d = docs(spark)
    spark.conf.set("pairforge.index.partitions", "3")
    try:
        ix = global_index(d, ["doc_id"])
        assert ix.df.rdd.getNumPartitions() == 3
        assert sorted(r.idx for r in ix.df.collect()) == list(range(d.count()))
    finally:
        spark.conf.unset("pairforge.index.partitions")


def test_join_bounded_both_paths(spark):
    from pairforge.operators.joins import join_bounded
    d = docs(spark)
    small = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    broadcast = join_bounded(d, small, ["source"])
    regular = join_bounded(d, small, ["source"], max_rows=0)  # over the bound: a regular join
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in broadcast.collect()) == sorted(tuple(r) for r in regular.collect())


def test_ring_takes_the_next_row_where_it_lies(spark):
    """No row is shuffled for its negative, over groups of one, two and many rows, over several partitions, with null values and arrays."""
    from pyspark.sql import functions as F

    from pairforge.operators.index import group_index
    from pairforge.operators.order import ring_join, ring_negatives

    rows = [(g, k, "text" if k % 3 else None, f"{g}{k}" if k % 5 else None, [float(k)]) for g, n in (("a", 1), ("b", 2), ("c", 400), (None, 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, positive_type string, positive_value string, v array<double>").repartition(7)
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        for i, r in enumerate(own):
            nxt = own[(i + 1) % len(own)]
            want[g, r[1]] = (nxt[2], nxt[3], nxt[4]) if len(own) > 1 else (None, None, None)
    spark.conf.set("pairforge.index.partitions", "9")
    try:
        ix = group_index(df, ["g"], ["k"], pos_col="p", size_col="n", gidx_col="i", start_col="s")
        out = ring_join(ix, "i", "s", "p", "n")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
        arrays = {(r.g, r.k): r.o for r in ring_negatives(df, ["g"], ["k"], value_col="v", type_col=None, out_value="o").collect()}
        # rows that don't lie in the order of the index any more are joined on it
        moved = ring_join(ix.repartition(5, F.col("k")), "i", "s", "p", "n")
        for got in (out, moved):
            found = {(r.g, r.k): (r.negative_type, r.negative_value) for r in got.collect()}
            assert found == {key: v[:2] for key, v in want.items()}
    finally:
        spark.conf.unset("pairforge.index.partitions")
    assert arrays == {key: v[2] for key, v in want.items()}
