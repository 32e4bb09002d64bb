import random

import pytest
from pyspark.sql import functions as F

from strandex.functions.storage import shared_path
from strandex.operators import index, store

from .graph_cases import graph


def made(n=3000):
    rng = random.Random(9)
    return [("hot" if i % 3 else rng.choice("abcd"), i * 7) for i in range(n)]


@pytest.fixture(scope="module")
def saved(spark):
    pairs = spark.createDataFrame(made() + made()[:0], "kmer string, loc long")
    return store.save_index(pairs, 3, shared_path(spark, "index"), buckets=8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_posting_blocks(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("b", 2)] + [("c", i) for i in range(25)], "kmer string, loc long")
    got = sorted(map(tuple, store.posting_blocks(rows, block=10).collect()))
    assert got == [("a", 0, 2, 1, 5, [1, 5]), ("b", 0, 1, 2, 2, [2]), ("c", 0, 10, 0, 9, list(range(10))), ("c", 1, 10, 10, 19, list(range(10, 20))), ("c", 2, 5, 20, 24, list(range(20, 25)))]
    assert store.posting_blocks(rows.limit(0)).count() == 0


def test_lookups(spark, saved):
    rows = made()
    words = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3), (None, 4)], "kmer string, tag int")
    assert sorted((r.kmer, r.loc, r.tag) for r in store.locations_of(words, saved).collect()) == sorted((k, x, {"hot": 1, "a": 2}[k]) for k, x in rows if k in ("hot", "a"))
    own = {k: [x for w, x in rows if w == k] for k in ("hot", "a")}
    assert {(r.kmer, r.n, r.first, r.last) for r in store.counts_of(words, saved).collect()} == {(k, len(x), min(x), max(x)) for k, x in own.items()}
    assert {r.kmer: r.found for r in store.contained(words, saved).collect()} == {"hot": True, "a": True, "zz": False, None: False}
    locs = spark.createDataFrame([(0,), (7,), (8,)], "loc long")
    assert {(r.loc, r.kmer) for r in store.words_of(locs, saved).collect()} == {(x, k) for k, x in rows if x in (0, 7)}
    assert {r.kmer: (r.n, r.locs) for r in store.listed(saved).collect()} == {k: (len(x), ",".join(map(str, x))) for k in {k for k, _ in rows} for x in [sorted(x for w, x in rows if w == k)]}
    assert saved.num_pairs == len(rows) and max(r.n for r in saved.words.collect()) <= store.BLOCK and saved.words.where("kmer = 'hot'").count() == 2


def test_index_side_stays_in_place_and_few_keys_read_few_buckets(spark, saved):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.createDataFrame([("hot",), ("b",)], "kmer string")
        shown = plan(store.locations_of(few, saved))
        assert "SelectedBucketsCount: 2 out of 8" in shown or "SelectedBucketsCount: 1 out of 8" in shown
        many = spark.range(1000).select(F.col("id").cast("string").alias("kmer"))
        shown = plan(store.locations_of(many, saved))
        index_side = shown[shown.rindex("Sort", 0, shown.index("FileScan parquet spark_catalog")) :]
        assert "SelectedBucketsCount: 8 out of 8" in shown and shown.count("Exchange") == 1 and "Exchange" not in index_side
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_opened_again(spark, saved):
    again = store.open_index(spark.newSession(), saved.path)
    assert (again.k, again.buckets, again.num_pairs) == (3, 8, 3000)
    assert sorted(map(tuple, again.places.collect())) == sorted((x, k) for k, x in made())
    with pytest.raises(Exception):
        store.save_index(saved.places.select("kmer", "loc"), 3, saved.path)


def test_saved_graph(spark):
    g = graph(spark, ["acgtacgt", "gg"], [(0, 1), (1, 0)])
    pairs = index.build_pairs(g, 3)
    kept = store.save_index(pairs, 3, shared_path(spark, "index"))
    assert sorted(map(tuple, kept.places.select("kmer", "loc").collect())) == sorted(map(tuple, pairs.collect()))
