import os
import random

import pytest
from pyspark.sql import functions as F

from strandex.operators import index, stats

from .graph_cases import all_walks, graph


def pairs_of(df):
    return {(r.kmer, r.loc) for r in df.collect()}


@pytest.mark.parametrize(
    "segs, edges, k, expected",
    [
        (["acgtacgtac"], [], 4, {("acgt", 4), ("acgt", 8), ("cgta", 5), ("cgta", 9), ("gtac", 6), ("gtac", 10), ("tacg", 7)}),
        (["a", "cg", "t", "ac"], [(0, 1), (0, 2), (1, 3), (2, 3)], 4, {("acga", 5), ("atac", 6), ("cgac", 6)}),
        (["acg", "c", "g"], [(0, 1), (0, 2)], 4, {("acgc", 5), ("acgg", 6)}),
        (["ac", "gt", "at"], [(0, 1), (1, 2)], 2, {("ac", 2), ("cg", 3), ("gt", 4), ("ta", 5), ("at", 6)}),
        (["ac", "gt", "at"], [(0, 1), (1, 2)], 3, {("acg", 3), ("cgt", 4), ("gta", 5), ("tat", 6)}),
    ],
)
def test_goldens(spark, segs, edges, k, expected):
    assert pairs_of(index.build_pairs(graph(spark, segs, edges).extended(), k)) == expected


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    segs = ["".join(rng.choice("acgt") for _ in range(rng.randint(1, 6))) for _ in range(8)]
    edges = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(12)})
    k = rng.randint(2, 5)
    g = graph(spark, segs, edges)
    assert pairs_of(index.build_pairs(g, k)) == all_walks(segs, edges, k)
    assert pairs_of(index.cut_pairs(g, k, 0)) == all_walks(segs, edges, k)


@pytest.mark.parametrize(
    "segs, edges, k",
    [
        (["ca", "c", "a", "gtacca"], [(0, 3), (1, 2), (2, 3), (3, 0)], 3),  # one pair over two and over three nodes
        (["acgtacg", "a"], [(0, 0), (0, 1), (1, 0), (1, 1), (0, 1)], 2),  # loops, an edge twice, words inside and across
    ],
)
def test_each_pair_once(spark, segs, edges, k):
    rows = [(r.kmer, r.loc) for r in index.build_pairs(graph(spark, segs, edges), k).collect()]
    assert sorted(rows) == sorted(all_walks(segs, edges, k))


def test_empty_segments(spark):
    """Walks go through nodes without letters and never begin in one; each pair once."""
    got = index.build_pairs(graph(spark, ["acg", "", "ttgca"], [(0, 1), (1, 2)]), 3).collect()
    assert sorted((r.kmer, r.loc) for r in got) == sorted(all_walks(["acg", "ttgca"], [(0, 1)], 3))


def test_early_cut(spark):
    segs = list("agctagct")
    edges = [(a, b) for layer in range(3) for a in (2 * layer, 2 * layer + 1) for b in (2 * layer + 2, 2 * layer + 3)]
    starts = spark.createDataFrame([(0, 0), (1, 0)], "node_id long, pos int")
    got = pairs_of(index.cut_pairs(graph(spark, segs, edges).extended(), 4, 8, starts))
    assert got == {(w, l) for w in ("aca", "acg", "ata", "atg", "gca", "gcg", "gta", "gtg") for l in (6, 7)}


def test_long_nodes_are_chunked(spark):
    seg = "".join(random.Random(1).choice("acgt") for _ in range(700))
    nodes = graph(spark, [seg], []).nodes.withColumn("node_start", F.lit(0).cast("long"))
    assert pairs_of(index.inside(nodes, 5, 64)) == {(seg[i : i + 5], i + 5) for i in range(695)}


def test_reachable(spark):
    g = graph(spark, ["ac", "gt", "aa", "cc"], [(0, 1), (2, 3), (3, 2)])
    places = index.reachable_places(g, spark.createDataFrame([(0,)], "node_id long"))
    assert pairs_of(index.build_pairs(g, 2, places)) == {("ac", 2), ("cg", 3)}


def make(spark, rows):
    return spark.createDataFrame(rows, "kmer string, loc long")


def test_presence_and_lookup(spark):
    pairs = make(spark, [("aac", 1), ("aat", 2), ("ata", 3), ("cgt", 4), ("tat", 5)])
    assert {r.prefix for r in index.prefixes(pairs, 3).collect()} == {"", "a", "aa", "at", "c", "cg", "t", "ta"}
    inner = pairs.union(make(spark, [("g", 6), ("ta", 7)]))
    assert {r.prefix for r in index.prefixes(inner, 3).collect()} == {"", "a", "aa", "at", "c", "cg", "t", "ta", "g"}
    words = spark.createDataFrame([("aac",), ("tat",), ("ta",), ("tta",), ("ttttt",)], "kmer string")
    assert {r.kmer: r.found for r in index.trie_contains(words, inner, 3).collect()} == {"aac": True, "tat": True, "ta": True, "tta": False, "ttttt": False}
    assert {r.loc for r in index.locations_for(spark.createDataFrame([("ta",), ("tta",)], "kmer string"), inner).collect()} == {7}
    assert {(r.loc, r.found) for r in index.contains(spark.createDataFrame([(1,), (9,)], "loc long"), pairs, "loc").collect()} == {(1, True), (9, False)}


def test_multimap_and_offsets(spark):
    m = spark.createDataFrame([(0, 5), (1, 7), (1, 6), (5, 8), (1, 6)], "kmer long, loc long")
    assert {r.kmer: (r["values"], r.n) for r in index.multimap(m).collect()} == {0: ([5], 1), 1: ([6, 7], 2), 5: ([8], 1)}
    keys = spark.createDataFrame([(k,) for k in (0, 0, 0, 1, 1, 5, 7)], "k long")
    assert [r.offset for r in index.offsets(keys, "k", 7).orderBy("key").collect()] == [3, 5, 5, 5, 5, 6, 6, 7]


def test_names(spark):
    assert index.starts_of("BT") == "all" and index.starts_of("node_bfs") == "reachable" and index.starts_of("PBFS") == "cut"
    with pytest.raises(ValueError, match="unknown algorithm"):
        index.starts_of("x")


def test_builders_by_name(spark):
    g = graph(spark, ["ac", "gt", "aa", "cc"], [(0, 1), (2, 3), (3, 2), (3, 0)])
    everywhere = all_walks(["ac", "gt", "aa", "cc"], [(0, 1), (2, 3), (3, 2), (3, 0)], 3)
    assert pairs_of(index.build(g, 3, "bt")) == pairs_of(index.build(g, 3, "pbfs", cut=0)) == everywhere
    apart = graph(spark, ["ac", "gt", "aa", "cc"], [(0, 1), (2, 3), (3, 2), (3, 1)])
    assert pairs_of(index.build(apart, 3, "NBFS")) == {("acg", 3)}


def test_substrings(spark):
    rows = spark.createDataFrame([("acgac",), ("",)], "seg string")
    assert {r.kmer for r in index.substrings(rows, 3, 2).collect()} == {"", "a", "c", "g", "ac", "cg", "ga", "acg", "cga", "gac"}


def test_stats(spark):
    pairs = make(spark, [("aa", 1), ("aa", 2), ("aa", 3), ("ac", 1)])
    assert index.depth_of(graph(spark, ["acgt"], [])) == 1
    assert stats.index_stats(pairs).first().asDict() == {"num_kmers": 2, "num_pairs": 4, "num_locs": 3, "ff": 2 / 3}
    assert [tuple(r) for r in stats.histogram_of(pairs, "kmer").orderBy("bin").collect()] == [(0, 1, 1, 1, 1), (1, 1, 3, 2, 4)]
    with pytest.raises(Exception, match="negative"):
        stats.power_histogram(spark.createDataFrame([(-1,)], "v long"), "v").collect()
    assert stats.total_words(4) == 256 and stats.total_words(2, shorter=True) == 21


def scans(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Relation [")


def test_plans_do_not_grow_with_rounds(spark):
    """A walk over many short nodes takes a round each; the driver's plan reads them by one scan, and reached nodes are kept, not found anew for each use."""
    g = graph(spark, ["a"] * 8, [(i, i + 1) for i in range(7)]).saved()
    start = spark.createDataFrame([(0,)], "node_id long")
    found = index.build(g, 7, "node_bfs", start)
    assert scans(found) <= 6 and pairs_of(found) == {("a" * 7, 7)}


def test_stored_tables_have_no_mark(spark):
    """Each mark would start processes beside the driver's where Hadoop's native library is missing."""
    from strandex.functions.storage import stored, together

    one, two = stored(spark.range(2), "a"), stored(spark.range(3), "b")
    assert "_SUCCESS" not in os.listdir(one.stored_path.removeprefix("file:"))
    assert together(one, two).count() == 5 and scans(together(one, two)) == 1


def test_plan_of_cut_words_does_not_grow_with_rounds(spark):
    g = graph(spark, ["a"] * 8, [(i, i + 1) for i in range(7)]).saved()
    found = index.cut_pairs(g, 7, 128)
    assert scans(found) <= 5 and pairs_of(found) == {("a" * 7, 7)}


def test_stats_as_words_are_built(spark):
    """The numbers of the saved pairs, from words that no table holds; the queries of counts save no index."""
    rng = random.Random(4)
    segs = ["".join(rng.choice("acgt") for _ in range(rng.randint(1, 9))) for _ in range(8)]
    g = graph(spark, segs, sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(12)})).saved()
    parts, pairs = index.parts_of_pairs(g, 3), index.build_pairs(g, 3)
    assert stats.built_stats(*parts).first().asDict() == stats.index_stats(pairs).first().asDict()
    assert sorted(r["count"] for r in stats.counts_of_words(*parts).collect()) == sorted(r["count"] for r in pairs.groupBy("kmer").count().collect())


@pytest.mark.parametrize("name", ["index_stats", "histogram_kmers"])
def test_counts_save_no_index(spark, name, monkeypatch):
    from strandex.jobs import queries
    from strandex.operators import store

    monkeypatch.setattr(queries, "_SAVED", {})
    for f in ("save_index", "save_places"):
        if hasattr(store, f):
            monkeypatch.setattr(store, f, lambda *_: pytest.fail("an index is saved"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
