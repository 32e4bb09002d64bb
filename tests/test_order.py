import random
import time

import pytest
from pyspark.sql import functions as F

from strandex.functions.letters import common_prefix
from strandex.functions.order import group_ranks, ranks, running_sum
from strandex.operators import adjacency

from .graph_cases import graph


def test_ranks(spark):
    rows = spark.createDataFrame([(k, "x") for k in (5, 100, 7, 250, 0)], "k long, other string")
    assert sorted((r.k, r["rank"]) for r in ranks(rows, "k").collect()) == [(0, 0), (5, 1), (7, 2), (100, 3), (250, 4)]
    two = spark.createDataFrame([(a, b) for a in (None, 1, 2) for b in ("b", None, "a")], "a int, b string")
    got = [(r.a, r.b) for r in ranks(two, "a", "b", name="place").orderBy("place").collect()]
    assert got == [(None, None), (None, "a"), (None, "b"), (1, None), (1, "a"), (1, "b"), (2, None), (2, "a"), (2, "b")]
    assert ranks(rows.limit(0), "k").count() == 0


@pytest.mark.parametrize("n", [0, 1, 30_000])
def test_sums_over_hashed_ids(spark, n):
    rows = spark.range(n).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).cast("int").alias("size"), F.lit("text").alias("seg"))
    got = sorted((r.key, r.before, r.size) for r in running_sum(rows, "key", "size", "before").collect())
    total = 0
    for _, before, size in got:
        assert before == total
        total += size
    assert len(got) == n


def test_only_ranges_meet_in_one_task(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.lit(1).alias("one"))
    plan = running_sum(rows, "key", "one", "before")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "Aggregate [__part" in window[: window.index("Relation")]  # what the window orders is a row for each range


def test_group_ranks_of_a_hub(spark):
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 1, 2, 3, None)), k) for k in rng.sample(range(10**9), 20_000)]
    table = spark.createDataFrame(rows, "g int, k long").repartition(5)
    got = group_ranks(table, ["g"], ["k"]).withColumn("task", F.spark_partition_id())
    expected = {(g, k): i for g in {g for g, _ in rows} for i, k in enumerate(sorted(k for h, k in rows if h == g))}
    assert {(r.g, r.k): r["rank"] for r in got.collect()} == expected


def test_neighbours_of_a_hub_run_in_several_tasks(spark):
    n = 60_000
    g = graph(spark, ["a"], []).nodes.sparkSession.range(n)
    edges = g.select((F.col("id") * 2).alias("edge_id"), F.lit(7).cast("long").alias("src"), (F.col("id") + 10).alias("dst"))
    from strandex.sources.graphs import StringGraph

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are put into one task
    try:
        out = adjacency.neighbours(StringGraph(graph(spark, ["a"], []).nodes, edges)).withColumn("task", F.spark_partition_id())
        rows = [r.n for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) > 2 and max(rows) < 0.5 * n
    assert out.where("newest <> 9 + {} - other".format(n)).count() == 0 and out.count() == n
    listed = adjacency.forward_from(StringGraph(graph(spark, ["a"], []).nodes, edges)).first()
    assert listed.successors == [i + 10 for i in reversed(range(n))]


PREFIXES = [("", "", 0), ("a", "", 0), ("acgt", "acgt", 4), ("acgt", "acga", 3), ("acgt", "ac", 2), ("c" * 1024, "c" * 1025, 1024), ("c" * 1023 + "a", "c" * 1024, 1023), ("c" * 1024 + "a", "c" * 1024 + "g", 1024), ("a" * 3000, "a" * 2047 + "c", 2047), ("a" * 2048, "a" * 2048, 2048)]


def test_common_prefix(spark):
    rows = spark.createDataFrame(PREFIXES, "a string, b string, n int")
    got = rows.select("n", common_prefix(F.col("a"), F.col("b")).alias("m"), common_prefix(F.col("b"), F.col("a"), 3).alias("k")).collect()
    assert all(r.n == r.m == r.k for r in got)
    rng = random.Random(4)
    more = [("".join(rng.choice("ac") for _ in range(rng.randrange(9))), "".join(rng.choice("ac") for _ in range(rng.randrange(9)))) for _ in range(200)]
    for r in spark.createDataFrame(more, "a string, b string").select("a", "b", common_prefix(F.col("a"), F.col("b"), 2).alias("m")).collect():
        assert r.m == next((i for i, (x, y) in enumerate(zip(r.a, r.b)) if x != y), min(len(r.a), len(r.b)))


def test_common_prefix_of_a_million_letters_is_linear(spark):
    one = spark.range(1).select(F.repeat(F.lit("acgt"), 250_000).alias("a"))
    rows = one.select("a", F.concat(F.expr("substring(a, 1, 999990)"), F.lit("tttttttttt")).alias("b"))
    rows.select(common_prefix(F.col("a"), F.col("b"))).collect()
    began = time.time()
    assert rows.select(common_prefix(F.col("a"), F.col("b"))).first()[0] == 999_990 + 1 - 1
    assert time.time() - began < 5
