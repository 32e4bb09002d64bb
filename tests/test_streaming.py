from strandex.streaming.nodes import SCHEMA, add_inner_words


def test_new_files_are_added_once(spark, tmp_path):
    nodes, out, state = (f"file://{tmp_path}/{x}" for x in ("nodes", "index", "state"))
    spark.createDataFrame([(0, "acgt", 4, 0)], SCHEMA).write.parquet(nodes)
    assert sorted(map(tuple, add_inner_words(spark, nodes, out, state, 2).collect())) == [("ac", 2), ("cg", 3)]
    spark.createDataFrame([(1, "ttt", 3, 4)], SCHEMA).write.mode("append").parquet(nodes)
    assert sorted(map(tuple, add_inner_words(spark, nodes, out, state, 2).collect())) == [("ac", 2), ("cg", 3), ("tt", 6)]
