"""Words of new nodes, added to a stored index as node files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import inside

SCHEMA = "node_id long, seg string, len int, node_start long"


def add_inner_words(spark: SparkSession, nodes_path: str, index_path: str, state_path: str, k: int) -> DataFrame:
    """Read the node files (SCHEMA, Parquet) that no earlier run has read, append their inner (kmer, loc) pairs to the index, return the index.

    Pairs inside a node depend on that node alone, so no state is kept beyond the list of files; each file counts once, also after
    a failed run. Pairs across nodes need the edges and are built in batch.
    """
    nodes = spark.readStream.schema(SCHEMA).parquet(nodes_path)
    query = inside(nodes, k).writeStream.format("parquet").option("path", index_path).option("checkpointLocation", state_path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("kmer string, loc long").parquet(index_path)
