"""String graphs as two tables: nodes (node_id, seg_id, seg, len) and edges (edge_id, src, dst).

edges has one row per directed edge; edge_id is even and grows in insertion order, the reverse of an edge is edge_id + 1. Neighbours
are listed newest edge first where an order matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.letters import checked, rev_comp
from ..functions.order import ranks, running_sum
from ..functions.storage import stored


@dataclass
class StringGraph:
    nodes: DataFrame
    edges: DataFrame

    def saved(self) -> StringGraph:
        """Both tables written to the shared folder, so that later steps don't repeat the reading."""
        return StringGraph(stored(self.nodes, "nodes"), stored(self.edges, "edges"))

    def reverse_complement(self) -> StringGraph:
        """Node i becomes 2i, its reverse complement is 2i + 1; each edge a -> b also gives rc(b) -> rc(a)."""
        twin = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
        n = self.nodes.select("*", twin)
        nodes = n.select((F.col("node_id") * 2 + F.col("k")).alias("node_id"), F.when(F.col("k") == 1, F.concat(F.lit("revcomp:"), "seg_id")).otherwise(F.col("seg_id")).alias("seg_id"), F.when(F.col("k") == 1, rev_comp(F.col("seg"))).otherwise(F.col("seg")).alias("seg"), "len")
        e = self.edges.select("*", twin)
        back = F.col("k") == 1
        edges = e.select((F.col("edge_id") * 2 + 2 * F.col("k")).alias("edge_id"), F.when(back, F.col("dst") * 2 + 1).otherwise(F.col("src") * 2).alias("src"), F.when(back, F.col("src") * 2 + 1).otherwise(F.col("dst") * 2).alias("dst"))
        return StringGraph(nodes, edges)

    def extended(self, letter: str = "a") -> StringGraph:
        """Each node without successors gets one more, extend:<seg_id>, of one letter, so that words up to its last letter have a location after them.

        New ids follow the largest one, in the order of the sinks. Ids that start with extend: already are an error.
        """
        clash = F.when(F.col("seg_id").startswith("extend:"), F.raise_error(F.lit("original nodes contain extend: prefix")).cast("string")).otherwise(F.col("seg_id"))
        base = self.nodes.withColumn("seg_id", clash)
        sinks = self.nodes.join(self.edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").select("node_id", "seg_id")
        ranked = ranks(sinks, "node_id")
        top = self.nodes.agg(F.max("node_id")).first()[0] or 0
        last = self.edges.agg(F.max("edge_id")).first()[0]
        first = -2 if last is None else last
        new = ranked.select("node_id", "seg_id", (F.col("rank") + top + 1).alias("new_id"), (F.col("rank") * 2 + first + 2).alias("edge_id"))
        nodes = base.unionByName(new.select(F.col("new_id").alias("node_id"), F.concat(F.lit("extend:"), "seg_id").alias("seg_id"), F.lit(letter).alias("seg"), F.lit(1).alias("len")))
        return StringGraph(nodes, self.edges.unionByName(new.select("edge_id", F.col("node_id").alias("src"), F.col("new_id").alias("dst"))))


def located(nodes: DataFrame) -> DataFrame:
    """nodes with node_start: how many letters lie before the node, in node_id order."""
    return running_sum(nodes, "node_id", "len", "node_start")


def from_tables(nodes: DataFrame, edges: DataFrame) -> StringGraph:
    """nodes (node_id, seg_id, seg) and edges (edge_id, src, dst); letters are checked, an edge to an unknown node is an error."""
    n = nodes.select("node_id", "seg_id", checked(F.col("seg")).alias("seg")).withColumn("len", F.length("seg"))
    known = n.select(F.col("node_id").alias("__id"))
    lost = edges.join(known, edges.src == known["__id"], "left_anti").union(edges.join(known, edges.dst == known["__id"], "left_anti"))
    if not lost.isEmpty():
        raise ValueError("an edge names an unknown node")
    return StringGraph(n, edges.select("edge_id", "src", "dst"))


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, line (ascending in the order of the file) and first (of its file). Part files follow each other by their numbers, other files of a
    folder by name, and the splits of a file by place, in whatever order Spark reads them."""
    from pyspark.sql.window import Window

    name = F.col("_metadata.file_name")
    number = lambda pattern: F.lpad(F.regexp_extract(name, pattern, 1), 12, "0")
    split = [number(r"^part-(\d+)").alias("__part"), number(r"^part-.*-c(\d+)\.").alias("__cut"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at")]
    keys = ["__part", "__cut", "__file", "__at"]
    rows = stored(spark.read.options(**options).text(path).select("value", F.monotonically_increasing_id().alias("__id"), *split), "lines")
    splits = rows.groupBy(*keys).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))  # a split's ids follow each other
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per split of a file
    starts = splits.select(*keys, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    line = F.col("__start") + F.col("__id") - F.col("__first")
    return rows.join(starts, keys).select("value", line.alias("line"), ((F.col("__at") == 0) & (F.col("__id") == F.col("__first"))).alias("first"))


def from_gfa(spark: SparkSession, path: str, revcomp: bool = False) -> StringGraph:
    """S and L records of a GFA text; other records and tags are ignored. Overlaps other than 0M are an error, and so are edges of
    unknown segments, repeated segment ids, and mixed directions unless revcomp is on."""
    rows = stored(_lines(spark, path).select("line", F.split("value", r"\s+").alias("f")).where("f[0] in ('S', 'L')"), "gfa")
    seg = ranks(rows.where("f[0] = 'S'").select("line", F.expr("f[1]").alias("seg_id"), F.expr("f[2]").alias("seg")), "line")
    nodes = stored(seg.select(F.col("rank").alias("node_id"), "seg_id", checked(F.col("seg")).alias("seg")).withColumn("len", F.length("seg")), "segments")
    counts = nodes.agg(F.count("*").alias("n"), F.countDistinct("seg_id").alias("d")).first()
    if not counts.n:
        raise ValueError("empty-graph")
    if counts.n != counts.d:
        raise ValueError("a segment id is repeated")
    link = rows.where("f[0] = 'L'").select("line", *(F.expr(f"f[{k}]").alias(c) for k, c in enumerate(("a", "da", "b", "db", "cigar"), 1)))
    bad = link.agg(F.sum((F.coalesce("cigar", F.lit("")) != "0M").cast("int")).alias("overlap"), F.sum((F.col("da") != F.col("db")).cast("int")).alias("mixed")).first()
    if bad.overlap:
        raise ValueError("does not support non-zero overlap")
    if bad.mixed and not revcomp:
        raise ValueError("mismatch directions and no revcomp in settings")
    if not link.isEmpty() and not rows.where("f[0] = 'S'").join(link.agg(F.min("line").alias("l")), F.col("line") > F.col("l")).isEmpty():
        raise ValueError("can not add_node after add_edge")
    ids = nodes.select("seg_id", "node_id")
    named = ranks(link, "line").join(ids.toDF("a", "ia"), "a", "left").join(ids.toDF("b", "ib"), "b", "left")
    if not named.where("ia is null or ib is null").isEmpty():
        raise ValueError("an edge names an unknown segment")
    if revcomp:
        both = StringGraph(nodes, named.limit(0).select(F.col("rank").alias("edge_id"), F.col("ia").alias("src"), F.col("ib").alias("dst"))).reverse_complement().nodes
        side = lambda i, d: F.col(i) * 2 + (F.col(d) == "-").cast("long")
        fwd = named.select((F.col("rank") * 4).alias("edge_id"), side("ia", "da").alias("src"), side("ib", "db").alias("dst"))
        twin = fwd.select((F.col("edge_id") + 2).alias("edge_id"), F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"))
        return StringGraph(both, fwd.unionByName(twin))
    minus = F.col("da") == "-"
    return StringGraph(nodes, named.select((F.col("rank") * 2).alias("edge_id"), F.when(minus, F.col("ib")).otherwise(F.col("ia")).alias("src"), F.when(minus, F.col("ia")).otherwise(F.col("ib")).alias("dst")))


def to_gfa(graph: StringGraph) -> DataFrame:
    """value: the graph as GFA lines, segments first; ordered."""
    s = graph.nodes.select(F.lit(0).alias("kind"), F.col("node_id").alias("at"), F.concat_ws("\t", F.lit("S"), "seg_id", "seg").alias("value"))
    name = graph.nodes.select("node_id", "seg_id")
    e = graph.edges.join(name.toDF("src", "a"), "src").join(name.toDF("dst", "b"), "dst")
    edges = e.select(F.lit(1).alias("kind"), F.col("edge_id").alias("at"), F.concat_ws("\t", F.lit("L"), "a", F.lit("+"), "b", F.lit("+"), F.lit("0M")).alias("value"))
    return s.unionByName(edges).orderBy("kind", "at").select("value")


def to_fasta(nodes: DataFrame, width: int = 60) -> DataFrame:
    """value: a FASTA record for each node, its letters in lines of `width`; ordered."""
    lines = F.regexp_replace(F.regexp_replace("seg", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return nodes.orderBy("node_id").select(F.concat(F.lit(">"), "seg_id", F.lit("\n"), lines).alias("value"))


def from_fasta(spark: SparkSession, path: str) -> StringGraph:
    """One node per > record (the rest of the line is its id), its lines joined up to their first white space; ; comments and lines before
    a file's first header are skipped. There are no edges. A folder's files follow each other as in _lines()."""
    records = _lines(spark, path, lineSep="\n>")
    first = F.when(F.col("first"), F.regexp_extract("value", r"(?s)(?:^|.*?\n)>(.*)$", 1)).otherwise(F.col("value"))
    head = F.split(F.col("r"), "\n")
    body = F.filter(F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(1))), lambda x: ~x.startswith(";"))
    rows = records.select("line", first.alias("r")).where("r <> ''")
    named = rows.select("line", F.regexp_replace(head[0], "\r$", "").alias("seg_id"), F.array_join(F.transform(body, lambda x: F.regexp_extract(x, r"^(\S*)", 1)), "").alias("seg"))
    nodes = ranks(named, "line").select(F.col("rank").alias("node_id"), "seg_id", checked(F.col("seg")).alias("seg")).withColumn("len", F.length("seg"))
    if nodes.isEmpty():
        raise ValueError("empty-graph")
    return StringGraph(nodes, spark.createDataFrame([], "edge_id long, src long, dst long"))


def from_file(spark: SparkSession, path: str, revcomp: bool = False, extends: bool = False) -> StringGraph:
    """Reader by suffix: .gfa and .rgfa, .fa and .fasta."""
    name = path.lower()
    if name.endswith((".gfa", ".rgfa")):
        graph = from_gfa(spark, path, revcomp)
    elif name.endswith((".fa", ".fasta")):
        graph = from_fasta(spark, path)
        graph = graph.reverse_complement() if revcomp else graph
    else:
        raise ValueError("empty-graph")
    return graph.extended() if extends else graph


def document_graph(spark: SparkSession, sf_dir: str) -> StringGraph:
    """The documents as a string graph: a node is the a, c, g, t letters of a whole text; i leads to i + 1, every third also to i + 2,
    every fiftieth back to i - 5, where these exist."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nodes = docs.select(F.col("doc_id").alias("node_id"), F.col("doc_id").cast("string").alias("seg_id"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("seg")).where("seg <> ''").withColumn("len", F.length("seg"))
    i = F.col("node_id")
    steps = F.array(F.lit(1), F.when(i % 3 == 0, 2), F.when(i % 50 == 49, -5))
    edges = nodes.select(i.alias("src"), F.posexplode(steps).alias("kind", "step")).where("step is not null").select((F.col("src") * 6 + F.col("kind") * 2).alias("edge_id"), "src", (F.col("src") + F.col("step")).alias("dst"))
    edges = edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("edge_id", "src", "dst")
    return StringGraph(nodes, edges)


def part_graph(spark: SparkSession, sf_dir: str) -> StringGraph:
    """Parts as short nodes (the digits of their key in base 4 as letters); an edge for each two parts that follow each other in an order."""
    from pyspark.sql.window import Window

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    nodes = part.select(F.col("p_partkey").cast("long").alias("node_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("seg_id"), F.translate(F.conv(F.col("p_partkey").cast("string"), 10, 4), "0123", "acgt").alias("seg")).withColumn("len", F.length("seg"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))  # line numbers repeat in some orders
    steps = line.select(F.col("l_partkey").cast("long").alias("src"), after.cast("long").alias("dst")).where("dst is not null").distinct()
    ids = nodes.select(F.col("node_id"))
    steps = steps.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return StringGraph(nodes, steps.select(((F.col("src") * 10_000_000 + F.col("dst")) * 2).alias("edge_id"), "src", "dst"))
