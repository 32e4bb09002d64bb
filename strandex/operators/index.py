"""The index: all (kmer, loc) such that some walk spells the k letters of kmer and goes on to location loc.

Inside a node that is a substring and a sum. Across nodes the last letters of a node travel along edges, whole nodes at a time, until they
are k letters long; equal travellers at one node are merged in each round, which keeps branching graphs from blowing up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import chosen_depth
from ..functions.order import running_sum
from ..functions.storage import counted, drop_stored, stored, together
from ..sources.graphs import StringGraph, located
from .paths import levels

ALGORITHMS = {"bfs": "reachable", "location_bfs": "reachable", "lbfs": "reachable", "node_bfs": "reachable", "nbfs": "reachable", "back_track": "all", "bt": "all", "point_bfs": "cut", "pbfs": "cut"}


def starts_of(name: str) -> str:
    """Which starts a builder's name stands for: all locations, those reachable from chosen nodes, or all with an early cut."""
    try:
        return ALGORITHMS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown algorithm {name}") from None


def depth_of(graph: StringGraph, depth: int = 0, relative: int | None = None) -> int:
    """The word length from the number of locations, see letters.chosen_depth."""
    return chosen_depth(int(graph.nodes.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]), depth, relative)


def inside(nodes: DataFrame, k: int, chunk: int = 1024) -> DataFrame:
    """Words that end before their node does; nodes has node_start. Nodes are cut into overlapping chunks, so a long one isn't walked from its start for each word."""
    fit = nodes.where(F.col("len") > k)
    cut = fit.select("node_start", "seg", "len", F.explode(F.sequence(F.lit(0), F.expr(f"(len - {k} - 1) div {chunk}").cast("int"))).alias("c"))
    part = cut.select((F.col("node_start") + F.col("c") * chunk).alias("at"), F.substring("seg", F.col("c") * chunk + 1, F.lit(chunk + k)).alias("s"), F.least(F.lit(chunk), F.col("len") - k - F.col("c") * chunk).cast("int").alias("n"))
    each = part.select("at", "s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select(F.substring("s", F.col("i") + 1, F.lit(k)).alias("kmer"), (F.col("at") + F.col("i") + k).alias("loc"))


def _across(graph: StringGraph, k: int, nodes: DataFrame, tails: DataFrame) -> DataFrame:
    """kmer, loc of the words that tails (src, pre), each once, make across nodes; a pair that walks over different numbers of nodes make repeats."""
    target = nodes.select(F.col("node_id").alias("dst"), "seg", "len", "node_start")
    front, steps = tails, []
    for _ in range(k + 1):
        here = front.join(graph.edges.select("src", "dst"), "src").join(target, "dst")
        need = k - F.length("pre")
        step, on = counted(here.select("dst", need.alias("need"), "len", "node_start", F.concat("pre", F.left(F.col("seg"), F.least(need, F.col("len")))).alias("word")).distinct(), "frontier", n=F.count(F.when(F.col("need") >= F.col("len"), 1)))
        steps.append(step)
        front = step.where("need >= len").select(F.col("dst").alias("src"), F.col("word").alias("pre"))
        if not on["n"]:
            break
    return together(*steps).where("need < len").select(F.col("word").alias("kmer"), (F.col("node_start") + F.col("need")).alias("loc"))


def parts_of_pairs(graph: StringGraph, k: int, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """kmer, loc of words inside nodes and of words across nodes, each pair once, for walks that begin everywhere, or everywhere in the nodes of within (node_id). No location is in both."""
    nodes = stored(located(graph.nodes), "located")
    own = nodes if within is None else nodes.join(within.select("node_id"), "node_id", "left_semi")
    tails = own.where("len > 0").select(F.col("node_id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.col("len"), F.lit(k))), lambda j: F.right(F.col("seg"), j))).alias("pre"))
    return inside(own, k), _across(graph, k, nodes, tails).distinct()


def build_pairs(graph: StringGraph, k: int, starts: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """kmer, loc, each once. starts (node_id, pos) limits where walks begin, or within (node_id) to all places of some nodes; without them walks begin everywhere."""
    if starts is None:
        # A location at least k letters into its node has one word, the ones before have none from inside: only words across nodes can repeat.
        found, across = parts_of_pairs(graph, k, within)
        return found.union(across)
    nodes = stored(located(graph.nodes), "located")
    own = starts.join(nodes, "node_id")
    found = own.where(F.col("pos") + k < F.col("len")).select(F.substring("seg", F.col("pos") + 1, F.lit(k)).alias("kmer"), (F.col("node_start") + F.col("pos") + k).alias("loc"))
    tails = own.where(F.col("pos") + k >= F.col("len")).select(F.col("node_id").alias("src"), F.substring("seg", F.col("pos") + 1, F.lit(k)).alias("pre"))
    return found.union(_across(graph, k, nodes, tails.distinct())).distinct()


def cut_pairs(graph: StringGraph, k: int, threshold: int = 128, starts: DataFrame | None = None) -> DataFrame:
    """kmer, loc with an early cut: a start whose paths to a level number `threshold` or more stops there with shorter words.

    From each start the paths advance a letter at a time; while a start has fewer paths than threshold and words shorter than k, it goes on; then
    each of its paths gives the word so far and the location after it. Paths are a bag, not a set. threshold 0 never cuts. Starts whose word lies
    inside one node, or on a path without a choice, never branch and aren't cut.
    """
    nodes = stored(located(graph.nodes), "located")
    places = starts if starts is not None else nodes.where("len > 0").select("node_id", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("pos"))
    own = places.join(nodes, "node_id")
    found = own.where(F.col("pos") + k < F.col("len")).select(F.substring("seg", F.col("pos") + 1, F.lit(k)).alias("kmer"), (F.col("node_start") + F.col("pos") + k).alias("loc"))
    size = F.least(F.col("len") - F.col("pos") - 1, F.lit(k)).cast("int")  # letters read so far: up to the one before the node's last
    front = own.where(F.col("pos") + k >= F.col("len")).select((F.col("node_start") + F.col("pos")).alias("start"), "node_id", (F.col("pos") + size).alias("pos"), F.substring("seg", F.col("pos") + 1, size).alias("word"))
    letter = nodes.select("node_id", "seg", "len", "node_start")
    after = graph.edges.select(F.col("src").alias("node_id"), "dst")
    over, rounds = ((F.length("word") == k) | ((F.col("paths") >= threshold) if threshold else F.lit(False))) & (F.length("word") > 0), []
    kept = None
    for _ in range(k + 1):
        sizes = front.groupBy("start").agg(F.count("*").alias("paths"))  # counted before the join, so a hot start is no hot task
        full = stored(front.join(sizes, "start").select("start", "node_id", "pos", "word", "paths"), "paths")
        rounds.append(full)
        if kept is not None:
            drop_stored(kept)
        go = full.where(~over).join(letter, "node_id").select("start", "node_id", "pos", "len", F.concat("word", F.substring("seg", F.col("pos") + 1, F.lit(1))).alias("word"))
        stay = go.where("pos + 1 < len").select("start", "node_id", (F.col("pos") + 1).cast("int").alias("pos"), "word")
        hop = go.where("pos + 1 >= len").join(after, "node_id").select("start", F.col("dst").alias("node_id"), F.lit(0).alias("pos"), "word")
        front, on = counted(stay.union(hop), "paths", n=F.count("*"))
        kept = front
        if not on["n"]:
            break
    done = together(*rounds).where(over).join(letter.select("node_id", "node_start"), "node_id").select(F.col("word").alias("kmer"), (F.col("node_start") + F.col("pos")).alias("loc"))
    return found.union(done).distinct()


def substrings(rows: DataFrame, longest: int, chunk: int = 1024) -> DataFrame:
    """kmer: the distinct words of up to `longest` letters, the empty one too, at any place of rows (seg)."""
    cut = rows.select("seg", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(length(seg) - 1, 0) div {chunk}").cast("int"))).alias("c"))
    part = cut.select(F.substring("seg", F.col("c") * chunk + 1, F.lit(chunk + longest - 1)).alias("s"), F.least(F.lit(chunk), F.length("seg") - F.col("c") * chunk).alias("n"))
    # Prefixes of the longest word at each place; those are made distinct first.
    at = part.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.substring("s", i, F.lit(longest)))).alias("w")).distinct()
    return at.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("w")), lambda i: F.left("w", i))).alias("kmer")).distinct()


def reachable_nodes(graph: StringGraph, from_nodes: DataFrame) -> DataFrame:
    """node_id of all nodes that walks from the given ones reach; for the builders that only start there."""
    return stored(levels(graph, from_nodes.select("node_id").distinct()).select("node_id"), "reached")


def reachable_places(graph: StringGraph, from_nodes: DataFrame) -> DataFrame:
    """node_id, pos of all locations in these nodes."""
    seen = reachable_nodes(graph, from_nodes)
    return graph.nodes.where("len > 0").join(seen, "node_id", "left_semi").select("node_id", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("pos"))


def build(graph: StringGraph, k: int, algorithm: str = "back_track", starts: DataFrame | None = None, cut: int = 128) -> DataFrame:
    """kmer, loc by a builder's name: walks from all places (or those of starts), from the places that the starting points (or the nodes in starts) reach, or from all with
    an early cut."""
    kind = starts_of(algorithm)
    if kind == "reachable":
        from .analytics import starting_points

        return build_pairs(graph, k, within=reachable_nodes(graph, starts if starts is not None else starting_points(graph)))
    return build_pairs(graph, k, starts) if kind == "all" else cut_pairs(graph, k, cut, starts)


def merged(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Union of two sets of pairs, each pair once."""
    return fast.select("kmer", "loc").union(slow.select("kmer", "loc")).distinct()


def prefixes(pairs: DataFrame, k: int) -> DataFrame:
    """prefix, depth: every proper prefix of a stored word, the empty one too, and stored words shorter than k."""
    words = pairs.select("kmer").distinct()
    cut = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.least(F.length("kmer"), F.lit(k - 1))), lambda i: F.left(F.col("kmer"), i))).alias("prefix"))
    return cut.distinct().withColumn("depth", F.length("prefix"))


def locations_for(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """words (kmer, ...) with each loc stored for them."""
    return words.join(pairs, "kmer")


def words_for(locs: DataFrame, pairs: DataFrame) -> DataFrame:
    """locs (loc, ...) with each kmer stored for them."""
    return locs.join(pairs, "loc")


def contains(keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """keys with found: whether pairs has the key (kmer or loc)."""
    return keys.join(pairs.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def trie_contains(words: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """words (kmer, ...) with found: a full word must be stored, a shorter one must be a prefix of a stored one (or stored)."""
    asked = words.select("kmer").distinct()
    heads = pairs.select("kmer").distinct().select(F.explode(F.transform(F.sequence(F.lit(0), F.length("kmer")), lambda i: F.left(F.col("kmer"), i))).alias("kmer"))
    known = heads.join(asked, "kmer", "left_semi").distinct()
    return words.join(known.withColumn("__hit", F.lit(True)), "kmer", "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def multimap(pairs: DataFrame, key: str = "kmer", value: str = "loc") -> DataFrame:
    """key, values (ascending), n: the distinct values of each key, put together from blocks of bounded size; store.posting_blocks() leaves them in blocks."""
    from .store import posting_blocks

    blocks = posting_blocks(pairs, key, value).withColumnRenamed(f"{value}s", "list")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "list"))), lambda b: b["list"]))
    return blocks.groupBy(key).agg(whole.alias("values")).withColumn("n", F.size("values"))


def offsets(keys: DataFrame, key: str, top: int) -> DataFrame:
    """key 0..top with how many rows have that key or a smaller one."""
    counts = keys.groupBy(F.col(key).alias("key")).count()
    spark = keys.sparkSession
    every = spark.range(top + 1).select(F.col("id").alias("key")).join(counts, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("n"))
    return running_sum(every, "key", "n", "before").select("key", (F.col("before") + F.col("n")).alias("offset"))
