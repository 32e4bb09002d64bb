"""Small graphs for tests, and a plain model of the index."""

from strandex.sources.graphs import StringGraph, from_tables


def graph(spark, segs: list[str], edges: list[tuple[int, int]]) -> StringGraph:
    nodes = spark.createDataFrame([(i, f"s{i + 1}", s) for i, s in enumerate(segs)], "node_id long, seg_id string, seg string")
    rows = spark.createDataFrame([(2 * i, a, b) for i, (a, b) in enumerate(edges)], "edge_id long, src long, dst long")
    return from_tables(nodes, rows)


DIAMOND = (["ac", "gg", "acg", "ac"], [(0, 1), (0, 2), (1, 3), (2, 3)])


def all_walks(segs: list[str], edges: list[tuple[int, int]], k: int) -> set[tuple[str, int]]:
    """Every (word, location after it), by walking letter by letter from everywhere."""
    start = [sum(map(len, segs[:i])) for i in range(len(segs))]
    out = set()

    def go(node, pos, word):
        if len(word) == k:
            out.add((word, start[node] + pos))
            return
        word += segs[node][pos]
        if pos + 1 < len(segs[node]):
            go(node, pos + 1, word)
        else:
            for a, b in edges:
                if a == node:
                    go(b, 0, word)

    for i, s in enumerate(segs):
        for p in range(len(s)):
            go(i, p, "")
    return out
