import pytest
from pyspark.sql import functions as F

from strandex.functions import letters as L
from strandex.operators import adjacency, locations
from strandex.sources import graphs

from .graph_cases import DIAMOND, graph


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_letters(spark):
    r = one(spark, push=L.push(F.lit("acgt"), F.lit("a"), 4), pop=L.pop(F.lit("acgt")), code=L.code(F.lit("tt")), level=L.level_code(F.lit("tt")), empty=L.level_code(F.lit("")), rc=L.rev_comp(F.lit("aacgn")), lcp=L.common_prefix(F.lit("aaaca"), F.lit("aaata")), same=L.common_prefix(F.lit("ac"), F.lit("acg")), none=L.common_prefix(F.lit(""), F.lit("a")))
    assert r.asDict() == {"push": "cgta", "pop": "acg", "code": 15, "level": 20, "empty": 0, "rc": "ncgtt", "lcp": 3, "same": 2, "none": 0}
    assert [r.b for r in spark.createDataFrame([(i,) for i in range(5)], "i int").select(L.level_start(F.col("i")).alias("b")).collect()] == [0, 1, 5, 21, 85]


def test_depth_and_human(spark):
    assert [L.depth_for(n) for n in (1, 5, 8, 171998)] == [0, 1, 2, 9]
    with pytest.raises(ValueError):
        L.chosen_depth(100, 3, 1)
    with pytest.raises(ValueError, match="too high"):
        L.chosen_depth(100, 32)
    rows = spark.createDataFrame([(950,), (1250,), (15550,), (156000123,), (-1250,), (0,)], "n long").select(L.human(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["950", "1.25k", "15.5k", "156m", "-1.25k", "0"]


def test_invalid_letter(spark):
    with pytest.raises(Exception, match="invalid letter"):
        spark.createDataFrame([("acx",)], "s string").select(L.checked(F.col("s"))).collect()


def test_neighbours(spark):
    g = graph(spark, *DIAMOND)
    assert {r.node_id: r.successors for r in adjacency.forward_from(g).collect()} == {0: [2, 1], 1: [3], 2: [3]}
    assert {r.node_id: r.predecessors for r in adjacency.backward_from(g).collect()} == {1: [0], 2: [0], 3: [2, 1]}
    assert {(r.node_id, r.next) for r in adjacency.forward_one(g).collect()} == {(1, 3), (2, 3)}
    assert adjacency.graph_stats(g).first().asDict() == {"num_nodes": 4, "num_locations": 9, "num_edges": 8}
    ids = spark.createDataFrame([(2,), (3,), (99,)], "edge_id long")
    assert sorted(map(tuple, adjacency.edges_by_id(ids, g).collect())) == [(2, 0, 2), (3, 2, 0)]


def test_reverse_complement(spark):
    g = graph(spark, *DIAMOND).reverse_complement()
    assert {r.node_id: r.seg for r in g.nodes.collect() if r.node_id % 2} == {1: "gt", 3: "cc", 5: "cgt", 7: "gt"}
    out = {}
    for r in g.edges.collect():
        out.setdefault(r.src, set()).add(r.dst)
    assert out[7] == {3, 5} and out[5] == {1} and out[3] == {1} and 1 not in out
    places = spark.createDataFrame([(0, 0), (1, 1)], "node_id long, pos int")
    assert sorted(map(tuple, locations.reverse_place(places, g.nodes).collect())) == [(0, 0), (1, 1)]


def test_extends(spark):
    g = graph(spark, ["ac", "gg", "acg"], [(0, 1), (0, 2)]).extended()
    assert {(r.node_id, r.seg_id, r.seg) for r in g.nodes.collect() if r.node_id > 2} == {(3, "extend:s2", "a"), (4, "extend:s3", "a")}
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(0, 1), (0, 2), (1, 3), (2, 4)]
    with pytest.raises(Exception, match="extend: prefix"):
        g.extended().nodes.collect()


def test_locations(spark):
    g = graph(spark, ["acgt", "a", "cgt", "aa"], [(0, 1), (0, 2), (1, 3), (2, 3)]).extended()
    nodes = graphs.located(g.nodes)
    assert [(r.node_id, r.node_start) for r in nodes.orderBy("node_id").collect()] == [(0, 0), (1, 4), (2, 5), (3, 8), (4, 10)]
    locs = spark.range(12).select(F.col("id").alias("loc"))
    got = sorted((r.loc, r.node_id, r.pos) for r in locations.expand(locs, nodes).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 0), (5, 2, 0), (6, 2, 1), (7, 2, 2), (8, 3, 0), (9, 3, 1), (10, 4, 0)]
    letters = "".join(r.letter for r in locations.letters(nodes, 2).orderBy("loc").collect())
    assert letters == "acgtacgtaaa"


GFA = "H\tVN:Z:1.0\nS\ts1\tCTGAA\tSN:Z:x\nS\ts2\tacg\nS\ts3\tTGGC\nL\ts1\t+\ts2\t+\t0M\nL\ts3\t-\ts2\t-\t0M\n"


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_gfa(spark, tmp_path):
    g = graphs.from_file(spark, write(tmp_path, "a.gfa", GFA))
    assert [(r.node_id, r.seg_id, r.seg) for r in g.nodes.orderBy("node_id").collect()] == [(0, "s1", "ctgaa"), (1, "s2", "acg"), (2, "s3", "tggc")]
    assert [tuple(r) for r in g.edges.orderBy("edge_id").collect()] == [(0, 0, 1), (2, 1, 2)]
    rc = graphs.from_file(spark, write(tmp_path, "b.gfa", GFA), revcomp=True)
    assert rc.nodes.count() == 6 and {(r.src, r.dst) for r in rc.edges.collect()} == {(0, 2), (3, 1), (5, 3), (2, 4)}


@pytest.mark.parametrize(
    "text, message",
    [("S\ta\tac\nL\ta\t+\ta\t+\t5M\n", "overlap"), ("S\ta\tac\nL\ta\t+\ta\t-\t0M\n", "mismatch"), ("S\ta\tac\nL\ta\t+\tb\t+\t0M\n", "unknown"), ("H\tx\n", "empty-graph"), ("S\ta\tac\nS\ta\tg\n", "repeated"), ("S\ta\tac\nL\ta\t+\ta\t+\t0M\nS\tb\tg\n", "add_node")],
)
def test_gfa_errors(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        graphs.from_gfa(spark, write(tmp_path, "e.gfa", text))


def test_fasta(spark, tmp_path):
    g = graphs.from_file(spark, write(tmp_path, "a.fasta", "skipped\n>Simple header line\naC\n;note\nGt\n>two\ntgca tail\n>three\naa\naa\n"))
    assert [(r.seg_id, r.seg) for r in g.nodes.orderBy("node_id").collect()] == [("Simple header line", "acgt"), ("two", "tgca"), ("three", "aaaa")]
    with pytest.raises(ValueError, match="empty-graph"):
        graphs.from_file(spark, "x.txt")


def test_round_trip(spark, tmp_path):
    g = graph(spark, *DIAMOND)
    path = f"file://{tmp_path}/out.gfa"
    graphs.to_gfa(g).coalesce(1).write.text(path)
    back = graphs.from_gfa(spark, path)
    assert sorted(r.seg for r in back.nodes.collect()) == sorted(DIAMOND[0]) and [tuple(r) for r in back.edges.orderBy("edge_id").collect()] == [(2 * i, a, b) for i, (a, b) in enumerate(DIAMOND[1])]


def test_gfa_of_several_unequal_files(spark, tmp_path):
    """Spark reads large files first; the order of the lines is that of the files' numbers."""
    folder = tmp_path / "parts.gfa"
    folder.mkdir()
    links = [f"L\ts{i % 7}\t+\ts{(i * 3 + 1) % 7}\t+\t0M\n" for i in range(500)]
    parts = {"part-00000-x": "S\ts0\tac\nS\ts1\tg\n", "part-00001-x": "".join(f"S\ts{i}\ttt\n" for i in range(2, 7)), "part-00002-x": "".join(links[:100]), "part-99999-x": "".join(links[100:490]), "part-100000-x": "".join(links[490:])}
    for name, text in parts.items():
        (folder / f"{name}.txt").write_text(text)
    g = graphs.from_gfa(spark, f"file://{folder}")
    assert [r.seg_id for r in g.nodes.orderBy("node_id").collect()] == [f"s{i}" for i in range(7)]
    assert [tuple(r) for r in g.edges.orderBy("edge_id").collect()] == [(2 * i, i % 7, (i * 3 + 1) % 7) for i in range(500)]


def test_fasta_of_several_unequal_files(spark, tmp_path):
    """Each file starts with a header of its own; the larger file isn't the first one."""
    folder = tmp_path / "parts.fasta"
    folder.mkdir()
    large = "".join(f">r{i}\n{'acgt' * 5}\nac\n" for i in range(2, 300))
    for name, text in {"part-00000-x": ">r0\nac\n", "part-00001-x": "junk\n>r1\ngg\n;note\ntt\n", "part-00002-x-c000": large, "part-00002-x-c001": ">last\na\n"}.items():
        (folder / f"{name}.txt").write_text(text)
    rows = graphs.from_file(spark, f"file://{folder}").nodes.orderBy("node_id").collect()
    assert [r.node_id for r in rows] == list(range(301)) and [r.seg_id for r in rows] == [*(f"r{i}" for i in range(300)), "last"]
    assert [r.seg for r in rows[:3]] == ["ac", "ggtt", "acgt" * 5 + "ac"] and rows[-1].seg == "a"


def test_neighbours_as_rows(spark):
    g = graph(spark, *DIAMOND)
    assert sorted(map(tuple, adjacency.neighbours(g).collect())) == [(0, 1, 1), (0, 2, 0), (1, 3, 0), (2, 3, 0)]
    assert sorted(map(tuple, adjacency.neighbours(g, False).collect())) == [(1, 0, 0), (2, 0, 0), (3, 1, 1), (3, 2, 0)]


def test_segments_without_letters_have_no_places(spark):
    g = graph(spark, ["ac", "", "gt"], [(0, 1), (1, 2)])
    from strandex.operators import analytics, index

    assert {(r.kmer, r.loc) for r in index.build_pairs(g, 2).collect()} == {("ac", 2), ("cg", 3)}
    assert {(r.kmer, r.loc) for r in index.cut_pairs(graph(spark, ["ac", "", "gt"], [(0, 2)]), 2, 0).collect()} == {("ac", 2), ("cg", 3)}
    assert index.reachable_places(g, g.nodes.where("node_id = 0").select("node_id")).where("node_id = 1").count() == 0
    inside, rest = analytics.region_starts(g, spark.createDataFrame([(1, 1, "internal")], "root long, node_id long, role string"), 2)
    assert inside.count() == 0 and rest.count() == 4
