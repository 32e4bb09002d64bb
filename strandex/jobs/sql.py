"""DuckDB SQL for the registered queries over string graphs, on the same tables."""

from __future__ import annotations

PART_K, HYBRID_K, HYBRID_SEED, HYBRID_CUT = 6, 5, 24, 32

#: The document graph: n (node_id, seg, len), e (edge_id, src, dst), p (n with node_start).
DOCS = r"""
n AS (SELECT doc_id AS node_id, CAST(doc_id AS VARCHAR) AS seg_id, seg, CAST(length(seg) AS INT) AS len
      FROM (SELECT doc_id, regexp_replace(lower(text), '[^acgt]', '', 'g') AS seg FROM documents) WHERE seg <> ''),
e AS (SELECT src * 6 + kind * 2 AS edge_id, src, src + step AS dst FROM (
        SELECT node_id AS src, 0 AS kind, 1 AS step FROM n UNION ALL SELECT node_id, 1, 2 FROM n WHERE node_id % 3 = 0 UNION ALL SELECT node_id, 2, -5 FROM n WHERE node_id % 50 = 49)
      WHERE src + step IN (SELECT node_id FROM n)),
p AS (SELECT *, CAST(coalesce(sum(len) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node_start FROM n),
size AS (SELECT CAST(sum(len) AS BIGINT) AS l FROM n),
depth AS (SELECT CAST(ceil(floor(log2(l)) / 2) AS INT) AS k FROM size)
"""

#: The part graph, in the same form.
PARTS = rf"""
n AS (SELECT p_partkey AS node_id, 'part' || p_partkey AS seg_id, seg, CAST(length(seg) AS INT) AS len
      FROM (SELECT p_partkey, translate(to_base(p_partkey, 4), '0123', 'acgt') AS seg FROM part)),
e AS (SELECT (src * 10000000 + dst) * 2 AS edge_id, src, dst FROM (
        SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)
      WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)),
p AS (SELECT *, CAST(coalesce(sum(len) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node_start FROM n),
depth AS (SELECT {PART_K} AS k)
"""

#: Walks from places (node_id, pos) named in st: pairs (kmer, loc).
WALK = """
inner_words AS (SELECT substr(seg, pos + 1, k) AS kmer, node_start + pos + k AS loc FROM st JOIN p USING (node_id), depth WHERE pos + k < len),
walk(node_id, pre) AS (
  SELECT node_id, substr(seg, pos + 1, k) FROM st JOIN p USING (node_id), depth WHERE pos + k >= len
  UNION
  SELECT e.dst, left(w.pre || d.seg, k) FROM walk w JOIN e ON w.node_id = e.src JOIN n d ON e.dst = d.node_id, depth WHERE k - length(w.pre) >= d.len),
outer_words AS (SELECT left(w.pre || d.seg, k) AS kmer, d.node_start + k - length(w.pre) AS loc FROM walk w JOIN e ON w.node_id = e.src JOIN p d ON e.dst = d.node_id, depth WHERE k - length(w.pre) < d.len),
pairs AS (SELECT kmer, loc FROM inner_words UNION SELECT kmer, loc FROM outer_words)
"""

EVERYWHERE = "st AS (SELECT node_id, unnest(range(len)) AS pos FROM n)"
PREFIX = "prefixes AS (SELECT DISTINCT left(kmer, d) AS prefix, CAST(d AS INT) AS depth FROM (SELECT kmer, unnest(range(k)) AS d FROM pairs, depth))"
REACH = "lev(node_id) AS (SELECT node_id FROM begin UNION SELECT e.dst FROM lev JOIN e ON lev.node_id = e.src)"
LINKS = "und AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"
SPREAD = "spread(root, node_id) AS (SELECT node_id, node_id FROM n UNION SELECT s.root, u.b FROM spread s JOIN und u ON s.node_id = u.a WHERE s.root < u.b)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


DOC_PAIRS = _with(DOCS, EVERYWHERE, WALK)
PART_PAIRS = _with(PARTS, EVERYWHERE, WALK)
#: The part graph with a part of its edges.
OVERLAPPING = PARTS.replace("e AS (", "whole AS (").replace("p AS (", "e AS (SELECT w.* FROM whole w JOIN n a ON a.node_id = w.src JOIN n b ON b.node_id = w.dst WHERE a.len > 1 AND b.len > 1 AND right(a.seg, 2) = left(b.seg, 2)),\np AS (")
#: Sources, and the smallest node of each component without one.
STARTS = SPREAD + ", low AS (SELECT node_id, min(root) AS root FROM spread GROUP BY 1), src0 AS (SELECT node_id FROM n WHERE node_id NOT IN (SELECT dst FROM e)), begin AS (SELECT node_id, 'source' AS kind FROM src0 UNION ALL SELECT DISTINCT root, 'cycle' FROM low WHERE root NOT IN (SELECT root FROM low JOIN src0 USING (node_id)))"


#: The document graph with the edges between documents of one language, and the documents labelled good as starts.
ONE_LANGUAGE = DOCS.replace("\ne AS (", "\nwhole AS (").replace("p AS (SELECT *", "e AS (SELECT w.* FROM whole w JOIN documents a ON a.doc_id = w.src JOIN documents b ON b.doc_id = w.dst WHERE a.lang = b.lang),\np AS (SELECT *")
GOOD = "begin AS (SELECT doc_id AS node_id FROM labels WHERE quality = 1)"


def levels_from(seed: str, *of: str) -> str:
    """lv (of, node_id, level): the fewest edges from the rows of seed to each node, however many there are."""
    keys, same = ", ".join([*of, "node_id"]), "".join(f" AND r.{c} = lv.{c}" for c in of)
    return f"lv({keys}, level) USING KEY ({keys}) AS ({seed} UNION SELECT {''.join(f'lv.{c}, ' for c in of)}e.dst, min(lv.level) + 1 FROM lv JOIN e ON e.src = lv.node_id LEFT JOIN recurring.lv r ON r.node_id = e.dst{same} WHERE r.level IS NULL OR r.level > lv.level + 1 GROUP BY ALL)"


def index_at(relative: int) -> str:
    """Size of the part graph's index at so many letters more than its default depth."""
    depth = f"depth AS (SELECT CAST(ceil(floor(log2(sum(len))) / 2) AS INT) + {relative} AS k FROM n)"
    start = _with(PARTS.replace(f"depth AS (SELECT {PART_K} AS k)", depth), EVERYWHERE, WALK)
    return f"SELECT * FROM ({start}SELECT {relative} AS relative, (SELECT k FROM depth) AS k, count(*) AS num_pairs, count(DISTINCT kmer) AS num_kmers, count(DISTINCT loc) AS num_locs, round(count(DISTINCT kmer) / (SELECT power(4, k) FROM depth), 9) AS fill FROM pairs)"


def bounds(k: int) -> str:
    """b{j} (node_id, w): how many words of j letters can lie before a node at most; bound (node_id, starts, ends)."""
    out = ["b0 AS (SELECT node_id, CAST(1 AS BIGINT) AS w FROM n)"]
    for j in range(1, k + 1):
        lower = " UNION ALL ".join(f"SELECT node_id, {i} AS i, w FROM b{i}" for i in range(j))
        out.append(f"b{j} AS MATERIALIZED (SELECT n.node_id, CAST(coalesce(s, 1) AS BIGINT) AS w FROM n LEFT JOIN (SELECT dst, least(sum(CASE WHEN u.len >= {j} THEN 1 ELSE b.w END), {(4 ** (j + 1) - 1) // 3}) AS s FROM e JOIN n u ON u.node_id = e.src LEFT JOIN ({lower}) b ON b.node_id = e.src AND b.i = {j} - u.len GROUP BY dst) ON dst = n.node_id)")
    every = " UNION ALL ".join(f"SELECT node_id, {i} AS i, w FROM b{i}" for i in range(k + 1))
    out.append(f"bound AS (SELECT n.node_id, t.w AS starts, CASE WHEN n.len >= {k} THEN 1 ELSE b.w END AS ends FROM n JOIN b{k} t USING (node_id) LEFT JOIN ({every}) b ON b.node_id = n.node_id AND b.i = {k} - n.len)")
    return ",\n".join(out)


#: Words with an early cut from the places (node_id, pos) in inside: a letter at a time, all paths of a start at once; 128 paths cut it.
CUT = """
nxt AS (SELECT node_id, pos, node_id AS to_node, pos + 1 AS to_pos FROM (SELECT node_id, len, unnest(range(len)) AS pos FROM n) WHERE pos + 1 < len UNION ALL SELECT src, len - 1, dst, 0 FROM e JOIN n ON node_id = src),
cut(start, node_id, pos, word, paths) AS (
  SELECT node_start + pos, node_id, pos + least(len - pos - 1, k), substr(seg, pos + 1, least(len - pos - 1, k)), CAST(1 AS BIGINT) FROM inside JOIN p USING (node_id), depth WHERE pos + k >= len
  UNION ALL
  SELECT c.start, x.to_node, x.to_pos, c.word || substr(n.seg, c.pos + 1, 1), count(*) OVER (PARTITION BY c.start)
  FROM cut c JOIN n USING (node_id) JOIN nxt x ON x.node_id = c.node_id AND x.pos = c.pos, depth WHERE c.word = '' OR (length(c.word) < k AND c.paths < 128)),
cut_words AS (SELECT substr(seg, pos + 1, k) AS kmer, node_start + pos + k AS loc FROM inside JOIN p USING (node_id), depth WHERE pos + k < len
  UNION SELECT word, node_start + pos FROM cut JOIN p USING (node_id), depth WHERE word <> '' AND (length(word) = k OR paths >= 128))
"""
#: Regions of nodes shorter than k around the seeds, all places inside them, and the rest.
HYBRID = f"""
short AS (SELECT node_id FROM n, depth WHERE len < k), su AS (SELECT src AS a, dst AS b FROM e WHERE src IN (FROM short) AND dst IN (FROM short) UNION SELECT dst, src FROM e WHERE src IN (FROM short) AND dst IN (FROM short)),
internal(node_id) AS (SELECT node_id FROM bound WHERE ends >= {HYBRID_SEED} UNION SELECT su.b FROM internal i JOIN su ON su.a = i.node_id),
border AS (SELECT n.node_id, CASE WHEN n.node_id IN (FROM internal) THEN 0 WHEN n.len >= k AND n.node_id IN (SELECT src FROM e WHERE dst IN (FROM internal)) THEN n.len - k ELSE n.len END AS first, len FROM n, depth),
inside AS (SELECT node_id, unnest(range(first, len)) AS pos FROM border), st AS (SELECT node_id, unnest(range(first)) AS pos FROM border)
"""
ALPHABET = "alpha(letter) AS (VALUES ('a'), ('c'), ('g'), ('t'), ('n'))"
HANDLES = """
known AS (SELECT prefix AS kmer FROM prefixes UNION SELECT kmer FROM pairs),
handles AS (SELECT 'trie' AS kind, kmer, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS pos FROM known UNION ALL SELECT 'graph', NULL, node_id, len - 1 FROM n)
"""
EDITS = """
child AS (SELECT kmer AS child, left(kmer, length(kmer) - 1) AS kmer, right(kmer, 1) AS actual FROM known WHERE kmer <> ''),
place AS (SELECT 'graph' AS src_kind, CAST(NULL AS VARCHAR) AS src_kmer, node_id AS src_node_id, len - 1 AS src_pos, node_id, len - 1 AS pos FROM n
          UNION ALL SELECT 'trie', kmer, NULL, NULL, p.node_id, r.loc - p.node_start FROM asked JOIN pairs r USING (kmer) JOIN p ON r.loc >= p.node_start AND r.loc < p.node_start + p.len),
move AS (SELECT place.* EXCLUDE (node_id, pos), node_id AS dst_node, pos + 1 AS dst_pos, substr(seg, pos + 1, 1) AS actual FROM place JOIN n USING (node_id) WHERE pos + 1 < len
         UNION ALL SELECT place.* EXCLUDE (node_id, pos), e.dst, 0, substr(seg, pos + 1, 1) FROM place JOIN n USING (node_id) JOIN e ON e.src = node_id WHERE pos + 1 >= len),
edits AS (
  SELECT src_kind, src_kmer, src_node_id, src_pos, 'graph' AS dst_kind, CAST(NULL AS VARCHAR) AS dst_kmer, dst_node, dst_pos, CASE WHEN letter = actual THEN 'MATCH' ELSE 'SUB' END AS op, letter FROM move, alpha
  UNION ALL SELECT src_kind, src_kmer, src_node_id, src_pos, 'graph', NULL, dst_node, dst_pos, 'DEL', 'E' FROM move
  UNION ALL SELECT src_kind, src_kmer, src_node_id, src_pos, 'graph', NULL, node_id, pos, 'INS', letter FROM place, alpha
  UNION ALL SELECT 'trie', kmer, NULL, NULL, 'trie', child, NULL, NULL, CASE WHEN letter = actual THEN 'MATCH' ELSE 'SUB' END, letter FROM child, alpha
  UNION ALL SELECT 'trie', kmer, NULL, NULL, 'trie', child, NULL, NULL, 'DEL', 'E' FROM child
  UNION ALL SELECT 'trie', kmer, NULL, NULL, 'trie', kmer, NULL, NULL, 'INS', letter FROM known, alpha, depth WHERE length(kmer) < k)
"""
KNOWN = "known AS (SELECT prefix AS kmer FROM prefixes UNION SELECT kmer FROM pairs)"
#: All stored words go on from their locations; none of them does where only shorter ones are asked.
ALL_WORDS, NO_WORDS = "asked AS (SELECT DISTINCT kmer FROM pairs)", "asked AS (SELECT kmer FROM pairs WHERE false)"
#: Trie handles first (by length, then letters), then graph handles.
HANDLE_KEY = "CASE {0}_kind WHEN 'trie' THEN 0 ELSE 1 END, coalesce(length({0}_kmer), 0), coalesce({0}_kmer, ''), coalesce({1}, 0), coalesce({2}, 0)"
#: Mutual reach: component is the smallest node of a strongly connected component; level the longest way between components.
STRONG = """
plain AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
reach(a, b) AS (SELECT src, dst FROM plain UNION SELECT r.a, p.dst FROM reach r JOIN plain p ON p.src = r.b),
strong AS (SELECT node_id, least(node_id, coalesce(m, node_id)) AS component FROM n LEFT JOIN (SELECT x.a, min(x.b) AS m FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1) ON a = node_id)
"""
TOP = """
between AS (SELECT DISTINCT s.component AS src, d.component AS dst FROM e JOIN strong s ON s.node_id = src JOIN strong d ON d.node_id = dst WHERE s.component <> d.component),
lv(c, level) AS (SELECT DISTINCT component, CAST(0 AS BIGINT) FROM strong UNION SELECT b.dst, level + 1 FROM lv JOIN between b ON b.src = lv.c),
top AS (SELECT c, max(level) AS level FROM lv GROUP BY 1)
"""
ORDER = TOP.strip() + """
SELECT node_id, component, level, row_number() OVER (ORDER BY level, component, node_id) - 1 AS place FROM strong JOIN top ON c = component
"""
HISTOGRAM = """
h AS (SELECT CAST(floor(log2(c)) AS INT) AS bin, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM c GROUP BY 1)
SELECT bin, n, total, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS cum_n, CAST(sum(total) OVER (ORDER BY bin) AS BIGINT) AS cum_total FROM h
"""
WORDS = "q AS (SELECT DISTINCT substr(seg, CAST(i AS INT), k) AS kmer FROM (SELECT seg, k, unnest(range(1, length(seg) - k + 2)) AS i FROM (SELECT regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seg FROM benchmark), depth WHERE length(seg) >= k))"
REGION = "short AS (SELECT node_id FROM n WHERE len < 64), se AS (SELECT src AS a, dst AS b FROM e WHERE src IN (FROM short) AND dst IN (FROM short)), su AS (SELECT a, b FROM se UNION SELECT b, a FROM se), sp(root, node_id) AS (SELECT node_id, node_id FROM short UNION SELECT sp.root, su.b FROM sp JOIN su ON sp.node_id = su.a), internal AS (SELECT min(root) AS root, node_id FROM sp GROUP BY node_id), regions AS (SELECT root, node_id, 'internal' AS role FROM internal UNION SELECT root, e.src, 'incoming' FROM internal i JOIN e ON e.dst = i.node_id WHERE e.src NOT IN (FROM short) UNION SELECT root, e.dst, 'outgoing' FROM internal i JOIN e ON e.src = i.node_id WHERE e.dst NOT IN (FROM short))"

ORACLE_SQL: dict[str, str] = {
    "graph_nodes": _with(DOCS) + "SELECT node_id, len, md5(seg) AS seg_md5 FROM n",
    "graph_edges": _with(DOCS) + "SELECT edge_id, src, dst, 'forward' AS way FROM e UNION ALL SELECT edge_id + 1, dst, src, 'reverse' FROM e",
    "graph_stats": _with(DOCS) + """SELECT (SELECT count(*) FROM n) AS num_nodes, 2 * (SELECT count(*) FROM e) AS num_edges, l AS num_locations,
        CASE WHEN l < 1000 THEN CAST(l AS VARCHAR) WHEN l < 10000 THEN printf('%d.%02dk', l // 1000, l % 1000 // 10) WHEN l < 100000 THEN printf('%d.%dk', l // 1000, l % 1000 // 100) WHEN l < 1000000 THEN printf('%dk', l // 1000)
             WHEN l < 10000000 THEN printf('%d.%02dm', l // 1000000, l % 1000000 // 10000) WHEN l < 100000000 THEN printf('%d.%dm', l // 1000000, l % 1000000 // 100000) ELSE printf('%dm', l // 1000000) END AS shown, k AS depth FROM size, depth""",
    "graph_letters": _with(DOCS, EVERYWHERE) + "SELECT substr(seg, pos + 1, 1) AS letter, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, max(node_start + pos) AS last FROM st JOIN p USING (node_id) GROUP BY 1",
    "graph_locations": _with(DOCS) + "SELECT node_id, node_start, len FROM p",
    "location_expand": _with(DOCS) + "SELECT loc, node_id, loc - node_start AS pos FROM (SELECT DISTINCT o_orderkey * 31 AS loc FROM orders) JOIN p ON loc >= node_start AND loc < node_start + len",
    "graph_revcomp": _with(DOCS, "rn AS (SELECT node_id * 2 AS node_id, seg_id, seg, len FROM n UNION ALL SELECT node_id * 2 + 1, 'revcomp:' || seg_id, translate(reverse(seg), 'acgt', 'tgca'), len FROM n), re AS (SELECT edge_id * 2 AS edge_id, src * 2 AS src, dst * 2 AS dst FROM e UNION ALL SELECT edge_id * 2 + 2, dst * 2 + 1, src * 2 + 1 FROM e)") + "SELECT node_id, seg_id, len, md5(seg) AS seg_md5, len - 1 AS last, coalesce(s, '') AS successors FROM rn LEFT JOIN (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY edge_id DESC) AS s FROM re GROUP BY src) ON src = node_id",
    "graph_extends": _with(DOCS, "sink AS (SELECT node_id, seg_id, row_number() OVER (ORDER BY node_id) AS r FROM n WHERE node_id NOT IN (SELECT src FROM e)), xe AS (SELECT src FROM e UNION ALL SELECT node_id FROM sink)") + "SELECT node_id, seg_id, len, coalesce(d, 0) AS degree FROM (SELECT node_id, seg_id, len FROM n UNION ALL SELECT (SELECT max(node_id) FROM n) + r, 'extend:' || seg_id, 1 FROM sink) LEFT JOIN (SELECT src, count(*) AS d FROM xe GROUP BY src) ON src = node_id",
    "graph_adjacency": _with(PARTS) + "SELECT node_id, seg_id, coalesce(f, '') AS forward, coalesce(b, '') AS backward, onward FROM n LEFT JOIN (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY edge_id DESC) AS f, CASE WHEN count(*) = 1 THEN min(dst) END AS onward FROM e GROUP BY src) ON src = node_id LEFT JOIN (SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY edge_id DESC) AS b FROM e GROUP BY dst) d ON d.dst = node_id",
    "edge_lookup": _with(DOCS) + "SELECT c_custkey AS edge_id, CASE WHEN c_custkey % 2 = 1 THEN dst ELSE src END AS src, CASE WHEN c_custkey % 2 = 1 THEN src ELSE dst END AS dst FROM customer JOIN e ON e.edge_id = c_custkey - c_custkey % 2",
    "gfa_round_trip": _with(PARTS) + "SELECT a.seg_id AS a, a.seg AS a_seg, b.seg_id AS b FROM e JOIN n a ON a.node_id = src JOIN n b ON b.node_id = dst",
    "graph_pairs": DOC_PAIRS + "SELECT kmer, loc FROM pairs",
    "part_pairs": PART_PAIRS + "SELECT kmer, loc FROM pairs",
    "pairs_from_starts": _with(DOCS, "st AS (SELECT node_id, 0 AS pos FROM n)", WALK) + "SELECT kmer, loc FROM pairs",
    "pairs_reachable": _with(OVERLAPPING, LINKS, STARTS, REACH, "st AS (SELECT node_id, unnest(range(len)) AS pos FROM n WHERE node_id IN (FROM lev))", WALK) + "SELECT kmer, loc FROM pairs",
    "saved_index": PART_PAIRS + "SELECT kmer, loc, node_id, seg_id, loc - node_start AS pos, len FROM pairs JOIN p ON loc >= node_start AND loc < node_start + len",
    "pair_codes": PART_PAIRS + f"SELECT kmer, code, {(4**PART_K - 1) // 3} + code AS level_code, substr(kmer, 2) || 't' AS pushed, left(kmer, {PART_K - 1}) AS popped, translate(reverse(kmer), 'acgt', 'tgca') AS rc FROM (SELECT kmer, CAST(list_sum(list_transform(range(1, {PART_K} + 1), lambda i: (instr('acgt', substr(kmer, i, 1)) - 1) * CAST(power(4, {PART_K} - i) AS BIGINT))) AS BIGINT) AS code FROM (SELECT DISTINCT kmer FROM pairs))",
    "index_stats": DOC_PAIRS + "SELECT count(*) AS num_pairs, count(DISTINCT kmer) AS num_kmers, count(DISTINCT loc) AS num_locs, round(count(DISTINCT kmer) / count(DISTINCT loc), 9) AS ff, round(count(DISTINCT kmer) / (SELECT power(4, k) FROM depth), 9) AS fill FROM pairs",
    "histogram_kmers": DOC_PAIRS + ", c AS (SELECT count(*) AS c FROM pairs GROUP BY kmer)," + HISTOGRAM,
    "histogram_locs": PART_PAIRS + ", c AS (SELECT count(*) AS c FROM pairs GROUP BY loc)," + HISTOGRAM,
    "word_lookup": DOC_PAIRS + f", {WORDS} SELECT kmer, count(*) AS n, min(loc) AS first, max(loc) AS last FROM q JOIN pairs USING (kmer) GROUP BY kmer",
    "word_locations": DOC_PAIRS + f", {WORDS} SELECT kmer, loc FROM q JOIN pairs USING (kmer)",
    "word_contains": DOC_PAIRS + f", {WORDS} SELECT kmer, kmer IN (SELECT kmer FROM pairs) AS found FROM q",
    "location_lookup": PART_PAIRS + "SELECT loc, kmer FROM pairs JOIN customer ON loc = c_custkey * 7",
    "multimap_words": PART_PAIRS + "SELECT kmer, CAST(count(*) AS INT) AS n, string_agg(CAST(loc AS VARCHAR), ',' ORDER BY loc) AS locs FROM pairs GROUP BY kmer",
    "posting_blocks": PART_PAIRS + "SELECT kmer, block, CAST(count(*) AS INT) AS n, min(loc) AS first, max(loc) AS last, md5(string_agg(CAST(loc AS VARCHAR), ',' ORDER BY loc)) AS locs_md5 FROM (SELECT kmer, loc, (row_number() OVER (PARTITION BY kmer ORDER BY loc) - 1) // 1024 AS block FROM pairs) GROUP BY 1, 2",
    "neighbour_ranks": _with(PARTS) + "SELECT src AS node_id, dst AS other, row_number() OVER (PARTITION BY src ORDER BY edge_id DESC) - 1 AS newest, 'forward' AS way FROM e UNION ALL SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY edge_id DESC) - 1, 'backward' FROM e",
    "code_offsets": PART_PAIRS + f", c AS (SELECT list_sum(list_transform(range(1, {PART_K} + 1), lambda i: (instr('acgt', substr(kmer, i, 1)) - 1) * CAST(power(4, {PART_K} - i) AS BIGINT))) AS code, count(*) AS m FROM pairs GROUP BY kmer) SELECT key, CAST(sum(coalesce(m, 0)) OVER (ORDER BY key) AS BIGINT) AS \"offset\" FROM range({4**PART_K}) t(key) LEFT JOIN c ON code = key",
    "word_prefixes": PART_PAIRS + f", {PREFIX} SELECT prefix, depth FROM prefixes",
    "short_match": PART_PAIRS + f", {PREFIX}, t AS (SELECT regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g') AS seg FROM conversations), q AS (SELECT '' AS kmer UNION SELECT substr(seg, CAST(i AS INT), CAST(j AS INT)) FROM (SELECT seg, j, unnest(range(1, length(seg) - j + 2)) AS i FROM t, range(1, {PART_K + 2}) r(j) WHERE length(seg) >= j)) SELECT kmer, CASE WHEN kmer IN (SELECT prefix FROM prefixes UNION SELECT kmer FROM pairs) THEN 'trie' ELSE 'invalid' END AS kind FROM q",
    "match_many": _with(DOCS) + "SELECT b.node_id, CAST(coalesce(list_position(list_transform(range(1, least(a.len, b.len) + 1), lambda i: substr(a.seg, CAST(i AS INT), 1) = substr(b.seg, CAST(i AS INT), 1)), false) - 1, least(a.len, b.len)) AS INT) AS matched FROM labels JOIN n a ON a.node_id = doc_id JOIN n b ON b.node_id = doc_id + 1",
    "edit_edges": _with(PARTS, EVERYWHERE, WALK, PREFIX, KNOWN, ALL_WORDS, ALPHABET, EDITS) + "SELECT src_kind, src_kmer, src_node_id, CAST(src_pos AS INT) AS src_pos, dst_kind, op, letter, count(*) AS n, CAST(sum(dst_node) AS BIGINT) AS sum_node, CAST(sum(dst_pos) AS BIGINT) AS sum_pos, min(dst_kmer) AS low_kmer, max(dst_kmer) AS high_kmer FROM edits GROUP BY 1, 2, 3, 4, 5, 6, 7",
    "handle_order": _with(PARTS, EVERYWHERE, WALK, PREFIX, HANDLES) + f"SELECT src_kind AS kind, src_kmer AS kmer, node_id, CAST(pos AS INT) AS pos, row_number() OVER (ORDER BY {HANDLE_KEY.format('src', 'node_id', 'pos')}) - 1 AS place FROM (SELECT kind AS src_kind, kmer AS src_kmer, node_id, pos FROM handles UNION SELECT 'graph', NULL, node_id, 0 FROM n)",
    "edge_order": _with(PARTS, EVERYWHERE, WALK, PREFIX, KNOWN, NO_WORDS, ALPHABET, EDITS) + f"SELECT src_kind, src_kmer, src_node_id, CAST(src_pos AS INT) AS src_pos, dst_kind, dst_kmer, dst_node, CAST(dst_pos AS INT) AS dst_pos, op, letter, row_number() OVER (ORDER BY {HANDLE_KEY.format('src', 'src_node_id', 'src_pos')}, {HANDLE_KEY.format('dst', 'dst_node', 'dst_pos')}, op, letter) - 1 AS place FROM (SELECT DISTINCT * FROM edits)",
    "previous_handles": PART_PAIRS + ", g AS (SELECT e.dst AS src_node, count(*) AS n_graph, CAST(sum(len - 1) AS BIGINT) AS sum_pos FROM e JOIN n ON n.node_id = e.src GROUP BY 1), t AS (SELECT node_id AS src_node, count(*) AS n_trie, min(kmer) AS first_word FROM p JOIN pairs ON loc = node_start GROUP BY 1) SELECT src_node, n_graph, sum_pos, n_trie, first_word FROM g FULL JOIN t USING (src_node)",
    "parent_handles": _with(PARTS, EVERYWHERE, WALK, PREFIX, HANDLES) + "SELECT kind, CASE WHEN kind = 'trie' AND kmer <> '' THEN 'trie' ELSE 'invalid' END AS up_kind, CASE WHEN kind = 'trie' AND kmer <> '' THEN left(kmer, length(kmer) - 1) END AS up_kmer, count(*) AS n FROM handles GROUP BY 1, 2, 3",
    "match_reach": _with(PARTS, EVERYWHERE, WALK, PREFIX, "known AS (SELECT prefix AS kmer FROM prefixes UNION SELECT kmer FROM pairs)") + f"SELECT CAST(length(kmer) AS INT) AS step, 'trie' AS kind, count(*) AS n FROM known GROUP BY 1 UNION ALL SELECT {PART_K + 1}, 'graph', count(*) FROM (SELECT node_id, loc - node_start + 1 AS pos FROM (SELECT DISTINCT loc FROM pairs) JOIN p ON loc >= node_start AND loc < node_start + len - 1 UNION SELECT e.dst, 0 FROM (SELECT DISTINCT loc FROM pairs) JOIN p ON loc = node_start + len - 1 JOIN e ON e.src = node_id) HAVING count(*) > 0",
    "match_closure": _with(PARTS, EVERYWHERE, WALK, PREFIX, KNOWN, """go(node_id, pos) AS (
      SELECT node_id, loc - node_start + 1 FROM (SELECT DISTINCT loc FROM pairs) JOIN p ON loc >= node_start AND loc < node_start + len - 1 UNION SELECT e.dst, 0 FROM (SELECT DISTINCT loc FROM pairs) JOIN p ON loc = node_start + len - 1 JOIN e ON e.src = p.node_id
      UNION SELECT x.node_id, x.pos FROM (SELECT go.node_id, go.pos + 1 AS pos FROM go JOIN n USING (node_id) WHERE go.pos + 1 < n.len UNION ALL SELECT e.dst, 0 FROM go JOIN n USING (node_id) JOIN e ON e.src = go.node_id WHERE go.pos + 1 = n.len) x)""") + "SELECT 'trie' AS kind, CAST(length(kmer) AS INT) AS size, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS INT) AS first, count(*) AS n FROM known GROUP BY 2 UNION ALL SELECT 'graph', NULL, node_id, CAST(min(pos) AS INT), count(*) FROM go GROUP BY 3",
    "labelled_reach": _with(ONE_LANGUAGE, GOOD, levels_from("SELECT DISTINCT node_id, 0 FROM begin JOIN n USING (node_id)")) + "SELECT node_id, level FROM lv",
    "pairs_from_labelled": _with(ONE_LANGUAGE, GOOD, REACH, "st AS (SELECT node_id, unnest(range(len)) AS pos FROM n WHERE node_id IN (FROM lev))", WALK) + "SELECT kmer, loc FROM pairs",
    "strong_components": _with(DOCS, STRONG) + "SELECT node_id, component FROM strong",
    "part_order": _with(OVERLAPPING, STRONG, ORDER),
    "whole_part_order": _with(PARTS, STRONG, ORDER),
    "back_edges": _with(DOCS, STRONG) + "SELECT edge_id, src, dst FROM e JOIN strong a ON a.node_id = src JOIN strong b ON b.node_id = dst WHERE a.component = b.component AND dst <= src",
    "node_levels": _with(PARTS, levels_from("SELECT min(node_id), 0 FROM n")) + "SELECT node_id, level FROM lv",
    "connected_components": _with(DOCS, LINKS, SPREAD, "low AS (SELECT node_id, min(root) AS root FROM spread GROUP BY 1)") + "SELECT node_id, root, dense_rank() OVER (ORDER BY root) - 1 AS comp_id FROM low",
    "starting_points": _with(OVERLAPPING, LINKS, STARTS) + "SELECT node_id, kind FROM begin",
    "complexity_regions": _with(DOCS, REGION) + "SELECT root, node_id, role FROM regions",
    "region_cover": _with(DOCS, REGION, EVERYWHERE, "cut AS (SELECT n.node_id, min(CASE WHEN role = 'internal' THEN 0 WHEN role = 'incoming' THEN len - 64 ELSE len END) AS first FROM n LEFT JOIN regions USING (node_id) GROUP BY 1)") + "SELECT CASE WHEN pos >= first THEN 'inside' ELSE 'outside' END AS part, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM st JOIN cut USING (node_id) GROUP BY 1",
    "fasta_round_trip": _with(DOCS) + "SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, seg_id, len, md5(seg) AS seg_md5 FROM n",
    "top_order": _with(DOCS, STRONG, ORDER),
    "edge_cycles": _with(DOCS, "back AS (SELECT edge_id, src, dst FROM e WHERE src >= dst)", levels_from("SELECT edge_id, dst, 0 FROM back", "edge_id")) + "SELECT edge_id, src, dst, CAST(level + 1 AS INT) AS cycle FROM back LEFT JOIN lv USING (edge_id) WHERE lv.node_id = src",
    "shortest_paths": _with(DOCS, "ends AS (SELECT DISTINCT n_nationkey * 7 AS start, n_nationkey * 7 + 10 + n_regionkey * 20 - n_nationkey AS finish FROM nation)", levels_from("SELECT DISTINCT start, start, 0 FROM ends JOIN n ON node_id = start", "start")) + "SELECT start, finish, CAST(level AS BIGINT) AS length, CAST(level AS BIGINT) AS edges FROM ends JOIN lv USING (start) WHERE lv.node_id = finish",
    "complexity_bounds": _with(PARTS, bounds(PART_K)) + "SELECT node_id, starts, ends FROM bound",
    "complexity_check": _with(PARTS, EVERYWHERE, WALK, bounds(PART_K)) + "SELECT count(*) AS nodes, count(*) FILTER (starts < words) AS too_low FROM (SELECT node_id, count(DISTINCT kmer) AS words FROM pairs JOIN p ON loc = node_start GROUP BY 1) JOIN bound USING (node_id)",
    "sparse_starts": _with(DOCS, EVERYWHERE, STRONG, TOP, """
        spot AS (SELECT node_id, len, row_number() OVER (ORDER BY level, component, node_id) - 1 AS place FROM strong JOIN top ON c = component JOIN n USING (node_id)),
        bent AS (SELECT DISTINCT dst FROM e JOIN strong a ON a.node_id = src JOIN strong b ON b.node_id = dst WHERE a.component = b.component AND dst <= src),
        feeds AS (SELECT d.place, list({'p': s.place + 1, 'l': s.len}) AS feeds FROM (SELECT DISTINCT src, dst FROM e WHERE dst NOT IN (FROM bent)) JOIN spot s ON s.node_id = src JOIN spot d ON d.node_id = dst GROUP BY 1),
        tag(i, tags) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i + 1, list_append(tags, coalesce(list_max(list_transform(feeds, lambda f: (tags[f.p] + f.l) % 64)), 63)) FROM tag JOIN spot ON place = i LEFT JOIN feeds USING (place)),
        last AS (SELECT tags FROM tag ORDER BY i DESC LIMIT 1)""") + "SELECT st.node_id, CAST(st.pos AS INT) AS pos FROM st JOIN spot USING (node_id), last WHERE (st.pos + tags[place + 1] + 1) % 64 = 0",
    "cut_pairs": _with(PARTS, EVERYWHERE.replace("st AS", "inside AS"), CUT) + "SELECT kmer, loc FROM cut_words",
    "size_estimate": " UNION ALL ".join(map(index_at, (0, 1, 2))),
    "hybrid_pairs": _with(PARTS.replace(f"SELECT {PART_K} AS k", f"SELECT {HYBRID_K} AS k"), bounds(HYBRID_K), HYBRID, CUT.replace("128", str(HYBRID_CUT)), WALK) + "SELECT kmer, loc FROM pairs UNION SELECT kmer, loc FROM cut_words",
}
