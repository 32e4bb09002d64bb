"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

OP3 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP4 = r"""
WITH RECURSIVE
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
raw AS (
  SELECT page_id, url, translate(regexp_extract(regexp_extract(coalesce(url, ''), '^[^#]*'), '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_extract(coalesce(url, ''), '^[^#]*'), length(regexp_extract(regexp_extract(coalesce(url, ''), '^[^#]*'), '(?s)^.*?://[^/?#]*')) + 1) AS key, coalesce(html, '') AS html,
         regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS canonical,
         regexp_extract(regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\bcontent\s*=\s*["'']([^"'']*)["'']', 1), '(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$', 1) AS redirect
  FROM pages),
links AS (SELECT key AS a, regexp_extract(trim(canonical), '^[^#]*') AS b FROM raw WHERE canonical <> '' UNION SELECT key, regexp_extract(trim(redirect), '^[^#]*') FROM raw WHERE redirect <> ''),
edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(root, node) AS (SELECT a, a FROM edges UNION SELECT r.root, e.b FROM reach r JOIN edges e ON r.node = e.a),
urls AS (SELECT DISTINCT key AS u FROM raw UNION SELECT a FROM edges),
parts AS (
  SELECT u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
fits AS (
  SELECT u, h || p AS rule, verdict, row_number() OVER (PARTITION BY u ORDER BY length(h || p) DESC) AS k
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
named AS (SELECT p.*, f.rule, f.verdict AS own FROM parts p LEFT JOIN fits f ON p.u = f.u AND f.k = 1),
bad AS (SELECT r.root AS u FROM reach r JOIN named n ON r.node = n.u GROUP BY 1 HAVING bool_or(n.own = 'block') AND NOT coalesce(bool_or(n.own = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN b.u IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM raw JOIN named n ON raw.key = n.u LEFT JOIN bad b ON n.u = b.u
"""

OP7 = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
place AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT p.r, p.i, p.k, win.item_id FROM (SELECT r, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM place) p JOIN win USING (k, gram)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP8 = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(root, node) AS (SELECT a, a FROM edge UNION SELECT r.root, e.b FROM reach r JOIN edge e ON r.node = e.a),
comp AS (SELECT root AS doc_id, min(node) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM doc d LEFT JOIN size s USING (doc_id) LEFT JOIN comp c USING (doc_id)
"""

def _clustering(k: int, rounds: int) -> str:
    """Every round a step of its own; c{r} holds the centroids (c, d, x), a{r} the nearest one of each vector."""
    out = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "long AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM kept)",
        "part AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS d, unnest(v) AS x FROM long)",
        f"first AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS d, unnest(v) AS x FROM first)",
    ]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x)) AS s FROM part p JOIN c{r} c USING (d) GROUP BY 1, 2) GROUP BY 1)")
        if r < rounds:
            out.append(f"m{r} AS (SELECT a.c, p.d, CAST(floor(sum(p.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN part p USING (r) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c, d, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c, d))")
    named = f"(SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS name FROM c{rounds} GROUP BY c)"
    return "WITH " + ",\n".join(out) + f"\nSELECT vec_id, CAST(c AS INT) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, name AS centroid_sha256 FROM a{rounds} JOIN long USING (r) JOIN {named} USING (c)"


OP13 = r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
low AS (SELECT t, min(doc_id) AS m FROM doc GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
mark AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(doc_id > m, false) THEN 'E' ELSE '' END AS fails
  FROM doc JOIN low USING (t) LEFT JOIN lab USING (doc_id)),
sum_up AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM mark GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, k AS step, substr(o, k, 1) AS f, '[' || substr(o, 1, k) || ']' AS upto, CASE WHEN k = 1 THEN '^$a' ELSE '[' || substr(o, 1, k - 1) || ']' END AS earlier FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS k)),
counted AS (
  SELECT part, o, step, f,
    coalesce(sum(n) FILTER (NOT regexp_matches(fails, upto)), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, f) AND NOT regexp_matches(fails, earlier)), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND regexp_matches(fails, earlier)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, f) AND NOT regexp_matches(fails, earlier)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, f) AND NOT regexp_matches(fails, earlier)), 0) AS toxic_lost
  FROM steps, sum_up GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

OP12 = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 20)) AS j FROM again)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM doc),
rest AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN rest USING (r)
"""

ORACLE_SQL = {"op12_recompression": OP12, "op11_centroids": _clustering(40, 5), "op13_filter_audit": OP13, "op3_exact_dedup": OP3, "op4_url_filter": OP4, "op7_contamination": OP7, "op8_near_dedup": OP8}
