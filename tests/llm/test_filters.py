import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandex.llm import contamination, quality, toxicity, url_filter
from strandex.llm.queries import RULES
from strandex.llm.url_filter import Rule

from .helpers import docs, small


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def verdicts(spark, rows, rules=RULES, **more):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages(spark, rows), rules, **more).collect()}


def test_rules(spark):
    urls = ["http://A.Example.NET/x?y#z", "https://example.net/en/a", "http://example.com/de/", "http://x.org/fr/", "http://net", "http://net/", "nothing", None, "ftp://badnet/", "http://example.com?de/"]
    got = verdicts(spark, [(u, None) for u in urls])
    assert [got[i] for i in range(10)] == [
        ("a.example.net", "/x", "net/", "block"), ("example.net", "/en/a", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("net", "", None, "allow"),
        ("net", "/", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("badnet", "/", None, "allow"), ("example.com", "", None, "allow"),
    ]


def test_decisions_reach_aliases(spark):
    link = '<link href="{}" rel=canonical>'
    html = [("http://a.com/1", link.format("http://b.net/2").replace("rel=canonical", 'rel="canonical"')), ("http://c.com/x", "<meta http-equiv='refresh' content='0; url=/1'>"), ("http://c.com/1", '<link rel="canonical" href="//a.com/1#top">'), ("http://d.org/fr/q", '<link rel="canonical" href="http://e.net/z">'), ("http://f.com/", '<link rel="canonical" href="http://e.net/z">'), ("http://g.com/", "<p>")]
    got = {k: v[3] for k, v in verdicts(spark, html).items()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    more = spark.createDataFrame([("http://g.com/", "http://net/")], "src string, dst string")
    assert verdicts(spark, html, redirects=more)[5][3] == "block"
    assert verdicts(spark, []) == {}


def canonical(to):
    return f'<link rel="canonical" href="{to}">'


def test_case_references_and_several_tags(spark):
    rows = [
        ("HTTP://Site.com/a", canonical("http://other.net/x")), ("http://site.COM/a#b", None), ("http://site.com/A", None),
        ("http://q.com/1", canonical("http://r.com/?a=1&amp;b=2")), ("http://r.com/?a=1&b=2", canonical("http://bad.net/")),
        ("http://two.com/", canonical("http://clean.com/") + canonical("http://evil.net/")), ("http://two.com/", None), ("http://two.com/", "<p>"), (None, canonical("http://evil.net/")),
    ]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow"}


def test_a_long_chain_and_a_hot_component(spark):
    chain = [(f"http://c{i}.com/", canonical(f"http://c{i + 1}.com/")) for i in range(150)] + [("http://c150.com/", canonical("http://end.net/"))]
    hub = [(f"http://h{i}.com/", "<meta http-equiv=refresh content='0;url=http://hub.com/'>") for i in range(1500)]
    free = [(f"http://f{i}.com/", canonical("http://x.org/fr/")) for i in range(20)] + [("http://f0.com/", canonical("http://bad.net/"))]
    table = pages(spark, chain + hub + [("http://hub.com/", canonical("http://hub.net/"))] + free).withColumns({"rule": F.lit("x"), "key": F.lit(1), "component": F.lit(None)})
    got = [r.verdict for r in url_filter.judged(table, RULES).orderBy("page_id").collect()]
    assert got == ["block"] * (151 + 1501) + ["allow"] * 21


def test_longest_rule_wins(spark):
    rules = [Rule("com", "/", "block"), Rule("a.com", "/", "allow"), Rule("a.com", "/x/", "block")]
    got = verdicts(spark, [("http://a.com/", None), ("http://w.a.com/x/y", None), ("http://b.com/", None)], rules)
    assert [got[i][3] for i in range(3)] == ["allow", "block", "block"]


def brute_hits(text, items, size=10):
    words = contamination.normalised(text or "")
    hit, found = set(), set()
    for item, t in items:
        w = contamination.normalised(t)
        if not w:
            continue
        k = min(size, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40, 1])
def test_contamination(spark, part_bytes):
    item = "What IS the, capital of Fran-ce today? Answer: Paris (the city of light)"
    texts = ["x " * 30 + item + " tail", item.upper(), item.replace(" ", "\n--"), "the city", None, "", "café short item", "Café Short  ITEM café", "of light) What IS the, capital of Fran-ce today? Answer: Paris"]
    bench = spark.createDataFrame([(1, item), (10, "café short item"), (2, ""), (3, None), (11, "..."), (1, item), (12, "of light What is the capital of fran ce today answer paris"), (None, "short item")], "item_id long, text string")
    items = [("1", item), ("10", "café short item"), ("12", "of light What is the capital of fran ce today answer paris"), ("", "short item")]
    table = docs(spark, [*texts, item], [*range(7), 7, None, 7]).withColumns({"items": F.lit(1), "ranges": F.lit(2), "n_words": F.lit("x")})
    by_text = {t: brute_hits(t, items) for t in [*texts, item]}
    rows = contamination.contaminated(table, bench, part_bytes=part_bytes).collect()
    assert sorted(((r.n_words, r.n_hit, r["items"]) for r in rows), key=str) == sorted(by_text.values(), key=str)
    for r in rows:
        if r.doc_id not in (7, None):
            assert (r.n_words, r.n_hit, r["items"]) == by_text[texts[r.doc_id]]
            inside = [w for a, b in r.spans for w in contamination.normalised(texts[r.doc_id][a:b])]
            assert len(inside) == r.n_hit
    assert sorted(r.doc_id is None for r in rows) == [False] * (len(rows) - 1) + [True] and sum(r.doc_id == 7 for r in rows) == 2
    kept = contamination.clean_documents(table, bench, part_bytes=part_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == table.columns
    assert contamination.contaminated(table, bench.limit(0)).where("n_hit > 0").count() == 0 and contamination.contaminated(table.limit(0), bench).count() == 0


def test_contamination_of_a_table(spark):
    items = [(str(r.item_id), r.text) for r in small(spark, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    for r in contamination.contaminated(small(spark), small(spark, "benchmark")).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(texts[r.doc_id], items)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def table(spark, size, name):
    return spark.read.parquet(f"/root/testdata/{size}/{name}.parquet")


def held_out_accuracy(spark, scored, label, size="sf0.01"):
    truth = {r.doc_id: r[label] for r in table(spark, size, "labels").collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in scored.collect() if r.held_out and r.doc_id in truth]
    return sum(p == y for p, y in rows) / len(rows)


def test_quality(spark):
    d, labels = table(spark, "sf0.01", "documents"), table(spark, "sf0.01", "labels")
    trees = quality.fit(d, labels)
    out = quality.scored(d, trees)
    assert held_out_accuracy(spark, out, "quality") > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in out.collect())
    assert quality.scored(docs(spark), trees).count() == 9 and quality.scored(docs(spark, []), trees).count() == 0
    kept = {r.doc_id for r in quality.good_documents(d, trees).collect()}
    assert kept == {r.doc_id for r in out.collect() if r.predicted}


def test_trees_follow_the_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, quality.FEATURES))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.boosted(x, y, rounds=30, depth=3)
    slow = []
    for row in x[:50]:
        total = trees.base
        for node in trees.roots:
            while trees.left[node] >= 0:
                node = trees.left[node] + int(row[trees.feature[node]] > trees.limit[node])
            total += trees.value[node]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.score(x[:50]), slow) and ((trees.score(x) > 0.5) == y).mean() > 0.95
    assert quality.boosted(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_toxicity(spark):
    d, labels = table(spark, "sf0.01", "documents"), table(spark, "sf0.01", "labels")
    model = toxicity.fit(d, labels)
    out = toxicity.scored(d, model)
    assert held_out_accuracy(spark, out, "toxic") > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in out.collect())
    plain, spread, clean = (toxicity.WordCache(model).tops([t])[0, 0] for t in ("the idiot", "the idi-iot and i d i o t", "the and of"))
    assert plain > 0 and spread > 0 and clean < 0
    assert toxicity.scored(docs(spark), model).count() == 9 and toxicity.scored(docs(spark, []), model).count() == 0
    empty = toxicity.fit(d, labels.limit(0))
    assert toxicity.scored(d, empty).where("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_repeated_and_null_rows(spark, operator, label):
    d = small(spark).select("doc_id", "text").where("doc_id < 60")
    known = table(spark, "sf0.001", "labels")
    odd = known.union(known).select("doc_id", "quality", "toxic").union(spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").select(*(F.col(c).cast(t) for c, t in known.select("doc_id", "quality", "toxic").dtypes)))
    many = d.union(d).union(spark.createDataFrame([(None, "some words"), (7, None), (7, "")], "doc_id long, text string")).withColumns({"label": F.lit("x"), "x": F.lit(1), "held_out": F.lit(None), "score": F.lit(2)})
    model = operator.fit(many, odd, max_rows=1000)
    rows = operator.scored(many, model).collect()
    assert len(rows) == many.count() and all(0 <= r.score <= 1 for r in rows) and sum(r.doc_id is None for r in rows) == 1
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(round(r.score, 12))
    assert all(len(set(s)) == 1 for i, s in by_id.items() if i != 7) and len(set(by_id[7])) <= 2
    none = operator.scored(d, operator.fit(d, known.limit(0))).select("score").distinct().count()
    assert none == 1 and operator.scored(d.limit(0), model).count() == 0 and operator.fit(d.limit(0), known) is not None


def slow_kernel(u, v):
    """Gap-weighted subsequences of three characters, by definition."""
    def features(w):
        out = {}
        for j in range(2, toxicity.SPAN):
            for i in range(1, j):
                for a in range(len(w) - j):
                    key = w[a] + w[a + i] + w[a + j]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (j + 1)
        return out

    f, g = features(u), features(v)
    dot = lambda a, b: sum(x * b.get(k, 0) for k, x in a.items())
    return dot(f, g) / np.sqrt(dot(f, f) * dot(g, g))


def test_kernel_and_collapsed_table():
    words = ["idiot", "idiiot", "idxiot", "banana", "worthless"]
    k = toxicity.dense_kernel(words, words)
    assert np.allclose(k, [[slow_kernel(u, v) for v in words] for u in words], atol=1e-6)
    model = toxicity.train_words(["idiot", "moron", "worthless"], ["banana", "window", "garden", "people", "thing"], 6)
    direct = model.decisions(["idiot", "gardens"])
    r, s, v = toxicity.mapped(["idiot", "gardens"])
    assert np.allclose(direct, np.bincount(r, v * model.table[s], 2) + model.bias) and direct[0] > 0 > direct[1]
