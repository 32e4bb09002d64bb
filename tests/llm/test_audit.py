import random
import re
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandex.llm import filter_audit

from .helpers import small

IDS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(IDS, st.lists(IDS, max_size=5))
def test_merges(ids, others):
    assert filter_audit.union([ids, *others]) == sorted(set(ids).union(*others))
    assert filter_audit.difference(ids, others) == sorted(set(ids).difference(*others))


@settings(max_examples=200, deadline=None)
@given(IDS, st.integers(-1, 61), st.integers(0, 60))
def test_gallop(ids, limit, at):
    at = min(at, len(ids))
    assert filter_audit.gallop(ids, at, limit) == next((k for k in range(at, len(ids)) if ids[k] >= limit), len(ids))


def brute(rows, labels):
    """rows (doc_id, lang, text), labels (doc_id, quality, toxic)."""
    marks = []
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        upper = sum("A" <= c <= "Z" for c in t)
        first = any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in rows)
        f = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * upper > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), first)) if bad}
        marks.append((lang or "", f, any(j == i is not None and q == 1 for j, q, _ in labels), any(j == i is not None and x == 1 for j, _, x in labels)))
    out = []
    for part in {m[0] for m in marks}:
        mine, shapley, mid = [m for m in marks if m[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                fails = sum(f in m[1] for m in mine)
                mid.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone), f))
        out += [(*m[:-1], shapley[m[-1]]) for m in mid]
    return sorted(out)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " ", long, long, long + " $", long.upper(), "a " * 300, "é漢 Word", "x" * 5000, "", long, "same words", "same words", "same words"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None, 20, 20, 19]
    langs = ["en", None, "", "en", "de", "en", "en", "de", None, "en", "en", "en", "de", "de", "en"]
    named = spark.createDataFrame(list(zip(ids, langs, texts)), "doc_id long, lang string, text string").withColumns({c: F.lit(7) for c in ("part", "mask", "salt", "id", "range", "name", "good")})
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, None), (None, 1, 1), (20, 1, 1), (0, None, None), (99, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    got = sorted(map(tuple, filter_audit.audit(named, known).collect()))
    assert got == brute(list(zip(ids, langs, texts)), labels) and len(got) == 600 * 3
    assert filter_audit.audit(named.limit(0), known).collect() == []
    bare = filter_audit.audit(named, known.limit(0))
    assert bare.where("good_lost > 0 or toxic_lost > 0").count() == 0 and bare.count() == 1800


def test_of_a_table_with_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 16)
    rows = [(r.doc_id, r.lang, r.text) for r in small(spark).collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in small(spark, "labels").collect()]
    assert sorted(map(tuple, filter_audit.audit(small(spark), small(spark, "labels")).collect())) == brute(rows, labels)


def test_hot_text(spark):
    rng = random.Random(5)
    rows = [(i, "en", "the same" if i % 3 else f"other {rng.random()}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    first = filter_audit.audit(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").first()
    assert (first.removed, first.kept) == (1999, 1001)
