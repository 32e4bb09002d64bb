import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandex.llm import substring_dedup as sd

from .helpers import TEXTS, small


def brute(rows, window=20):
    """rows (doc_id, text): (doc_id, n_words, n_removed, kept) as a sorted list."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    place = [((i is None, i or 0, xxhash.xxh3_64_intdigest((t or "").encode())), w) for (i, t), (_, w) in zip(rows, split)]
    first = {}
    for key, w in place:
        for s in range(len(w) - window + 1):
            gram = tuple(w[s : s + window])
            first[gram] = min(first.get(gram, (key, s)), (key, s))
    out = []
    for (key, w), (i, _) in zip(place, rows):
        gone = {j for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (key, s) for j in range(s, s + window)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def found(table, **more):
    return sorted(map(tuple, sd.without_repeats(table, **more).collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(4, 12))
def test_equal_windows_hold_equal_symbols(texts, window):
    sizes = np.array([len(t) for t in texts])
    words = sd.mixed(np.array([x + 5 for t in texts for x in t], np.uint64))
    name, low, high = sd._settled(words, sizes, window)
    first, seen = np.cumsum(sizes) - sizes, {}
    for a, n in zip(first.tolist(), sizes.tolist()):
        for s in range(a, a + n - window + 1):
            inside = sorted((lo - s, hi - s, x) for x, lo, hi in zip(name.tolist(), low.tolist(), high.tolist()) if s <= lo and hi <= s + window)
            assert seen.setdefault(tuple(words[s : s + window].tolist()), inside) == inside


def planted():
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 4000}"
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.randrange(5, 160))]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(20) : 30 + rng.randrange(40)]
        if i % 10 == 3:
            w += w[: rng.randrange(len(w))]  # repeats itself
        rows.append((i * 7 % 120, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300 + i, rows[i][1].replace(" ", "\n", 3) + " tail") for i in range(10)]
    return rows


@pytest.mark.parametrize("chunk, bucket", [(2_000_000, 16_000_000), (3_000, 5_000)])
def test_against_brute_force(spark, chunk, bucket):
    periodic = ["a " * 19, "a " * 20, "a " * 21, "a " * 90, "a b " * 40, "x " + "a b " * 12, "a b c " * 30, " ".join("ab"[bin(i).count("1") % 2] for i in range(256)), "b a " * 15]
    rows = planted() + list(enumerate(TEXTS, 500)) + list(enumerate(periodic, 600)) + [(600, "a " * 90), (600, "a " * 90), (None, "a b " * 40), (None, "b " * 30), (603, "a " * 90 + "end"), (-5, "a b c " * 10)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "ids", "kept", "bucket", "found")}).repartition(5)
    assert found(table, chunk=chunk, bucket=bucket) == brute(rows)


def test_of_a_table_and_an_empty_one(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    assert found(small(spark)) == brute(rows)
    assert found(small(spark).limit(0)) == []
    assert found(small(spark).limit(7).select("doc_id", F.lit(None).cast("string").alias("text"))) == sorted([(i, 0, 0, "") for i, _ in rows[:7]], key=str)


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own{i} {passage} end{i} " * 2) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.without_repeats(table, chunk=20_000).collect()}
    assert got[0].n_removed == 52 and all(got[i].kept == f"own{i} end{i}" for i in range(1, 2000))
