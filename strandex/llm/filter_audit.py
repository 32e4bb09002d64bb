"""How filters overlap: what each removes in every order, from posting lists of failing documents.

1. Each document gets a row number, and the filters that it fails: A few words, B repeated words, C capitals, D symbols, E the text of a smaller doc_id.
2. For each part, filter and range of row numbers the failing ones are kept as a sorted posting list, and so are the good and the toxic ones.
   A range holds RANGE rows at most, so no list and no group grows with the input.
3. In a range, unions and differences of lists come from galloping k-way merges: the list with the smallest head jumps, by steps that double and a
   binary search, to the first id that isn't below the other heads. For every filter and every set of filters before it the sizes are taken: 80 rows.
4. Sizes are summed over ranges; the 120 orders of a part are looked up among them, since only the set of earlier filters matters, not its order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored

FILTERS = "ABCDE"
RANGE = 1 << 15  # row numbers of a range
SALTS = 16  # a text that many documents share is looked up in so many groups
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def gallop(ids: list[int], at: int, limit: int) -> int:
    """The first place from `at` on whose id isn't below limit: steps double, then a binary search between the last two."""
    step, low = 1, at
    while low + step < len(ids) and ids[low + step] < limit:
        low += step
        step *= 2
    return bisect_left(ids, limit, low, min(low + step, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """The ids in any of some sorted lists, each list without repeats."""
    heads, out = [[x[0], k, 0] for k, x in enumerate(lists) if x], []
    while heads:
        heads.sort()
        head, k, at = heads[0]
        if len(heads) == 1:
            out.extend(lists[k][at:])
            break
        if head == heads[1][0]:
            end = at + 1  # the other list brings it
        else:
            end = gallop(lists[k], at, heads[1][0])
            out.extend(lists[k][at:end])
        if end < len(lists[k]):
            heads[0] = [lists[k][end], k, end]
        else:
            heads.pop(0)
    return out


def difference(ids: list[int], others: list[list[int]]) -> list[int]:
    """The ids that are in none of the other sorted lists."""
    places, out, at = [0] * len(others), [], 0
    while at < len(ids):
        low, found = None, False
        for k, other in enumerate(others):
            places[k] = p = gallop(other, places[k], ids[at])
            if p < len(other):
                found = found or other[p] == ids[at]
                low = other[p] if low is None or other[p] < low else low
        if found:
            at += 1
        else:
            end = len(ids) if low is None else gallop(ids, at, low)
            out.extend(ids[at:end])
            at = end
    return out


def fails(text: str, words_least: int = 200) -> int:
    """The filters A to D that a text fails, as bits 0 to 3. Words are runs of bytes other than 0x20 and 0x09-0x0D."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    few = len(words) < words_least
    repeated = 100 * len(set(words)) < 50 * len(words)
    capitals = 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * len(text)
    symbols = len(raw) != len(raw.translate(None, b"#$%&*|"))
    return few | repeated << 1 | capitals << 2 | symbols << 3


def _judged(it):
    for rows in batches(it, ["doc_id", "part", "text"]):
        texts = [t or "" for _, _, t in rows]
        digests = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([fails(t) for t in texts], pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits 0 to 4: fails A to E) for each row of docs (doc_id, text, lang).

    Null texts are empty, a null lang is the part ''. E compares whole texts (by SHA-256) over the table; a null doc_id neither fails E nor makes others fail, and rows
    that repeat a doc_id don't make each other fail.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(_judged, "doc_id long, part string, mask int, digest binary")
    rows = stored(rows, "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    out = rows.withColumn("salt", salt).join(salted, ["digest", "salt"], "left")
    return out.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))


def postings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, range, name, ids: sorted row numbers of the rows that fail a filter (name A to E), are good or toxic by labels; name all: n only.

    Of several labels of a doc_id any 1 counts. Rows of docs that share a doc_id share its labels.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = judged(docs).join(known, "doc_id", "left").select(F.monotonically_increasing_id().alias("id"), "part", "mask", "good", "toxic")
    rows = stored(rows, "audit-rows")  # from here on a row's number stays
    names = [F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, F.lit(f)) for k, f in enumerate(FILTERS)] + [F.when(F.col(c) == 1, F.lit(c)) for c in ("good", "toxic")]
    at = rows.select("part", F.floor(F.col("id") / RANGE).alias("range"), "id", F.array_compact(F.array(*names)).alias("names"))
    lists = at.select("part", "range", F.explode("names").alias("name"), "id").groupBy("part", "range", "name").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))
    counts = at.groupBy("part", "range").agg(F.count("*").alias("n")).select("part", "range", F.lit("all").alias("name"), F.array().cast("array<bigint>").alias("ids"), "n")
    return lists.union(counts)


_SIZES = "part string, filter string, before string, removed long, redundant long, after long, good_lost long, toxic_lost long"


def _sizes(group):
    """For each filter and each set of earlier ones, sizes in a range."""
    import pandas as pd

    lists = {name: ids.tolist() for name, ids in zip(group["name"], group["ids"])}
    n = int(group.loc[group["name"] == "all", "n"].iloc[0])
    of, out = {f: lists.get(f, []) for f in FILTERS}, []
    for f in FILTERS:
        rest = [g for g in FILTERS if g != f]
        for k in range(len(rest) + 1):
            for before in combinations(rest, k):
                gone = difference(of[f], [of[g] for g in before])
                lost = [len(gone) - len(difference(gone, [lists.get(c, [])])) for c in ("good", "toxic")]
                after = n - len(union([of[f], *(of[g] for g in before)]))
                out.append((group["part"].iloc[0], f, "".join(before), len(gone), len(of[f]) - len(gone), after, *lost))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _SIZES.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the five filters (filter_order, 120 permutations, applied left to right) and step (1 to 5): kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, as counts of rows in the part.

    See judged() and postings() for nulls, repeated rows and labels. Other columns of both tables are ignored; without documents there are no parts and
    no rows, without labels nothing good or toxic is lost.
    """
    lists = postings(docs, labels).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "range")  # small, but work: not to be put into one task
    sizes = lists.groupBy("part", "range").applyInPandas(_sizes, _SIZES).groupBy("part", "filter", "before")
    sizes = stored(sizes.agg(*(F.sum(c).alias(c) for c in ("removed", "redundant", "after", "good_lost", "toxic_lost"))), "audit-sizes")  # 80 rows a part
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), F.length("before") + 1)
    whole = sizes.groupBy("part", "filter").agg(F.sum(F.when(F.length("before") == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    steps = [("".join(p), k + 1, p[k], "".join(sorted(p[:k]))) for p in permutations(FILTERS) for k in range(len(p))]
    orders = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before string"))  # 600 rows
    out = sizes.join(whole, ["part", "filter"]).join(orders, ["filter", "before"])
    return out.select("part", "filter_order", "step", F.col("after").alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
