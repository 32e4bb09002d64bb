"""Global ranks and prefix sums: a range partition puts rows in order, each range counts its own, and offsets over ranges make the numbers global.

Only one row for each range ever meets in one task. Where a range ends doesn't change any result; ranges come from a sample of the keys, so sparse or hashed keys
spread like dense ones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .storage import stored

_RANGE_BITS = 33  # monotonically_increasing_id: the partition's number stands above so many bits


def _offsets(totals: DataFrame) -> DataFrame:
    """__part, __start: sums of the ranges before each one, from totals (__part, __sum): a row a range."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    return F.broadcast(totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__start")))


def ranks(rows: DataFrame, *keys: str | Column, name: str = "rank", distinct: bool = False) -> DataFrame:
    """rows with their place (0, 1, ...) in the order of the keys; rows equal in all keys follow each other in any order. distinct: of equal rows one counts; they meet in a range, so it
    takes no exchange of its own (keys must be columns)."""
    ranged = rows.repartitionByRange(*keys)
    ordered = (ranged.distinct() if distinct else ranged).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    at = stored(ordered, "ranked").withColumn("__part", F.shiftright("__id", _RANGE_BITS)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1)))
    counts = at.groupBy("__part").agg(F.count("*").alias("__sum"))
    return at.join(_offsets(counts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__id", "__part", "__at", "__start")


def _summed(it, value: str):
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in it:
        v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
        before = total + np.cumsum(v) - v
        total += int(v.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(v), part, np.int32)), pa.array(before), pa.array(v)], ["__key", "__part", "__in", "__value"])


def running_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value (long, not null) over the rows before, in the order of a unique key. Only key and value are sorted; the rows move once, to be joined."""
    narrow = rows.select(F.col(key).alias("__key"), F.col(value).cast("long").alias("__value"))
    kind = narrow.schema["__key"].dataType
    shape = StructType([StructField("__key", kind), StructField("__part", IntegerType()), StructField("__in", LongType()), StructField("__value", LongType())])
    sums = stored(narrow.repartitionByRange("__key").sortWithinPartitions("__key").mapInArrow(partial(_summed, value="__value"), shape), "summed")
    starts = _offsets(sums.groupBy("__part").agg(F.sum("__value").alias("__sum")))
    whole = sums.join(starts, "__part").select("__key", (F.col("__start") + F.col("__in")).alias(name))
    return rows.join(whole, rows[key] == whole["__key"]).drop("__key")


def _counted_groups(it, keys: int):
    """Batches with __part and __in: how many rows of the same group came before in this range."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in range(keys):
            column = batch.column(k)
            code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        head = tuple(batch.column(k)[0].as_py() for k in range(keys))
        new[0] = head != last
        before = seen if not new[0] else 0
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        inside = np.arange(n) - first
        inside[: int(np.argmax(new[1:])) + 1 if new[1:].any() else n] += before
        last, seen = tuple(batch.column(k)[n - 1].as_py() for k in range(keys)), int(inside[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(inside.astype(np.int64))], [*batch.schema.names, "__part", "__in"])


def group_ranks(rows: DataFrame, groups: list[str], keys: list[str | Column], name: str = "rank") -> DataFrame:
    """rows with their place (0, 1, ...) among those equal in the columns groups, in the order of the keys. A group of any size is cut into ranges: no task has to hold or sort it
    as a whole. Groups that lie in several ranges are fewer than the ranges; only their offsets are joined."""
    front = rows.select(*groups, *(c for c in rows.columns if c not in groups))
    shape = StructType([*front.schema.fields, StructField("__part", IntegerType()), StructField("__in", LongType())])
    ordered = front.repartitionByRange(*groups, *keys).sortWithinPartitions(*groups, *keys)
    at = stored(ordered.mapInArrow(partial(_counted_groups, keys=len(groups)), shape), "group-ranks")
    parts = at.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    wide = parts.groupBy(*groups).agg(F.min("__part").alias("__a"), F.max("__part").alias("__b")).where("__a < __b").select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)]
    few = parts.join(F.broadcast(wide), same)  # fewer rows than twice the ranges
    before = Window.partitionBy(*(f"__g{k}" for k in range(len(groups)))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few.select(*(f"__g{k}" for k in range(len(groups))), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = at.join(F.broadcast(offsets), [*same, F.col("__part") == F.col("__p")], "left")
    return out.withColumn(name, F.coalesce("__start", F.lit(0)) + F.col("__in")).select(*rows.columns, name)
