"""A saved index: posting lists by word and words by location, each in sorted buckets, with a manifest to open them again.

Words: (kmer, block, n, first, last, locs), the locations of a word cut into blocks of BLOCK, ascending, which the file format delta-codes; a word of any number of locations is a number of
bounded rows. Places: (loc, kmer). Both tables are bucketed by their key, so a join with asked keys moves the keys only, and a few keys read their buckets only.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import group_ranks
from ..functions.storage import counted, drop_stored

BLOCK = 1024  # locations of a row
PAIRS_PER_BUCKET = 4_000_000
FEW = 200  # so many keys are looked up in their buckets only; more are joined
_WORDS, _PLACES = "kmer STRING, block BIGINT, n INT, first BIGINT, last BIGINT, locs ARRAY<BIGINT>", "loc BIGINT, kmer STRING"
#: Sorted lists of numbers are stored as differences by this version of the format.
_DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}


@dataclass
class SavedIndex:
    path: str
    k: int
    buckets: int
    num_pairs: int
    words: DataFrame | None
    places: DataFrame


def posting_blocks(pairs: DataFrame, key: str = "kmer", value: str = "loc", block: int = BLOCK, unique: bool = False) -> DataFrame:
    """key, block, n, first, last, <value>s (ascending): the distinct values of each key in blocks; a key's values are ranked in ranges, and no list is longer than a block.
    unique: no pair repeats, so none has to be looked for."""
    rows = pairs.select(key, value)
    at = group_ranks(rows if unique else rows.distinct(), [key], [value]).withColumn("block", F.expr(f"rank div {block}"))
    lists = at.groupBy(key, "block").agg(F.sort_array(F.collect_list(value)).alias("values"))
    return lists.select(key, "block", F.size("values").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"), F.col("values").alias(f"{value}s"))


def _write(df: DataFrame, key: str, order: list[str], buckets: int, path: str) -> None:
    name = "saved_" + hashlib.md5(path.encode()).hexdigest()
    df.repartition(buckets, key).sortWithinPartitions(*order).write.options(**_DELTAS).option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # its files stay


def save_places(pairs: DataFrame, k: int, path: str, buckets: int | None = None) -> SavedIndex:
    """The part of save_index() that needs no posting lists: words by location, and the manifest. add_words() brings the rest."""
    spark = pairs.sparkSession
    rows, size = counted(pairs.select("kmer", "loc"), "index-pairs", n=F.count("*"))
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PAIRS_PER_BUCKET))
    _write(rows, "loc", ["loc", "kmer"], buckets, f"{path}/places")
    manifest = json.dumps({"format": 1, "k": k, "buckets": buckets, "num_pairs": size["n"]})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")
    drop_stored(rows)
    return open_index(spark, path, words=False)


def add_words(spark: SparkSession, path: str) -> SavedIndex:
    """Posting lists beside the places that save_places() wrote."""
    saved = open_index(spark, path, words=False)
    _write(posting_blocks(saved.places.select("kmer", "loc"), unique=True), "kmer", ["kmer", "block"], saved.buckets, f"{path}/words")
    return open_index(spark, path)


def save_index(pairs: DataFrame, k: int, path: str, buckets: int | None = None) -> SavedIndex:
    """Write pairs (kmer, loc), each once as builders give them, to path, which must not exist; the number of buckets grows with them unless given."""
    save_places(pairs, k, path, buckets)
    return add_words(pairs.sparkSession, path)


def open_index(spark: SparkSession, path: str, words: bool = True) -> SavedIndex:
    """The index saved at path, in this or any later session; without words if only its places are needed, or there."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if about["format"] != 1:
        raise ValueError(f"unknown format of the index at {path}")
    tables = {}
    for part, shape, key, order in (("words", _WORDS, "kmer", "kmer, block"), ("places", _PLACES, "loc", "loc, kmer"))[not words :]:
        name = f"{part}_{hashlib.md5(path.encode()).hexdigest()}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({shape}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {about['buckets']} BUCKETS LOCATION '{path}/{part}'")
        tables[part] = spark.table(name)
    return SavedIndex(path, about["k"], about["buckets"], about["num_pairs"], tables.get("words"), tables["places"])


def _asked(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows of a table that keys may name: of a few keys only their buckets are read."""
    some = [r[0] for r in keys.select(key).distinct().limit(FEW + 1).collect()]
    return table.where(F.col(key).isin([k for k in some if k is not None])) if len(some) <= FEW else table


def locations_of(words: DataFrame, index: SavedIndex) -> DataFrame:
    """words (kmer, ...) with each loc stored for them."""
    return words.join(_asked(words, index.words, "kmer").select("kmer", "locs"), "kmer").withColumn("loc", F.explode("locs")).drop("locs")


def counts_of(words: DataFrame, index: SavedIndex) -> DataFrame:
    """words (kmer, ...) with n, first and last of their locations, from the blocks' heads alone; words that aren't stored go."""
    heads = _asked(words, index.words, "kmer").groupBy("kmer").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return words.join(heads, "kmer")


def words_of(locs: DataFrame, index: SavedIndex) -> DataFrame:
    """locs (loc, ...) with each kmer stored for them."""
    return locs.join(_asked(locs, index.places, "loc"), "loc")


def contained(words: DataFrame, index: SavedIndex) -> DataFrame:
    """words (kmer, ...) with found: whether they are stored."""
    known = _asked(words, index.words, "kmer").where("block = 0").select("kmer", F.lit(True).alias("__hit"))
    return words.join(known, "kmer", "left").withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def listed(index: SavedIndex) -> DataFrame:
    """kmer, n, locs: the whole list of each word as text; the blocks' texts are joined, values aren't collected anew."""
    text = index.words.select("kmer", "block", "n", F.array_join(F.transform("locs", lambda x: x.cast("string")), ",").alias("text"))
    return text.groupBy("kmer").agg(F.sum("n").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), ",").alias("locs"))
