"""Exact deduplication as a stream over disk-backed keyed state, in DataFrame operations only.

A stream of (digest, doc_id, locator) is grouped by digest. The state store (RocksDB, checkpointed to the shared folder, never
expired) keeps for each digest the identifier that stays, where its content lies, and the number of rows. Every digest that has a second
row is a hit; hits are compared with the full bytes of the row that stays, so two texts of one digest are told apart. Running again with the same
state folder and other documents goes on where the last run stopped: content of earlier runs is fetched by its locator.

A state folder holds the digests of all runs (the stream's input), the stream's checkpoint and each run's updates.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import counted, shared_path, stored

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for each
}
#: For state that no later run reads: no checksum files beside those of the stores. Each file costs an executor several processes where Hadoop's native library is missing.
_PASSING_CONF = {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false"}


def sha256_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, columns: list[str], names: tuple[str, str] = ("__file", "__row")) -> DataFrame:
    """The columns of docs with the place of each row (file, row in it); other sources than files are stored first."""
    place = [F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        return stored(docs, "located", lasting=True).select(*columns, *place)


def _stream(spark: SparkSession, kind: str, state_dir: str, run: str, max_bytes_per_trigger: int, lasting: bool) -> DataFrame:
    """Run the stream over the digests that no run has read yet; returns the last state of each digest that this run has touched."""
    out = f"{state_dir}/updates/{run}"
    shape = f"digest string, best struct<doc_id:{kind},__file:string,__row:bigint>, n bigint"
    reader = spark.readStream.schema(f"doc_id {kind}, digest string, __file string, __row bigint, run string").option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    best = F.max(F.struct("doc_id", "__file", "__row")).alias("best")
    state = reader.parquet(f"{state_dir}/digests").groupBy("digest").agg(best, F.count("*").alias("n"))
    spark.range(0).select(F.lit(None).cast("string").alias("digest")).write.mode("append").parquet(f"{out}/batch=-1")  # so that the folder exists
    conf = _STATE_CONF if lasting else _STATE_CONF | _PASSING_CONF
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(shape).parquet(out).groupBy("digest").agg(F.max(F.struct("n", "best")).alias("s")).select("digest", F.col("s.n").alias("n"), F.col("s.best").alias("best"))


def _fetched(places: DataFrame) -> DataFrame:
    """places (digest, at: doc_id, __file, __row) with text, read from the files that they name. Only these files' paths go to the driver."""
    spark = places.sparkSession
    files = [unquote(r[0]) for r in places.select("at.__file").distinct().toLocalIterator()]
    if not files:
        return places.withColumn("text", F.lit(""))
    content = spark.read.parquet(*files).select(F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    return places.join(content, (F.col("at.__file") == F.col("f")) & (F.col("at.__row") == F.col("r"))).select("digest", "at", "text")


def exact_groups(docs: DataFrame, digest=sha256_digest, state_dir: str | None = None, run: str | None = None, max_bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, __file, __row, digest, keep_id, group_size, kept.

    Texts are equal when their bytes are; null counts as empty. The row with the largest doc_id stays; of several rows with
    that id the one that lies last in file order; null ids are smaller than others, so keep_id is null only where all are.
    Every group keeps exactly one row, also when rows repeat. An empty table gives an empty result. Other columns are ignored, whatever their names.

    With state_dir the groups span all runs over that folder: keep_id and group_size count earlier runs' rows too, and a row of an earlier run may
    lose its place to one of this run. run names the run: repeating one after a failure, with the same documents, counts its rows once. The files of
    earlier runs must still be there. docs is read twice (digests, then the bytes of hits); digest is a parameter so that tests can force collisions.
    """
    return _grouped(located(docs, ["doc_id", "text"]), digest, state_dir, run, max_bytes_per_trigger)


def _grouped(placed: DataFrame, digest=sha256_digest, state_dir: str | None = None, run: str | None = None, max_bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """exact_groups() of rows with their places: doc_id, text, __file, __row."""
    spark, lasting, named = placed.sparkSession, state_dir is not None, run is not None
    state_dir, run = state_dir or shared_path(spark, "dedup-state"), run or uuid.uuid4().hex
    placed = placed.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__file", "__row").withColumn("digest", digest(F.col("text")))
    kind, at = placed.schema["doc_id"].dataType.simpleString(), F.struct("doc_id", "__file", "__row")

    def digests() -> DataFrame:
        return spark.read.schema(f"doc_id {kind}, digest string, __file string, __row bigint, run string").parquet(f"{state_dir}/digests")

    def known(which: Column) -> bool:
        try:
            return not digests().where(which).isEmpty()
        except AnalysisException:  # no run yet
            return False

    if not (lasting and named and known(F.col("run") == run)):
        placed.select("doc_id", "digest", "__file", "__row", F.lit(run).alias("run")).write.mode("append").parquet(f"{state_dir}/digests")
    rows = digests().where(F.col("run") == run).drop("run") if lasting else digests().drop("run")
    state = stored(_stream(spark, kind, state_dir, run, max_bytes_per_trigger, lasting), "dedup-groups")
    earlier = lasting and known(F.col("run") != run)
    # Full bytes: the kept row's text beside each other row of its digest.
    hits = stored(placed.join(state.where("n > 1").select("digest", "best"), "digest").select("digest", "text", at.alias("at"), at.eqNullSafe(F.col("best")).alias("stays")), "dedup-hits", compression="zstd")
    kept_text = hits.where("stays").select("digest", F.col("text").alias("kept_text"))
    if earlier:  # the kept row may be one of an earlier run
        far = stored(state.where("n > 1").join(hits.where("stays").select("digest"), "digest", "left_anti").select("digest", F.col("best").alias("at")), "dedup-far")
        kept_text = kept_text.union(_fetched(far).select("digest", "text"))
    odd, size = counted(hits.where("not stays").join(kept_text, "digest").where(F.col("text").cast("binary") != F.col("kept_text").cast("binary")).select("digest"), "dedup-collisions", n=F.count("*"))
    grouped = rows.withColumn("at", at).join(state, "digest")
    if not size["n"]:
        return _decided(grouped)
    # A digest with several texts: its rows, those of earlier runs too, are grouped by their texts.
    odd = odd.distinct()  # not above, so that the join on a hot digest can be split
    texts = hits.join(odd, "digest", "left_semi").select("digest", "at", "text")
    if earlier:
        texts = texts.union(_fetched(stored(digests().where(F.col("run") != run).join(odd, "digest", "left_semi").select("digest", at.alias("at")), "dedup-earlier")).select("digest", "at", "text"))
    texts = stored(texts, "dedup-texts")
    groups = texts.groupBy("digest", "text").agg(F.max("at").alias("best2"), F.count("*").alias("n2"))
    named_rows = stored(texts.join(groups, ["digest", "text"]).select(F.col("at.__file").alias("__file"), F.col("at.__row").alias("__row"), "best2", "n2"), "dedup-regrouped")
    fixed = grouped.join(named_rows, ["__file", "__row"], "left")
    return _decided(fixed.withColumn("best", F.coalesce("best2", "best")).withColumn("n", F.coalesce("n2", "n")))


def _decided(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", "__file", "__row", "digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("at").eqNullSafe(F.col("best")).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs without exact copies: all columns of the rows that stay. Columns of any names pass through.

    Of equal texts the row with the largest doc_id stays, null ids being smaller than all; of rows that repeat an id and text one stays. Null texts count as empty, so they are copies of
    each other and of empty ones. An empty table gives an empty one."""
    place = []
    for name in ("__file", "__row"):
        while name in docs.columns:
            name += "_"
        place.append(name)
    placed = located(docs, docs.columns, tuple(place))
    groups = _grouped(placed.select("doc_id", "text", F.col(place[0]).alias("__file"), F.col(place[1]).alias("__row")))
    goes = stored(groups.where("not kept").select(F.col("__file").alias(place[0]), F.col("__row").alias(place[1])), "copies")
    return placed.join(goes, place, "left_anti").select(docs.columns)
