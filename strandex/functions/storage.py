"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a full path. Only a local master may leave it unset (tests): a temporary folder stands in there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        root = _OWN[context.applicationId]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it isn't created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _session_root(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    context = spark.sparkContext
    root = f"{shared_root(spark)}/strandex-{context.applicationId}"
    if root not in _OWN.values():
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN[root] = root
    return root


def session_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what goes when the application ends; it isn't created."""
    return f"{_session_root(spark)}/{name}-{uuid.uuid4().hex}"


#: No _SUCCESS file: where Hadoop's native library is missing, the driver would start two processes for each one, and until such a process runs its own program it counts as a second driver.
_UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stored(df: DataFrame, name: str, lasting: bool = False, **options) -> DataFrame:
    """df written there and read again: cuts an iteration's lineage, and later reads survive lost executors. Kept until the application ends or drop_stored(); lasting: for good."""
    spark = df.sparkSession
    path = shared_path(spark, name) if lasting else session_path(spark, name)
    df.write.options(**({} if lasting else _UNMARKED), **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def together(*tables: DataFrame) -> DataFrame:
    """The rows of tables of one shape made by stored(), by one scan: a union of many scans is a plan of its own for each, which the driver holds."""
    first = tables[0]
    return first if len(tables) == 1 else first.sparkSession.read.schema(first.schema).parquet(*(t.stored_path for t in tables))


def counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict]:
    """stored(df), and aggregates of its rows that the same job takes while it writes (counts: name -> aggregate column)."""
    from pyspark.sql import Observation

    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, *(c.alias(n) for n, c in counts.items())), name)
    return out, seen.get


def files_of(*tables: DataFrame) -> str:
    """A digest of the files behind tables: another one once a file is added, changed or gone."""
    each = [t.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("m")).distinct() for t in tables]
    parts = [t.agg(F.count("*"), F.sum(F.xxhash64("p", "s", "m").cast("decimal(20,0)"))).first() for t in each]
    return "-".join(f"{n}.{h}" for n, h in parts)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files behind tables made by stored(); only for those that no later plan reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
