"""Session helpers: shared folder, written tables with measured sizes, size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType

#: Largest measured size (bytes of its values) of a side that may be broadcast.
BROADCAST_LIMIT = 8 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from spark.checkpoint.dir.

    The setting is read from the session.  Only where it is unset and the master
    is local (single-JVM tests) a temporary folder is chosen; on a cluster that
    would be another disk on every machine, so it is an error there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(known)
        return known
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _width(c: Column, t: DataType) -> Column:
    """Bytes of a value, about: strings by their bytes, lists by their length, anything else 8."""
    if isinstance(t, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(t, (ArrayType, MapType)):
        return F.greatest(F.size(c), F.lit(0)) * 24 + 16
    return F.lit(8)


_written: list[tuple[SparkSession, str]] = []


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, survives the loss of any executor, and lets several readers
    prune columns.  Rows and bytes are measured while writing, for ``small``.
    The files are removed when the driver's Python ends or ``drop_tables`` runs.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/loomtext-tables/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    wide = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(wide.cast("bigint")).alias("bytes")).write.parquet(at)
    _written.append((spark, at))
    out = spark.read.schema(df.schema).parquet(at)
    got = seen.get
    out.loom_rows, out.loom_bytes = got["rows"] or 0, got["bytes"] or 0
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, whose size is then known."""
    return table(df, "cut")


def small(df: DataFrame, limit: int = BROADCAST_LIMIT, columns: list[str] | None = None) -> DataFrame:
    """A side of a join, hinted by its measured size.

    A frame of ``table`` or ``cut`` is broadcast up to ``limit`` bytes and joined by
    sorting beyond it.  Catalyst's estimates are not asked: after lists were
    exploded they are wrong by orders of magnitude either way.  A frame that
    was not measured is left to Spark's adaptive choice.
    """
    size = getattr(df, "loom_bytes", None)
    out = df.select(*columns) if columns else df
    if size is None:
        return out
    return F.broadcast(out) if size <= limit else out.hint("merge")


@atexit.register
def drop_tables() -> None:
    """Remove the tables written by ``table`` (best effort at exit)."""
    while _written:
        spark, at = _written.pop()
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return
