"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, and
    an error on a cluster, whose machines share no such folder."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not current.isDefined() and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not current.isDefined():
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="phonoframe-"))
    return configured or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and store it in the shared folder, so that no lost executor forces a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_sized(df: DataFrame) -> DataFrame:
    """As cut, without the size that Spark estimates for df: a checkpoint keeps it, and in a loop of joins it is a product of
    all earlier sizes, a number whose digits multiply in each round until planning no longer ends."""
    done = cut(df)
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), df.sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col, modulus: int):
    """crc32 of the id's decimal text, modulo `modulus`; null ids get a null bucket."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % modulus


def bounded_sample(df: DataFrame, n: int, key) -> DataFrame:
    """At most n rows, chosen by a hash of the key, the same ones at every run; each task sorts and sends n rows at most."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def tidy(run):
    """run, a function over Arrow batches, that gives memory back at its end: a worker that goes on to other tasks keeps its
    freed memory otherwise, and an executor's workers share its bound."""

    def tidied(batches):
        yield from run(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def let(value, body):
    """body of a Column that is computed once: one named within a lambda may be inlined, and then recomputed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sized(df: DataFrame, limit: int) -> DataFrame:
    """df, which is computed already, marked for a broadcast where it has at most `limit` rows."""
    return F.broadcast(df) if df.count() <= limit else df
