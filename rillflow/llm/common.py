"""What the operators share: input columns, text folding, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words: what is not in [^\x00-\x2F\x3A-\x60\x7B-\x7F] and in [^\x20\x09-\x0D].
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the fast form where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, separators: str) -> Column:
    """Array of the non-empty pieces between separators; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def n_blank_words(text: Column) -> Column:
    """Number of maximal runs of other characters than ASCII white space; null gives 0."""
    return F.size(words(text, BLANK)).cast("long")


def chance(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1, in steps fine enough for any number of rows."""
    return F.shiftrightunsigned(h, 1) / float(1 << 63)


_made: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Shared folders made within are deleted at the end; what was read from them must be written elsewhere."""
    n = len(_made)
    yield
    for at in _made[n:]:
        remove(spark, at)
    del _made[n:]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which executors and the driver share.

    Where the setting is empty (tests in local mode, one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/rillflow-shared"
    at = f"{base.rstrip('/')}/rillflow-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, at)
    _made.append(at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder that no frame reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, at: str) -> None:
    """At the end of the driver; a session that has ended already leaves the folder to the cluster."""
    if spark.sparkContext._jsc is None:
        if at.startswith("file://" + tempfile.gettempdir()):
            shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)
        return
    remove(spark, at)


def stored(df: DataFrame, at: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(at)
    return spark.read.schema(df.schema).parquet(at)



def split_words(texts, lower: bool = True):
    """Arrow list array of the pieces between runs of ASCII white space; nulls are empty texts.

    The texts are copied first: Arrow's string kernels are not right for every kind of slice.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    own = pc.take(texts, pa.array(range(len(texts)), pa.int64())).cast(pa.string()).fill_null("")
    return pc.ascii_split_whitespace(pc.ascii_lower(own) if lower else own)


def tidied(run, keep: str = ""):
    """run, dropping first what other operators remember in this worker process (all but `keep`), and giving back to the system at a task's end what its worker process no longer uses.

    Workers live from task to task and from stage to stage; without this their pools keep the peak of each.
    """

    def wrapped(batches):
        import ctypes
        import gc
        import sys

        import pyarrow as pa

        def trim() -> None:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

        others = [m for m in sys.modules if m.startswith("_rillflow_") and m != keep]
        for m in others:
            sys.modules.pop(m).__dict__.clear()
        if others:
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
