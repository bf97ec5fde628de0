"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def lower_bytes(text: str) -> bytes:
    """The UTF-8 bytes of a text with A-Z in lower case. Their split() gives the words: bytes count just the six
    characters of ASCII white space that end a WORD."""
    return text.encode("utf-8", "replace").translate(_LOWER)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z alone, so that every engine agrees on the result."""
    return F.translate(c, _UPPER, _UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_caches: dict[object, dict] = {}


def release() -> None:
    """Give freed memory back to the system: Arrow's pool, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def worker_cache(owner: object) -> dict:
    """A dictionary that a Python worker keeps between tasks for one owner. Another owner's is dropped, so that the operators of
    a pipeline, whose tasks share workers, don't add up."""
    if owner not in _caches:
        _caches.clear()
        release()
        _caches[owner] = {}
    return _caches[owner]


def parts(batches: Iterable[pd.DataFrame], rows: int = 1_000) -> Iterator[pd.DataFrame]:
    """Smaller batches, so that a result of lists is not held for a whole Arrow batch."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Where it is unset, one of our own on a single machine, as
    in tests; a cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_scope: ContextVar[list[str] | None] = ContextVar("kinfold_cuts", default=None)


@contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """A run of its own: the tables that cut() writes inside are deleted when it ends, and no others. Results that read them
    must have been written by then. Runs in other threads, or around this one, keep theirs. Tables written outside of any run
    stay, as results not yet read may need them, in a folder that bears the application's id."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        for out in mine:
            path = hadoop(out)
            path.getFileSystem(conf).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A name below the shared folder, which belongs to the run that is under way."""
    out = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    if (mine := _scope.get()) is not None:
        mine.append(out)
    return out


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: a table written once in the shared folder and read back, so that lost executors cost no more
    than their own tasks and the planner knows its size. by: a column that parts the table's files."""
    spark, out = df.sparkSession, new_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def small(df: DataFrame, most: int, each: Column | None = None) -> DataFrame:
    """Marked for broadcast if it has at most so many rows, as counted, or so many of what `each` counts in a row; else as it
    is, for a shuffled join. df should be cheap to count, such as one that cut() returned."""
    if each is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    return F.broadcast(df) if (df.agg(F.sum(each + 1)).first()[0] or 0) <= most else df


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
