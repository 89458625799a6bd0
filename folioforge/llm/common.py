"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a pandas frame are handed on in slices of about this many characters, so that long texts do not add up.
SLICE_CHARS = 3_000_000

#: The attribute of a frame that holds its folder.
_WRITTEN = "__ff_written"

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_hash(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; where none is set, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def written(df: DataFrame, drop: Iterable[DataFrame] = (), by: Sequence[str] = (), codec: str = "snappy") -> DataFrame:
    """df, written once as Parquet in the shared folder: cuts the lineage, and survives the loss of executors.

    drop: earlier results of written() that nothing reads from now on; their folders go once df is written. by: columns by whose
    values the files are parted, so that a filter on them reads no others.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=codec)
    for old in drop:
        folder = spark._jvm.org.apache.hadoop.fs.Path(old.__dict__[_WRITTEN])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_WRITTEN] = path
    return out


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each action go once it has ended, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: within a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null gives an empty one, lone surrogates become '?'."""
    if not isinstance(text, str):
        return b""
    return text.encode("utf-8", "replace")


def lowered(text: bytes) -> bytes:
    """A-Z lower-cased, all else kept."""
    return text.translate(_ASCII_LOWER)


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORDS_ONLY).split()


def release() -> None:
    """Hands free memory back: Python workers live on after a task, and would keep it beside what the next ones need."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The frames, cut where their texts add up to more than `chars`."""
    for frame in frames:
        sizes = frame[column].map(lambda t: len(t) if isinstance(t, (str, bytes)) else 0).to_numpy()
        groups = np.cumsum(sizes) // chars
        for g in np.unique(groups):
            yield frame[groups == g]
        del frame
        release()


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The Arrow batches, cut where the bytes of their texts add up to more than `size`; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        release()
