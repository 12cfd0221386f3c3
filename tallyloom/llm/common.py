"""What the operators of this subpackage share: scratch tables, size-checked joins, bounded caches and text splitting."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows of whole texts that become Python objects at once.
BATCH_ROWS = 256
#: Most rows of 8-byte keys that are broadcast (about 32 MB as a hashed relation); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Entries of a worker's cache, after which it starts anew; results don't depend on it.
CACHE_WORDS = 400_000

_own_dir: list[str] = []
_left: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, on one machine only, a folder of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tallyloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return "file://" + _own_dir[0]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_results() -> None:
    """At the end of the process: results that were kept for their readers go; in other stores than a local folder only if the session still lives."""
    spark = SparkSession.getActiveSession()
    for path in _left:
        local = "/" + path.removeprefix("file:").lstrip("/")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif spark is not None:
            try:
                delete(spark, path)
            except Exception:  # noqa: BLE001, the session is going down
                return


class Scratch:
    """The scratch tables of one call, in one folder of the shared folder; used in a `with`, after which the folder is gone.

    A table cuts the lineage, survives lost executors and is computed once. What a call returns to be read later is written
    by `result` beside the folder and stays until the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/tallyloom-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        return _table(df, self.path(name), compression)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return kept(df, name)

    def settle(self) -> None:
        """Lets Spark's cleaner find the shuffles of jobs that have ended, so that their files go before the next large step."""
        gc.collect()
        self.spark._jvm.System.gc()


def _table(df: DataFrame, path: str, compression: str) -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder that stays until the process ends."""
    path = f"{scratch_dir(df.sparkSession)}/tallyloom-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_drop_results)
    _left.append(path)
    return _table(df, path, "zstd")


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: Spark bounds a batch in bytes (spark.sql.execution.arrow.maxBytesPerBatch), this bounds what becomes Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed_join(df: DataFrame, keys: DataFrame, on: str, how: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """df joined with a table of keys, which is broadcast only if its counted rows are at most `limit`."""
    return df.join(F.broadcast(keys) if keys.count() <= limit else keys, on, how)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other column's name can clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Memo(dict):
    """A dict that computes what it lacks and starts anew beyond `limit` entries. Keys longer than `longest` aren't kept, so its bytes are bounded, too."""

    def __init__(self, make: Callable[[Any], Any], limit: int = CACHE_WORDS, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


_states: dict[Any, Any] = {}


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """Built once in a Python worker and kept for its later tasks; the oldest of more than four goes."""
    if key not in _states:
        while len(_states) >= 4:
            _states.pop(next(iter(_states)))
        _states[key] = build()
    return _states[key]


def shared(spark: SparkSession, value: Any):
    """A broadcast of model data; callers state the bound of its size."""
    return spark.sparkContext.broadcast(value)


def context() -> SparkContext:
    return SparkContext._active_spark_context


def ascii_lower_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then the words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes (bytes.lower and bytes.split know only ASCII)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def batch_of(names: Iterable[str], arrays: Iterable[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], list(names))


def crc_residue(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo; a null id counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in ids], dtype=np.int64)
