"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key is in no fold (-1)."""
    key = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(parts), F.lit(-1))


def in_sample(df: DataFrame, key: str, rows: int, salt: int) -> Column:
    """Whether a row of ``df`` is among about ``rows`` of them, picked by a hash of the key alone; true where there are no more.

    One counting pass fixes the share. The pick is the same in every run.
    """
    total = df.count()
    share = int(rows / max(total, 1) * (1 << 40))
    return F.lit(True) if total <= rows else F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 40)) < share


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    return df.where(in_sample(df, key, rows, salt))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table below spark.checkpoint.dir, which all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all machines share")
        # Tests on one machine.
        root = f"file://{tempfile.gettempdir()}/quillon-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it again. Its shuffle files go at once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``tables``; nothing may read them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(conf).delete(path, True)


_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless PYTHONPATH already leads them to it."""
    app = spark.sparkContext.applicationId
    here = str(_PACKAGE.parent)
    if app in _shipped or here in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in _PACKAGE.rglob("*.py"):
            out.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about ``limit`` bytes of the string ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]
