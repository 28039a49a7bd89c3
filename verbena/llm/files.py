"""Whole files in a shared folder from Python tasks: local paths and the stores that pyarrow knows."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import NativeFile, fs
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch between Spark and a Python worker, so that very long texts fit into its memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python need not have it on its path."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="verbena-"), "verbena.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Readies a session for operators that run Python. The batch limits stay set, as plans run after the call that builds them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _where(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_file(uri: str, data: bytes | Iterable[bytes]) -> None:
    """Callers name files by task attempt, so that an attempt never meets another's file, and list those of the attempts that ended."""
    store, path = _where(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        for part in [data] if isinstance(data, bytes) else data:
            f.write(part)


def open_file(uri: str) -> NativeFile:
    store, path = _where(uri)
    return store.open_input_file(path)


def read_file(uri: str) -> bytes:
    store, path = _where(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers live on, idle, through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def whole(values: list) -> pd.Series:
    """Ids that went to Python as strings, as 64-bit integers with nulls: a float column would round large ones."""
    return pd.Series(pd.array([None if v is None or v != v else int(v) for v in values], dtype="Int64"))
