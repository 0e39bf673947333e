"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chemscore._ship import ship_package
from chemscore.operators.joins import DEFAULT_BROADCAST_BYTES, measured
from chemscore.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows a side may have before it is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000
#: Characters of text a worker holds as Python lists at once.
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once under spark.checkpoint.dir and read back: cuts the lineage,
    survives lost executors and gives joins bare, splittable scans."""
    return materialize(df, f"llm-{label}")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def hash_share(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash falls into this share of all its values."""
    return hashed < F.lit(max(-(1 << 63), min((1 << 63) - 1, int(share * 2.0 ** 64) - (1 << 63))))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table with the broadcast hint if its rows and bytes are proven
    few, as it is otherwise (then the join is a shuffle)."""
    n, size = measured(df)
    return F.broadcast(df) if n <= rows and size <= DEFAULT_BROADCAST_BYTES else df


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors have this package (for functions that run there)."""
    ship_package(df.sparkSession)
    return df


def pylists(batch: pa.RecordBatch, *columns: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def text_slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(start row, texts) with about ``chars`` characters each; null is empty.
    A longer text comes whole, alone in its slice."""
    start, size, part = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > chars:
            yield start, part
            start, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def sliced(batches: Iterable[pa.RecordBatch], *columns: str, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches in slices (without copies) whose values in ``columns`` (texts
    or binaries) have about ``size`` bytes, so that only a slice is ever held as
    Python objects.  A longer row comes alone."""
    for batch in batches:
        total = 0
        for c in columns:
            width = pc.binary_length(batch.column(batch.schema.get_field_index(c)))
            total = total + pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype("int64")
        start = held = 0
        for i, n in enumerate(total.tolist()):
            if i > start and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def release() -> None:
    """Give memory that is free in this process back to the system.  Workers outlive
    their tasks, and what an idle one keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc has it
    if trim:
        trim(0)


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
