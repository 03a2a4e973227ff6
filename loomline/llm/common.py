"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.lineage import cut, shared_dir

__all__ = ["crc_mod", "cut", "give_back", "map_texts", "read", "shared_dir", "slices", "stored", "text_bytes", "texts", "tokenizer_path", "worker_threads_off"]

#: Characters of a text that one Python step handles at a time.
SLICE_CHARS = 8_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: read again by column, where cut() reads whole rows."""
    path = f"{shared_dir(df.sparkSession)}/loomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Hand what Python has freed back to the system, which a worker would hold between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, or one row; what the task before has left is given back first."""
    give_back()
    for batch in batches:
        at, size = 0, 0
        lengths = pc.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)
    give_back()


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, a null as no bytes."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def map_texts(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow with bounded slices of text."""

    def run(batches):
        for part in slices(batches, text):
            yield step(part)

    return df.mapInArrow(run, schema)


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_threads_off() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
