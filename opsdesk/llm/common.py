"""Helpers shared by the training-data operators: table access, Arrow mapping, cluster set-up."""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdesk.session import ensure_checkpoint_dir, ship_package

ARROW_BYTES = "8m"         # of a batch between the JVM and a worker
PIECE_BYTES = 1 << 20      # text handled at once inside a task (a longer text is one piece)


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package shipping and the size of Arrow batches (texts are long, so
    the default of 64 MB a batch would fill the workers); called by every entry point."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the needed columns, with the types the operators rely on (columns of other names
    never reach an operator, so they cannot clash)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def carry(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): everything but the text as one struct, so that a table's own columns
    pass through an operator whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def restore(carried: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from a carried table; ``changed`` gives new values by name."""
    return carried.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else
                            F.col("row").getField(c).alias(c) for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding at most ``limit`` bytes of text each (at least one row)."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    i = 0
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def release_memory() -> None:
    """Give memory back at the end of a task.  Spark keeps Python workers for later stages, where
    grown pools and caches would still count."""
    from opsdesk.llm import textscan
    textscan.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def releasing(run):
    """``run`` (batches to batches) with ``release_memory`` when its task ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return task


def map_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
               column: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` over text pieces; ``fn`` turns one piece into one output batch."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(releasing(run), schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_thread() -> None:
    """Task code uses the one core that Spark gave it."""
    for key in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(key, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
