"""Helpers shared by the operators: tables in the shared folder, and words of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task holds as words at one time.
BATCH_BYTES = 4 << 20
#: Bytes of files up to which a table of few splits is dealt over all cores.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its rows dealt over all cores if it has fewer splits than those and SPREAD_BYTES of files at most.

    All of a small file may be one task's. Larger tables are read as they lie, without a shuffle, on any number of cores.
    """
    table, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores or table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SPREAD_BYTES:
        return table
    return table.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and Spark is local (tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_columns(docs: DataFrame, keep: list[str] | None, results: list[str]) -> list[str]:
    """The columns that pass through: those in keep, or all; a result takes the place of a column of its name in any case."""
    low = {r.lower() for r in results}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in low]


def plain_text(column: pa.Array) -> pa.Array:
    """A text column as 32-bit strings from offset 0, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])


def bounded(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their text column holds limit bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than space and tab to carriage return, flat, and how many each row has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)])
    offsets = offsets - offsets[0]
    return flat.filter(keep), before[offsets[1:]] - before[offsets[:-1]]


def _folding() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_FOLD = _folding()


def folded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII, flat, and how many each row has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    data = _FOLD[raw[offsets[0] : offsets[-1]]]
    return space_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data)))


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's number in the list of different words, and that list."""
    coded = pc.dictionary_encode(words)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def row_numbers(counts: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
