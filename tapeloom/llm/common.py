"""Stored intermediate tables, hashing of words and numbering of rows, shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text that are hashed at once; bounds the working memory of a task, not the length of a text.
CHUNK = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back.

    Cuts the lineage, survives lost executors and keeps column pruning; the files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tapeloom-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], n_rows: int, per_block: int = 100_000) -> DataFrame:
    """``df`` with a gapless ``slot`` from 0 within each group, without one task per group.

    Rows are dealt into hash blocks of about ``per_block`` rows, numbered inside the block and shifted by the
    number of rows in the group's earlier blocks. ``order`` must hold all columns that tell rows apart.
    """
    blocks = max(1, -(-n_rows // per_block))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    counts = dealt.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_block").alias("_at"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    same = F.col("_block") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    ranked = dealt.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(shifts, same)
    slot = (F.col("_rank") - 1 + F.col("_shift")).cast("long").alias("slot")
    return joined.select(*df.columns, slot)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = int(odd_numbers(1, 11)[0])
_UNBASE = pow(_BASE, -1, 2**64)
_SYMBOL = odd_numbers(256, 12)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE, unbase: int = _UNBASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of them."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, unbase, np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _POWERS[base] = have
    return have


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as ``(first row, end row, bytes, offsets)`` of about CHUNK bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        offset_type = np.int64
    else:
        offset_type = np.int32
    buffers = column.buffers()
    n = len(column)
    offsets = np.frombuffer(buffers[1], offset_type)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of consecutive texts, and each text's first word in them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = letters.copy()
    starts[1:] &= ~letters[:-1] | cut[1:-1]
    ends = letters.copy()
    ends[:-1] &= ~letters[1:] | cut[1:-1]
    first = np.flatnonzero(starts)
    last = np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[_LOWER[data]] * up[: len(data)], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)
