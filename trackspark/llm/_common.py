"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; also the size of a block of documents.
BLOCK_BYTES = 4_000_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (or the folder given to ``setCheckpointDir``), which every executor sees.

    Without either a session on one machine (tests, a laptop) gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="trackspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Its shuffle files go once it is written; the written table stays until ``discard``.
    """
    spark = df.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def block_of(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[Column, int]:
    """Column with the block of a row and the number of blocks; a block holds about ``block_bytes``.

    Rows are dealt by their place in the input, so neither copies of a text nor repeated rows pile up in one block.
    """
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"), blocks


def text_slices(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = 2 * BLOCK_BYTES) -> Iterator[pa.Table]:
    """Cut a batch by rows so that each part holds about ``limit`` bytes of text (one row at least)."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if not table.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield table.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts (null: none): distinct words, code of each word, offsets by text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])
    offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), offsets


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(total) + np.repeat(starts - before, lengths)]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def gram_hashes(codes_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive word hashes at each start (mod 2**64), mixed so that all bits are usable."""
    size = len(codes_hash) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    mult, acc = np.uint64(0x9E3779B97F4A7C15), np.zeros(size, np.uint64)
    for i in range(n):
        acc = mix((acc * mult) + codes_hash[i : i + size])
    return acc


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on, and what its allocators keep adds to the next block's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
