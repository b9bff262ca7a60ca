"""Shared folder, table cuts and the vectorised word hashing that the operators of this subpackage use."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer single text is taken whole.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessel-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, with_path: bool = False):
    """Write the rows to the shared folder and read them back, which cuts the lineage; with the folder, for discard(), if asked."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def range_bits(docs: DataFrame, sent: float, size: int = 32 << 20) -> int:
    """Bits of the hash ranges over which tasks exchange about sent bytes for each byte of text: ranges hold about size bytes, and are no fewer than 64."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    return max(6, (int(total * sent) // size).bit_length())


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark removes the files of shuffles that no plan holds any more; by itself it waits for a full heap or half an hour."""
    gc.collect()  # plans that Python objects still name are held
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks a table of short rows for broadcast if it counts at most so many rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files in the shared folder -----------------------------------------------------------------------------------


def local_path(uri: str) -> str | None:
    """The path that this machine can open, if the store is a mounted file system."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def put_file(uri: str, data: bytes) -> None:
    """Write a file under its final name in one step, so that a repeated task leaves the same whole file."""
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}.part"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, path)


def map_file(uri: str, dtype) -> np.ndarray:
    """The file as a memory-mapped array; from a remote store by way of an unlinked local copy."""
    path, copy = local_path(uri), None
    if path is None:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp()
        copy = path
        with store.open_input_stream(remote) as src, os.fdopen(handle, "wb") as dst:
            while block := src.read(1 << 20):
                dst.write(block)
    out = np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    if copy:
        os.unlink(copy)
    return out


# --- words --------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
#: One odd 64-bit number for each byte, from a fixed seed.
_BYTE = (np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWER = np.ones(256, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n or int(_POWER[1]) == 1:
        size = max(256, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
    return _POWER


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, split at space and 0x09-0x0D) and, for each text, where its words begin and end."""
    buf = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", dtype=np.uint8)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    word = _IS_WORD[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, edges)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    at = np.arange(len(buf), dtype=np.int32)
    run = np.zeros(len(buf), dtype=np.int32)
    run[starts] = starts
    at -= np.maximum.accumulate(run)
    value = _BYTE[_LOWER[buf]]
    value[~word] = 0
    np.minimum(at, int(np.diff(np.append(starts, len(buf))).max()), out=at)
    at[: starts[0]] = 0
    value *= _powers(int(at.max()) + 1)[at]
    return mix(np.add.reduceat(value, starts)), bounds


def slices(ids: list, texts: list) -> Iterator[tuple[list, list[bytes]]]:
    """Rows as lists of ids and UTF-8 texts (null: empty) of about SLICE_BYTES."""
    own_ids, own, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        data = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        own_ids.append(i)
        own.append(data)
        size += len(data)
        if size >= SLICE_BYTES:
            yield own_ids, own
            own_ids, own, size = [], [], 0
    if own:
        yield own_ids, own


def text_slices(batches: Iterable[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[list, list[bytes]]]:
    for b in batches:
        raw = b.column(text).cast(pa.large_binary()) if b.num_rows else b.column(text)
        keys = b.column(key)
        for lo in range(0, b.num_rows, 256):
            yield from slices(keys[lo : lo + 256].to_pylist(), raw[lo : lo + 256].to_pylist())
