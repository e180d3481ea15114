"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, scratch_path  # noqa: F401

#: A-Z to a-z, everything else unchanged.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The same, with every ASCII byte but 0-9 and a-z turned into a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return encoded(text).translate(WORD_BYTES).split()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling, vectorised."""
    z = values.astype(np.uint64, copy=True)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        total += hashes[k : k + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    return mix(total)


def index_block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Number of the index block of uniform hashes: equal ranges, so a block's numbers lie close together."""
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


#: Bytes between words: blanks, tabs and line ends.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_FACTOR = 0x9E3779B97F4A7C15
_LONG_WORD = 1 << 16
_CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = kept_in_worker("powers", list)
    if not held or len(held[0]) < n:
        size = max(n, 1 << 17)
        one = np.ones(1, np.uint64)
        held[:] = [
            np.cumprod(np.concatenate((one, np.full(size, f, np.uint64))))
            for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))
        ]
    return held[0], held[1]


def word_places(data: bytes, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~blank[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def range_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each byte range (rising starts), computed for all at once.

    Differences of prefix sums of a polynomial; the same for equal bytes at
    any place.  Ranges above 64 KB are hashed one by one.
    """
    out = np.empty(len(starts), np.uint64)
    long = ends - starts > _LONG_WORD
    if long.any():
        import xxhash

        for k in np.flatnonzero(long):
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    short = np.flatnonzero(~long)
    at = 0
    while at < len(short):
        base = starts[short[at]]
        to = max(at + 1, int(np.searchsorted(starts[short], base + _CHUNK - _LONG_WORD)))
        own = short[at:to]
        first, last = starts[own] - base, ends[own] - base
        own_bytes = np.frombuffer(data, np.uint8, int(last.max()), int(base))
        up, down = _powers(len(own_bytes) + 1)
        total = np.zeros(len(own_bytes) + 1, np.uint64)
        np.cumsum((own_bytes.astype(np.uint64) + np.uint64(1)) * up[: len(own_bytes)], out=total[1:])
        out[own] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        at = to
    return out


def word_hashes(data: bytes, blank: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash for each word of a text; the same for a word everywhere."""
    return range_hashes(data, *word_places(data, blank))


def kept_in_worker(name: str, make: Callable):
    """An object that stays in the Python worker over its tasks."""
    store = sys.modules.setdefault("_plumbline_worker", types.ModuleType("_plumbline_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def slices(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches a few rows at a time, so that what is made of them stays small.

    What the batches held is given back at the end, since workers are kept for later tasks.
    """
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str, step: int = 256) -> Iterator[str | None]:
    """Values of a text column, a few at a time as Python objects."""
    values = batch.column(column)
    for at in range(0, len(values), step):
        yield from values.slice(at, step).to_pylist()


def digest128(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def task_block() -> int:
    """A number of this task that no other task of the stage has."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def packed_ints(values: np.ndarray) -> bytes:
    """Rising or small integers as compressed byte planes."""
    import zstandard

    flat = np.ascontiguousarray(values, dtype="<u8")
    planes = flat.view(np.uint8).reshape(-1, 8).T
    top = max((k for k in range(8) if planes.shape[1] and planes[k].any()), default=-1)
    body = planes[: top + 1].tobytes()
    return len(flat).to_bytes(8, "little") + bytes([top + 1]) + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked_ints(data: bytes) -> np.ndarray:
    import zstandard

    n, k = int.from_bytes(data[:8], "little"), data[8]
    body = zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * k))
    planes = np.zeros((8, n), np.uint8)
    planes[:k] = np.frombuffer(body, np.uint8).reshape(k, n) if k else 0
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n).copy()


def packed_sorted(values: np.ndarray) -> bytes:
    """Rising integers: their steps as byte planes."""
    v = values.astype(np.uint64)
    return packed_ints(np.diff(v, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked_ints(data), dtype=np.uint64)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows chosen by the hash of their keys, at most twice as many; the same on each run."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * 1_000_000_000) + 1
    return df.where(F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(1_000_000_000)) < share).limit(2 * rows)
