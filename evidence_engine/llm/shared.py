"""What several operators need: shared scratch tables, Arrow text buffers, word boundaries and hashes.

Scratch tables live under ``spark.checkpoint.dir``, which all machines of a cluster share. Only where
that setting is unset (tests) a folder of the local machine stands in.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words where words are [^\x20\x09-\x0D]+
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True in words of [^\x20\x09-\x0D]+
IS_TOKEN = ~SPACES
#: True in words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, letters, all beyond ASCII.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table in the shared folder: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _made.append(path)
    return out


#: Scratch tables that were written and not deleted yet, in the order of writing.
_made: list[str] = []


def made() -> int:
    return len(_made)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more. A hint to the collector lets Spark drop the shuffle files of finished steps sooner."""
    _delete(spark, {t._scratch_path for t in tables})


def discard_since(spark: SparkSession, since: int, *but: DataFrame) -> None:
    """Deletes all tables settled after made() gave ``since``, except some."""
    _delete(spark, set(_made[since:]) - {t._scratch_path for t in but})


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        if path in _made:
            _made.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def arrow_batches(spark: SparkSession, rows: int = 2000, mb: int = 32) -> None:
    """Bounds what one Arrow batch holds, in rows and, where Spark has that setting, in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def trimmed(run):
    """The same Arrow function, which at its end gives the worker's freed memory back: workers live on into later stages."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return go


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``most`` bytes."""
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        end = min(end, rows)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row. No word crosses rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = inside[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    s[first], e[last] = m[first], m[last]
    start = np.flatnonzero(s)
    return start, np.flatnonzero(e) + 1, np.searchsorted(start, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, p in enumerate((_P, _P_INV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, span: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from running polynomial sums over about ``span`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + span, side="right")))
        lo, hi = start[i], end[j - 1]
        up, down = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i, without regard to rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + words[j : j + n]
    return mix(h)


def within_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words from which k words stay in one row. first: number of each row's first word."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    total = int(count.sum())
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + shift


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)
