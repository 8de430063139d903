"""Shared pieces: the shared scratch folder, word rules and vectorised text hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank, tab, LF, VT, FF and CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 1_000_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: set[str] = set()
_own: list[str] = []


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that df does not have, whatever the case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of this process in
    local mode, and an error on a cluster, whose executors would write to their own disks."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
        top = _own[0]
    return f"{top.rstrip('/')}/millrace-{spark.sparkContext.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    for path in list(_made):
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    if not _made:
        atexit.register(_clean, spark)
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.add(path)
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the table stands for the plan, whose shuffle files go at once
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more, and shuffle files nobody holds."""
    for t in tables:
        path = t._stored_at
        _remove(t.sparkSession, path)
        _made.discard(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def given_back() -> None:
    """Returns to the system what a Python worker holds without using it: workers live on between stages, beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# ---------------------------------------------------------------- numpy text

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)  # 3 mod 4, so that powers less one have few factors of two
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A = np.uint64(0xD1342543DE82EF95)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] the polynomial of data[i:j], scaled by the base to the power i."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], from prefix_hash(data)."""
    p = powers(len(s))[1]
    return mix((s[end] - s[start]) * p[start] + (end - start).astype(np.uint64) * _A)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of a string or binary column: all bytes, and the n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(large).fill_null(b"" if large == pa.large_binary() else "")
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data and len(o) else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` bytes of text in all, a longer text alone: (rows, bytes, offsets)."""
    for batch in batches:
        data, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


class Words:
    """The words of several texts: hash, first byte, end and number of text of each; first[i] to first[i + 1] are text i's."""

    def __init__(self, data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _IS_SPACE):
        self.data = _LOWERED[data]
        word = ~gaps[data]
        begins, ends = word.copy(), word.copy()
        cut = off[1:-1]
        cut = cut[cut < len(data)]
        if len(data):
            begins[1:] &= ~word[:-1]
            begins[cut] |= word[cut]
            ends[:-1] &= ~word[1:]
            back = cut[cut > 0] - 1
            ends[back] |= word[back]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.hash = span_hash(prefix_hash(self.data), self.start, self.end)
        self.text = np.repeat(np.arange(len(self.count)), self.count)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's k-word shingles and the n + 1 offsets; a shorter text with words gives one."""
    n = len(w.hash)
    many = np.maximum(w.count - k + 1, (w.count > 0).astype(np.int64))
    off = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=off[1:])
    out = np.zeros(off[-1], np.uint64)
    if n >= k:
        rolled = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * _A + w.hash[j : n - k + 1 + j]
        whole = np.flatnonzero(w.count >= k)
        size = w.count[whole] - k + 1
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(off[whole], size) + within] = mix(rolled[np.repeat(w.first[whole], size) + within])
    for i in np.flatnonzero((w.count > 0) & (w.count < k)):
        h = np.uint64(w.count[i])
        with np.errstate(over="ignore"):
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                h = h * _A + x
        out[off[i]] = mix(np.array([h], np.uint64))[0]
    return out, off
