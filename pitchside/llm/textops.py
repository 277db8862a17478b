"""Vectorised text helpers used inside Arrow tasks, and the shared-folder helper.

Hashes are 64-bit sums of random byte values weighted by powers of an odd
base, passed through a mixer that spreads the bits.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# fixed values: the separators of the word class [^\x20\x09-\x0D]+
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True


def _mix_scalar(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


_BYTE_VALUE = np.array([_mix_scalar(i + 1) for i in range(256)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of the odd base modulo 2**64."""
    return _powers(1 << max(8, int(n - 1).bit_length()))[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    up = np.full(n, _BASE, dtype=np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~_IS_SEP[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every word given by its byte span: byte values weighted by the place in the word."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = ranges(start, size)
    place = np.arange(len(at)) - np.repeat(first, size)
    sums = np.add.reduceat(_BYTE_VALUE[data[at]] * odd_powers(int(size.max()))[place], first)
    return mix64(sums ^ (size.astype(np.uint64) << np.uint64(48)))


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive items (the caller drops those that cross a boundary)."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j, p in enumerate(odd_powers(k)):
        out += items[j:j + n] * p
    return mix64(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Index of the first entry of every run of equal neighbours."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)`` for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, dtype=np.int64)
    nonzero = lengths > 0
    first = (ends - lengths)[nonzero]
    s, ln = starts[nonzero], lengths[nonzero]
    out[first] = s - np.concatenate(([0], s[:-1] + ln[:-1] - 1))
    return np.cumsum(out)


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal disjoint runs (touching spans join)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(start) - 1]))
    return start[first], end[last]


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``max_bytes`` of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    edge = np.cumsum(size) // max_bytes
    cuts = np.concatenate((run_starts(edge), [n]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> Iterable[bytes]:
    """UTF-8 bytes of every value (null: empty)."""
    for v in column.cast(pa.binary()).to_pylist():
        yield v or b""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the folder that the cluster names in ``spark.checkpoint.dir``."""
    from pitchside.session import run_dir

    return run_dir(spark, "llm", name)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once into the shared folder and read it back: later jobs start from the files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


ARROW_BYTES = 4 << 20            # bytes of one Arrow batch between Spark and its Python workers
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound the Arrow batches of the session by ``most`` bytes (a smaller setting stays): whole texts make large rows, and
    a batch is held several times, in the executor and in its worker."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_ARROW_SETTING))
    if not now or int(now[1]) > most:
        spark.conf.set(_ARROW_SETTING, str(most))


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What one operator keeps in its worker process from task to task.  Workers serve one operator after another, so there is
    one such thing at a time: asking for another, or :func:`let_go`, frees it."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def let_go() -> None:
    """Free what an earlier operator kept in this worker process."""
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Hand memory that was freed, but is held for reuse by Arrow and the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # GNU's C library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task, and :func:`give_back` at its end: workers stay, idle ones too, and would keep the
    peak of all their tasks while the next stage fills the executor."""
    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
