"""What the operators of this subpackage share: input shaping, stored tables, byte-level hashing."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_DIRS[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, most_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows come to at most that many bytes; else as it is, to be joined by shuffle.

    A column counts 16 bytes, arrays 8 more for each entry, strings and binaries their length.
    """
    widths = [16 + (8 * F.greatest(F.size(c), F.lit(0)) if f.dataType.typeName() == "array" else F.octet_length(c) if f.dataType.typeName() in ("string", "binary") else F.lit(0)) for c, f in zip(df.columns, df.schema, strict=True)]
    total = df.agg(F.sum(F.coalesce(functools.reduce(lambda x, y: x + y, widths), F.lit(16)).cast("long"))).first()[0]
    return F.broadcast(df) if (total or 0) <= most_bytes else df


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Let Arrow batches to and from Python workers hold some megabytes of text, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, handing freed memory back to the system when a task ends: Python workers live on from stage to stage."""

    def told(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return told


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact name, so further columns (even ones that clash by case) do no harm."""
    bare = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return bare.select(*[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def keyed(df: DataFrame, key: str, *names: str) -> DataFrame:
    """key and the named columns, one row a key.

    Rows with a null key can't be referred to and go. Of rows that repeat a key the least stays (nulls first); the
    check reads the key column alone, and the texts are shuffled only when it finds a repeat.
    """
    bounded_batches(df.sparkSession)
    rows = pick(df, key, *names).where(F.col(key).isNotNull())
    if rows.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    least = F.min(F.struct(*[F.struct(F.col(n).isNotNull(), F.col(n)) for n in names]))
    got = rows.groupBy(key).agg(least.alias("_r"))
    return got.select(key, *[F.col("_r").getField(f"col{i + 1}").getField(n).alias(n) for i, n in enumerate(names)])


def runs_by_key(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows of a sorted partition that agree in the (integer) key columns, one table a key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(key[a].tolist())
            if held and own != now:
                yield pa.Table.from_batches(held)
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def text_slices(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about max_bytes; a longer text is a run by itself. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(filled)
    if not n:
        return
    _, offs, data = filled.buffers()
    offsets = np.frombuffer(offs, np.int64)[filled.offset : filled.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def window_slices(column: pa.Array, width: int, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in its text, bytes, offsets) as text_slices; a longer text in pieces that share width - 1 bytes."""
    for at, data, offsets in text_slices(column, max_bytes):
        if len(data) <= 4 * max_bytes:
            yield at, 0, data, offsets
            continue
        for k in range(0, len(data) - width + 1, max_bytes):
            piece = data[k : k + max_bytes + width - 1]
            yield at, k, piece, np.array([0, len(piece)])


_RNG = np.random.default_rng(20240601)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, each in constant time from running sums."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64) if isinstance(end, np.ndarray) else np.uint64(0)
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of that width, by start."""
        n = len(self._sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[width : width + n] - self._sums[:n]) * self._down[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_TAILS = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, long: int = 64) -> np.ndarray:
    """Hash of each span: eight bytes a step, each step a bijection of what it adds; above `long` bytes by BLAKE2b."""
    size = end - start
    out = mix(size.astype(np.uint64) * BASE)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    at = np.flatnonzero(size <= long)
    done = 0
    while len(at):
        lane = lanes[start[at] + done].view("<u8").ravel()
        left = size[at] - done
        lane = np.where(left < 8, lane & _TAILS[np.minimum(left, 7)], lane)
        out[at] = mix(out[at] * BASE ^ lane)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; and each text's first word number."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    if len(offsets) == 2 and n > 2 * _PIECE:  # one long text, by pieces that end at white space
        found, at = [], 0
        while at < n:
            to = min(n, at + _PIECE)
            while to < n and not len(gap := np.flatnonzero(_SPACE[data[to : to + _PIECE]])):
                to = min(n, to + _PIECE)
            to = to if to == n else to + int(gap[0])
            low = _LOWER[data[at:to]]
            start, end = _spans(low, np.array([0, to - at]))
            found.append((_hashed(low, start, end), start + at, end + at))
            at = to
        hashes, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        return hashes, start, end, np.array([0, len(start)])
    low = _LOWER[data]
    start, end = _spans(low, offsets)
    return _hashed(low, start, end), start, end, np.searchsorted(start, offsets)


_PIECE = 1 << 20


def _spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a text's bounds part words."""
    n = len(low)
    solid = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    start = np.flatnonzero(solid & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    return start, np.flatnonzero(solid & (after | cut[1:])) + 1


_COEFF = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words; of the whole sequence where it is shorter."""
    if len(words) < width:
        return mix((words * _COEFF[: len(words)]).sum(keepdims=True) + np.uint64(len(words))) if len(words) else words
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _COEFF[i]
    return mix(total)


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
