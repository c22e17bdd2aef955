"""Shared plumbing of the training-data operators: the shared folder, files in it, and vectorised text scans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- shared folder


#: Folders made for applications without the setting.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent in a local session (as in tests) a temporary folder is made, one for each application; on a
    cluster its absence is an error, as executors would write to different disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="evigraph-shared-")
        found = _own_folders[app]
    return found.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, as a URI or path that Spark's writers take."""
    return f"{shared_dir(spark)}/evigraph-{name}-{uuid.uuid4().hex[:12]}"


def table_at(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it again: cuts lineage and survives lost executors.

    With a bound of its ``rows``, so few that they don't fill the shuffle's partitions, it is written in fewer: one for each 50,000
    rows, and at least as many as the cluster has cores.
    """
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 50_000)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str | None:
    """The plain path of a local or file: URI, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for files that are not Spark tables."""
    from pyarrow import fs

    if (p := local_path(uri)) is not None:
        return fs.LocalFileSystem(), p
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks) -> int:
    """Write bytes to a file by a temporary name and a rename, so that a retried or doubled task leaves one whole file."""
    where, path = filesystem(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with where.open_output_stream(part, buffer_size=1 << 20) as out:
        for chunk in chunks:
            size += len(memoryview(chunk).cast("B"))
            out.write(chunk)
    where.move(part, path)
    return size


def map_file(uri: str, dtype) -> np.ndarray:
    """A file of the shared folder as a read-only array: memory-mapped, or read whole from a store without plain paths."""
    if (p := local_path(uri)) is not None:
        return np.memmap(p, dtype=dtype, mode="r") if os.path.getsize(p) else np.empty(0, dtype)
    where, path = filesystem(uri)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with a number behind them where ``df`` has a column of that name already, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own, k = name, 0
        while own.lower() in taken:
            k += 1
            own = f"{name}_{k}"
        taken.add(own.lower())
        out.append(own)
    return out


class Keyed:
    """Numbers by 64-bit keys, as sorted arrays in ranges of the shared folder that tasks map."""

    def __init__(self, where: str, sizes: list[int]):
        self.where, self.sizes, self.files = where, sizes, {}

    def of(self, keys: np.ndarray, default: float) -> np.ndarray:
        """The value of each key; ``default`` for keys without one."""
        out = np.full(len(keys), default)
        part = range_of(keys, len(self.sizes))
        for b in np.unique(part).tolist():
            if self.sizes[b]:
                if b not in self.files:
                    self.files[b] = (map_file(f"{self.where}/{b}.keys", np.int64), map_file(f"{self.where}/{b}.values", np.float32))
                have, values = self.files[b]
                rows = np.flatnonzero(part == b)
                k = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                hit = have[k] == keys[rows]
                out[rows[hit]] = values[k[hit]]
        return out


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the signed 64 bits each key falls in."""
    return ((keys.astype(np.int64) >> np.int64(32)) + np.int64(1 << 31)) * n >> np.int64(32)


def keyed_at(rows: DataFrame, name: str, ranges: int | None = None) -> tuple[str, tuple[int, ...]]:
    """Write ``rows(key long, value)`` with keys spread over all 64 bits; returns what a :class:`Keyed` needs. One of equal keys' rows counts."""
    from pyspark.sql import functions as F

    spark = rows.sparkSession
    n = ranges or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = workdir(spark, name)
    bucket = F.shiftright((F.shiftright("key", 32) + F.lit(1 << 31)) * F.lit(n), 32).cast("int")

    def keep(key, table):
        import pyarrow as pa

        b, keys = key[0].as_py(), table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        put_file(f"{where}/{b}.keys", [keys[order].tobytes()])
        put_file(f"{where}/{b}.values", [table.column("value").to_numpy()[order].astype(np.float32).tobytes()])
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    sizes = [0] * n
    for r in rows.select(bucket.alias("bucket"), "key", F.col("value").cast("float").alias("value")).groupBy("bucket").applyInArrow(keep, "bucket int, n long").collect():
        sizes[r["bucket"]] = r["n"]
    return where, tuple(sizes)


@lru_cache(maxsize=4)
def keyed(where: str, sizes: tuple[int, ...]) -> Keyed:
    """The opened arrays of a task's process."""
    return Keyed(where, list(sizes))


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Arrow batches of the session hold at most so many rows: whole texts are long, and a task holds a few batches at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


# ---------------------------------------------------------------- text of Arrow batches


def utf8_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without copies; offsets has one entry more than rows.

    Nulls must have been replaced before (coalesce on the JVM side).
    """
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes stay near ``most``; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE[IS_SPACE] = 0
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("i", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x)
    return _tables["p"][:n], _tables["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte codes from prefix sums, then mixed."""
    n = len(data)
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code[data] * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the runs without ASCII white space in each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(rows, np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def words_hashed(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per row); A-Z count as a-z. Works through about ``most`` bytes at a time."""
    hashes, counts = [], []
    for a, b in spans(offsets, most):
        part = LOWER[data[offsets[a] : offsets[b]]]
        s, e, n = word_spans(part, offsets[a : b + 1] - offsets[a])
        counts.append(n)
        if len(part) <= 4 * most:
            hashes.append(span_hashes(part, s, e))
        else:  # one very long text: by groups of words, so that tables stay small
            k = 0
            while k < len(s):
                m = max(k + 1, int(np.searchsorted(e, s[k] + 4 * most, side="right")))
                x = part[s[k] : e[m - 1]]
                hashes.append(span_hashes(x, s[k:m] - s[k], e[k:m] - s[k]))
                k = m
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs with these lengths, with the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def tidy(run):
    """A mapInArrow function that gives freed memory back to the system when its partition ends: workers are used again by later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Return what the allocators of Arrow and C keep but nothing uses."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass
