"""Shared folders, written tables and Arrow text helpers used by the operators here."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space in the sense of the contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
#: Text bytes handled at once by the vectorised code; one longer text is handled alone.
CHUNK = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is made if
    the driver runs all tasks itself (tests); on a cluster that is an error, as executors elsewhere could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        path = _own.get("dir")
        if not path:
            path = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="attestra-")
    return path.rstrip("/")


_own: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be over
        pass


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/attestra/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and lost executors lose nothing of it."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing reads any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, f)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more, instead of when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def met(left: DataFrame, right: DataFrame, on: str, most_rows: int = 1_000_000) -> DataFrame:
    """Inner join with a written table of few short columns: broadcast if it has at most most_rows rows (counted), else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= most_rows else right.hint("shuffle_hash"), on)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python by bytes too, so long texts cannot add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # not in this version
        pass


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_P = np.uint64((1 << 61) - 1)
_S, _LOW31, _LOW30 = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of numbers below it, in halves of 31 bits."""
    a1, a0, b1, b0 = a >> _S, a & _LOW31, b >> _S, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << _S) + a0 * b0)


class Rolling:
    """Prefix polynomial hashes modulo the prime 2**61 - 1: the hash of any [start, end) is one subtraction and product. (Modulo 2**64 some
    strings of 1,024 symbols would meet for every base.)"""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 40, int(_P)))
        self.inverse = pow(self.base, -1, int(_P))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.empty(size, np.uint64)
                a[0] = 1
                done = 1
                while done < size:  # doubling
                    more = min(done, size - done)
                    a[done : done + more] = _product(a[:more], np.uint64(pow(b, done, int(_P))))
                    done += more
                setattr(self, name, a)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """symbols: uint8, or uint64 words (taken modulo the prime). Halves are summed apart, so that sums stay below 2**64."""
        n = len(symbols)
        self.powers(n)
        out = np.zeros(n + 1, np.uint64)
        if symbols.dtype == np.uint8:
            value, up = symbols.astype(np.uint64) + np.uint64(1), self.up[:n]
            high, low = np.cumsum(value * (up >> _S)), np.cumsum(value * (up & _LOW31))
        else:
            terms = _product(_reduced(symbols), self.up[:n])
            high, low = np.cumsum(terms >> _S), np.cumsum(terms & _LOW31)
        high = _reduced(high)
        out[1:] = _reduced((high >> np.uint64(30)) + ((high & _LOW30) << _S) + _reduced(low))
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number below the prime for what lies in [start, end)."""
        a, z = prefix[start], prefix[end]
        return _product(np.where(z >= a, z - a, z + _P - a), self.down[start])

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.between(prefix, start, end) + (end - start).astype(np.uint64))


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: What a word's last eight bytes keep, by how many there are.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word from which one call hashes it whole.
_LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each [start, end): eight bytes at a time are mixed into it, for all words at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1), writeable=False)
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed * int(_ODD) & (1 << 64) - 1))
    live, done = np.flatnonzero(size < _LONG_WORD), 0
    while len(live):
        block = eight[starts[live] + done].view("<u8")[:, 0] & _KEEP[np.minimum(size[live] - done, 8)]
        out[live] = mix((out[live] ^ block) * _ODD)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size >= _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out
