"""What the operators of this subpackage share: table access, cut lineage, word hashing.

Intermediate tables are written as Parquet under the folder named by
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
costs recomputation of its tasks only. Where the setting is absent, a session on
one machine, as in tests, gets a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text):
    """Lower-case A-Z only; ``lower`` does that fast where the text is pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def shrink_heaps(spark: SparkSession) -> None:
    """Let each executor collect its garbage and give heap back.

    Many short tasks let an executor's heap grow up to its limit long before it is full
    of live objects, and the Python workers beside it need room. One task an executor;
    none is missed while no other job runs.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # without the driver
    spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


class Workspace:
    """A folder of intermediate Parquet tables of one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="siltstone-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.made, self.paths = 0, set()
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the written table; its plan starts there."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small blocks, as tasks write beside Python workers
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._siltstone_path = path
        self.paths.add(path)
        return kept

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned and that nothing reads any more."""
        for df in tables:
            self.paths.discard(df._siltstone_path)
            self._delete(df._siltstone_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which the result still reads."""
        for path in self.paths - {df._siltstone_path for df in tables}:
            self.paths.discard(path)
            self._delete(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of queries that are over: it does so once neither Python nor the driver's JVM refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def relieve(self) -> None:
        """``release``, and heap of the executors that earlier steps took."""
        self.release()
        shrink_heaps(self.spark)

    def drop(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may already be gone; the folder is scratch space
            pass


# 64-bit hashing in numpy. Sums, products and shifts wrap modulo 2**64.

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _inverse_odd(r: int) -> int:
    return pow(r, -1, 1 << 64)


class WordHasher:
    """Hashes the white-space separated words of a text without a Python loop over words.

    A word's hash is a polynomial in an odd base over random byte values, modulo
    2**64, then mixed with the word's length. A-Z are lower-cased; white space is
    0x20 and 0x09-0x0D.
    """

    CHUNK = 1 << 18

    def __init__(self, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(65, 91):
            self.value[c] = self.value[c + 32]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self._power = self._inverse = np.ones(1, np.uint64)
        self._grow(4096)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            with np.errstate(over="ignore"):
                r = np.full(n, self.base, np.uint64)
                r[0] = 1
                self._power = np.cumprod(r, dtype=np.uint64)
                r[1:] = np.uint64(_inverse_odd(self.base))
                self._inverse = np.cumprod(r, dtype=np.uint64)

    def words(self, data: bytes) -> np.ndarray:
        """uint64 hash of each word of ``data``, in order."""
        out, at, size = [], 0, len(data)
        while at < size:
            end = min(size, at + self.CHUNK)
            if end < size:  # cut at white space; a longer word makes a longer chunk
                cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                while cut < at and end < size:
                    end = min(size, end + self.CHUNK)
                    cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                end = cut if cut >= at and end < size else end
            out.append(self._chunk(np.frombuffer(data, np.uint8, end - at, at)))
            at = end if end > at else at + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _chunk(self, b: np.ndarray) -> np.ndarray:
        gap = np.empty(len(b) + 2, bool)
        gap[0] = gap[-1] = True
        gap[1:-1] = self.space[b]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = turn[0::2], turn[1::2]
        if not len(start):
            return np.zeros(0, np.uint64)
        self._grow(len(b) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(self.value[b] * self._power[: len(b)], out=total[1:])
            h = (total[stop] - total[start]) * self._inverse[start]
            return mix64(h + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(hasher: WordHasher, text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; fewer words make one shingle."""
    w = hasher.words(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
