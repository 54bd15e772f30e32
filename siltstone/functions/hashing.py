"""Fingerprints: 64-bit simhash, Rabin fingerprints, CRC16, Rice codes, a bloom filter."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Fixed value: the 64-bit Rabin polynomial's low word.
POLYNOMIAL = 0x911498AE0E66BAD6


def _rabin_table() -> np.ndarray:
    out = []
    for i in range(256):
        v = i
        for _ in range(8):
            v = (v >> 1) ^ POLYNOMIAL if v & 1 else v >> 1
        out.append(v)
    return np.array(out, np.uint64)


_TABLE = _rabin_table()


def rabin64(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of equally long byte rows (n x length)."""
    f = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        f = (f >> np.uint64(8)) ^ _TABLE[((f ^ rows[:, j]) & np.uint64(255)).astype(np.int64)]
    return f


def rabin64_bytes(data: bytes) -> int:
    return int(rabin64(np.frombuffer(data, np.uint8).reshape(1, -1).astype(np.uint64))[0].view(np.int64)) if data else 0


def simhash(text: str | None) -> int | None:
    """Distinct UTF-16 4-grams, fingerprinted; a bit is set if most fingerprints set it."""
    if not text:
        return None
    u = np.frombuffer(text.encode("utf-16-be", "surrogatepass"), np.uint8).reshape(-1, 2)
    if len(u) < 4:
        u = np.concatenate([u, np.zeros((4 - len(u), 2), np.uint8)])
    grams = np.ascontiguousarray(np.concatenate([u[i : len(u) - 3 + i] for i in range(4)], axis=1))
    grams = np.unique(grams.view(np.uint64).ravel()).view(np.uint8).reshape(-1, 8)  # a gram's eight bytes as one number
    prints = rabin64(grams.astype(np.uint64))
    votes = np.array([2 * int(((prints >> np.uint64(i)) & np.uint64(1)).sum()) - len(prints) for i in range(64)])
    return int(sum(1 << i for i in range(64) if votes[i] > 0) - (1 << 64 if votes[63] > 0 else 0))


def _simhashes(text: pd.Series) -> pd.Series:
    return text.map(simhash).astype("Int64")


def _prints(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else rabin64_bytes(t.encode())).astype("Int64")


def simhash_udf(text: str) -> Column:
    """Column of 64-bit simhashes; made when called, as workers import this module too."""
    return pandas_udf(_simhashes, LongType())(F.col(text))


def rabin_udf(text: str) -> Column:
    return pandas_udf(_prints, LongType())(F.col(text))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0xA001 (reflected 0x8005)."""
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ 0xA001 if c & 1 else c >> 1
    return c


def rice_encode(values: list[int], k: int) -> str:
    """Non-negative numbers as Rice codes: quotient in unary, remainder in k bits."""
    return "".join("1" * (v >> k) + "0" + (format(v & ((1 << k) - 1), f"0{k}b") if k else "") for v in values)


def rice_decode(bits: str, k: int) -> list[int]:
    out, at = [], 0
    while at < len(bits):
        q = bits.index("0", at) - at
        at += q + 1
        out.append(q << k | (int(bits[at : at + k], 2) if k else 0))
        at += k
    return out


class BloomFilter:
    """k hash functions over m bits; numpy bits, mergeable, serialisable."""

    def __init__(self, n: int, p: float = 0.01):
        self.m = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.k = max(1, round(self.m / max(n, 1) * math.log(2)))
        self.bits = np.zeros(self.m, bool)

    def _places(self, item: str) -> list[int]:
        b = item.encode()
        h1, h2 = zlib.crc32(b), zlib.adler32(b) | 1
        return [(h1 + i * h2 + i * i * 0x9E37) % self.m for i in range(self.k)]

    def add(self, item: str) -> None:
        self.bits[self._places(item)] = True

    def __contains__(self, item: str) -> bool:
        return bool(self.bits[self._places(item)].all())

    def merge(self, other: BloomFilter) -> None:
        self.bits |= other.bits

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()
