"""Sorted hash arrays in files of the shared folder, mapped into memory by whoever looks something up."""

from __future__ import annotations

import math
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_path

U64 = np.uint64
#: Bytes of input for each range of hashes: few, while there are not too many ranges for small files; in larger inputs more, but no more than a task holds.
RANGE_BYTES = 4 << 20
LARGE_RANGE_BYTES = 32 << 20
MANY_BITS = 18
#: Files that a worker keeps mapped at most.
MOST_MAPPED = 8192


def local_folder(uri: str) -> str:
    """The path of a shared folder that every worker has mounted; the files are mapped into memory from there."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder for this operator, not {uri}")
    return unquote(parts.path)


def new_folder(spark: SparkSession, name: str) -> str:
    folder = local_folder(work_path(spark, name))
    os.makedirs(folder, exist_ok=True)
    return folder


def range_bits(docs: DataFrame) -> int:
    """So many ranges, as a power of 2, that each has about RANGE_BYTES of the input as Spark estimates it, beyond 2**MANY_BITS ranges up to
    LARGE_RANGE_BYTES; 64 ranges where there is no estimate."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 6 if size >= 1 << 60 else bits_for(size)


def bits_for(size: int) -> int:
    small, large = (max(4, math.ceil(math.log2(max(1, size / b)))) for b in (RANGE_BYTES, LARGE_RANGE_BYTES))
    return max(min(small, MANY_BITS), large)


def range_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U64(64 - bits)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def save(path: str, *arrays: np.ndarray) -> None:
    """Arrays one after another behind their lengths; a task that runs twice replaces the file by the same one."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            out.write(a.tobytes())
    os.replace(own, path)


def every_range(rows: DataFrame, bits: int) -> DataFrame:
    """`rows` (range and binary columns, and perhaps numbers) with an empty row for each range, so that a file is written for all: one that isn't there later is then known to be lost."""
    none = {t: F.lit(b"") if t == "binary" else F.lit(0).cast(t) for t in {t for _, t in rows.dtypes}}
    ranges = rows.sparkSession.range(1 << bits).select(*((F.col("id").cast("int") if c == "range" else none[t]).alias(c) for c, t in rows.dtypes))
    return rows.unionByName(ranges)


def load(path: str, *kinds: type) -> list[np.ndarray]:
    """The arrays of save(), mapped. A file that isn't there is an error: it was written, and holds counts that can't be guessed."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path} is gone, or its folder isn't mounted on this worker")
    raw = np.memmap(path, np.uint8, "r")
    at = 8 * len(kinds)
    out = []
    for n, kind in zip(raw[:at].view(np.int64), kinds):
        size = int(n) * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


class Lookup:
    """Files of one kind, by range of a hash."""

    def __init__(self, folder: str, kind: str, bits: int, kinds: tuple[type, ...]):
        self.folder, self.kind, self.bits, self.kinds = folder, kind, bits, kinds
        self.files: dict[int, list[np.ndarray]] = {}

    def __reduce__(self):
        return Lookup, (self.folder, self.kind, self.bits, self.kinds)

    def found(self, by: np.ndarray, keys: np.ndarray, key_column: int, columns: tuple[int, ...]) -> list[np.ndarray]:
        """The values of `columns` at each key, 0 where it isn't; `by` tells the range."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        number = range_of(by, self.bits)
        order = np.lexsort((keys, number))
        at = np.append(runs(number[order]), len(order))
        for a, b in zip(at[:-1], at[1:]):
            mine = order[a:b]
            n = int(number[mine[0]])
            if n not in self.files:
                if len(self.files) >= MOST_MAPPED:  # the one mapped first
                    del self.files[next(iter(self.files))]
                self.files[n] = load(f"{self.folder}/{self.kind}-{n}", *self.kinds)
            arrays = self.files[n]
            if not len(arrays[key_column]):
                continue
            have = arrays[key_column]
            spot = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
            hit = have[spot] == keys[mine]
            for o, c in zip(out, columns):
                o[mine[hit]] = arrays[c][spot[hit]]
        return out
