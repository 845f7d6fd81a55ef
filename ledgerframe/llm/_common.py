"""What the operators of this subpackage share: shared storage, row hygiene and numpy hashing of texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir. Where that is unset, a local folder if Spark is one local process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "ledgerframe-shared")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, lengthened until no column of `taken` is called so (Spark compares without case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_written(df: DataFrame) -> DataFrame:
    """df, read from files that Spark wrote, in the order in which it was written: a scan takes files by size, not by number.

    The place is the number of the part file and the row's place in it. A df that is no plain read of files is returned as it is."""
    try:
        placed = df.select("*", F.col("_metadata.file_name").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        return df
    return placed.orderBy(F.regexp_extract("at_file", r"^part-(\d+)", 1).try_cast("long"), "at_file", "at_row").drop("at_file", "at_row")


def id_hash_mod(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**64 - 1, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes hashed at once; a longer text is cut at separators.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 14)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def pieces(data: np.ndarray, is_separator: np.ndarray, size: int = CHUNK) -> Iterator[np.ndarray]:
    """data in pieces of `size` bytes or more, cut before separators only, so that no word is cut."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        while end < n:  # move the cut to the next separator
            stop = np.flatnonzero(is_separator[data[end : end + size]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(n, end + size)
        yield data[at:end]
        at = end


def word_hashes(raw: bytes, is_separator: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of raw, in order; a word is a maximal run of bytes that is_separator (256 booleans) denies."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(raw) <= 2 * CHUNK:
        return _word_hashes(data, is_separator)
    return np.concatenate([_word_hashes(part, is_separator) for part in pieces(data, is_separator)])


def _word_hashes(data: np.ndarray, is_separator: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~is_separator[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(len(data))
    prefix = np.empty(len(data) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SHINGLE_CODES = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64 - 1, size=64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; fewer words make one shingle, no word none."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    k = min(n, width)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        total += mix64(words[i : n - k + 1 + i] * _SHINGLE_CODES[i])
    return np.unique(mix64(total + np.uint64(k)))
