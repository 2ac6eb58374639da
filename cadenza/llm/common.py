"""What the training-data operators share: words, hashes, staged tables, ids.

A *word* is a maximal run of characters other than U+0020 and U+0009..U+000D.  Those six are
exactly what ``bytes.split()`` splits on, so words are taken from UTF-8 bytes without a regex.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a worker turns into Python objects at once: texts are long.  Spark bounds a batch's bytes by itself.
BATCH_ROWS = 256
_CACHE_WORDS = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most BATCH_ROWS at a time (views; nothing is copied)."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local folder is made and set if the master is local (tests, a laptop); on a cluster
    that is refused, as executors would write to disks that others do not see.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cadenza-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is deleted by ``drop_stage``, or else when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    sc = spark.sparkContext
    own = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)
    back = spark.read.schema(df.schema).parquet(path)
    back.stage_path = path
    return back


def drop_stage(*staged: DataFrame) -> None:
    """Delete the files behind tables that ``stage`` returned (nothing may read them afterwards)."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stage_path).getParent()
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered in a worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORD_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(k: int, seed: int) -> list[np.uint64]:
    rng = np.random.default_rng(seed)
    return [np.uint64(int(v) | 1) for v in rng.integers(0, 2**64, k, dtype=np.uint64)]


def window_hashes(h: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """A 64-bit hash of every ``k`` consecutive entries of ``h`` (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, m in enumerate(_odd(k, seed)):
        out += scramble(h[i : i + n] + m) * m
    return scramble(out)


def id_crc_mod(doc_id: int, mod: int) -> int:
    """crc32 of the id written in decimal, modulo ``mod``: what splits held-out rows."""
    return zlib.crc32(str(doc_id).encode()) % mod


def crc_mod(col: str, mod: int):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod))
