"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import hashlib
import os
import re
import tempfile
import time

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    ``spark.checkpoint.dir`` names that folder; a folder of our own is used only
    where the setting is absent and everything runs in one process, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "tracequarry-checkpoints"))
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver's objects for them are collected, which could
    take as long as the job; they are on the executors' disks meanwhile.
    """
    gc.collect()
    time.sleep(0.3)  # the Python objects' counterparts in the JVM are let go by a thread of their own
    spark.sparkContext._jvm.System.gc()


#: Rows of a few numbers that may be broadcast, 2 MB or so.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is, for a join by exchange. Counts ``df``, which should be cut."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null read as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


_SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20


def word_pieces(text: bytes, size: int = PIECE):
    """``text`` in pieces of about ``size`` bytes that begin and end between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > size and (m := _SPACE.search(text, at + size)):
            end = m.start()
        yield text[at:end] if end - at < len(text) else text
        at = end


_P, _M = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(text: bytes, size: int):
    """Arrays of the hashes of all runs of ``size`` words, A-Z lowered, in order; of fewer words the whole sequence is one run."""
    digest = xxhash.xxh64_intdigest
    held, some = np.empty(0, np.uint64), False

    def mixed(h: np.ndarray, n: int) -> np.ndarray:
        s = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            s = s * _P + h[k : len(h) - n + 1 + k]
        s = (s ^ (s >> np.uint64(29))) * _M
        return s ^ (s >> np.uint64(32))

    for piece in word_pieces(text):
        h = np.concatenate([held, np.array([digest(x) for x in piece.translate(LOWER_ASCII).split()], np.uint64)])
        if len(h) >= size:
            yield mixed(h, size)
            some, held = True, h[len(h) - size + 1 :]
        else:
            held = h
    if not some and len(held):
        yield mixed(held, len(held))


def rows(batch: pa.RecordBatch, limit: int = 32 << 20, name: str = "text"):
    """Slices of ``batch`` whose texts hold about ``limit`` bytes at most (a single longer row stays whole)."""
    column = batch.column(batch.schema.get_field_index(name))
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
