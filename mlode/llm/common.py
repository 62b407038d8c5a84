"""What the operators share: the shared folder, Arrow text buffers, word and n-gram hashes.

Words are maximal runs of bytes other than the six ASCII white-space bytes
(0x20 and 0x09-0x0D). Hashes are 64-bit; where equality decides a result the
operators use two independent ones (128 bits) or compare the strings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one round of array work takes; a longer document is a round of its own.
CHUNK_BYTES = 1 << 20

BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xD6E8FEB86659FD93)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jroot = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jroot.get() if jroot.isDefined() else None
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mlode-", dir=_own_folder())
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own_folder() -> str:
    import os

    os.makedirs("/tmp/checkpoints", exist_ok=True)
    return "/tmp/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there."""
    return Kept(df, name).df


class Kept:
    """df, written to the shared folder and read back; drop() deletes it once all that reads it is written."""

    def __init__(self, df: DataFrame, name: str):
        self.path = shared_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = df.sparkSession.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        context = self.df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """About the bytes of df's rows: three times the size that its files give, or a sum over its text and binary columns where no file tells."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return 3 * size
    parts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    return df.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, parts, F.lit(8)).cast("long")), F.lit(0))).first()[0]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_hash(*cols) -> "F.Column":
    """A 52-bit number below 1 from the md5 of the columns as text joined by ':', the same in any SQL engine."""
    key = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


# ---------------------------------------------------------------- Arrow text

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with every output bit depending on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE_A) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, mixed over its 8-byte lanes (or by xxhash for a long span); other bases give independent hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + base)
    live = np.flatnonzero(size <= LONG_SPAN)
    at, left = starts[live], size[live]
    while len(live):
        lane = lanes[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.clip(left, 1, 8).astype(np.uint64)))
        lane[left == 0] = 0
        out[live] = mix((out[live] ^ lane) * BASE_B + base)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), int(base))
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of the first word of each row (with the total last)."""
    solid = ~_SEP[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = solid[first]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = solid[last]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(word_hashes: np.ndarray, n: int, step: np.uint64 = BASE_B) -> np.ndarray:
    """Hashes of each run of n word hashes (runs that cross rows included)."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = word_hashes[:count].copy()
    for k in range(1, n):
        total ^= total >> np.uint64(32)
        total *= step
        total += word_hashes[k : k + count]
    return mix(total)


def gram_rows(first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that lie inside one row, and how many each row has."""
    counts = np.maximum(np.diff(first_word) - n + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first_word[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total), counts


def covered(first: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total places lie in a run of that length that begins at one of first."""
    delta = np.zeros(total + 1, np.int32)
    np.add.at(delta, first, 1)
    np.add.at(delta, np.minimum(first + length, total), -1)
    return np.cumsum(delta[:-1]) > 0


def row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
