"""Operator 8: token ids in independent zstandard frames with a trailing seek table.

File format (little-endian; all but the data frames are skippable frames, so any
zstandard tool can decompress a file to its ids):

* data frames, each compressed on its own: ids as unsigned 32-bit integers of the
  documents in order, about ``FRAME_BYTES`` a frame; a frame holds whole documents;
* a skippable frame with the document index: number of documents, then their ids
  (int64), numbers of ids (uint32) and frames (uint32), zstandard-compressed;
* a skippable frame with the seek table in the public seekable format: compressed
  and decompressed size and 32-bit checksum (low half of XXH64) of each data
  frame, their number, flags, and the magic number that ends the file.

A reader takes the seek table from the end of the file, the document index from
before it, and decompresses only the frames that hold the documents asked for,
checking their checksums.

Files hold ranges of doc_id; within a file documents ascend by (doc_id, text).
Nulls: null text is the empty text (only the end id); null ids come first, as
their own rows. Repeated rows are kept. Empty tables make no files. Other columns
are not read. A retried task writes a new file; only files that a finished task
reports are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm import common as C
from mlode.llm import shared_files as S

FRAME_BYTES = 1 << 18
LEVEL = 3
END_ID = 1
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)
#: Words whose ids a worker remembers before it starts again.
MOST_WORDS = 1_000_000


class FileWriter:
    def __init__(self, sink):
        self.sink, self.frames, self.docs, self.pending, self.size = sink, [], [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids), len(self.frames)))
        self.pending.append(np.ascontiguousarray(ids, "<u4"))
        self.size += 4 * len(ids)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        raw = np.concatenate(self.pending).tobytes()
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        d = np.array(self.docs, np.int64).reshape(-1, 3)
        body = struct.pack("<Q", len(d)) + d[:, 0].astype("<i8").tobytes() + d[:, 1].astype("<u4").tobytes() + d[:, 2].astype("<u4").tobytes()
        body = self.compressor.compress(body)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        # the flag 0x80 says that entries have checksums
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC))
        self.sink.close()


class FileReader:
    def __init__(self, uri: str):
        self.file = S.open_random(uri)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", S.read_range(self.file, size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table")
        begin = size - 9 - 12 * count
        entries = np.frombuffer(S.read_range(self.file, begin, 12 * count), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.sums = (entries[:, k].astype(np.int64) for k in range(3))
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        head = int(self.at[-1])
        magic, length = struct.unpack("<II", S.read_range(self.file, head, 8))
        body = zstandard.ZstdDecompressor().decompress(S.read_range(self.file, head + 8, length))
        (n,) = struct.unpack_from("<Q", body)
        self.doc_ids = np.frombuffer(body, "<i8", n, 8)
        self.counts = np.frombuffer(body, "<u4", n, 8 + 8 * n).astype(np.int64)
        self.frame_of = np.frombuffer(body, "<u4", n, 8 + 12 * n).astype(np.int64)

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(S.read_range(self.file, int(self.at[k]), int(self.packed[k])), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; only frames with a wanted document are read."""
        begins = np.cumsum(self.counts) - self.counts
        open_frame, ids, base = -1, None, 0
        for d, n, k, at in zip(self.doc_ids.tolist(), self.counts.tolist(), self.frame_of.tolist(), begins.tolist(), strict=True):
            if wanted is not None and d not in wanted:
                continue
            if k != open_frame:
                open_frame, ids = k, self.frame(k)
                base = int(begins[np.searchsorted(self.frame_of, k)])
            yield (None if d == NULL_ID else d), ids[at - base : at - base + n]


_WORKER: dict = {}


#: With these parts, a tokenizer drops white space, folds case, and never joins letters or digits with other characters.
_WORDWISE = ("{'type': 'Lowercase'}", "'behavior': 'Removed', 'invert': True", "[^\\\\s\\\\p{L}\\\\p{N}]+")


class Encoder:
    """Ids of whole texts.

    Where the tokenizer drops white space, a text's ids are its words' ids in order, and each distinct word is encoded
    once: in lower case (ASCII) and with trailing stops and commas apart, as they are pieces of their own after a
    letter or digit. Words with a special token's "<|" are left as they are. Other tokenizers get whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        parts = json.loads(self.tokenizer.to_str())
        said = str(parts["normalizer"]) + str(parts["pre_tokenizer"])
        self.wordwise = parts["post_processor"] is None and all(x in said for x in _WORDWISE)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pieces: dict[bytes, bytes] = {b"": b""}  # ids as bytes: a list of ints takes several times the memory
        self.flat, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros((1 << 16) + 1, np.int64), 0

    def learn(self, new: list[bytes]) -> None:
        cut = []
        for w in new:
            tail = b""
            if b"<|" not in w:
                w = w.lower()
                if w[-1] in b".,":
                    stem = w.rstrip(b".,")
                    if stem and stem[-1:].isalnum():
                        w, tail = stem, w[len(stem) :]
            cut.append((w, tail))
        pieces = self.pieces
        unknown = [x for x in dict.fromkeys(x for pair in cut for x in pair) if x not in pieces]
        pieces.update(zip(unknown, [array("I", e.ids).tobytes() for e in self.encode([x.decode() for x in unknown], add_special_tokens=False)], strict=True))
        ids = [pieces[a] + pieces[b] if b else pieces[a] for a, b in cut]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, total = len(self.number), int(lengths.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.begin) <= first + len(ids):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.begin[first + 1 : first + 1 + len(ids)] = self.used + np.cumsum(lengths)
        self.used += total
        self.number.update(zip(new, range(first, first + len(ids)), strict=True))

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [e.ids + [END_ID] for e in self.encode(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk with the end id after each row, and each row's bounds."""
        if not self.wordwise:
            return self.whole(data, offsets)
        _, _, first = C.words(data, offsets)
        found = data.tobytes()
        cut = found.split()
        if len(cut) != first[-1]:  # a row ends without white space: cut row by row
            cut = [w for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for w in found[a:b].split()]
        if len(self.number) > MOST_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(cut) if w not in self.number]
        if new:
            self.learn(new)
        number = np.fromiter(map(self.number.__getitem__, cut), np.int64, len(cut))
        lengths = self.begin[number + 1] - self.begin[number]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        per_row = ends[first[1:]] - ends[first[:-1]]
        rows = np.arange(len(per_row))
        bounds = np.concatenate([[0], np.cumsum(per_row + 1)])
        out = np.full(int(bounds[-1]), END_ID, np.uint32)
        row_of = np.repeat(rows, np.diff(first))
        target = np.repeat(ends[:-1] + row_of, lengths) + (np.arange(int(ends[-1])) - np.repeat(ends[:-1], lengths))
        source = np.repeat(self.begin[number], lengths) + (np.arange(int(ends[-1])) - np.repeat(ends[:-1], lengths))
        out[target] = self.flat[source]
        return out, bounds


def encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes docs in ascending doc_id order; one entry for each file: file, first, n_docs, n_tokens, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, uri, first, total, n = encoder(tokenizer), None, "", None, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, offsets in C.text_chunks(batch.column(1)):
                if writer is None:
                    uri, first = S.unique(folder, "tokens", ".zst"), ids[i]
                    writer = FileWriter(S.create(uri))
                out, bounds = enc.rows(data, offsets)
                for k in range(j - i):
                    writer.add(ids[i + k], out[bounds[k] : bounds[k + 1]])
                total, n = total + len(out), n + j - i
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "first": pa.array([first], pa.int64()), "n_docs": [n], "n_tokens": [total]})

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    ranged = rows.repartitionByRange(F.col("_id").asc_nulls_first(), F.xxhash64("_text")).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    files = ranged.mapInArrow(run, "file string, first long, n_docs long, n_tokens long")
    # one row for each file; a file is a partition
    found = [r.asDict() for r in files.withColumn("part", F.spark_partition_id()).collect()]
    return sorted(found, key=lambda r: r["part"])


def read_token_files(spark: SparkSession, files: list[dict], wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files, from the files."""
    starts, at = [], 0
    for f in files:
        starts.append((f["file"], at))
        at += f["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = FileReader(uri)
                begins = np.cumsum(reader.counts) - reader.counts
                if wanted is not None:
                    begins = begins[np.isin(reader.doc_ids, list(wanted))]
                out: tuple[list, list, list] = ([], [], [])
                for d, ids in reader.documents(wanted):
                    for to, x in zip(out, (d, len(ids), zlib.crc32(ids)), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out[0], pa.int64()), "start": pa.array(base + begins, pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_crc32": pa.array(out[2], pa.int64())})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    # a row for each file, as evenly dealt as the files
    slices = spark.sparkContext.parallelize(starts, len(starts))
    return spark.createDataFrame(slices, "file string, base long").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    files = write_token_files(docs, tokenizer or default_tokenizer(), C.shared_path(spark, "tokens"))
    return read_token_files(spark, files)


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
