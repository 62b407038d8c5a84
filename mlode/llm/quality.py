"""Operator 7: quality rules by a hashed n-gram log-likelihood ratio.

Base rules count words, their code points, symbols, repeated lines and words in
repeated 5-word windows; they reject texts of fewer than ``MIN_WORDS`` words or
with more than ``MOST_REPEATED`` percent repeated words. The method compares two
multinomials over hashed word 1- and 2-grams: the trusted target (documents
labelled quality 1 and not toxic) and the raw corpus (every document). A text's
score is the mean over its n-grams of log((c + k) / (e + k)), where c is the
bucket's count in the target, e the count expected there from the raw corpus and
k a prior count that keeps rare buckets near 0. Texts that score below
``THRESHOLD`` are rejected, whatever their length.

The raw counts cover all documents. The target counts come from a bounded sample
of labelled rows: ``MOST_TRUSTED`` documents with the smallest hashes of their
ids (their ids are broadcast). The model is ``BUCKETS`` numbers.

Nulls: null text has no words (rejected); a null id is never trusted; other
columns pass through, whatever their names. Without trusted rows every score is
0 and the base rules decide. Repeated rows are judged alike. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlode.llm import common as C

BUCKETS = 1 << 16
PRIOR = 3.0
THRESHOLD = -0.18
MOST_TRUSTED = 20_000
MIN_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_NEWLINE = 10

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])
_ARROW = pa.struct([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in FIELDS])


def _buckets(word_hashes: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-grams and 2-grams of a chunk, and how many each row has; row by row."""
    mask = np.uint64(buckets - 1)
    ones = (word_hashes & mask).astype(np.int32)
    at, twos_of = C.gram_rows(first, 2)
    twos = (C.gram_hashes(word_hashes, 2)[at] & mask).astype(np.int32)
    return np.concatenate([ones, twos]), np.concatenate([np.diff(first), twos_of])


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _row_keys(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return C.mix(hashes ^ (row.astype(np.uint64) * C.BASE_A))


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row, for each row."""
    rows = len(offsets) - 1
    cuts = np.flatnonzero(data == _NEWLINE)
    begins = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    row = np.searchsorted(offsets, begins, side="right") - 1
    # a newline that ends one row's bytes opens an empty line of that row, at the next row's offset: it has no word
    inside = begins < len(data)
    begins, row = begins[inside], row[inside]
    ends = np.minimum(np.append(begins[1:], len(data)), offsets[row + 1])
    at_cut = (ends > begins) & (data[np.maximum(ends - 1, 0)] == _NEWLINE)
    ends = ends - at_cut
    worded = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends, row = begins[worded], ends[worded], row[worded]
    keys = _row_keys(C.span_hashes(data, begins, ends), row)
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return np.bincount(row[again], minlength=rows)


def measures(data: np.ndarray, offsets: np.ndarray, model: np.ndarray | None) -> dict[str, np.ndarray]:
    """All columns but the verdict for the rows of a chunk."""
    starts, ends, first = C.words(data, offsets)
    hashes = C.span_hashes(data, starts, ends)
    n_words = np.diff(first)
    solid = ~C._SEP[data] & ((data & 0xC0) != 0x80)
    at, counts = C.gram_rows(first, WINDOW)
    row = np.repeat(np.arange(len(counts)), counts)
    twice = _repeats(_row_keys(C.gram_hashes(hashes, WINDOW)[at], row)) if len(at) else np.zeros(0, bool)
    within = C.covered(at[twice], WINDOW, len(hashes))
    out = {
        "n_words": n_words,
        "word_chars": C.row_sums(solid, offsets),
        "n_symbols": C.row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, starts),
        "n_repeat_words": C.row_sums(within, first),
    }
    if model is None:
        score = np.zeros(len(n_words))
    else:
        grams, per = _buckets(hashes, first, len(model))
        sums = np.zeros(len(grams) + 1)
        np.cumsum(model[grams], out=sums[1:])
        bounds = np.concatenate([[0], np.cumsum(per)])
        parts = sums[bounds[1:]] - sums[bounds[:-1]]
        rows = len(n_words)
        score = np.round((parts[:rows] + parts[rows:]) / np.maximum(per[:rows] + per[rows:], 1), 9)
    return out | {"score": score}


def count_grams(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, target, raw) counts; texts: _text and _trusted. One row for each bucket and task is shuffled at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column(1).fill_null(False))
            for i, j, data, offsets in C.text_chunks(batch.column(0)):
                starts, ends, first = C.words(data, offsets)
                grams, per = _buckets(C.span_hashes(data, starts, ends), first, buckets)
                counts[1] += np.bincount(grams, minlength=buckets)
                mine = np.repeat(np.tile(trusted[i:j], 2), per)
                if mine.any():
                    counts[0] += np.bincount(grams[mine], minlength=buckets)
        some = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "target", "raw"])

    per_task = texts.mapInArrow(run, "bucket int, target long, raw long")
    return per_task.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, prior: float = PRIOR, most: int = MOST_TRUSTED) -> np.ndarray | None:
    """The log ratio of each bucket; None without trusted rows."""
    trusted = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"), F.max("toxic").alias("_t")).filter((F.col("_q") == 1) & (F.col("_t") == 0) & F.col("_id").isNotNull())
    # at most `most` ids: a bound that does not depend on the data
    ids = trusted.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id").withColumn("_trusted", F.lit(True))
    flagged = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id", "left").select("_text", F.coalesce("_trusted", F.lit(False)).alias("_trusted"))
    rows = count_grams(flagged, buckets).collect()  # one row for each bucket at most
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    if not target.sum():
        return None
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + prior) / (expected + prior))


def judge(docs: DataFrame, model: np.ndarray | None, *, text: str = "text", out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column ``out`` of FIELDS (in place of a column of that name)."""
    names = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j, data, offsets in C.text_chunks(column):
                m = measures(data, offsets, model)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
                m |= {"base_failed": failed, "kept": ~failed & (m["score"] >= threshold)}
                made = pa.StructArray.from_arrays([pa.array(m[f.name].astype(np.int64) if pa.types.is_int64(f.type) else m[f.name], f.type) for f in _ARROW], fields=list(_ARROW))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns)), made], [*part.schema.names, out])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, fit(docs, labels, text=text, doc_id=doc_id), text=text, out=out, threshold=threshold)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, C.table(spark, sf_dir, "labels")).select("doc_id", *[f"quality.{f.name}" for f in FIELDS])
