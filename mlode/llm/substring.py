"""Operator 5: removal of repeated substrings by fixed-block anchors.

A window is 13 consecutive words of one document; each word covered by a window
whose words also start in a document with a smaller doc_id is removed.

1. Index: each document's non-overlapping blocks of 7 words. Every 13-word window
   holds a whole block. Probes: every rolling run of 7 words. Blocks and probes
   go to the partition of their hash as packed arrays (4 bytes a hash), not rows.
   A probe hits if a block with its hash is in a smaller document; a block is hit
   if a larger document probes it. Hits return as bits and block numbers.
2. Extension: the windows around hits are compared by two hashes (64 bits and the partition):
   windows around hit blocks are the references, windows around hit probes are
   looked up in them, and hits that extend to whole windows return as positions.
   Overlapping windows make up the maximal repeats.
3. Words that these windows cover are removed.

Both lookups hold one entry for each distinct hash of a partition and stream the
rest, so a passage or copy that a third of all documents share costs a task no
memory. The text is shuffled once (both later steps use the same exchange).

Nulls: null text has no words; a null id counts as larger than any other id and
stays null in the result. Rows with equal ids don't affect each other. Empty
tables give no rows. Other columns are not read. Ids are whole numbers (what a
cast to long refuses is an error).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm import common as C

WINDOW = 13
LAST_ID = (1 << 63) - 1
OWNERS, PROBES = 0, 1
#: Blocks of a partition that are held in memory until all its probes are known; beyond it they wait in a temporary file.
HELD_BYTES = 64 << 20
#: Text bytes of a bucket of documents, which a task holds at once: more text makes more buckets.
BUCKET_BYTES = 64 << 20


MOST_KEYS = 4096


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """An int for each of n hash partitions that Spark deals to that partition (plain numbers, dealt less evenly, where there are many)."""
    if n > MOST_KEYS:
        return list(range(n))
    rows = spark.range(0, 40 * n + 200).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    spare = iter(range(1 << 30, 1 << 31))
    return [found.get(p, next(spare)) for p in range(n)]


def _runs(part: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part (stable) and each part's bounds in it."""
    order = np.argsort(part.astype(np.uint16) if n <= 65536 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _blob(ids: np.ndarray, marks: np.ndarray, row: np.ndarray, *columns: np.ndarray, places: np.ndarray | None = None) -> bytes:
    """The documents (id, mark, entries) and the entries' columns of a part of a chunk; row is ascending. Places take two bytes where they fit."""
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    docs = row[edge]
    counts = np.diff(np.append(edge, len(row))).astype(np.uint32)
    own = ids[docs]
    wide = 0
    if places is not None:
        wide = 2 if int(places.max()) < 1 << 16 else 4
        columns = (*columns, places.astype(f"u{wide}"))
    return b"".join([np.array([len(docs), len(row), wide], np.uint32).tobytes(), np.diff(own, prepend=np.int64(0)).tobytes(), marks[docs].tobytes(), counts.tobytes(), *(c.tobytes() for c in columns)])


def _unblob(blob: bytes, *kinds: str) -> tuple[np.ndarray, ...]:
    """ids and marks of the documents, counts, then the columns, then places if it has some."""
    d, n, wide = np.frombuffer(blob, np.uint32, 3).tolist()
    at = 12
    out = [np.cumsum(np.frombuffer(blob, np.int64, d, at))]
    at += 8 * d
    for kind, size in (("u4", d), ("u4", d), *((k, n) for k in kinds), *(((f"u{wide}", n),) if wide else ())):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    out[2] = out[2].astype(np.int64)
    return tuple(out)


def _rows(kinds: list[int], parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


ROUTED = "part int, kind int, blob binary"
#: Answers travel packed: a row for each bucket of documents and task.
HITS = "bucket int, id array<long>, mark array<long>, kind array<int>, part array<int>, blob array<binary>"
FLUSH_BYTES = 32 << 20


def _ids_marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column(0).fill_null(LAST_ID)), (np.asarray(batch.column(1)) & 0xFFFFFFFF).astype(np.uint32)


def _route(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition number and the 32 bits that are kept there."""
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _anchors(data: np.ndarray, offsets: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the rolling runs in rows that have a window: hash, row, place in the row; word hashes; first words."""
    starts, ends, first = C.words(data, offsets)
    hashes = C.span_hashes(data, starts, ends)
    at, counts = C.gram_rows(first, block)
    row = np.repeat(np.arange(len(counts)), counts)
    some = np.diff(first)[row] >= window
    at, row = at[some], row[some]
    grams = C.gram_hashes(hashes, block)
    return grams[at] if len(at) else np.zeros(0, np.uint64), row, at - first[row], hashes, first


def _emit_anchors(keys: list[int], block: int, window: int):
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = _ids_marks(batch)
            for i, j, data, offsets in C.text_chunks(batch.column(2)):
                grams, row, place, _, _ = _anchors(data, offsets, block, window)
                kinds, parts, blobs = [], [], []
                part, low = _route(grams, n)
                own = np.flatnonzero(place % block == 0)
                for kind, chosen in ((OWNERS, own), (PROBES, None)):
                    p, h, r, b = (part, low, row, None) if chosen is None else (part[chosen], low[chosen], row[chosen], place[chosen] // block)
                    order, bounds = _runs(p, r, n)
                    h, r = h[order], r[order]
                    b = None if b is None else b[order]
                    for k in range(n):
                        s, e = int(bounds[k]), int(bounds[k + 1])
                        if s < e:
                            kinds.append(kind)
                            parts.append(keys[k])
                            blobs.append(_blob(ids[i:j], marks[i:j], r[s:e], h[s:e], places=None if b is None else b[s:e]))
                if kinds:
                    yield _rows(kinds, parts, blobs)

    return run


class _Smallest:
    """Distinct hashes with the smallest id of each, merged as they come."""

    def __init__(self, kind: str):
        self.kind, self.parts, self.size, self.hash, self.id = kind, [], 0, np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((hashes, ids))
        self.size += len(hashes)
        if self.size > 500_000 + len(self.hash):
            self.settle()

    def settle(self) -> None:
        if not self.parts:
            return
        h = np.concatenate([self.hash, *(p[0] for p in self.parts)])
        d = np.concatenate([self.id, *(p[1] for p in self.parts)])
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        edge = np.concatenate([[True], h[1:] != h[:-1]])
        self.hash, self.id, self.parts, self.size = h[edge], d[edge], [], 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return at, self.hash[at] == hashes


def bucket_of(ids: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document; bucket_column is the same in Spark."""
    return (ids % n + marks.astype(np.int64)) % n


def bucket_column(n: int) -> Column:
    return F.pmod(F.pmod(F.col("id"), F.lit(n)) + F.col("mark"), F.lit(n)).cast("int")


class _Answers:
    """Answers of a task, gathered by bucket."""

    def __init__(self, keys: list[int]):
        self.keys, self.rows, self.size = keys, [], 0

    def add(self, ids: np.ndarray, marks: np.ndarray, kind: int, part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        self.rows.append((ids, marks.astype(np.int64), np.full(len(ids), kind, np.int32), np.full(len(ids), part, np.int32), blobs))
        self.size += sum(map(len, blobs)) + 40 * len(blobs)
        if self.size > FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, marks, kinds, parts = (np.concatenate([r[k] for r in self.rows]) for k in range(4))
        blobs = pa.array([b for r in self.rows for b in r[4]], pa.binary())
        bucket = bucket_of(ids, marks, len(self.keys))
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        cuts = pa.array(np.append(at, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in (ids, marks, kinds, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(self.keys, np.int32)[found]), *lists, pa.ListArray.from_arrays(cuts, blobs.take(pa.array(order)))], ["bucket", "id", "mark", "kind", "part", "blob"])
        self.rows, self.size = [], 0


def _by_document(answers: pa.Table) -> dict[tuple[int, int], list[tuple[int, int, bytes]]]:
    """(kind, part, blob) of each document of a bucket; rows of one id and text give equal answers, kept once."""
    columns = [answers.column(c).combine_chunks() for c in ("id", "mark", "kind", "part", "blob")]
    flat = [pa.concat_arrays([c.flatten() for c in x.chunks]) if isinstance(x, pa.ChunkedArray) else x.flatten() for x in columns]
    out: dict[tuple[int, int], set] = {}
    for i, m, *rest in zip(*(c.to_pylist() for c in flat), strict=True):
        out.setdefault((i, m), set()).add(tuple(rest))
    return {k: sorted(v) for k, v in out.items()}


class _Held:
    """Blobs to be read once more, in memory or, if they are many, in an unnamed temporary file."""

    def __init__(self):
        self.file, self.sizes = tempfile.SpooledTemporaryFile(HELD_BYTES), []

    def add(self, blob: bytes) -> None:
        self.file.write(blob)
        self.sizes.append(len(blob))

    def __iter__(self) -> Iterator[bytes]:
        self.file.seek(0)
        for n in self.sizes:
            yield self.file.read(n)

    def close(self) -> None:
        self.file.close()


def _answer_anchors(keys: list[int]):
    numbers = {k: p for p, k in enumerate(keys)}

    def owners_hit(answers: _Answers, part: int, index: "_Smallest", largest: np.ndarray, held: _Held) -> Iterator[pa.RecordBatch]:
        """Blocks that a larger document probed."""
        for blob in held:
            ids, marks, counts, hashes, block = _unblob(blob, "u4")
            own = np.repeat(ids, counts)
            at, there = index.find(hashes)
            hit = there & (largest[at] > own)
            ends = np.cumsum(counts)
            some = np.flatnonzero(C.row_sums(hit, np.concatenate([[0], ends])))
            if len(some):
                begins = ends - counts
                yield from answers.add(ids[some], marks[some], OWNERS, numbers[part], [block[begins[k] : ends[k]][hit[begins[k] : ends[k]]].astype(np.uint32).tobytes() for k in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, index, largest, held = None, _Smallest("u4"), None, _Held()
        answers = _Answers(keys)
        for batch in batches:
            for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if largest is not None:
                        yield from owners_hit(answers, part, index, largest, held)
                    held.close()
                    part, index, largest, held = p, _Smallest("u4"), None, _Held()
                if kind == OWNERS:
                    ids, _, counts, hashes, _ = _unblob(blob, "u4")
                    index.add(hashes, np.repeat(ids, counts))
                    held.add(blob)
                    continue
                if largest is None:
                    index.settle()
                    largest = np.full(len(index.hash), -(1 << 63), np.int64)
                if not len(index.hash):
                    continue
                ids, marks, counts, hashes = _unblob(blob, "u4")
                own = np.repeat(ids, counts)
                at, there = index.find(hashes)
                np.maximum.at(largest, at[there], own[there])
                hit = there & (index.id[at] < own)
                ends = np.cumsum(counts)
                some = np.flatnonzero(C.row_sums(hit, np.concatenate([[0], ends])))
                if len(some):
                    begins = ends - counts
                    yield from answers.add(ids[some], marks[some], PROBES, numbers[p], [np.packbits(hit[begins[k] : ends[k]]).tobytes() for k in some])
        if largest is not None:
            yield from owners_hit(answers, part, index, largest, held)
        held.close()
        yield from answers.flush()

    return run


def _around(places: np.ndarray, block: int, window: int, words: int) -> np.ndarray:
    """Starts of the windows that hold a run of `block` words at one of the places."""
    lo = np.maximum(places - (window - block), 0)
    hi = np.minimum(places, words - window) + 1
    delta = np.zeros(words + 2, np.int32)
    np.add.at(delta, lo[hi > lo], 1)
    np.add.at(delta, hi[hi > lo], -1)
    return np.flatnonzero(np.cumsum(delta) > 0)


def _emit_windows(keys: list[int], block: int, window: int):
    n = len(keys)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hits = _by_document(answers)
        out = []
        wanted = [(i, m) in hits for i, m in zip(docs.column("id").to_pylist(), docs.column("mark").to_pylist(), strict=True)]
        for batch in docs.filter(pa.array(wanted, pa.bool_())).to_batches():
            ids, marks = _ids_marks(batch)
            for i, j, data, offsets in C.text_chunks(batch.column(2)):
                grams, row, place, hashes, first = _anchors(data, offsets, block, window)
                part, _ = _route(grams, n)
                starts, ends, _ = C.words(data, offsets)
                other = C.span_hashes(data, starts, ends, C.BASE_B)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                chosen: dict[int, list[tuple[int, np.ndarray]]] = {PROBES: [], OWNERS: []}
                for k in range(j - i):
                    size, mine = int(first[k + 1] - first[k]), part[bounds[k] : bounds[k + 1]]
                    order = np.argsort(mine, kind="stable")
                    edges = np.searchsorted(mine[order], np.arange(n + 1)) if len(mine) else None
                    places: dict[int, list[np.ndarray]] = {PROBES: [], OWNERS: []}
                    for role, number, blob in hits[int(ids[i + k]), int(marks[i + k])]:
                        if role == OWNERS:
                            places[OWNERS].append(np.frombuffer(blob, np.uint32).astype(np.int64) * block)
                        elif edges is not None:
                            at = order[edges[number] : edges[number + 1]]
                            places[PROBES].append(at[np.unpackbits(np.frombuffer(blob, np.uint8), count=len(at)).astype(bool)])
                    for kind, found in places.items():
                        if found and size >= window:
                            chosen[kind].append((k, _around(np.concatenate(found), block, window, size)))
                a, b = C.gram_hashes(hashes, window), C.gram_hashes(other, window, C.BASE_A)
                kinds, parts, blobs = [], [], []
                for kind, found in chosen.items():
                    if not found:
                        continue
                    r = np.repeat(np.array([k for k, _ in found]), [len(x) for _, x in found])
                    at = np.concatenate([x for _, x in found])
                    ha, hb = a[first[r] + at], b[first[r] + at]
                    # the partition's number and 64 more bits of both hashes
                    p, both = ((ha >> np.uint64(33)) % np.uint64(n)).astype(np.int64), C.mix(ha ^ C.mix(hb))
                    order, cuts = _runs(p, r, n)
                    for q in range(n):
                        o = order[cuts[q] : cuts[q + 1]]
                        if len(o):
                            kinds.append(kind)
                            parts.append(keys[q])
                            blobs.append(_blob(ids[i:j], marks[i:j], r[o], both[o], places=at[o] if kind == PROBES else None))
                if kinds:
                    out.append(_rows(kinds, parts, blobs))
        return pa.Table.from_batches(out, _rows([], [], []).schema)

    return run


def _answer_windows(keys: list[int]):
    """Looks windows up by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = _Answers(keys)
        yield from _looked_up(batches, answers)
        yield from answers.flush()

    return run


def _looked_up(batches: Iterator[pa.RecordBatch], answers: _Answers) -> Iterator[pa.RecordBatch]:
    part, index, ready = None, _Smallest("u8"), False
    for batch in batches:
        for p, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, index, ready = p, _Smallest("u8"), False
            if kind == OWNERS:
                ids, _, counts, hashes = _unblob(blob, "u8")
                index.add(hashes, np.repeat(ids, counts))
                continue
            if not ready:
                index.settle()
                ready = True
            if not len(index.hash):
                continue
            ids, marks, counts, hashes, places = _unblob(blob, "u8")
            at, there = index.find(hashes)
            hit = there & (index.id[at] < np.repeat(ids, counts))
            ends = np.cumsum(counts)
            some = np.flatnonzero(C.row_sums(hit, np.concatenate([[0], ends])))
            if len(some):
                begins = ends - counts
                wide = places.dtype.itemsize
                yield from answers.add(ids[some], marks[some], wide, 0, [places[begins[k] : ends[k]][hit[begins[k] : ends[k]]].tobytes() for k in some])


def _remove(window: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        hits, made = _by_document(answers), []
        for batch in docs.to_batches():
            ids, marks = _ids_marks(batch)
            for i, j, data, offsets in C.text_chunks(batch.column(2)):
                starts, ends, first = C.words(data, offsets)
                at = [np.zeros(0, np.int64)]
                for k in range(i, j):
                    at += [first[k - i] + np.frombuffer(blob, f"u{wide}").astype(np.int64) for wide, _, blob in hits.get((int(ids[k]), int(marks[k])), ())]
                gone = C.covered(np.unique(np.concatenate(at)), window, len(starts))
                keep = np.flatnonzero(~gone)
                delta = np.zeros(len(data) + 1, np.int32)
                delta[starts[keep]] += 1
                delta[ends[keep]] -= 1
                solid = np.cumsum(delta[:-1]) > 0
                row_end = offsets[1:][np.searchsorted(first, keep, side="right") - 1]
                gap = ends[keep][ends[keep] < row_end]
                out = data.copy()
                out[gap] = 0x20
                solid[gap] = True
                kept_at = np.zeros(len(data) + 1, np.int64)
                np.cumsum(solid, out=kept_at[1:])
                raw = out[solid].tobytes()
                cuts = kept_at[offsets].tolist()
                texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                made.append(pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array(C.row_sums(gone, first)),
                        pa.array([t[:-1] if t.endswith(b" ") else t for t in texts], pa.binary()),
                    ],
                    ["id", "n_words", "n_removed", "kept"],
                ))
        return pa.Table.from_batches(made, pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, only_digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space), or kept_sha256 in its place."""
    spark = docs.sparkSession
    block = (window + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-C.input_bytes(docs.select(doc_id, text)) // BUCKET_BYTES))
    keys = partition_keys(spark, n) if n == parts else list(range(n))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"), F.col(text).alias("text"))
    # as many buckets as partitions: one each; more: several in a partition, one after the other
    rows = rows.withColumn("bucket", F.element_at(F.array(*[F.lit(k) for k in keys]), bucket_column(n) + 1) if n == parts else bucket_column(n))
    routed = rows.select("id", "mark", "text").mapInArrow(_emit_anchors(keys, block, window), ROUTED).repartition(n, "part").sortWithinPartitions("part", "kind")
    hits = routed.mapInArrow(_answer_anchors(keys), HITS)
    # the same exchange of the text serves both meetings with answers, so both take the same columns; a bucket is a partition
    dealt = rows.select("id", "mark", "text", "bucket")
    near = dealt.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_emit_windows(keys, block, window), ROUTED)
    windows = near.repartition(n, "part").sortWithinPartitions("part", "kind")
    found = windows.mapInArrow(_answer_windows(keys), HITS)
    out = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_remove(window), "id long, n_words long, n_removed long, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("id") != LAST_ID, F.col("id")).cast(kind))
    if only_digest:
        return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"))


def op5_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"), only_digest=True)


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS p, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda p: array_to_string(w[p:p + {WINDOW} - 1], ' '))) AS g FROM d),
f AS (SELECT g, min(doc_id) AS m FROM s GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM s JOIN f USING (g) WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
