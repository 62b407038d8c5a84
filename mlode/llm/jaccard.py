"""Operator 6: n-gram Jaccard join by a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets, columns are 5-word shingles
(A-Z lower-cased; a shorter text is one shingle). Documents link when
100 * intersection >= 75 * union; the result has each document's component.

1. Rows: documents of equal sets are one row, named by a 64-bit fingerprint. (Of the
   128 bits computed, the second half shows whether two sets share a name; then all
   are named anew.)
2. Size-derived bounds: sets of sizes s <= t that link share
   ceil(75 * (s + t) / 175) shingles. In any common order of the columns their first
   common one then stands among the first s - ceil(6 s / 7) + 1 of the smaller set
   and the first t - ceil(0.75 t) + 1 of the larger one, and leaves that many behind it
   in both. Only these entries of the matrix are used. The order puts shingles that
   are frequent in the corpus last, by counts hashed to a fixed number of cells; it
   decides cost, never results.
3. Blocks: entries go to the partition of their column as packed arrays. The rows of a
   column and size class (sizes within a quarter are in the same or neighbouring
   classes) that meet the bounds form a group, named by its smallest row; groups of one
   name are merged. Every pair that can link is in a group.
4. Product: the whole sets of a group meet in a task, which multiplies the group's part
   of the matrix by its transpose, adds up overlap counts, discards pairs below the
   bound for their sizes, and returns a forest that spans the linked pairs. A group of
   more than ``BLOCK_ROWS`` rows or ``BLOCK_ENTRIES`` entries is dealt out in blocks:
   first some of its rows against all, then, block by block, the rows outside its
   largest component against all. No pair within that component is needed, and none
   between components is missed.
5. Links form components.

Nulls: null or wordless text has an empty set and no links; a null id is no
document id: component null. Rows with equal ids are one document: linked if any
of their rows are. Empty tables give no rows. Other columns are not read. Ids are
whole numbers (anything else that a cast to long refuses is an error).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm import common as C
from mlode.llm.substring import _Held, _runs, partition_keys

N = 5
PERCENT = 75
#: Hashed document counts that order the columns: CELLS of them, counted and merged in blocks.
CELLS, CELL_BLOCKS = 1 << 22, 256
#: Text bytes that one round of array work takes here.
ROUND_BYTES = 2 << 20
#: Rows, and entries of the matrix, that a block of a large group has.
BLOCK_ROWS, BLOCK_ENTRIES = 2000, 4_000_000
#: Entries of a partition of the columns; with more there are more partitions than the session's.
PARTITION_ENTRIES = 2_000_000
#: Prefixes are longer by a share of 1 / EXTRA of the set, and linked sets then share so many more columns there.
EXTRA = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _by_row(r: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by row and key; r needs no order."""
    o = np.argsort(key)
    rows = r[o]
    return o[np.argsort(rows.astype(np.uint16) if not len(rows) or int(rows.max()) < 1 << 16 else rows, kind="stable")]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by both."""
    data = _LOWER[data]
    starts, ends, first = C.words(data, offsets)
    hashes = C.span_hashes(data, starts, ends)
    at, counts = C.gram_rows(first, n)
    row = [np.repeat(np.arange(len(counts)), counts)]
    made = [C.gram_hashes(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)]
    size = np.diff(first)
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            made.append(C.gram_hashes(hashes, k)[first[short]] + np.uint64(k))
            row.append(short)
    r, h = np.concatenate(row), np.concatenate(made)
    order = _by_row(r, h)
    r, h = r[order], h[order]
    edge = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, bool)
    return r[edge], h[edge]


def fingerprints(ids: np.ndarray, bounds: np.ndarray, h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of each row's set and 64 further bits; a document without shingles is named by its id."""
    size, out = np.diff(bounds), []
    for base in (C.BASE_A, C.BASE_B):
        salt = C.mix(np.array([base], np.uint64) + np.uint64(seed))
        total = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(h ^ salt), dtype=np.uint64)])
        name = C.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ C.mix(size.astype(np.uint64) + salt))
        out.append(np.where(size > 0, name, C.mix(ids.view(np.uint64) ^ C.mix(salt))).view(np.int64))
    return out[0], out[1]


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(0)).astype(np.int64)


def _survey(n: int, seed: int):
    """A row for each document (kind 0: id, size, two fingerprint halves), then the task's cells (kind 1: number of the block, packed counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "size", "a", "b", "blob"]
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            ids = _ids(batch.column(0))
            for i, j, data, offsets in C.text_chunks(batch.column(1), ROUND_BYTES):
                r, h = shingle_sets(data, offsets, n)
                bounds = np.searchsorted(r, np.arange(j - i + 1))
                a, b = fingerprints(ids[i:j], bounds, h, seed)
                np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), batch.column(0).slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.array(a), pa.array(b), pa.nulls(j - i, pa.binary())], names)
        parts = [(k, x) for k, x in enumerate(cells.reshape(CELL_BLOCKS, -1)) if x.any()]
        zero = pa.array(np.zeros(len(parts), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(parts), np.int32)), pa.array([k for k, _ in parts], pa.int64()), zero, zero, zero, pa.array([zlib.compress(x.tobytes(), 1) for _, x in parts], pa.binary())], names)

    return run


def _merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels (8 times the binary logarithm of the counts) of each block of cells; rows are sorted by block."""
    at, total = None, None

    def out() -> pa.RecordBatch:
        level = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["id", "blob"])

    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != at:
                if at is not None:
                    yield out()
                at, total = k, np.zeros(CELLS // CELL_BLOCKS, np.int64)
            total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    if at is not None:
        yield out()


def cell_levels(survey: DataFrame) -> np.ndarray:
    """A level for each cell: a fixed size, whatever the corpus."""
    parts = min(CELL_BLOCKS, int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = survey.filter("kind = 1").select("id", "blob").repartition(parts, "id").sortWithinPartitions("id").mapInArrow(_merge_cells, "id long, blob binary")
    levels = np.zeros((CELL_BLOCKS, CELLS // CELL_BLOCKS), np.uint8)
    for r in merged.collect():
        levels[r["id"]] = np.frombuffer(r["blob"], np.uint8)
    return levels.ravel()


def shared_least(s, t, percent: int):
    """Shingles that sets of these sizes share if they link: the ceiling of percent * (s + t) / (100 + percent)."""
    return -(-percent * (s + t) // (100 + percent))


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sizes within a quarter of each other are in the same or neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)


def _pack(name: np.ndarray, size: np.ndarray, row: np.ndarray, low: np.ndarray, place: np.ndarray) -> bytes:
    """Rows (name, size, entries) and entries (column, place) of a part of a chunk; row is ascending."""
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    wide = 2 if int(place.max()) < 1 << 16 else 4
    rows = row[edge]
    head = np.array([len(edge), len(row), wide], np.uint32)
    return b"".join(x.tobytes() for x in (head, name[rows], size[rows].astype(np.uint32), np.diff(np.append(edge, len(row))).astype(np.uint32), low, place.astype(f"u{wide}")))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: the row's name and size, the column, the place."""
    d, n, wide = np.frombuffer(blob, np.uint32, 3).tolist()
    name, size, count = np.frombuffer(blob, np.int64, d, 12), np.frombuffer(blob, np.uint32, d, 12 + 8 * d), np.frombuffer(blob, np.uint32, d, 12 + 12 * d)
    at = 12 + 16 * d
    return np.repeat(name, count), np.repeat(size, count).astype(np.int64), np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, f"u{wide}", n, at + 4 * n).astype(np.int64)


def _emit(keys: list[int], n: int, percent: int, seed: int, levels):
    """The entries that the bounds leave, by partition of the column. Of equal sets in a chunk one is sent."""
    parts_n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            ids = _ids(batch.column(0))
            for i, j, data, offsets in C.text_chunks(batch.column(1), ROUND_BYTES):
                r, h = shingle_sets(data, offsets, n)
                if not len(h):
                    continue
                bounds = np.searchsorted(r, np.arange(j - i + 1))
                name, _ = fingerprints(ids[i:j], bounds, h, seed)
                size = np.diff(bounds)
                once = np.zeros(j - i, bool)
                once[np.unique(name, return_index=True)[1]] = True
                some = once[r]
                r, h = r[some], h[some]
                rank = (level[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                order = _by_row(r, rank)
                r, h = r[order], h[order]
                place = np.arange(len(r)) - np.searchsorted(r, np.arange(j - i))[r]
                prefix = place < (size + 1 + size // EXTRA + (-percent * size // 100))[r]
                r, h, place = r[prefix], h[prefix], place[prefix]
                part, low = ((h >> np.uint64(33)) % np.uint64(parts_n)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                order, cuts = _runs(part, r, parts_n)
                full = [k for k in range(parts_n) if cuts[k] < cuts[k + 1]]
                blobs = [_pack(name, size, r[o], low[o], place[o]) for o in (order[cuts[k] : cuts[k + 1]] for k in full)]
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in full], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    return run


class _Heads:
    """For each column and size class: the smallest row, and the smallest size of a row that can be the smaller of a pair."""

    def __init__(self):
        self.new, self.waiting = [], 0
        self.cols = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)]

    def add(self, key: np.ndarray, name: np.ndarray, least: np.ndarray) -> None:
        self.new.append((key, name, least.astype(np.uint32)))
        self.waiting += len(key)
        if self.waiting > 250_000 + len(self.cols[0]):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        key, name, least = (np.concatenate([c, *(x[k] for x in self.new)]) for k, c in enumerate(self.cols))
        order = np.argsort(key)
        key, name, least = key[order], name[order], least[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.cols = [key[edge], np.minimum.reduceat(name, edge), np.minimum.reduceat(least, edge)]
        self.new, self.waiting = [], 0


#: Rows of groups that a partition gathers before it merges them.
MERGED_ROWS = 500_000
GROUPS = "head long, name long, size long"
NEVER_SMALLER = (1 << 32) - 1


def columns_least(size, percent: int):
    """Columns that a set of this size has in common with any that links, in both prefixes: by the extra of the smallest partner."""
    return 1 + -(-percent * size // 100) // EXTRA


def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(head, name, size, columns) with one row for each name and head, in that order."""
    head, name, size, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((head, name))
    head, name, size, n = head[order], name[order], size[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (name[1:] != name[:-1])]))
    return head[edge], name[edge], size[edge], np.add.reduceat(n, edge)


def _able(percent: int):
    """GROUPS of the rows that have the columns, in all their groups, that a link would give them; all of a name's packed rows are in one partition."""

    def able(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if found:
            head, name, size, n = merged(found)
            edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            total = np.repeat(np.add.reduceat(n, edge), np.diff(np.append(edge, len(name))))
            some = total >= columns_least(size, percent)
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (head, name, size)], ["head", "name", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, []
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    yield from able(found)
                    part, found = p, []
                found.append(tuple(np.frombuffer(x.as_py(), np.int64).reshape(4, -1)))
                if len(found) > 64:
                    found = [merged(found)]
        yield from able(found)

    return run


def _group(keys: list[int], percent: int):
    """Packed (head, row, its size, columns) of the rows that meet the bounds with others in a column and class, by a partition of their names; a partition of columns is read once and kept in memory or on its own disk."""

    def key_of(low: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return (low.astype(np.uint64) << np.uint64(8)) | (cls.astype(np.uint64) & np.uint64(255))

    def fits(size: np.ndarray, place: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether a column at this place can be one that the set shares with one of the other size or more."""
        return size - place >= shared_least(other, size, percent) - size // EXTRA

    def rows_of(held: list[bytes], columns: np.ndarray, leasts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in columns, name, size) of the entries that meet the bounds."""
        for blob in held:
            name, size, low, place = _unpack(blob)
            cls, out = _size_class(size), []
            for below in (0, 1):
                key = key_of(low, cls - below)
                at = np.minimum(np.searchsorted(columns, key), len(columns) - 1)
                least = leasts[at].astype(np.int64)
                can = (least != NEVER_SMALLER) & fits(size, place, least)
                if not below:
                    can |= fits(size, place, size)
                member = np.flatnonzero((columns[at] == key) & can & (cls >= below))
                out.append((at[member], name[member], size[member]))
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def grouped(heads: _Heads, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        heads.settle()
        columns, names, leasts = heads.cols
        if not len(columns):
            return
        first, last = np.full(len(columns), (1 << 63) - 1), np.full(len(columns), -(1 << 63))
        for at, name, _ in rows_of(held, columns, leasts):  # the smallest and the largest tell whether there are several
            np.minimum.at(first, at, name)
            np.maximum.at(last, at, name)
        several = first < last
        found: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for at, name, size in rows_of(held, columns, leasts):
            some = several[at]
            found.append((names[at[some]], name[some], size[some], np.ones(int(some.sum()), np.int64)))
            waiting += len(found[-1][0])
            if waiting > MERGED_ROWS + len(found[0][0]):
                found = [merged(found)]
                waiting = len(found[0][0])
        if waiting:
            rows = np.stack(merged(found))
            to = (C.mix(rows[1].view(np.uint64)) % np.uint64(len(keys))).astype(np.int64)
            order, cuts = _runs(to, to, len(keys))
            full = [k for k in range(len(keys)) if cuts[k] < cuts[k + 1]]
            blobs = [np.ascontiguousarray(rows[:, order[cuts[k] : cuts[k + 1]]]).tobytes() for k in full]
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in full], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, heads, held = None, _Heads(), _Held()
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    yield from grouped(heads, held)
                    held.close()
                    part, heads, held = p, _Heads(), _Held()
                blob = x.as_py()
                held.add(blob)
                name, size, low, place = _unpack(blob)
                heads.add(key_of(low, _size_class(size)), name, np.where(fits(size, place, size), size, NEVER_SMALLER))
        yield from grouped(heads, held)
        held.close()

    return run


#: 64-bit words of the mask that picks the documents whose sets are made: a fixed size, whatever the corpus.
MASK_WORDS = 1 << 18


def _mask_hash(ids: np.ndarray) -> np.ndarray:
    return C.mix(ids.view(np.uint64)) & np.uint64(64 * MASK_WORDS - 1)


def mask_of(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id. More ids than bits make it useless, never wrong: it then picks documents that no pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(MASK_WORDS, np.uint64)
        for batch in batches:
            at = _mask_hash(np.asarray(batch.column(0)))
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(words[some].view(np.int64))], ["at", "bits"])

    out = np.zeros(MASK_WORDS, np.uint64)
    for r in ids.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["at"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def _make_sets(n: int, seed: int, mask):
    """(id, name, grams) of the documents whose ids are in the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = mask.value
        for batch in batches:
            at = _mask_hash(_ids(batch.column(0)))
            picked = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            if not picked.any():
                continue
            batch = batch.filter(pa.array(picked))
            ids = _ids(batch.column(0))
            for i, j, data, offsets in C.text_chunks(batch.column(1)):
                r, h = shingle_sets(data, offsets, n)
                bounds = np.searchsorted(r, np.arange(j - i + 1))
                name, _ = fingerprints(ids[i:j], bounds, h, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(name), pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in range(j - i)], pa.binary())], ["id", "name", "grams"])

    return run


#: Columns with this many rows or fewer are multiplied entry by entry, others as dense blocks of so many columns.
SPARSE_ROWS, DENSE_COLUMNS = 32, 2048


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Shared entries of each row of left and each of right (None: left again): the product of the matrix and its transpose."""
    both = right is None
    rows = left if both else left + right
    size = np.array([len(x) for x in rows])
    entries = np.concatenate(rows) if len(rows) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(entries, kind="stable")
    ranked, row = entries[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    count = np.diff(np.append(edge, len(ranked)))
    n, m = len(left), len(rows) - (0 if both else len(left))
    out = np.zeros((n, m), np.float32)
    dense = count > (1 if len(rows) <= 2 * SPARSE_ROWS else SPARSE_ROWS)
    at, wide = np.flatnonzero(dense), DENSE_COLUMNS
    for k in range(0, len(at), wide):
        some = at[k : k + wide]
        cells = np.repeat(edge[some] - np.concatenate([[0], np.cumsum(count[some])[:-1]]), count[some]) + np.arange(count[some].sum())
        x = np.zeros((len(rows), len(some)), np.float32)
        x[row[cells], np.repeat(np.arange(len(some)), count[some])] = 1
        out += x[:n] @ (x if both else x[n:]).T
    for c in np.unique(count[~dense]):
        if c < 2:
            continue
        some = edge[(count == c) & ~dense]
        for k in range(0, len(some), 1 << 14):
            group = row[some[k : k + (1 << 14), None] + np.arange(c)]
            u, v = np.broadcast_arrays(group[:, :, None], group[:, None, :])
            if not both:
                fit = (u < n) & (v >= n)
                u, v = u[fit], v[fit] - n
            np.add.at(out, (u.ravel(), v.ravel()), 1)
    if both:
        np.fill_diagonal(out, size)
    return out


def spanning(link: np.ndarray, both: bool) -> list[tuple[int, int]]:
    """Pairs (left, right) that connect what the linked pairs connect, one less than there are rows at most."""
    n, m = link.shape
    out: list[tuple[int, int]] = []
    if both:
        todo = np.ones(n, bool)
        for start in range(n):
            if not todo[start]:
                continue
            todo[start], stack = False, [start]
            while stack:
                x = stack.pop()
                found = np.flatnonzero(link[x] & todo)
                todo[found] = False
                out += [(x, int(y)) for y in found]
                stack += found.tolist()
        return out
    left, right = np.ones(n, bool), np.ones(m, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], stack = False, [(0, start)]
        while stack:
            side, x = stack.pop()
            found = np.flatnonzero(link[x] & right if side == 0 else link[:, x] & left)
            (right if side == 0 else left)[found] = False
            out += [(x, int(y)) if side == 0 else (int(y), x) for y in found]
            stack += [(1 - side, int(y)) for y in found]
    return out


def _product(percent: int):
    """Rows (head, i, j, role, name, grams) of blocks: role 0 and 1 are compared with each other, role 2 among themselves."""

    def links(names: dict[int, list[int]], sets: dict[int, list[np.ndarray]]) -> tuple[list[int], list[int]]:
        both = bool(names[2])
        left, right = (sets[2], None) if both else (sets[0], sets[1])
        if not left or not (both or right):
            return [], []
        a, b = names[2 if both else 0], names[2 if both else 1]
        s, t = np.array([len(x) for x in left]), np.array([len(x) for x in (left if both else right)])
        link = overlaps(left, right) >= shared_least(s[:, None], t[None, :], percent)
        found = spanning(link, both)
        return [a[x] for x, _ in found], [b[y] for _, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, sets = None, {}, {}
        for batch in batches:
            out: tuple[list, list] = ([], [])
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for k, (head, i, j, role, name) in enumerate(keys):
                if (head, i, j) != block:
                    if block is not None:
                        for to, x in zip(out, links(names, sets), strict=True):
                            to += x
                    block, names, sets = (head, i, j), {0: [], 1: [], 2: []}, {0: [], 1: [], 2: []}
                if names[role] and names[role][-1] == name:  # a repeated row
                    continue
                names[role].append(name)
                sets[role].append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))
            yield _links(*out)
        if block is not None:
            yield _links(*links(names, sets))

    return run


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in links: comp is the smallest id reachable. Each round joins every id to its neighbours' smallest and that id's own (large star, small star); a round's edges are deleted once the next are written."""
    kept = C.Kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        edges = kept.df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u to u's smallest
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, to u's smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, kept = kept, C.Kept(small, "edges")
        last.drop()
        now = kept.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("u").cast("decimal(38,0)")).alias("u"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).first()
        if now == before:
            return kept.df.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(kept.df.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        before = now


def _blocks_of(groups: DataFrame, spread) -> DataFrame:
    """(head, i, j, role, name) of the groups that fit one block: each row once."""
    return groups.filter(~spread).select("head", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role"), "name")


def _cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """(head, i, j, role, name): each block of left against each block of right. left and right have head, name, n_left, n_right."""
    block = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    one = left.select("head", block("n_left").alias("i"), every("n_right").alias("j"), F.lit(0).alias("role"), "name")
    two = right.select("head", every("n_left").alias("i"), block("n_right").alias("j"), F.lit(1).alias("role"), "name")
    return one.unionByName(two)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    for seed in range(8):
        survey = C.Kept(rows.mapInArrow(_survey(n, seed), "kind int, id long, size long, a long, b long, blob binary"), "survey")
        sized = survey.df.filter("kind = 0").select("id", F.col("a").alias("name"), "size", "b")
        named = sized.filter(F.col("id").isNotNull()).groupBy("name").agg(F.min("id").alias("least"), F.min("size").alias("size"), F.max("size").alias("s2"), F.min("b").alias("b"), F.max("b").alias("b2"), F.count(F.lit(1)).alias("k"))
        nodes = C.Kept(named, "nodes")
        facts = nodes.df.agg(F.count_if((F.col("b") != F.col("b2")) | (F.col("size") != F.col("s2"))).alias("clashes"), F.coalesce(F.sum("size"), F.lit(0)).alias("entries")).first()
        if not facts["clashes"]:
            break
        survey.drop()
        nodes.drop()

    known = rows.filter(F.col("id").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-facts["entries"] * (100 - percent) // (100 * PARTITION_ENTRIES)))
    levels = spark.sparkContext.broadcast(cell_levels(survey.df))
    keys = partition_keys(spark, parts)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    routed = by_part(known.mapInArrow(_emit(keys, n, percent, seed, levels), "part int, blob binary"))
    able = C.Kept(by_part(routed.mapInArrow(_group(keys, percent), "part int, blob binary")).mapInArrow(_able(percent), GROUPS), "groups")
    heads = able.df.groupBy("head").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_entries")).filter("n_rows > 1")
    heads = heads.withColumn("n_right", F.greatest(F.ceil(F.col("n_rows") / BLOCK_ROWS), F.ceil(F.col("n_entries") / BLOCK_ENTRIES)))
    groups = C.Kept(able.df.join(heads.select("head", "n_right"), "head"), "rows-of-groups")
    able.drop()
    spread = F.col("n_right") > 1
    large = groups.df.filter(spread)

    wanted = groups.df.select("name").distinct().join(nodes.df.select("name", F.col("least").alias("id")), "name")
    mask = spark.sparkContext.broadcast(mask_of(wanted.select("id")))
    # a set can come from several rows; the product takes it once
    sets = known.mapInArrow(_make_sets(n, seed, mask), "id long, name long, grams binary").select("name", "grams")

    def linked(blocks: DataFrame) -> DataFrame:
        dealt = blocks.join(sets, "name").select("head", "i", "j", "role", "name", "grams")
        return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "head", "i", "j").sortWithinPartitions("head", "i", "j", "role", "name").mapInArrow(_product(percent), "a long, b long")

    # rows of one id are one document
    same = sized.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("name").alias("a"), F.max("name").alias("b")).filter("a <> b")
    same = sized.join(same.select("id", "a"), "id").select("a", F.col("name").alias("b")).filter("a <> b").distinct()
    few = large.groupBy("head").agg(F.array_distinct(F.array(F.min("name"), F.max("name"), F.min_by("name", F.xxhash64("name")), F.max_by("name", F.xxhash64("name")))).alias("names"), F.max("n_right").alias("n_right"))
    few = few.select("head", F.explode("names").alias("name"), F.lit(1).alias("n_left"), "n_right")
    first = _blocks_of(groups.df, spread).unionByName(_cross(few, large.withColumn("n_left", F.lit(1))))
    links = [C.Kept(linked(first), "links")]
    every = links[0].df.unionByName(same)
    if large.head(1):
        comp = components(every)
        labelled = large.join(comp.withColumnRenamed("id", "name"), "name", "left").withColumn("comp", F.coalesce("comp", "name"))
        main = labelled.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("head").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
        other = C.Kept(labelled.join(main, "head").filter("comp <> main").select("head", "name", "size", "n_right"), "outside")
        n_left = other.df.groupBy("head").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_ENTRIES)).alias("n_left"))
        links.append(C.Kept(linked(_cross(other.df.join(n_left, "head"), large.join(n_left, "head"))), "links"))
        every = every.unionByName(links[1].df)
        other.drop()

    # the component of a set that links, or that several documents have
    comp = components(every).select(F.col("id").alias("name"), "comp")
    joined = nodes.df.join(comp, "name", "left").filter(F.col("comp").isNotNull() | (F.col("k") > 1)).select("name", F.coalesce("comp", "name").alias("comp"), "least")
    least = joined.groupBy("comp").agg(F.min("least").alias("first"))
    answer = C.Kept(joined.join(least, "comp").select("name", "first"), "components").df
    for x in (groups, nodes, *links):
        x.drop()
    out = sized.join(answer, "name", "left").select(F.col("id").cast(kind).alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("first", "id")).cast(kind).alias("component_id"))
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of its component (rows with a null id stay)."""
    found = jaccard_components(docs, doc_id=doc_id, **how)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - {N} + 2)), lambda p: array_to_string(w[p:p + {N} - 1], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, comp) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id WHERE r.comp < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.comp AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(comp) AS comp FROM r GROUP BY id) m ON m.id = d.doc_id
"""
