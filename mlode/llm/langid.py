"""Operator 2: language identification by prediction by partial matching.

Each language has a context tree of depth ``DEPTH`` over the text's bytes (ASCII
letters folded to lower case, digits to 0, white space and controls to one symbol;
every other byte is itself). The probability of a byte after its context follows
PPM method C without exclusions: c / (n + q) if the byte was seen c times among
the n bytes after the longest context (q of them distinct), else the escape
probability q / (n + q) times its probability one order shorter; a context that
was never seen costs nothing; the order below zero is uniform. Statistics are
frozen after training, so a text's code length is an exact sum over its bytes
under each language, and the smallest wins (ties: the first in name order). The
score is the winner's posterior under equal priors, with code lengths scaled to
``EVIDENCE`` bytes at most so that long texts don't all score 1.

Training takes a bounded sample: for each of the ``MOST_LANGS`` most frequent
languages the ``DOCS_PER_LANG`` documents (of at most ``LONGEST`` characters; where
there are too few, up to ``LONGEST_ANY``) with the smallest id hashes among those
whose crc32(id as text) mod 4 is not ``HELD_OUT`` and whose language is not null.
Of rows with one id and language the smallest text counts. The model (dense tables for the two lower orders, keys that were seen for
the two higher ones) is some MB a language and is broadcast.

Nulls: a null text, or one without a letter, is ``und`` with score 0; a null id
counts as the empty text for the split. Without training rows all are ``und``.
Repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlode.llm import common as C

DEPTH = 3
SYMBOLS = 256
DOCS_PER_LANG = 400
LONGEST, LONGEST_ANY = 20_000, 1_000_000
MOST_LANGS = 64
HELD_OUT = 2
EVIDENCE = 40
UND = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def symbol_map() -> np.ndarray:
    """The symbol of each byte value."""
    out = np.arange(SYMBOLS, dtype=np.uint32)
    out[:33] = out[127] = 0
    out[48:58] = 48
    out[65:91] += 32
    return out


class Keys:
    """Places of numbers in a sorted array of distinct ones, by two hash tables and a short list of what both leave out."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys.astype(np.uint32), [], np.arange(len(keys), dtype=np.int32)
        self.shift = np.uint32(32 - max(10, int(len(keys) * 4).bit_length()))
        for odd in (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)):
            table = np.full(1 << (32 - int(self.shift)), -1, np.int32)
            slot = (self.keys[left] * odd) >> self.shift
            table[slot] = left
            self.tables.append((odd, table))
            left = left[table[slot] != left]
        self.rest, self.rest_at = self.keys[left], left

    def find(self, sought: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for one that isn't there."""
        out = np.full(len(sought), -1, np.int32)
        if not len(self.keys):
            return out
        todo = np.arange(len(sought))
        for odd, table in self.tables:
            mine = sought[todo]
            at = table[(mine * odd) >> self.shift]
            hit = (at >= 0) & (self.keys[at] == mine)
            out[todo[hit]] = at[hit]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            mine = sought[todo]
            at = np.minimum(np.searchsorted(self.rest, mine), len(self.rest) - 1)
            hit = self.rest[at] == mine
            out[todo[hit]] = self.rest_at[at[hit]]
        return out


def _contexts(symbols: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """For each order k, the number that context and symbol spell; before a text stand white-space symbols."""
    keys, key = [symbols], symbols.astype(np.uint32)
    for k in range(1, DEPTH + 1):
        back = np.zeros(len(symbols), np.uint32)
        back[k:] = symbols[:-k] if len(symbols) > k else 0
        for d in range(k):
            at = begins + d
            back[at[at < len(back)]] = 0
        key = key + back * np.uint32(SYMBOLS**k)
        keys.append(key)
    return keys


class Model:
    """Code lengths in bits of a symbol after its context under each language.

    low: of all pairs (one symbol of context). Of longer contexts: rows for the keys (context and symbol) that some language saw, and what escaping from a context costs."""

    def __init__(self, langs: list[str], texts: dict[str, list[bytes]]):
        self.langs, self.map = langs, symbol_map()
        counted = []
        for lang in langs:
            raw = np.frombuffer(b"".join(texts[lang]), np.uint8)
            lengths = np.array([len(t) for t in texts[lang]], np.int64)
            keys = _contexts(self.map[raw], np.cumsum(lengths) - lengths)
            counted.append([np.unique(k, return_counts=True) for k in keys])
        self.low = np.stack([self._lower(c) for c in counted], 1)
        self.seen, self.rows, self.contexts, self.escapes = {}, {}, {}, {}
        for k in range(2, DEPTH + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counted]))
            contexts = np.unique(keys // SYMBOLS)
            escapes = np.zeros((len(contexts), len(langs)), np.float32)
            own = np.full((len(keys), len(langs)), np.nan, np.float32)
            for i, c in enumerate(counted):
                found, cost, after, escape = self._costs(*c[k])
                own[np.searchsorted(keys, found), i] = cost
                escapes[np.searchsorted(contexts, after), i] = escape
            # a language that didn't see the symbol there escapes to the shorter context
            rest = escapes[np.searchsorted(contexts, keys // SYMBOLS)] + self._shorter(keys % np.uint32(SYMBOLS**k), k - 1)
            self.rows[k] = np.where(np.isnan(own), rest, own)
            self.seen[k], self.contexts[k], self.escapes[k] = Keys(keys), Keys(contexts), np.concatenate([escapes, np.zeros((1, len(langs)), np.float32)])

    def _costs(self, found: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys and their costs, contexts and the cost of escaping from them, by method C."""
        after, at, kinds = np.unique(found // SYMBOLS, return_inverse=True, return_counts=True)
        total = np.bincount(at, count)
        return found, np.log2((total + kinds)[at] / count), after, np.log2((total + kinds) / kinds)

    def _lower(self, counted: list) -> np.ndarray:
        """Of one language, for all pairs of symbols."""
        cost = np.full(SYMBOLS, np.log2(SYMBOLS))
        found, own, _, escape = self._costs(*counted[0])
        cost += escape[0] if len(escape) else 0
        cost[found] = own
        found, own, after, escape = self._costs(*counted[1])
        pairs = np.tile(cost, (SYMBOLS, 1))
        pairs[after] += escape[:, None]
        pairs = pairs.ravel()
        pairs[found] = own
        return pairs.astype(np.float32)

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs of keys of k symbols of context and one more."""
        if k == 1:
            return self.low[keys]
        at = self.seen[k].find(keys)
        out = self.rows[k][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            there = keys[miss]
            out[miss] = self.escapes[k][self.contexts[k].find(there // np.uint32(SYMBOLS))] + self._shorter(there % np.uint32(SYMBOLS**k), k - 1)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of each row under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        costs = self._shorter(_contexts(self.map[data], offsets[:-1][offsets[:-1] < len(data)])[DEPTH], DEPTH)
        some = offsets[:-1] < offsets[1:]
        for i in range(len(self.langs)):
            out[some, i] = np.add.reduceat(costs[:, i].astype(np.float64), offsets[:-1][some])
        return out


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, longest: int = LONGEST) -> Model | None:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter((F.crc32(key) % 4 != HELD_OUT) & F.col("_lang").isNotNull() & F.col("_id").isNotNull())
    usable = rows.filter((F.length("_text") <= LONGEST_ANY) & (F.length("_text") > 0)).withColumn("_long", F.length("_text") > longest)
    # at most MOST_LANGS rows of counts; only rows whose hash share can be among the smallest (four times as many as are wanted) are ranked
    share = F.col("_hash") / float(1 << 64) + 0.5
    thin = usable.select("_id", "_lang", "_long", F.xxhash64("_id").alias("_hash"))
    langs = thin.groupBy("_lang").agg(F.count_if(~F.col("_long")).alias("_n"), F.count(F.lit(1)).alias("_all")).orderBy(F.desc("_all"), "_lang").limit(MOST_LANGS)
    few = thin.join(F.broadcast(langs), "_lang").filter(F.when(F.col("_n") >= docs_per_lang, ~F.col("_long") & (share * F.col("_n") <= 4.0 * docs_per_lang)).otherwise(share * F.col("_all") <= 4.0 * docs_per_lang))
    once = few.groupBy("_lang", "_id", "_hash").agg(F.min("_long").alias("_long"))
    ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy("_long", "_hash", "_id")))
    chosen = ranked.filter(F.col("_rank") <= docs_per_lang).select("_id", "_lang", "_long")
    # a row for each chosen id: a fixed bound for the driver
    sample = usable.join(F.broadcast(chosen), ["_id", "_lang", "_long"]).groupBy("_lang", "_id").agg(F.min("_text").alias("_text")).orderBy("_lang", F.xxhash64("_id"), "_id").collect()
    texts: dict[str, list[bytes]] = {}
    for r in sample:
        texts.setdefault(r["_lang"], []).append(r["_text"].encode())
    return Model(sorted(texts), texts) if texts else None


def predict(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    held = (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == HELD_OUT).alias("held_out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held, F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array([*m.langs, UND])
        for batch in batches:
            texts = batch.column(2)
            for i, j, data, offsets in C.text_chunks(texts):
                bits = m.bits(data, offsets)
                best = bits.argmin(1)
                size = np.maximum(np.diff(offsets), 1)
                gap = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, EVIDENCE) / size)[:, None]
                score = 1 / np.exp2(-gap).sum(1)
                lettered = C.row_sums(_ASCII_LETTER[data], offsets) > 0
                for k in np.flatnonzero(~lettered):
                    lettered[k] = any(c.isalpha() for c in texts[i + int(k)].as_py() or "")
                pick = np.where(lettered, best, len(m.langs)).astype(np.int32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), names.take(pa.array(pick)), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))
