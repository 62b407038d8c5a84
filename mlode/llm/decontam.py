"""Operator 10: benchmark decontamination by MinHash containment search.

Words are lower-cased runs of letters and digits; an item's set has its distinct
5-word shingles (with fewer words, the whole sequence as one). An item of s
shingles is contained in a document if at least ``threshold`` of them occur there.

The search is over the items' MinHash sketches, in partitions by size: partition p
has the items of 2**p to 2**(p+1) - 1 shingles, and each of their sketches is the
item's floor((1 - threshold) * (2**(p+1) - 1)) + 1 + ``SPARE`` smallest shingle
hashes (all, if it has fewer). A document that contains an item of s shingles lacks
floor((1 - threshold) * s) of them at most, so it holds all but so many of the
sketch: a document is a candidate of an item if it holds that many, and has at least
threshold * 2**p shingles. The search loses nothing, however long the document is.
(Documents have no signatures: banded ones of long documents would lose short
items.) Every document is read once: its shingles, of as many words as the items'
have, are looked up in the sketches. Candidates are verified on the shingles as text.

Nulls: a null or wordless text has no shingles and matches nothing; an item
without words is contained in nothing. Rows with the same id and text give one
row for a pair (rows of one id with different texts: the largest overlap); a null
document or item id is an id like any other.
Empty tables give no rows. Other columns are not read. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlode.llm.common import table, written

N = 5
THRESHOLD = 0.75
#: Hashes of a sketch beyond those that a match needs: with them a candidate holds several.
SPARE = 3
#: Sketch hashes that are sent to every task as a set; with more, the lookup is a join on the hash.
MOST_SENT = 100_000
#: Candidates (a few numbers each) that are sent to every task to be verified; more are joined.
MOST_CANDIDATES = 200_000


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def bound_to(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it, wherever the optimizer moves it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: Column, sizes: list[int]) -> Column:
    """64-bit hashes of all runs of so many words, for each of the sizes."""
    none = F.array().cast("array<bigint>")

    def runs(h: Column, n: int) -> Column:
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))).otherwise(none)

    def over(h: Column) -> Column:
        return F.concat(*[runs(h, n) for n in sizes])

    return bound_to(F.transform(words, lambda x: F.xxhash64(x)), over)


def shingle_texts(words: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return bound_to(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none))


def item_sketches(items: DataFrame, item_id: str, text: str, n: int, threshold: float) -> DataFrame:
    """_item, _n (words a shingle), _texts (its set), _s, _part, _sketch, _hits (of the sketch, in a document that contains the item), _least (shingles of such a document)."""
    w = items.select(F.col(item_id).alias("_item"), normal_words(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    w = w.withColumn("_n", F.least(F.lit(n), F.size("_w")))
    per = None
    for k in range(1, n + 1):
        part = w.filter(F.col("_n") == k)
        part = part.select("_item", "_n", F.array_distinct(shingle_texts(F.col("_w"), k)).alias("_texts"), F.array_sort(F.array_distinct(shingle_hashes(F.col("_w"), [k]))).alias("_hashes"))
        per = part if per is None else per.unionByName(part)
    lacks = lambda s: F.floor((1 - threshold) * s + 1e-9).cast("int")
    per = per.withColumn("_s", F.size("_texts")).withColumn("_part", F.floor(F.log2(F.col("_s").cast("double")) + 1e-9).cast("int"))
    per = per.withColumn("_sketch", F.slice("_hashes", F.lit(1), lacks(F.pow(F.lit(2.0), F.col("_part") + 1) - 1) + 1 + SPARE))
    return per.withColumn("_hits", F.size("_sketch") - lacks(F.col("_s"))).withColumn("_least", F.ceil(threshold * F.pow(F.lit(2.0), F.col("_part")) - 1e-9).cast("int")).drop("_hashes")


def find_contained(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that it contains: ids, shingles of the item, shared ones, containment."""
    spark = docs.sparkSession
    sketches = item_sketches(items, item_id, item_text, n, threshold).withColumn("_set", F.xxhash64("_texts"))
    stats = sketches.agg(F.collect_set("_n").alias("ns"), F.sum(F.size("_sketch")).alias("total")).first()
    sizes, total = sorted(stats["ns"] or []), stats["total"] or 0
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    if not total:
        return spark.createDataFrame([], f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, n_item_shingles int, n_shared int, containment double")
    small = total <= MOST_SENT
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    words = texts.select("_doc", F.xxhash64("_text").alias("_row"), normal_words(F.col("_text")).alias("_w"))
    probes = shingle_hashes(F.col("_w"), sizes)
    if small:
        wanted = [r[0] for r in sketches.select(F.explode("_sketch")).distinct().collect()]
        probes = F.filter(probes, lambda x: x.isin(wanted))
    # a row's key is its id, which can be null, and the hash of its text or set, which can't
    hits = words.select(F.col("_doc").alias("_d"), "_row", F.size("_w").alias("_len"), F.array_distinct(probes).alias("_found"))
    # explode_outer: of explode() the optimizer would infer a filter that computes the hits a second time
    hits = hits.select("_d", "_row", "_len", F.explode_outer("_found").alias("_hash"))
    wide = sketches.select(F.explode("_sketch").alias("_hash"), F.col("_item").alias("_i"), "_set", "_n", "_hits", "_least")
    met = hits.join(F.broadcast(wide) if small else wide, "_hash").filter(F.col("_len") - F.col("_n") + 1 >= F.col("_least"))
    # rows of one id and text count once
    met = written(met.groupBy("_d", "_row", "_i", "_set").agg(F.count_distinct("_hash").alias("_k"), F.max("_hits").alias("_hits")).filter("_k >= _hits").drop("_k", "_hits"), "candidates")
    found_few = met.count() <= MOST_CANDIDATES
    met = met.withColumnRenamed("_row", "_r")
    pairs = texts.join(F.broadcast(met) if found_few else met, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_r") == F.xxhash64("_text")))
    pairs = pairs.select("_doc", normal_words(F.col("_text")).alias("_w"), "_i", "_set")
    own = sketches.select("_item", "_n", "_s", "_texts", F.col("_set").alias("_same"))
    pairs = pairs.join(own, F.col("_i").eqNullSafe(F.col("_item")) & (F.col("_set") == F.col("_same")))
    there = F.coalesce(*[F.when(F.col("_n") == k, shingle_texts(F.col("_w"), k)) for k in sizes])
    found = pairs.select("_doc", "_item", "_s", F.size(F.array_intersect(F.col("_texts"), there)).alias("_shared"))
    best = found.groupBy("_doc", "_item").agg(F.max("_s").alias("_s"), F.max("_shared").alias("_shared"))
    best = best.filter(F.col("_shared") >= F.ceil(threshold * F.col("_s") - 1e-9))
    return best.select(F.col("_doc").alias("doc_id"), F.col("_item").alias("item_id"), F.col("_s").alias("n_item_shingles"), F.col("_shared").alias("n_shared"), (F.col("_shared") / F.col("_s")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that contain no item."""
    doc_id = how.get("doc_id", "doc_id")
    leaks = find_contained(docs, items, **how).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs[doc_id] == leaks["_leak"], "left_anti")


def op10_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
si AS (SELECT DISTINCT item_id, least({N}, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - {N} + 2)), lambda p: array_to_string(w[p:p + least({N}, len(w)) - 1], ' '))) AS s
  FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM si),
sd AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s FROM ns, d),
sizes AS (SELECT item_id, count(*) AS c FROM si GROUP BY 1)
SELECT doc_id, item_id, CAST(any_value(c) AS INTEGER) AS n_item_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / any_value(c) AS containment
FROM sd JOIN si USING (n, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil({THRESHOLD} * any_value(c) - 1e-9)
"""
